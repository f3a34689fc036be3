"""Gene panels, cutoffs and column layouts. Everything here is a default; operators take them as arguments."""

# ---------------------------------------------------------------------------
# These must stay exactly as they are for results to be right.
# ---------------------------------------------------------------------------

# Extraction panel: gene and its interval on GRCh38.
GENE_REGIONS = [
    ("OBSCN", "chr1:228208044-228378877"),
    ("PLEKHM2", "chr1:15681506-15734770"),
    ("PRDM16", "chr1:3069168-3438622"),
    ("PSEN2", "chr1:226870184-226927727"),
    ("TNNI3K", "chr1:74235387-74544429"),
    ("LMNA", "chr1:155682573-156540082"),
    ("TNNT2", "chr1:200959008-201777829"),
    ("ACTN2", "chr1:236264141-237164632"),
    ("RIT1", "chr1:155497808-156311405"),
    ("NEXN", "chr1:77488624-78343896"),
    ("RYR2", "chr1:237042184-237833989"),
    ("TRIM63", "chr1:26051301-26068437"),
    ("ANKRD1", "chr10:90912096-90921088"),
    ("MYPN", "chr10:68087897-68212018"),
    ("NEBL", "chr10:20779973-21293051"),
    ("COX15", "chr10:99294293-100132132"),
    ("LDB3", "chr10:86268511-87136073"),
    ("RBM20", "chr10:110244336-111239469"),
    ("VCL", "chr10:73595193-74521364"),
    ("BAG3", "chr10:119251380-120077820"),
    ("CTNNA3", "chr10:65912457-67763638"),
    ("ILK", "chr11:6603708-6610875"),
    ("KCNQ1", "chr11:2444684-2849106"),
    ("MYBPC3", "chr11:46952957-47774254"),
    ("CRYAB", "chr11:111508564-112323741"),
    ("CSRP3", "chr11:18782030-19610572"),
    ("MYL2", "chr12:110510819-111321444"),
    ("ABCC9", "chr12:21397389-22342544"),
    ("CACNA1C", "chr12:1569552-3097951"),
    ("PTPN11", "chr12:112018351-112909919"),
    ("PKP2", "chr12:32390755-33296777"),
    ("MYH6", "chr14:23381982-23408274"),
    ("MYH7", "chr14:23012740-23835678"),
    ("TGFB3", "chr14:75958097-75983012"),
    ("TPM1", "chr15:62642632-63471916"),
    ("ALPK3", "chr15:84417356-85273480"),
    ("ACTC1", "chr15:34390230-35195550"),
    ("TJP1", "chr15:29699367-29969050"),
    ("CTF1", "chr16:30895824-30903561"),
    ("TCAP", "chr17:39665349-39666555"),
    ("GAA", "chr17:79701535-80519882"),
    ("JUP", "chr17:41354604-42186932"),
    ("DTNA", "chr18:34493291-34891845"),
    ("TTR", "chr18:31157009-31998834"),
    ("DSC2", "chr18:30658840-31502523"),
    ("DSG2", "chr18:31098177-31949009"),
    ("CDH2", "chr18:27932878-28177947"),
    ("MYOM1", "chr18:3066807-3220109"),
    ("TNNI3", "chr19:54751767-55557774"),
    ("CALR3", "chr19:16479061-16496168"),
    ("TTN", "chr2:178125989-179230803"),
    ("DES", "chr2:219018377-219826736"),
    ("JPH2", "chr20:43706590-44587947"),
    ("MYLK2", "chr20:31819308-31834690"),
    ("SCN5A", "chr3:38148057-39049688"),
    ("MYL3", "chr3:46435123-47282173"),
    ("CAV3", "chr3:8333802-9241809"),
    ("RAF1", "chr3:12183601-13064126"),
    ("TMEM43", "chr3:13725006-14543681"),
    ("TNNC1", "chr3:52051100-52854042"),
    ("SLC25A4", "chr4:184743266-185550383"),
    ("MYOZ2", "chr4:119135832-119187790"),
    ("PDLIM3", "chr4:185500660-185535508"),
    ("NKX2-5", "chr5:173232109-173235322"),
    ("SGCD", "chr5:155728636-156767789"),
    ("EYA4", "chr6:133240340-133532129"),
    ("LAMA4", "chr6:112107931-112254940"),
    ("DSP", "chr6:7141617-7986715"),
    ("MYO6", "chr6:75349192-76319538"),
    ("PLN", "chr6:118148296-118961717"),
    ("KCNH2", "chr7:150944961-150978322"),
    ("GATAD1", "chr7:92447448-92494632"),
    ("TBX20", "chr7:35199936-35254101"),
    ("FLNC", "chr7:128430406-129259275"),
    ("PRKAG2", "chr7:151156124-152277126"),
    ("KLF10", "chr8:102648784-102655726"),
    ("FXN", "chr9:68635751-69479077"),
    ("GLA", "chrX:100993273-101808013"),
    ("FHL1", "chrX:135746702-136611360"),
    ("LAMP2", "chrX:120026148-120869366"),
]

# Spellings of one gene that differ between inputs.
GENE_ALIASES = {"NKX2_5": "NKX2-5"}

# Genetic ancestry groups of the cohort.
ANCESTRIES = ["eur", "afr", "amr", "eas", "sas", "mid"]

# Order in which the gene named by an ancestry's frequency file is taken.
GENE_SOURCE_ORDER = ["eur", "amr", "afr", "eas", "sas", "mid"]

# Ancestry labels of the public frequency table.
PUBLIC_ANCESTRIES = ["afr", "amr", "asj", "eas", "fin", "nfe", "sas", "oth"]

DISEASES = ["dcm", "hcm", "arvc"]
IMPACTS = ["lp_p", "lof", "missense"]

# Genes whose ClinVar P/LP variants count for a disease.
PLP_GENES = {
    "dcm": ["TTN", "MYH7", "LMNA", "FLNC", "DSP", "DES", "TNNT2", "SCN5A", "ACTC1", "PLN", "TNNC1", "BAG3", "TNNI3", "TPM1"],
    "hcm": ["MYH7", "MYBPC3", "TNNT2", "TPM1", "TNNI3", "MYL2", "MYL3", "ACTC1", "TNNC1"],
    "arvc": ["DSC2", "DSG2", "DSP", "PKP2", "TMEM43", "JUP", "DES", "PLN"],
}

# Genes whose loss-of-function and missense variants count for a disease.
TIER_GENES = {
    "dcm": ["BAG3", "DES", "FLNC", "LMNA", "MYH7", "PLN", "RBM20", "SCN5A", "TNNC1", "TNNT2", "TTN", "DSP", "ACTC1", "ACTN2"],
    "hcm": ["MYBPC3", "MYH7", "TNNT2", "TNNI3", "TPM1", "ACTC1", "MYL3", "MYL2"],
    "arvc": ["PKP2", "DSP", "DSG2", "DSC2", "JUP", "TMEM43"],
}

# Genes in which an impact is a known mechanism of disease.
KNOWN_MECHANISM = {
    "lof": ["PKP2", "DSP", "DSC2", "JUP", "DSG2", "BAG3", "FLNC", "TTN", "PLN", "LMNA", "RBM20", "MYBPC3", "ACTN2"],
    "missense": ["MYBPC3", "MYH7", "TNNT2", "TNNI3", "TPM1", "ACTC1", "MYL3", "MYL2", "PLN", "DES", "DSG2", "SCN5A", "TNNC1", "LMNA", "RBM20"],
}

# Genes whose genotypes are read for carrier status.
CARRIER_GENES = [
    "LMNA", "TNNT2", "ACTN2", "RBM20", "BAG3", "MYBPC3", "MYL2", "PKP2", "MYH7", "ACTC1", "TPM1", "JUP",
    "DSC2", "DSG2", "TNNI3", "TTN", "DES", "TMEM43", "SCN5A", "MYL3", "TNNC1", "PLN", "DSP", "FLNC",
]

RARE_AF = 0.001
FAF_CUTOFFS = {"dcm": 8.4e-05, "hcm": 4e-05, "arvc": 9.2e-05}
REVEL_CUTOFF = 0.65
EXON_PAD = 10

# ClinVar classes and review states.
CLNSIG_PLP = ["Pathogenic", "Likely_pathogenic", "Pathogenic/Likely_pathogenic"]
CLNSIG_BENIGN = ["Benign", "Benign/Likely_benign", "Likely_benign"]
TWO_STAR = ["criteria_provided,_multiple_submitters,_no_conflicts", "reviewed_by_expert_panel"]

# Patterns that put a consequence row into a category; categories overlap.
CATEGORY_PATTERNS = {
    "clinvar": ("CLNSIG", "Pathogenic|Likely_pathogenic|Pathogenic/Likely_pathogenic"),
    "lof": ("EFFECT", "stop_gained|frameshift|splice_acceptor|splice_donor|start_lost|splice"),
    "missense": ("EFFECT", "missense"),
}
INTERVAR_PATHOGENIC = "pathogenic|Pathogenic"

# Layout of a consequence row.
CONSEQUENCE_COLS = [
    "CHROM", "POS", "ID", "REF", "ALT", "ALLELE", "EFFECT", "GENE", "FEATURE", "HGVS_C", "HGVS_P",
    "GENEINFO", "CLNSIG", "CLNREVSTAT",
]

# Place of each field inside one pipe-separated ANN entry (VCF annotation format 1.0).
ANN_FIELDS = {"ALLELE": 0, "EFFECT": 1, "GENE": 3, "FEATURE": 6, "HGVS_C": 9, "HGVS_P": 10}

# Pseudo-autosomal regions of chromosome X on GRCh38, 1-based closed.
PAR_X = [(10001, 2781479), (155701383, 156030895)]

# ---------------------------------------------------------------------------

VARIANT_KEY = ["contig", "pos", "ref", "alt"]
