import pytest
from pyspark.sql import functions as F

from allelio.functions import fields, keys


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(col.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("chr1:228208044-228378877", ("chr1", 228208044, 228378877)),
        ("5-9", (None, 5, 9)),
        ("chrX:5", (None, None, None)),
        ("", (None, None, None)),
    ],
)
def test_parse_interval(spark, text, want):
    assert tuple(one(spark, keys.parse_interval("t"), t=text)) == want


def test_variant_id_is_null_if_a_part_is(spark):
    assert one(spark, keys.variant_id(F.lit("1"), F.lit(5), F.lit("A"), F.lit("T"))) == "1:5:A:T"
    assert one(spark, keys.variant_id(F.lit("1"), F.lit(5), F.lit(None), F.lit("T"))) is None


def test_contigs(spark):
    assert one(spark, keys.norm_contig("c"), c="chr12") == "12"
    assert one(spark, keys.norm_contig("c", "chr"), c="12") == "chr12"
    assert one(spark, keys.norm_contig("c"), c="un_chr1") == "un_chr1"
    ranks = spark.createDataFrame([("chr2",), ("chr10",), ("chrX",), ("chrM",), ("HLA",)], "c string")
    got = [r["c"] for r in ranks.orderBy(keys.contig_rank("c")).collect()]
    assert got == ["chr2", "chr10", "chrX", "chrM", "HLA"]


@pytest.mark.parametrize(
    "ref, alt, want",
    [("A", "G", True), ("A", "A", False), ("A", "AT", False), ("AC", "AT", True), ("AC", "GT", False), ("A", "*", False), ("A", "<DEL>", False)],
)
def test_is_snp(spark, ref, alt, want):
    assert one(spark, keys.is_snp("r", "a"), r=ref, a=alt) is want


def test_names(spark):
    assert one(spark, keys.canonical_gene("g"), g="NKX2_5") == "NKX2-5"
    assert one(spark, keys.canonical_gene("g"), g="TTN") == "TTN"
    assert one(spark, keys.strip_suffix("n", ".raw", ".bed"), n="DSP_draw_lof.raw") == "DSP_draw_lof"
    assert one(spark, keys.gene_from_path("n", "eur"), n="eur_BAG3_10_1-2_2.afreq") == "BAG3"
    assert one(spark, keys.gene_from_path("n", "eur"), n="afr_BAG3_10_1-2_2.afreq") == "afr_BAG3_10_1-2_2.afreq"
    # Canonical spelling has no underscore, so the file name still yields the whole symbol.
    assert one(spark, keys.gene_from_path("n", "eur"), n="eur_NKX2-5_5_1-2_2.afreq") == "NKX2-5"


def test_info(spark):
    info = "AC=1,2;DB;ANN=A|x=y|z;CLNSIG=Pathogenic;XAC=9"
    assert one(spark, fields.info_field("i", "AC"), i=info) == "1,2"
    assert one(spark, fields.info_field("i", "ANN"), i=info) == "A|x=y|z"
    assert one(spark, fields.info_field("i", "DB"), i=info) is None
    assert one(spark, fields.info_field("i", "SIG"), i=info) is None


def test_scores(spark):
    assert one(spark, fields.score_array("s"), s="[0.7,null,0.3]") == [0.7, None, 0.3]
    assert one(spark, fields.score("s"), s=".") is None
    assert one(spark, fields.any_score_ge("s", 0.65), s="[null,0.65]") is True
    assert one(spark, fields.any_score_ge("s", 0.65), s="[null,0.1]") is False
    assert one(spark, fields.any_score_ge("s", 0.65), s="[0,0,0,0,0,0.9]") is True
    assert one(spark, fields.any_score_ge("s", 0.65), s=None) is False


def test_rowwise_max_skips_null_and_nan(spark):
    df = spark.createDataFrame([(0.1, float("nan"), None), (None, None, float("nan"))], "a double, b double, c double")
    assert [r[0] for r in df.select(fields.rowwise_max("a", "b", "c")).collect()] == [0.1, None]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("TTN",), (None,), ("DES",)], "g string")
    assert [r["g"] for r in df.filter(fields.not_in("g", ["TTN"])).collect()] == [None, "DES"]


def test_flip_dosage(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "d int")
    assert [r[0] for r in df.select(fields.flip_dosage("d")).collect()] == [2, 1, 0, None, None]


def test_fix_info_header(spark):
    bad = '##INFO=<ID=AS_VQSLOD,Number=A,Type=Float,Description="">'
    good = '##INFO=<ID=AC,Number=A,Type=Integer,Description="Count">'
    assert one(spark, fields.repair_header("l"), l=bad) == '##INFO=<ID=AS_VQSLOD,Number=.,Type=String,Description="Description not provided">'
    assert one(spark, fields.repair_header("l"), l=good) == good
    for line, want in [
        ('##INFO=<ID=A,Description="",Number=1,Type=Integer>', '##INFO=<ID=A,Description="Description not provided",Number=.,Type=String>'),
        ('##INFO=<ID=A,Number=1,Source="x, \\"y\\"",Type=Float,Description="",Version="3">', '##INFO=<ID=A,Number=.,Source="x, \\"y\\"",Type=String,Description="Description not provided",Version="3">'),
        ('##FILTER=<ID=A,Description="">', '##FILTER=<ID=A,Description="">'),
        ("##fileformat=VCFv4.2", "##fileformat=VCFv4.2"),
    ]:
        assert one(spark, fields.repair_header("l"), l=line) == want


def test_geneinfo(spark):
    assert one(spark, fields.geneinfo_symbol("g"), g="BAG3:9531|RAB:1") == "BAG3"
    assert one(spark, fields.geneinfo_symbols("g"), g="BAG3:9531|RAB:1") == ["BAG3", "RAB"]
