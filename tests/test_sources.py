import gzip
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelio import schemas, session
from allelio.operators import annotation
from allelio.sources import readers, writers

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1
chr1\t100\trs1\tA\tG,T\t50\tPASS\tAC=1,2;ANN=G|missense_variant|M|TTN|E|transcript|NM_1|pc|1/2|c.1A>G|p.1,T|stop_gained|H|TTN|E|transcript|NM_1|pc|1/2|c.1A>T|p.2;CLNSIG=Pathogenic\tGT\t0/1
chr1\t200\t.\tC\tCA\t.\tLowQual\tAC=3;DB\tGT\t0/0
chrX\t300\trs3\tG\t.\t.\tPASS\t.\tGT\t0/0
"""


@pytest.mark.parametrize("name", ["a.vcf", "a.vcf.gz", "a.vcf.bgz"])
def test_read_vcf(spark, tmp_path, rows, name):
    path = tmp_path / name
    data = VCF.encode()
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else bgzf(data, 100) if name.endswith(".bgz") else data)
    df = readers.read_vcf(spark, str(path))
    assert df.columns == readers.VCF_FIELDS
    got = [(r.contig, r.pos, r.id, r.ref, r.alts, r.qual, r.filter, r.info) for r in df.orderBy("pos").collect()]
    assert got[0][:7] == ("chr1", 100, "rs1", "A", ["G", "T"], "50", "PASS")
    assert got[1] == ("chr1", 200, None, "C", ["CA"], None, "LowQual", "AC=3;DB")
    assert got[2] == ("chrX", 300, "rs3", "G", None, None, "PASS", None)
    assert rows(readers.read_vcf_header(spark, str(path)))[0][0].startswith("##INFO")


def test_alleles_keep_their_own_annotation(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(VCF)
    alleles = annotation.split_alleles(readers.read_vcf(spark, str(path)).filter("pos = 100"), "alts")
    out = annotation.extract_fields(annotation.explode_ann(alleles, annotation.match_allele(annotation.ann_entries())))
    got = [(r.ALT, r.ALLELE, r.EFFECT, r.GENE, r.HGVS_P) for r in out.orderBy("ALT").collect()]
    assert got == [("G", "G", "missense_variant", "TTN", "p.1"), ("T", "T", "stop_gained", "TTN", "p.2")]


def test_source_without_id_keeps_the_layout(spark):
    df = spark.createDataFrame(
        [("chr1", 5, "A", "G", "ANN=G|missense_variant|M|TTN|E|transcript|NM_1|pc|1/2|c.1|p.1;GENEINFO=TTN:1")],
        "contig string, pos bigint, ref string, alt string, info string",
    )
    row = annotation.extract_fields(annotation.explode_ann(df)).first()
    assert (row.ID, row.REF, row.ALT, row.GENE, row.FEATURE, row.GENEINFO, row.CLNSIG) == (None, "A", "G", "TTN", "NM_1", "TTN:1", None)


def test_no_hit_gives_an_empty_table(spark):
    df = spark.createDataFrame([("synonymous_variant", None)], "EFFECT string, CLNSIG string")
    assert annotation.categorise(df).count() == 0


def bgzf(data: bytes, block: int) -> bytes:
    out = []
    for i in [*range(0, len(data), block), None]:
        text = b"" if i is None else data[i : i + block]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(text) + c.flush()
        head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + b"\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(text), len(text)))
    return b"".join(out)


@pytest.mark.parametrize("split", [50, 400, 3_000, 10_000_000])
@pytest.mark.parametrize("last", ["\n", ""])
def test_block_gzip_is_split_without_loss(spark, tmp_path, split, last):
    rng = random.Random(split)
    # Lines shorter and much longer than a block, empty lines, and a line that ends at a block's end.
    lines = [f"{i}:" + "x" * rng.choice([0, 3, 40, 500]) for i in range(400)] + ["", "end"]
    (tmp_path / "t.bgz").write_bytes(bgzf(("\n".join(lines) + last).encode(), 64))
    from allelio.sources.blocks import BgzfText

    spark.dataSource.register(BgzfText)
    df = spark.read.format("bgzf_text").option("splitBytes", split).load(str(tmp_path / "t.bgz"))
    assert sorted(r["value"] for r in df.collect()) == sorted(lines)


def test_plain_gzip_named_bgz_is_refused(spark, tmp_path):
    (tmp_path / "t.bgz").write_bytes(gzip.compress(b"a\nb\n"))
    with pytest.raises(Exception, match="block-gzip"):
        readers.read_lines(spark, str(tmp_path / "t.bgz")).collect()


def test_read_tsv_by_name(spark, tmp_path):
    text = "Extra\t#Chr\tHg38 start\tInterVar: InterVar and Evidence\nx\t1\t10\tLikely pathogenic\ny\tX\t.\t.\n"
    (tmp_path / "a.tsv").write_text(text)
    (tmp_path / "a.tsv.bgz").write_bytes(bgzf(text.encode(), 20))
    columns = {"Hg38 start": ("start_pos", "bigint"), "InterVar: InterVar and Evidence": ("intervar", "string"), "#Chr": ("contig", "string")}
    for name in ("a.tsv", "a.tsv.bgz"):
        df = readers.read_tsv(spark, str(tmp_path / name), columns)
        assert df.dtypes == [("start_pos", "bigint"), ("intervar", "string"), ("contig", "string")]
        assert sorted(map(tuple, df.collect()), key=repr) == [(10, "Likely pathogenic", "1"), (None, None, "X")]


def test_nan_frequency_and_afreq_layout(spark, tmp_path):
    (tmp_path / "eur_TTN_2_1-9_2.afreq").write_text("#CHROM\tID\tREF\tALT\tALT_FREQS\tOBS_CT\n2\t2:5:A:G\tA\tG\t0.25\t4\n2\t2:6:A:G\tA\tG\tnan\t0\n")
    (tmp_path / "afr_TTN_2_1-9_2.afreq").write_text("#CHROM\tID\tREF\tALT\tALT_FREQS\tOBS_CT\n2\t2:5:A:G\tA\tG\t0\t4\n")
    (tmp_path / "other.log").write_text("x\n")
    df = readers.with_provenance(
        readers.read_glob(spark, str(tmp_path), "*.afreq", schemas.AFREQ_TSV),
        {"ancestry": r"([a-z]+)_[^/]*\.afreq$", "gene": r"[a-z]+_([^_/]+)_[^/]*\.afreq$"},
    )
    from allelio.operators import frequency

    assert df.count() == 3
    kept = frequency.nonzero_af(df).collect()
    assert [(r.variant_id, r.alt_freq, r.ancestry, r.gene) for r in kept] == [("2:5:A:G", 0.25, "eur", "TTN")]


def test_regions_and_raw(spark, tmp_path, rows):
    (tmp_path / "r.txt").write_text("1\tLMNA\t100-200\nX\tGLA\t5-6\n")
    assert rows(readers.read_regions(spark, str(tmp_path / "r.txt"))) == [("GLA", "X", 5, 6), ("LMNA", "1", 100, 200)]
    raw = "FID\tIID\tPAT\tMAT\tSEX\tPHENOTYPE\tchr1:5:A:G_A\tchr1:9:C:T_C\n0\ts1\t0\t0\t1\t-9\t2\t1\n0\ts2\t0\t0\t2\t-9\tNA\t0\n"
    (tmp_path / "g.raw").write_text(raw)
    got = rows(readers.read_raw(spark, str(tmp_path / "g.raw")))
    assert got == [("s1", "chr1:5:A:G_A", 2), ("s1", "chr1:9:C:T_C", 1), ("s2", "chr1:5:A:G_A", None), ("s2", "chr1:9:C:T_C", 0)]


def test_dosages_count_alt(spark, tmp_path, rows):
    n = 25_000
    head = "FID\tIID\tPAT\tMAT\tSEX\tPHENOTYPE\t" + "\t".join(f"1:{i}:A:G_{'AG'[i % 2]}" for i in range(n))
    (tmp_path / "g.raw").write_text(head + "\n" + "0\ts1\t0\t0\t1\t-9" + "\t2" * (n - 1) + "\tNA\n")
    raw = readers.read_raw(spark, str(tmp_path / "g.raw"))
    assert raw.count() == n
    got = {r.pos: r.alt_dosage for r in readers.dosage_calls(raw).collect()}
    assert got == {i: 2 for i in range(1, n - 1, 2)} | {n - 1: None}  # two of REF are none of ALT
    odd = spark.createDataFrame([("s", "rs1_C", 1)], "sample_id string, variant string, dosage int")
    with pytest.raises(Exception, match="not a counted variant"):
        readers.dosage_calls(odd).collect()


@pytest.mark.parametrize("ending", ["tsv", "tsv.gz", "tsv.bgz"])
def test_every_file_is_read_by_its_own_header(spark, tmp_path, ending):
    def write(name, text):
        data = text.encode()
        (tmp_path / f"{name}.{ending}").write_bytes(bgzf(data, 9) if ending.endswith("bgz") else gzip.compress(data) if ending.endswith("gz") else data)

    write("a", "ID\tFREQ\nx\t0.1\nID\tFREQ\n")  # a row that looks like the header is a row
    write("b", "FREQ\tMore\tID\n0.2\tm\ty\n0.3\t\tz\n")
    write("c", "ID\tFREQ\n")
    columns = {"ID": ("id", "string"), "FREQ": ("freq", "double")}
    df = readers.read_glob(spark, str(tmp_path), f"*.{ending}", columns)
    assert df.columns == ["id", "freq", "path"]
    got = sorted((r.id, r.freq, r.path.rsplit("/", 1)[1][0]) for r in df.collect() if r.id != "ID")
    assert got == [("x", 0.1, "a"), ("y", 0.2, "b"), ("z", 0.3, "b")]
    assert [(r.freq, r.path.rsplit("/", 1)[1][0]) for r in df.collect() if r.id == "ID"] == [(None, "a")]
    write("d", "NAME\tFREQ\nx\t0.1\n")
    with pytest.raises(ValueError, match="no column 'ID'"):
        readers.read_glob(spark, str(tmp_path), f"*.{ending}", columns)


def test_folders_name_columns_of_files_with_other_headers(spark, tmp_path):
    for gene, text in (("TTN", "ID\tAF\nx\t0.1\n"), ("DSP", "AF\tID\n0.2\ty\n")):
        (tmp_path / "t" / f"gene={gene}").mkdir(parents=True)
        (tmp_path / "t" / f"gene={gene}" / "part.tsv").write_text(text)
    columns = {"ID": ("id", "string"), "AF": ("af", "double"), "gene": ("gene", "string")}
    assert sorted(map(tuple, readers.read_tsv(spark, str(tmp_path / "t"), columns).collect())) == [("x", 0.1, "TTN"), ("y", 0.2, "DSP")]


def test_arrays_go_through_text(spark, tmp_path, rows):
    from allelio.plans.pipelines import public_rare

    flat = spark.createDataFrame([("chr1:5", ["A", "G"], 0.0005), ("chr1:6", ["A", "T"], 0.5)], "locus string, alleles array<string>, joint_grpmax_AF double")
    writers.write_tsv(flat, str(tmp_path / "flat"))
    read = readers.read_tsv(spark, str(tmp_path / "flat"), schemas.PUBLIC_TSV)
    assert rows(public_rare(read)) == rows(public_rare(flat)) == [("1", 5, "A", "G", 0.0005)]


def _bed(codes: np.ndarray) -> bytes:
    n_variants, n_samples = codes.shape
    padded = np.zeros((n_variants, (n_samples + 3) // 4 * 4), dtype=np.uint8)
    padded[:, :n_samples] = codes
    quads = padded.reshape(n_variants, -1, 4)
    packed = quads[:, :, 0] | quads[:, :, 1] << 2 | quads[:, :, 2] << 4 | quads[:, :, 3] << 6
    return b"\x6c\x1b\x01" + packed.astype(np.uint8).tobytes()


@pytest.mark.parametrize("n_samples", [1, 3, 4, 9])
@pytest.mark.parametrize("split", [None, 7])
def test_read_plink(spark, tmp_path, n_samples, split):
    rng = np.random.default_rng(n_samples)
    codes = rng.integers(0, 4, size=(60, n_samples), dtype=np.uint8)
    (tmp_path / "p.bed").write_bytes(_bed(codes))
    (tmp_path / "p.bim").write_text("".join(f"{23 if v > 50 else 1}\tv{v}\t0\t{1000 + v}\tG\tA\n" for v in range(60)))
    (tmp_path / "p.fam").write_text("".join(f"0 s{s} 0 0 {1 + s % 2} -9\n" for s in range(n_samples)))
    got = {(r.contig, r.pos, r.ref, r.alt, r.variant_id, r.sample_id): r.alt_dosage for r in readers.read_plink(spark, str(tmp_path / "p"), split).collect()}
    dosage = {0: 2, 1: None, 2: 1}
    want = {
        ("chrX" if v > 50 else "chr1", 1000 + v, "A", "G", f"v{v}", f"s{s}"): dosage[int(codes[v, s])]
        for v in range(60)
        for s in range(n_samples)
        if codes[v, s] != 3
    }
    assert got == want


def test_line_numbers_over_file_splits(spark, tmp_path):
    path = tmp_path / "big.bim"
    path.write_text("".join(f"1\tv{i}\t0\t{i}\tG\tA\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        bim = readers.read_bim(spark, str(path))
        assert bim.rdd.getNumPartitions() > 3
        assert bim.filter("line != pos").count() == 0
        assert bim.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_write_vcf_has_a_header_in_every_file(spark, tmp_path):
    df = spark.range(1000).select(
        F.concat(F.lit("chr"), (F.col("id") % 12 + 1).cast("string")).alias("contig"),
        (F.col("id") * 7 % 1000).alias("pos"),
        F.lit("A").alias("ref"),
        F.lit("G").alias("alt"),
        F.when(F.col("id") % 3 > 0, "TTN").otherwise("DES").alias("gene"),  # one gene holds two thirds
        F.lit("exome").alias("source"),
    )
    path = str(tmp_path / "v")
    writers.write_vcf(df, path, rows_per_file=100)
    files = sorted((tmp_path / "v").glob("gene=*/source=*/part=*/*.gz"))
    assert len(files) > 8
    n = 0
    for f in files:
        lines = gzip.decompress(f.read_bytes()).decode().splitlines()
        assert lines[0] == "##fileformat=VCFv4.2" and lines[1].startswith("#CHROM\tPOS\t")
        assert not any(x.startswith("#") for x in lines[2:])
        order = [(int(x.split("\t")[0][3:]), int(x.split("\t")[1])) for x in lines[2:]]
        assert order == sorted(order)
        n += len(order)
    assert n == 1000
    back = readers.read_vcf(spark, path)
    assert back.count() == 1000 and back.filter("gene = 'DES'").count() == 334


def test_id_and_sample_lists(spark, tmp_path):
    ids = spark.createDataFrame(
        [("1", 5, "A", "G", "lof", "dcm", "exome")] * 2 + [("1", 6, "A", "G", "lof", "hcm", "wgs")],
        "contig string, pos bigint, ref string, alt string, impact string, disease string, source string",
    )
    writers.export_ids(ids, str(tmp_path / "ids"))
    (f,) = (tmp_path / "ids" / "impact=lof" / "disease=dcm" / "source=exome").glob("*.csv")
    assert f.read_text() == "ID\n1:5:A:G\n"
    writers.write_samples(spark.createDataFrame([(7, "eur")], "sample_id bigint, ancestry string"), str(tmp_path / "s"))
    (f,) = (tmp_path / "s" / "ancestry=eur").glob("*.csv")
    assert f.read_text() == "0\t7\n"


@pytest.mark.parametrize("folders", [64, 2])
def test_lists_of_genes_are_opened_as_folders_are_written(spark, tmp_path, rows, monkeypatch, folders):
    import pyarrow.parquet as pq

    monkeypatch.setattr(writers, "CALLS_PER_TASK", 300)
    monkeypatch.setattr(writers, "OPEN_FOLDERS", folders)
    genes = [["TTN"], ["TTN", "DES"], ["DES", None, "DSP"], [], None, ["DSP", "DSP"]]
    calls = [("acaf" if i % 3 else None, genes[i % 6], f"chr{i % 2}", i * 7919 % 50, i * 7919 % 50 + 100 * (i % 4), i % 97, 1 if i % 5 else None) for i in range(2000)]
    df = spark.createDataFrame(calls, "dataset string, gene array<string>, contig string, pos bigint, site_id bigint, sample_id bigint, alt_dosage int")
    names = ("spark.sql.files.openCostInBytes", "spark.sql.maxConcurrentOutputFileWriters", *session.SHUFFLES_GO)
    before = [spark.conf.get(n, None) for n in names]
    path = str(tmp_path / "listed")
    writers.write_genotypes(df.repartition(3), path)
    assert [spark.conf.get(n, None) for n in names] == before
    want = [(*c[2:], c[0], g) for c in calls for g in c[1] or []]
    back = spark.read.parquet(path)
    assert back.columns == ["contig", "pos", "site_id", "sample_id", "alt_dosage", "dataset", "gene"]
    assert rows(back) == sorted(want, key=repr)
    files = list((tmp_path / "listed").glob("dataset=*/gene=*/*.parquet"))
    assert len({f.parent for f in files}) == len({c[-2:] for c in want}) and len(files) > 2 * len({f.parent for f in files})
    for f in files if folders > 2 else []:
        part = [(r["contig"], r["pos"], r["site_id"]) for r in pq.ParquetFile(f).read(["contig", "pos", "site_id"]).to_pylist()]
        assert part == sorted(part) and len(part) <= 2 * 300


def test_region_reads_skip_row_groups(spark, tmp_path):
    sites = spark.range(10_000).select(
        F.lit("chr1").alias("contig"), F.col("id").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"),
        F.lit("TTN").alias("gene"), F.lit("x").alias("effect"),
    )
    writers.save_stage(sites, str(tmp_path), "sites", sort_by=["contig", "pos"])
    regions = spark.createDataFrame([("TTN", "chr1", 10, 20), ("DES", "chr1", 15, 40)], "gene string, contig string, start_pos bigint, end_pos bigint")
    df = readers.read_sites(spark, str(tmp_path / "sites"), regions=regions)
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    assert "GreaterThanOrEqual(pos,10)" in text.getvalue() and "LessThanOrEqual(pos,40)" in text.getvalue()
    assert df.count() == 31


def plink_set(folder, name, codes, start, contig="2"):
    folder.mkdir(parents=True, exist_ok=True)
    n, people = codes.shape
    (folder / f"{name}.bed").write_bytes(_bed(codes))
    (folder / f"{name}.bim").write_text("".join(f"{contig}\t{name}:{v}\t0\t{start + 10 * v}\tG\tA{'C' * (v % 7)}\n" for v in range(n)))
    (folder / f"{name}.fam").write_text("".join(f"0 {name}-{s} 0 0 1 -9\n" for s in range(people)))


@pytest.mark.parametrize("split, range_bytes", [(None, 256 << 10), (5, 64), (1, 17)])
def test_many_plink_sets(spark, tmp_path, split, range_bytes):
    rng = np.random.default_rng(range_bytes)
    sets = {}
    for i, (dataset, gene, people) in enumerate([("exome", "TTN", 3), ("exome", "DSP", 5), ("acaf", "TTN", 9)]):
        codes = rng.integers(0, 4, size=(40 + i, people), dtype=np.uint8)
        sets[dataset, gene] = codes, 1000 * (i + 1)
        plink_set(tmp_path / dataset, gene, codes, 1000 * (i + 1), contig="X" if gene == "DSP" else "2")
    calls = readers.read_plink(spark, str(tmp_path / "*" / "*"), split, with_path=True, range_bytes=range_bytes)
    df = readers.with_provenance(calls, {"dataset": r"([^/]+)/[^/]+$", "gene": r"([^/]+)$"})
    assert df.columns == ["contig", "pos", "ref", "alt", "variant_id", "sample_id", "alt_dosage", "dataset", "gene"]
    dosage = {0: 2, 1: None, 2: 1}
    want = {
        (d, g, f"{g}:{v}", f"{g}-{s}", start + 10 * v, dosage[c])
        for (d, g), (codes, start) in sets.items()
        for (v, s), c in np.ndenumerate(codes)
        if c != 3
    }
    got = [(r.dataset, r.gene, r.variant_id, r.sample_id, r.pos, r.alt_dosage) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    # Regions leave out what is outside them, whatever the style of contigs; calls are not joined with anything.
    regions = spark.createDataFrame([("2", 1100, 1200), ("chrX", 2000, 2000), ("2", 900_000, 900_020)], "contig string, start_pos bigint, end_pos bigint")
    part = readers.read_plink(spark, str(tmp_path / "*" / "*"), split, regions, range_bytes=range_bytes)
    inside = {x[2:] for x in want if (x[1] == "TTN" and 1100 <= x[4] <= 1200) or (x[1] == "DSP" and x[4] == 2000)}
    assert {(r.variant_id, r.sample_id, r.pos, r.alt_dosage) for r in part.collect()} == inside
    assert "Join" not in part._jdf.queryExecution().toString()
    assert readers.read_plink(spark, str(tmp_path / "*" / "*"), regions=regions.limit(0)).count() == 0


def test_plink_sets_that_do_not_fit_are_refused(spark, tmp_path):
    plink_set(tmp_path, "p", np.zeros((8, 5), np.uint8), 100)
    (tmp_path / "p.fam").write_text("".join(f"0 s{s} 0 0 1 -9\n" for s in range(9)))
    with pytest.raises(ValueError, match="does not fit"):
        readers.read_plink(spark, str(tmp_path / "p"))
    (tmp_path / "p.bim").unlink()
    with pytest.raises(ValueError, match="not all of"):
        readers.read_plink(spark, str(tmp_path / "*"))


def test_headers_are_merged_over_files(spark, tmp_path):
    from allelio.sources import headers

    (tmp_path / "a.vcf").write_text(VCF)
    other = '##fileformat=VCFv4.3\n##INFO=<ID=AC,Number=R,Type=Integer,Description="Counts">\n##contig=<ID=chrX>\n##note=x\n##note=x\n##note=y\n'
    (tmp_path / "b.vcf").write_text(other + VCF.split("\n", 2)[2])
    table = headers.read_header(spark, str(tmp_path / "*.vcf"))
    assert table.count() == 8
    lines = headers.header_lines(headers.merge_headers(table))
    assert lines == [
        "##fileformat=VCFv4.3",
        '##INFO=<ID=AC,Number=.,Type=String,Description="Description not provided">',  # the first file's line counts
        "##contig=<ID=chrX>",
        "##note=x",
        "##note=y",
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
    ]
    got = {(r.kind, r.id, r.n) for r in table.select("kind", "id", headers.header_value("keys", "Number").alias("n")).collect()}
    assert got == {("fileformat", None, None), ("INFO", "AC", "A"), ("INFO", "AC", "R"), ("contig", "chrX", None), ("note", None, None)}


def test_a_stage_is_reused_only_if_nothing_changed(spark, tmp_path):
    from allelio.sources import stages

    built = []

    def stage(n, params=None):
        df = spark.read.parquet(str(tmp_path / "in"))
        return stages.resumed_stage(str(tmp_path / "st"), "s", lambda: built.append(n) or df.selectExpr("id + 1 AS id"), [df], params)

    spark.range(5).write.parquet(str(tmp_path / "in"))
    assert stage(1).count() == 5 and stage(2).count() == 5 and built == [1]
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    assert stage(3).count() == 8 and stage(4).count() == 8 and built == [1, 3]
    assert stage(5, {"cutoff": 0.1}).count() == 8 and stage(6, {"cutoff": 0.1}).count() == 8 and stage(7, {"cutoff": 0.2}).count() == 8
    assert built == [1, 3, 5, 7]
    # A stage without manifest was not finished.
    import shutil

    shutil.rmtree(tmp_path / "st" / "_s.manifest")
    assert stage(8, {"cutoff": 0.2}).count() == 8 and built[-1] == 8
    memory = spark.createDataFrame([(1,)], "id int")
    for n in (9, 10):
        stages.resumed_stage(str(tmp_path / "st"), "m", lambda n=n: built.append(n) or memory, [memory])
    assert built[-2:] == [9, 10]
    stages.remove_stages(spark, str(tmp_path / "st"), ["s"])
    assert sorted(p.name for p in (tmp_path / "st").iterdir() if not p.name.endswith(".crc")) == ["m"]
    stages.remove_stages(spark, str(tmp_path / "st"))
    assert not (tmp_path / "st").exists()


def indexed_vcf(path, records, block, csi):
    """A block-gzip VCF file with its index, made record by record as the format says."""
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    lines = [head, *[f"{c}\t{p}\t.\t{r}\tG\t.\tPASS\tN={i}\n" for i, (c, p, r) in enumerate(records)]]
    data = "".join(lines).encode()
    raw = bgzf(data, block)
    path.write_bytes(raw)
    begins, at = [], 0  # file offset of each block
    while at < len(raw):
        begins.append(at)
        at += struct.unpack_from("<H", raw, at + 16)[0] + 1
    virtual = lambda off: begins[off // block] << 16 | off % block
    shift, depth = (12, 6) if csi else (14, 5)
    contigs, offset = {}, len(head)
    for (c, p, r), line in zip(records, lines[1:], strict=True):
        first, last = p - 1, p - 1 + len(r) - 1
        level = next(d for d in range(depth, -1, -1) if first >> shift + 3 * (depth - d) == last >> shift + 3 * (depth - d))
        number = ((1 << 3 * level) - 1) // 7 + (first >> shift + 3 * (depth - level))
        bins, windows = contigs.setdefault(c, ({}, {}))
        bins.setdefault(number, []).append((virtual(offset), virtual(offset + len(line))))
        for w in range(first >> 14, (last >> 14) + 1):
            windows.setdefault(w, virtual(offset))
        offset += len(line)
    names = b"".join(c.encode() + b"\0" for c in contigs)
    meta = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
    out = (b"CSI\1" + struct.pack("<3i", shift, depth, len(meta)) + meta + struct.pack("<i", len(contigs))) if csi else b"TBI\1" + struct.pack("<i", len(contigs)) + meta
    for bins, windows in contigs.values():
        out += struct.pack("<i", len(bins))
        for number, chunks in bins.items():
            out += struct.pack("<I", number) + (struct.pack("<Q", chunks[0][0]) if csi else b"") + struct.pack("<i", len(chunks))
            out += b"".join(struct.pack("<2Q", *c) for c in chunks)
        if not csi:
            full, last = [], 0
            for w in range(max(windows) + 1):
                last = windows.get(w, last)
                full.append(last)
            out += struct.pack("<i", len(full)) + struct.pack(f"<{len(full)}Q", *full)
    path.with_name(path.name + (".csi" if csi else ".tbi")).write_bytes(bgzf(out, 60_000))


@pytest.mark.parametrize("csi, ending", [(False, "vcf.gz"), (True, "vcf.bgz")])
def test_regions_of_an_indexed_vcf(spark, tmp_path, csi, ending):
    from allelio.sources import blocks

    rng = random.Random(7)
    records = [(c, p, "A" * rng.choice([1, 1, 1, 30, 40_000 if rng.random() < 0.01 else 2])) for c in ("chr1", "chr2", "chrX") for p in sorted(rng.sample(range(1, 3_000_000), 700))]
    path = tmp_path / f"a.{ending}"
    indexed_vcf(path, records, 4000, csi)
    spans = [("1", 500_000, 520_000), ("chr2", 2_990_000, 600_000_000), ("chr2", 1, 9_000), ("X", 1_000_000, 1_000_001), ("chr7", 1, 10**6)]
    regions = spark.createDataFrame(spans, "contig string, start_pos bigint, end_pos bigint")
    want = sorted((c, p, f"N={i}") for i, (c, p, _) in enumerate(records) if any(c[3:] == d.removeprefix("chr") and s <= p <= e for d, s, e in spans))
    assert want
    got = readers.read_vcf(spark, str(path), regions)
    assert sorted((r.contig, r.pos, r.info) for r in got.collect()) == want
    # Few of the file's blocks are opened.
    for split in (1 << 26, 1):
        reader = blocks.BgzfReader({"path": str(path), "regions": __import__("json").dumps(spans), "splitbytes": split})
        parts = reader.partitions()
        lines = [line for p in parts for b in reader.read(p) for line in b.column("value").to_pylist()]
        assert len(lines) == len(set(lines)) and {x.split("\t")[7] for x in lines} >= {n for _, _, n in want}
        opened = sum((p.end >> 16) - (p.start >> 16) for p in parts)
        assert opened < path.stat().st_size / 2 and len(lines) < len(records) / 2
    # A file without an index is read as a whole, an empty list opens nothing.
    assert readers.read_vcf(spark, str(path), regions.limit(0)).count() == 0
    path.with_name(path.name + (".csi" if csi else ".tbi")).unlink()
    assert sorted((r.contig, r.pos, r.info) for r in readers.read_vcf(spark, str(path), regions).collect()) == want
