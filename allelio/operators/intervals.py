"""Point-in-interval joins.

Every interval is spread over fixed-width bins of its contig and every point lies in exactly one bin, so the
range condition becomes an equi-join on (contig, bin) with a residual check and yields no duplicates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelio.config import EXON_PAD, GENE_REGIONS
from allelio.functions.keys import _col, norm_contig, parse_interval
from allelio.operators.joins import BROADCAST_BYTES, SALTS, lookup_join, staged

BIN_SIZE = 100_000
MIN_BIN = 256
# Pairs of a point and a region in its bin that one task compares, and pairs per point from which points are dealt out by them.
PAIRS_PER_TASK = 4_000_000
PAIRS_PER_POINT = 8
PRUNE_SPAN = 100_000
# Stretches that a list is summed up to before it reaches the driver; beyond it, one stretch per contig.
PRUNE_STRETCHES = 32_768
# Literal ranges are checked for every row that is read; more of them make the generated method too long to compile.
MAX_RANGES = 24
# Contigs that a plain scan is read one by one for, each with ranges of its own.
MAX_CONTIGS = 64
# Partition columns of tables written by position, and the bases a place of theirs is wide. A place names its contig without
# prefix and the stretch in one text, because Spark prunes partitions by each column apart.
PLACES = {"place_100kb": 100_000, "place_mb": 1_000_000}


def region_panel(spark, panel: list[tuple[str, str]] | None = None) -> DataFrame:
    """Region table of a gene panel given as (gene, 'contig:start-end') pairs."""
    df = spark.createDataFrame(panel or GENE_REGIONS, "gene string, region string")
    return df.select("gene", parse_interval("region").alias("i")).select("gene", "i.*")


def _bin(c: Column, size: int) -> Column:
    return F.floor(c / F.lit(size))


def _bin_size(regions: DataFrame, length: Column) -> int:
    """The mean length of the regions, within bounds: so many bins hold few regions that end short of a point, and a list becomes at most three times as long."""
    mean = regions.agg(F.avg(length.cast("double")).alias("mean")).first()["mean"]
    return int(min(BIN_SIZE, max(MIN_BIN, mean or 0)))


def _dealt(points: DataFrame, binned: DataFrame) -> DataFrame:
    """Points in as many partitions as their pairs with regions need: a few small files would leave all of them to a few tasks."""
    per_bin = [t.groupBy("contig", "_bin").agg(F.count(F.lit(1)).alias(n)) for t, n in ((points, "_n"), (binned, "_m"))]
    both = per_bin[0].join(per_bin[1], ["contig", "_bin"], "left")
    found = both.agg(F.sum("_n").alias("points"), F.sum(F.col("_n").cast("double") * F.col("_m")).alias("pairs")).first()
    pairs = found["pairs"] or 0
    if pairs <= max(PAIRS_PER_TASK, PAIRS_PER_POINT * (found["points"] or 0)):
        return points
    return points.repartition(int(pairs // PAIRS_PER_TASK) + 1)


def interval_join(
    df: DataFrame,
    regions: DataFrame,
    closed: bool = False,
    how: str = "inner",
    bin_size: int | None = None,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join rows with ``contig, pos`` to all regions (``contig, start_pos, end_pos, ...``) that hold them.

    A row in several overlapping regions appears once per region. Intervals are half-open unless ``closed``. Bins are as wide as
    the mean region unless ``bin_size`` is given. An inner join with many regions per point deals the points out by the pairs to compare.
    """
    last = F.col("end_pos") if closed else F.col("end_pos") - 1
    regions = regions.filter(F.col("start_pos") <= last)
    if bin_size is None:
        bin_size = _bin_size(regions, last - F.col("start_pos") + 1)
    binned = (
        regions
        .withColumn("_bin", F.explode(F.sequence(_bin(F.col("start_pos"), bin_size), _bin(last, bin_size))))
    )
    upper = F.col("l.pos") <= F.col("r.end_pos") if closed else F.col("l.pos") < F.col("r.end_pos")
    points = df.withColumn("_bin", _bin(F.col("pos"), bin_size))
    if how == "inner":
        points = _dealt(points, binned)
    joined = lookup_join(
        points, binned, ["contig", "_bin"], how, (F.col("l.pos") >= F.col("r.start_pos")) & upper, max_bytes, salts
    )
    return joined.drop("_bin")


def filter_intervals(df: DataFrame, regions: DataFrame, closed: bool = False, prune: bool = False, **kw) -> DataFrame:
    """Rows inside at least one region. ``prune`` also hands a short region list down to the file scan."""
    spans = regions.select("contig", "start_pos", "end_pos").distinct()
    if prune:
        df = prune_to_regions(df, spans)
    return interval_join(df, spans, closed, "left_semi", **kw)


def merge_spans(rows: list[tuple[str, int, int]], at_most: int | None = None) -> list[tuple[str, int, int]]:
    """Overlapping spans made one; then, if asked, the smallest gaps inside contigs closed until few are left."""
    spans: list[list] = []
    for contig, start, end in sorted(rows):
        if spans and spans[-1][0] == contig and start <= spans[-1][2]:
            spans[-1][2] = max(spans[-1][2], end)
        else:
            spans.append([contig, start, end])
    if at_most is not None and len(spans) > at_most:
        gaps = sorted((b[1] - a[2], i) for i, (a, b) in enumerate(zip(spans, spans[1:])) if a[0] == b[0])
        closed = {i for _, i in gaps[: len(spans) - at_most]}
        merged = [spans[0]]
        for i, span in enumerate(spans[1:]):
            if i in closed:
                merged[-1][2] = span[2]
            else:
                merged.append(span)
        spans = merged
    return [tuple(x) for x in spans]


def stretches(regions: DataFrame, span: int = PRUNE_SPAN, most: int = PRUNE_STRETCHES) -> list[tuple[str, int, int]]:
    """What a region list covers, as one row per contig and ``span`` of starts: as many as the genome is long, not the list."""
    ends = [F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")]
    known = regions.filter("contig IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL")
    near = known.groupBy("contig", _bin(F.col("start_pos"), span).alias("_at")).agg(*ends)
    rows = near.select("contig", "start_pos", "end_pos").limit(most + 1).collect()
    if len(rows) > most:
        rows = known.groupBy("contig").agg(*ends).limit(most + 1).collect()
    return merge_spans([tuple(r) for r in rows]) if len(rows) <= most else []


def place_of(df: DataFrame) -> str | None:
    """The column that names a row's place, if the table was written by position."""
    return next((c for c in PLACES if c in df.columns), None)


def place_name(contig: Column | str, at: Column, column: str) -> Column:
    """``1.230`` for ``chr1`` and the 231st place."""
    return F.concat_ws(".", norm_contig(contig), at.cast("string")).alias(column)


def places(regions: DataFrame, column: str) -> DataFrame:
    """Distinct places (``column``) that a region list touches: as many as the genome has, not the list."""
    at = lambda c: F.floor(F.col(c) / PLACES[column]).cast("int")
    known = regions.filter("contig IS NOT NULL AND start_pos <= end_pos")
    each = known.select("contig", F.explode(F.sequence(at("start_pos"), at("end_pos"))).alias("at"))
    return each.select(place_name("contig", F.col("at"), column)).distinct()


def _by_place(df: DataFrame, regions: DataFrame, column: str) -> DataFrame | None:
    # Written first, so that Spark sees a filtered table, from which it prunes the scan's partitions when the query runs.
    wanted, size = staged(places(regions, column), "places")
    if size > BROADCAST_BYTES:
        return None
    return df.join(F.broadcast(wanted.filter(F.col(column) > "")), column, "left_semi").select(*df.columns)


def prune_to_regions(
    df: DataFrame, regions: DataFrame, either_style: bool = False, span: int = PRUNE_SPAN, most: int = PRUNE_STRETCHES, scan: bool = False
) -> DataFrame:
    """Narrow a scan to where a region list lies; exact filtering is left to ``filter_intervals``.

    A table written by position (``write_by_position``) meets the distinct places of the list, of any length: a broadcast of
    checked size, by which Spark picks the partitions to open at run time. No row of another place is read.
    Any other table gets literal ranges, by which Parquet skips row groups if it is sorted. A list of any length is
    first summed up to stretches of ``span`` bases, and to whole contigs' ranges if there are more than ``most`` of them;
    only a list of more than ``most`` contigs narrows nothing. One filter takes few ranges; ``scan`` tells that ``df`` is a plain
    table of files, which is then read contig by contig with as many ranges for each. Use it on columns as stored, before they are rewritten; with
    ``either_style`` contigs are found with and without ``chr``, whatever the list says.
    """
    column = place_of(df)
    if column is not None:
        narrowed = _by_place(df, regions, column)
        if narrowed is not None:
            return narrowed
    if either_style:
        regions = regions.withColumn("contig", norm_contig("contig"))
    spans = stretches(regions, span, most)
    if not spans:
        return df

    def on(contig: str) -> Column:
        return F.col("contig").isin(contig, f"chr{contig}") if either_style else F.col("contig") == contig

    def inside(some: list[tuple[str, int, int]]) -> Column:
        return reduce(lambda a, b: a | b, [on(c) & (F.col("pos") >= s) & (F.col("pos") <= e) for c, s, e in some])

    contigs = list(dict.fromkeys(c for c, _, _ in spans))
    if len(spans) <= MAX_RANGES:
        return df.filter(inside(spans))
    if scan and len(contigs) <= MAX_CONTIGS:
        per_contig = [merge_spans([x for x in spans if x[0] == c], MAX_RANGES) for c in contigs]
        return reduce(lambda a, b: a.unionByName(b), [df.filter(inside(some)) for some in per_contig])
    if len(contigs) > MAX_RANGES:
        names = [n for c in contigs for n in ((c, f"chr{c}") if either_style else (c,))]
        return df.filter(F.col("contig").isin(names) & F.col("pos").between(min(s for _, s, _ in spans), max(e for _, _, e in spans)))
    return df.filter(inside(merge_spans(spans, MAX_RANGES)))


def prune_to_variants(df: DataFrame, ids: DataFrame, either_style: bool = False) -> DataFrame:
    """The same for a variant list: the stretches of the genome its variants lie in."""
    return prune_to_regions(df, ids.select("contig", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos")), either_style)


def pad_intervals(regions: DataFrame, pad: int = EXON_PAD) -> DataFrame:
    """Regions widened by ``pad`` bases at both ends."""
    return regions.withColumns({"start_pos": F.col("start_pos") - pad, "end_pos": F.col("end_pos") + pad})


def near_intervals(df: DataFrame, regions: DataFrame, pad: int = EXON_PAD, **kw) -> DataFrame:
    """Rows within ``pad`` bases of a closed region; each row once."""
    return filter_intervals(df, pad_intervals(regions, pad), closed=True, **kw)


def merged_regions(regions: DataFrame, by: list[str]) -> DataFrame:
    """Closed regions (``*by, contig, start_pos, end_pos``) with those of one group and contig that overlap made one."""
    rows = Window.partitionBy(*by, "contig").orderBy("start_pos", "end_pos")
    known = regions.filter("start_pos <= end_pos").distinct()
    before = F.max("end_pos").over(rows.rowsBetween(Window.unboundedPreceding, -1))
    opened = known.withColumn("_new", F.coalesce(F.col("start_pos") > before, F.lit(True)).cast("bigint"))
    numbered = opened.withColumn("_at", F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*by, "contig", "_at").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    return merged.drop("_at")


def subset_genotypes(
    genotypes: DataFrame, sites: DataFrame, regions: DataFrame, key: list[str], listed: bool = False, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Calls whose site lies in a closed region, once per gene: ranges meet the sites, calls meet the key.

    Overlapping regions of a gene are one, so a site meets each gene once however many regions there are, and a site's genes travel
    in one row. ``listed`` leaves them so: each call stays one row and ``gene`` is the list of its genes, to be opened where the rows
    are used. The columns ``carried`` of the sites come along; a site that is there twice then doubles its calls.
    """
    spans = merged_regions(regions.select("gene", "contig", "start_pos", "end_pos"), ["gene"])
    genes = interval_join(sites.select(*dict.fromkeys([*key, "contig", "pos"])), spans, closed=True)
    # In a struct, so that a gene without name stays.
    lists = genes.groupBy(*key).agg(F.collect_set(F.struct("gene")).alias("_genes"))
    if listed:
        # Sorted, so that sites of the same genes have the same list.
        lists = lists.withColumn("_genes", F.array_sort(F.transform("_genes", lambda g: g["gene"])))
    if carried:
        lists = sites.select(*key, *carried).join(lists.hint("merge"), key)
    calls = genotypes.drop("gene") if "gene" in genotypes.columns else genotypes
    joined = lookup_join(calls, lists, key, stage=True)
    genes = F.col("_genes").alias("gene") if listed else F.inline("_genes")
    return joined.select(*[c for c in joined.columns if c != "_genes"], genes)


def in_region(contig: Column | str, pos: Column | str, region: tuple[str, int, int]) -> Column:
    """Closed test of one literal region, pushed down as it stands."""
    name, start, end = region
    return (_col(contig) == name) & _col(pos).between(start, end)
