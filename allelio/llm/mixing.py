"""Mixing sources to target weights with a low-discrepancy schedule.

Slots are numbered; slot ``t`` gets the point ``frac(t * golden ratio)``, and the cumulative targets cut [0, 1) into one interval
per source, so a source's slots are spread as evenly as a sequence can and their number stays within a few slots of its
target after any number of slots. A source's documents, in an order shuffled by a hash of their content, form one stream of
words that is cut into blocks of equal size; the source's k-th slot takes its k-th block, from the start again after the
last. The last block of a source is cut at the target. Blocks that a source still lacks when the slots end, as one below a block
beside millions of words does, are dealt in closing slots.

Ranks of slots within a source and places of documents within its stream are running sums in two steps, over chunks and
within a chunk, so no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelio.llm.common import stage
from allelio.operators.joins import lookup_join

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Words per block, slots per chunk of the schedule, cells of the unit interval, parts of a stream that are summed apart.
BLOCK, CHUNK, CELLS, PARTS = 256, 1 << 16, 1 << 12, 4096
GOLDEN = 0.6180339887498949


def size_of(text: str = "text") -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, no, source_size, target`` from one row per source (``source, source_size``).

    Sources in code point order (null last) are numbered from 0, have the weights in turn and share ``share`` times all words;
    none gets over ``most`` times its own, and what it cannot take is shared by the others by weight. Sorted by how soon they are
    full, the full sources come first: a source is full if, with all before it full, its part of the rest is at least what it
    can take. The table has one row per source; its windows are over sources, not documents.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("no", F.row_number().over(ordered) - 1)
    weighed = weighed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("no") % len(weights) + 1))
    weighed = weighed.withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    before, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = weighed.select(
        "*",
        (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    full = F.col("weight") * F.col("left") / F.col("open") >= F.col("cap")
    # The level of the first source that is not full holds for all after it.
    level = F.first(F.when(~full, F.col("left") / F.col("open")), ignorenulls=True).over(every)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap")))
    return rest.withColumn("level", level).select("source", "no", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, no, rank``: which source each slot takes and how many slots that source had before.

    ``goals`` is the written result of ``targets``. There are a few slots more than the targets need; ranks beyond a target are left
    out, and ranks below it that got no slot follow in closing slots, source by source, so each source gets its last block.
    """
    spark = goals.sparkSession
    ordered = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = goals.filter("target > 0").select(
        "no", "target", "source_size", (F.sum("target").over(ordered) / total).alias("high"), (F.col("target") / total).alias("part")
    )
    cut = stage(cut, "cuts")
    words, least = cut.agg(F.sum("target"), F.min("part")).first()
    # A source whose last block is short needs one slot more per turn; the sequence is off by a few slots at most.
    needed = int((words or 0) // block) + 1
    slots = needed + min(needed, int(8 / least)) + 16 if words else 0
    by_high = Window.orderBy("high")
    last = F.lead("high").over(by_high).isNull()
    cells = cut.select("no", "target", "source_size", F.coalesce(F.lag("high").over(by_high), F.lit(0.0)).alias("low"), F.when(last, F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    top = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), top), top)))
    point = (F.col("id") * GOLDEN) % 1.0
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.floor(point * CELLS).alias("cell"))
    placed = lookup_join(points, cells, "cell", where=(F.col("l.point") >= F.col("r.low")) & (F.col("l.point") < F.col("r.high")), stage=True)
    chunked = placed.select("slot", "no", "target", "source_size", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    in_chunk = stage(chunked.groupBy("no", "chunk").agg(F.count(F.lit(1)).alias("n")), "chunks")
    earlier = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_chunk.select("no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = chunked.withColumn("within", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1)
    ranked = lookup_join(numbered, offsets, ["no", "chunk"], stage=True).withColumn("rank", (F.col("offset") + F.col("within")).cast("long"))
    blocks = F.ceil(F.col("source_size") / block)
    words_before = F.floor(F.col("rank") / blocks) * F.col("source_size") + (F.col("rank") % blocks) * block
    dealt = ranked.filter(words_before < F.col("target")).select("slot", "no", "rank")
    # Ranks up to the target's last block, and how many of them had a slot; one row per source.
    turns = F.floor(F.col("target") / F.col("source_size"))
    ranks = turns * blocks + F.ceil((F.col("target") - turns * F.col("source_size")) / block)
    drawn = in_chunk.groupBy("no").agg(F.sum("n").alias("drawn"))
    lacking = cut.select("no", ranks.cast("long").alias("ranks")).join(drawn, "no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    lacking = lacking.filter("drawn < ranks").withColumn("n", F.col("ranks") - F.col("drawn"))
    lacking = lacking.withColumn("slot", F.sum("n").over(ordered) - F.col("n") + slots)
    closing = lacking.select("slot", "no", "drawn", F.explode(F.sequence("drawn", F.col("ranks") - 1)).alias("rank"))
    return dealt.unionByName(closing.select((F.col("slot") + F.col("rank") - F.col("drawn")).alias("slot"), "no", "rank"))


def streams(items: DataFrame) -> DataFrame:
    """``items`` (``no, size, h1, h2`` and more) with ``start``, the place in the source's stream in the order of the hashes."""
    placed = stage(items.withColumn("part", F.pmod(F.col("h1"), F.lit(PARTS))), "places")
    sums = placed.groupBy("no", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("no", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy("no", "part").orderBy("h2", "h1").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("inner", F.coalesce(F.sum("size").over(before), F.lit(0)))
    joined = lookup_join(inner, offsets, ["no", "part"], stage=True)
    return joined.withColumn("start", (F.col("offset") + F.col("inner")).cast("long")).drop("offset", "inner", "part")


def _items(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written rows without texts, with source number and hashes of the row, and the written targets."""
    flat = [F.col(f"`{c}`") for c in docs.columns]
    # The order of a stream and the way back to a row: two hashes over all columns.
    rows = docs.select("doc_id", "source", size_of().alias("size"), F.xxhash64(F.lit(17), *flat).alias("h1"), F.xxhash64(F.lit(29), *flat).alias("h2"))
    rows = stage(rows, "sizes")
    goals = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    named = goals.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), "no")
    keyed = rows.withColumn("_none", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    return lookup_join(keyed, named, ["_none", "_name"]).drop("_none", "_name", "source"), goals


def taken_parts(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in their streams, what the mix takes of them (``no, start, epoch, first, words``), and the targets.

    Joins the slots with the blocks by (source, block). A part is a run of a document's words that one pass over its source takes.
    """
    items, goals = _items(docs)
    placed = stage(streams(items), "streams")
    slots = schedule(goals, block)
    sizes = goals.select("no", "source_size", "target")
    turns = lookup_join(slots, sizes, "no").withColumn("blocks", F.ceil(F.col("source_size") / block))
    turns = turns.select(
        "no", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), "source_size", "target"
    )
    # Where a pass ends: at the end of the stream, or where the target is reached.
    turns = turns.withColumn("stop", F.least(F.col("source_size").cast("double"), F.col("target") - F.col("epoch") * F.col("source_size")))
    turns = turns.select("no", "block", "epoch", F.least((F.col("block") + 1) * block, F.round("stop").cast("long")).alias("stop"))
    own = placed.filter("size > 0").select("no", "start", "size")
    spread = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = own.withColumn("block", F.explode(spread))
    met = pieces.join(turns, ["no", "block"])
    first = F.greatest("start", F.col("block") * block)
    found = met.select("no", "start", "epoch", (first - F.col("start")).alias("first"), (F.least(F.col("start") + F.col("size"), F.col("stop")) - first).alias("words"))
    parts = found.filter("words > 0").groupBy("no", "start", "epoch").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    return placed, parts, goals


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``taken`` counts the words that the mix takes of the document, repeats included; no document gives more than twice its size.
    Null texts have size 0 and give nothing; a null source is a source of its own; repeated rows have places of their own in the
    stream. Other columns only enter the hash that orders a stream. An empty table gives an empty result.
    """
    placed, parts, goals = taken_parts(docs)
    taken = parts.groupBy("no", "start").agg(F.sum("words").alias("taken"))
    # Rows without words share their place with the row after them, and take nothing.
    joined = placed.join(taken, ["no", "start"], "left").withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return lookup_join(joined, goals.select("no", "source_size", "target"), "no").select("doc_id", "size", "source_size", "target", "taken")


def apply(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row per pass over a document, its text the words taken.

    A text taken as a whole is unchanged; of one where a source's target ends, the words up to there are kept, joined by
    single spaces, and ``n_chars`` counts what is left. Rows that repeat wholly are rows of their own in the mix.
    """
    placed, parts, _ = taken_parts(docs)
    items = stage(placed.join(parts, ["no", "start"]).filter("size > 0").select("h1", "h2", "size", "first", "words"), "parts")
    flat = [F.col(f"`{c}`") for c in docs.columns]
    # A row is one column from here on, so its columns may have any names.
    hashed = docs.select(F.struct(*flat).alias("row"), F.xxhash64(F.lit(17), *flat).alias("h1"), F.xxhash64(F.lit(29), *flat).alias("h2"))
    keys = ["h1", "h2"]
    repeated = stage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys), "repeated")
    if not repeated.isEmpty():
        # Each of the equal rows has parts of its own; one of them brings the text.
        some = lookup_join(hashed, repeated, keys, "left_semi")
        one = some.groupBy(*keys).agg(F.min("row").alias("row")).select("row", *keys)
        hashed = lookup_join(hashed, repeated, keys, "left_anti").unionByName(one)
    spans = items.select(*keys, F.struct("size", "first", "words").alias("part"))
    joined = lookup_join(hashed, spans, keys)
    whole, text = F.col("part.words") == F.col("part.size"), F.col("row.text")
    cut = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " "), (F.col("part.first") + 1).cast("int"), F.col("part.words").cast("int")), " ")
    joined = joined.withColumn("cut", F.when(whole, text).otherwise(cut))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    own["text"] = F.col("cut")
    if "n_chars" in own:
        own["n_chars"] = F.when(whole, own["n_chars"]).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[value.alias(c) for c, value in own.items()])
