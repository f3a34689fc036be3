"""Left alignment of indels against a reference genome.

The genome is a table ``(contig, chunk_no, seq)`` of equally long chunks, ``chunk_no`` from 0. An indel only ever
needs the bases to its left, so each one meets exactly one row: its chunk with the chunk before it in front. Only chunks
that an indel needs leave the genome table. A run that goes on beyond is followed through twice as many chunks each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelio.operators.joins import lookup_join, measured_bytes, stack, staged

# Most moves are short: the bases next to an indel are searched first.
NEAR = 63


def common_prefix(a: str, b: str, n: str) -> str:
    """SQL text: number of equal leading characters of two texts, looking at the first ``n``."""
    same = f"zip_with(split(left({a}, {n}), ''), split(left({b}, {n}), ''), (x, y) -> x = y)"
    # Most texts differ at once or not at all; only the others are taken apart.
    plain = f"WHEN left({a}, 1) <> left({b}, 1) THEN 0 WHEN left({a}, {n}) = left({b}, {n}) THEN {n}"
    return f"(CASE WHEN {n} <= 0 THEN 0 {plain} ELSE coalesce(nullif(CAST(array_position({same}, false) AS INT), 0) - 1, {n}) END)"


def genome_windows(genome: DataFrame, places: DataFrame, back: int) -> DataFrame:
    """``contig, chunk_no, window, first``: for each of ``places`` its chunk with up to ``back`` chunks in front, and the first one's number.

    The genome is filtered by the chunks that are needed; nothing else of it is moved.
    """
    needed = places.select("contig", "chunk_no", F.explode(F.sequence(F.greatest(F.col("chunk_no") - back, F.lit(0).cast("bigint")), F.col("chunk_no"))).alias("at"))
    chunks = lookup_join(genome.select("contig", F.col("chunk_no").alias("at"), "seq"), needed, ["contig", "at"], stage=True)
    found = chunks.groupBy("contig", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("at", "seq"))).alias("parts"))
    # Only what joins on without a gap to the place's own chunk.
    whole = found.selectExpr("contig", "chunk_no", "filter(parts, (x, i) -> chunk_no - x.at = size(parts) - 1 - i) AS parts").filter("size(parts) > 0")
    return whole.selectExpr("contig", "chunk_no", "upper(array_join(transform(parts, x -> x.seq), '')) AS window", "parts[0].at AS first")


def trim_alleles(df: DataFrame) -> DataFrame:
    """Drop what both alleles share at the end, then at the start, keeping one base in each.

    If one allele is wholly the end of the other, nothing is trimmed and ``indel`` holds the bases in which they
    differ; only such rows can move.
    """
    cols = [c for c in df.columns if c not in ("pos", "ref", "alt")]
    plain = "ref RLIKE '^[ACGTNacgtn]+$' AND alt RLIKE '^[ACGTNacgtn]+$' AND ref <> alt"
    shorter = "least(length(ref), length(alt))"
    shared_end = common_prefix("reverse(ref)", "reverse(alt)", shorter)
    shared_start = common_prefix("_ref", "_alt", "(least(length(_ref), length(_alt)) - 1)")
    return (
        df.selectExpr("*", f"CASE WHEN length(ref) + length(alt) > 2 AND {plain} THEN {shared_end} END AS _end")
        .selectExpr(
            "*",
            f"CASE WHEN _end = {shorter} AND length(ref) <> length(alt) THEN"
            f" left(CASE WHEN length(ref) > length(alt) THEN ref ELSE alt END, abs(length(ref) - length(alt))) END AS indel",
        )
        .selectExpr(
            "*",
            "CASE WHEN indel IS NULL AND _end > 0 THEN left(ref, length(ref) - _end) ELSE ref END AS _ref",
            "CASE WHEN indel IS NULL AND _end > 0 THEN left(alt, length(alt) - _end) ELSE alt END AS _alt",
        )
        .selectExpr("*", f"CASE WHEN indel IS NULL AND _end IS NOT NULL THEN {shared_start} ELSE 0 END AS _start")
        .selectExpr(
            *cols, "pos + _start AS pos", "substring(_ref, 1 + _start) AS ref", "substring(_alt, 1 + _start) AS alt", "indel"
        )
    )


def _equal_ends(front: str, n: str, most: int) -> str:
    """SQL text: the largest k up to ``n`` (at most ``most``) for which ``front`` and ``front || indel`` have the same last k bases.

    If k bases agree, so do fewer: bit by bit from the highest, each with one comparison of whole texts.
    """
    bits = ", ".join(str(1 << b) for b in reversed(range(most.bit_length())))
    both = f"concat({front}, indel)"
    # Without the last base in common there is nothing to look for.
    return f"CASE WHEN {n} < 1 OR right({front}, 1) <> right(indel, 1) THEN 0 ELSE aggregate(array({bits}), 0, (k, b) -> CASE WHEN k + b <= {n} AND right({front}, k + b) = right({both}, k + b) THEN k + b ELSE k END) END"


def _shift(df: DataFrame, chunk: int, back: int) -> DataFrame:
    """Move each indel (``pos`` = its first base) left inside its window; ``at_edge`` if the window was too short.

    Moving left by one is possible while the base in front equals the indel's last base, so the stretch that is moved over repeats
    the indel: with the bases in front as one text, the longest move is the longest common end of that text with
    and without the indel behind it.
    """
    start = f"first * {chunk} + 1"
    df = df.selectExpr("* EXCEPT (window, first)", f"{start} AS window_start", f"CASE WHEN length(window) >= pos - ({start}) THEN left(window, CAST(pos - ({start}) AS INT)) END AS _front")
    df = df.selectExpr("*", "length(_front) AS _n", f"right(_front, {NEAR}) AS _near")
    df = df.selectExpr("* EXCEPT (_near)", f"{_equal_ends('_near', 'length(_near)', NEAR)} AS _k")
    df = df.selectExpr("* EXCEPT (_k)", f"CASE WHEN _k < {NEAR} OR _n = {NEAR} THEN _k ELSE {_equal_ends('_front', '_n', (back + 1) * chunk)} END AS _k")
    # One base in front of the indel is its anchor; at the start of a contig the indel stops one base short. A window
    # of one base has nothing in front of it in the genome table: the run ends there.
    df = df.selectExpr("* EXCEPT (_k)", "least(_k, _n - 1) AS _k")
    return df.selectExpr(
        "* EXCEPT (_front, _n, _k, window_start)",
        "pos - _k AS _pos",
        "left(concat(right(_front, _k), indel), length(indel)) AS _indel",
        "substring(_front, _n - _k, 1) AS _anchor",
        "_k = _n - 1 AND _n > 1 AND window_start > 1 AS at_edge",
    )


def normalise(df: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """Trim and left-align biallelic variants (``contig, pos, ref, alt``); other columns are carried along.

    ``df`` is read twice, once for the rows that stay and once for those that may move: stage a costly one first.

    Rows that cannot move (SNVs, trimmed replacements, symbolic alleles) never meet the genome, and chunks that no indel needs
    are never moved. An indel that reaches the left edge of its window goes on from there with twice as many chunks, so a run
    of any length is followed to its end in as many turns as its length has bits.
    """
    cols = df.columns
    trimmed = trim_alleles(df)
    can_move = "indel IS NOT NULL AND pos > 1"
    done = [trimmed.filter(f"NOT ({can_move})").select(*cols)]
    todo = trimmed.filter(can_move).selectExpr("*", "length(ref) > length(alt) AS deletion")
    place = ["contig", "chunk_no"]
    others = [c for c in cols if c not in ("pos", "ref", "alt")]
    back = 1
    while True:
        # pos - 1 is the last base needed; an indel at the first base of a chunk takes the window before it.
        placed, _ = staged(todo.selectExpr("*", f"(pos - 2) div {chunk} AS chunk_no"), "placed")
        windows = genome_windows(genome, placed.select(*place).distinct(), back)
        moved, _ = staged(_shift(lookup_join(placed, windows, place, "left", stage=True), chunk, back), "moved")
        # Without a window the genome table does not hold the place, and the row stays as it was.
        done.append(
            moved.filter("NOT coalesce(at_edge, false)").selectExpr(
                *others,
                "CASE WHEN _anchor IS NULL THEN pos ELSE _pos - 1 END AS pos",
                "CASE WHEN _anchor IS NULL THEN ref WHEN deletion THEN concat(_anchor, _indel) ELSE _anchor END AS ref",
                "CASE WHEN _anchor IS NULL THEN alt WHEN deletion THEN _anchor ELSE concat(_anchor, _indel) END AS alt",
            ).select(*cols)
        )
        edge = moved.filter("at_edge")
        if measured_bytes(edge) == 0:
            return stack(done)
        todo = edge.selectExpr("* EXCEPT (pos, indel, _pos, _indel, _anchor, at_edge, chunk_no)", "_pos AS pos", "_indel AS indel")
        back *= 2
