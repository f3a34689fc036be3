"""Column functions for INFO text, ANN entries, GENEINFO, scores and dosages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelio.config import ANN_FIELDS
from allelio.functions.keys import _col


def info_field(info: Column | str, key: str) -> Column:
    """Value of one INFO key; a flag without value and a missing key are both NULL. The first of repeated keys counts."""
    return F.nullif(F.regexp_extract(_col(info), f"(?:^|;){re.escape(key)}=([^;]*)", 1), F.lit(""))


def info_number_per_allele(info_value: Column | str, index: Column) -> Column:
    """Element of a comma-separated per-allele value (``Number=A``), 0-based; NULL out of range."""
    return F.get(F.split(_col(info_value), ","), index)


def ann_field(entry: Column | str, name: str) -> Column:
    """Named field of one pipe-separated ANN entry; an empty field is NULL."""
    return F.nullif(F.get(F.split(_col(entry), r"\|"), F.lit(ANN_FIELDS[name])), F.lit(""))


def split_cols(c: Column | str, delimiter: str, names: list[str]) -> list[Column]:
    """Delimited text to a fixed number of named columns; missing places are NULL."""
    parts = F.split(_col(c), F.lit(delimiter))
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)]


def geneinfo_symbols(c: Column | str) -> Column:
    """All gene symbols of ``BAG3:9531|RAB:1`` as an array."""
    return F.transform(F.split(_col(c), r"\|"), lambda x: F.get(F.split(x, ":"), F.lit(0)))


def geneinfo_symbol(c: Column | str) -> Column:
    """First gene symbol of a GENEINFO text."""
    return F.get(F.split(_col(c), ":"), F.lit(0))


def score(c: Column | str) -> Column:
    """Scalar score; ``.`` and other text are NULL."""
    return _col(c).try_cast("double")


def score_array(c: Column | str) -> Column:
    """``[0.7,null,0.3]`` to array<double>; tokens that are no number become NULL."""
    bare = F.regexp_replace(_col(c), r"[\[\]]", "")
    return F.transform(F.split(bare, ","), lambda x: F.trim(x).try_cast("double"))


def any_score_ge(c: Column | str, cutoff: float) -> Column:
    """True if a value of a score list, of any length, reaches the cutoff, else false (never NULL)."""
    return F.coalesce(F.exists(score_array(c), lambda x: x >= F.lit(cutoff)), F.lit(False))


def flip_dosage(c: Column | str) -> Column:
    """Count of the other allele: 2, 1, 0 become 0, 1, 2; anything else is NULL."""
    d = _col(c)
    return F.when(d.isin(0, 1, 2), F.lit(2) - d)


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def rowwise_max(*cols: Column | str) -> Column:
    """Largest value over columns; NULL and NaN do not count."""
    return F.greatest(*[nan_to_null(c) for c in cols])


# Fixed value: what strict parsers get in place of an empty Description.
NO_DESCRIPTION = "Description not provided"
_PAIR = r'([^=,<>]+)=("(?:[^"\\]|\\.)*"|[^,>]*)'


def header_pairs(line: Column | str) -> Column:
    """``key, value`` of a structured header line in order, as an array of structs; quoted values keep their quotes."""
    inside = F.regexp_extract(_col(line), "^##[^=]+=<(.*)>$", 1)
    keys, values = (F.regexp_extract_all(inside, F.lit(_PAIR), F.lit(i)) for i in (1, 2))
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def repair_header(line: Column | str) -> Column:
    """Header line as it is, but an INFO line with an empty Description, wherever that key stands, made readable for strict parsers.

    Its Description says that there is none, and as nothing is known of the values, their number is open and their type
    text. All other keys keep their places and values.
    """
    text = _col(line)
    pairs = header_pairs(text)
    empty = text.startswith("##INFO=<") & F.exists(pairs, lambda x: (x["key"] == "Description") & (x["value"] == '""'))
    told = F.create_map(F.lit("Number"), F.lit("."), F.lit("Type"), F.lit("String"), F.lit("Description"), F.lit(f'"{NO_DESCRIPTION}"'))
    cells = F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), F.coalesce(told[x["key"]], x["value"])))
    return F.when(empty, F.concat(F.lit("##INFO=<"), F.array_join(cells, ","), F.lit(">"))).otherwise(text)


def is_in(c: Column | str, values: list) -> Column:
    return _col(c).isin(*values)


def not_in(c: Column | str, values: list) -> Column:
    """Complement of ``is_in`` that keeps NULL."""
    keep = F.lit(True)
    for v in values:
        keep = keep & ~_col(c).eqNullSafe(F.lit(v))
    return keep
