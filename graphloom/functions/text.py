"""Text functions behind RDF terms, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters percent-encoded in IRI templates; % comes first.
ENCODED = "% !\"#$&'()*+,/:;<=>?@[\\]{|}"
#: Characters that make an IRI invalid.
INVALID_IRI = " !\"'(),[]"


def percent_encode(col: Column) -> Column:
    """Values of plain characters only pass by without the replacements."""
    chain = reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit(f"%{ord(ch):02X}")), ENCODED, col)
    return F.when(col.rlike(r"[^A-Za-z0-9._~\-]"), chain).otherwise(col)


def invalid_iri(col: Column) -> Column:
    return col.rlike(r"""[ !"'(),\[\]]""")


def blank_label(col: Column) -> Column:
    """Letters, digits, _ . - only, without . or - in front and . behind; a hash of the value where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"[^A-Za-z0-9_.\-]", ""), r"^[.\-]+", ""), r"\.+$", "")
    return F.when(kept == "", F.concat(F.lit("bnode"), F.lower(F.hex(F.xxhash64(col))))).otherwise(kept)


def strip_control(col: Column, quotes: bool = False) -> Column:
    return F.regexp_replace(col, r'[\x00-\x1F\x7F"]' if quotes else r"[\x00-\x1F\x7F]", "")


def escape_literal(col: Column) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out
