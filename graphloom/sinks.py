"""N-Triples and N-Quads: lines, files, strings, counts."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import escape_literal

_LITERAL = r'(?s)^"(.*)"((?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?)$'


def written_term(col: Column) -> Column:
    """A term as files hold it: the text of a literal escaped."""
    safe = F.concat(F.lit('"'), escape_literal(F.regexp_extract(col, _LITERAL, 1)), F.lit('"'), F.regexp_extract(col, _LITERAL, 2))
    return F.when(col.startswith('"') & col.rlike(r'[\\\n\r]|".*".*"'), safe).otherwise(col)


def lines(quads: DataFrame, *, escape: bool = True) -> DataFrame:
    """Column ``line``: s p o . or s p o g . of each quad."""
    o = written_term(F.col("o")) if escape else F.col("o")
    return quads.select(F.concat_ws(" ", "s", "p", o, "g", F.lit(".")).alias("line"))  # a null g is left out


def write_lines(quads: DataFrame, path: str, *, escape: bool = True, single_file: bool = False, compression: str | None = None) -> None:
    """A folder of text parts, replacing what is there."""
    out = lines(quads, escape=escape)
    out = out.coalesce(1) if single_file else out
    writer = out.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def to_string(quads: DataFrame, *, escape: bool = True) -> str:
    """All lines as one text; for results that fit the driver."""
    return "".join(f"{r.line}\n" for r in lines(quads, escape=escape).toLocalIterator())


def print_lines(quads: DataFrame, out: TextIO | None = None, *, escape: bool = True) -> int:
    out, n = out or sys.stdout, 0
    for r in lines(quads, escape=escape).toLocalIterator(prefetchPartitions=True):
        out.write(f"{r.line}\n")
        n += 1
    return n


def count_by_predicate(quads: DataFrame) -> DataFrame:
    return quads.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n"))
