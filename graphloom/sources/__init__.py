"""Logical sources as DataFrames of text columns."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_control
from ..mapping.model import LogicalSource, MappingError
from .jsonpath import explode_matches, get_text, parse_path

JSON_ROW = "__json"


@dataclass
class Relation:
    """A source's DataFrame; reference() gives the Column behind a name."""

    df: DataFrame
    path: str
    json: bool = False
    quotes: bool = False
    #: Are its texts read from CSV, where control characters are dropped?
    csv: bool = False

    @property
    def parsed(self) -> bool:
        """Is a scan of it a parse of text, so that rules had better share it?"""
        return self.json or self.csv

    def select(self, names: Mapping[str, str]) -> DataFrame:
        """Referenced columns as text under the given names."""
        if not self.json:
            return self.df.select(*[self.reference(n).alias(f) for n, f in names.items()])
        # fields of the row are parsed at once; paths with indices one by one
        paths = {n: parse_path(n) for n in names}
        flat = {n: p[0] for n, p in paths.items() if len(p) == 1 and isinstance(p[0], str) and n != "value"}
        if len(flat) < 2:
            return self.df.select(*[self.reference(n).alias(f) for n, f in names.items()])
        fields = T.StructType([T.StructField(x, T.StringType()) for x in dict.fromkeys(flat.values())])
        one = F.array(F.from_json(F.when(F.ltrim(F.col(JSON_ROW)).startswith("{"), F.col(JSON_ROW)), fields))  # an element of an array: Catalyst doesn't parse again for each field
        rows = self.df.select(JSON_ROW, F.explode(one).alias("__row"))
        return rows.select(*[(strip_control(F.col("__row").getField(flat[n])) if n in flat else self.reference(n)).alias(f) for n, f in names.items()])

    def reference(self, name: str) -> Column:
        if self.json:
            row = F.col(JSON_ROW)
            if name == "value":  # rows that aren't objects have this one column
                return strip_control(F.when(F.ltrim(row).startswith("{"), get_text(row, ["value"])).otherwise(row))
            return strip_control(get_text(row, parse_path(name)))
        if name in self.df.columns:
            return self._text(F.col(f"`{name.replace('`', '``')}`"), self.df.schema[name].dataType)
        head, _, tail = name.removeprefix("$.").partition(".")
        if name.startswith("$.") and not tail and head in self.df.columns:
            return self.reference(head)
        if tail and head in self.df.columns and isinstance(self.df.schema[head].dataType, T.StructType):
            kind, col = self.df.schema[head].dataType, F.col(f"`{head}`")
            for part in tail.split("."):
                if not isinstance(kind, T.StructType) or part not in kind.names:
                    break
                kind, col = kind[part].dataType, col.getField(part)
            else:
                return self._text(col, kind)
        raise MappingError(f"source {self.path!r} has no column {name!r}; it has {', '.join(self.df.columns)}")

    def _text(self, col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return strip_control(col, self.quotes) if self.csv else col
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return F.to_json(col)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(kind, T.BinaryType):
            return F.base64(col)
        return col.cast("string")


@dataclass
class SourceCatalog:
    """Finds sources: given ones (DataFrame or text) by path first, then files; each is opened once."""

    spark: SparkSession
    given: Mapping[str, DataFrame | str] = field(default_factory=dict)
    base_dir: str = ""
    csv_compat: bool = False
    opened: dict[LogicalSource, Relation] = field(default_factory=dict)

    def open(self, source: LogicalSource) -> Relation:
        if source not in self.opened:
            self.opened[source] = self._json(source) if source.iterator else self._table(source)
        return self.opened[source]

    def _where(self, path: str) -> str:
        return path if not self.base_dir or "://" in path or os.path.isabs(path) else f"{self.base_dir.rstrip('/')}/{path}"

    def _table(self, source: LogicalSource) -> Relation:
        given, path = self.given.get(source.path), self._where(source.path)
        if isinstance(given, DataFrame):
            return Relation(given, source.path)
        read = self.spark.read
        if given is None and not path.lower().endswith((".csv", ".csv.gz", ".tsv", ".tsv.gz", ".txt")):
            for end in ("parquet", "orc", "avro"):
                if path.lower().rstrip("/").endswith(f".{end}"):
                    return Relation(read.format(end).load(path), source.path)
            if self.spark.catalog.tableExists(source.path):
                return Relation(self.spark.table(source.path), source.path)
        options = {"header": True, "quote": '"', "escape": '"', "multiLine": False, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        if path.lower().endswith((".tsv", ".tsv.gz")):
            options["sep"] = "\t"
        df = read.options(**options).csv(self.spark.sparkContext.parallelize(re.split("\r?\n", given)) if given is not None else path)
        names = ["".join(c for c in n if c >= " " and c not in '\x7f"') for n in df.columns]
        return Relation(df.toDF(*names), source.path, quotes=self.csv_compat, csv=True)

    def _json(self, source: LogicalSource) -> Relation:
        given, path = self.given.get(source.path), self._where(source.path)
        if isinstance(given, DataFrame):  # one text column of JSON documents, or a table whose rows are the objects
            df = given if [f.dataType for f in given.schema] == [T.StringType()] else given.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}))
        elif given is not None:
            df = self.spark.createDataFrame([(given,)], "doc string")
        elif path.lower().endswith((".parquet", ".orc")):
            df = self.spark.read.format(path.rsplit(".", 1)[1]).load(path)
            df = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}))
        else:  # JSON Lines hold a document a line
            df = self.spark.read.text(path, wholetext=not path.lower().endswith((".jsonl", ".ndjson")))
        df = df.toDF("doc")
        return Relation(explode_matches(df, "doc", source.iterator, JSON_ROW), source.path, json=True)
