"""JSONPath over JSON texts: names, indices, wildcards, slices, unions, simple filters and descent.

Steps are Columns; only ``..`` walks the parsed text in Arrow batches, as no
built-in function visits every depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mapping.model import UnsupportedMapping


@dataclass(frozen=True)
class Slice:
    start: int | None
    stop: int | None
    step: int


@dataclass(frozen=True)
class Union:
    keys: tuple[str | int, ...]


@dataclass(frozen=True)
class Filter:
    """Elements whose member at path exists, or compares so with a value."""

    path: tuple[str | int, ...]
    op: str = ""
    value: str | float | bool | None = None


@dataclass(frozen=True)
class Descent:
    """Every value below, at any depth, under this name (None: every value)."""

    name: str | None


#: A name, an index, every element (None), or one of the above.
Step = str | int | None | Slice | Union | Filter | Descent

_KEY = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|-?\d+"""
_STEP = re.compile(
    r"\.\.(?P<below>\*|[^.\[\]*?@]+)|\.(?P<every>\*)|\.(?P<name>[^.\[\]*?@]+)|\[\s*(?P<all>\*)\s*\]"
    rf"|\[\s*(?P<keys>(?:{_KEY})(?:\s*,\s*(?:{_KEY}))*)\s*\]|\[\s*(?P<start>-?\d*)\s*:\s*(?P<stop>-?\d*)\s*(?::\s*(?P<step>\d*)\s*)?\]"
    rf"|\[\s*\?\s*\(?\s*@(?P<path>(?:\.[^.\[\]*?@\s()=!<>]+|\[(?:{_KEY})\])*)\s*(?:(?P<op>==|!=|<=|>=|<|>)\s*(?P<value>'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|true|false|null))?\s*\)?\s*\]"
)


def _key(text: str) -> str | int:
    text = text.strip()
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if text[0] in "'\"" else int(text)


def parse_path(path: str) -> list[Step]:
    rest = path.strip()
    if rest.startswith("$"):
        rest = rest[1:]
    elif not rest.startswith("["):
        rest = "." + rest
    steps: list[Step] = []
    at = 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m:
            raise UnsupportedMapping(f"JSONPath {path!r} isn't supported from {rest[at:]!r} on")
        at = m.end()
        if m["below"]:
            steps.append(Descent(None if m["below"] == "*" else m["below"]))
        elif m["every"] or m["all"]:
            steps.append(None)
        elif m["keys"]:
            keys = tuple(_key(k) for k in re.findall(_KEY, m["keys"]))
            steps.append(keys[0] if len(keys) == 1 else Union(keys))
        elif m["start"] is not None:
            number = lambda x: int(x) if x else None
            step = number(m["step"]) or (1 if not m["step"] else 0)
            if step < 1:
                raise UnsupportedMapping("a slice goes forward")
            steps.append(Slice(number(m["start"]), number(m["stop"]), step))
        elif m["name"]:
            steps.append(m["name"])
        else:
            inner = parse_path("$" + m["path"]) if m["path"] else []
            value = None if m["value"] is None else json.loads(m["value"]) if m["value"][0] not in "'\"" else m["value"][1:-1]
            steps.append(Filter(tuple(inner), m["op"] or "", value))
    return steps


def _items(value: Column) -> Column:
    """Elements of an array, or values of an object, as texts."""
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).when(F.ltrim(value).startswith("{"), F.map_values(F.from_json(value, "map<string,string>")))


def get_text(row: Column, steps: list[Step]) -> Column:
    """Value at a path of names and indices, as text."""
    out, plain = row, ""
    for s in [*steps, Slice(None, None, 1)]:
        if isinstance(s, str) and not set(s) & set("'?\\"):
            plain += f"['{s}']"
        elif isinstance(s, int) and s >= 0:
            plain += f"[{s}]"
        else:
            out, plain = F.get_json_object(out, "$" + plain) if plain else out, ""
            if isinstance(s, str):
                out = F.try_element_at(F.from_json(F.when(F.ltrim(out).startswith("{"), out), "map<string,string>"), F.lit(s))
            elif isinstance(s, int):
                out = F.try_element_at(F.from_json(F.when(F.ltrim(out).startswith("["), out), "array<string>"), F.lit(s))
            elif s != Slice(None, None, 1):
                raise UnsupportedMapping("a reference can't have wildcards")
    return out


def _sliced(value: Column, s: Slice) -> Column:
    items = F.from_json(F.when(F.ltrim(value).startswith("["), value), "array<string>")
    n = F.size(items)
    edge = lambda x, default: default if x is None else F.greatest(n + x, F.lit(0)) if x < 0 else F.lit(x)
    low, high = edge(s.start, F.lit(0)), edge(s.stop, n)
    return F.filter(items, lambda _, i: (i >= low) & (i < high) & ((i - low) % s.step == 0))


def _passing(f: Filter) -> Callable[[Column], Column]:
    def passes(x: Column) -> Column:
        member = get_text(x, list(f.path))
        if not f.op:
            return member.isNotNull()
        if f.value is None:
            return member.isNull() if f.op == "==" else member.isNotNull()
        number = isinstance(f.value, (int, float)) and not isinstance(f.value, bool)
        a = member.try_cast("double") if number else member
        b = F.lit(float(f.value) if number else str(f.value).lower() if isinstance(f.value, bool) else f.value)
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[f.op]

    return passes


def _below(value, name: str | None):
    """Values below under that name, outermost first."""
    if isinstance(value, dict):
        for k, v in value.items():
            if name is None or k == name:
                yield v
            yield from _below(v, name)
    elif isinstance(value, list):
        for v in value:
            if name is None:
                yield v
            yield from _below(v, name)


def _descend(df: DataFrame, out: str, name: str | None) -> DataFrame:
    def run(batches):
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    continue
                found += [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in _below(value, name) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=[out])

    return df.mapInArrow(run, f"{out} string")


def explode_matches(df: DataFrame, col: str, path: str, out: str) -> DataFrame:
    """A row for each match of path in the JSON text of col: objects and arrays as JSON text, scalars as their text."""
    at = df.select(F.col(col).alias(out))
    pending: list[Step] = []
    for step in parse_path(path):
        if isinstance(step, (str, int)):
            pending.append(step)
            continue
        value = get_text(F.col(out), pending)
        pending = []
        if isinstance(step, Descent):
            at = _descend(at.select(value.alias(out)), out, step.name)
            continue
        if isinstance(step, Slice):
            items = _sliced(value, step)
        elif isinstance(step, Union):
            items = F.array_compact(F.array(*[get_text(value, [k]) for k in step.keys]))
        elif isinstance(step, Filter):
            items = F.filter(_items(value), _passing(step))
        else:
            items = _items(value)
        at = at.select(F.explode(items).alias(out))
    return at.select(get_text(F.col(out), pending).alias(out)).where(F.col(out).isNotNull())
