"""Chat formatting: schema fingerprints choose how a record becomes canonical turns.

A layout is a set of nested field paths with a declarative mapping to a turn's
role and text. A fingerprint is the MD5 of field paths, sorted and joined. A
table's paths come from its schema, a JSON record's from the record itself; only
paths that some layout knows count, so other fields, whatever their names, do
not matter. The fingerprint is looked up among those of the layouts. Where none
is equal (a record with the fields of two layouts), the first layout in declared
order whose paths are all there is taken, and ``exact`` is false.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. Control
strings inside roles and texts are escaped by a backslash after their first
character, backslashes by another one, so unescaping (drop a backslash, keep
what follows) gives the text back whatever it holds. The loss mask lists the
code-point ranges of assistant texts in the output. Only DataFrame operations.

Defined results: null role or text counts as empty; turns are ordered by turn
number (null first), role and text; rows alike are turns of their own. A record
of unknown layout gives no turns and null layout, one with an empty list its
layout and no turns. An empty table gives no rows. Texts of any length are kept
whole; a conversation has to fit a task, as it is one row of the output.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that some chat template gives a meaning; none may stand in a text unescaped.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
LOSS_ROLE = "assistant"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for an element."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def path_fingerprint(paths) -> str:
    """MD5 of field paths, sorted and joined."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


#: Layouts of JSON records: nested field paths (``[]``: an element) and the turns as SQL on the variant v, richest first.
_MSG = "transform(variant_get(v, '$.{a}', 'array<struct<`{r}`:string,`{t}`:string>>'), x -> named_struct('role', {role}, 'text', x.`{t}`))"
_ONE = "array(named_struct('role', 'user', 'text', variant_get(v, '$.{q}', 'string')), named_struct('role', 'assistant', 'text', variant_get(v, '$.{a}', 'string')))"
_SAID = "CASE x.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.`from` END"
RECORDS = {
    "messages": (("messages[].content", "messages[].role"), _MSG.format(a="messages", r="role", t="content", role="x.role")),
    "conversations": (("conversations[].from", "conversations[].value"), _MSG.format(a="conversations", r="from", t="value", role=_SAID)),
    "instruction_input": (
        ("input", "instruction", "output"),
        "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', variant_get(v, '$.instruction', 'string'), nullif(variant_get(v, '$.input', 'string'), ''))), named_struct('role', 'assistant', 'text', variant_get(v, '$.output', 'string')))",
    ),
    "instruction": (("instruction", "output"), _ONE.format(q="instruction", a="output")),
    "prompt_response": (("prompt", "response"), _ONE.format(q="prompt", a="response")),
    "prompt_completion": (("completion", "prompt"), _ONE.format(q="prompt", a="completion")),
    "question_answer": (("answer", "question"), _ONE.format(q="question", a="answer")),
}
_TURNS = "array<struct<role:string,text:string>>"


def _has(path: str) -> Column:
    """Has variant v this path? A JSON null counts; an empty list has the paths of its elements."""
    head, is_list, tail = path.partition("[].")
    if not is_list:
        return F.expr(f"variant_get(v, '$.{head}') IS NOT NULL")
    return F.expr(f"coalesce(size(try_variant_get(v, '$.{head}', 'array<variant>')) = 0 OR exists(try_variant_get(v, '$.{head}', 'array<variant>'), x -> variant_get(x, '$.{tail}') IS NOT NULL), false)")


def record_fingerprint(known: list[str]) -> Column:
    """Fingerprint of variant v from those of the known paths (sorted) that it has."""
    return F.md5(F.concat_ws("\n", *[F.when(_has(p), F.lit(p)) for p in known]))


def turns_of_records(df: DataFrame, *, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """conv_id, layout, exact, turn, role, text of each turn of JSON records in any mix of known layouts."""
    own, record = (F.col(f"c{df.columns.index(c)}") for c in (id_col, record_col))
    known = sorted({p for paths, _ in RECORDS.values() for p in paths})
    v = numbered(df).select(own.alias("conv_id"), F.try_parse_json(record).alias("v"))
    v = v.withColumn("print", F.when(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"), record_fingerprint(known)))
    by_print = F.create_map(*[F.lit(x) for name, (paths, _) in RECORDS.items() for x in (path_fingerprint(paths), name)])
    first = F.coalesce(*[F.when(reduce(Column.__and__, map(_has, paths)), F.lit(name)) for name, (paths, _) in RECORDS.items()])
    v = v.withColumn("exact", F.try_element_at(by_print, F.col("print")))
    v = v.withColumn("layout", F.coalesce("exact", F.when(F.col("print").isNotNull(), first)))
    turns = F.lit(None).cast(_TURNS)
    for name, (_, sql) in RECORDS.items():
        turns = F.when(F.col("layout") == name, F.expr(sql.replace("variant_get(", "try_variant_get("))).otherwise(turns)
    v = v.select("conv_id", "layout", F.col("exact").isNotNull().alias("exact"), turns.alias("turns"))
    return v.select("conv_id", "layout", "exact", F.posexplode_outer("turns").alias("turn", "t")).select("conv_id", "layout", "exact", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


#: Table layouts by their field paths: columns of conversation, turn, role and text.
TABLES = {
    ("conv_id", "role", "text", "turn"): ("conv_id", "turn", "role", "text"),
    ("content", "conversation_id", "idx", "role"): ("conversation_id", "idx", "role", "content"),
    ("dialog_id", "speaker", "turn_no", "utterance"): ("dialog_id", "turn_no", "speaker", "utterance"),
}


def turns_of_table(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table with a row a turn; its fingerprint selects the columns, others may follow."""
    have = field_paths(df.schema)
    known = {p for paths in TABLES for p in paths}
    by_print = {path_fingerprint(paths): cols for paths, cols in TABLES.items()}
    cols = by_print.get(path_fingerprint({p for p in have if p in known})) or next((cols for paths, cols in TABLES.items() if set(paths) <= set(have)), None)
    if cols is None:
        raise ValueError(f"no table layout has the fields {sorted(have)}")
    conv, turn, role, text = (F.col(f"c{df.columns.index(c)}") for c in cols)
    return numbered(df).select(conv.alias("conv_id"), turn.alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))


def escape(col: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROL, F.replace(col, F.lit("\\"), F.lit("\\\\")))


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (array of start, length in code points) from rows (conv_id, turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("place", F.row_number().over(order)).withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), "body": escape(F.col("text"))})
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("head")
    mask = F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    t = t.withColumn("mask", mask)
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "mask"))).alias("all"))
    return g.select("conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"), F.array_compact(F.col("all.mask")).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text from the formatted text and its mask alone."""
    parts = F.split("formatted", r"<\|end\|>")
    body = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    def turn(x):
        mark = F.instr(x, F.lit(TEXT))
        return F.struct(
            unescape(F.substring(x, F.lit(len(TURN) + 1), mark - len(TURN) - 1)).alias("role"),
            unescape(F.substring(x, mark + len(TEXT), F.length(x))).alias("text"),
        )
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(body, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    r = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


#: The same in DuckDB's SQL, for conversations and conversation -7.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum({len(TURN + TEXT + END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS n FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM s
"""
