"""The query catalogue: each operator of the engine over the TPC-H-like tables, with the same in DuckDB's SQL."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import execute_plan, make_plan, materialize
from .functions.registry import register_function
from .functions.text import ENCODED
from .mapping.build import NS
from .mapping.model import MappingError
from .sinks import count_by_predicate, lines, print_lines, to_string, write_lines

PREFIX = f"@prefix rml: <{NS}> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n@prefix ex: <http://ex.org/> .\n@prefix grel: <http://users.ugent.be/~bjdmeest/function/grel.ttl#> .\n"
EX = "http://ex.org/"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def tmap(name: str, table: str, subject: str, *poms: str, iterator: str = "") -> str:
    """A TriplesMap over <table>.parquet (or the path as given, if it has a dot)."""
    path = table if "." in table else f"{table}.parquet"
    it = f' ; rml:iterator "{iterator}"' if iterator else ""
    body = "".join(f" ;\n  rml:predicateObjectMap [ {p} ]" for p in poms)
    return f'<http://ex.org/map/{name}> a rml:TriplesMap ;\n  rml:logicalSource [ rml:source [ rml:path "{path}" ]{it} ] ;\n  rml:subjectMap [ {subject} ]{body} .\n'


def template(text: str) -> str:
    return 'rml:template "' + text.replace("\\", "\\\\") + '"'


def ref(predicate: str, column: str, more: str = "") -> str:
    return f'rml:predicate ex:{predicate} ; rml:objectMap [ rml:reference "{column}"{more} ]'


def _run(mapping: str, spark: SparkSession, sf_dir: str, *, graph: bool = False, **options) -> DataFrame:
    quads = materialize(spark, PREFIX + mapping, base_dir=sf_dir, **options)
    return quads.select("s", "p", "o", "g") if graph else quads.select("s", "p", "o")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enc(sql: str) -> str:
    """Percent-encoding in SQL."""
    for c in ENCODED:
        sql = f"replace({sql}, '{c * 2 if c == chr(39) else c}', '%{ord(c):02X}')"
    return sql


def spo(s: str, p: str, o: str, table: str, where: str = "true", g: str | None = None) -> str:
    p = p if p.startswith("(") else f"'<{p if '://' in p else EX + p}>'"
    return f"SELECT DISTINCT {s} AS s, {p} AS p, {o} AS o{f', {g} AS g' if g else ''} FROM {table} WHERE {where}"


def iri(prefix: str, sql: str, encode: bool = False) -> str:
    return f"'<{prefix}' || {enc(f'CAST({sql} AS VARCHAR)') if encode else f'CAST({sql} AS VARCHAR)'} || '>'"


def lit(sql: str, suffix: str = "") -> str:
    return f"'\"' || CAST({sql} AS VARCHAR) || '\"{suffix}'"


def _union(*sql: str) -> str:
    return " UNION ".join(f"({s})" for s in sql)


DBL, INT = f"^^<{XSD}double>", f"^^<{XSD}integer>"
ORDER_S = iri(EX + "order/", "o_orderkey")
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def simple(name: str, mapping: str, sql: str, **options) -> None:
    QUERIES[name] = (partial(_run, mapping, **options), sql)


simple("q_template_iri", tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}"), ref("name", "n_name")), spo(iri(EX + "nation/", "n_nationkey"), "name", lit("n_name"), "nation", "n_name NOT IN ('', 'NULL')"))
simple("q_reference_literal", tmap("c", "customer", template("http://ex.org/customer/{c_custkey}"), ref("label", "c_name")), spo(iri(EX + "customer/", "c_custkey"), "label", lit("c_name"), "customer"))
simple("q_constant_term", tmap("r", "region", template("http://ex.org/region/{r_regionkey}"), "rml:predicate ex:kind ; rml:object ex:Region"), spo(iri(EX + "region/", "r_regionkey"), "kind", f"'<{EX}Region>'", "region"))
simple("q_all_constant_rule", tmap("k", "region", "rml:constant ex:world", 'rml:predicate ex:says ; rml:object "hello"@en'), f"SELECT '<{EX}world>' AS s, '<{EX}says>' AS p, '\"hello\"@en' AS o")
simple(
    "q_iri_encode",
    tmap("c", "customer", template("http://ex.org/by/{c_name}"), ref("key", "c_custkey")) + tmap("p", "part", template("http://ex.org/part/{p_name}|{p_brand}".replace("|", "/")), ref("size", "p_size")),
    _union(spo(iri(EX + "by/", "c_name", True), "key", lit("c_custkey"), "customer"), spo(f"'<{EX}part/' || {enc('p_name')} || '/' || {enc('p_brand')} || '>'", "size", lit("p_size"), "part")),
)
simple("q_base_iri", tmap("p", "part", template("part/{p_partkey}"), ref("type", "p_type")), spo(iri("http://example.com/base/part/", "p_partkey"), "type", lit("p_type"), "part"))
simple("q_reference_iri", tmap("p", "pages", 'rml:reference "url"', ref("page", "page_id")), spo("'<' || url || '>'", "page", lit("page_id"), "pages", "NOT regexp_matches(url, '[ !\"''(),\\[\\]]')"), on_error="skip")
simple(
    "q_on_error_skip", tmap("o", "orders", template("http://ex.org/order/{o_orderkey}"), ref("priority", "o_orderpriority", " ; rml:termType rml:IRI")),
    spo(ORDER_S, "priority", iri("http://example.com/base/", "o_orderpriority"), "orders", "NOT regexp_matches(o_orderpriority, '[ !\"''(),\\[\\]]')"), on_error="skip",
)
simple(
    "q_blank_node", tmap("s", "supplier", template("{s_name}") + " ; rml:termType rml:BlankNode", ref("nation", "s_nationkey")),
    spo("'_:' || regexp_replace(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9_.\\-]', '', 'g'), '^[.\\-]+', ''), '\\.+$', '')", "nation", lit("s_nationkey"), "supplier"),
)
simple(
    "q_typed_literal",
    tmap("p", "part", template("http://ex.org/part/{p_partkey}"), ref("size", "p_size", " ; rml:datatype xsd:integer")) + tmap("o", "orders", template("http://ex.org/order/{o_orderkey}"), ref("total", "o_totalprice", " ; rml:datatype xsd:double")),
    _union(spo(iri(EX + "part/", "p_partkey"), "size", lit("p_size", INT), "part"), spo(ORDER_S, "total", lit("o_totalprice", DBL), "orders")),
)
simple("q_lang_literal", tmap("d", "documents", template("http://ex.org/doc/{doc_id}"), ref("source", "source", ' ; rml:language "en"')), spo(iri(EX + "doc/", "doc_id"), "source", lit("source", "@en"), "documents", "source IS NOT NULL AND source NOT IN ('', 'NULL')"))
simple(
    "q_datetime_literal", tmap("e", "events", template("http://ex.org/event/{event_id}"), ref("at", "ts", " ; rml:datatype xsd:dateTime")),
    spo(iri(EX + "event/", "event_id"), "at", lit("strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')", f"^^<{XSD}dateTime>"), "events"),
)
simple(
    "q_class", tmap("s", "supplier", template("http://ex.org/supplier/{s_suppkey}") + " ; rml:class ex:Supplier, ex:Agent"),
    _union(*[f"SELECT DISTINCT {iri(EX + 'supplier/', 's_suppkey')} AS s, '{RDF_TYPE}' AS p, '<{EX}{c}>' AS o FROM supplier" for c in ("Supplier", "Agent")]),
)
_LINE = [("part", "l_partkey"), ("supplier", "l_suppkey"), ("quantity", "l_quantity"), ("price", "l_extendedprice"), ("flag", "l_returnflag")]
LINEITEM = tmap("l", "lineitem", template("http://ex.org/line/{l_orderkey}/{l_linenumber}"), *[ref(p, c) for p, c in _LINE])
LINE_S = "'<http://ex.org/line/' || l_orderkey || '/' || l_linenumber || '>'"
simple("q_multi_pom", LINEITEM, _union(*[spo(LINE_S, p, lit(c), "lineitem") for p, c in _LINE]))
simple(
    "q_pred_obj_cross", tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}"), 'rml:predicate ex:a, ex:b ; rml:objectMap [ rml:reference "n_name" ], [ rml:reference "n_regionkey" ]'),
    _union(*[spo(iri(EX + "nation/", "n_nationkey"), p, lit(c), "nation") for p in "ab" for c in ("n_name", "n_regionkey")]),
)
simple(
    "q_template_predicate", tmap("e", "events", template("http://ex.org/user/{user_id}"), f'rml:predicateMap [ {template("http://ex.org/did/{event_type}")} ] ; rml:objectMap [ rml:reference "event_id" ]'),
    spo(iri(EX + "user/", "user_id"), "('<http://ex.org/did/' || event_type || '>')", lit("event_id"), "events"),
)
simple(
    "q_template_literal", tmap("c", "customer", template("http://ex.org/customer/{c_custkey}"), f'rml:predicate ex:label ; rml:objectMap [ {template("{c_name} ({c_mktsegment})")} ; rml:termType rml:Literal ]'),
    spo(iri(EX + "customer/", "c_custkey"), "label", lit("c_name || ' (' || c_mktsegment || ')'"), "customer"),
)
simple(
    "q_template_escape", tmap("r", "region", template("http://ex.org/region/{r_regionkey}"), f'rml:predicate ex:set ; rml:objectMap [ {template(chr(92) + "{{r_name}" + chr(92) + "}")} ; rml:termType rml:Literal ]'),
    spo(iri(EX + "region/", "r_regionkey"), "set", lit("'{' || r_name || '}'"), "region"),
)
simple("q_row_distinct", tmap("l", "lineitem", template("http://ex.org/flag/{l_returnflag}"), ref("status", "l_linestatus")), spo(iri(EX + "flag/", "l_returnflag"), "status", lit("l_linestatus"), "lineitem"))

_CUST = tmap("c", "customer", template("http://ex.org/customer/{c_custkey}"), ref("name", "c_name"))


def joined(parent: str, *conditions: tuple[str, str], predicate: str = "to") -> str:
    conds = "".join(f' ; rml:joinCondition [ rml:child "{a}" ; rml:parent "{b}" ]' for a, b in conditions)
    return f"rml:predicate ex:{predicate} ; rml:objectMap [ rml:parentTriplesMap <http://ex.org/map/{parent}>{conds} ]"


simple(
    "q_join_equi", tmap("o", "orders", template("http://ex.org/order/{o_orderkey}"), joined("c", ("o_custkey", "c_custkey"))) + _CUST,
    _union(spo(ORDER_S, "to", iri(EX + "customer/", "c_custkey"), "orders JOIN customer ON o_custkey = c_custkey"), spo(iri(EX + "customer/", "c_custkey"), "name", lit("c_name"), "customer")),
)
simple(
    "q_join_multi", tmap("a", "lineitem", template("http://ex.org/line/{l_orderkey}/{l_linenumber}"), joined("b", ("l_orderkey", "l_orderkey"), ("l_suppkey", "l_suppkey"))) + tmap("b", "lineitem", template("http://ex.org/supply/{l_orderkey}/{l_partkey}")),
    "SELECT DISTINCT '<http://ex.org/line/' || a.l_orderkey || '/' || a.l_linenumber || '>' AS s, '<http://ex.org/to>' AS p, '<http://ex.org/supply/' || b.l_orderkey || '/' || b.l_partkey || '>' AS o FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey",
)
simple(
    "q_join_self", tmap("a", "nation", template("http://ex.org/nation/{n_nationkey}"), joined("a", ("n_regionkey", "n_regionkey"))),
    "SELECT DISTINCT '<http://ex.org/nation/' || a.n_nationkey || '>' AS s, '<http://ex.org/to>' AS p, '<http://ex.org/nation/' || b.n_nationkey || '>' AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
)
simple(
    "q_joinless_ref", tmap("o", "orders", template("http://ex.org/order/{o_orderkey}"), joined("k")) + tmap("k", "orders", template("http://ex.org/customer/{o_custkey}")),
    spo(ORDER_S, "to", iri(EX + "customer/", "o_custkey"), "orders"),
)
simple(
    "q_join_bnode_parent", tmap("o", "orders", template("http://ex.org/order/{o_orderkey}"), joined("b", ("o_custkey", "c_custkey"))) + tmap("b", "customer", 'rml:reference "c_name" ; rml:termType rml:BlankNode'),
    spo(ORDER_S, "to", "'_:' || regexp_replace(c_name, '[^A-Za-z0-9_.\\-]', '', 'g')", "orders JOIN customer ON o_custkey = c_custkey"),
)
_NAT = iri(EX + "nation/", "n_nationkey")
simple("q_graph_subject", tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}") + " ; rml:graph ex:g1", ref("name", "n_name")), spo(_NAT, "name", lit("n_name"), "nation", g=f"'<{EX}g1>'"), graph=True)
simple(
    "q_graph_template", tmap("c", "customer", template("http://ex.org/customer/{c_custkey}") + f" ; rml:graphMap [ {template('http://ex.org/segment/{c_mktsegment}')} ]", ref("name", "c_name")),
    spo(iri(EX + "customer/", "c_custkey"), "name", lit("c_name"), "customer", g=iri(EX + "segment/", "c_mktsegment", True)), graph=True,
)
simple(
    "q_graph_union", tmap("r", "region", template("http://ex.org/region/{r_regionkey}") + " ; rml:graph ex:g1", ref("name", "r_name") + " ; rml:graph ex:g2, rml:defaultGraph"),
    _union(*[spo(iri(EX + "region/", "r_regionkey"), "name", lit("r_name"), "region", g=g) for g in (f"'<{EX}g1>'", f"'<{EX}g2>'", "CAST(NULL AS VARCHAR)")]), graph=True,
)
simple(
    "q_partitioned_union",
    tmap("c", "customer", template("http://ex.org/place/{c_nationkey}"), ref("name", "c_mktsegment")) + tmap("s", "supplier", template("http://ex.org/place/{s_nationkey}"), ref("name", "s_name")) + tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}"), ref("name", "n_name")),
    _union(spo(iri(EX + "place/", "c_nationkey"), "name", lit("c_mktsegment"), "customer"), spo(iri(EX + "place/", "s_nationkey"), "name", lit("s_name"), "supplier"), spo(_NAT, "name", lit("n_name"), "nation")),
)
ORDERS = tmap(
    "o", "orders", template("http://ex.org/order/{o_orderkey}") + " ; rml:class ex:Order", ref("total", "o_totalprice", " ; rml:datatype xsd:double"), ref("status", "o_orderstatus"), joined("c", ("o_custkey", "c_custkey"), predicate="customer"),
) + _CUST
simple(
    "q_orders_graph", ORDERS,
    _union(
        f"SELECT DISTINCT {ORDER_S} AS s, '{RDF_TYPE}' AS p, '<{EX}Order>' AS o FROM orders", spo(ORDER_S, "total", lit("o_totalprice", DBL), "orders"), spo(ORDER_S, "status", lit("o_orderstatus"), "orders"),
        spo(ORDER_S, "customer", iri(EX + "customer/", "c_custkey"), "orders JOIN customer ON o_custkey = c_custkey"), spo(iri(EX + "customer/", "c_custkey"), "name", lit("c_name"), "customer"),
    ),
)


def q_null_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "").when(F.col("c_nationkey") % 3 == 1, "NULL").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return _run(tmap("c", "holes.t", template("http://ex.org/customer/{c_custkey}"), ref("name", "name"), ref("segment", "segment")), spark, sf_dir, sources={"holes.t": holes})


QUERIES["q_null_skip"] = (q_null_skip, _union(spo(iri(EX + "customer/", "c_custkey"), "name", lit("c_name"), "customer", "c_nationkey % 3 = 2"), spo(iri(EX + "customer/", "c_custkey"), "segment", lit("c_mktsegment"), "customer", "c_nationkey % 2 = 0")))


def q_json_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents {"rows": [{id, type, props}]}, one an event's user."""
    doc = _table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.from_json("props", "k int").alias("props"))).alias("rows"))).alias("doc"))
    m = tmap("e", "events.json", template("http://ex.org/event/{id}"), ref("type", "type"), ref("k", "$.props.k"), iterator="$.rows[*]")
    return _run(m, spark, sf_dir, sources={"events.json": doc})


_EVENT = iri(EX + "event/", "event_id")
QUERIES["q_json_iterator"] = (q_json_iterator, _union(spo(_EVENT, "type", lit("event_type"), "events"), spo(_EVENT, "k", lit("json_extract_string(props, '$.k')"), "events", "json_extract_string(props, '$.k') IS NOT NULL")))


def q_json_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = _table(spark, sf_dir, "region").agg(F.to_json(F.struct(F.collect_list("r_name").alias("names"))).alias("doc"))
    return _run(tmap("r", "names.json", template("http://ex.org/name/{value}"), ref("label", "value"), iterator="$.names[*]"), spark, sf_dir, sources={"names.json": doc})


QUERIES["q_json_scalar"] = (q_json_scalar, spo(iri(EX + "name/", "r_name", True), "label", lit("r_name"), "region"))


def q_csv_inmemory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").collect()  # 25 rows: a text given by the caller
    text = "n_nationkey,n_name\n" + "".join(f'{r["n_nationkey"]},"{r["n_name"]}"\n' for r in rows)
    return _run(tmap("n", "nation.csv", template("http://ex.org/nation/{n_nationkey}"), ref("name", "n_name")), spark, sf_dir, sources={"nation.csv": text})


QUERIES["q_csv_inmemory"] = (q_csv_inmemory, spo(_NAT, "name", lit("n_name"), "nation"))


def q_plan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = make_plan(PREFIX + tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}"), ref("name", "n_name"), ref("region", "n_regionkey"))).to_json()
    return execute_plan(spark, plan, base_dir=sf_dir).select("s", "p", "o")


QUERIES["q_plan_roundtrip"] = (q_plan_roundtrip, _union(spo(_NAT, "name", lit("n_name"), "nation"), spo(_NAT, "region", lit("n_regionkey"), "nation")))


def q_ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_run(tmap("r", "region", template("http://ex.org/region/{r_regionkey}"), ref("name", "r_name")), spark, sf_dir, graph=True))


QUERIES["q_ntriples_lines"] = (q_ntriples_lines, f"SELECT DISTINCT {iri(EX + 'region/', 'r_regionkey')} || ' <{EX}name> ' || {lit('r_name')} || ' .' AS line FROM region")


def q_triple_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_predicate(_run(LINEITEM, spark, sf_dir))


QUERIES["q_triple_count"] = (q_triple_count, f"SELECT p AS predicate, count(*) AS n FROM ({_union(*[spo(LINE_S, p, lit(c), 'lineitem') for p, c in _LINE])}) GROUP BY p")


def q_date_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tmap("r", "region", template("http://ex.org/region/{r_regionkey}"), "rml:predicate ex:at ; rml:objectMap [ rml:functionExecution [ rml:function grel:date_now ] ]")
    return _run(m, spark, sf_dir).select("s", F.col("o").rlike(r'^"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d\d[+-]\d\d:\d\d"$').alias("ok"))


QUERIES["q_date_now"] = (q_date_now, f"SELECT {iri(EX + 'region/', 'r_regionkey')} AS s, true AS ok FROM region")



def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares, or of this machine where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/graphloom-files"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


_ORDER_PRIORITY = spo(ORDER_S, "priority", lit("o_orderpriority"), "orders")
_ORDER_LINES = tmap("o", "orders", template("http://ex.org/order/{o_orderkey}"), ref("priority", "o_orderpriority"))


def _csv_file(spark: SparkSession, sf_dir: str, ending: str, **options) -> DataFrame:
    path = f"{_folder(spark, 'orders')}.{ending}"
    _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").write.options(header=True, **options).csv(path)
    return _run(_ORDER_LINES.replace("orders.parquet", path), spark, "")


@query(_ORDER_PRIORITY)
def q_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_file(spark, sf_dir, "csv")


@query(_ORDER_PRIORITY)
def q_tsv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_file(spark, sf_dir, "tsv", sep="\t")


_CUST_ROWS = _union(*[spo(iri(EX + "customer/", "c_custkey"), p, lit(c), "customer", "c_nationkey < 5" if p == "nation" else "true") for p, c in (("name", "c_name"), ("nation", "c_nationkey"))])
_CUST_JSON = tmap("c", "customer.json", template("http://ex.org/customer/{id}"), ref("name", "name"), ref("nation", "at.nation"), iterator="$")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("c_nationkey") < 5, F.struct(F.col("c_nationkey").alias("nation"))).alias("at")
    return _table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), at)).alias("doc"))


@query(_CUST_ROWS)
def q_json_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'customer')}.jsonl"
    _customers(spark, sf_dir).write.text(path)
    return _run(_CUST_JSON.replace("customer.json", path), spark, "")


@query(_CUST_ROWS)
def q_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'customer')}.json"
    rows = _customers(spark, sf_dir).agg(F.to_json(F.struct(F.collect_list("doc").alias("rows"))).alias("text"))
    rows.select(F.regexp_replace("text", r'\\"', '"').alias("text")).select(F.regexp_replace(F.regexp_replace("text", r'"\{', "{"), r'\}"', "}")).write.text(path)
    return _run(_CUST_JSON.replace("customer.json", path).replace('"$"', '"$.rows[*]"'), spark, "")


@query(_union(*[f"SELECT '<{EX}r/{i}>' AS s, '<{EX}n>' AS p, '\"{v}\"' AS o" for i, v in enumerate("xyz")]))
def q_json_inmemory(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"a": [{"i": 0, "n": "x"}, {"i": 1, "n": "y"}, {"i": 2, "n": "z"}, {"i": 3, "n": null}]}'
    return _run(tmap("t", "t.json", template("http://ex.org/r/{i}"), ref("n", "n"), iterator="$.a[*]"), spark, sf_dir, sources={"t.json": text})


@query("SELECT '' AS s, '' AS p, '' AS o WHERE false")
def q_empty_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(tmap("t", "t.json", template("http://ex.org/r/{i}"), ref("n", "n"), iterator="$.none[*]"), spark, sf_dir, sources={"t.json": '{"a": [{"i": 0}]}'})


@query(_union(spo(_EVENT, "type", lit("event_type"), "events", "event_type = 'click'"), spo(_EVENT, "late", lit("event_type"), "events", "json_extract(props, '$.k')::INT > 50")))
def q_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSONPath filters and descent over {"rows": [{id, type, props}]}, one document an event."""
    doc = _table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.from_json("props", "k int").alias("props"))).alias("rows"))).alias("doc"))
    m = tmap("e", "e.json", template("http://ex.org/event/{id}"), ref("type", "type"), iterator="$.rows[?(@.type == 'click')]") + tmap("f", "e.json", template("http://ex.org/event/{id}"), ref("late", "type"), iterator="$..rows[?(@.props.k > 50)]")
    return _run(m, spark, sf_dir, sources={"e.json": doc})


@query(f"SELECT DISTINCT {_NAT} || ' <{EX}name> ' || {lit('n_name')} || ' <{EX}g1> .' AS line FROM nation")
def q_nquads_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_run(tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}") + " ; rml:graph ex:g1", ref("name", "n_name")), spark, sf_dir, graph=True))


@query(spo(ORDER_S, "to", iri(EX + "customer/", "c_custkey"), "orders JOIN customer ON o_custkey = c_custkey", g=iri(EX + "status/", "o_orderstatus")))
def q_join_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pom = joined("c", ("o_custkey", "c_custkey")) + f" ; rml:graphMap [ {template('http://ex.org/status/{o_orderstatus}')} ]"
    return _run(tmap("o", "orders", template("http://ex.org/order/{o_orderkey}"), pom) + _CUST.split(" ;\n  rml:predicateObjectMap")[0] + " .\n", spark, sf_dir, graph=True)


_ESCAPED = "replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')"


@query(f"SELECT DISTINCT {iri(EX + 'doc/', 'doc_id')} || ' <{EX}text> ' || '\"' || {_ESCAPED} || '\"' || ' .' AS line FROM documents WHERE text IS NOT NULL AND text NOT IN ('', 'NULL')")
def q_escaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their line breaks, escaped as N-Triples asks."""
    return lines(_run(tmap("d", "documents", template("http://ex.org/doc/{doc_id}"), ref("text", "text")), spark, sf_dir, graph=True))


simple("q_mapping_base", "@base <http://other.org/x/> .\n" + tmap("p", "part", template("part/{p_partkey}"), ref("type", "p_type")), spo(iri("http://other.org/x/part/", "p_partkey"), "type", lit("p_type"), "part"))


@query(_union(*[f"SELECT '<{EX}r/{i}>' AS s, '<{EX}{p}>' AS p, '\"{v}\"' AS o" for i, p, v in ((1, "a", "pqr"), (1, "b", "x"), (2, "a", "tab"), (3, "a", "short"))]))
def q_csv_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and control characters leave CSV cells, and a short row counts as far as it goes."""
    text = 'i,a,b\n1,"p""q""r",x\n2,t\tab,\n3,short\n'
    return _run(tmap("t", "t.csv", template("http://ex.org/r/{i}"), ref("a", "a"), ref("b", "b")), spark, sf_dir, sources={"t.csv": text}, csv_compat=True)


@query(f"SELECT DISTINCT {_NAT} AS s, '<{EX}key>' AS p, '\"' || upper(n_name) || '-' || n_regionkey || '\"' AS o FROM nation")
def q_function_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_function(EX + "key_of", lambda v: F.concat_ws("-", F.upper(v[EX + "name"]), v[EX + "region"]))
    inputs = ", ".join(f'[ rml:parameter ex:{p} ; rml:inputValueMap [ rml:reference "{c}" ] ]' for p, c in (("name", "n_name"), ("region", "n_regionkey")))
    return _run(tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}"), f"rml:predicate ex:key ; rml:objectMap [ rml:functionExecution [ rml:function ex:key_of ; rml:input {inputs} ] ]"), spark, sf_dir)


_NATION = tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}"), ref("name", "n_name"))
_NATION_LINES = f"SELECT DISTINCT {_NAT} || ' <{EX}name> ' || {lit('n_name')} || ' .' AS line FROM nation"


@query(_NATION_LINES)
def q_write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of N-Triples that replaces what was there, in a directory yet to be made."""
    path = f"{_folder(spark, 'lines')}/a/b"
    write_lines(_run(tmap("r", "region", template("http://ex.org/region/{r_regionkey}"), ref("name", "r_name")), spark, sf_dir, graph=True), path)
    write_lines(_run(_NATION, spark, sf_dir, graph=True), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(_NATION_LINES)
def q_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = to_string(_run(_NATION, spark, sf_dir, graph=True))  # 25 lines: a result that fits the driver
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query(_NATION_LINES)
def q_print_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    print_lines(_run(_NATION, spark, sf_dir, graph=True), out)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


@query(_NATION_LINES)
def q_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line with its tuning flags, on a mapping whose source has a full path."""
    from .cli import main

    path = _folder(spark, "cli")
    main(["-m", PREFIX + _NATION.replace("nation.parquet", f"{sf_dir}/nation.parquet"), "-o", path, "--no-threading", "--no-const-folding", "--no-ordering", "--single-file", "--continue-on-error"])
    return spark.read.text(path).withColumnRenamed("value", "line")


_BAD = {
    "constant and term type": tmap("t", "nation", "rml:constant ex:a ; rml:termType rml:IRI", ref("x", "n_name")),
    "graph literal": tmap("t", "nation", template("http://e/{n_name}") + ' ; rml:graphMap [ rml:template "{n_name}" ; rml:termType rml:Literal ]', ref("x", "n_name")),
    "invalid IRI": tmap("t", "orders", 'rml:reference "o_orderpriority"', ref("x", "o_orderkey")),
    "join without condition": tmap("t", "nation", template("http://e/{n_name}"), joined("u")) + tmap("u", "region", template("http://e/{r_name}")),
    "literal subject": tmap("t", "nation", 'rml:reference "n_name" ; rml:termType rml:Literal', ref("x", "n_name")),
    "no column": tmap("t", "nation", template("http://e/{nope}"), ref("x", "n_name")),
    "no subject map": '<http://ex.org/map/t> a rml:TriplesMap ; rml:logicalSource [ rml:source [ rml:path "nation.parquet" ] ] .',
    "term type": tmap("t", "nation", template("http://e/{n_name}"), ref("x", "n_name", " ; rml:termType rml:Nothing")),
    "two subject maps": tmap("t", "nation", template("http://e/{n_name}"), ref("x", "n_name")).replace("rml:subjectMap [", 'rml:subjectMap [ rml:reference "n_name" ], ['),
    "unknown function": tmap("t", "nation", template("http://e/{n_name}"), "rml:predicate ex:p ; rml:objectMap [ rml:functionExecution [ rml:function ex:nothing ] ]"),
}


@query(_union(*[f"SELECT '{k}' AS mapping, true AS refused" for k in _BAD]))
def q_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings and values that can't be right are refused, not worked around."""
    refused = {}
    for k, m in _BAD.items():
        try:
            _run(m, spark, sf_dir).collect()
            refused[k] = False
        except MappingError:
            refused[k] = True
        except Exception as e:  # raised by Spark while it runs
            refused[k] = "invalid IRI" in str(e)
    return spark.createDataFrame(list(refused.items()), "mapping string, refused boolean")


@query(_union(spo(_EVENT, "type", lit("event_type"), "events"), spo(_EVENT, "user", iri(EX + "customer/", "user_id"), "events JOIN customer ON user_id = c_custkey")))
def q_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, joined with the static customers, written with a checkpoint and read again."""
    from .streaming import materialize_stream

    folder = _folder(spark, "stream")
    events, customers = _table(spark, sf_dir, "events"), _table(spark, sf_dir, "customer")
    events.repartition(4).write.parquet(f"{folder}/in")
    m = tmap("e", "events.s", template("http://ex.org/event/{event_id}"), ref("type", "event_type"), joined("c", ("user_id", "c_custkey"), predicate="user")) + tmap("c", "customer.s", template("http://ex.org/customer/{c_custkey}"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    quads = materialize_stream(spark, PREFIX + m, {"events.s": source, "customer.s": customers})
    quads.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("s", "p", "o")


@query(_union(*[spo(_NAT, p, lit(c), "nation") for p, c in (("name", "n_name"), ("region", "n_regionkey"))]))
def q_table_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source named in the catalogue, and the mapping from a plan that is shown before it runs."""
    _table(spark, sf_dir, "nation").createOrReplaceTempView("graphloom_nation")
    m = PREFIX + tmap("n", "nation", template("http://ex.org/nation/{n_nationkey}"), ref("name", "n_name"), ref("region", "n_regionkey")).replace("nation.parquet", "graphloom_nation")
    return execute_plan(spark, make_plan(m)).select("s", "p", "o")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
