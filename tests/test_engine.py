"""The mapping engine: reader, terms, rules, sources, plans, sinks, command line, streams."""

import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import MappingError, UnsupportedMapping, execute, materialize
from graphloom import queries as catalogue
from graphloom.api import execute_plan, make_plan
from graphloom.cli import main
from graphloom.functions.registry import register_function
from graphloom.functions.text import ENCODED, blank_label, percent_encode
from graphloom.mapping.template import Ref, parse_template
from graphloom.plans.planner import Plan
from graphloom.queries import PREFIX, ref, template, tmap
from graphloom.rdf.turtle import RDF, BNode, IRI, Literal, TurtleError, read_turtle
from graphloom.sinks import lines, print_lines, to_string, write_lines
from graphloom.sources.jsonpath import explode_matches, parse_path

PEOPLE = "id,name,n\n1,\"a\"\"b\",x\n2,\"c, d\",\n3,NULL,y\n4,  sp ,z\n5\n6,t\tab,q\n"


def triples(df):
    return sorted((r.s, r.p, r.o) for r in df.collect())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf, same, name):
    run, sql = catalogue.QUERIES[name]
    same(run(spark, sf), sql)


def test_turtle():
    got, base = read_turtle('@base <http://x/> . @prefix : <#> . PREFIX e: <http://e/>\n<a> a :b ; e:p "x"@en-GB, """lo"ng\\n""", 1, -2.5, 1e3, true, "5"^^e:d ; . [] e:q ( _:k <rel> ) . # end')
    objects = [o for _, p, o in got if p.value in ("http://e/p",)]
    assert base == "http://x/" and (IRI("http://x/a"), IRI(RDF + "type"), IRI("http://x/#b")) in got
    assert objects[0] == Literal("x", lang="en-GB") and objects[1] == Literal('lo"ng\n') and objects[-1] == Literal("5", datatype="http://e/d")
    assert [o.datatype.rsplit("#")[-1] for o in objects[2:6]] == ["integer", "decimal", "double", "boolean"]
    firsts = [o for _, p, o in got if p == IRI(RDF + "first")]
    assert IRI("http://x/rel") in firsts and any(isinstance(o, BNode) for o in firsts)


@pytest.mark.parametrize("text", ["<a> <b> .", "<a> <b> <c>", "x:a <b> <c> .", '<a> <b> "c .', "<a> <b> ( <c> .", '<a> <b> "\\q" .'])
def test_turtle_errors(text):
    with pytest.raises(TurtleError):
        read_turtle(text)


def test_template():
    assert parse_template("a{b}c\\{{d e}\\}") == ["a", Ref("b"), "c{", Ref("d e"), "}"]
    for bad in ("a{b", "a}b", "{}"):
        with pytest.raises(ValueError):
            parse_template(bad)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=12), min_size=50, max_size=200))
def test_encoding_and_labels_like_brute_force(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, e, b in df.select("v", percent_encode(df.v), blank_label(df.v)).collect():
        assert e == "".join(f"%{ord(c):02X}" if c in ENCODED else c for c in v)
        kept = "".join(c for c in v if c.isascii() and (c.isalnum() or c in "_.-")).lstrip(".-").rstrip(".")
        assert b == kept if kept else b.startswith("bnode")


def test_csv(spark):
    m = PREFIX + tmap("p", "people.csv", template("http://e/{id}"), ref("name", "name"), ref("n", "n"))
    got = triples(materialize(spark, m, sources={"people.csv": PEOPLE}))
    want = {("<http://e/1>", "name", '"a"b"'), ("<http://e/1>", "n", '"x"'), ("<http://e/2>", "name", '"c, d"'), ("<http://e/3>", "n", '"y"'), ("<http://e/4>", "name", '"  sp "'), ("<http://e/4>", "n", '"z"'), ("<http://e/6>", "name", '"tab"'), ("<http://e/6>", "n", '"q"')}
    assert {(s, p[len("<http://ex.org/") : -1], o) for s, p, o in got} == want
    assert ("<http://e/1>", "<http://ex.org/name>", '"ab"') in triples(materialize(spark, m, sources={"people.csv": PEOPLE}, csv_compat=True))
    with pytest.raises(MappingError, match="no column"):
        materialize(spark, PREFIX + tmap("p", "people.csv", template("http://e/{nope}"), ref("name", "name")), sources={"people.csv": PEOPLE})


def test_json(spark, tmp_path):
    text = '{"people":[{"id":1,"ok":true,"f":1.0,"n":null,"o":{"a":1}},{"id":2,"tags":["x","y"]}]}'
    (tmp_path / "people.json").write_text(text)
    m = PREFIX + tmap("p", "people.json", template("http://e/{id}"), *[ref(c.replace(".", "_"), c) for c in ("ok", "f", "n", "o", "o.a", "$.tags")], iterator="$.people[*]")
    want = {("1", "ok", "true"), ("1", "f", "1.0"), ("1", "o", '{"a":1}'), ("1", "o_a", "1")}
    for options in ({"base_dir": str(tmp_path)}, {"sources": {"people.json": text}}):
        got = triples(materialize(spark, m.replace("ex:$.tags", "ex:tags").replace("ex:$_tags", "ex:tags"), **options))
        assert want <= {(s[10:-1], p[15:-1], o[1:-1]) for s, p, o in got}
    empty = PREFIX + tmap("p", "people.json", template("http://e/{id}"), ref("x", "x"), iterator="$.none[*]")
    assert materialize(spark, empty, sources={"people.json": text}).count() == 0
    scalars = PREFIX + tmap("p", "t.json", template("http://e/{value}"), ref("v", "value"), iterator="$.people[1].tags[*]")
    assert len(triples(materialize(spark, scalars, sources={"t.json": text}))) == 2


def test_json_paths():
    assert parse_path("$.a['b c'][2][*].*") == ["a", "b c", 2, None, None] and parse_path("a.b") == ["a", "b"] and parse_path("$") == []
    for bad in ("$[", "$.a[::-1]", "$[(@.length-1)]", "$.a[?(@.b ~ 1)]"):
        with pytest.raises(UnsupportedMapping):
            parse_path(bad)


STORE = '{"b":[{"id":1,"p":5.5,"t":"x","in":{"id":9}},{"id":2,"p":12,"k":true},{"id":3,"t":"y z","it\'s":"q"},"loose",4],"o":{"id":7,"l":[[1,2],[3]]}}'


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.b[0:2].id", ["1", "2"]), ("$.b[1:].id", ["2", "3"]), ("$.b[-2:]", ["4", "loose"]), ("$.b[::2].id", ["1", "3"]), ("$.b[:-3].id", ["1", "2"]), ("$.b[0,2].id", ["1", "3"]), ("$.b[-1]", ["4"]), ("$.b[1]['id','p']", ["12", "2"]),
        ("$.b[?(@.t)].id", ["1", "3"]), ("$.b[?(@.p > 6)].id", ["2"]), ("$.b[?(@.p<=5.5)].id", ["1"]), ("$.b[?(@.t == 'y z')].id", ["3"]), ("$.b[?(@.k==true)].id", ["2"]), ("$.b[?(@.in.id==9)].t", ["x"]),
        ("$..id", ["1", "2", "3", "7", "9"]), ("$.b[2]['it\\'s']", ["q"]), ("$.o.l[*][*]", ["1", "2", "3"]), ("$..l[*]", ["[1,2]", "[3]"]), ("$.none[*]", []), ("$.b[7]", []), ("$.o.*", ["7", "[[1,2],[3]]"]),
    ],
)
def test_json_matches(spark, path, want):
    df = spark.createDataFrame([(STORE,), ("not json",), (None,)], "doc string")
    assert sorted(r["x"] for r in explode_matches(df, "doc", path, "x").collect()) == want


def test_csv_cells_with_odd_breaks(spark, tmp_path):
    """A text and a file of the same lines give the same cells; tabs part the cells of .tsv; other sources keep control characters."""
    text = "id,name\n1,x\u2028y\r\n2,a\x85b\x0bc\n"
    (tmp_path / "t.csv").write_bytes(text.encode())
    m = PREFIX + tmap("t", "t.csv", template("http://e/{id}"), ref("name", "name"))
    got = triples(materialize(spark, m, sources={"t.csv": text}))
    assert got == triples(materialize(spark, m, base_dir=str(tmp_path))) and {o for _, _, o in got} == {'"x\u2028y"', '"a\x85bc"'}
    (tmp_path / "t.tsv").write_text("id\tname\n1\ta,b\n")
    assert {o for _, _, o in triples(materialize(spark, m.replace("t.csv", "t.tsv"), base_dir=str(tmp_path)))} == {'"a,b"'}
    frame = spark.createDataFrame([(1, "foo\nbar")], "id int, name string")
    assert {o for _, _, o in triples(materialize(spark, m.replace("t.csv", "t.x"), sources={"t.x": frame}))} == {'"foo\nbar"'}


def test_shared_scan(spark, sf):
    """Rules of a parsed source share one scan and one exchange, and give the same as each by itself."""
    text = "\n".join(json.dumps({"rows": [{"id": i % 7, "a": f"v{i % 3}", "b": i, "c": "NULL" if i % 2 else None, "d": {"e": [i % 2, 2]}} for i in range(k, k + 20)]}) for k in range(0, 100, 20))
    docs = spark.createDataFrame([(x,) for x in text.split("\n")], "doc string")
    m = PREFIX + tmap("t", "t.json", template("http://e/{id}"), ref("a", "a"), ref("b", "b"), ref("c", "c"), ref("d", "d"), ref("e", "d.e[0]"), f'rml:predicateMap [ {template("http://p/{a}")} ] ; rml:objectMap [ rml:reference "b" ] ; rml:graph ex:g', iterator="$.rows[*]")
    made = materialize(spark, m, sources={"t.json": docs})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("Aggregate") == 1
    apart = materialize(spark, m, sources={"t.json": docs}, dedup=False).distinct()
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str) and made.count() > 100


def test_function_inputs(spark):
    register_function("http://ex.org/joined", lambda v: F.concat_ws("-", v["http://ex.org/a"], F.upper(v["http://ex.org/b"])))
    call = 'rml:predicate ex:p ; rml:objectMap [ rml:functionExecution [ rml:function ex:joined ; rml:input [ rml:parameter ex:a ; rml:inputValueMap [ rml:reference "id" ] ], [ rml:parameter ex:b ; rml:inputValue "z" ] ] ]'
    m = PREFIX + tmap("t", "t.x", template("http://e/{id}"), call)
    src = {"t.x": spark.createDataFrame([("1",), ("2",), ("",)], "id string")}
    want = {("<http://e/1>", "<http://ex.org/p>", '"1-Z"'), ("<http://e/2>", "<http://ex.org/p>", '"2-Z"')}
    assert set(triples(materialize(spark, m, sources=src))) == want == set(triples(execute_plan(spark, make_plan(m).to_json(), sources=src)))
    for bad in ("rml:input [ rml:parameter ex:a ]", "rml:input [ rml:inputValue 1 ]"):
        with pytest.raises(MappingError):
            make_plan(PREFIX + tmap("t", "t.x", template("http://e/{id}"), f"rml:predicate ex:p ; rml:objectMap [ rml:functionExecution [ rml:function ex:joined ; {bad} ] ]"))


INVALID = {
    "two subjects": "<http://x/t> a rml:TriplesMap ; rml:logicalSource [ rml:source [ rml:path \"t\" ] ] ; rml:subjectMap [ rml:reference \"a\" ], [ rml:reference \"b\" ] .",
    "no map": "<http://x/t> rml:subject <http://x/s> .",
    "graph literal": tmap("t", "t", template("http://e/{a}") + ' ; rml:graphMap [ rml:template "{a}" ; rml:termType rml:Literal ]', ref("x", "a")),
    "constant type": tmap("t", "t", "rml:constant ex:a ; rml:termType rml:IRI", ref("x", "a")),
    "literal subject": tmap("t", "t", 'rml:reference "a" ; rml:termType rml:Literal', ref("x", "a")),
    "unknown function": tmap("t", "t", template("http://e/{a}"), "rml:predicate ex:p ; rml:objectMap [ rml:functionExecution [ rml:function ex:f ] ]"),
    "no function": tmap("t", "t", template("http://e/{a}"), "rml:predicate ex:p ; rml:objectMap [ rml:functionExecution [ ] ]"),
    "language": tmap("t", "t", template("http://e/{a}"), ref("x", "a", ' ; rml:language "not a tag"')),
    "other source": tmap("t", "t", template("http://e/{a}"), "rml:predicate ex:p ; rml:objectMap [ rml:parentTriplesMap <http://ex.org/map/u> ]") + tmap("u", "u", template("http://e/{a}")),
}


@pytest.mark.parametrize("name", INVALID)
def test_invalid_mappings(name):
    with pytest.raises(MappingError):
        make_plan(PREFIX + INVALID[name])


def frame(spark):
    return spark.createDataFrame([("1", "http://a/b", "x"), ("2", "http://a/b c", 'q"\\\n'), ("3", "urn:x", "NULL")], "id string, u string, `t.x` string")


def test_terms(spark):
    src = {"t": frame(spark)}
    iri = PREFIX + tmap("t", "t.d", template("http://e/{id}"), ref("u", "u", " ; rml:termType rml:IRI"))
    src = {"t.d": frame(spark)}
    skipped = triples(materialize(spark, iri, sources=src, on_error="skip"))
    assert [o for _, _, o in skipped] == ["<http://a/b>", "<http://example.com/base/urn:x>"]
    with pytest.raises(Exception, match="invalid IRI"):
        materialize(spark, iri, sources=src).count()
    rel = triples(materialize(spark, PREFIX + tmap("t", "t.d", template("{u}"), ref("i", "id")), sources=src, base_iri="http://b/"))
    assert ("<http://b/http%3A%2F%2Fa%2Fb>", "<http://ex.org/i>", '"1"') in rel
    both = PREFIX + tmap("t", "t.d", template("http://e/{id}"), ref("v", "t.x", ' ; rml:language "en" ; rml:datatype ex:d'))
    got = triples(materialize(spark, both, sources=src))
    assert [o for _, _, o in got][0] == '"x"^^<http://ex.org/d>' and len(got) == 2
    blank = triples(materialize(spark, PREFIX + tmap("t", "t.d", 'rml:template "///" ; rml:termType rml:BlankNode', ref("i", "id")), sources=src))
    assert all(s.startswith("_:bnode") for s, _, _ in blank) and len({s for s, _, _ in blank}) == 1


def test_sinks(spark, tmp_path, capsys):
    m = PREFIX + tmap("t", "t.d", template("http://e/{id}") + " ; rml:graph ex:g, rml:defaultGraph", ref("v", "t.x"))
    quads = materialize(spark, m, sources={"t.d": frame(spark)})
    text = to_string(quads)
    assert '<http://e/2> <http://ex.org/v> "q\\"\\\\" .' in text.replace("\\n", "") or '"q\\"\\\\' in text
    assert '<http://e/1> <http://ex.org/v> "x" <http://ex.org/g> .' in text and '<http://e/1> <http://ex.org/v> "x" .' in text
    write_lines(quads, str(tmp_path / "o"), single_file=True)
    write_lines(quads, str(tmp_path / "o"), single_file=True)
    assert sorted(spark.read.text(str(tmp_path / "o")).toPandas().value) == sorted(lines(quads).toPandas().line)
    out = io.StringIO()
    assert print_lines(quads, out) == quads.count() == 4 and out.getvalue().count("\n") == 4


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "p.csv").write_text("id,name\n1,x\n2,y\n")
    m = PREFIX + tmap("p", str(tmp_path / "p.csv"), template("http://e/{id}"), ref("name", "name"))
    (tmp_path / "m.ttl").write_text(m)
    assert main(["-m", str(tmp_path / "m.ttl"), "-gp"]) == 0
    plan = capsys.readouterr().out
    assert json.loads(plan)["groups"]
    assert main(["-p", plan]) == 0 and capsys.readouterr().out.count(" .\n") == 2
    assert main(["-m", str(tmp_path / "m.ttl"), "-o", str(tmp_path / "out"), "-v", "--no-threading", "--no-const-folding", "--no-ordering", "--continue-on-error"]) == 0
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert main(["-m", "<a> <b> ."]) == 1
    assert execute(m) == execute(plan=execute(m, generate_plan=True)) and execute(m).count("\n") == 2
    with pytest.raises(MappingError):
        execute()


def test_groups(spark, sf):
    def groups(*maps):
        return len(Plan.of(make_plan(PREFIX + "".join(maps)).rules(), "http://example.com/base/").groups)

    one = tmap("a", "nation", template("http://e/{n_nationkey}"), ref("p", "n_name"))
    assert groups(one, tmap("b", "region", template("http://e/x{r_regionkey}"), ref("p", "r_name"))) == 1
    assert groups(tmap("a", "nation", template("http://e/a/{n_name}"), ref("p", "n_name")), tmap("b", "region", template("http://e/b/{r_name}"), ref("p", "r_name"))) == 2
    assert groups(tmap("a", "nation", template("p/{n_name}"), ref("p", "n_name")), tmap("b", "region", template("http://example.com/base/p/{r_name}"), ref("p", "r_name"))) == 1
    assert groups(one, tmap("c", "nation", template("http://e/{n_nationkey}"), ref("p", "n_name", ' ; rml:language "en"'))) == 2
    plan = make_plan(PREFIX + catalogue.ORDERS)
    assert Plan.from_json(plan.to_json()) == plan
    whole = execute_plan(spark, plan, base_dir=sf)
    plain = execute_plan(spark, plan, base_dir=sf, dedup=False).distinct()
    assert whole.exceptAll(plain).count() == 0 and plain.count() == whole.count()
    with pytest.raises(MappingError):
        Plan.from_json("{}")


def test_pruning_and_no_python(spark, sf):
    text = materialize(spark, PREFIX + catalogue.LINEITEM, base_dir=sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "ReadSchema" in text and "l_comment" not in text
    assert all("l_discount" not in part for part in text.split("ReadSchema")[1:])


def test_functions(spark):
    from pyspark.sql import functions as F

    register_function("http://ex.org/answer", lambda: F.lit("42"))
    m = PREFIX + tmap("t", "t.d", template("http://e/{id}"), "rml:predicate ex:p ; rml:objectMap [ rml:functionExecution [ rml:function ex:answer ] ]")
    assert {o for _, _, o in triples(materialize(spark, m, sources={"t.d": frame(spark)}))} == {'"42"'}


def test_stream(spark, tmp_path):
    from graphloom.streaming import materialize_stream

    frame(spark).write.parquet(str(tmp_path / "in"))
    m = PREFIX + tmap("t", "t.d", template("http://e/{id}"), ref("v", "t.x"))
    stream = spark.readStream.schema(frame(spark).schema).parquet(str(tmp_path / "in"))
    for watermark, name in ((None, "plain"), ("1 hour", "once")):
        q = materialize_stream(spark, m, {"t.d": stream}, watermark=watermark).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == 2
