"""Turtle text to rules: validation, shortcuts, classes, cross products, graphs, joins."""

from __future__ import annotations

import re
from collections import defaultdict

from ..functions.registry import known_function
from ..rdf.turtle import RDF, BNode, IRI, Literal, Term, read_turtle
from .model import LogicalSource, MappingError, Rule, TermMap, UnsupportedMapping
from .template import parse_template

NS = "http://w3id.org/rml/"
TYPE = IRI(RDF + "type")
_TERM_TYPES = {"IRI": "iri", "BlankNode": "bnode", "Literal": "literal", "URI": "iri"}
_LANG = re.compile(r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*")


def rml(name: str) -> IRI:
    return IRI(NS + name)


class MappingGraph:
    """Triples by subject and predicate."""

    def __init__(self, triples: list[tuple[Term, Term, Term]]):
        self.by: dict[tuple[Term, Term], list[Term]] = defaultdict(list)
        for s, p, o in triples:
            if o not in self.by[s, p]:
                self.by[s, p].append(o)
        self.triples = triples

    def all(self, s: Term, name: str) -> list[Term]:
        return self.by.get((s, rml(name)), [])

    def one(self, s: Term, name: str, what: str) -> Term | None:
        found = self.all(s, name)
        if len(found) > 1:
            raise MappingError(f"{what} has {len(found)} values of {name}")
        return found[0] if found else None


def _text(term: Term, what: str) -> str:
    if isinstance(term, Literal):
        return term.text
    if isinstance(term, IRI):
        return term.value
    raise MappingError(f"{what} must be a literal or an IRI")


def _constant(term: Term) -> TermMap:
    if isinstance(term, IRI):
        return TermMap("constant", term.value, "iri")
    if isinstance(term, BNode):
        return TermMap("constant", term.label, "bnode")
    return TermMap("constant", term.text, "literal", term.lang, term.datatype)


class Builder:
    def __init__(self, text: str, base: str | None = None):
        triples, self.base = read_turtle(text, base)
        self.graph = MappingGraph(triples)

    def rules(self) -> list[Rule]:
        maps = sorted({s for s, p, o in self.graph.triples if p == TYPE and o == rml("TriplesMap")}, key=str)
        if not maps:
            raise MappingError("the mapping has no TriplesMap (its rdf:type must be stated)")
        for s in maps:
            self.subject_node(s)
        out: list[Rule] = []
        for s in maps:
            for rule in self.of_triples_map(s):
                if rule not in out:
                    out.append(rule)
        return out

    def source(self, tm: Term) -> LogicalSource:
        g = self.graph
        ls = g.one(tm, "logicalSource", str(tm))
        if ls is None:
            raise MappingError(f"{tm} has no logicalSource")
        src = g.one(ls, "source", "a logicalSource")
        path = None
        if src is not None:
            path = g.one(src, "path", "a source") if not isinstance(src, Literal) else src
        if path is None:
            raise MappingError(f"the logicalSource of {tm} has no source with a path")
        iterator = g.one(ls, "iterator", "a logicalSource")
        return LogicalSource(_text(path, "a path"), _text(iterator, "an iterator") if iterator else None)

    def subject_node(self, tm: Term) -> tuple[Term, bool]:
        """The subject map's node, and whether it is a constant given by the shortcut."""
        full, short = self.graph.all(tm, "subjectMap"), self.graph.all(tm, "subject")
        if len(full) + len(short) > 1:
            raise MappingError(f"{tm} has more than one subject map")
        if not full and not short:
            raise MappingError(f"{tm} has no subject map")
        return (full or short)[0], bool(short)

    def subject(self, tm: Term) -> TermMap:
        node, short = self.subject_node(tm)
        out = _constant(node) if short else self.term_map(node, "subject")
        if out.term_type == "literal":
            raise MappingError(f"the subject of {tm} can't be a literal")
        return out

    def term_map(self, node: Term, position: str) -> TermMap:
        g = self.graph
        stated = g.one(node, "termType", f"a {position} map")
        kinds = [(k, v) for k in ("template", "reference", "constant", "functionExecution") for v in g.all(node, k)]
        if len(kinds) != 1:
            raise MappingError(f"a {position} map needs one of template, reference, constant or functionExecution, and has {len(kinds)}")
        kind, value = kinds[0]
        term_type = None
        if stated is not None:
            name = stated.value.removeprefix(NS) if isinstance(stated, IRI) else ""
            if name not in _TERM_TYPES:
                raise MappingError(f"unknown termType {stated}")
            term_type = _TERM_TYPES[name]
            if kind == "constant":
                raise MappingError("termType and constant don't go together")
            if position == "graph" and term_type != "iri":
                raise MappingError("the termType of a graph must be IRI")
            if position == "subject" and term_type == "literal":
                raise MappingError("the termType of a subject can't be Literal")
            if position == "predicate":
                term_type = "iri"  # whatever is stated
        lang = self.constant_of(node, "language", "languageMap")
        datatype = self.constant_of(node, "datatype", "datatypeMap")
        if lang is not None and not _LANG.fullmatch(lang):
            raise MappingError(f"language tag {lang!r} isn't well formed")
        if kind == "constant":
            out = _constant(value)
            if position == "object" and out.term_type == "literal":
                return TermMap("constant", out.value, "literal", lang or out.lang, datatype or out.datatype)
            return out
        if kind == "functionExecution":
            fn = g.one(value, "function", "a functionExecution")
            if fn is None:
                raise MappingError("a functionExecution has no function")
            iri = _text(fn, "a function")
            if not known_function(iri):
                raise UnsupportedMapping(f"unknown function {iri}")
            return TermMap("function", iri, term_type or "literal", lang, datatype, self.inputs(value))
        text = _text(value, f"a {kind}")
        if term_type is None:
            typed = lang is not None or datatype is not None
            term_type = "literal" if position == "object" and (kind == "reference" or typed) else "iri"
        if kind == "template":
            try:
                parse_template(text)
            except ValueError as e:
                raise MappingError(str(e)) from None
        return TermMap(kind, text, term_type, lang if term_type == "literal" else None, datatype if term_type == "literal" else None)

    def inputs(self, node: Term) -> tuple[tuple[str, TermMap], ...]:
        """A functionExecution's parameters, sorted, and the maps of their values."""
        g, out = self.graph, {}
        for i in g.all(node, "input"):
            name = g.one(i, "parameter", "an input") or next((g.one(m, "constant", "a parameterMap") for m in g.all(i, "parameterMap")), None)
            values = [_constant(v) for v in g.all(i, "inputValue")] + [self.term_map(m, "object") for m in g.all(i, "inputValueMap")]
            if name is None or len(values) != 1:
                raise MappingError("an input needs one parameter and one value")
            if out.setdefault(_text(name, "a parameter"), values[0]) is not values[0]:
                raise MappingError(f"parameter {name} is given twice")
        return tuple(sorted(out.items()))

    def constant_of(self, node: Term, short: str, full: str) -> str | None:
        """A language or datatype, which must be constant."""
        found = list(self.graph.all(node, short))
        for m in self.graph.all(node, full):
            value = self.graph.one(m, "constant", f"a {full}")
            if value is None:
                raise UnsupportedMapping(f"a {full} must be constant")
            found.append(value)
        if len(found) > 1:
            raise MappingError(f"more than one {short}")
        return _text(found[0], f"a {short}") if found else None

    def graphs(self, node: Term) -> list[TermMap | None]:
        """Graph maps of a subject map or predicate-object map; None stands for the default graph."""
        out: list[TermMap | None] = []
        for v in self.graph.all(node, "graph"):
            out.append(_constant(v))
        for m in self.graph.all(node, "graphMap"):
            out.append(self.term_map(m, "graph"))
        for g in out:
            if g.term_type == "literal":
                raise MappingError("a graph can't be a literal")
        return [None if g == TermMap("constant", NS + "defaultGraph", "iri") else g for g in out]

    def of_triples_map(self, tm: Term) -> list[Rule]:
        g = self.graph
        source, subject = self.source(tm), self.subject(tm)
        node, short = self.subject_node(tm)
        own = [] if short else self.graphs(node)
        out: list[Rule] = []

        def emit(predicate: TermMap, obj: TermMap, graphs: list[TermMap | None], parent=None, joins=()) -> None:
            for graph in dict.fromkeys(graphs) if graphs else [None]:
                out.append(Rule(source, subject, predicate, obj, graph, parent, joins))

        for c in [] if short else g.all(node, "class"):
            emit(TermMap("constant", RDF + "type", "iri"), _constant(c), own)
        for pom in g.all(tm, "predicateObjectMap"):
            graphs = own + self.graphs(pom)
            predicates = [_constant(p) for p in g.all(pom, "predicate")] + [self.term_map(p, "predicate") for p in g.all(pom, "predicateMap")]
            if not predicates:
                raise MappingError("a predicateObjectMap has no predicate")
            for p in predicates:
                if p.term_type != "iri":
                    raise MappingError("a predicate must be an IRI")
            objects = [(_constant(o), None, ()) for o in g.all(pom, "object")] + [self.object(o, source) for o in g.all(pom, "objectMap")]
            if not objects:
                raise MappingError("a predicateObjectMap has no object")
            for p in predicates:
                for o, parent, joins in objects:
                    emit(p, o, graphs, parent, joins)
        return out

    def object(self, node: Term, source: LogicalSource) -> tuple[TermMap, LogicalSource | None, tuple[tuple[str, str], ...]]:
        g = self.graph
        parent = g.one(node, "parentTriplesMap", "an object map")
        if parent is None:
            return self.term_map(node, "object"), None, ()
        other, term = self.source(parent), self.subject(parent)
        joins = []
        for j in g.all(node, "joinCondition"):
            sides = [g.one(j, n, "a join condition") or g.one(j, f"{n}Map", "a join condition") for n in ("child", "parent")]
            if None in sides:
                raise MappingError("a join condition needs a child and a parent")
            joins.append(tuple(_text(s, "a join condition") for s in sides))
        if joins:
            return term, other, tuple(joins)
        if other != source:
            raise UnsupportedMapping("a parentTriplesMap without a join condition needs the same logical source")
        return term, None, ()


def read_mapping(text: str, base: str | None = None) -> tuple[list[Rule], str | None]:
    """Rules of a mapping, and the base IRI that it states, if any."""
    b = Builder(text, base)
    return b.rules(), b.base
