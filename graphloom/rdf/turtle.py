"""A strict Turtle reader: text to a list of triples of typed terms."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Literal:
    text: str
    lang: str | None = None
    datatype: str | None = None


Term = IRI | BNode | Literal


class TurtleError(ValueError):
    """Text that isn't Turtle."""


_NAME = r"(?:[\w\-.:%·]|\\[_~.\-!$&'()*+,;=/?#@%])*"
_TOKEN = re.compile(
    r"""(?P<skip>[\s]+|\#[^\n\r]*)
  | (?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<dt>\^\^)
  | (?P<double>[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+)
  | (?P<decimal>[+-]?\d*\.\d+)
  | (?P<integer>[+-]?\d+)
  | (?P<bnode>_:[\w](?:[\w\-.·]*[\w\-·])?)
  | (?P<pname>[^\W\d_]?[\w\-.]*:""" + _NAME + r""")
  | (?P<word>[A-Za-z]+)
  | (?P<punct>[;,.\[\]()])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_CHAR = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if code := m[1] or m[2]:
            return chr(int(code, 16))
        if m[3] not in _CHAR:
            raise TurtleError(f"unknown escape \\{m[3]}")
        return _CHAR[m[3]]

    return _ESCAPE.sub(one, text)


class _Reader:
    def __init__(self, text: str, base: str | None):
        self.base, self.prefixes, self.triples = base, {}, []
        self.labels: dict[str, BNode] = {}
        self.fresh = 0
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at : at + 20]!r}")
            kind, value = m.lastgroup, m[0]
            if kind == "pname" and value.endswith(".") and not value.endswith("\\."):  # a final dot ends the statement
                value = value.rstrip(".")
                m_end = at + len(value)
            else:
                m_end = m.end()
            if kind != "skip":
                self.tokens.append((kind, value, at))
            at = m_end
        self.text, self.at = text, 0

    def error(self, what: str) -> TurtleError:
        where = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
        return TurtleError(f"line {self.text.count(chr(10), 0, where) + 1}: {what}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def expect(self, mark: str) -> None:
        if self.peek() != ("punct", mark):
            raise self.error(f"expected {mark!r}, found {self.peek()[1]!r}")
        self.at += 1

    def blank(self) -> BNode:
        self.fresh += 1
        return BNode(f"n{self.fresh}")

    def resolve(self, token: str) -> IRI:
        iri = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), token[1:-1])
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) or self.base is None:
            return IRI(iri)
        full = urljoin(self.base, iri) if iri else self.base
        return IRI(full + "#" if iri.endswith("#") and not full.endswith("#") else full)  # urljoin drops an empty fragment

    def expand(self, token: str) -> IRI:
        prefix, _, name = token.partition(":")
        if prefix not in self.prefixes:
            raise self.error(f"unknown prefix {prefix!r}")
        return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name))

    def document(self) -> list[tuple[Term, Term, Term]]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if kind == "lang" and value in ("@prefix", "@base") or kind == "word" and value.upper() in ("PREFIX", "BASE"):
                self.directive(value)
            else:
                self.statement()
        return self.triples

    def directive(self, word: str) -> None:
        self.next()
        if word.strip("@").lower() == "prefix":
            kind, name = self.next()
            if kind != "pname" or not name.endswith(":"):
                raise self.error("a prefix needs a name and a colon")
            if self.peek()[0] != "iri":
                raise self.error("a prefix needs an IRI")
            self.prefixes[name[:-1]] = self.resolve(self.next()[1]).value
        else:
            if self.peek()[0] != "iri":
                raise self.error("a base needs an IRI")
            self.base = self.resolve(self.next()[1]).value
        if word.startswith("@"):
            self.expect(".")

    def statement(self) -> None:
        bracket = self.peek() == ("punct", "[")
        subject = self.node()
        if not (bracket and self.peek() == ("punct", ".")):
            self.properties(subject)
        self.expect(".")

    def properties(self, subject: Term) -> None:
        while True:
            kind, value = self.peek()
            if (kind, value) == ("word", "a"):
                self.next()
                predicate: Term = IRI(RDF + "type")
            elif kind in ("iri", "pname"):
                predicate = self.node()
            else:
                raise self.error(f"expected a predicate, found {value!r}")
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.peek() != ("punct", ","):
                    break
                self.next()
            if self.peek() != ("punct", ";"):
                return
            while self.peek() == ("punct", ";"):
                self.next()
            if self.peek() in (("punct", "."), ("punct", "]")):
                return

    def node(self) -> Term:
        kind, value = self.next()
        if kind == "iri":
            return self.resolve(value)
        if kind == "pname":
            return self.expand(value)
        if kind == "bnode":
            return self.labels.setdefault(value, BNode(f"l{len(self.labels)}"))
        if kind in ("long", "short"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            follow, tag = self.peek()
            if follow == "lang":
                self.next()
                return Literal(text, lang=tag[1:])
            if follow == "dt":
                self.next()
                dt = self.node()
                if not isinstance(dt, IRI):
                    raise self.error("a datatype must be an IRI")
                return Literal(text, datatype=dt.value)
            return Literal(text)
        if kind in ("integer", "decimal", "double"):
            return Literal(value, datatype=XSD + kind)
        if kind == "word" and value in ("true", "false"):
            return Literal(value, datatype=XSD + "boolean")
        if (kind, value) == ("punct", "["):
            node = self.blank()
            if self.peek() != ("punct", "]"):
                self.properties(node)
            self.expect("]")
            return node
        if (kind, value) == ("punct", "("):
            items = []
            while self.peek() != ("punct", ")"):
                if self.peek()[0] == "end":
                    raise self.error("a list isn't closed")
                items.append(self.node())
            self.next()
            head: Term = IRI(RDF + "nil")
            for item in reversed(items):
                node = self.blank()
                self.triples += [(node, IRI(RDF + "first"), item), (node, IRI(RDF + "rest"), head)]
                head = node
            return head
        self.at -= 1
        raise self.error(f"expected a term, found {value or 'the end'!r}")


def read_turtle(text: str, base: str | None = None) -> tuple[list[tuple[Term, Term, Term]], str | None]:
    """Triples, and the base IRI in force at the end (None if there is none)."""
    r = _Reader(text, base)
    return r.document(), r.base
