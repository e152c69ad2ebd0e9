"""Templates: text with {references}; \\{ and \\} stand for the braces themselves."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Ref:
    name: str


_PART = re.compile(r"\\([{}\\])|\{((?:[^{}\\]|\\.)*)\}|([^{}\\]+|\\)", re.DOTALL)


def parse_template(text: str) -> list[str | Ref]:
    """Literal segments (unescaped) and references, in order; neighbouring literals are joined."""
    out: list[str | Ref] = []
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"unbalanced brace in template {text!r} at {at}")
        at = m.end()
        if m[2] is not None:
            if not m[2]:
                raise ValueError(f"empty reference in template {text!r}")
            out.append(Ref(re.sub(r"\\([{}\\])", r"\1", m[2])))
            continue
        piece = m[3] if m[3] is not None else (m[0] if m[1] == "\\" else m[1])
        if out and isinstance(out[-1], str):
            out[-1] += piece
        else:
            out.append(piece)
    return out
