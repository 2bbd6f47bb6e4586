"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>0x[0-9a-fA-F]+|\d+)
    |(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<quoted>`[^`]+`)|(?P<param>\$[A-Za-z_]\w*|\$\d+)|(?P<name>[^\W\d]\w*)
    |(?P<op><>|<=|>=|=~|\.\.|<-|->|[-+*/%^=<>()\[\]{},.:;|!])""",
    re.S | re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: object
    at: int


def _unquote(raw: str) -> str:
    quote = raw[0]
    body = raw[1:-1].replace(quote * 2, "\\" + quote)
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            raise ParseError(f"unexpected {text[at:at + 10]!r} at {at}")
        kind, raw = m.lastgroup or "", m[0]
        if kind != "space":
            value: object = raw
            if kind == "int":
                value = int(raw, 0)
            elif kind == "float":
                value = float(raw)
            elif kind == "string":
                value = _unquote(raw)
            elif kind == "quoted":
                kind, value = "name", raw[1:-1]
            elif kind == "param":
                value = raw[1:]
            out.append(Token(kind, raw, value, at))
        at = m.end()
    out.append(Token("end", "", None, at))
    return out
