"""Values as text of the query language."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from ..errors import QueryError
from .lexer import tokenize


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def literal(value: object) -> str:
    """A Python value as an expression: null, truth values, numbers (NaN and the infinities by toFloat), texts, dates,
    times, lists and maps; anything else is an error."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return repr(value) if math.isfinite(value) else f"toFloat({quote('NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity')})"
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, dt.datetime):
        return f"timestamp({quote(value.isoformat(' '))})"
    if isinstance(value, dt.date):
        return f"date({quote(value.isoformat())})"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"`{k}`: {literal(v)}" for k, v in value.items()) + "}"
    raise QueryError(f"no literal for {type(value).__name__}")


def bind_text(text: str, params: dict) -> str:
    """A statement with its parameters written out; what stands inside texts is left alone."""
    out, at = [], 0
    for t in tokenize(text):
        if t.kind == "param":
            if t.value not in params:
                raise QueryError(f"no parameter ${t.value}")
            out += [text[at : t.at], literal(params[str(t.value)])]
            at = t.at + len(t.text)
    return "".join(out) + text[at:]
