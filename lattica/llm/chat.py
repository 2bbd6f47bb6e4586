"""Chat formatting by a small template compiler.

A template is text with ``{{ expression }}`` and the tags ``for``/``endfor``, ``if``/``elif``/``else``/``endif``,
``set`` and ``generation``/``endgeneration``. ``parse`` makes a syntax tree of it, ``fold`` evaluates what is
constant, and ``compile_template`` turns the tree into Python closures: generators that yield ``(text, in_loss)``
pieces. Expressions can reach the fields of messages and the loop counters and nothing else: there are no calls, no
attributes of Python objects, and no names that the caller did not give.

Conversations are rendered as streams, one message at a time, so a conversation of any length needs the memory of its
longest turn. Control strings inside roles and texts are escaped reversibly; ``read_turns`` reads the turns back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

START, SEP, END, ESC = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "␛"
#: Strings with a meaning in common chat formats; none of them stands unescaped inside a role or a text.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join([ESC, *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_ESCAPED = re.compile(f"{ESC}({ESC})?")
DEFAULT_TEMPLATE = (
    "{% for m in messages %}" + START + "{{ m.role | escape }}" + SEP
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    + "{% else %}{{ m.text | escape }}{% endif %}" + END + "{{ '\\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not in the language, or asks for what the sandbox does not give."""


def escape(text: str) -> str:
    """An escape sign after the first character of each control string, and after each escape sign."""
    return _CONTROL.sub(lambda m: m[0] + ESC, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "", text)


# ---------------------------------------------------------------- syntax tree

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z]\w*)|(==|!=|<=|>=|[-+*/%~<>.|()\[\],]))", re.S)
_FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(), "length": lambda x: len(x), "default": lambda x, other="": other if x is None else x,
}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "-": lambda a, b: a - b,
    "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "~": lambda a, b: _text(a) + _text(b),
    "in": lambda a, b: a in b,
}
_LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*", "/", "%"))


def _text(x: object) -> str:
    return "" if x is None else str(x)


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s[1:-1], flags=re.S)


class _Expr:
    """Recursive descent over one expression; trees are tuples headed by their kind."""

    def __init__(self, source: str):
        self.toks: list[tuple[str, object]] = []
        at = 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            at = m.end()
            num, string, name, op = m.groups()
            self.toks.append(("const", float(num) if "." in num else int(num)) if num else ("const", _unquote(string)) if string else ("name", name) if name else ("op", op))
        self.i = 0

    def peek(self) -> tuple[str, object]:
        return self.toks[self.i] if self.i < len(self.toks) else ("end", None)

    def take(self, *what: str) -> object:
        kind, value = self.peek()
        if kind in ("op", "name") and value in what:
            self.i += 1
            return value
        return None

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"{what} expected, not {self.peek()[1]!r}")

    def whole(self) -> tuple:
        out = self.ternary()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def ternary(self) -> tuple:
        out = self.either()
        if self.take("if"):
            cond = self.either()
            other = self.ternary() if self.take("else") else ("const", None)
            return ("choose", cond, out, other)
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.postfix()
        out = self.binary(level + 1)
        while op := self.take(*_LEVELS[level]):
            out = ("binary", op, out, self.binary(level + 1))
        return out

    def postfix(self) -> tuple:
        kind, value = self.peek()
        self.i += 1
        if kind == "const":
            out: tuple = ("const", value)
        elif kind == "name":
            out = ("const", {"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else ("name", value)
        elif (kind, value) == ("op", "("):
            out = self.ternary()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "[", "|"):
            if op == "|":
                kind, name = self.peek()
                self.i += 1
                if kind != "name" or name not in _FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                args = []
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.ternary())
                        self.take(",")
                out = ("filter", name, out, *args)
            elif op == ".":
                kind, name = self.peek()
                self.i += 1
                if kind != "name":
                    raise TemplateError("a field name expected")
                out = ("field", out, ("const", name))
            else:
                out = ("field", out, self.ternary())
                self.need("]")
        return out


def parse(source: str) -> tuple:
    """The syntax tree: ("block", nodes...) of text, print, for, if, set and generation nodes."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if m[1] or m[4] else text))
        if m[2] is not None or m[5] is not None:
            parts.append(("print", m[2].strip()) if m[2] is not None else ("tag", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6])
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    i = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal i
        nodes: list[tuple] = []
        while i < len(parts):
            kind, value = parts[i]
            i += 1
            if kind == "text":
                if value:
                    nodes.append(("text", value))
            elif kind == "print":
                nodes.append(("print", _Expr(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return ("block", *nodes), value
                if word == "for":
                    if not (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                        raise TemplateError(f"for: {rest!r}")
                    nodes.append(("for", m[1], _Expr(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    arms, cond = [], _Expr(rest).whole()
                    while True:
                        body, end = block("elif", "else", "endif")
                        arms.append((cond, body))
                        if end == "endif":
                            break
                        cond = ("const", True) if end == "else" else _Expr(end[4:]).whole()
                    nodes.append(("if", *arms))
                elif word == "set":
                    name, _, expr = rest.partition("=")
                    if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                        raise TemplateError(f"set: {rest!r}")
                    nodes.append(("set", name.strip(), _Expr(expr).whole()))
                elif word == "generation":
                    nodes.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown or misplaced tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return ("block", *nodes), ""

    return block()[0]


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, constant branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for x in map(fold, node[1:]):
            for y in x[1:] if x[0] == "block" else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                else:
                    out.append(y)
        return ("block", *out)
    if kind == "print":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "const" else ("print", inner)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        arms = []
        for cond, body in node[1:]:
            cond = fold(cond)
            if cond[0] == "const" and not cond[1]:
                continue
            arms.append((cond, fold(body)))
            if cond[0] == "const":
                break
        return arms[0][1] if arms and arms[0][0][0] == "const" else ("if", *arms) if arms else ("block",)
    parts = [fold(x) if isinstance(x, tuple) else x for x in node[1:]]
    if kind == "choose" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind != "field" and all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _closure((kind, *parts))({}))
    return (kind, *parts)


# ---------------------------------------------------------------- closures


def _field(x: object, name: object) -> object:
    if isinstance(x, dict):
        return x.get(name)
    if isinstance(x, (list, tuple)) and isinstance(name, int):
        return x[name] if -len(x) <= name < len(x) else None
    if x is None:
        return None
    raise TemplateError(f"no field {name!r} of a {type(x).__name__}")


def _closure(node: tuple) -> Callable[[dict], object]:
    kind, *a = node
    if kind == "const":
        return lambda env, v=a[0]: v
    if kind == "name":
        return lambda env, v=a[0]: env.get(v)
    if kind == "field":
        x, name = _closure(a[0]), _closure(a[1])
        return lambda env: _field(x(env), name(env))
    if kind == "filter":
        f, x, rest = _FILTERS[a[0]], _closure(a[1]), [_closure(y) for y in a[2:]]
        return lambda env: f(x(env), *(y(env) for y in rest))
    if kind == "binary":
        f, x, y = _BINARY[a[0]], _closure(a[1]), _closure(a[2])
        return lambda env: f(x(env), y(env))
    fs = [_closure(x) for x in a]
    if kind == "and":
        return lambda env: fs[0](env) and fs[1](env)
    if kind == "or":
        return lambda env: fs[0](env) or fs[1](env)
    if kind == "not":
        return lambda env: not fs[0](env)
    return lambda env: fs[1](env) if fs[0](env) else fs[2](env)


def _emitter(node: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    kind, *a = node
    if kind == "text":

        def emit(env, loss, v=a[0]):
            yield v, loss
    elif kind == "print":
        f = _closure(a[0])

        def emit(env, loss):
            yield _text(f(env)), loss
    elif kind == "set":
        f = _closure(a[1])

        def emit(env, loss):
            env[a[0]] = f(env)
            return
            yield
    elif kind == "generation":
        body = _emitter(a[0])

        def emit(env, loss):
            yield from body(env, True)
    elif kind == "if":
        arms = [(_closure(c), _emitter(b)) for c, b in a]

        def emit(env, loss):
            for cond, body in arms:
                if cond(env):
                    yield from body(env, loss)
                    return
    elif kind == "for":
        name, items, body = a[0], _closure(a[1]), _emitter(a[2])

        def emit(env, loss):
            it = iter(items(env) or ())
            done = object()
            item, k, before = next(it, done), 0, None
            while item is not done:
                after = next(it, done)
                inner = env | {name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is done, "previtem": before}}
                yield from body(inner, loss)
                before, item, k = item, after, k + 1
    else:
        nodes = [_emitter(x) for x in a]

        def emit(env, loss):
            for x in nodes:
                yield from x(env, loss)
    return emit


def compile_template(source: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (any iterable of dicts) to the pieces of the formatted conversation."""
    body = _emitter(fold(parse(source)))
    return lambda messages, **extra: body(extra | {"messages": messages}, False)


# ---------------------------------------------------------------- over tables

_CHUNK = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])
_CHUNK_SQL = "conv_id long, chunk long, text string, loss_start array<long>, loss_end array<long>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 1 + weight(row)
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(turns: DataFrame, template: str = DEFAULT_TEMPLATE, chunk_chars: int = 1 << 16) -> DataFrame:
    """Format conversations given as rows by turn (conv_id, turn, role, text).

    Returns the formatted text as consecutive chunks: conv_id, chunk (from 0), text, and the loss spans inside the
    chunk as loss_start, loss_end (code points from the start of the conversation). Rows of one conversation stay in
    one partition, in order. Null roles and texts are empty; a null conv_id is a conversation of its own; turns that
    tie or repeat are all kept, in the order of role and text. Other columns are ignored.
    """
    prepare(turns.sparkSession)
    compile_template(template)

    def run(batches):
        render = compile_template(template)

        def chunks():
            for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
                at = [0]  # messages begun so far

                def messages(rows=rows, at=at):
                    for _, _, role, text in rows:
                        at[0] += 1
                        yield {"role": role or "", "text": text or ""}

                text, starts, ends, held, pos, k, seen = [], [], [], 0, 0, 0, 0
                for piece, loss in render(messages()):
                    if at[0] != seen and held >= chunk_chars:
                        yield conv, k, "".join(text), starts, ends
                        text, starts, ends, held, k = [], [], [], 0, k + 1
                    seen = at[0]
                    if loss and piece:
                        starts.append(pos)
                        ends.append(pos + len(piece))
                    text.append(piece)
                    held, pos = held + len(piece), pos + len(piece)
                yield conv, k, "".join(text), starts, ends

        yield from _batches(chunks(), _CHUNK, 1 << 20, lambda r: len(r[2]))

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, _CHUNK_SQL)


def read_turns(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn in text that DEFAULT_TEMPLATE formatted; memory for one chunk and one turn."""
    held = ""
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(END + "\n", at)) >= 0:
            if not held.startswith(START, at) or (sep := held.find(SEP, at)) < 0 or sep > end:
                raise ValueError("not a formatted turn")
            yield unescape(held[at + len(START) : sep]), unescape(held[sep + len(SEP) : end])
            at = end + len(END) + 1
        held = held[at:]
    if held:
        raise ValueError("an open turn")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation, read back from format_conversations' chunks: turns and their digest, and the loss text's."""

    def run(batches):
        def found():
            for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
                loss, loss_chars, size, turns, n = hashlib.sha256(), 0, 0, hashlib.sha256(), 0

                def texts(rows=rows):
                    nonlocal loss_chars, size
                    for _, _, text, starts, ends in rows:
                        for a, b in zip(starts, ends):
                            plain = unescape(text[a - size : b - size])
                            loss.update(plain.encode())
                            loss_chars += len(plain)
                        size += len(text)
                        yield text

                for role, text in read_turns(texts()):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size

        yield from _batches(found(), _DIGEST, 5000, lambda r: 0)

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the made-up conversation -7, formatted by DEFAULT_TEMPLATE and read back."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(told.unionByName(extra)))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '␛|<(?:\\|im_start\\|>|\\|im_sep\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|system\\|>|\\|user\\|>|\\|assistant\\|>|s>|/s>|<SYS>>|</SYS>>)|\\[(?:INST\\]|/INST\\])', '\\0#', 'g') AS marked FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(marked) + 33) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
