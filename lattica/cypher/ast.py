"""Syntax trees of queries and statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: object
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # of (key, expression)


@dataclass(frozen=True)
class Case:
    of: object
    arms: tuple
    other: object


@dataclass(frozen=True)
class Sub:
    """A pattern asked about within an expression: whether it is there, or how often."""

    kind: str  # exists, count
    patterns: tuple
    where: object = None


@dataclass(frozen=True)
class NodePat:
    var: str
    labels: tuple = ()
    props: tuple = ()
    named: bool = True


@dataclass(frozen=True)
class RelPat:
    var: str
    types: tuple = ()
    props: tuple = ()
    way: str = "out"  # out, in, both
    low: int | None = None  # None: one hop
    high: int | None = None
    shortest: str = ""  # "", one, all
    named: bool = True


@dataclass(frozen=True)
class Pattern:
    nodes: tuple
    rels: tuple
    path: str = ""


@dataclass(frozen=True)
class Item:
    expr: object
    name: str
    star: bool = False


@dataclass(frozen=True)
class Projection:
    items: tuple
    distinct: bool = False
    order: tuple = ()  # of (expression, descending)
    skip: object = None
    limit: object = None
    where: object = None


@dataclass(frozen=True)
class Match:
    patterns: tuple
    where: object = None
    optional: bool = False


@dataclass(frozen=True)
class With:
    body: Projection


@dataclass(frozen=True)
class Return:
    body: Projection


@dataclass(frozen=True)
class Unwind:
    expr: object
    name: str


@dataclass(frozen=True)
class CallProc:
    name: str
    args: tuple
    outputs: tuple = ()  # of (column, name)


@dataclass(frozen=True)
class Create:
    patterns: tuple


@dataclass(frozen=True)
class Merge:
    pattern: Pattern
    on_create: tuple = ()
    on_match: tuple = ()


@dataclass(frozen=True)
class SetProps:
    items: tuple  # of (variable, property or "" for a map, expression)


@dataclass(frozen=True)
class Remove:
    items: tuple  # of (variable, property)


@dataclass(frozen=True)
class Delete:
    names: tuple
    detach: bool = False


@dataclass(frozen=True)
class Query:
    clauses: tuple
    union: object = None
    union_all: bool = False


@dataclass(frozen=True)
class NodeDDL:
    name: str
    columns: tuple
    key: str
    if_not_exists: bool = False


@dataclass(frozen=True)
class RelDDL:
    name: str
    src: str
    dst: str
    columns: tuple
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Alter:
    name: str
    action: str
    args: tuple


@dataclass(frozen=True)
class Copy:
    table: str
    path: str
    options: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Admin:
    action: str
    name: str = ""
    shards: int | None = None
