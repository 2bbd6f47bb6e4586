"""Expressions of the query language as Spark columns, in a scope of variables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cypher import ast as A
from ..errors import QueryError
from ..functions.scalars import AGGREGATES, SCALARS


def name_of(var: str, prop: str) -> str:
    return f"{var}·{prop}"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Bound:
    """What a variable stands for: a node or relationship with columns var·prop, a path, or the column var."""

    kind: str  # node, rel, path, hops, value
    props: dict = field(default_factory=dict)  # property -> column name
    key: str = ""  # of a node: the property that is its key
    label: str = ""
    columns: tuple = ()  # further columns: the label of a node of any label, a path's length and nodes
    endpoint_of: tuple = ()


class Scope:
    """Variables by name, and the parameters."""

    def __init__(self, params: dict):
        self.params, self.vars = params, {}
        self.types: dict[str, str] = {}  # Spark's name of the type of a column
        self.subs: dict = {}  # the column of each pattern that an expression asks about

    def copy(self) -> Scope:
        out = Scope(self.params)
        out.vars, out.types = dict(self.vars), dict(self.types)
        return out

    def note(self, df) -> None:
        """Remember the types of df's columns."""
        self.types.update(df.dtypes)

    def get(self, name: str) -> Bound:
        if name not in self.vars:
            raise QueryError(f"variable {name} is not in scope")
        return self.vars[name]


def literal(value: object) -> Column:
    """A Python value as a column: lists become arrays, dicts structs."""
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(str(k)) for k, v in value.items()])
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("long")
    return F.lit(value)


def is_aggregate(e: object) -> bool:
    return isinstance(e, A.Call) and e.name in AGGREGATES


def children(e: object) -> list:
    if isinstance(e, A.Prop):
        return [e.of]
    if isinstance(e, (A.Op, A.Call)):
        return list(e.args)
    if isinstance(e, A.ListOf):
        return list(e.items)
    if isinstance(e, A.MapOf):
        return [v for _, v in e.items]
    if isinstance(e, A.Case):
        return [x for x in [e.of, e.other, *(y for arm in e.arms for y in arm)] if x is not None]
    if isinstance(e, A.Sub):
        parts = [x for p in e.patterns for x in (*p.nodes, *p.rels)]
        own = [A.Var(n.var) for p in e.patterns for n in p.nodes]
        return [*own, *(v for x in parts for _, v in x.props), *([e.where] if e.where is not None else [])]
    return []


def subqueries(e: object) -> list:
    """The patterns that an expression asks about; not those inside them."""
    return [e] if isinstance(e, A.Sub) else [y for x in children(e) for y in subqueries(x)]


def bare(e: object) -> set[str]:
    """The variables that an expression reads whole, not by a property."""
    if isinstance(e, A.Var):
        return {e.name}
    return set() if isinstance(e, A.Prop) and isinstance(e.of, A.Var) else set().union(*map(bare, children(e)), set())


def read_props(e: object) -> set[tuple[str, str]]:
    """(variable, property) of all that an expression reads."""
    own = {(e.of.name, e.name)} if isinstance(e, A.Prop) and isinstance(e.of, A.Var) else set()
    return own.union(*map(read_props, children(e)))


def has_aggregate(e: object) -> bool:
    return is_aggregate(e) or any(map(has_aggregate, children(e)))


def mentions(e: object) -> set[str]:
    return {e.name} if isinstance(e, A.Var) else set().union(*map(mentions, children(e)), set())


def conjuncts(e: object) -> list:
    return [y for x in e.args for y in conjuncts(x)] if isinstance(e, A.Op) and e.name == "and" else [] if e is None else [e]


_BINARY = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "%": lambda a, b: a % b, "^": F.pow, "=~": F.rlike, "starts with": F.startswith, "ends with": F.endswith, "contains": F.contains,
}


_TEXT_CALLS = ("toupper", "tolower", "tostring", "upper", "lower", "trim", "ltrim", "rtrim", "substring", "left", "right", "replace", "reverse")
_WHOLE_CALLS = ("size", "length", "tointeger", "count")
_SPARK_KINDS = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "string": "text"}


def kind_of(e: object, scope: Scope) -> str:
    """'whole', 'text', 'list' or '': what is known of an expression's type before it is planned."""
    if isinstance(e, (A.Lit, A.Param)):
        v = e.value if isinstance(e, A.Lit) else scope.params.get(e.name)
        return "text" if isinstance(v, str) else "whole" if isinstance(v, int) and not isinstance(v, bool) else "list" if isinstance(v, (list, tuple)) else ""
    name = ""
    if isinstance(e, A.Prop) and isinstance(e.of, A.Var) and e.of.name in scope.vars:
        name = scope.get(e.of.name).props.get(e.name, "")
    elif isinstance(e, A.Var) and e.name in scope.vars and scope.get(e.name).kind == "value":
        name = e.name
    if name:
        kind = scope.types.get(name, "")
        return "list" if kind.startswith("array") else _SPARK_KINDS.get(kind, "")
    if isinstance(e, A.ListOf):
        return "list"
    if isinstance(e, A.Op):
        kinds = [kind_of(x, scope) for x in e.args]
        if e.name == "+" and "list" in kinds:
            return "list"
        if e.name == "+" and "text" in kinds:
            return "text"
        return "whole" if e.name in ("+", "-", "*", "%", "/", "neg") and set(kinds) == {"whole"} else ""
    if isinstance(e, A.Call):
        if e.name in _TEXT_CALLS:
            return "text"
        if e.name in ("sum", "min", "max", "abs") and e.args:
            return kind_of(e.args[0], scope)
        return "whole" if e.name in _WHOLE_CALLS else "list" if e.name in ("collect", "nodes", "rels", "relationships", "labels", "keys") else ""
    return ""


def _textual(e: object, scope: Scope) -> bool:
    return kind_of(e, scope) == "text"


def compile_expr(e: object, scope: Scope, done: dict | None = None) -> Column:
    """The column of an expression. done gives columns for whole subexpressions, such as computed aggregates."""
    if done and e in done:
        return done[e]
    go = lambda x: compile_expr(x, scope, done)
    if isinstance(e, A.Lit):
        return literal(e.value)
    if isinstance(e, A.Param):
        if e.name not in scope.params:
            raise QueryError(f"no parameter ${e.name}")
        return literal(scope.params[e.name])
    if isinstance(e, A.Var):
        return whole(e.name, scope.get(e.name))
    if isinstance(e, A.Prop):
        if isinstance(e.of, A.Var):
            b = scope.get(e.of.name)
            if b.kind in ("node", "rel"):
                if e.name in b.props:
                    return col(b.props[e.name])
                if b.label:
                    raise QueryError(f"{b.label} has no property {e.name}")
                return F.lit(None)
        return go(e.of).getField(e.name)
    if isinstance(e, A.ListOf):
        return F.array(*map(go, e.items))
    if isinstance(e, A.MapOf):
        return F.struct(*[go(v).alias(k) for k, v in e.items])
    if isinstance(e, A.Case):
        out = None
        for cond, value in e.arms:
            test = go(cond) if e.of is None else go(e.of) == go(cond)
            out = F.when(test, go(value)) if out is None else out.when(test, go(value))
        return out.otherwise(go(e.other))
    if isinstance(e, A.Op):
        if e.name in ("is null", "is not null"):
            c = identity(e.args[0], scope) if isinstance(e.args[0], A.Var) else go(e.args[0])
            return c.isNull() if e.name == "is null" else c.isNotNull()
        if e.name == "not":
            return ~go(e.args[0])
        if e.name == "neg":
            return -go(e.args[0])
        if e.name == "in":
            items = e.args[1].items if isinstance(e.args[1], A.ListOf) else [A.Lit(x) for x in scope.params[e.args[1].name]] if isinstance(e.args[1], A.Param) else None
            return F.array_contains(go(e.args[1]), go(e.args[0])) if items is None else go(e.args[0]).isin([go(x) for x in items]) if items else F.lit(False)
        if e.name == "index":
            at = go(e.args[1])
            return F.try_element_at(go(e.args[0]), F.when(at >= 0, at + 1).otherwise(at).cast("int"))
        if e.name in ("=", "<>") and all(isinstance(x, A.Var) and scope.get(x.name).kind in ("node", "rel") for x in e.args):
            a, b = (identity(x, scope) for x in e.args)
            return a == b if e.name == "=" else a != b
        a, b = go(e.args[0]), go(e.args[1])
        if e.name == "+":
            if any(isinstance(x, A.ListOf) for x in e.args):
                return F.concat(a, b)
            return F.concat(a.cast("string"), b.cast("string")) if any(_textual(x, scope) for x in e.args) else a + b
        if e.name == "/":
            # whole numbers divide towards zero
            return F.call_function("div", a, b) if all(kind_of(x, scope) == "whole" for x in e.args) else a / b
        return _BINARY[e.name](a, b)
    if isinstance(e, A.Call):
        return call(e, scope, go)
    if isinstance(e, A.Sub):
        if e not in scope.subs:
            raise QueryError("patterns stand in WHERE, WITH and RETURN only")
        return col(scope.subs[e])
    raise QueryError(f"cannot evaluate {e}")


def call(e: A.Call, scope: Scope, go) -> Column:
    if is_aggregate(e):
        return aggregate(e, scope, go)
    of = scope.vars.get(e.args[0].name) if e.args and isinstance(e.args[0], A.Var) else None
    if e.name in ("length", "size") and of is not None and of.kind in ("hops", "path"):
        return col(of.columns[0])
    if e.name in ("nodes", "relationships", "rels") and of is not None and of.kind in ("hops", "path"):
        return whole(e.args[0].name, of).getField("nodes" if e.name == "nodes" else "rels")
    if e.name == "id" and of is not None:
        return identity(e.args[0], scope)
    if e.name in ("label", "labels", "type") and of is not None:
        c = col(of.columns[0]) if of.columns else F.lit(of.label)
        return F.array(c) if e.name == "labels" else c
    if e.name in ("keys", "properties") and of is not None:
        return F.array(*[F.lit(p) for p in of.props]) if e.name == "keys" else F.struct(*[col(c).alias(p) for p, c in of.props.items()])
    if e.name in ("size", "length"):
        x = go(e.args[0])
        return F.length(x) if _textual(e.args[0], scope) or e.name == "length" else F.size(x)
    if e.name not in SCALARS:
        raise QueryError(f"no function {e.name}")
    return SCALARS[e.name](*map(go, e.args))


def aggregate(e: A.Call, scope: Scope, go) -> Column:
    if e.star or not e.args:
        return F.count(F.lit(1))
    x = identity(e.args[0], scope) if isinstance(e.args[0], A.Var) and e.name == "count" else go(e.args[0])
    if e.name == "count":
        return F.count_distinct(x) if e.distinct else F.count(x)
    if e.name == "collect":
        of = scope.vars.get(e.args[0].name) if isinstance(e.args[0], A.Var) else None
        if e.distinct and of is not None and of.kind == "rel":
            told = F.collect_set(F.when(x.isNotNull(), F.struct(x.alias("value"), *map(col, of.columns[1:]))))
            return F.transform(told, lambda s: s["value"])
        return F.collect_set(x) if e.distinct else F.collect_list(x)
    if e.name in ("stdev", "percentilecont") and e.distinct:
        raise QueryError(f"{e.name} takes no DISTINCT")
    if e.name == "stdev":
        return F.stddev(x)
    if e.name == "percentilecont":
        return F.percentile(x, go(e.args[1]))
    if e.name == "avg" and e.distinct:
        n = F.count_distinct(x)
        return F.when(n > 0, F.sum_distinct(x) / n)
    return {"sum": F.sum_distinct if e.distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name](x)


def identity(v: A.Var, scope: Scope) -> Column:
    """What tells a variable's values apart: the key of a node; the ends, the properties and, where it is asked for, the
    number among equal ones of a relationship."""
    b = scope.get(v.name)
    if b.kind == "node":
        key = col(b.props[b.key]) if b.key in b.props else col(name_of(v.name, "_key"))
        return F.when(key.isNotNull(), F.struct(col(b.columns[0]), key)) if b.columns else key
    if b.kind == "rel":
        return F.when(col(name_of(v.name, "_src")).isNotNull(), F.struct(*[col(name_of(v.name, p)) for p in ("_src", "_dst", "_type")], *[col(c) for c in b.columns[1:]], *[col(c) for c in b.props.values()]))
    return whole(v.name, b)


def whole(name: str, b: Bound) -> Column:
    """The value of a variable in a result: nodes and relationships are structs."""
    if b.kind == "node":
        key = col(b.props[b.key]) if b.key in b.props else col(name_of(name, "_key"))
        label = col(b.columns[0]) if b.columns else F.lit(b.label)
        return F.when(key.isNotNull(), F.struct(key.cast("string").alias("_id"), label.alias("_label"), *[col(c).alias(p) for p, c in b.props.items()]))
    if b.kind == "rel":
        ends = [col(name_of(name, p)).alias(p) for p in ("_src", "_dst", "_type")]
        return F.when(col(name_of(name, "_src")).isNotNull(), F.struct(*ends, *[col(c).alias(p) for p, c in b.props.items()]))
    if b.kind in ("hops", "path"):
        parts = [col(b.columns[0]).alias("length")]
        if len(b.columns) > 1:
            nodes = col(b.columns[1])
            pairs = F.transform(F.when(F.size(nodes) > 1, F.sequence(F.lit(0), F.size(nodes) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(nodes[i].alias("_src"), nodes[i + 1].alias("_dst")))
            parts += [nodes.alias("nodes"), pairs.alias("rels")]
        return F.struct(*parts)
    return col(name)
