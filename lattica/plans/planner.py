"""Queries as DataFrames: patterns become chains of equi-joins that start where the pattern is most selective.

Every property of a bound variable is a column; Catalyst prunes the ones that nothing reads and pushes filters into the
scans. What it cannot know is decided here: the anchor of a chain, the filters on edges before they are unrolled, and
whether a variable-length pattern may be walked as a set because only distinct ends are asked for.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import GraphCatalog, NodeTable
from ..cypher import ast as A
from ..errors import QueryError
from ..operators import paths
from ..operators.mutate import numbered
from .expressions import (
    Bound, Scope, aggregate, bare, children, col, compile_expr, conjuncts, has_aggregate, identity, is_aggregate, mentions, name_of, read_props, subqueries, whole,
)


def lists(e: object) -> set[str]:
    """The variables whose nodes or relationships an expression lists."""
    own = {e.args[0].name} if isinstance(e, A.Call) and e.name in ("nodes", "rels", "relationships") and e.args and isinstance(e.args[0], A.Var) else set()
    return own.union(*map(lists, children(e)))


def distinct_args(e: object) -> set[str]:
    """The variables that calls with DISTINCT, and comparisons of two variables, read whole."""
    own: set[str] = set()
    if isinstance(e, A.Call) and e.distinct:
        own = set().union(*map(bare, e.args))
    elif isinstance(e, A.Op) and e.name in ("=", "<>") and all(isinstance(x, A.Var) for x in e.args):
        own = {x.name for x in e.args}
    return own.union(*map(distinct_args, children(e)))


class Planner:
    """Plans the reading clauses of one query over a catalog."""

    def __init__(self, catalog: GraphCatalog, params: dict | None = None, mode: str = "walk"):
        self.catalog, self.spark, self.mode = catalog, catalog.spark, mode
        self.scope = Scope(dict(params or {}))
        self.df: DataFrame | None = None
        self.sets: set[str] = set()  # relationship variables that may be walked as sets
        self.asked: set[str] = set()  # variables that some expression reads as a whole
        self.listed: set[str] = set()  # variables whose nodes or relationships some expression lists
        self.copied: set[str] = set()  # relationships of which equal ones must be told apart
        self.changed: set[str] = set()  # those that a write changes
        self.columns: list[str] = []
        self.pushed: list = []  # conjuncts of WHERE, of the MATCH being planned

    # ------------------------------------------------------------ clauses

    def start(self) -> DataFrame:
        return self.df if self.df is not None else self.spark.range(1).select(F.lit(1).alias("_row"))

    def read(self, clauses: tuple) -> None:
        for i, c in enumerate(clauses):
            if isinstance(c, A.Match):
                self.look_ahead(clauses, i)
                self.match(c)
            elif isinstance(c, (A.With, A.Return)):
                self.project(c.body, isinstance(c, A.Return))
            elif isinstance(c, A.Unwind):
                value = compile_expr(c.expr, self.scope)
                self.df = self.start().withColumn(c.name, F.explode(value))
                self.scope.vars[c.name] = Bound("value")
                self.scope.note(self.df.select(col(c.name)))
            elif isinstance(c, A.CallProc):
                self.procedure(c)
            else:
                raise QueryError(f"{type(c).__name__} is not a reading clause")

    def look_ahead(self, clauses: tuple, i: int) -> None:
        """Which variables are read, and which variable-length relationships need no multiplicity: the projection after
        this MATCH is DISTINCT, or aggregates only what repeats do not change."""
        self.asked, self.listed, self.copied = set(), set(), set(self.changed)
        merging = lambda b: b.distinct or any(has_aggregate(x.expr) for x in b.items)
        for k, c in enumerate(clauses[i:], i):
            body = c.body if isinstance(c, (A.With, A.Return)) else None
            if body and (merging(body) or any(merging(x.body) for x in clauses[k + 1 :] if isinstance(x, (A.With, A.Return)))):
                self.copied |= set().union(*[bare(x.expr) for x in body.items if not has_aggregate(x.expr)])
            exprs = [c.where] if isinstance(c, A.Match) else [c.expr] if isinstance(c, A.Unwind) else []
            if body:
                exprs = [x.expr for x in body.items] + [x for x, _ in body.order] + [body.where]
                if any(x.star for x in body.items):
                    self.asked |= set(self.scope.vars) | {"*"}
            for e in exprs:
                if e is not None:
                    self.asked |= mentions(e)
                    self.listed |= lists(e)
                    self.copied |= distinct_args(e)
        self.sets = set()
        later = clauses[i + 1 :]
        if not later or not isinstance(later[0], (A.With, A.Return)) or self.mode == "trail":
            return
        body = later[0].body

        def calls(e):
            return [e] if is_aggregate(e) else [y for x in children(e) for y in calls(x)]

        found = [c for x in body.items if x.expr is not None for c in calls(x.expr)]
        if body.distinct and not found or found and all(c.distinct or c.name in ("min", "max") for c in found):
            for p in clauses[i].patterns:
                self.sets |= {r.var for r in p.rels if r.low is not None and r.var not in self.asked and p.path not in self.asked}

    def procedure(self, c: A.CallProc) -> None:
        args = [a.value if isinstance(a, A.Lit) else self.scope.params[a.name] if isinstance(a, A.Param) else None for a in c.args]
        name = c.name.lower()
        if name == "show_tables":
            out = self.catalog.show_tables()
        elif name == "table_info":
            out = self.catalog.table_info(str(args[0]))
        elif name == "db.labels":
            out = self.catalog.show_tables().where("type = 'NODE'").select(F.col("name").alias("label"))
        elif name == "db.relationshiptypes":
            out = self.catalog.show_tables().where("type = 'REL'").select(F.col("name").alias("relationshipType"))
        else:
            raise QueryError(f"no procedure {c.name}")
        named = c.outputs or tuple((x, x) for x in out.columns)
        out = out.select(*[col(a).alias(b) for a, b in named])
        self.df = out if self.df is None else self.df.crossJoin(out)
        for _, b in named:
            self.scope.vars[b] = Bound("value")

    # ------------------------------------------------------------ patterns

    def lifted(self, c: A.Match) -> A.Match:
        """Properties whose values read other variables become conditions of WHERE."""
        extra, patterns = [], []

        def lift(x):
            late = [(k, v) for k, v in x.props if mentions(v)] if isinstance(x, A.NodePat) or x.low is None else []
            extra.extend(A.Op("=", (A.Prop(A.Var(x.var), k), v)) for k, v in late)
            return replace(x, props=tuple(p for p in x.props if p not in late))

        for p in c.patterns:
            patterns.append(replace(p, nodes=tuple(map(lift, p.nodes)), rels=tuple(map(lift, p.rels))))
        if not extra:
            return c
        return replace(c, patterns=tuple(patterns), where=reduce(lambda a, b: A.Op("and", (a, b)), [*([c.where] if c.where is not None else []), *extra]))

    def match(self, c: A.Match) -> None:
        c = self.lifted(c)
        if c.optional and self.df is not None:
            return self.optional(c)
        self.pushed = [e for e in conjuncts(c.where) if not subqueries(e)]
        waiting = list(c.patterns)
        while waiting:  # first the patterns that hang on what is bound, then those with the best anchor
            bound = lambda p: any(n.var in self.scope.vars for n in p.nodes)
            p = max(waiting, key=lambda p: (bound(p), max(self.selectivity(n) for n in p.nodes)))
            waiting.remove(p)
            self.pattern(p)
        self.keep(c.where)
        self.pushed = []

    # ------------------------------------------------------------ patterns within expressions

    def keep(self, where: object) -> None:
        """Keep the rows of which a condition holds; a pattern that must be there is a semi join, one that must not an
        anti join, and any other use of patterns reads a column that a left join brings."""
        mixed = []
        for e in sorted(conjuncts(where), key=lambda e: bool(subqueries(e))):
            inner = e.args[0] if isinstance(e, A.Op) and e.name == "not" else e
            if not subqueries(e):
                self.df = self.df.where(compile_expr(e, self.scope))
            elif isinstance(inner, A.Sub) and inner.kind == "exists":
                got, met = self.found(inner)
                self.df = self.df.join(got, met, "left_semi" if inner is e else "left_anti")
            else:
                mixed.append(e)
        for e in mixed:
            before = self.df.columns
            self.mark([e])
            self.df = self.df.where(compile_expr(e, self.scope)).select(*map(col, before))

    def mark(self, exprs: list) -> None:
        """Bring a column for each pattern that expressions ask about: whether it is there, or how often."""
        for s in dict.fromkeys(y for e in exprs if e is not None for y in subqueries(e)):
            name = f"_sub{len(self.scope.subs)}"
            got, met = self.found(s)
            keys = got.columns
            if s.kind == "count":
                got = got.groupBy(*keys).agg(F.count("*").alias(name))
                value = F.coalesce(col(name), F.lit(0).cast("long"))
            else:
                got = (got.distinct() if keys else got).withColumn(name, F.lit(True))
                value = F.coalesce(col(name), F.lit(False))
            self.df = self.start().join(got, met, "left").drop(*keys).withColumn(name, value)
            self.scope.subs[s] = name

    def found(self, s: A.Sub) -> tuple:
        """What a pattern matches, as the columns of the outer variables that it reads, and their join condition.

        It is matched from the distinct values of those columns: the keys of nodes, and the properties that are read.
        """
        parts = [x for p in s.patterns for x in (*p.nodes, *p.rels)]
        if taken := [r.var for p in s.patterns for r in p.rels if r.var in self.scope.vars]:
            raise QueryError(f"the relationship {taken[0]} is bound outside the pattern")
        shared = sorted(mentions(s) & set(self.scope.vars))
        read = set().union(*map(read_props, children(s)), {(x.var, k) for x in parts for k, _ in x.props})
        ends = {n.var for p in s.patterns for n in p.nodes}
        whole_ones = set().union(*map(bare, [v for x in parts for _, v in x.props]), bare(s.where) if s.where is not None else set())
        names: list[str] = []
        for v in shared:
            b = self.scope.get(v)
            if b.kind == "node" and v not in whole_ones:
                own = [b.props[b.key] if b.key in b.props else name_of(v, "_key"), *b.columns] if v in ends else []
                names += [*own, *(b.props[k] for w, k in sorted(read) if w == v and k in b.props)]
            else:
                names += self.columns_of_bound(v, b) if b.kind != "value" else [v]
        names = list(dict.fromkeys(names))
        inner = Planner(self.catalog, self.scope.params, self.mode)
        inner.asked, inner.listed, inner.copied = mentions(s), lists(s), distinct_args(s)
        if s.kind == "exists" and self.mode != "trail":
            used = mentions(s.where) if s.where is not None else set()
            inner.sets = {r.var for p in s.patterns for r in p.rels if r.low is not None and r.var not in used and not p.path}
        if names:
            inner.df = self.df.select(*map(col, names)).distinct()
            inner.scope.vars = {v: self.scope.vars[v] for v in shared}
            inner.scope.types = dict(self.scope.types)
        inner.match(A.Match(s.patterns, s.where))
        got = inner.df.select(*[col(c).alias(f"_e{i}") for i, c in enumerate(names)])
        if not names and s.kind == "exists":
            got = got.limit(1)
        return got, reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(names)], F.lit(True))

    def optional(self, c: A.Match) -> None:
        before, scope = self.df.withColumn("_opt", F.monotonically_increasing_id()), self.scope.copy()
        shared = sorted({n.var for p in c.patterns for n in p.nodes} & set(scope.vars))
        if not shared:
            inner = Planner(self.catalog, scope.params, self.mode)
            inner.asked, inner.listed, inner.copied = self.asked, self.listed, self.copied
            inner.match(replace(c, optional=False))
            self.df = self.df.join(inner.df.drop("_row"), F.lit(True), "left")
            self.scope.vars |= inner.scope.vars
            return
        # match from the distinct keys of the shared variables, then join what was found to all rows
        keys = [identity(A.Var(v), scope) for v in shared]
        inner = Planner(self.catalog, scope.params, self.mode)
        inner.asked, inner.sets, inner.listed, inner.copied = self.asked | set(shared), set(), self.listed, self.copied
        outer = mentions(c.where) - {n.var for p in c.patterns for n in p.nodes} - {r.var for p in c.patterns for r in p.rels} if c.where is not None else set()
        if outer & set(scope.vars):
            inner.df, inner.scope = before, scope.copy()
            inner.match(replace(c, optional=False))
            fresh = [x for x in inner.df.columns if x not in before.columns]
            got = inner.df.select(F.col("_opt").alias("_opt2"), *[col(x) for x in fresh])
            self.df = before.join(got, F.col("_opt") == F.col("_opt2"), "left").drop("_opt", "_opt2")
            self.scope = inner.scope
            return
        needed = [x for v in shared for x in self.columns_of(v, scope)]
        inner.df = self.df.select(*[col(x) for x in needed]).distinct()
        inner.scope.vars = {v: scope.vars[v] for v in shared}
        inner.match(replace(c, optional=False))
        fresh = [x for x in inner.df.columns if x not in needed]
        got = inner.df.select(*[identity(A.Var(v), inner.scope).alias(f"_k{i}") for i, v in enumerate(shared)], *[col(x) for x in fresh])
        met = reduce(lambda a, b: a & b, [k == F.col(f"_k{i}") for i, k in enumerate(keys)])
        self.df = self.df.join(got, met, "left").drop(*[f"_k{i}" for i in range(len(shared))])
        self.scope.vars |= inner.scope.vars

    def columns_of(self, v: str, scope: Scope) -> list[str]:
        return [c for c in self.df.columns if c == v or c.startswith(name_of(v, ""))]

    def selectivity(self, n: A.NodePat) -> int:
        """3: bound; 2: the key is given; 1: some property is; 0: all of a label; -1: anything."""
        if n.var in self.scope.vars:
            return 3
        given = {k for k, _ in n.props}
        for e in self.pushed:
            if isinstance(e, A.Op) and e.name == "=":
                for a, b in (e.args, e.args[::-1]):
                    if isinstance(a, A.Prop) and a.of == A.Var(n.var) and isinstance(b, (A.Lit, A.Param)):
                        given.add(a.name)
        if len(n.labels) == 1 and self.catalog.node(n.labels[0]).key in given:
            return 2
        return 1 if given else 0 if n.labels else -1

    def pattern(self, p: A.Pattern) -> None:
        at = max(range(len(p.nodes)), key=lambda i: self.selectivity(p.nodes[i]))
        labels = self.infer(p)
        anchor = p.nodes[at]
        if anchor.var not in self.scope.vars:
            scan = self.scan(anchor, labels[at])
            self.df = scan if self.df is None else self.df.crossJoin(scan)
        else:
            self.restrict(anchor)
        for i in range(at, len(p.rels)):
            self.expand(p, i, i, i + 1, labels)
        for i in range(at - 1, -1, -1):
            self.expand(p, i, i + 1, i, labels)
        if p.path:
            self.path(p)

    def infer(self, p: A.Pattern) -> list[tuple]:
        """Labels of each node, those that relationships imply where none are written."""
        labels = [n.labels or ((self.scope.vars[n.var].label,) if n.var in self.scope.vars and self.scope.vars[n.var].label else ()) for n in p.nodes]
        for _ in p.rels:
            for i, r in enumerate(p.rels):
                if r.low is not None and r.high != 1:
                    ends = {x for t in self.tables(r, (), ()) for x in (t.src, t.dst)}
                    for j in (i, i + 1):
                        if not labels[j] and len(ends) == 1:
                            labels[j] = tuple(ends)
                    continue
                ts = self.tables(r, labels[i], labels[i + 1])
                if not labels[i]:
                    labels[i] = tuple(dict.fromkeys(x for t in ts for x in ((t.src,) if r.way == "out" else (t.dst,) if r.way == "in" else (t.src, t.dst))))
                if not labels[i + 1]:
                    labels[i + 1] = tuple(dict.fromkeys(x for t in ts for x in ((t.dst,) if r.way == "out" else (t.src,) if r.way == "in" else (t.src, t.dst))))
        return labels

    def tables(self, r: A.RelPat, left: tuple, right: tuple) -> list:
        """The relationship tables that fit a pattern's types and ends."""
        tables = [self.catalog.rel(t) for t in r.types] or self.catalog.rels
        fits = lambda label, ok: not ok or label.upper() in {x.upper() for x in ok}
        one = lambda t: fits(t.src, left) and fits(t.dst, right)
        other = lambda t: fits(t.dst, left) and fits(t.src, right)
        return [t for t in tables if (r.way != "in" and one(t)) or (r.way != "out" and other(t))]

    def scan(self, n: A.NodePat, labels: tuple) -> DataFrame:
        """Nodes of one label with their columns named; of several labels all properties, and the label as a column."""
        tables = [self.catalog.node(x) for x in labels] or self.catalog.nodes
        if not tables:
            raise QueryError("the graph has no node tables")
        if len(tables) == 1:
            t = tables[0]
            df = t.df.select(*[col(c).alias(name_of(n.var, c)) for c in t.props])
            self.scope.note(df)
            self.scope.vars[n.var] = Bound("node", {c: name_of(n.var, c) for c in t.props}, t.key, t.name)
        else:
            parts = [t.df.select(*[col(c).alias(name_of(n.var, c)) for c in t.props], F.lit(t.name).alias(name_of(n.var, "_label")), col(t.key).cast("string").alias(name_of(n.var, "_key"))) for t in tables]
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.alike(parts))
            self.scope.note(df)
            props = {c: name_of(n.var, c) for t in tables for c in t.props}
            self.scope.vars[n.var] = Bound("node", props, "_key", "", (name_of(n.var, "_label"),))
            self.scope.vars[n.var].props = props
        return self.filtered(df, n)

    def alike(self, parts: list[DataFrame]) -> list[DataFrame]:
        """Columns of one name but several types become text, so that labels can be put together."""
        kinds: dict[str, set] = {}
        for p in parts:
            for c, k in p.dtypes:
                kinds.setdefault(c, set()).add(k)
        return [p.select(*[(col(c).cast("string").alias(c) if len(kinds[c]) > 1 else col(c)) for c in p.columns]) for p in parts]

    def filtered(self, df: DataFrame, n: A.NodePat | A.RelPat) -> DataFrame:
        for k, v in n.props:
            df = df.where(compile_expr(A.Op("=", (A.Prop(A.Var(n.var), k), v)), self.scope))
        return df

    def restrict(self, n: A.NodePat) -> None:
        b = self.scope.get(n.var)
        if n.labels and b.label and b.label.upper() not in {x.upper() for x in n.labels}:
            self.df = self.df.where(F.lit(False))
        elif n.labels and b.columns:
            self.df = self.df.where(F.upper(col(b.columns[0])).isin([x.upper() for x in n.labels]))
        self.df = self.filtered(self.df, n)

    def edges(self, r: A.RelPat, left: tuple, right: tuple, forward: bool) -> DataFrame:
        """Edges of a pattern as _from, _to (in walking order), with their labels and ends, type and properties."""
        out = []
        apart = r.var in self.copied or self.mode == "trail" and r.low is not None
        for t in self.tables(r, left, right):
            rows = numbered(t.df) if apart else t.df
            props = [col(c).alias(name_of(r.var, c)) for c in t.props]
            row = [*[col(c).alias(name_of(r.var, c)) for c in ("_src", "_dst", *(["_copy"] if apart else []))], F.lit(t.name).alias(name_of(r.var, "_type")), *props]
            fits = lambda label, ok: not ok or label.upper() in {x.upper() for x in ok}
            for a, b, la, lb, use in (("_src", "_dst", t.src, t.dst, r.way != "in"), ("_dst", "_src", t.dst, t.src, r.way != "out")):
                if use and fits(la, left) and fits(lb, right):
                    x, y, lx, ly = (a, b, la, lb) if forward else (b, a, lb, la)
                    df = rows.where("_src <> _dst") if r.way == "both" and a == "_dst" and t.src == t.dst else rows
                    out.append(df.select(col(x).alias("_from"), col(y).alias("_to"), F.lit(lx).alias("_lfrom"), F.lit(ly).alias("_lto"), *row))
        if not out:
            raise QueryError(f"no relationship table fits {'|'.join(r.types) or 'the pattern'}")
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.alike(out))
        known = [c for c in df.columns if c.startswith(name_of(r.var, "")) and not c.endswith(("·_src", "·_dst", "·_type", "·_copy"))]
        self.scope.note(df)
        scope = Scope(self.scope.params)
        scope.types = self.scope.types
        scope.vars[r.var] = Bound("rel", {c.partition("·")[2]: c for c in known}, "", "", ())
        for k, v in r.props:
            df = df.where(compile_expr(A.Op("=", (A.Prop(A.Var(r.var), k), v)), scope))
        for e in self.pushed:
            if mentions(e) == {r.var} and r.low is None and not has_aggregate(e) and isinstance(e, A.Op) and e.name in ("=", "<", ">", "<=", ">=", "<>"):
                df = df.where(compile_expr(e, scope))
        return df

    def expand(self, p: A.Pattern, i: int, a: int, b: int, labels: list[tuple]) -> None:
        """Follow relationship i from node a, which is bound, to node b."""
        r, source, target = p.rels[i], p.nodes[a], p.nodes[b]
        forward = a < b
        if r.low is not None and not (r.low == 1 and r.high == 1 and not r.shortest):
            return self.hops(p, r, source, target, labels, a, b)
        edges = self.edges(r, labels[min(a, b)], labels[max(a, b)], forward)
        sb = self.scope.get(source.var)
        met = self.key_of(source.var) == (F.col("_from").cast("string") if sb.columns else F.col("_from"))
        if sb.columns:
            met &= col(sb.columns[0]) == F.col("_lfrom")
        df = self.df.join(edges, met).drop("_from", "_lfrom")
        self.scope.vars[r.var] = Bound("rel", {c.partition("·")[2]: c for c in edges.columns if c.startswith(name_of(r.var, "")) and c.partition("·")[2] not in ("_src", "_dst", "_type", "_copy")}, "", "", tuple(name_of(r.var, c) for c in ("_type", "_copy") if name_of(r.var, c) in edges.columns))
        self.df = df
        self.arrive(target, labels[b])

    def key_of(self, var: str):
        b = self.scope.get(var)
        return col(b.props[b.key]) if b.key in b.props else col(name_of(var, "_key"))

    def arrive(self, target: A.NodePat, labels: tuple) -> None:
        """Join the node at _to: to the rows where it is bound already, or else to its table."""
        if target.var in self.scope.vars:
            b = self.scope.get(target.var)
            same = self.key_of(target.var) == (F.col("_to").cast("string") if b.columns else F.col("_to"))
            self.df = self.df.where(same & (col(b.columns[0]) == F.col("_lto")) if b.columns else same).drop("_to", "_lto")
            self.restrict(target)
            return
        nodes = self.scan(target, labels)
        b = self.scope.get(target.var)
        met = F.col("_to").cast("string") == self.key_of(target.var) if b.columns else F.col("_to") == self.key_of(target.var)
        if b.columns:
            met &= F.col("_lto") == col(b.columns[0])
        self.df = self.df.join(nodes, met).drop("_to", "_lto")

    def hops(self, p: A.Pattern, r: A.RelPat, source: A.NodePat, target: A.NodePat, labels: list[tuple], a: int, b: int) -> None:
        ends = {x for t in self.tables(r, (), ()) for x in (t.src, t.dst)}
        if len(ends) != 1:
            raise QueryError("a variable-length pattern needs relationships within one label")
        edges = self.edges(r, (), (), a < b)
        low, high = r.low, r.high if r.high is not None else paths.ENDLESS if r.shortest else paths.MOST_HOPS
        if self.mode == "trail":
            edges = edges.withColumn("_eid", F.xxhash64(F.to_json(F.struct(*[col(c) for c in edges.columns if c.startswith(name_of(r.var, ""))]))))
        key = self.key_of(source.var)
        starts = self.df.select(key.alias("_start")).where("_start IS NOT NULL").distinct()
        need_nodes = p.path in self.asked and bool(p.path) or r.var in self.listed
        if r.shortest:
            targets = None
            if target.var in self.scope.vars:
                targets = self.df.select(key.alias("_start"), self.key_of(target.var).alias("_end")).distinct()
            elif self.selectivity(target) >= 1:
                kept = self.scope.copy()
                ends_df = self.scan(target, labels[b])
                targets = starts.crossJoin(self.pre_filter(ends_df, target).select(self.key_of(target.var).alias("_end")))
                self.scope = kept
            if r.shortest == "all" or need_nodes:
                found = paths.all_shortest(starts, edges, min(low, 1), high, targets)
                found = found.where(F.col("_len") >= low)
                if r.shortest == "one":
                    found = found.groupBy("_start", "_end", "_len").agg(F.min("_nodes").alias("_nodes"))
            else:
                found = paths.shortest_lengths(starts, edges, min(low, 1), high, targets).where(F.col("_len") >= low)
        elif r.var in self.sets and not need_nodes:
            found = paths.reachable(starts, edges, low, r.high)
        else:
            found = paths.walks(starts, edges, low, high, need_nodes, self.mode == "trail")
        names = {"_len": name_of(r.var, "_len"), "_nodes": name_of(r.var, "_nodes")}
        label = next(iter(ends))
        found = found.select("_start", F.col("_end").alias("_to"), F.lit(label).alias("_lto"), *[F.col(c).alias(names[c]) for c in ("_len", "_nodes") if c in found.columns])
        columns = tuple(names[c] for c in ("_len", "_nodes") if names[c] in found.columns)
        if columns:
            self.scope.vars[r.var] = Bound("hops", {}, "", "", columns)
        self.df = self.df.join(found, key == F.col("_start")).drop("_start")
        self.arrive(target, labels[b] or (label,))

    def pre_filter(self, df: DataFrame, n: A.NodePat) -> DataFrame:
        """Conditions of WHERE on this node alone."""
        for e in self.pushed:
            if mentions(e) == {n.var} and not has_aggregate(e):
                df = df.where(compile_expr(e, self.scope))
        return df

    def path(self, p: A.Pattern) -> None:
        """Bind a path variable: its length, and its node keys where they are carried."""
        lens, nodes = [], []
        for i, r in enumerate(p.rels):
            b = self.scope.vars.get(r.var)
            if b is not None and b.kind == "hops":
                lens.append(col(b.columns[0]).cast("long"))
                nodes = [col(b.columns[1])] if len(b.columns) > 1 and len(p.rels) == 1 else nodes
            else:
                lens.append(F.lit(1).cast("long"))
        name = name_of(p.path, "_len")
        self.df = self.df.withColumn(name, reduce(lambda x, y: x + y, lens, F.lit(0).cast("long")))
        columns = [name]
        if all(r.low is None for r in p.rels):
            nodes = [F.array(*[self.key_of(n.var).cast("string") for n in p.nodes])]
        if nodes:
            self.df = self.df.withColumn(name_of(p.path, "_nodes"), nodes[0])
            columns.append(name_of(p.path, "_nodes"))
        self.scope.vars[p.path] = Bound("path", {}, "", "", tuple(columns))

    # ------------------------------------------------------------ projections

    def items(self, body: A.Projection) -> list[A.Item]:
        out = []
        for x in body.items:
            if x.star and x.expr is None:
                out += [A.Item(A.Var(v), v) for v in self.scope.vars if not v.startswith("_anon")]
            elif x.star:
                b = self.scope.get(x.name)
                if b.kind not in ("node", "rel"):
                    raise QueryError(f"{x.name} has no properties")
                out += [A.Item(A.Prop(A.Var(x.name), p), f"{x.name}.{p}") for p in b.props]
            else:
                out.append(x)
        return out

    def number(self, e: object) -> int:
        value = e.value if isinstance(e, A.Lit) else self.scope.params.get(e.name) if isinstance(e, A.Param) else None
        if not isinstance(value, int) or value < 0:
            raise QueryError("SKIP and LIMIT need a whole number")
        return value

    def project(self, body: A.Projection, last: bool) -> None:
        items, scope = self.items(body), self.scope
        self.mark([*(x.expr for x in items), *(e for e, _ in body.order)])
        df = self.start()
        if len({x.name for x in items}) < len(items):
            raise QueryError("two columns of one name")
        done: dict = {}
        fresh = Scope(scope.params)
        if any(has_aggregate(x.expr) for x in items):
            keys = [x for x in items if not has_aggregate(x.expr)]
            calls: dict = {}

            def find(e):
                if is_aggregate(e):
                    calls.setdefault(e, f"_agg{len(calls)}")
                else:
                    for y in children(e):
                        find(y)

            for x in items:
                find(x.expr)
            for e, _ in body.order:
                find(e)
            carried, group = {}, []
            for k, x in enumerate(keys):
                b = scope.vars.get(x.expr.name) if isinstance(x.expr, A.Var) else None
                if b is not None and b.kind != "value" and not last:
                    carried[x.name] = (x.expr.name, b)
                    group += [col(c) for c in self.columns_of_bound(x.expr.name, b)]
                else:
                    group.append(compile_expr(x.expr, scope).alias(f"_key{k}"))
                    group += [col(c) for c in b.columns[1:]] if b is not None and b.kind == "rel" else []
                    done[x.expr] = col(f"_key{k}")
            go = lambda e: compile_expr(e, scope)
            aggs = [aggregate(e, scope, go).alias(n) for e, n in calls.items()]
            df = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
            done |= {e: col(n) for e, n in calls.items()}
        out, carry, seen, hidden = [], [], {}, []  # hidden: what tells equal relationships apart
        for x in items:
            b = scope.vars.get(x.expr.name) if isinstance(x.expr, A.Var) else None
            if b is not None and b.kind != "value" and not last:
                carry += self.renamed(x.expr.name, x.name, b, fresh)
            else:
                c = compile_expr(x.expr, scope, done)
                out.append(c.alias(x.name))
                if b is not None and b.kind == "rel":
                    hidden += [col(c).alias(f"_cpy{len(hidden) + i}") for i, c in enumerate(b.columns[1:])]
                seen[x.expr] = x.name
                fresh.vars[x.name] = Bound("value")
        order = []
        by_name = {x.name: x.expr for x in items}
        for e, down in body.order:
            expr = by_name[e.name] if isinstance(e, A.Var) and e.name in by_name and e.name not in done else e
            if body.distinct and expr not in seen and not (isinstance(expr, A.Prop) and isinstance(expr.of, A.Var) and expr.of.name in fresh.vars):
                raise QueryError("ORDER BY of a DISTINCT result needs a column of it")
            order.append((compile_expr(expr, scope, done), down))
        sort = [c.alias(f"_ord{k}") for k, (c, _) in enumerate(order)]
        df = df.select(*out, *carry, *sort, *hidden)
        if not last:
            fresh.note(df)
        names = [c for c in df.columns if not c.startswith(("_ord", "_cpy"))]
        if body.distinct:
            df = df.distinct()
        if sort:
            df = df.orderBy(*[F.desc(f"_ord{k}") if down else F.asc(f"_ord{k}") for k, (_, down) in enumerate(order)])
        if body.skip is not None:
            df = df.offset(self.number(body.skip))
        if body.limit is not None:
            df = df.limit(self.number(body.limit))
        if sort or hidden:
            df = df.select(*[col(c) for c in names])
        self.df, self.scope = df, fresh
        self.keep(body.where)
        self.columns = names

    def columns_of_bound(self, var: str, b: Bound) -> list[str]:
        extra = [name_of(var, p) for p in ("_src", "_dst", "_type")] if b.kind == "rel" else [name_of(var, "_key")] if b.key == "_key" else []
        return list(dict.fromkeys([*b.props.values(), *b.columns, *extra]))

    def renamed(self, old: str, new: str, b: Bound, into: Scope) -> list:
        names = {c: name_of(new, c.partition("·")[2]) for c in self.columns_of_bound(old, b)}
        into.vars[new] = replace(b, props={p: names[c] for p, c in b.props.items()}, columns=tuple(names[c] for c in b.columns))
        return [col(c).alias(n) for c, n in names.items()]


def plan_query(q: A.Query, catalog: GraphCatalog, params: dict | None = None, mode: str = "walk") -> DataFrame:
    """The result of a reading query; UNION puts results together by place."""
    planner = Planner(catalog, params, mode)
    planner.read(q.clauses)
    if not isinstance(q.clauses[-1], (A.Return, A.CallProc)):
        raise QueryError("a query ends with RETURN")
    df = planner.df
    if q.union is not None:
        df = df.union(plan_query(q.union, catalog, params, mode))
        df = df if q.union_all else df.distinct()
    return df


__all__ = ["NodeTable", "Planner", "SparkSession", "plan_query", "whole"]
