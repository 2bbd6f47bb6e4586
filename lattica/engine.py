"""The engine: statements in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Databases, GraphCatalog
from .cypher import ast as A
from .cypher.parser import parse
from .cypher.render import bind_text
from .errors import DatabaseError, LatticaError, MissingKeyError, QueryError
from .operators import mutate
from .operators.paths import scratch_table
from .plans.expressions import col, compile_expr, name_of
from .plans.planner import Planner, plan_query
from .streaming.changelog import ChangeLog
from .types import to_spark

_READING = (A.Match, A.With, A.Unwind, A.CallProc)


@dataclass
class QueryResult:
    """A result with its columns and the time it took to plan."""

    df: DataFrame
    plan_ms: float

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def stream(self, size: int = 1000) -> Iterator[list[dict]]:
        """The rows in batches of at most size; the driver holds one partition at a time."""
        it = (r.asDict(recursive=True) for r in self.df.toLocalIterator())
        while batch := list(islice(it, size)):
            yield batch


class Engine:
    """Databases of property graphs, and the statements on them.

    mode: 'walk' (a pattern may use an edge twice) or 'trail' for variable-length patterns. strict_writes asks for the
    key of what a write creates or changes. store_every: so many changes of a table later it is stored, which cuts its
    lineage (0: never). log: a change log that every statement which changes something is appended to before it runs,
    with its parameters written out and under the first shard of its database; ChangeLog.replay builds the graph again.
    """

    def __init__(self, spark: SparkSession, mode: str = "walk", strict_writes: bool = False, store_every: int = 8, log: ChangeLog | None = None):
        self.log = log
        self.spark, self.mode, self.strict_writes, self.store_every = spark, mode, strict_writes, store_every
        self.databases = Databases(spark)
        self.databases.create("default")
        self._changes: dict[tuple[int, str], int] = {}

    @property
    def graph(self) -> GraphCatalog:
        return self.databases.graph("default")

    def database(self, name: str) -> Session:
        self.databases.graph(name)
        return Session(self, name)

    def cypher(self, text: str, params: dict | None = None, database: str = "default") -> DataFrame:
        """Run one statement. A reading query is planned, not run; a write changes the graph and returns what it says
        to RETURN, or no rows."""
        tree = parse(text)
        if isinstance(tree, A.Admin):
            return self.admin(text)
        g = self.databases.graph(database)
        reading = isinstance(tree, A.Query) and all(isinstance(c, (*_READING, A.Return)) for c in tree.clauses)
        if self.log is not None and not reading:
            self.log.append([(self.databases.get(database).shard_ids[0], bind_text(text, dict(params or {})))])
        return self._run(tree, dict(params or {}), g)

    def query(self, text: str, params: dict | None = None, database: str = "default") -> QueryResult:
        begun = perf_counter()
        df = self.cypher(text, params, database)
        return QueryResult(df, (perf_counter() - begun) * 1000)

    def admin(self, text: str) -> DataFrame:
        """CREATE, STOP, START and DROP DATABASE, and SHOW DATABASES; returns the databases there are then."""
        tree = parse(text)
        if not isinstance(tree, A.Admin):
            raise DatabaseError("an admin command expected")
        if self.log is not None and tree.action != "show":
            self.log.append([(0, text)])
        if tree.action == "create":
            self.databases.create(tree.name, tree.shards if tree.shards is not None else 3)
        elif tree.action != "show":
            getattr(self.databases, tree.action)(tree.name)
        return self.databases.show()

    # ------------------------------------------------------------ statements

    def _run(self, tree, params: dict, g: GraphCatalog) -> DataFrame:
        if isinstance(tree, A.NodeDDL):
            if not (tree.if_not_exists and g.has(tree.name)):
                if g.has(tree.name):
                    raise QueryError(f"table {tree.name} exists")
                g.add_node(tree.name, g.empty((c, to_spark(k)) for c, k in tree.columns), tree.key)
        elif isinstance(tree, A.RelDDL):
            if not (tree.if_not_exists and g.has(tree.name)):
                if g.has(tree.name):
                    raise QueryError(f"table {tree.name} exists")
                ends = [(c, g.node(t).df.schema[g.node(t).key].dataType) for c, t in (("_src", tree.src), ("_dst", tree.dst))]
                g.add_rel(tree.name, g.empty([*ends, *((c, to_spark(k)) for c, k in tree.columns)]), tree.src, tree.dst)
        elif isinstance(tree, A.DropTable):
            g.drop(tree.name, tree.if_exists)
        elif isinstance(tree, A.Alter):
            self._alter(tree, g, params)
        elif isinstance(tree, A.Copy):
            from .sources import csv_io

            header = bool(tree.options.get("HEADER", False))
            load = csv_io.load_nodes if any(n.name.upper() == tree.table.upper() for n in g.nodes) else csv_io.load_edges
            load(g, tree.table, tree.path, header=header)
        elif any(not isinstance(c, (*_READING, A.Return)) for c in tree.clauses):
            return self._write(tree, g, params)
        else:
            return plan_query(tree, g, params, self.mode)
        return self.spark.range(0).select(F.lit(0).alias("ok"))

    def _alter(self, tree: A.Alter, g: GraphCatalog, params: dict) -> None:
        if tree.action == "rename_table":
            return g.rename(tree.name, tree.args[0])
        is_node = any(n.name.upper() == tree.name.upper() for n in g.nodes)
        t = g.node(tree.name) if is_node else g.rel(tree.name)
        fixed = {t.key} if is_node else {"_src", "_dst"}
        if tree.action == "add":
            name, kind, default = tree.args
            if name in t.df.columns:
                raise QueryError(f"{t.name} has the column {name}")
            value = compile_expr(default, Planner(g, params).scope)
            g.bind(t.name, t.df.withColumn(name, value.cast(to_spark(kind))))
            return None
        if tree.args[0] not in t.df.columns or (tree.args[0] in fixed and (tree.action == "drop" or not is_node)):
            raise QueryError(f"cannot {tree.action} the column {tree.args[0]} of {t.name}")
        if tree.action == "drop":
            g.bind(t.name, t.df.drop(tree.args[0]))
        elif is_node:
            g.add_node(t.name, t.df.withColumnRenamed(*tree.args), tree.args[1] if tree.args[0] == t.key else t.key)
        else:
            g.bind(t.name, t.df.withColumnRenamed(*tree.args))
        return None

    def _bind(self, g: GraphCatalog, name: str, df: DataFrame) -> None:
        at = (id(g), name.upper())
        self._changes[at] = self._changes.get(at, 0) + 1
        if self.store_every and self._changes[at] % self.store_every == 0:
            df = scratch_table(df, f"table-{name.lower()}")
        g.bind(name, df)

    # ------------------------------------------------------------ writes

    def _write(self, q: A.Query, g: GraphCatalog, params: dict) -> DataFrame:
        if q.union is not None:
            raise QueryError("UNION of writes")
        planner = Planner(g, params, self.mode)
        clauses = list(q.clauses)
        for c in clauses:  # relationships that are changed are told apart from their equals, also under another name
            planner.changed |= set(c.names) if isinstance(c, A.Delete) else {x[0] for x in c.items} if isinstance(c, (A.SetProps, A.Remove)) else set()
            planner.changed |= {x.expr.name for x in c.body.items if isinstance(x.expr, A.Var)} if isinstance(c, A.With) else set()
        while clauses:
            c = clauses.pop(0)
            if isinstance(c, (*_READING, A.Return)):
                part = [c]
                planner.read(tuple(part))
            elif isinstance(c, A.Create):
                self._create(planner, g, c)
            elif isinstance(c, A.Merge):
                self._merge(planner, g, c)
            elif isinstance(c, A.SetProps):
                self._set(planner, g, c.items)
            elif isinstance(c, A.Remove):
                self._set(planner, g, tuple((v, p, A.Lit(None)) for v, p in c.items))
            else:
                self._delete(planner, g, c)
        if q.clauses and isinstance(q.clauses[-1], A.Return):
            return planner.df
        return self.spark.range(0).select(F.lit(0).alias("ok"))

    def _new_node(self, planner: Planner, g: GraphCatalog, n: A.NodePat) -> tuple:
        """The table and, per row of the planner, the property columns of a node to make."""
        if len(n.labels) != 1:
            raise QueryError("a node to create needs one label")
        t = g.node(n.labels[0])
        props = dict(n.props)
        if t.key not in props:
            raise (MissingKeyError if self.strict_writes else QueryError)(f"{t.name} needs its key {t.key}")
        for k in props:
            if k not in t.props:
                raise QueryError(f"{t.name} has no property {k}")
        return t, {k: compile_expr(v, planner.scope).cast(t.df.schema[k].dataType) for k, v in props.items()}

    def _bring(self, planner: Planner, t, var: str, values: dict) -> None:
        from .plans.expressions import Bound

        df = planner.start()
        df = df.withColumns({name_of(var, c): values.get(c, F.lit(None).cast(t.df.schema[c].dataType)) for c in t.props})
        planner.df = df
        planner.scope.vars[var] = Bound("node", {c: name_of(var, c) for c in t.props}, t.key, t.name)

    def _create(self, planner: Planner, g: GraphCatalog, c: A.Create) -> None:
        planner.df = scratch_table(planner.start(), "rows")
        for p in c.patterns:
            for n in p.nodes:
                if n.var in planner.scope.vars:
                    continue
                t, values = self._new_node(planner, g, n)
                rows = planner.start().select(*[v.alias(k) for k, v in values.items()])
                self._bind(g, t.name, mutate.insert_nodes(g.node(t.name).df, rows, t.key))
                self._bring(planner, t, n.var, values)
            for i, r in enumerate(p.rels):
                self._create_rel(planner, g, r, p.nodes[i].var, p.nodes[i + 1].var)

    def _rel_rows(self, planner: Planner, g: GraphCatalog, r: A.RelPat, left: str, right: str) -> tuple:
        if len(r.types) != 1 or r.way == "both" or r.low is not None:
            raise QueryError("a relationship to create needs one type and a direction")
        t = g.rel(r.types[0])
        a, b = (left, right) if r.way == "out" else (right, left)
        for v, label in ((a, t.src), (b, t.dst)):
            if planner.scope.get(v).label.upper() != label.upper():
                raise QueryError(f"{t.name} goes from {t.src} to {t.dst}")
        row = [planner.key_of(a).alias("_src"), planner.key_of(b).alias("_dst"), *[compile_expr(v, planner.scope).alias(k) for k, v in r.props]]
        return t, planner.df.select(*row).where("_src IS NOT NULL AND _dst IS NOT NULL")

    def _create_rel(self, planner: Planner, g: GraphCatalog, r: A.RelPat, left: str, right: str) -> None:
        t, rows = self._rel_rows(planner, g, r, left, right)
        self._bind(g, t.name, mutate.append(t.df, rows))

    def _merge(self, planner: Planner, g: GraphCatalog, c: A.Merge) -> None:
        p = c.pattern
        if p.rels:
            if len(p.rels) > 1 or any(n.var not in planner.scope.vars for n in p.nodes):
                for n in p.nodes:
                    if n.var not in planner.scope.vars:
                        self._merge(planner, g, A.Merge(A.Pattern((n,), ())))
            for i, r in enumerate(p.rels):
                t, rows = self._rel_rows(planner, g, r, p.nodes[i].var, p.nodes[i + 1].var)
                keys = ["_src", "_dst", *(k for k, _ in r.props)]
                sets = {pr: compile_expr(e, planner.scope) for v, pr, e in c.on_create if v == r.var}
                fresh = mutate.remove(rows.distinct(), t.df, [(k, k) for k in keys])
                if sets:
                    fresh = fresh.withColumns({k: v for k, v in sets.items()})
                fresh = scratch_table(fresh, "rows")
                met = {pr: compile_expr(e, planner.scope) for v, pr, e in c.on_match if v == r.var}
                df = t.df
                if met:
                    changes = rows.select("_src", "_dst").distinct().select("_src", "_dst", *[v.alias(f"_set_{k}") for k, v in met.items()])
                    df = mutate.update(df, changes, ["_src", "_dst"])
                self._bind(g, t.name, mutate.append(df, fresh))
            return
        n = p.nodes[0]
        if n.var in planner.scope.vars:
            return
        t, values = self._new_node(planner, g, n)
        own = planner.scope.copy()
        base = planner.start().select(*planner.start().columns)
        self._bring(planner, t, n.var, values)
        sets = {}
        for kind, items in (("c", c.on_create), ("m", c.on_match)):
            for _, prop, e in items:
                if prop not in t.props:
                    raise QueryError(f"{t.name} has no property {prop}")
                sets[kind, prop] = e
        # what ON MATCH reads of the node is what the table has
        old = t.df.select(*[col(x).alias(f"_old_{x}") for x in t.props])
        df = planner.df.join(old, planner.key_of(n.var) == col(f"_old_{t.key}"), "left")
        seen = planner.scope.copy()
        from .plans.expressions import Bound

        seen.vars[n.var] = Bound("node", {x: f"_old_{x}" for x in t.props}, t.key, t.name)
        rows = df.select(*[col(name_of(n.var, k)).alias(k) for k in values], *[compile_expr(e, seen if kind == "m" else planner.scope).alias(f"_{kind}_{prop}") for (kind, prop), e in sets.items()])
        rows = scratch_table(rows, "rows")
        table = mutate.upsert(t.df, rows, t.key, {p: f"_c_{p}" for k, p in sets if k == "c"}, {p: f"_m_{p}" for k, p in sets if k == "m"})
        self._bind(g, t.name, scratch_table(table, f"table-{t.name.lower()}"))
        planner.df, planner.scope = base, own
        nodes = g.node(t.name).df.select(*[col(x).alias(name_of(n.var, x)) for x in t.props])
        planner.df = base.join(nodes, values[t.key] == col(name_of(n.var, t.key)))
        planner.scope.vars[n.var] = Bound("node", {x: name_of(n.var, x) for x in t.props}, t.key, t.name)

    def _set(self, planner: Planner, g: GraphCatalog, items: tuple) -> None:
        by: dict[str, dict] = {}
        for v, prop, e in items:
            if prop:
                by.setdefault(v, {})[prop] = e
            else:
                pairs = e.items if isinstance(e, A.MapOf) else [(k, A.Lit(x)) for k, x in planner.scope.params[e.name].items()] if isinstance(e, A.Param) else ()
                by.setdefault(v, {}).update(dict(pairs))
        planner.df = scratch_table(planner.start(), "rows")
        for v, sets in by.items():
            b = planner.scope.get(v)
            if b.kind == "node":
                t = g.node(b.label)
                for p in sets:
                    if p not in t.props or p == t.key:
                        raise QueryError(f"cannot set {p} of {t.name}")
                changes = planner.df.where(planner.key_of(v).isNotNull()).select(planner.key_of(v).alias(t.key), *[compile_expr(e, planner.scope).alias(f"_set_{p}") for p, e in sets.items()])
                self._bind(g, t.name, mutate.update(t.df, changes, [t.key]))
            else:
                kinds = {r[0] for r in planner.df.select(col(name_of(v, "_type"))).distinct().collect()} - {None}
                for kind in kinds:
                    t = g.rel(kind)
                    mine = planner.df.where(col(name_of(v, "_type")) == kind)
                    keys = [col(name_of(v, x)).alias(x) for x in (*t.df.columns, "_copy")]
                    changes = mine.select(*keys, *[compile_expr(e, planner.scope).alias(f"_set_{p}") for p, e in sets.items()])
                    self._bind(g, t.name, mutate.update_rels(t.df, changes))
            fresh = {name_of(v, p): compile_expr(e, planner.scope) for p, e in sets.items()}
            kinds = dict(planner.df.dtypes)
            planner.df = planner.df.withColumns({n: (x.cast(kinds[n]) if n in kinds else x) for n, x in fresh.items()})

    def _delete(self, planner: Planner, g: GraphCatalog, c: A.Delete) -> None:
        planner.df = scratch_table(planner.start(), "rows")
        rels = [v for v in c.names if planner.scope.get(v).kind == "rel"]
        for v in rels:
            kinds = {r[0] for r in planner.df.select(col(name_of(v, "_type"))).distinct().collect()} - {None}
            for kind in kinds:
                t = g.rel(kind)
                mine = planner.df.where(col(name_of(v, "_type")) == kind).select(*[col(name_of(v, x)).alias(x) for x in (*t.df.columns, "_copy")])
                self._bind(g, t.name, mutate.remove_rels(t.df, mine))
        for v in c.names:
            if v in rels:
                continue
            b = planner.scope.get(v)
            if b.kind != "node" or not b.label:
                raise QueryError(f"cannot delete {v}")
            t = g.node(b.label)
            gone = planner.df.select(planner.key_of(v).alias("k")).where("k IS NOT NULL").distinct()
            for r in g.rels:
                for end, label in (("_src", r.src), ("_dst", r.dst)):
                    if label.upper() != t.name.upper():
                        continue
                    if c.detach:
                        self._bind(g, r.name, mutate.remove(g.rel(r.name).df, gone, [(end, "k")]))
                    elif not g.rel(r.name).df.join(gone, F.col(end) == F.col("k"), "left_semi").isEmpty():
                        raise QueryError(f"{t.name} has relationships left; use DETACH DELETE")
            self._bind(g, t.name, mutate.remove(t.df, gone, [(t.key, "k")]))


class Session:
    """Statements on one named database."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name

    @property
    def graph(self) -> GraphCatalog:
        return self.engine.databases.graph(self.name)

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        return self.engine.cypher(text, params, self.name)


__all__ = ["Engine", "LatticaError", "QueryResult", "Session"]
