"""CSV in and out of graph tables, bound to their schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import GraphCatalog
from ..errors import QueryError
from ..operators.dedup import one_per_key
from ..operators.mutate import append, insert_nodes
from ..operators.paths import scratch_table

_BAD = "_corrupt_record"


@dataclass
class LoadResult:
    table: str
    loaded: int
    errors: int


def _header(spark, path: str, sep: str) -> list[str]:
    rows = spark.read.option("header", False).option("sep", sep).csv(path).limit(1).collect()
    if not rows:
        raise QueryError(f"{path} is empty")
    return [str(x).strip() if x is not None else "" for x in rows[0]]


def read_checked(spark, path: str, schema: T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV read by schema, stored, with the column _corrupt_record of rows that are too short, too long or ill-typed.

    All columns are read before anything is counted: column pruning would let ill-typed values pass.
    """
    whole = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    df = spark.read.schema(whole).option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).option("enforceSchema", True).csv(path)
    return scratch_table(df, "csv")


def _ordered(fields: dict[str, T.StructField], names: list[str], table: str) -> T.StructType:
    by = {n.lower(): f for n, f in fields.items()}
    unknown = [n for n in names if n.lower() not in by]
    if unknown:
        raise QueryError(f"{table} has no column {', '.join(unknown)}")
    return T.StructType([T.StructField(by[n.lower()].name, by[n.lower()].dataType) for n in names])


def _take(df: DataFrame, strict: bool, table: str) -> tuple[DataFrame, int]:
    bad = df.where(F.col(_BAD).isNotNull()).count()
    if bad and strict:
        raise QueryError(f"{table}: {bad} malformed rows")
    return df.where(F.col(_BAD).isNull()).drop(_BAD), bad


def load_nodes(graph: GraphCatalog, table: str, path: str, header: bool = True, strict: bool = True, sep: str = ",") -> LoadResult:
    """Append a CSV of nodes. Its header names columns in any case and order, the key among them; without one the
    columns are the table's. strict: any malformed row fails the load; else such rows are left out and counted. A key
    that is null, repeated, or in the table already fails the load."""
    t = graph.node(table)
    names = _header(graph.spark, path, sep) if header else t.props
    if t.key.lower() not in [n.lower() for n in names]:
        raise QueryError(f"{table}: the key column {t.key} is missing")
    schema = _ordered({f.name: f for f in t.df.schema}, names, table)
    good, bad = _take(read_checked(graph.spark, path, schema, header, sep), strict, table)
    graph.bind(t.name, insert_nodes(t.df, good, t.key))
    return LoadResult(t.name, good.count(), bad)


def put_edges(graph: GraphCatalog, table: str, good: DataFrame, ends: str = "report") -> DataFrame:
    """Append stored rows (_src, _dst, properties) to a relationship table; what was appended. ends: see load_edges."""
    t = graph.rel(table)
    if ends == "skip":
        for c, label in (("_src", t.src), ("_dst", t.dst)):
            n = graph.node(label)
            good = good.join(n.df.select(F.col(n.key).alias(c)).distinct(), c, "left_semi").select(*good.columns)
        good = scratch_table(good, "edges")
    elif ends == "create":
        for c, label in (("_src", t.src), ("_dst", t.dst)):
            n = graph.node(label)
            fresh = good.select(F.col(c).alias(n.key)).where(F.col(n.key).isNotNull()).distinct().join(n.df.select(n.key), n.key, "left_anti")
            graph.bind(n.name, append(n.df, scratch_table(fresh, "ends")))
    graph.bind(t.name, append(t.df, good))
    return good


def load_edges(graph: GraphCatalog, table: str, path: str, header: bool = True, strict: bool = True, ends: str = "report", sep: str = ",") -> LoadResult:
    """Append a CSV of relationships: the first two columns are the keys of the ends, the rest properties.

    ends: what to do where an end has no node: 'report' loads the row all the same (see missing_ends), 'skip' leaves it
    out, 'create' adds nodes with nothing but the key.
    """
    t = graph.rel(table)
    names = _header(graph.spark, path, sep) if header else ["_src", "_dst", *t.props]
    if len(names) < 2:
        raise QueryError(f"{table}: two key columns are needed")
    fields = {f.name: f for f in t.df.schema}
    schema = T.StructType([T.StructField(c, fields[c].dataType) for c in ("_src", "_dst")] + _ordered({n: f for n, f in fields.items() if n in t.props}, names[2:], table).fields)
    good, bad = _take(read_checked(graph.spark, path, schema, header, sep), strict, table)
    return LoadResult(t.name, put_edges(graph, table, good, ends).count(), bad)


def missing_ends(graph: GraphCatalog, table: str) -> DataFrame:
    """(side, key) of ends of relationships that have no node."""
    t = graph.rel(table)
    parts = []
    for c, label in (("_src", t.src), ("_dst", t.dst)):
        n = graph.node(label)
        keys = t.df.select(F.lit(c[1:]).alias("side"), F.col(c).cast("string").alias("key"))
        parts.append(keys.join(n.df.select(F.col(n.key).cast("string").alias("key")), "key", "left_anti").select("side", "key"))
    return parts[0].unionByName(parts[1]).distinct()


def export_nodes(graph: GraphCatalog, table: str) -> DataFrame:
    """The nodes with columns by name, one row per key (the most complete one)."""
    t = graph.node(table)
    return one_per_key(t.df, t.key).select(*sorted(t.props))


def export_edges(graph: GraphCatalog, table: str, keep_parallel: bool = False) -> DataFrame:
    """from, to and properties by name; one row for each pair of ends (the smallest), or all of them."""
    t = graph.rel(table)
    rows = t.df.select(F.col("_src").alias("from"), F.col("_dst").alias("to"), *sorted(t.props))
    if keep_parallel:
        return rows
    least = F.min(F.struct(*[F.col(f"`{p}`") for p in sorted(t.props)])).alias("p") if t.props else F.lit(None).alias("p")
    out = rows.groupBy("from", "to").agg(least)
    return out.select("from", "to", *[F.col(f"p.`{p}`").alias(p) for p in sorted(t.props)])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; null is empty."""
    df.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def _literal(c, kind: T.DataType):
    """A column's values as text of the query language."""
    if isinstance(kind, T.StringType):
        for raw, safe in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return F.concat(F.lit("'"), c, F.lit("'"))
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.concat(F.lit("date('" if isinstance(kind, T.DateType) else "timestamp('"), c.cast("string"), F.lit("')"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = c.cast("string")
        return F.when(text.isin("NaN", "Infinity", "-Infinity"), F.concat(F.lit("toFloat('"), text, F.lit("')"))).otherwise(text)
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: F.coalesce(_literal(x, kind.elementType), F.lit("NULL")))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
    return c.cast("string")


def _props(fields: list[T.StructField]):
    """{name: value, ...} without the nulls."""
    if not fields:
        return F.lit("")
    pairs = F.array_compact(F.array(*[F.concat(F.lit(f"`{f.name}`: "), _literal(F.col(f"`{f.name}`"), f.dataType)) for f in fields]))
    return F.when(F.size(pairs) > 0, F.concat(F.lit(" {"), F.array_join(pairs, ", "), F.lit("}"))).otherwise("")


def to_statements(graph: GraphCatalog, table: str) -> DataFrame:
    """statement: a CREATE for each node or relationship of a table, null properties left out; run_statements runs them.

    Relationships find their ends by key, so nodes go first. One without an end's key has no statement.
    """
    if any(n.name.upper() == table.upper() for n in graph.nodes):
        t = graph.node(table)
        return t.df.select(F.concat(F.lit(f"CREATE (:{t.name}"), _props(t.df.schema.fields), F.lit(")")).alias("statement"))
    r = graph.rel(table)
    end = lambda v, label, c: F.concat(F.lit(f"({v}:{label} {{`{graph.node(label).key}`: "), _literal(F.col(c), r.df.schema[c].dataType), F.lit("})"))
    props = _props([f for f in r.df.schema if f.name in r.props])
    line = F.concat(F.lit("MATCH "), end("a", r.src, "_src"), F.lit(", "), end("b", r.dst, "_dst"), F.lit(f" CREATE (a)-[:{r.name}"), props, F.lit("]->(b)"))
    return r.df.where("_src IS NOT NULL AND _dst IS NOT NULL").select(line.alias("statement"))


def run_statements(engine, statements: DataFrame, database: str = "default") -> tuple[int, int]:
    """Run the statements of a DataFrame one after another, a partition of them on the driver at a time; how many ran and
    how many failed. For whole tables the CSV or snapshot functions load without a plan for each row."""
    ran = failed = 0
    for (line,) in statements.select("statement").toLocalIterator():
        try:
            engine.cypher(line, database=database)
            ran += 1
        except Exception:  # noqa: BLE001  a statement that fails is counted, and the next one runs
            failed += 1
    return ran, failed
