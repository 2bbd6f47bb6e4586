"""Graphs and databases: node and relationship tables with their keys, and the life of named databases."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DatabaseError, QueryError
from .types import to_name


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one label; key is the column of the primary key."""

    name: str
    df: DataFrame
    key: str

    @property
    def props(self) -> list[str]:
        return self.df.columns


@dataclass(frozen=True)
class RelTable:
    """Relationships of one type: columns _src and _dst hold keys of the two labels, the others are properties."""

    name: str
    df: DataFrame
    src: str
    dst: str

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_src", "_dst")]


class GraphCatalog:
    """The tables of one graph. Names are case-insensitive; a change binds a new DataFrame and never alters one."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._nodes: dict[str, NodeTable] = {}
        self._rels: dict[str, RelTable] = {}
        self.delivered: dict[str, int] = {}  # table -> the last batch of an ingest queue that it holds

    @property
    def nodes(self) -> list[NodeTable]:
        return list(self._nodes.values())

    @property
    def rels(self) -> list[RelTable]:
        return list(self._rels.values())

    def add_node(self, name: str, df: DataFrame, key: str) -> NodeTable:
        if key not in df.columns:
            raise QueryError(f"table {name} has no column {key}")
        out = self._nodes[name.upper()] = NodeTable(name, df, key)
        return out

    def add_rel(self, name: str, df: DataFrame, src: str, dst: str) -> RelTable:
        if not {"_src", "_dst"} <= set(df.columns):
            raise QueryError(f"table {name} needs the columns _src and _dst")
        out = self._rels[name.upper()] = RelTable(name, df, self.node(src).name, self.node(dst).name)
        return out

    def node(self, name: str) -> NodeTable:
        if name.upper() not in self._nodes:
            raise QueryError(f"no node table {name}")
        return self._nodes[name.upper()]

    def rel(self, name: str) -> RelTable:
        if name.upper() not in self._rels:
            raise QueryError(f"no relationship table {name}")
        return self._rels[name.upper()]

    def has(self, name: str) -> bool:
        return name.upper() in self._nodes or name.upper() in self._rels

    def bind(self, name: str, df: DataFrame) -> None:
        """Put df in place of a table's rows."""
        of = self._nodes if name.upper() in self._nodes else self._rels
        of[name.upper()] = replace(of[name.upper()], df=df)

    def drop(self, name: str, missing_ok: bool = False) -> None:
        if name.upper() in self._rels:
            del self._rels[name.upper()]
        elif name.upper() in self._nodes:
            if used := [r.name for r in self.rels if name.upper() in (r.src.upper(), r.dst.upper())]:
                raise QueryError(f"table {name} is an end of {', '.join(used)}")
            del self._nodes[name.upper()]
        elif not missing_ok:
            raise QueryError(f"no table {name}")

    def rename(self, name: str, to: str) -> None:
        of = self._nodes if name.upper() in self._nodes else self._rels
        if name.upper() not in of or self.has(to):
            raise QueryError(f"cannot rename {name} to {to}")
        old = of.pop(name.upper())
        of[to.upper()] = replace(old, name=to)
        for k, r in self._rels.items():
            self._rels[k] = replace(r, src=to if r.src == old.name else r.src, dst=to if r.dst == old.name else r.dst)

    def show_tables(self) -> DataFrame:
        rows = [(n.name, "NODE", n.key, None, None) for n in self.nodes] + [(r.name, "REL", None, r.src, r.dst) for r in self.rels]
        return self.spark.createDataFrame(rows, "name string, type string, `primary key` string, `from` string, `to` string")

    def table_info(self, name: str) -> DataFrame:
        if name.upper() in self._nodes:
            t = self._nodes[name.upper()]
            fields, key = t.df.schema.fields, t.key
        else:
            fields, key = [f for f in self.rel(name).df.schema.fields if f.name not in ("_src", "_dst")], None
        rows = [(i, f.name, to_name(f.dataType), "NULL", f.name == key) for i, f in enumerate(fields)]
        return self.spark.createDataFrame(rows, "`property id` int, name string, type string, `default expression` string, `primary key` boolean")

    def empty(self, fields: Iterable[tuple[str, T.DataType]]) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in fields]))


NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")
ONLINE, STOPPED, DELETED = "ONLINE", "STOPPED", "DELETED"


@dataclass
class Database:
    name: str
    shard_ids: list[int]
    state: str = ONLINE
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: float = field(default_factory=time.time)


class Databases:
    """Named databases and their states: ONLINE and STOPPED by turns, DELETED as a tombstone that keeps the name taken."""

    MOST, MOST_SHARDS = 64, 256

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._all: dict[str, Database] = {}
        self._graphs: dict[str, GraphCatalog] = {}
        self._next = 0

    def create(self, name: str, shards: int = 3) -> Database:
        name = name.lower()
        if not NAME.fullmatch(name):
            raise DatabaseError(f"bad database name {name!r}")
        if name in self._all:
            raise DatabaseError(f"database {name} exists" if self._all[name].state != DELETED else f"database {name} was dropped; remove its tombstone first")
        if not 1 <= shards <= self.MOST_SHARDS:
            raise DatabaseError(f"shards must be from 1 to {self.MOST_SHARDS}")
        if sum(d.state != DELETED for d in self._all.values()) >= self.MOST:
            raise DatabaseError(f"more than {self.MOST} databases")
        db = self._all[name] = Database(name, list(range(self._next, self._next + shards)))
        self._next += shards
        self._graphs[name] = GraphCatalog(self.spark)
        return db

    def get(self, name: str) -> Database:
        if (db := self._all.get(name.lower())) is None or db.state == DELETED:
            raise DatabaseError(f"database {name} not found")
        return db

    def _move(self, name: str, to: str, allowed: tuple[str, ...]) -> Database:
        db = self.get(name)
        if db.state not in allowed:
            raise DatabaseError(f"database {name} is {db.state}")
        db.state = to
        return db

    def stop(self, name: str) -> Database:
        return self._move(name, STOPPED, (ONLINE,))

    def start(self, name: str) -> Database:
        return self._move(name, ONLINE, (STOPPED,))

    def drop(self, name: str) -> Database:
        db = self._move(name, DELETED, (ONLINE, STOPPED))
        self._graphs.pop(db.name, None)
        return db

    def remove_tombstone(self, name: str) -> None:
        if (db := self._all.get(name.lower())) is None or db.state != DELETED:
            raise DatabaseError(f"database {name} has no tombstone")
        del self._all[name.lower()]

    def graph(self, name: str) -> GraphCatalog:
        db = self.get(name)
        if db.state != ONLINE:
            raise DatabaseError(f"database {name} is {db.state}")
        return self._graphs[db.name]

    def owner(self, shard_id: int) -> str | None:
        return next((d.name for d in self._all.values() if shard_id in d.shard_ids and d.state != DELETED), None)

    def list(self) -> list[Database]:
        return sorted((d for d in self._all.values() if d.state != DELETED), key=lambda d: d.name)

    def show(self) -> DataFrame:
        rows = [(d.name, d.id, d.state, len(d.shard_ids), d.shard_ids, d.created_at) for d in self.list()]
        df = self.spark.createDataFrame(rows, "name string, id string, state string, shard_count int, shard_ids array<int>, at double")
        return df.select("name", "id", "state", "shard_count", F.col("at").cast("timestamp").alias("created_at"), "shard_ids")

    def dump(self) -> str:
        return json.dumps({"next": self._next, "databases": [vars(d) for d in self._all.values()]})

    def load(self, text: str) -> None:
        got = json.loads(text)
        self._next = got["next"]
        self._all = {d["name"]: Database(**d) for d in got["databases"]}
        self._graphs = {n: self._graphs.get(n) or GraphCatalog(self.spark) for n, d in self._all.items() if d.state != DELETED}
