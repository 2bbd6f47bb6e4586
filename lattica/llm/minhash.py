"""Near duplicates by BagMinHash signatures of weighted word shingles, banded and verified.

A document is a multiset of shingles of five words. For each shingle the weights are cut into the intervals [0, 1),
[1, 2), [2, 4), [4, 8)...; each interval holds a Poisson process over time whose rate is its length, and each point has
a register and a whole weight inside the interval. A document keeps the points below its weight of that shingle, and a
register remembers the first point in time that it gets. Two registers are equal with the probability of the weighted
Jaccard similarity (Ertl, 2018). Points are drawn from hashes in order of time, and only up to the time by which all
registers are full. Bands of registers make the candidates; the multisets themselves decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, key128, prepare, sized, small, table, tidy
from .linkage import group_buckets

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of hashed words and their counts; fewer words than size are one shingle, none is none."""
    w = words.astype(np.int64).view(np.uint64)
    if not len(w):
        return w, np.empty(0, np.int64)
    k = min(size, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * GOLD + w[i : len(w) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(h, return_counts=True)


def signature(keys: np.ndarray, counts: np.ndarray, m: int = 128) -> np.ndarray:
    """The BagMinHash of a multiset that is not empty: for each of m registers the name of its first point."""
    top = int(counts.max())
    level, low, high = [keys], [np.zeros(len(keys), np.int64)], [np.ones(len(keys), np.int64)]
    w = [counts]
    a = 1
    while a < top:
        sub = counts > a
        level.append(mix(keys[sub] + np.array([a], np.uint64) * GOLD))
        low.append(np.full(sub.sum(), a))
        high.append(np.full(sub.sum(), 2 * a))
        w.append(counts[sub])
        a *= 2
    key, lo, hi, w = (np.concatenate(x) for x in (level, low, high, w))
    rate = (hi - lo).astype(float)
    until = m * (np.log(m) + 3) / counts.sum()
    while True:
        regs, times, names = [], [], []
        live, at, t = np.arange(len(key)), 0, np.zeros(len(key))
        while len(live):
            k = int(min(64, max(1, (until - t[live].min()) * rate[live].min() + 2)))
            name = mix(key[live][:, None] + np.arange(at + 1, at + k + 1, dtype=np.uint64) * GOLD)
            gap = -np.log1p(-((name >> np.uint64(11)) * 2.0**-53)) / rate[live][:, None]
            time = t[live][:, None] + np.cumsum(gap, axis=1)
            more = mix(name ^ M1)
            place = lo[live][:, None] + ((more >> np.uint64(40)) * rate[live][:, None] * 2.0**-24).astype(np.int64)
            ok = (time <= until) & (place < w[live][:, None])
            regs.append((more[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m)
            times.append(time[ok])
            names.append(name[ok])
            t[live] = time[:, -1]
            live, at = live[time[:, -1] < until], at + k
        reg, time, name = (np.concatenate(x) for x in (regs, times, names))
        order = np.argsort(-time)
        out, full = np.zeros(m, np.uint64), np.zeros(m, bool)
        out[reg[order]] = name[order]  # the earliest is written last
        full[reg] = True
        if full.all():
            return out
        until *= 2


def bands(sig: np.ndarray, rows: int = 4) -> np.ndarray:
    """One hash for each run of rows registers, told apart by their places."""
    parts = sig.reshape(-1, rows)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64) * M2
    for i in range(rows):
        h = mix(h * GOLD + parts[:, i])
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers to a 64-bit word."""
    nibbles = (mix(sig) & np.uint64(15)).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def differing(a: list[Column], b: list[Column]) -> Column:
    """How many registers of two sketches differ."""

    def one(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    out = one(a[0], b[0])
    for x, y in zip(a[1:], b[1:]):
        out = out + one(x, y)
    return out


def parities(keys: np.ndarray, counts: np.ndarray, bits: int = 1024) -> np.ndarray:
    """How many shingles a multiset has, and for each of bits cells, into which hashes deal them, whether their number is
    odd, as 64-bit words."""
    odd = mix(keys[counts % 2 == 1] ^ M2) % np.uint64(bits)
    cells = (np.bincount(odd.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.concatenate([[counts.sum()], np.packbits(cells).view(np.int64)])


def reachable(a: list[Column], b: list[Column], threshold: float) -> Column:
    """Whether multisets with these parities may be as similar as threshold. No pair that is gets lost: shingles that only
    one of two multisets has number at least the cells that differ, and at least what one has more than the other; at
    similarity t they are (1 - t) / (1 + t) of the shingles of both."""
    cells = F.lit(0)
    for x, y in zip(a[1:], b[1:]):
        cells = cells + F.bit_count(x.bitwiseXOR(y))
    most = (a[0] + b[0]) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.abs(a[0] - b[0]) <= most) & (cells <= most)


def first_shared(a: list[Column], b: list[Column], bucket: Column) -> Column:
    """Whether bucket is the first band that documents with the bands a and b share: true in one of their buckets."""
    return F.coalesce(*[F.when(x == y, x) for x, y in zip(a, b)]) == bucket


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets of shingles; of two empty ones 1."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return both / either if either else 1.0


def hashed_words(text: Column) -> Column:
    """Hashes of the lower-case words of a text, in order; null has none."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.xxhash64(w))


def _node(words: Column) -> Column:
    """One number for texts of equal words; null for a text without words."""
    return F.when(F.size(words) > 0, F.xxhash64(words))


def _values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - (offsets[0] if len(offsets) else 0)


def signatures(docs: DataFrame, m: int = 128, rows: int = 4) -> DataFrame:
    """doc_id, h1, h2 (of the text), node, bands, sketch (its words, and then the parities) of documents (doc_id, text); a
    text without words has null for the last three."""
    prepare(docs.sparkSession)

    def run(batches):
        last = None
        for b in batches:
            flat, at = _values(b.column(4))
            nodes, out = b.column(3).to_pylist(), []
            for i, node in enumerate(nodes):
                if node is None:
                    out.append((None, None))
                    continue
                if last is None or last[0] != node:
                    bag = shingles(flat[at[i] : at[i + 1]])
                    sig = signature(*bag, m)
                    last = node, (bands(sig, rows), np.concatenate([sketch(sig), parities(*bag)]))
                out.append(last[1])
            lists = [pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *lists], names=["doc_id", "h1", "h2", "node", "bands", "sketch"])

    h1, h2 = key128(F.col("text"))
    hashed = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), hashed_words(F.col("text")).alias("words"))
    return hashed.select("doc_id", "h1", "h2", _node(F.col("words")).alias("node"), "words").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, node long, bands array<long>, sketch array<long>"
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, m: int = 128, rows: int = 4) -> DataFrame:
    """h1, h2 (hashes of a text) of every text of documents (doc_id, text) with words, root, a number that tells its
    class, class_id, the smallest doc_id of the class, and class_rows.

    Texts of equal words are one node. Nodes are linked if the weighted Jaccard similarity of their shingles of five
    words is at least threshold; classes are what links connect. Texts without words are in no class. Candidates share
    a band; those not met by way of a common head must also not differ in more registers than such texts do, and not in
    more shingles than such texts can.
    """
    signed = table(signatures(docs, m, rows), "signatures").where("node IS NOT NULL")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("text"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = table(nodes, "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = table(members.join(several, "bucket"), "shared")
    # the texts that can be asked for, fetched once by their hashes
    first = nodes.select("node", "text.h1", "text.h2").join(shared.select("node").distinct(), "node", "left_semi")
    h1, h2 = key128(F.col("text"))
    first = table(first, "first")
    keyed = docs.select("text", h1.alias("h1"), h2.alias("h2"))
    if small(first):
        texts = keyed.join(F.broadcast(first), ["h1", "h2"]).groupBy("h1", "h2", "node").agg(F.first("text").alias("text"))
    else:  # copies become one row before the shuffle, and the join is dealt as they are
        texts = keyed.groupBy("h1", "h2").agg(F.first("text").alias("text")).join(first, ["h1", "h2"])
    texts = table(texts.select("node", "text"), "texts", "zstd")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = table(pairs, "pairs")
        asked = sized(table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked"))
        some = texts.join(asked, "node", "left_semi")
        both = pairs.join(some.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").join(some.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def run(batches):
            last: tuple = (None, None)
            for b in batches:
                left, at = _values(b.column(2))
                right, to = _values(b.column(3))
                keep = []
                for i, a in enumerate(b.column(0).to_pylist()):
                    if last[0] != a:
                        last = a, shingles(left[at[i] : at[i + 1]])
                    keep.append(similarity(last[1], shingles(right[to[i] : to[i + 1]])) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

        hashed = both.select("a", "b", hashed_words(F.col("left")).alias("left"), hashed_words(F.col("right")).alias("right"))
        return hashed.mapInArrow(run, "a long, b long")

    # registers that differ: as many as leave a pair at the threshold out once in some hundred thousand times
    expected = (1 - threshold) * 15 / 16
    most = int(m * expected + 4.5 * (m * expected * (1 - expected)) ** 0.5)
    words, cells, places = [f"s{i}" for i in range(m // 16)], [f"p{i}" for i in range(17)], [f"b{i}" for i in range(m // rows)]
    of = lambda k, names: [F.col(f"{k}.{w}") for w in names]
    sketches = lambda some: nodes.join(some, "node", "left_semi").select("node", *[F.element_at("sketch", i + 1).alias(w) for i, w in enumerate(words + cells)], *[F.element_at("bands", i + 1).alias(w) for i, w in enumerate(places)])
    near = lambda x, y: (differing(of(x, words), of(y, words)) <= most) & reachable(of(x, cells), of(y, cells), threshold)
    once = lambda x, y: first_shared(of(x, places), of(y, places), F.col(f"{x}.bucket"))
    groups, _ = group_buckets(shared, verify, sketches, near, star_shared=2, rounds=2, once=once)
    rooted = nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id", "n")
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_rows"))
    of = table(rooted.join(classes, "root").select("node", "root", "class_id", "class_rows"), "classes")
    return signed.select("h1", "h2", "node").distinct().join(of, "node").select("h1", "h2", "root", "class_id", "class_rows")


def label_classes(docs: DataFrame, threshold: float = 0.8, root: str | None = None) -> DataFrame:
    """docs with class_id (the smallest doc_id of its near-duplicate class) and class_rows; other columns stay.

    A document without words is a class of its own: its own doc_id, 1 row. A null doc_id can only be the class_id of
    a class of nulls. doc_id may be of any type that has an order. Columns of docs with these names are replaced.
    root: a column of this name tells the classes apart, also where doc_ids repeat; it is null without words.
    """
    docs = docs.drop("class_id", "class_rows")
    a, b, c = (fresh(docs, x) for x in ("_h1", "_h2", "_rows"))
    found = lambda: near_duplicates(docs.select("doc_id", "text"), threshold)
    classes = tidy(lambda: table(found().select(F.col("h1").alias(a), F.col("h2").alias(b), "class_id", F.col("class_rows").alias(c), "root"), "labels"))
    # hashed before the join: a text that nobody asks for is not shuffled
    keyed = docs.withColumns(dict(zip((a, b), key128(F.col("text")))))
    more = [F.col(root)] if root else []
    joined = keyed.join(sized(classes.select(a, b, "class_id", c, *[F.col("root").alias(x) for x in (root,) if x])), [a, b], "left")
    return joined.select(*[keyed[x] for x in docs.columns], *more, F.when(F.col(c).isNull(), keyed["doc_id"]).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(c, F.lit(1)).alias("class_rows"))


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate class: doc_id, class_id, class_rows, keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return label_classes(docs).select("doc_id", "class_id", "class_rows", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"))
