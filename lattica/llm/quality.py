"""Quality scores by naive Bayes support vectors (Wang and Manning, 2012).

A text's features are indicators of n-grams: lower-case words (one and two) and token shapes (one to three: case,
digits, punctuation as it stands, and whether a token repeats the one before), hashed to a fixed width. Indicators are
scaled by the log-count ratio of the classes, normalised, and a linear hinge-loss model is fit to them by dual
coordinate descent (Hsieh et al., 2008). Every token of every text is read; the model is fit on a bounded sample.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, prepare
from .minhash import GOLD, M1, M2, mix

TOKEN = r"(?U)\w+|[^\w\s]+"
WIDTH = 1 << 18
#: At most so many labelled rows are used to fit, those with the smallest hashes of their doc_id.
MAX_ROWS = 8_000
#: Codes of tokens that a worker keeps while it has a task.
CACHE = 100_000
_known: dict[str, tuple[int, int]] = {}


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token
    kind = "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a" if token.islower() else "0" if token.isdigit() else "x"
    return "w" + kind


def _codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case token and of its shape."""
    from xxhash import xxh3_64_intdigest as h

    if len(_known) > CACHE:
        _known.clear()
    out = []
    for t in tokens:
        if (c := _known.get(t)) is None:
            c = _known[t] = h(t.lower().encode("utf-8", "surrogatepass")), h(_shape(t).encode("utf-8", "surrogatepass"))
        out.append(c)
    pair = np.array(out, np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def features(words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The distinct features of one text, sorted."""
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    s = np.where(again, mix(shapes + GOLD), shapes)
    grams = [mix(words ^ M1), mix(s ^ M2)]
    if len(words) > 1:
        grams += [mix(words[:-1] * GOLD + words[1:]), mix(s[:-1] * GOLD + s[1:] + M1)]
    if len(words) > 2:
        grams.append(mix((s[:-2] * GOLD + s[1:-1]) * GOLD + s[2:]))
    seen = np.zeros(WIDTH, bool)
    seen[(np.concatenate(grams) & np.uint64(WIDTH - 1)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def _each(column: pa.ListArray, step: int = 1_000_000):
    """The features of each row's tokens, a bounded number of tokens at once."""
    at, n = 0, len(column)
    offsets = column.offsets.to_numpy()
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1))
        part = column.slice(at, to - at)
        enc = part.flatten().dictionary_encode()
        words, shapes = _codes(enc.dictionary.to_pylist())
        which = enc.indices.to_numpy()
        words, shapes = words[which], shapes[which]
        for a, b in zip(offsets[at:to] - offsets[at], offsets[at + 1 : to + 1] - offsets[at]):
            yield features(words[a:b], shapes[a:b])
        at = to


def _forgetting(run):
    """run, and the tokens it remembers are forgotten when its task ends: idle workers stay small."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _known.clear()

    return task


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the indicators, their log-count ratios, and the bias. Without two classes all weights are 0."""
    y = np.where(labels > 0, 1.0, -1.0)
    zero = np.zeros(WIDTH, np.float32)
    if not len(y) or abs(y.sum()) == len(y):
        return zero, zero, float(np.sign(y.sum()))
    p, q = (np.full(WIDTH, alpha) for _ in range(2))
    for x, s in zip(rows, y):
        (p if s > 0 else q)[x] += 1
    r = np.log((p / p.sum()) / (q / q.sum()))
    cost = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    norm = np.array([max(1e-9, np.sqrt((r[x] ** 2).sum())) for x in rows])
    w, bias, a = np.zeros(WIDTH), 0.0, np.zeros(len(y))
    size = np.array([((r[x] / n) ** 2).sum() + 1 for x, n in zip(rows, norm)])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x = rows[i]
            v = r[x] / norm[i]  # not kept: the values of all rows are twice as large as the rows
            g = y[i] * (w[x] @ v + bias) - 1
            now = min(max(a[i] - g / size[i], 0), cost[i])
            if step := (now - a[i]) * y[i]:
                w[x] += step * v
                bias += step
                worst = max(worst, abs(now - a[i]))
                a[i] = now
        if worst < 1e-3:
            break
    return (w * r).astype(np.float32), (r * r).astype(np.float32), bias


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "quality") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled documents: of labels (doc_id, quality) the max_rows with the smallest hashes of doc_id."""
    prepare(docs.sparkSession)
    few = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    def run(batches):
        for b in batches:
            xs = pa.array([x.astype("<i4").tobytes() for x in _each(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), xs], names=["doc_id", "y", "x"])

    of = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", _tokens(F.col("text")).alias("t"))
    found = of.mapInArrow(_forgetting(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary").toArrow()
    ids, ys = found.column("doc_id").to_pylist(), found.column("y").to_pylist()
    xs = [np.frombuffer(x.as_buffer(), "<i4") for x in found.column("x")]  # views of what came: rows as objects would leave the driver's memory in pieces
    order = sorted(range(len(ids)), key=lambda i: (ids[i], ys[i]))
    same = itertools.groupby(order, key=lambda i: (ids[i], ys[i]))
    order = [i for _, of_one in same for i in sorted(of_one, key=lambda i: xs[i].tobytes())]
    try:
        return fit([xs[i] for i in order], np.array([ys[i] for i in order]))
    finally:
        del found, xs
        give_back()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs with score (0 to 1): the logistic of four times the margin. A null text is empty: the bias alone.

    All rows and columns stay; a column named score is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("score")
    v, r2, bias = model
    names = docs.columns

    def run(batches):
        for b in batches:
            out = []
            for x in _each(b.column(len(names))):
                n = float(r2[x].sum())
                margin = float(v[x].sum()) / n**0.5 + bias if n > 0 else bias
                out.append(1 / (1 + np.exp(-4 * margin)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.float64())], names=[*names, "score"])

    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.select(*names, _tokens(F.col("text")).alias("_tokens")).mapInArrow(_forgetting(run), out_type)


def learn_from(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the rows that may be learned from: crc32(doc_id) mod 3 is not 1."""
    return train(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
