"""Language-model scores by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps.

The restaurant of a context is that of the word before: every word that stands before another has one. The tables of
all context restaurants are customers of one parent, over all words, whose base is uniform over the words seen and one
for all others (Teh, 2006).

A dish of a restaurant (word and context) is a row, as are words and contexts. A sweep joins the dishes with the words'
parent probabilities and the contexts' totals as of the sweep before, seats all dishes independently and in parallel,
and sums the new tables by word and by context; only the sums over everything reach the driver. A dish of one customer
has one table whatever is drawn, so it is counted once and stands in no sweep. Sweeps draw from
hashes, so a lost task draws the same seating again. Predictive probabilities are averaged over the sweeps that follow
the burn-in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, drop_table, prepare, split_words, table
from .minhash import GOLD, mix

APART = " \t\n\v\f\r"  # stands in no word
END = "\n"  # no word holds it


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of x > 0."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def _quantile(u: np.ndarray, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A count of most draws of equal chance, with this mean, from a uniform number: by the binomial distribution while
    the mean is small, else by the normal one of its variance."""
    out = np.zeros_like(u)
    small = mean < 8
    if small.any():
        n, v = most[small], u[small]
        p = np.minimum(mean[small] / n, 1 - 1e-9)
        term, odds = np.exp(n * np.log1p(-p)), p / (1 - p)
        below, k = term.copy(), np.zeros_like(p)
        for i in range(1, 40):
            k += v > below
            term = term * np.maximum(0, n - i + 1) / i * odds
            below += term
        out[small] = k
    if not small.all():
        m, v, n = mean[~small], u[~small], most[~small]
        t = np.sqrt(-2 * np.log(np.minimum(v, 1 - v)))
        z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
        out[~small] = np.round(m + np.where(v < 0.5, -z, z) * np.sqrt(m * np.maximum(0, 1 - m / n)))
    return np.clip(out, 0, most)


def seat(c: np.ndarray, a: np.ndarray, d: float, seeds: np.ndarray, few: int = 24) -> np.ndarray:
    """Tables of dishes with c customers each, where a new table weighs a and old ones i - d*t in all.

    The first few customers sit down one by one. Then a dish that will have few tables goes from new table to new
    table, by the exact distribution of the customers between them; one with many takes customers in runs of a
    fiftieth of the weight so far, within which chances hardly change. So time grows with the logarithm of c. seeds: a
    64-bit word for each dish, the source of its random numbers, so that a sweep can be drawn again.
    """
    c, a = np.asarray(c, float), np.asarray(a, float)
    t = np.minimum(c, 1).astype(float)
    draw = lambda s, k: ((mix(s + np.array([k], np.uint64) * GOLD) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    live = np.flatnonzero(c > 1)
    for i in range(1, few):
        if not len(live):
            return t
        new = draw(seeds[live], i) * (i - d * t[live] + a[live]) < a[live]
        t[live] += new
        live = live[c[live] > i + 1]
    many = a[live] * np.log1p((c[live] - few) / (few + a[live])) > 8
    runs, live = live[many], live[~many]
    at, k = np.full(len(runs), float(few)), few
    while len(runs):
        k += 1
        n = np.minimum(c[runs] - at, np.maximum(1, np.floor((at + a[runs]) / 50)))
        p = a[runs] / (at - d * t[runs] + a[runs])
        p = a[runs] / (at + (n - 1) / 2 - d * (t[runs] + (n - 1) / 2 * np.minimum(1, p)) + a[runs])
        t[runs] += _quantile(draw(seeds[runs], k), n * np.minimum(1, p), n)
        at += n
        keep = at < c[runs]
        runs, at = runs[keep], at[keep]
    at, k = np.full(len(live), float(few)), few
    while len(live):
        k += 1
        u, td, aa, end = np.log(draw(seeds[live], k)), d * t[live], a[live], c[live]
        first = lgamma(at - td + aa) - lgamma(at - td)
        none = lambda j: lgamma(j - td) - lgamma(j - td + aa) + first  # noqa: E731  log probability of no new table up to customer j
        more = none(end) < u
        live, at, td, aa, end, u, first = (x[more] for x in (live, at, td, aa, end, u, first))
        lo, hi = at.copy(), end.copy()
        while (hi - lo > 1).any():
            mid = np.floor((lo + hi) / 2)
            below = none(mid) < u
            hi, lo = np.where(below, mid, hi), np.where(below, lo, mid)
        t[live] += 1
        keep = hi < end
        live, at = live[keep], hi[keep]
    return t


def discount(one: int, two: int) -> float:
    """The discount that the numbers of counts of one and of two suggest."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered, and the end; null is empty."""
    return F.array_append(split_words(text, APART), F.lit(END))


def _slices(batches, column: int, step: int = 1_000_000):
    """Of each batch the rows, a bounded number of tokens at once: batch, from, to, offsets, keys of the distinct words,
    which of them each token is, and which stands before it (the end at the start of a text: each text ends with it)."""
    from xxhash import xxh3_64_intdigest as h

    for b in batches:
        lists, at = b.column(column), 0
        offsets = lists.offsets.to_numpy()
        while at < len(b):
            to = min(len(b), max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1))
            enc = lists.slice(at, to - at).flatten().dictionary_encode()
            keys = np.array([h(w.encode("utf-8", "surrogatepass")) for w in enc.dictionary.to_pylist()], np.uint64).view(np.int64)
            bounds, which = offsets[at : to + 1] - offsets[at], enc.indices.to_numpy().astype(np.int64)
            before = np.empty(len(which), np.int64)
            before[1:] = which[:-1]
            before[bounds[:-1]] = which[bounds[1:] - 1]
            yield b, at, to, bounds, keys, which, before
            at = to


class Model:
    """A fitted model: dishes (key, ctx, p, the averaged predictive probability), words (key, c, p1, an array by kept
    sweep), contexts (ctx, customers, back, the weight of the parent by kept sweep), and the parent's probability of an
    unseen word."""

    def __init__(self, dishes: DataFrame | None, words: DataFrame | None, contexts: DataFrame | None, unseen: list[float], n: int, v: int):
        self.dishes, self.words, self.contexts, self.unseen, self.n, self.v = dishes, words, contexts, unseen, n, v


def _joined(batches, rows: int = 100_000):
    """Batches of small rows put together to about so many: seating is the same, and numpy works on longer arrays."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _seated(df: DataFrame, keys: list[str], turn: int, d: float) -> DataFrame:
    """df with t, the tables of n customers where a new table weighs a; drawn from the hashes of keys and turn."""

    def run(batches):
        for b in _joined(batches):
            seeds = np.full(len(b), turn + 1, np.uint64)
            for k in keys:
                seeds = mix(seeds * GOLD ^ b.column(k).to_numpy().view(np.uint64))
            t = seat(b.column("n").to_numpy(), b.column("a").to_numpy(), d, seeds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t)], names=[*b.schema.names, "t"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", t double")


def train(docs: DataFrame, burn: int = 1, kept: int = 2, theta: float = 1.0) -> Model:
    """Fit to every document of docs (text). Without documents every word has the same small probability."""
    prepare(docs.sparkSession)

    def count(batches):
        for _, _, _, _, keys, which, before in _slices(batches, 0):
            cell, n = np.unique(which * len(keys) + before, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[cell // len(keys)]), pa.array(keys[cell % len(keys)]), pa.array(n)], names=["key", "ctx", "n"])

    pairs = docs.select(words(F.col("text")).alias("w")).mapInArrow(count, "key long, ctx long, n long")
    dishes = table(pairs.groupBy("key", "ctx").agg(F.sum("n").alias("n")), "dishes")
    single = F.sum((F.col("n") == 1).cast("double")).alias("singles")
    known = table(dishes.groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("kinds"), single), "words")
    n, v, one1, two1 = (x or 0 for x in known.agg(F.sum("c"), F.count("*"), F.sum((F.col("kinds") == 1).cast("long")), F.sum((F.col("kinds") == 2).cast("long"))).first())
    if not v:
        return Model(None, None, None, [1.0], 0, 0)
    one, two = dishes.agg(F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    d2, d1 = discount(one, two), discount(one1, two1)
    every = table(dishes.groupBy("ctx").agg(F.sum("n").alias("customers"), F.count("*").cast("double").alias("tables"), single), "contexts")
    contexts, p1s, tables1 = every, known.select("key", (F.col("c") / n).alias("p1")), float(v)
    of_word, backs, unseen, spent = [], [], [], [known, every]

    def with_tables(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
        """rows with tables: one for each single customer, and those of the seated dishes."""
        return rows.join(sums, key, "left").withColumn("tables", F.col("singles") + F.coalesce("t", F.lit(0.0)))

    # a dish of one customer has one table in every sweep: only the others are seated
    seated = dishes.where("n > 1").select("key", "ctx", "n", F.lit(0.0).alias("t_sum"))
    for turn in range(burn + kept):
        a = ((theta + d2 * F.col("tables")) * F.col("p1")).alias("a")
        joined = seated.join(p1s, "key").join(contexts.select("ctx", "tables"), "ctx").select("key", "ctx", "n", "t_sum", a)
        mine = F.col("t") if turn >= burn else F.lit(0.0)
        drawn = table(_seated(joined, ["key", "ctx"], turn, d2).select("key", "ctx", "n", "t", (F.col("t_sum") + mine).alias("t_sum")), "seated")
        if turn:
            drop_table(seated)
        seated = drawn.drop("t")
        contexts = table(with_tables(every.select("ctx", "customers", "singles"), drawn.groupBy("ctx").agg(F.sum("t").alias("t")), "ctx").select("ctx", "customers", "tables"), "contexts")
        guests = with_tables(known.select("key", "singles"), drawn.groupBy("key").agg(F.sum("t").alias("t")), "key")
        guests = guests.select("key", F.col("tables").alias("n"), F.lit((theta + d1 * tables1) / (v + 1)).alias("a"))
        parent = table(_seated(guests, ["key"], turn, d1), "parent")
        spent += [contexts, parent]
        customers1, tables1 = parent.agg(F.sum("n"), F.sum("t")).first()
        base = (theta + d1 * tables1) / (v + 1)
        p1s = parent.select("key", ((F.col("n") - d1 * F.col("t") + base) / (theta + customers1)).alias("p1"))
        if turn >= burn:
            of_word.append(p1s)
            backs.append(contexts.select("ctx", ((theta + d2 * F.col("tables")) / (theta + F.col("customers"))).alias("back")))
            unseen.append(base / (theta + customers1))

    def gathered(rows: DataFrame, parts: list[DataFrame], key: str, value: str) -> DataFrame:
        for i, part in enumerate(parts):
            rows = rows.join(part.withColumnRenamed(value, f"{value}{i}"), key)
        return rows.withColumn(value, F.array(*[f"{value}{i}" for i in range(len(parts))])).drop(*[f"{value}{i}" for i in range(len(parts))])

    known = table(gathered(known.select("key", "c"), of_word, "key", "p1"), "known")
    contexts = table(gathered(every.select("ctx", "customers"), backs, "ctx", "back"), "backs")
    for old in spent:
        drop_table(old)
    all_dishes = dishes.where("n = 1").select("key", "ctx", "n", F.lit(float(kept)).alias("t_sum")).unionByName(seated)
    extra = (F.col("n") - d2 * F.col("t_sum") / kept) / (theta + F.col("customers"))
    fitted = all_dishes.join(known, "key").join(contexts, "ctx").select("key", "ctx", "c", (extra + _parents(F.col("p1"), F.col("back"), kept)).alias("p"))
    fitted = table(fitted, "fitted")
    drop_table(dishes)
    drop_table(seated)
    return Model(fitted, known, contexts, unseen, n, v)


def _parents(p1: Column, back: Column, kept: int) -> Column:
    """What the parent gives, averaged over the kept sweeps."""
    return sum((F.element_at(p1, k + 1) * F.element_at(back, k + 1) for k in range(kept)), F.lit(0.0)) / kept


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, doc, n_tokens, n_known, train_tokens, base_score, score of documents (doc_id, text). Each row counts.

    score is log10 of the averaged predictive probability, token by token; base_score that of the smoothed counts.
    doc numbers the rows. A context that no training text has leaves all to the parent.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b, at, to, bounds, keys, which, before in _slices(batches, 1):
            row = np.repeat(np.arange(to - at), np.diff(bounds))
            order = np.lexsort((before, which, row))
            r, w, u = row[order], which[order], before[order]
            start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]) | (u[1:] != u[:-1])][: len(r)])
            off = pa.array(np.searchsorted(r[start], np.arange(to - at + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (keys[w[start]], keys[u[start]], np.diff(np.r_[start, len(r)]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *lists], names=["doc_id", "key", "ctx", "m"])

    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    listed = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key array<long>, ctx array<long>, m array<long>")
    tokens = listed.withColumn("doc", F.monotonically_increasing_id()).select("doc", "doc_id", F.explode(F.arrays_zip("key", "ctx", "m")).alias("x")).select("doc", "doc_id", "x.key", "x.ctx", "x.m")
    unseen = F.array(*[F.lit(float(x)) for x in model.unseen])
    kept, m = len(model.unseen), F.col("m")
    sums = [F.sum(F.when(F.col("c").isNotNull(), m).otherwise(0)).alias("n_known"), F.sum(m * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("base"), F.sum(m * F.log10("p")).alias("score")]
    if model.dishes is None:
        found = tokens.select("doc", "doc_id", "m", F.lit(None).cast("long").alias("c"), F.lit(model.unseen[0]).alias("p"))
        found = found.groupBy("doc", "doc_id").agg(F.sum("m").alias("m"), *sums)
    else:
        # pairs that training texts have are summed at once; of the others key and ctx stay
        missed = [F.when(F.col("p").isNull(), F.col(k)).alias(k) for k in ("key", "ctx")]
        met = tokens.join(model.dishes, ["key", "ctx"], "left").select("doc", "doc_id", *missed, "m", "c", "p")
        met = table(met.groupBy("doc", "doc_id", "key", "ctx").agg(F.sum("m").alias("m"), *sums), "met")
        rest = met.where("key IS NOT NULL").select("doc", "doc_id", "key", "ctx", "m").join(model.words, "key", "left").join(model.contexts, "ctx", "left")
        back = F.coalesce("back", F.array(*[F.lit(1.0)] * kept))
        rest = rest.select("doc", "doc_id", "m", "c", _parents(F.coalesce("p1", unseen), back, kept).alias("p"))
        rest = rest.groupBy("doc", "doc_id").agg(F.sum("m").alias("m"), *sums)
        found = met.where("key IS NULL").drop("key", "ctx").unionByName(rest)
    whole = math.log10(model.n + 0.1 * (model.v + 1))
    found = found.groupBy("doc", "doc_id").agg(F.sum("m").alias("n_tokens"), *[F.sum(x).alias(x) for x in ("n_known", "base", "score")])
    return found.select(
        "doc_id", "doc", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score",
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """All documents, learned from those whose crc32(doc_id) mod 10 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 10) == 0
    model = train(docs.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
