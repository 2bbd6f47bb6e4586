"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds (term, doc, pos) for every occurrence, in any document, of a word that the benchmark uses; no other
posting can take part in a match. A window is a run of ``window`` words of an item. Of each window the two terms that
are rarest in the corpus are its anchors. Their postings, moved back by the anchor's place in the item, meet on the
same (doc, item, offset) only where both anchors stand at the right distance; every such meeting is then compared word
by word, so hashes never decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, sized, split_words, table

#: ASCII characters that stand in no word.
APART = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words(text: Column) -> Column:
    """Words of a text: A-Z lowered, then runs of a-z, 0-9 and all beyond ASCII. Null has none."""
    return split_words(text, APART)


def term_of(word: Column) -> Column:
    return F.hash(word)


def doc_of(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id (text; null: empty), words; items that repeat as a whole count once, empty ones not at all."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
    return table(rows.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "items")


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings term, doc, pos of documents (doc_id, text): all of them, or those of the terms in vocabulary (term)."""
    posted = docs.select(doc_of(F.col("doc_id"), F.col("text")).alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    posted = posted.select(term_of(F.col("word")).alias("term"), "doc", "pos")
    return table(posted if vocabulary is None else posted.join(sized(vocabulary), "term", "left_semi"), "postings")


def anchors_of(items: DataFrame, index: DataFrame, window: int, rarest: int = 2) -> DataFrame:
    """item, pos, term: the places of the rarest terms of each window that can occur; many windows share a place."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    span = F.least(F.lit(window), F.size("words"))
    starts = items.select("item", "words", span.alias("span"), F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("start"))
    places = starts.select("item", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.col("span"))).alias("at", "word"))
    places = places.select("item", "start", (F.col("start") + F.col("at")).alias("pos"), term_of(F.col("word")).alias("term"))
    counted = places.join(counts, "term", "left").fillna(0, ["n"])
    ranked = counted.select("item", "pos", "term", "n", F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "pos")).alias("k"), F.min("n").over(Window.partitionBy("item", "start")).alias("least"))
    return ranked.where((F.col("k") <= rarest) & (F.col("least") > 0)).select("item", "pos", "term").distinct()


def meetings(index: DataFrame, anchors: DataFrame, single: DataFrame) -> DataFrame:
    """doc, item, diag (document position of the item's word 0) where two anchors, or the only one, meet."""
    hits = index.join(sized(anchors.withColumnRenamed("pos", "place")), "term").select("doc", "item", (F.col("pos") - F.col("place")).alias("diag"), "place")
    met = hits.groupBy("doc", "item", "diag").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return met.join(sized(single.withColumn("alone", F.lit(True))), "item", "left").where(F.col("alone") | (F.col("a") < F.col("b"))).select("doc", "item", "diag")


def proximity_matches(index: DataFrame, items: DataFrame, window: int = 13, slop: int = 3) -> DataFrame:
    """doc_key, item, diag, drift: neighbouring anchors of one item that stand in a document in order, but up to slop
    words nearer or farther apart than in the item (0: exactly). doc_key is doc_of(doc_id, text)."""
    anchors = anchors_of(items, index, window).withColumnRenamed("pos", "place")
    hits = index.join(sized(anchors), "term").select("doc", "item", "place", "pos")
    near = Window.partitionBy("doc", "item").orderBy("pos", "place")
    pairs = hits.select("*", F.lag("place").over(near).alias("p0"), F.lag("pos").over(near).alias("q0"))
    drift = (F.col("pos") - F.col("q0")) - (F.col("place") - F.col("p0"))
    ok = (F.col("place") > F.col("p0")) & (F.col("place") - F.col("p0") < window) & (F.abs(drift) <= slop)
    return pairs.where(ok).select(F.col("doc").alias("doc_key"), "item", (F.col("q0") - F.col("p0")).alias("diag"), drift.alias("drift")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05) -> DataFrame:
    """All columns of docs with n_words, hits (positions of hit words, from 0), items (ids as text, sorted) and
    contaminated (some word is hit, and at least share of the words).

    An item shorter than the window, but not empty, is one window. Null texts have no words and are clean. Rows that
    repeat are each judged; null ids are ids like others. Columns of docs with the names of results are replaced.
    """
    docs = docs.drop("n_words", "hits", "items", "contaminated")
    items = items_of(benchmark)
    terms = items.select(F.explode("words").alias("word")).select(term_of(F.col("word")).alias("term")).distinct()
    index = build_index(docs.select("doc_id", "text"), terms)
    anchors = table(anchors_of(items, index, window), "anchors")
    found = meetings(index, anchors, items.where(F.size("words") == 1).select("item"))
    of, met, key, result = (fresh(docs, x) for x in ("_of", "_found", "_doc", "_judged"))
    found = found.join(sized(items), "item").groupBy(F.col("doc").alias(of)).agg(F.collect_list(F.struct("item_id", "diag", "words")).alias(met))
    keyed = docs.withColumn(key, doc_of(F.col("doc_id"), F.col("text")))
    joined = keyed.join(found, F.col(key) == F.col(of), "left").drop(of, key)

    def starts(w, c):
        span = F.least(F.lit(window), F.size(c["words"]))

        def same(s):
            at = c["diag"] + s
            return F.when((at >= 0) & (at + span <= F.size(w)), F.slice(w, at + 1, span) == F.slice(c["words"], s + 1, span)).otherwise(False)

        return F.struct(c["item_id"].alias("item_id"), c["diag"].alias("diag"), span.alias("span"), F.filter(F.sequence(F.lit(0), F.size(c["words"]) - span), same).alias("starts"))

    def judge(w):
        checked = F.filter(F.transform(F.col(met), lambda c: starts(w, c)), lambda c: F.size(c["starts"]) > 0)
        hit = lambda cs: F.array_sort(F.array_distinct(F.flatten(F.flatten(F.transform(cs, lambda c: F.transform(c["starts"], lambda s: F.sequence(c["diag"] + s, c["diag"] + s + c["span"] - 1)))))))
        out = lambda cs: F.struct(hit(cs).alias("hits"), F.array_sort(F.array_distinct(F.transform(cs, lambda c: c["item_id"]))).alias("items"))
        return F.struct(F.size(w).cast("long").alias("n_words"), let(checked, out).alias("found"))

    # only where something was found are the words compared; the others' are cut where their number is asked for
    judged = joined.withColumn(result, F.when(F.col(met).isNotNull(), let(words(F.col("text")), judge))).drop(met)
    of_result = lambda name, kind: F.coalesce(f"{result}.found.{name}", F.array().cast(f"array<{kind}>")).alias(name)
    n_words = F.when(F.col(result).isNotNull(), F.col(f"{result}.n_words")).otherwise(F.size(words(F.col("text"))).cast("long"))
    n = F.size(f"{result}.found.hits")
    contaminated = F.when(F.col(result).isNull(), False).otherwise((n > 0) & (n >= F.col(f"{result}.n_words") * F.lit(share).cast("decimal(9,6)")))
    return judged.select(*docs.columns, n_words.alias("n_words"), of_result("hits", "int"), of_result("items", "string"), contaminated.alias("contaminated"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 13 words, a twentieth of the words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Of the table {docs} (doc_id, text): rid, doc_id, n_words, n_hit, n_items, items_sha256.
JUDGED = f"""
d AS (SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM {{docs}}),
b AS (SELECT DISTINCT item_id, {_W} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, w[s + 1 : s + l] AS win FROM (SELECT *, unnest(range(0, len(w) - l + 1)) AS s FROM (SELECT *, least(13, len(w)) AS l FROM b WHERE len(w) > 0))),
dw AS (SELECT rid, s, l, w[s + 1 : s + l] AS win FROM (SELECT rid, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
m AS (SELECT rid, s, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM m) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY rid),
j AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256
      FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid))"""
ORACLE = "WITH " + JUDGED.format(docs="documents") + "\nSELECT doc_id, n_words, n_hit, n_items, items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM j"
