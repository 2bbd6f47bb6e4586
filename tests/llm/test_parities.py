import numpy as np
import pytest

from lattica.llm import minhash


def test_no_similar_pair_is_out_of_reach(spark):
    """Random multisets of many sizes, with repeats: what is as similar as the threshold is always kept, and of pairs at
    similarity 0.7 of a few hundred shingles most are told apart."""
    rng = np.random.default_rng(7)
    rows, apart = [], []
    for _ in range(400):
        n = int(rng.integers(1, 1500))
        words = rng.integers(0, max(2, n // int(rng.integers(1, 4))), n).astype(np.int64)
        other = words.copy()
        for at in rng.integers(0, n, rng.integers(0, max(2, n // 20))):
            other[at] = rng.integers(1 << 40)
        if rng.random() < 0.5:
            other = np.concatenate([other, rng.integers(1 << 41, 1 << 42, rng.integers(0, n // 4 + 1))])
        x, y = minhash.shingles(words), minhash.shingles(other)
        rows.append((float(minhash.similarity(x, y)), [int(v) for v in minhash.parities(*x)], [int(v) for v in minhash.parities(*y)]))
    for _ in range(60):
        keys = rng.integers(1 << 60, size=340).astype(np.uint64)
        x, y = (np.unique(k, return_counts=True) for k in (keys[:290], keys[50:]))
        apart.append((float(minhash.similarity(x, y)), [int(v) for v in minhash.parities(*x)], [int(v) for v in minhash.parities(*y)]))
    df = spark.createDataFrame(rows + apart, "sim double, a array<long>, b array<long>")
    for threshold in (0.5, 0.8, 0.95):
        kept = minhash.reachable([df.a[i] for i in range(17)], [df.b[i] for i in range(17)], threshold)
        got = df.select("sim", kept.alias("kept")).collect()
        assert all(r.kept for r in got if r.sim >= threshold)
        assert sum(r.sim >= threshold for r in got) > 20
    assert sum(r.kept for r in df.select("sim", minhash.reachable([df.a[i] for i in range(17)], [df.b[i] for i in range(17)], 0.8).alias("kept")).collect()[400:]) < 10


def test_parities_of_little():
    one = minhash.parities(*minhash.shingles(np.array([5], np.int64)))
    assert one[0] == 1 and sum(bin(int(v) & (1 << 64) - 1).count("1") for v in one[1:]) == 1
    twice = minhash.parities(np.array([3], np.uint64), np.array([2]))
    assert twice[0] == 2 and not twice[1:].any()


@pytest.mark.parametrize("extra", ["root", "_h1", "_rows", "class_rows", "node", "h1"])
def test_columns_that_clash(spark, extra):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9)], f"doc_id long, text string, `{extra}` long")
    got = {r.doc_id: (r.class_id, r["class_rows"]) for r in minhash.label_classes(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
