import zlib
from collections import Counter

import numpy as np

from lattica.llm import packing


def check_packed(rows, texts):
    """The contract, by brute force: ids of the tokenizer itself, cuts, no overlap, no gap."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_paths()[0])
    want = Counter()
    for doc, text in texts:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    return len(by), -(-sum(r.length for r in rows) // 1024)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    used, least = check_packed(packing.op7_pack(spark, sf).collect(), [(d.doc_id, d.text) for d in docs])
    assert used <= least * 1.05 + 2


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "x" * 5000 + " é   \n\n  it's 12³ <|endoftext|> a  \t"), (None, "a b"), (4, "日本 🤖'll" * 2000)]
    docs = spark.createDataFrame([(*r, "z", 7) for r in rows], "doc_id long, text string, length string, piece int")
    check_packed(packing.pack(packing.table(packing.cut_documents(docs), "p")).collect(), rows)
    assert packing.pack(packing.table(packing.cut_documents(docs.limit(0)), "p")).count() == 0


def test_plan_holds_all():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1025, 3000), rng.integers(240, 600, 5000), np.full(7, 1024), np.array([1])):
        counts = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
        for groups in (0, 20, 80):
            held = Counter()
            for n, sizes in packing.make_plan(counts, 1024, groups):
                assert sum(sizes) <= 1024
                for s in sizes:
                    held[s] += n
            assert held == counts


def test_grouping_is_near_the_bound():
    """Linear grouping alone: at most a thousandth and a few sequences over the volume, or over best-fit decreasing."""
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 1025, 30000), np.minimum(1024, rng.lognormal(5.5, 1, 50000).astype(int) + 1), rng.integers(345, 700, 20000)):
        counts = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
        grouped, plain = (sum(n for n, _ in packing.make_plan(counts, 1024, g)) for g in (packing.GROUPS, 0))
        assert grouped <= max(-(-int(lengths.sum()) // 1024), plain) * 1.001 + 3
