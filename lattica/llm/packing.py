"""Best-fit packing of tokenised documents into fixed-length sequences by a linear grouping scheme.

Lengths are at most the capacity, so however many documents there are, the plan is made from a histogram of at most
``capacity`` counts. Large lengths (over a third of the capacity, so at most two share a sequence) are sorted and cut
into groups of equal cardinality; each group counts as its longest length. Column generation finds the best mix of
configurations of the few rounded lengths; its whole parts are kept, the actual documents of each group are put in the
places, and what is left of the large ones and all small ones go best-fit into the room that remains. The plan is a
list of runs (this many sequences with these lengths); documents find their places by their rank among equals.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, sized, table

#: The pattern that cuts a text into the pieces that byte-level BPE merges within (fixed value of the public tokenizer).
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
END_ID = 2
#: Groups of the large documents: each holds one of so many parts of them, so rounding up costs little.
GROUPS = 4_000
#: Cached pieces of a worker, and tokens handled at once.
CACHE, STEP = 100_000, 1_000_000


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


@cache
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _cache(path: str) -> dict[str, bytes]:
    return {}


def _encode(pieces: list[str], path: str) -> list[bytes]:
    """The ids of each piece as little-endian 32-bit words."""
    known = _cache(path)
    if len(known) > CACHE:
        known.clear()
    bpe = _ranks(path)._core_bpe
    out = []
    for p in pieces:
        if (ids := known.get(p)) is None:
            ids = known[p] = np.array(bpe.encode_single_piece(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        out.append(ids)
    return out


def cut_documents(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise documents (doc_id, text), end each with END_ID and cut those over the capacity.

    Returns doc_id, piece, start, length, ids_crc32, and ids if keep_ids. The first piece of a long document takes what
    is over full pieces. A null text is empty: one piece of length 1. Each row is a document, also where ids repeat.
    The text is cut into BPE pieces by the JVM; each distinct piece of a batch is then merged once by a table of ranks
    of the same vocabulary, which gives the ids of the tokenizer file. A text with the special string takes the
    tokenizer itself.
    """
    prepare(docs.sparkSession)
    whole_path, ranks_path = paths or tokenizer_paths()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.uint32()))] * keep_ids)

    def rows(doc, ids):
        n = len(ids)
        first = n % capacity or min(n, capacity)
        cuts = [0, *range(first, n + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield (doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) + ((ids[a:b],) if keep_ids else ())

    def run(batches):
        for batch in batches:
            n = len(batch)
            offsets = batch.column(1).offsets.to_numpy() if n else np.zeros(1, np.int64)
            at = 0
            while at < n:
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1)
                part = batch.slice(at, min(upto, n) - at)
                at += len(part)
                enc = part.column(1).flatten().dictionary_encode()
                codes = _encode(enc.dictionary.to_pylist(), ranks_path)
                flat, size = np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4
                which = enc.indices.to_numpy()
                each = size[which] if len(which) else np.empty(0, np.int64)
                ends = np.cumsum(each)
                begin = (np.cumsum(size) - size)[which] if len(which) else each
                ids = flat[np.repeat(begin - ends + each, each) + np.arange(ends[-1])] if len(which) else flat
                bounds = np.concatenate([[0], ends])[part.column(1).offsets.to_numpy() - part.column(1).offsets[0].as_py()]
                out = []
                special = part.column(2)
                for i, doc in enumerate(part.column(0).to_pylist()):
                    if special[i].is_valid:
                        own = np.array(_whole(whole_path).encode(special[i].as_py(), add_special_tokens=False).ids, "<u4")
                    else:
                        own = ids[bounds[i] : bounds[i + 1]]
                    out += rows(doc, np.append(own, np.array([END_ID], "<u4")))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    text = F.coalesce("text", F.lit(""))
    odd = F.contains(text, F.lit(SPECIAL))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(F.when(odd, "").otherwise(text), F.lit(PATTERN), F.lit(0)).alias("parts"), F.when(odd, text).alias("special"))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _cache(ranks_path).clear()  # idle workers stay small

    return parts.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


# ---------------------------------------------------------------- the plan


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """How often to use which configuration (counts by size): column generation for sizes of which at most four share a sequence."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    i, j = np.triu_indices(k)
    both = sizes[i] + sizes[j]
    fits = both <= capacity
    i, j, both = i[fits], j[fits], both[fits]
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        one, two = np.zeros(capacity + 1), np.zeros(capacity + 1)
        np.maximum.at(one, sizes, dual)
        np.maximum.at(two, both, dual[i] + dual[j])
        two = np.maximum.accumulate(np.maximum(one, two))
        room = int(np.argmax(two + two[::-1]))
        if two[room] + two[capacity - room] <= 1 + 1e-9:
            break
        new = np.zeros(k)
        for r in (room, capacity - room):
            if two[r] > 0:
                pair = np.flatnonzero((both <= r) & (dual[i] + dual[j] >= two[r] - 1e-12))
                if len(pair):
                    new[i[pair[0]]] += 1
                    new[j[pair[0]]] += 1
                else:
                    new[np.flatnonzero((sizes <= r) & (dual >= two[r] - 1e-12))[0]] += 1
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(0, x - ratio[out] * step)
        x[out] = ratio[out]
        columns[:, out] = new
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return [(columns[:, c].astype(int), float(x[c])) for c in range(k) if x[c] >= 1]


def make_plan(counts: dict[int, int], capacity: int = 1024, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Runs (number of sequences, lengths in each) that hold counts[length] documents of each length, none left out.

    Without groups it is best-fit decreasing alone, to compare with.
    """
    left = {s: int(c) for s, c in counts.items() if c}
    runs: list[tuple[int, list[int]]] = []
    if c := left.pop(capacity, 0):
        runs.append((c, [capacity]))
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    total = sum(left[s] for s in large)
    opened: list[tuple[int, list[int]]] = []
    if groups and total:
        pools: list[list[list[int]]] = []
        quota, room = -(-total // groups), 0
        for s in large:
            c = left[s]
            while c:
                if not room:
                    pools.append([])
                    room = quota
                n = min(c, room)
                pools[-1].append([s, n])
                c, room = c - n, room - n
        merged: dict[int, list[list[int]]] = {}  # groups of one rounded length count together
        for pool in pools:
            merged.setdefault(pool[0][0], []).extend(pool)
        sizes = np.array(list(merged))
        for config, times in configurations(sizes, np.array([float(sum(n for _, n in p)) for p in merged.values()]), capacity):
            slots = [merged[int(sizes[g])] for g in np.flatnonzero(config) for _ in range(config[g])]
            n = min([int(times + 1e-6), *(sum(c for _, c in merged[int(sizes[g])]) // config[g] for g in np.flatnonzero(config))])
            taken = []  # for each place, the actual lengths of its n documents, as runs
            for pool in slots:
                need, own = n, []
                while need:
                    m = min(need, pool[0][1])
                    own.append([pool[0][0], m])
                    pool[0][1] -= m
                    need -= m
                    if not pool[0][1]:
                        pool.pop(0)
                taken.append(own)
            while n:
                m = min(own[0][1] for own in taken)
                opened.append((m, [own[0][0] for own in taken]))
                n -= m
                for own in taken:
                    own[0][1] -= m
                    if not own[0][1]:
                        own.pop(0)
        for s in large:
            left[s] = 0
        for pool in merged.values():
            for s, c in pool:
                left[s] += c
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def put(n: int, sizes: list[int]) -> None:
        r = capacity - sum(sizes)
        if r not in by_room:
            by_room[r] = []
            bisect.insort(rooms, r)
        by_room[r].append((n, sizes))

    for run in opened:
        put(*run)
    for s in sorted(left, reverse=True):
        c = left[s]
        while c:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                if c >= each:
                    put(c // each, [s] * each)
                if c % each:
                    put(1, [s] * (c % each))
                break
            r = rooms[at]
            n, sizes = by_room[r].pop()
            if not by_room[r]:
                del by_room[r]
                rooms.pop(at)
            m = min(n, c)
            put(m, [*sizes, s])
            if n > m:
                put(n - m, sizes)
            c -= m
    return runs + [run for r in by_room.values() for run in r]


def pack(pieces: DataFrame, capacity: int = 1024, salt_rows: int = 2_000_000) -> DataFrame:
    """Give each piece (a row with doc_id, piece, length, ids_crc32; other columns stay) a sequence_id and an offset.

    pieces should be a stored table: it is read twice. Only counts by length reach the driver. A length that many
    pieces share is ranked in parts of about salt_rows rows.
    """
    salts = max(1, -(-pieces.count() // salt_rows)) * 4
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = table(salted.groupBy("length", "_salt").count(), "lengths")
    runs = make_plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacity)
    places: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for n, sizes in runs:
        at = 0
        for s in sizes:
            places.setdefault(s, []).append((n, base, at))
            at += s
        base += n
    first = {s: np.concatenate([[0], np.cumsum([p[0] for p in ps])[:-1]]) for s, ps in places.items()}
    seq, off = ({s: np.array([p[i] for p in ps]) for s, ps in places.items()} for i in (1, 2))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_n", F.row_number().over(own) - 1).join(sized(starts), ["length", "_salt"])
    names = [c for c in pieces.columns]
    ranked = ranked.select(*names, (F.col("_from") + F.col("_n")).alias("_rank"))
    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            s_out, o_out = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for s in np.unique(length):
                rows = np.flatnonzero(length == s)
                at = np.searchsorted(first[s], rank[rows], "right") - 1
                s_out[rows], o_out[rows] = seq[s][at] + rank[rows] - first[s][at], off[s][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s_out), pa.array(o_out)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, out_type)


def op7_pack(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens: a row for each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(table(cut_documents(docs), "pieces"))
