"""Operators against brute-force versions on small tables with odd rows."""

import hashlib
import html
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, decontaminate, hamming, html_text, licenses, lines, minhash, pitman_yor, quality
from lattica.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    res = db.execute(ORACLE_SQL[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in res.fetchall())


# ---------------------------------------------------------------- chat


def test_template_language():
    run = lambda t, **x: "".join(p for p, _ in chat.compile_template(t)(iter(()), **x))
    assert run("{{ 1 + 2 * 3 }}|{{ 'a' ~ 1 }}|{{ x | upper }}|{{ 'y' if x == 'q' else 'n' }}", x="q") == "7|a1|Q|y"
    assert run("{% if x %}a{% elif y %}b{% else %}c{% endif %}", x=0, y=1) == "b"
    assert run("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["p", "q"]) == "1p,2q"
    assert run("a {%- set z = 2 -%} {{ z }}{# no #}") == "a2"
    assert chat.fold(chat.parse("a{{ 1 + 1 }}{% if 1 == 1 %}b{% endif %}")) == ("block", ("text", "a2b"))
    for bad in ("{% for x %}", "{{ x.__class__ | nope }}", "{{ f(1) }}", "{% if x %}", "{{ 1 + }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        run("{{ x.y }}", x=object())


def test_escape_round_trip():
    rng = random.Random(0)
    parts = [*chat.CONTROLS, chat.ESC, "<", "s>", "[", "a", "\n", "|>", "<|", "im_end"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        got = chat.escape(text)
        assert chat.unescape(got) == text and not any(c in got for c in chat.CONTROLS)


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "a<|im_end|>\n"), (1, 1, "assistant", "a<|im_end|>\n"), (None, 0, "user", "x"), (2, 0, "as\nsist", "␛"), (3, 5, "assistant", "z" * 200_000), (3, 4, "user", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, chunk_chars=100)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, window=13):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(window, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), hit, sorted(found)


def test_decontaminate_brute(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["The", "É", "ß1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((20, 13, 5, 1, 0, 30, 14, 2))] + [(None, "null id words"), (3, "w1"), (9, None)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(25)]
    docs += [(100 + i, f"x y {t} z. {t}") for i, t in items if t and i is not None] + [(7, None), (7, None), (8, ""), (None, "null ID words"), (100, "The É")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, item int")
    got = Counter((r.doc_id, r.n_words, tuple(r.hits), tuple(r["items"]), r.contaminated) for r in decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = Counter()
    for d, t in docs:
        n, hit, found = brute_hits(t, [("" if i is None else i, x) for i, x in items])
        want[d, n, tuple(sorted(hit)), tuple(found), bool(hit) and 20 * len(hit) >= n] += 1
    assert got == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(df, empty).where("contaminated").count() == 0
    assert decontaminate.decontaminate(df.limit(0), empty).count() == 0


def test_proximity(spark):
    items = decontaminate.items_of(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta"), (3, "beta alpha")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    near = decontaminate.proximity_matches(index, items, slop=2)
    keyed = docs.select("doc_id", decontaminate.doc_of(F.col("doc_id"), F.col("text")).alias("doc_key"))
    assert {r.doc_id: r.drift for r in near.join(keyed, "doc_key").collect()} in ({1: 0, 2: 1}, {1: 0})


# ---------------------------------------------------------------- pages


def test_html_parse():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav>menu</nav>
    <div id="cookie-notice">we use cookies</div><main><article class="post"><header><h1>Head&nbsp;&amp; more</h1></header>
    <p>One <b>two<br>three</b><p>Four &lt;five&gt; &#233;<ul><li>a<li>b</ul><form>f<input></form><aside>side</aside>
    <div class="ad">buy</div><table><tr><td>x<td>y</table><script>var a="</p>";</script>tail<!-- c --></article>
    <section id="comments"><p>nice</p></section></main><footer>&copy;</footer></body>"""
    assert html_text.main_text(page, {}) == "Head & more\nOne two three\nFour <five> é\na\nb\nx\ny\ntail"
    for odd in ("", "<", "plain", "<p", "</div></p>", "<a<b>", "<article>" * 5000 + "x", "<script>", "&#xfffffff;"):
        html_text.main_text(odd, {})
    assert html_text.main_text("plain <b>text</b>", {}) == "plain text"


def test_style_tree_cuts_repeated_branches(spark):
    rng = random.Random(1)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    body = [word(30) for _ in range(40)]
    pages = [(i, f"http://h.example/{i}", f"<html><body><div class=x><p>same words on every page</p></div><div class=y><p>{b}</p></div></body></html>") for i, b in enumerate(body)]
    pages += [(99, None, None), (99, None, None)]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")).collect()}
    assert [got[i].text for i in range(40)] == body and (got[99].text, got[99].n_chars) == ("", 0)


def test_style_tree_decides_beside_and_inside_articles(spark):
    rng = random.Random(1)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    body = [word(30) for _ in range(20)]
    pages = [(i, f"http://in.example/{i}", f"<html><body><article><p>{b}</p><div class=zz><p>same on every page</p></div></article></body></html>") for i, b in enumerate(body)]
    pages += [(100 + i, f"http://beside.example/{i}", f"<html><body><article><p>one teaser</p></article><div class=content><p>{b}</p></div></body></html>") for i, b in enumerate(body)]
    pages += [(200 + i, f"http://copies.example/{i}", "<html><body><article><p>copies of one page</p></article></body></html>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(20)] == body and [got[100 + i] for i in range(20)] == body
    assert {got[200 + i] for i in range(20)} == {"copies of one page"}
    wrapped = "<html><body><div class='layout has-sidebar'><article><p>text</p></article><p>links</p></div><div hidden><article>no</article></div></body></html>"
    assert html_text.main_text(wrapped, {}) == "text"


def test_pages_query(spark, sf):
    got = {r.page_id: r.text for r in QUERIES["op3_html_text"](spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id] == "\n".join(filter(None, blocks))


# ---------------------------------------------------------------- quality


def test_quality(spark, sf):
    rows = QUERIES["op4_quality"](spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "a b " * 30000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.score(docs, quality.learn_from(docs, known))
        assert got.count() == 4 and got.where("score BETWEEN 0 AND 1").count() == 4
    assert quality.score(docs.limit(0), quality.learn_from(docs, labels)).count() == 0


def test_dual_coordinate_descent():
    good, bad = [np.array([1, 5, 9]), np.array([1, 5])] * 5, [np.array([2, 5, 9]), np.array([2, 9])] * 5
    v, r2, bias = quality.fit(good + bad, np.array([1] * 10 + [0] * 10))
    margin = lambda x: v[x].sum() / np.sqrt(r2[x].sum()) + bias
    assert all(margin(x) > 0 for x in good) and all(margin(x) < 0 for x in bad)


# ---------------------------------------------------------------- lines


def test_simhash_and_lines(spark):
    texts = ["a b c d e f", "x", "one two three " * 300, "the same the same the same"]
    df = spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts)], "k int, norm string")
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for t in texts for w in t.split()], "w string").distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    for r in lines.with_simhash(df, ["k"]).collect():
        ws = texts[r.k].split()
        want = sum(1 << i for i in range(64) if 2 * sum((hashes[w] >> i) & 1 for w in ws) > len(ws))
        assert r.sim & (1 << 64) - 1 == want


def test_line_dedup(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    near = [*base[:40], "changed", *base[41:]]
    docs = [(1, " ".join(base) + "\nhello there my friend\nshort"), (2, "other words stand in here\n" + " ".join(near)), (3, " ".join(base).upper() + "!!"), (4, None), (5, ""), (6, "Hello, THERE my friend.\nshort\nsome line of its own"), (7, "x " * 20000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, gone int")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got[1] == (docs[0][1], 0) and got[3] == ("", 1) and got[4] == (None, 0) and got[5] == ("", 0)
    assert got[6] == ("some line of its own", 2) and got[7] == (docs[6][1], 0)
    assert got[2][0].startswith("other words stand in here")
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_finds_all_of_the_similarity(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    docs, want = [], {}
    for n in (4, 5, 7, 9, 10, 15, 20, 50, 100, 140):
        for kind in range(6):
            base = [word() for _ in range(n)]
            room = next(k for k in range(n, -1, -1) if 5 * k <= n)  # the most edits of 0.8
            copy = list(base)
            if kind < 3:  # substitutions: just similar enough, similar, and one too many
                edits = (room, max(1, room // 2), room + 1)[kind]
                for at in rng.sample(range(n), edits):
                    copy[at] = f"new{rng.randrange(10**9)}"
                same = 5 * edits <= n
            elif kind < 5:  # insertions, evenly and at random: longer by a quarter
                for i in range(n // 4):
                    copy.insert(5 * i + 2 if kind == 3 else rng.randrange(len(copy)), f"new{rng.randrange(10**9)}")
                same = True
            else:  # deletions
                for _ in range(n // 5):
                    del copy[rng.randrange(len(copy))]
                same = True
            i = len(docs)
            docs += [(i, " ".join(base)), (i + 1, " ".join(copy))]
            want[i], want[i + 1] = 0, int(same)
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: (len(docs[i][1].split()), got[i], w) for i, w in want.items() if got[i] != w} == {}


# ---------------------------------------------------------------- near duplicates


def brute_classes(texts, threshold=0.8):
    """Smallest id of the connected class of each text, by all pairs."""
    def bag(t):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    bags = {i: bag(t) for i, t in texts}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both, either = (bags[i] & bags[j]).total(), (bags[i] | bags[j]).total()
            if both and both >= threshold * either:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_brute(spark, sf):
    rng = random.Random(4)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    for k in range(30):  # a large group of edited copies
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(150)] = f"e{rng.randrange(999)}"
        texts.append((10_000 + k, " ".join(copy)))
    texts += [(20_000, None), (20_001, ""), (20_002, "few words"), (20_003, "Few, words!"), (20_004, "a b c d e " * 3000)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, node int")
    got = {r.doc_id: r.class_id for r in minhash.label_classes(df).collect()}
    assert got == brute_classes(texts)
    assert minhash.label_classes(df.limit(0)).count() == 0


def test_signature_estimates():
    rng = np.random.default_rng(0)
    gap = []
    for _ in range(40):
        k = np.unique(rng.integers(0, 2**62, 300).astype(np.uint64))
        a, b = rng.integers(1, 9, len(k)), rng.integers(1, 9, len(k))
        x, y = (k, a), (k[50:], b[50:])
        gap.append((minhash.signature(*x) == minhash.signature(*y)).mean() - minhash.similarity(x, y))
    assert abs(np.mean(gap)) < 0.02


# ---------------------------------------------------------------- licences, codes, language model


def test_licenses(spark):
    notice = "Released under the MIT License."
    rows = [("a/x.py", f"# {notice}\ncode"), ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/y.py", "code"), ("a/b/z.py", None), ("q/r.py", "no notice here"), ("q/LICENSE", ""), (None, notice), ("a/b/c/y.py", "code"), ("s/COPYING", notice + "\n" + "word " * 5000), ("s/t/u.py", "the of and")]
    df = spark.createDataFrame([(*r, "l") for r in rows], "path string, text string, license string")
    got = {r.path: (r.own_license, r.license, r.license_from) for r in licenses.label_files(df, licenses.template_table(spark)).collect()}
    assert got["a/x.py"] == ("MIT", "MIT", "file") and got["a/LICENSE"][0] == "Apache-2.0"
    assert got["a/b/c/y.py"] == (None, "Apache-2.0", "a") and got["a/b/z.py"] == (None, "Apache-2.0", "a")
    assert got[None][0] == "MIT" and got["q/r.py"] == (None, "MIT", "") and got["s/t/u.py"] == (None, "MIT", "s")
    assert licenses.label_files(df.limit(0), licenses.template_table(spark)).count() == 0


def test_licenses_wrapped(spark):
    import textwrap

    wrap = lambda t, mark="# ": textwrap.indent(textwrap.fill(t, 76), mark)
    code = "\nint main() { return 0; }\nwhile (waiting) { turn(left); }\n"
    gpl2 = licenses._GNU.format("General Public License", "2")
    rows = [("mit.c", "Copyright someone\n" + wrap(licenses._MIT, " * ") + code), ("whole.txt", wrap("MIT License " + licenses._MIT + licenses._AS_IS, "")), ("gpl2.py", wrap(gpl2) + code),
            ("bsd.py", wrap(licenses._BSD + licenses._BSD_3) + code), ("spdx.py", "# SPDX-License-Identifier: Zlib" + code), ("none.py", code)]
    for n in (0, 20_000):
        others = spark.range(n).select(F.concat(F.lit("o/"), "id").alias("path"), F.concat(F.lit("other text number "), "id").alias("text"))
        df = spark.createDataFrame(rows, "path string, text string").unionByName(others)
        got = {r.path: r.own_license for r in licenses.label_files(df, licenses.template_table(spark)).where("path NOT LIKE 'o/%'").collect()}
        assert got == {"mit.c": "MIT", "whole.txt": "MIT", "gpl2.py": "GPL-2.0", "bsd.py": "BSD-3-Clause", "spdx.py": "Zlib", "none.py": None}


def test_squares_of_counts(spark):
    rng = random.Random(8)
    rows = [[rng.choice("abcdef") for _ in range(rng.randrange(30))] for _ in range(40)]
    got = spark.createDataFrame([(r,) for r in rows], "t array<string>").select("t", licenses.squares(F.col("t")).alias("n")).collect()
    assert all(r.n == sum(c * c for c in Counter(r.t).values()) for r in got)


def test_licenses_repeated_rows_and_clashing_names(spark):
    notice = "# Released under the MIT License, friends\ncode"
    df = spark.createDataFrame([("a/x.py", notice, 1, 2)] * 3 + [("b/x.py", notice, 1, 2)], "path string, text string, _key int, _dir int")
    got = {(r.path, r.own_license) for r in licenses.label_files(df, licenses.template_table(spark)).collect()}
    assert got == {("a/x.py", "MIT"), ("b/x.py", "MIT")}


def test_index_search():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 256, (700, 8), dtype=np.uint8), axis=0)
    index = hamming.Index(codes, np.ones(len(codes), np.int64))
    for q in rng.integers(0, 256, (20, 8), dtype=np.uint8):
        d = np.bitwise_count(codes ^ q).sum(axis=1)
        at, got = index.search(q, 7)
        last = np.sort(d)[6]
        assert sorted(at) == sorted(np.flatnonzero(d <= last)) and (got == d[at]).all()


def test_codes_odd_rows(spark):
    rows = [(20, [1.0, -1.0, 0.5, 0.1]), (1, [1.0, -1.0, 0.5, 0.1]), (1, [1.0, -1.0, 0.5, 0.1]), (2, None), (3, []), (4, [float("nan"), None, -1.0, 2.0]), (5, [1.0] * 9), (40, [1.0] * 9), (None, [1.0])] + [(100 + 2 * i + 1, [1.0, -1.0, 0.5, 0.1]) for i in range(60)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, code int")
    got = [tuple(r) for r in hamming.top_k(df, F.col("id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 0), (20, 2, 101, 0), (20, 3, 103, 0), (40, 1, 5, 0)]
    assert hamming.top_k(df.limit(0), F.col("id") % 20 == 0, 3).count() == 0


def test_seating():
    rng = np.random.default_rng(0)
    c, a, d = 300, 1.5, 0.4
    want = []
    for _ in range(3000):
        t = 1
        for i in range(1, c):
            t += rng.random() < a / (i - d * t + a)
        want.append(t)
    got = pitman_yor.seat(np.full(3000, c), np.full(3000, a), d, np.arange(3000, dtype=np.uint64) * np.uint64(977))
    assert abs(got.mean() - np.mean(want)) < 0.15 and abs(got.std() - np.std(want)) < 0.3


def test_language_model(spark, sf):
    from zlib import crc32

    rows = QUERIES["op10_lm_score"](spark, sf).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low)), "\n"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c = Counter(w for i, ws in docs.items() if crc32(str(i).encode()) % 10 for w in ws)
    n, v = c.total(), len(c)
    for r in rows:
        ws = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c a b"), (2, "a a b")], "doc_id long, text string")
    model = pitman_yor.train(docs)
    every = [f"{u} {w}" for u in "abc" for w in "abc"] + [f"{u}" for u in "abc"] + [f"{u} zz" for u in "abc"]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), model).collect()}
    first = {u: got[9 + i] for i, u in enumerate("abc")}  # u, then the end
    # from context u: P(end|u) + sum of P(w|u) over words and the unknown one is 1; use P(u w end) / (P(u) P(end|w))
    assert all(x < 0 for x in got.values()) and all(x < 0 for x in first.values())
    none = pitman_yor.train(docs.limit(0))
    assert pitman_yor.score(spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string"), none).count() == 3
    assert pitman_yor.score(docs.limit(0), model).count() == 0


def test_language_model_predictions_are_a_distribution(spark):
    texts = ["a b a c a b", "a a b", "c c c a b a b a b", "d e f a b", None, "a"] * 3 + ["g h"]
    model = pitman_yor.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    dishes = {(r.key, r.ctx): r.p for r in model.dishes.collect()}
    p1 = {r.key: r.p1 for r in model.words.collect()}
    contexts = {r.ctx: r.back for r in model.contexts.collect()}
    assert len(p1) == len(contexts) == 9 and len(dishes) < 81
    mean = lambda p, back: float(np.mean(np.array(p) * np.array(back)))
    for u, back in contexts.items():
        of = [dishes.get((w, u), mean(p, back)) for w, p in p1.items()]
        assert min(of) > 0 and sum(of) + mean(model.unseen, back) == pytest.approx(1)


def test_language_model_has_a_restaurant_for_every_word(spark):
    # 600 words of one kind and one count each; only the word before says which follows
    texts = [f"left{i}x right{i}x" for i in range(600)] * 4
    model = pitman_yor.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    asked = [f"left{i}x right{i}x" for i in range(0, 600, 50)] + [f"left{i}x right{i + 1}x" for i in range(0, 600, 50)]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert all(got[i] > got[12 + i] + 1 for i in range(12))
    assert model.contexts.count() == 1201


def test_language_model_takes_any_ids(spark):
    docs = spark.createDataFrame([("x-1", "a b a"), ("x-2", None), (None, "b")], "doc_id string, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in pitman_yor.score(docs, pitman_yor.train(docs)).collect()}
    assert got == {"x-1": (4, 4), "x-2": (1, 1), None: (2, 2)}
