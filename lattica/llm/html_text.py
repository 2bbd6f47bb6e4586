"""Main text of web pages by site style trees (Yi, Liu and Li, 2003).

The DOMs of a host's pages are merged: elements of the same path (tags with their classes, digits left out) are one
node. Of each node we count, over the host's pages, the presentation (the sequence of children) and the content (the
blocks of text right inside). Presentation that varies has high entropy and is important; content that is the same on
many pages has high entropy over the pages and is not. A page then composes the importance of each of its branches
from its own and its children's, and the branches of low importance are cut, inside articles too. Names are a prior:
menus, adverts and footers have no importance; on a page with an article or main element what is inside begins with
full importance and what is outside with none, as if PRIOR pages had said so, and the host's pages outweigh it.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, sized, table

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Za-z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noframes xmp svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table article section div main body html td th blockquote".split())
NOISE_TAGS = frozenset("nav aside footer form button select input menu dialog head script style noscript iframe template svg math object textarea title label fieldset datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer foot masthead topbar sidebar side aside rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing comment comments commentlist reply replies respond disqus related recommended widget widgets toolbar pagination pager copyright legal disclaimer skip search".split()
)
MAIN_WORDS = frozenset("article post entry story main".split())
GAMMA, LEAST, PRIOR = 0.9, 0.3, 2


class Node:
    __slots__ = ("tag", "path", "kids", "noise", "hard", "main", "blocks")

    def __init__(self, tag: str, path: str, noise: bool, hard: bool, main: bool):
        self.tag, self.path, self.noise, self.hard, self.main, self.kids, self.blocks = tag, path, noise, hard, main, [], []


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements and, in page order, its blocks of text (element, text). Any input is a page."""
    root = Node("", "", False, False, False)
    stack, blocks, held = [root], [], []

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1].blocks.append(text)
                blocks.append((stack[-1], text))

    def close(upto: int):
        flush()
        del stack[upto:]

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["data"]:
                held.append(m["data"].replace("&", "&amp;"))
            continue
        if m["end"]:
            if tag in INLINE:
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if not m["attrs"].rstrip().endswith("/") else None
            at = end.end() if end else at if m["attrs"].rstrip().endswith("/") else n
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif not _noise(tag, m["attrs"], stack[-1])[0]:
                continue
            else:  # an inline element that says it is noise is a branch of its own
                flush()
                at = _skip(page, at, tag)
            continue
        flush()
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPE and not (tag in ("td", "th") and stack[i].tag in ("td", "th")):
                    break
        if len(stack) > 1:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        noise, hard, main, name = _noise(tag, m["attrs"], stack[-1])
        # words of an ancestor's class do not reach an article or main below it; tags, roles and hiding do
        above = stack[-1].hard if main else stack[-1].noise
        node = Node(tag, f"{stack[-1].path}/{name}", noise or above, hard or stack[-1].hard, main or stack[-1].main)
        stack[-1].kids.append(node)
        if tag not in VOID and len(stack) < 400:
            stack.append(node)
    flush()
    return root, blocks


def _skip(page: str, at: int, tag: str) -> int:
    """The end of an inline element that begins before at; elements of the same tag may stand inside it."""
    depth = 1
    for m in re.compile(rf"<(/)?{tag}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def _noise(tag: str, attrs: str, parent: Node) -> tuple[bool, bool, bool, str]:
    """Whether name and attributes say noise, whether by more than words of the class, whether they say main text, and
    the node's name in the style tree."""
    own = {}
    if attrs.strip():
        own = {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in _ATTR.findall(attrs)}
    label = f"{own.get('class', '')} {own.get('id', '')}".strip()
    words = {w.lower() for w in _WORDS.findall(label)}
    role = own.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or own.get("itemprop", "").lower() == "articlebody" or (bool(words & MAIN_WORDS) and bool(words & {"body", "content", "text", "article", "main"}) and tag != "body")
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not parent.main)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        noise = True
    hard = noise
    if words & NOISE_WORDS and tag not in ("body", "html", "article", "main"):
        noise = True
    return noise, hard, main, f"{tag}.{'.'.join(sorted(words))}" if words else tag


def style_features(page: str) -> set[tuple[str, int, str]]:
    """What a page adds to its host's style tree: (path, kind, value); kind 0 presence, 1 presentation, 2 content."""
    root, _ = parse(page)
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        out.add((node.path, 0, ""))
        if node.kids:
            names = [k.path.rpartition("/")[2] for k in node.kids]
            out.add((node.path, 1, ">".join(a for a, b in zip(names, [None, *names]) if a != b)))
        for text in node.blocks:
            out.add((node.path, 2, text))
        todo += node.kids
    return out


def importance(node: Node, model: dict[str, tuple[float, float, int]], into: dict[int, float], prior: bool = False) -> dict[int, float]:
    """Composite importance of every branch below node, by id(): leaves' content, and inner nodes' own presentation
    with their children's. A node that the host's other pages lack is important, or with prior what its place says.
    Returned: the importance of each node's own blocks."""
    order, todo, own = [], [node], {}
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.kids
    for x in reversed(order):
        style, content, m = model.get(x.path, (1.0, 1.0, 0))
        if prior:
            style, content = ((PRIOR * x.main + m * v) / (PRIOR + m) for v in (style, content))
        own[id(x)] = content
        parts = [into[id(k)] for k in x.kids if not (prior and k.noise)] + ([content] if x.blocks else [])
        inner = sum(parts) / len(parts) if parts else content
        into[id(x)] = (1 - GAMMA) * style + GAMMA * inner if x.kids else inner
    return own


def main_text(page: str, model: dict[str, tuple[float, float, int]], least: float = LEAST) -> str:
    """The blocks of the branches that stay, joined by newlines. If none would stay of a page with an article or main
    element (its text is the same on all pages), that element's stay."""
    root, blocks = parse(page)
    has_main = any(node.main and not node.noise for node, _ in blocks)
    weight: dict[int, float] = {}
    own = importance(root, model, weight, has_main)
    holds = _above_main(root) if has_main else set()
    cut: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, low = todo.pop()
        if id(node) in holds:  # a main element is below: only the node's own blocks are in question
            if own[id(node)] < least:
                cut.add(id(node))
        else:
            low = low or ((has_main or node.path.count("/") > 2) and weight[id(node)] < least)
            if low:
                cut.add(id(node))
        todo += [(k, low) for k in node.kids]
    kept = [text for node, text in blocks if not node.noise and id(node) not in cut]
    return "\n".join(kept or [text for node, text in blocks if has_main and node.main and not node.noise])


def _above_main(root: Node) -> set[int]:
    """The nodes outside of main elements that have one below."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.kids
    out: set[int] = set()
    for x in reversed(order):
        if not x.main and any((k.main and not k.noise) or id(k) in out for k in x.kids):
            out.add(id(x))
    return out


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, presentation, content, m (pages) of the nodes that at least two pages of a host share; pages: host, html."""
    prepare(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int32()), ("value", pa.int64())])

    def run(batches):
        from xxhash import xxh3_64_intdigest as h

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(host, p, k, h(v.encode("utf-8", "replace")) - (1 << 63)) for p, k, v in style_features(page or "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    seen = pages.mapInArrow(run, "host string, path string, kind int, value long").groupBy("host", "path", "kind", "value").agg(F.count("*").alias("d"))
    d, kind = F.col("d"), F.col("kind")
    nodes = seen.groupBy("host", "path").agg(
        F.max(F.when(kind == 0, d)).alias("m"), F.sum(F.when(kind == 1, d * F.log(d))).alias("dlogd"), F.sum(F.when(kind == 1, d)).alias("sd"),
        F.sum(F.when(kind == 2, F.log(d))).alias("logd"), F.count(F.when(kind == 2, d)).alias("l"),
    ).where("m > 1")
    log_m = F.log("m")
    style = F.coalesce((log_m * F.col("sd") - F.col("dlogd")) / (F.col("sd") * log_m), F.lit(1.0))
    content = F.when(F.col("l") > 0, 1 - F.col("logd") / F.col("l") / log_m).otherwise(1.0)
    return nodes.select("host", "path", style.alias("presentation"), content.alias("content"), "m")


def extract_text(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars in place of html; a null html is empty, a null url the host ''.

    Pages that repeat stay, each with its text. Other columns are ignored. Only nodes that pages share are kept of a
    host's tree, so the tree is small however many pages the host has.
    """
    prepare(pages.sparkSession)
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    tree = table(style_tree(named.select("host", "html")), "styles")
    sites = tree.groupBy("host").agg(F.collect_list(F.struct("path", "presentation", "content", "m")).alias("tree")).withColumnRenamed("host", "_host")
    joined = named.join(sized(sites, 2_000), F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "host", "tree")

    def run(batches):
        models: dict[str, dict] = {}
        for b in batches:
            trees, hosts, out = b.column(4), b.column(3).to_pylist(), []
            for i, page in enumerate(b.column(2).to_pylist()):
                if hosts[i] not in models:
                    if len(models) > 1000:
                        models.clear()
                    models[hosts[i]] = {x["path"]: (x["presentation"], x["content"], x["m"]) for x in trees[i].as_py() or ()}
                out.append(main_text(page or "", models[hosts[i]], least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
