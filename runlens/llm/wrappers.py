"""Main text of web pages by wrapper induction.

A page is read into a light DOM of its block elements.  Each host has one
reference page (the smallest page hash).  Every page of the host is aligned
with the reference by simple tree matching (nodes match if their labels, tag
plus class and id, are equal; the alignment keeps order and maximises matched nodes).  For each
node of the reference the job counts, over all pages of the host, how many
pages have a match and how many match with the same text.  Nodes with the same
text nearly everywhere are template; nodes whose text varies are slots.  The
host's content is its article or main slot if it has one, else the slot with
the most varying text outside links.  Near copies do not make a template: pages
that share at least ``NEAR`` of their content's block text with the reference do
not count, and other pages with the same longest block are one family and count
once.

Extraction aligns the page again and returns the text of the node matched with
the content slot (or, where nothing matches it, of the page's own article, main
or densest block) without what is never content: menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments.  Template
nodes are left out of a block that was only guessed to be the content, never of
an article or main element.

Counts are sums by host and node with a map-side combine, so a host with most
of the pages costs no task more than others.  References are sent to the tasks
if all of them together are small (``SENT_BYTES``), else joined by host.
Null html is empty; pages without an url share the empty host; repeated
page ids are pages of their own; extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import prepare
from runlens.session import cut_lineage

CONSTANT = 0.6
PAGES_NEEDED = 3
NEAR = 0.5
FLUSH = 200_000
TABLE_CELLS = 10_000
SENT_BYTES = 8 << 20

# fixed values: element kinds of HTML
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|canvas|audio|video|title"
DROPPED = set("nav aside footer form button menu dialog fieldset head".split())
CLOSES_P = set("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(" + RAW + r")\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<",
                   re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|signup|sidebar|side-bar|"
                   r"widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|topbar|comments?|comment-\w+|replies|reader-comments|disqus|respond|"
                   r"share|sharing|social|related|recommended|toolbar|search|login|complementary|contentinfo|banner)(?:$|[\s_-])", re.I)


class Page:
    """Block elements in page order: label, tag, parent, kids, and the text pieces with their elements."""

    def __init__(self, source: str | None):
        self.label, self.tag, self.parent, self.kids, self.noise = ["#"], ["#"], [-1], [[]], [False]
        self.shapes: list[int] | None = None  # of a reference, made by its first match
        self.pieces: list[tuple[int, str, bool]] = []  # element, text (a space between blocks), in a link
        stack, links = [(0, "#", False)], 0  # element, tag, in an article or main
        for m in TOKEN.finditer(source or ""):
            t = m.group()
            if t[0] != "<" or t == "<":
                self.pieces.append((stack[-1][0], t, links > 0))
                continue
            tag = (m.group(3) or "").lower()
            if not tag:
                continue
            if m.group(2):
                if tag == "a":
                    links = max(0, links - 1)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == tag:
                        if stack[i][0] != stack[i - 1][0]:
                            self._space(stack[i - 1][0])
                        del stack[i:]
                        break
                    if tag in INLINE and stack[i][1] not in INLINE:
                        break  # a stray inline end does not close a block
                continue
            if tag == "br" or tag == "hr":
                self._space(stack[-1][0])
            if tag in VOID:
                continue
            names = " ".join(v.strip("\"'") for _, v in ATTR.findall(m.group(4) or "")) if m.group(4) else ""
            noise = bool(names and NOISE.search(names))
            if m.group(4).endswith("/") and tag in INLINE:
                continue
            if tag in INLINE and not noise:
                links += tag == "a"
                continue
            if tag in CLOSES_P and stack[-1][1] == "p":
                stack.pop()
            if tag in SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] in SAME[tag]:
                        del stack[i:]
                        break
                    if stack[i][1] in CONTAINERS:
                        break
            up = stack[-1][0]
            here = len(self.label)
            self.label.append(f"{tag} {names}" if names else tag)
            self.tag.append(tag)
            self.parent.append(up)
            self.kids.append([])
            self.kids[up].append(here)
            inside = stack[-1][2]
            self.noise.append(self.noise[up] or noise and tag not in ("html", "body", "article", "main") or tag in DROPPED or tag == "header" and not inside)
            if tag not in INLINE:
                self._space(here)
            stack.append((here, tag, inside or tag in ("article", "main")))

    def _space(self, at: int) -> None:
        self.pieces.append((at, " ", False))

    def own_texts(self) -> list[str]:
        """Text of each element itself, without its block children's."""
        out: list[list[str]] = [[] for _ in self.label]
        for e, t, _ in self.pieces:
            out[e].append(t)
        return [clean("".join(x)) for x in out]

    def under(self, top: int) -> list[bool]:
        inside = [False] * len(self.label)
        for e in range(len(self.label)):  # parents come first
            inside[e] = e == top or (e > 0 and inside[self.parent[e]])
        return inside

    def content(self) -> int:
        """The page's own content node: article or main with the most text, else the element with the most direct block text outside links."""
        size, linked = [0] * len(self.label), [0] * len(self.label)
        for e, t, link in self.pieces:
            if not self.noise[e]:
                size[e] += len(t)
                linked[e] += len(t) * link
        direct = [max(0, s - 2 * n) for s, n in zip(size, linked)]
        for e in range(len(self.label) - 1, 0, -1):
            size[self.parent[e]] += size[e]
        named = [e for e, t in enumerate(self.tag) if t in ("article", "main") and not self.noise[e]]
        if named:
            best = max(named, key=lambda e: (size[e], -e))
            return best
        gain = direct[:]
        for e in range(1, len(self.label)):
            if self.tag[e] in ("p", "pre", "blockquote", "ul", "ol", "h1", "h2", "h3"):
                gain[self.parent[e]] += direct[e]
        return max(range(len(gain)), key=lambda e: (gain[e], -e))

    def text(self, top: int, template: set[int]) -> str:
        inside = self.under(top)
        base = self.noise[top]
        return clean("".join(t if t == " " or (inside[e] and e not in template and (base or not self.noise[e])) else "" for e, t, _ in self.pieces))


    def content_blocks(self, texts: list[str]) -> Counter:
        """The non-empty block texts of the page's own content; ``texts`` are its ``own_texts``."""
        inside = self.under(self.content())
        return Counter(t for e, t in enumerate(texts) if t and inside[e] and not self.noise[e])


def family(ref: Counter, page: Counter) -> int | None:
    """None for a near copy of the reference; else a key that near copies of one page share."""
    shared = sum(len(t) * n for t, n in (ref & page).items())
    if shared >= NEAR * max(sum(len(t) * n for t, n in x.items()) for x in (ref, page)):
        return None
    longest = max((t for t in page if t not in ref), key=lambda t: (len(t), t), default="")
    return int.from_bytes(hashlib.blake2b(longest.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _shapes(page: Page, known: dict, new: dict) -> list[int]:
    """A number for each element, equal for elements whose subtrees have the same labels; ``known`` is only read."""
    out = [0] * len(page.label)
    for e in range(len(page.label) - 1, -1, -1):  # kids come last
        key = (page.label[e], *[out[k] for k in page.kids[e]])
        got = known.get(key)
        out[e] = new.setdefault(key, len(known) + len(new)) if got is None else got
    return out


def _filled(first: list, weights: Iterator) -> list:
    """Rows of the alignment table after ``first``; a row of weights for each."""
    rows = [first]
    if isinstance(first, np.ndarray):
        for w in weights:
            row = np.maximum(rows[-1], 0)
            np.maximum(row[1:], rows[-1][:-1] + w, out=row[1:])
            rows.append(np.maximum.accumulate(row))
        return rows
    for w in weights:
        last, row, best = rows[-1], [0], 0
        for j, x in enumerate(w):
            if last[j + 1] > best:
                best = last[j + 1]
            if x and last[j] + x > best:
                best = last[j] + x
            row.append(best)
        rows.append(row)
    return rows


def match(a: Page, b: Page) -> dict[int, int]:
    """Simple tree matching from the roots: element of ``a`` -> element of ``b``.

    Pairs of subtrees wait on a list rather than the call stack, so depth is
    not bounded.  Subtrees of one shape are compared once, and equal first kids
    match each other.  Tables above ``TABLE_CELLS`` keep every
    ``sqrt(rows)``-th row and make the others again on the way back.
    """
    if a.shapes is None:
        a.known = {}
        a.shapes = _shapes(a, {}, a.known)
    sa, sb = a.shapes, _shapes(b, a.known, {})
    memo: dict[tuple[int, int], int] = {}  # matched elements of two shapes

    def rest(x: int, y: int) -> tuple[list[int], list[int], int]:
        ka, kb, i = a.kids[x], b.kids[y], 0
        while i < len(ka) and i < len(kb) and sa[ka[i]] == sb[kb[i]]:
            i += 1
        return ka[i:], kb[i:], i

    sizes = [1] * len(a.label)
    for e in range(len(a.label) - 1, 0, -1):
        sizes[a.parent[e]] += sizes[e]

    def weight(p: int, q: int) -> int | None:
        """Matched elements of two subtrees, None if not known yet."""
        if a.label[p] != b.label[q]:
            return 0
        if sa[p] == sb[q]:
            return sizes[p]
        return memo.get((sa[p], sb[q])) if a.kids[p] and b.kids[q] else 1

    def weights(ka: list[int], kb: list[int], wide: bool) -> Iterator:
        """For each of ``ka`` its weights with ``kb``; one row a shape."""
        made: dict = {}
        if wide:
            _, one, place = np.unique([sb[q] for q in kb], return_index=True, return_inverse=True)
            first = [kb[i] for i in one]
        for p in ka:
            if sa[p] not in made:
                made[sa[p]] = np.array([weight(p, q) for q in first], np.int32) if wide else [weight(p, q) for q in kb]
            yield made[sa[p]][place] if wide else made[sa[p]]

    def start(ka: list[int], kb: list[int]) -> tuple[list, bool]:
        wide = len(ka) * len(kb) > TABLE_CELLS
        return (np.zeros(len(kb) + 1, np.int32) if wide else [0] * (len(kb) + 1)), wide

    def checkpoints(ka: list[int], kb: list[int], step: int) -> list:
        """Every ``step``-th row of the table and the last one."""
        row, wide = start(ka, kb)
        kept, w = [row], weights(ka, kb, wide)
        for i in range(0, len(ka), step):
            for one in itertools.islice(w, min(step, len(ka) - i)):
                row = _filled(row, [one])[1]
            kept.append(row)
        return kept

    def solve(x: int, y: int) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if (sa[x], sb[y]) in memo:
                todo.pop()
                continue
            ka, kb, same = rest(x, y)
            p_of, q_of = {sa[p]: p for p in ka}, {sb[q]: q for q in kb}
            open_pairs = [(p, q) for p in p_of.values() for q in q_of.values() if weight(p, q) is None]
            if open_pairs:
                todo += open_pairs
                continue
            total = 1 + sum(sizes[k] for k in a.kids[x][:same])
            if ka and kb:
                total += int(checkpoints(ka, kb, len(ka))[-1][-1])
            memo[sa[x], sb[y]] = total
            todo.pop()

    out: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        ka, kb, same = rest(x, y)
        todo += zip(a.kids[x][:same], b.kids[y][:same])
        if not ka or not kb:
            continue
        solve(x, y)
        wide = len(ka) * len(kb) > TABLE_CELLS
        step = math.isqrt(len(ka)) + 1 if wide else len(ka)
        kept = checkpoints(ka, kb, step) if wide else [start(ka, kb)[0]]
        i, j = len(ka), len(kb)
        for c in range((len(ka) - 1) // step, -1, -1):
            lo = c * step
            if i <= lo or not j:
                continue
            rows = _filled(kept[c], weights(ka[lo:i], kb, wide))
            while i > lo and j:
                if rows[i - lo][j] == rows[i - lo - 1][j]:
                    i -= 1
                elif rows[i - lo][j] == rows[i - lo][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((ka[i], kb[j]))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _with_reference(pages: DataFrame, refs: DataFrame, column: str) -> tuple[DataFrame, object]:
    """Pages and, if all of ``refs`` is small, a broadcast of it; else the pages joined with it by host."""
    size = refs.agg(F.sum(F.length("host") + sum(F.length(c) for c in refs.columns if c != "host"))).first()[0] or 0
    if size <= SENT_BYTES:
        return pages.withColumn(column, F.lit(None).cast("string")), pages.sparkSession.sparkContext.broadcast({r.host: tuple(r[1:]) for r in refs.collect()})
    packed = refs.select("host", F.to_json(F.struct(*[c for c in refs.columns if c != "host"])).alias(column))
    return pages.join(packed, "host", "left"), None


def _reference(row_json, host, sent):
    if sent is not None:
        return sent.value.get(host, (None, None))
    got = json.loads(row_json) if row_json else {}
    return got.get("ref"), got.get("wrapper")


def induce(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, ref, wrapper): the reference page and its wrapper, ``content node|template nodes`` in page order."""
    joined, sent = _with_reference(pages, refs, "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        sums: dict[tuple[str, int, int], list[int]] = {}

        def rows() -> pa.RecordBatch:
            out = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.int32(), *[pa.int64()] * 4))],
                                              ["host", "node", "family", "n", "equal", "varying"])

        for b in batches:
            for host, source, given in zip(*(b.column(c).to_pylist() for c in ("host", "html", "given"))):
                if host not in known:
                    ref = Page(_reference(given, host, sent)[0])
                    texts = ref.own_texts()
                    known[host] = (ref, texts, ref.content_blocks(texts))
                    if len(known) > 2000:  # read references again rather than hold them all
                        known = {host: known[host]}
                ref, texts, main = known[host]
                page = Page(source)
                own = page.own_texts()
                kin = family(main, page.content_blocks(own))
                if kin is None:
                    continue
                link = [0] * len(page.label)
                for e, t, in_link in page.pieces:
                    link[e] += len(t) * in_link
                for x, y in match(ref, page).items():
                    if not texts[x] and not own[y]:
                        continue
                    s = sums.setdefault((host, x, kin), [0, 0, 0])
                    s[0] += 1
                    s[1] += texts[x] == own[y]
                    s[2] += 0 if texts[x] == own[y] else max(0, len(own[y]) - 2 * link[y])
                if len(sums) > FLUSH:
                    yield rows()
        yield rows()

    by_family = joined.select("host", "html", "given").mapInArrow(run, "host string, node int, family long, n long, equal long, varying long").groupBy("host", "node", "family").agg(
        F.sum("n").alias("n"), F.sum("equal").alias("equal"), F.sum("varying").alias("varying"))
    counted = by_family.groupBy("host", "node").agg(
        F.count("*").alias("n"), F.sum((F.col("equal") * 2 >= F.col("n")).cast("long")).alias("equal"), F.sum(F.expr("varying div n")).alias("varying"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, source, nodes in zip(*(b.column(c).to_pylist() for c in ("host", "ref", "nodes"))):
                ref = Page(source)
                texts = ref.own_texts()
                stats = {s["node"]: s for s in nodes or []}
                template = {e for e, s in stats.items() if texts[e] and s["n"] >= PAGES_NEEDED and s["equal"] >= CONSTANT * s["n"]}
                top = ref.content()
                if ref.tag[top] not in ("article", "main"):
                    mass = [0] * len(ref.label)
                    for e, s in stats.items():
                        if not ref.noise[e]:
                            up = ref.parent[e] if ref.tag[e] in ("p", "pre", "blockquote", "h1", "h2", "h3") and ref.parent[e] > 0 else e
                            mass[up] += s["varying"]
                    if any(mass):
                        top = max(range(len(mass)), key=lambda e: (mass[e], -e))
                out.append((host, source or "", f"{top}|" + " ".join(map(str, sorted(template)))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*out) if out else [[]] * 3)], ["host", "ref", "wrapper"])

    nodes = counted.groupBy("host").agg(F.collect_list(F.struct("node", "n", "equal", "varying")).alias("nodes"))  # one entry for each node of one page
    return refs.join(nodes, "host", "left").select("host", "ref", "nodes").mapInArrow(wrap, "host string, ref string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    prepare(spark)
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # the reference: smallest hash of the page itself, so copies and repeated ids do not matter
    refs = pages.where("html is not null").groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), F.col("html"))).alias("ref"))
    wrappers = cut_lineage(induce(pages, cut_lineage(refs)))
    joined, sent = _with_reference(pages, wrappers, "given")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for host, source, given in zip(*(b.column(c).to_pylist() for c in ("host", "html", "given"))):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    ref, wrapper = _reference(given, host, sent)
                    top, _, template = (wrapper or "0|").partition("|")
                    known[host] = (Page(ref), int(top), {int(x) for x in template.split()})
                ref, top, template = known[host]
                page = Page(source)
                pairs = match(ref, page)
                own = page.content()
                at = own if page.tag[own] in ("article", "main") or not pairs.get(top) else pairs[top]
                same, gone = None, set()
                for x, y in pairs.items() if page.tag[at] not in ("article", "main") else ():
                    if x in template:
                        same = same or (ref.own_texts(), page.own_texts())
                        if same[0][x] == same[1][y]:
                            gone.add(y)
                texts.append(page.text(at, gone))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "given").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
