"""Main text of web pages, with boilerplate found by a suffix array over the pages of a host.

A page's markup is read once into blocks in page order, each marked by whether it stands in the main
content (its article or main element, or else its body) and outside of menus, notices and the like.
The blocks' words of all pages of a host form one token stream. Its suffixes are sorted by their first
``RUN`` tokens (prefix doubling), equal neighbours are runs that repeat, and a run found on half of the
host's distinct pages covers its tokens. A block whose every token is covered is boilerplate wherever it
stands; unique runs stay.

Hosts above ``SHARD`` bytes never meet in one task. Their parsed pages are stored once; a run on half of a host's
distinct pages is on half of some group's wherever they are dealt into groups, so groups of ``DENSE`` pages or more, most of
them what one task reads of a host, name their own such runs, and these few are then counted exactly over the whole host.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.shared import column, spread_join, stored, unclashed

#: Tokens of a run (a power of two), pages that must hold it at least, and bytes of HTML of a host that one task takes whole.
RUN, PAGES, SHARD = 8, 3, 2 << 20
#: Runs that a task of a large host's pages holds before it names those on half of what it holds.
HELD = 2_000_000
#: Pages of a host that make a group whose shared runs are named, and candidate runs in one list at about.
DENSE, LISTED = 32, 4096
#: Large hosts that are broadcast at most; with more of them the pages are shuffled to their hosts' sizes.
HOSTS = 50_000

#: Elements that are left out with all they hold; those of RAW hold text that is no markup.
RAW = {"script", "style", "noscript", "iframe", "noembed", "noframes", "xmp", "textarea", "title"}
OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "template", "svg", "canvas", "object", "menu", "menuitem", "audio", "video", "fieldset"} | RAW
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A paragraph ends where one of these begins.
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside"}
#: Elements whose end tag may be missing, and what the start of which ends them.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: Words of class and id names that mark what surrounds a text, on their own or (the second list) with another such word.
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "masthead", "header", "footer", "pagination", "comment", "comments", "commentlist", "disqus", "newsletter",
}
WEAK = {
    "banner", "promotion", "notification", "alert", "aside", "rail", "widget", "widgets", "foot", "pager", "respond", "replies", "related", "recommended", "share", "sharing", "social",
    "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "toolbar", "copyright", "skip", "hidden",
}
#: Words that say where or what kind of a box something is and leave the meaning to the others.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "div", "footer", "global", "group", "head", "icon", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "outer",
    "page", "panel", "post", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "the", "title", "top", "unit", "wrap", "wrapper",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "status"}

#: A quote opens a value only after an equals sign and where it closes again, so that no tag is read twice.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
WORD_CUT = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _marks(token: str, inside: bool) -> bool:
    """Does a class or id mark what surrounds a text. Inside an article all of its words must be known, and a weak one needs another."""
    words = [w for w in WORD_CUT.split(token) if w and not w.isdigit()]
    strong = sum(w in WORDS for w in words)
    weak = sum(w in WEAK for w in words)
    if strong and not inside:
        return True
    if not strong + weak or any(w not in WORDS and w not in WEAK and w not in NEUTRAL for w in words):
        return False
    return strong > 0 or weak > 1 or not inside


def _surrounds(name: str, attributes: str, inside: bool) -> bool:
    if name in OUT:
        return True
    if not attributes or attributes == "/" or name in ("body", "html", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and any(_marks(t, inside) for t in value.split()):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and HIDDEN.search(value):
            return True
    return False


def blocks(html: str) -> list[tuple[str, bool]]:
    """(text, in the main content) of each block with text, in page order.

    Character references are decoded, white space is one space, ends are trimmed. A tag cut off by
    the end of the page is markup, a reference cut off stays as it is.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, left out, in an article or main element, left out within a line
    opened: Counter[str] = Counter()  # names on the stack
    parts: list[str] = []
    nowhere = place = (False, False, False)
    any_main = False

    def say(text: str) -> None:
        if not place[2]:
            parts.append(unescape(text))

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append((text, place[1], place[0]))

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        closing, name, attributes = m[1], m[2], m[3]
        if name is None:
            continue
        name = name.lower()
        if closing:
            if opened[name]:
                if name in BLOCK:
                    flush()
                while True:
                    opened[top := stack.pop()[0]] -= 1
                    if top == name:
                        break
                place = stack[-1][1:] if stack else nowhere
            elif name == "p":
                flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in BLOCK:
            flush()
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                opened[stack.pop()[0]] -= 1
            # an open paragraph ends even below inline elements that were left open
            if opened["p"]:
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in BLOCK:
                    k -= 1
                if stack[k][0] == "p":
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
            place = stack[-1][1:] if stack else nowhere
        elif name == "br":
            parts.append("\n")
        if name in VOID or attributes.endswith("/") and name not in BLOCK | OUT:
            continue
        if not place[0] and _surrounds(name, attributes, place[1]):
            # within a line its text goes at once; a block's is kept for the host's token stream
            place = (True, place[1], name not in BLOCK)
        if name in MAIN or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes):
            place = (place[0], True, place[2])
            any_main |= not place[0]
        stack.append((name, *place))
        opened[name] += 1
    flush()
    return [(text, not left_out and (inside or not any_main)) for text, inside, left_out in out]


def covered(tokens: np.ndarray, pages: np.ndarray, run: int = RUN, least: int = PAGES) -> np.ndarray:
    """Which tokens of a stream lie in a run of ``run`` tokens that stands on half of the pages, ``least`` at least.

    ``tokens`` are hashes; ``pages`` numbers the page of each. Ranks double their length each round, so
    after log2(run) rounds equal ranks are equal runs, and a sort brings equal suffixes together.
    """
    n = len(tokens)
    out = np.zeros(n, bool)
    total = len(np.unique(pages))
    need = max(least, (total + 1) // 2)
    if n < run or total < need:
        return out
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < run:
        rank = np.unique(rank[:-size] * (n + 1) + rank[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    whole = np.flatnonzero(pages[: len(rank)] == pages[run - 1 : run - 1 + len(rank)])
    order = whole[np.lexsort((pages[whole], rank[whole]))]
    r, p = rank[order], pages[order]
    new_run = np.ones(len(order), bool)
    new_run[1:] = r[1:] != r[:-1]
    new_page = new_run.copy()
    new_page[1:] |= p[1:] != p[:-1]
    group = np.cumsum(new_run) - 1
    on = np.bincount(group, new_page)
    starts = order[on[group] >= need]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge[:-1]) > 0


PAGE_BLOCKS = "page_id long, url string, host string, same long, blocks array<string>, inside array<boolean>"


def _parse(batches):
    for batch in batches:
        html, kept = batch.column("html"), batch.num_rows
        for a in range(0, kept, 256):
            parsed = [blocks(x or "") for x in html.slice(a, 256).to_pylist()]
            cols = [batch.column(c).slice(a, 256) for c in ("page_id", "url", "host")]
            same = np.array([int.from_bytes(blake2b("\n".join(t for t, _ in p).encode(), digest_size=8).digest(), "little", signed=True) for p in parsed], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(same), pa.array([[t for t, _ in p] for p in parsed], pa.list_(pa.string())), pa.array([[i for _, i in p] for p in parsed], pa.list_(pa.bool_()))],
                ["page_id", "url", "host", "same", "blocks", "inside"],
            )


def page_runs(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a page's runs of ``run`` tokens, and the block of each token."""
    flat = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(flat), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in flat])]).astype(np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends, block = kernels.words(raw, offsets)
    out, size = kernels.span_hashes(raw, starts, ends), 1
    if len(out) < run:
        return np.zeros(0, np.uint64), block
    while size < run:
        out = kernels.mix(out[:-size] * kernels.MIX[3] + kernels.mix(out[size:] + kernels.MIX[4]))
        size *= 2
    return out, block


def _shared_runs(pages: list[np.ndarray]) -> np.ndarray:
    """The runs on half of ``pages``, each the distinct runs of one: at most twice as many as a page has on average."""
    runs, n = np.unique(np.concatenate(pages), return_counts=True)
    return runs[2 * n >= len(pages)].view(np.int64)


def _named(dense: int):
    """(host, run, page) of batches of pages: the runs on half of the distinct pages of a host among those held at once,
    or, of a host with fewer than ``dense`` among them, each page's runs in one value."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}

        def flush():
            for host, pages in held.items():
                if len(pages) < dense:
                    blobs = [runs.tobytes() for runs in pages if len(runs)]
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(blobs), pa.string()), pa.nulls(len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["host", "run", "page"])
                    continue
                runs = _shared_runs(pages)
                for a in range(0, len(runs), 1 << 16):
                    part = runs[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(part), pa.string()), pa.array(part), pa.nulls(len(part), pa.binary())], ["host", "run", "page"])
            held.clear()

        size = 0
        for batch in batches:
            for host, texts in zip(batch.column("host").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                held.setdefault(host, []).append(np.unique(page_runs(texts)[0]))
                size += len(held[host][-1])
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _named_together(table: pa.Table) -> pa.Table:
    """(host, run): the runs on half of one group of a host's pages."""
    runs = _shared_runs([np.frombuffer(x, np.uint64) for x in table["page"].to_pylist()])
    return pa.table({"host": pa.array([table["host"][0].as_py()] * len(runs), pa.string()), "run": pa.array(runs)})


def _candidates(distinct: DataFrame) -> DataFrame:
    """(host, part, runs): every run that may be on half of a host's distinct pages, in lists of a few thousand.

    However a host's pages are dealt into groups, such a run is on half of the pages of some group. A task takes those it
    reads as a group where there are enough of them; the pages of hosts that it hardly meets go, as hashes, to groups of
    their host's, so that a group of a page or two does not name all that it holds.
    """
    named = stored(distinct.mapInArrow(_named(DENSE), "host string, run long, page binary"), "named")
    alone = named.where("page IS NOT NULL").select("host", "page", F.monotonically_increasing_id().alias("at"))
    sizes = stored(alone.groupBy("host").agg(F.count("*").alias("pages")), "thin")
    grouped = spread_join(alone, sizes, ["host"], "pages").withColumn("slice", F.expr(f"pmod(xxhash64(at), greatest(1, pages div {2 * DENSE}))"))
    together = grouped.groupBy("host", "slice").applyInArrow(_named_together, "host string, run long")
    runs = stored(named.where("run IS NOT NULL").select("host", "run").unionByName(together).distinct(), "candidates")
    many = runs.groupBy("host").agg(F.count("*").alias("many"))
    return runs.join(many, "host").groupBy("host", F.expr(f"pmod(run, many div {LISTED} + 1)").alias("part")).agg(F.collect_list("run").alias("runs"))


def _counted(batches):
    """(host, run, n): the pages of a batch that hold each run of the list beside them."""
    for batch in batches:
        hits: dict[tuple, list[np.ndarray]] = {}
        named: dict[tuple, np.ndarray] = {}
        runs = batch.column("runs")
        for i, (host, part, texts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "part", "blocks")), strict=True)):
            if (host, part) not in named:
                named[host, part] = runs[i].values.to_numpy().view(np.uint64)
            hits.setdefault((host, part), []).append(np.intersect1d(page_runs(texts)[0], named[host, part]))
        for (host, _), pages in hits.items():
            found, n = np.unique(np.concatenate(pages), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["host", "run", "n"])


def _stripped(batches):
    for batch in batches:
        out, known = [], {}
        hosts, runs = batch.column("host").to_pylist(), batch.column("runs")
        for i, (texts, flags) in enumerate(zip(batch.column("blocks").to_pylist(), batch.column("inside").to_pylist(), strict=True)):
            if hosts[i] not in known:
                known[hosts[i]] = runs[i].values.to_numpy().view(np.uint64) if runs[i].is_valid else np.zeros(0, np.uint64)
            free = np.ones(len(texts), bool)
            if len(known[hosts[i]]):
                own, block = page_runs(texts)
                at = np.flatnonzero(np.isin(own, known[hosts[i]]))
                edge = np.zeros(len(block) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + RUN, -1)
                if len(at):
                    hit, words = np.cumsum(edge[:-1]) > 0, np.bincount(block, minlength=len(texts))
                    free = (words == 0) | (np.bincount(block[hit], minlength=len(texts)) < words)
            out.append("\n".join(t for t, f, k in zip(texts, flags, free.tolist(), strict=True) if f and k))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _large(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of the pages of large hosts; copies of a page count as one."""
    parsed = stored(pages.mapInArrow(_parse, PAGE_BLOCKS).withColumn("key", F.monotonically_increasing_id()), "pages")
    first = stored(parsed.groupBy("host", "same").agg(F.min("key").alias("first")), "firsts")
    copies = stored(parsed.select("host", "same", "key").join(first, ["host", "same"]).where("key <> first").select("key"), "copies")
    distinct = parsed.join(copies, "key", "left_anti").select("host", "blocks")
    named = stored(_candidates(distinct), "lists")
    counted = distinct.join(named, "host").mapInArrow(_counted, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
    total = first.groupBy("host").agg(F.count("*").alias("total"))
    common = counted.join(total, "host").where((F.col("n") >= PAGES) & (2 * F.col("n") >= F.col("total")))
    # of these a host has at most twice as many as one of its pages holds on average: they stand on half of the pages
    common = stored(common.groupBy("host").agg(F.collect_list("run").alias("runs")), "runs")
    return parsed.join(common, "host", "left").select("page_id", "url", "host", "blocks", "inside", "runs").mapInArrow(_stripped, "page_id long, url string, text string")


def _unique(table: pa.Table) -> pa.Table:
    texts, inside = table["blocks"].to_pylist(), table["inside"].to_pylist()
    flat = [t.encode() for page in texts for t in page]
    raw = np.frombuffer(b"".join(flat), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in flat])]).astype(np.int64)
    starts, ends, block = kernels.words(raw, offsets)
    # copies of a page count as one page
    page_of_block = np.repeat(np.arange(len(texts)), [len(p) for p in texts])
    first: dict[tuple, int] = {}
    same = np.array([first.setdefault(tuple(p), i) for i, p in enumerate(texts)], np.int64)
    alone = same[page_of_block] == page_of_block
    hashes = kernels.span_hashes(raw, starts, ends) if len(raw) else np.zeros(0, np.uint64)
    own = alone[block] if len(block) else np.zeros(0, bool)
    free = np.ones(len(flat), bool)
    hit = covered(hashes[own], page_of_block[block[own]])
    words = np.bincount(block[own], minlength=len(flat))
    free[(words > 0) & (np.bincount(block[own][hit], minlength=len(flat)) == words)] = False
    out, at, seen = [], 0, {}
    for i, (page, flags) in enumerate(zip(texts, inside, strict=True)):
        keep = free[at : at + len(page)] if same[i] == i else seen[same[i]]
        seen[i] = keep
        out.append("\n".join(t for t, f, k in zip(page, flags, keep.tolist(), strict=True) if f and k))
        at += len(page)
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(out, pa.string())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    A null html is empty and gives an empty text; a null url, or one without a host, belongs to a host
    of its own kind. Pages of any length are read whole, in time that follows their length. Repeated rows are extracted
    alike and count as one page. An empty table gives no rows. Extra columns are not read.
    """
    pages = unclashed(pages, id_col, url_col, html_col)
    plain = pages.select(column(pages, id_col, "long").alias("page_id"), column(pages, url_col, "string").alias("url"), column(pages, html_col, "string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    plain = plain.withColumn("host", host)
    large = plain.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > SHARD).select(F.col("host").alias("h"))
    large = stored(large, "hosts")
    some = large.count()
    if some <= HOSTS:
        large = F.broadcast(large)
    is_large = F.col("host") == F.col("h")
    parsed = plain.join(large, is_large, "left_anti").select("page_id", "url", "html", "host").mapInArrow(_parse, PAGE_BLOCKS)
    out = parsed.groupBy("host").applyInArrow(_unique, "page_id long, url string, text string")
    if some:
        out = out.unionByName(_large(plain.join(large, is_large, "left_semi").select("page_id", "url", "html", "host")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
