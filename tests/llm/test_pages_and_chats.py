import hashlib
import html as plain_html
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import chat, html


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<html><body><div class='content'><p>Hello <b>big</b> world<p>two &lt; three</div><div id=sidebar>x</div><section class='comments'><p>bad</p></section></body>", "Hello big world\ntwo < three"),
        ("<main><h1>T</h1><p>a<aside>no</aside>b</p><form><input>no</form><ul><li>x<li>y</ul></main><p>out</p>", "T\na\nb\nx\ny"),
        ("<article><p>text <script>if(a<b)</script> more</p><div class=ad><p>ad</p></div><p>end", "text more\nend"),
        ("<article><p>one <span class='ad'>buy <b>now</b></span> two <button>x</button> three<style>a{}</style> four</p></article>", "one two three four"),
        ("<header><h1>Site</h1></header><article><h1>A</h1><p>t<br>u &amp;amp; &copy</article><footer>f", "A\nt u &amp; ©"),
        ("a < b and c > d", "a < b and c > d"), ("<p>cut &am", "cut &am"), ("<p>cut <b clas", "cut"), ("<!-- x --><p>a<!-- b --> c<![CDATA[z]]></p>", "a c"), ("", ""), ("<article></article><p>x</p>", ""),
    ],
)
def test_blocks(page, wanted):
    assert "\n".join(t for t, inside in html.blocks(page) if inside) == wanted


def test_covered_against_all_runs():
    rng = np.random.default_rng(1)
    pages = np.repeat(np.arange(12), 60)
    tokens = rng.integers(0, 50, len(pages)).astype(np.uint64)
    for p in range(0, 12, 2):  # a run of ten tokens on half of the pages
        tokens[p * 60 + p : p * 60 + p + 10] = np.arange(900, 910)
    where = {}
    for i in range(len(tokens) - 7):
        if pages[i] == pages[i + 7]:
            where.setdefault(tuple(tokens[i : i + 8]), set()).add(pages[i])
    wanted = np.zeros(len(tokens), bool)
    for i in range(len(tokens) - 7):
        if pages[i] == pages[i + 7] and len(where[tuple(tokens[i : i + 8])]) >= 6:
            wanted[i : i + 8] = True
    assert (html.covered(tokens, pages) == wanted).all() and wanted.sum() == 60


def test_host_boilerplate_goes_and_unique_text_stays(spark):
    note = "we use small files to make this place better for all who come here"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"https://h.example/{i}", f"<body><div><p>{note}</p><p>{body(i)}</p></div>") for i in range(8)]
    rows += [(100 + i, "https://other.example/", f"<body><p>{note}</p><p>{body(i)}</p>") for i in range(2)]  # too few pages to tell
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == body(i) for i in range(8)) and all(got[100 + i] == f"{note}\n{body(i)}" for i in range(2))


def test_without_covered_runs_boilerplate_stays(spark, monkeypatch):
    """What the suffix array does: a line in an article's own element, without any mark, on two pages of three."""
    note = "read more of our best stories every day on this place of ours"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"https://h.example/{i}", f"<article><p>{body(i)}</p>" + f"<p>{note}</p>" * (i % 3 > 0) + "</article>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages).collect()} == {body(i) for i in range(9)}
    monkeypatch.setattr(html, "covered", lambda tokens, pages: np.zeros(len(tokens), bool))
    table = pa.table({"page_id": list(range(9)), "url": [""] * 9, "blocks": [[t for t, _ in html.blocks(h)] for _, _, h in rows], "inside": [[f for _, f in html.blocks(h)] for _, _, h in rows]})
    assert sum(note in t for t in html._unique(table)["text"].to_pylist()) == 6


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<article><p>one</p><p class='share-price'>two</p><section id='rail'><p>three</p></section><p>a<math><mi>x</mi></math></p></article>", "one\ntwo\nthree\nax"),
        ("<article><p>one</p><div class='social-share'>two</div><div class='ad box-2'>three</div><div id='comments'>four</div></article>", "one"),
        ("<body><p>one</p><div class='share-price'>two</div><div id='rail'>three</div><div class='cookie-law-info'>four</div></body>", "one\ntwo"),
        ("<article><p>one <a href=\"x>two</a> three</p></article>", "one two three"),
        ("<article><p title=\"5\" tall\">one</p><p class=\"x\">two</p></article>", "one\ntwo"),
    ],
)
def test_names_are_weighed(page, wanted):
    assert "\n".join(t for t, inside in html.blocks(page) if inside) == wanted


@pytest.mark.parametrize("page", ["<b></i>" * 150_000, "<a " * 300_000 + '"', "<p>" * 300_000, "<i>" * 150_000 + "<div></b>" * 60_000, "<p>" + "<b>" * 100_000 + "<p><b>" * 50_000, "<a b='" * 150_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html.blocks(page)
    assert time.perf_counter() - began < 8


def test_copies_of_a_page_are_no_boilerplate(spark):
    page = "<article><h1>Title of it</h1><p>" + " ".join(f"w{k}" for k in range(40)) + "</p></article>"
    pages = spark.createDataFrame([(i, "https://h.example/x", page, "t") for i in range(9)], "page_id long, url string, html string, text string")
    assert {r.n_chars for r in html.extract(pages).collect()} == {len("Title of it\n" + " ".join(f"w{k}" for k in range(40)))}


def test_large_hosts_are_counted_whole(spark, monkeypatch):
    note = "we use small files to make this place better for all who come here"
    rare = "this line of ten words stands on fewer than half"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    page = lambda i: f"<body><div><p>{note}</p><p>{rare if i % 5 < 2 else body(1000 + i)}</p><p>{body(i)}</p></div>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(40)]
    rows += [(100 + i, f"https://h.example/copy{i}", page(0)) for i in range(60)]  # copies are one page
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    whole = sorted(map(tuple, html.extract(pages).collect()))
    monkeypatch.setattr(html, "SHARD", 400)  # shards of one page
    assert sorted(map(tuple, html.extract(pages).collect())) == whole
    assert all(note not in text for _, _, text, _ in whole) and sum(rare in text for _, _, text, _ in whole) == 76


def test_tasks_of_few_pages_do_not_name_all_their_runs(spark, monkeypatch):
    note = "we use small files to make this place better for all who come here"
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(h * 1000 + i, f"https://h{h}.example/{i}", f"<body><div><p>{note}</p><p>{words(h * 1000 + i)}</p></div>") for h in range(2) for i in range(24)]
    rows += [(5000 + i, f"https://h0.example/s{i}", f"<body><div><p>short {i}</p></div>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    whole = sorted(map(tuple, html.extract(pages).collect()))
    assert all(note not in text for _, _, text, _ in whole)
    monkeypatch.setattr(html, "SHARD", 400)
    kept = {}
    plain = html.stored
    monkeypatch.setattr(html, "stored", lambda df, tag: kept.setdefault(tag, plain(df, tag)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a stored table's small files stay tasks of their own
    try:
        for dense, listed in ((32, 4096), (1, 256), (10**6, 3)):  # groups from many tasks, of one task's few pages, and short lists
            kept.clear()
            monkeypatch.setattr(html, "DENSE", dense)
            monkeypatch.setattr(html, "LISTED", listed)
            assert sorted(map(tuple, html.extract(pages).collect())) == whole
            many = kept["candidates"].count()
            assert many > 500 if dense == 1 else many < 30  # what a page or two hold is named, or only what many share
            assert max(len(r.runs) for r in kept["lists"].collect()) <= (512 if dense == 1 else 30)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>para {i} of a long page</p>" for i in range(20_000))
    rows = [(1, None, None, 1), (None, "x", "<p>a", 1), (2, "https://h.example", "", 1), (3, "https://h.example", long, 1), (3, "https://h.example", long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = html.extract(pages).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id in (1, 2)} == {0}
    assert {r.text.count("\n") for r in got if r.page_id == 3} == {19_999}
    assert html.extract(pages.where("1 = 0")).collect() == []


def test_pages_against_a_plain_reading(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1] if m else "")
        cleaned = (re.sub(r"\s+", " ", plain_html.unescape(re.sub(r"<[^>]*(>|$)", "", re.sub(r"<br>", " ", x)))).strip() for x in parts)
        assert got[r.page_id] == "\n".join(x for x in cleaned if x)


def test_chats_come_back(spark, sf):
    odd = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "tool", None), (None, None, None, "x"), (-8, 0, "we[ir\\d", " [/TURN] \\ "), (-9, 1, "assistant", ""), (-9, 0, "user", "\\"), (-9, 0, "user", "\\"), (-10, 0, "user", "[" * 50_000)]
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    by_conv = {}
    for r in turns.collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    assert got.keys() == by_conv.keys()
    for conv, rows in by_conv.items():
        rows.sort()
        g, loss = got[conv], "".join(t for _, role, t in rows if role == "assistant")
        assert g.n_turns == len(rows) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7].valid and not got[-8].valid and not got[-9].valid
    assert chat.read_back(chat.format_chats(turns.where("1 = 0"))).collect() == []


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": ("user: ", "\n", False)})
