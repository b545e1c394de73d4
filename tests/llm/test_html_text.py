import html
import re

from fleetlens.llm import html_text, queries

PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body class="modal-open">
<header><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<article><h1>Big &amp; &lt;small&gt;</h1><p>First  paragraph<br>goes
 on &copy; 2020<p>Second <b>bold <i>text</b>.</i><div class="ad">Buy</div><aside>Side</aside><form>Name <input name=x></form>
<ul><li>item a<li>item b</ul><!-- <p>hidden --><script>x()</script><table><tr><td>c1<td>c2</table><div class='share'>Share</div>
<section id="comments"><p>A reader said</p></section><p>Last&nbsp;one &#8211; &unknown; &eacute;</article>
<aside>More</aside><footer>&copy; host</footer></body></html>"""


def extract(spark, rows, **options):
    return {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), **options).collect()}


def test_article_blocks(spark):
    got = extract(spark, [(1, "http://a.b/c", PAGE)])[1]
    assert got["text"].split("\n") == ["Big & <small>", "First paragraph goes on © 2020", "Second bold text.", "item a", "item b", "c1", "c2",
                                       "Last one – &unknown; é"]
    assert got["n_chars"] == len(got["text"])


def test_runs_that_repeat_on_a_host_go_where_there_is_no_article(spark):
    menu, note = "Home News Sport Weather Radio Television Shop Contact", "All content belongs to the people who wrote it and so on"
    page = "<div>{m}</div><div>{n} {own}</div><div>{own} stands here alone number {i}</div><div>{n}</div>"
    rows = [(i, f"http://h{i % 2}.x/{i}", page.format(m=menu, n=note, own=f"own{i}", i=i)) for i in range(6)]
    rows += [(10, "http://alone.x/", page.format(m=menu, n=note, own="z", i=10)), (11, None, "<p>" + menu), (12, None, "<p>" + menu)]
    rows += [(13, "http://twin.x/", "<p>" + menu), (13, "http://twin.x/", "<p>" + menu)]
    got = extract(spark, rows)
    for i in range(6):
        assert got[i]["text"] == f"own{i}\nown{i} stands here alone number {i}"
    assert got[10]["text"].split("\n") == [menu, note + " z", "z stands here alone number 10", note]  # other hosts don't count
    assert got[11]["text"] == got[12]["text"] == ""
    assert got[13]["text"] == menu  # equal rows are one page


def test_an_article_on_two_pages_stays(spark):
    text = "the same words of an article that two pages of one host carry as a whole"
    got = extract(spark, [(i, "http://h/" + str(i), f"<nav>{text}</nav><article><p>{text}</p></article>") for i in range(3)])
    assert [got[i]["text"] for i in range(3)] == [text] * 3


def test_unique_runs_beside_article_elements_stay(spark):
    menu = "Home News Sport Weather Radio Television Shop Contact"
    page = "<div>{m}</div><div><p>{i} story itself of page {i}<p>told in a plain div {i}</div><article>Card {i}</article><p>{i} end {i}</p><div>{m}</div>"
    got = extract(spark, [(i, f"http://h/{i}", page.format(m=menu, i=i)) for i in range(3)])
    for i in range(3):
        assert got[i]["text"].split("\n") == [f"{i} story itself of page {i}", f"told in a plain div {i}", f"Card {i}", f"{i} end {i}"]


def test_marks_on_wrappers_do_not_drop_the_text(spark):
    story = "<article><p>The story</p></article>"
    pages = [f"<div class='right-sidebar'>{story}<div class=sidebar>Side</div></div>", f"<div class='has-sidebar'>{story}</div>",
             "<article class='post no-comments'><p>The story</p><div class='comments-area'>Said</div></article>", f"<div id='search-results'>{story}</div>",
             f"<form action=x><input>{story}<div class='ad'>Buy</div></form>", f"<div class='widget sidebar'>{story}</div>",
             f"<div class='modal'><main><p>The story</main></div><div class='modal'>Sign up</div>", f"<div style='display:none'>{story}</div>",
             "<form><p>The story</p><div class='ad'>Buy</div></form>", "<div class='search'><div id='notice'><p>The story</p></div></div><div class='ad'>Buy</div>",
             f"{story}<aside><article>Card</article></aside>", f"{story}<form>Your name</form><div class='cookie-banner'>Fine</div>"]
    got = extract(spark, [(i, f"http://h{i}/", p) for i, p in enumerate(pages)])
    assert [got[i]["text"] for i in range(len(pages))] == ["The story"] * len(pages)


def test_nulls_empty_long_broken_and_clashing(spark):
    long = "<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "   "), (4, "u", long), (5, "u", "<article><p>cut here <a hre"), (6, "u", "plain text < 5 & more"),
            (None, "u", "<article>x</article>"), (7, "u", '<article><p title="never closed>one</p><p>two</p></article>'), (8, "u", "<nav>only a menu"),
            (9, "u", "<article><p>dangling &am")]
    df = spark.createDataFrame([(*r, "t", 5, "k") for r in rows], "page_id bigint, url string, html string, text string, n_chars int, x string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[1]["text"] == got[2]["text"] == got[3]["text"] == got[8]["text"] == ""
    assert got[4]["text"] == "\n".join(["word & more"] * 50_000)
    assert (got[5]["text"], got[6]["text"], got[None]["text"], got[9]["text"]) == ("cut here", "plain text < 5 & more", "x", "dangling &am")
    assert "two" in got[7]["text"] and got[1]["x"] == "k"
    assert html_text.extract(df.limit(0)).count() == 0


def test_parser_is_linear_on_bad_markup():
    for bad in ("<a b=\"" * 20_000, "<" * 100_000, "<!--" * 30_000, "<p " * 50_000, "<div>" * 20_000, "&" * 100_000):
        html_text.blocks(bad)


def test_registered_query(spark, sf):
    def plain(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        found = []
        for x in re.split(r"</?(?:p|h1)>", body):
            x = " ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*$", "", x.replace("<br>", " "))).split())
            found += [x] if x else []
        return "\n".join(found)

    got = {r["page_id"]: r["text"] for r in queries.op4_main_text(spark, sf.dir).collect()}
    assert got == {i: plain(h) for i, h in sf("pages", "page_id", "html")}


def test_no_page_takes_long():
    import time
    began = time.time()
    pages = ['<div class="nav' + "-link" * 10_000 + '-x">kept</div><p>text</p>', "<div>" + "<b>" * 100_000 + "x" + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "x",
             "<li>" + "<b>" * 50_000 + "<hr>" * 50_000 + "x", "<ul>" + "<li>" * 100_000 + "x", "<div>" * 50_000 + "x" + "</p>" * 50_000, "<table>" + "<tr><td>" * 50_000 + "x"]
    texts = ["\n".join(t for _, t, _ in html_text.blocks(p)[0]) for p in pages]
    assert time.time() - began < 20 and texts == ["kept\ntext"] + ["x"] * 6


def test_tags_end_what_they_ended():
    """The counts find what a walk over all open elements finds."""
    import random
    r = random.Random(2)
    names = ["b", "i", "p", "li", "ul", "div", "td", "tr", "table", "dd", "dt", "span", "option", "select", "article"]
    for _ in range(3000):
        stack, own = [], html_text.Open()
        for n in range(r.randrange(1, 25)):
            name, close = r.choice(names), r.random() < .45
            if close:
                own.end(name)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in html_text.BLOCK and name not in html_text.BLOCK:
                        break
                continue
            if name in html_text.BLOCK:
                own.make_way(name)
                for i in range(len(stack) - 1, -1, -1):
                    if name in html_text.ENDED_BY.get(stack[i][0], ()):
                        del stack[i:]
                        break
                    if stack[i][0] in html_text.LIMITS:
                        break
            stack.append((name, n))
            own.push(name, n)
            assert own.stack == stack
        assert own.stack == stack


def test_runs_equal_a_sorted_suffix_array(spark):
    """Grouping by the first tokens finds what neighbours in the host's sorted suffix array share."""
    import random
    r = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    streams = {i: [r.choice(words) for _ in range(r.randrange(0, 60))] for i in range(12)}
    run = 4
    host = [(t, i, p) for i, t in streams.items() for p in range(max(1, len(t) - run + 1) if t else 0)]
    order = sorted(host, key=lambda x: x[0][x[2]:])
    shared = set()
    for (a, i, p), (b, j, q) in ((x, y) for k, x in enumerate(order) for y in order[k + 1:k + 400]):
        if a[p:p + run] == b[q:q + run] and i != j:
            shared |= {(i, p), (j, q)}
    keys = {(i, p): tuple(k) for i, t in streams.items() for p, k in enumerate(html_text.suffixes(t, run).tolist())}
    pages = {}
    for (i, p), k in keys.items():
        pages.setdefault(k, set()).add(i)
    assert {x for x, k in keys.items() if len(pages[k]) > 1} == shared and shared


def test_batches_given_back_are_small():
    """Whatever the pages of an Arrow batch hold: many pages, or one of many tokens."""
    import json
    import zlib

    import numpy as np
    import pyarrow as pa
    words = [f"w{i}" for i in range(150_000)]
    pages = ["<p>" + " ".join(words), "", "<article>x</article>", *["<div>" + " ".join(words[i:i + 1_000]) for i in range(100)], None]
    n = len(pages)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([7] * n, pa.int64()), pa.array(["http://h/"] * n), pa.array(pages, pa.string())],
                                       names=["x", "y", "url", "html"])
    got = list(html_text._suffix_rows(8)([batch]))
    assert max(b.num_rows for b in got) < 2 * 32_768 and len(got) > 4
    rows = pa.Table.from_batches(got)
    assert rows.schema.types == [pa.int64()] * 4 + [pa.int32()]
    want = [(i, 7, *map(int, k), p) for i, t in enumerate(pages) for p, k in enumerate(html_text._parsed(t, "http://h/", 8, articles=False)[1])]
    assert list(zip(*[c.to_pylist() for c in rows.columns])) == want
    assert list(html_text._suffix_rows(8)([batch.slice(1, 2)])) == []

    rng = np.random.default_rng(1)
    long = ["<p>" + rng.bytes(1_500_000).hex() for _ in range(20)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array(["http://h/"] * 21), pa.array(long, pa.string())], names=["page_id", "url", "html"])
    packs = list(html_text._pack(["page_id", "url", "html"], 8, "html", "url", "packed")([batch]))
    assert len(packs) > 1 and max(b.nbytes for b in packs) < (8 << 20) + 2_000_000
    whole = pa.Table.from_batches(packs)
    assert whole.column("page_id").to_pylist() == list(range(21))
    assert json.loads(zlib.decompress(whole.column("packed")[3].as_py()))[0][0][1] == long[3][3:]
    names = [*whole.column_names, "places"]
    one = whole.append_column("places", pa.array([[]] * 21, pa.list_(pa.int32()))).combine_chunks().to_batches()[0]
    texts = list(html_text._unpack(names, ["page_id", "text", "n_chars"], "packed", "places", 8)([one]))
    assert len(texts) > 2 and max(b.nbytes for b in texts) < (8 << 20) + 4_000_000
    assert pa.Table.from_batches(texts).to_pylist() == [{"page_id": i, "text": (t or "")[3:], "n_chars": len((t or "")[3:])} for i, t in enumerate(long)]
