import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafwork.functions import html, paginate
from leafwork.operators import book, layout, markup, split

DOC, OUT = "doc_id string, total_pages long", "doc_id string, seq int, level int, title string, page long"
SPAN = "doc_id string, page long, block int, block_type int, line int, span int, text string, size double"
ITEM = "doc_id string, item_id string, ordinal int, href string, item_type string, content string"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id", "chapter_index").collect()]


@pytest.fixture
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def test_outline_same_page(make):
    out = [("d", 0, 1, "A", 1), ("d", 1, 2, "A1", 2), ("d", 2, 1, " B ", 5), ("d", 3, 1, "C", 5), ("d", 4, 1, "D", 9), ("d", 5, 1, "E", 40)]
    got = layout.outline_chapters(make([("d", 30)], DOC), make(out, OUT))
    assert rows(got, "chapter_index", "title", "start_page", "end_page") == [(1, "A", 1, 4), (2, "C", 5, 8), (3, "D", 9, 39)]


def test_cascade(make):
    docs = make([("marks", 9), ("deep", 9), ("heads", 9), ("none", 7)], DOC)
    out = make([("marks", 0, 1, "A", 1), ("deep", 0, 2, "x", 1)], OUT)
    spans = make([("marks", 2, 0, 0, 0, 0, "Chapter 1", 18.0), ("heads", 3, 0, 0, 0, 0, "Chapter 1", 11.0), ("heads", 3, 0, 0, 1, 0, "Chapter 2", 11.0), ("none", 1, 0, 1, 0, 0, "Chapter 1", 30.0)], SPAN)
    got = layout.detect_pdf(docs, out, spans)
    assert rows(got, "doc_id", "title", "start_page", "end_page", "page_count", "detection_method") == [
        ("deep", "Complete Document", 1, 9, 9, "fallback"), ("heads", "Chapter 1", 3, 2, 0, "heuristic"), ("heads", "Chapter 2", 3, 9, 7, "heuristic"),
        ("marks", "A", 1, 9, 9, "bookmark"), ("none", "Complete Document", 1, 7, 7, "fallback"),
    ]
    s = {r["doc_id"]: (r["strategy_used"], r["has_bookmarks"], r["try_heuristic"]) for r in layout.summarize_pdf(docs, out, got).collect()}
    assert s == {"marks": ("hybrid", True, False), "deep": ("fallback", True, False), "heads": ("hybrid", False, True), "none": ("fallback", False, True)}
    assert {r[0] for r in rows(layout.detect_pdf(docs, out, spans, "bookmarks"), "detection_method")} == {"bookmark", "fallback"}
    assert {r[0] for r in rows(layout.detect_pdf(docs, out, spans, "other"), "detection_method")} == {"fallback"}


def test_first_span_of_a_line_decides(make):
    long = "Chapter 1 " + "w " * 9
    spans = make([("d", 1, 0, 0, 0, 0, long, 11.0), ("d", 1, 0, 0, 0, 1, "Chapter 2", 11.0)], SPAN)
    docs = make([("d", 3)], DOC)
    assert layout.heuristic_chapters(docs, spans, "low").count() == 0
    assert rows(layout.heuristic_chapters(docs, spans, "medium"), "title", "confidence") == [(long.strip(), 0.7)]


def test_font_boundary(make):
    base = [("d", 1, 0, 0, i, 0, "some words", 10.0) for i in range(3)] + [("d", 1, 0, 0, 3, 0, "a large title", 16.0)]
    docs = make([("d", 3)], DOC)
    assert rows(layout.heuristic_chapters(docs, make(base, SPAN)), "title", "confidence") == [("a large title", 0.6)]
    assert layout.heuristic_chapters(docs, make(base, SPAN), "low").count() == 0
    assert layout.heuristic_chapters(docs, make([*base, ("d", 1, 0, 0, 4, 0, "   ", 30.0)], SPAN)).count() == 0


def test_tag_major_order(make):
    items = make([("b", "i", 0, "text/a.xhtml", "document", "<h2>a</h2><h1 id='q'>b</h1><h2>c</h2><h3>d</h3><h1> </h1>")], ITEM)
    assert rows(book.heading_chapters(items), "title", "level", "confidence", "html_id") == [("b", 1, 1.0, "q"), ("a", 2, 0.7, None), ("c", 2, 0.7, None)]
    assert [r[0] for r in rows(book.heading_chapters(items, "low"), "title")] == ["b"]


def test_toc_tree(make):
    nodes = [("b", "s1", None, 0, "S1", "a#1"), ("b", "l1", "s1", 0, "L1a", "b"), ("b", "s2", "s1", 1, "S2", "c"), ("b", "l2", "s2", 0, "L2a", "d"), ("b", "x", None, 1, None, None), ("b", "l3", "x", 0, "L1b", "e")]
    flat = book.flatten_toc(make(nodes, "doc_id string, node_id string, parent_id string, ordinal int, title string, href string"))
    assert rows(book.toc_chapters(flat, 0), "title", "level") == [("S1", 1), ("L1a", 2), ("S2", 2), ("L2a", 3), ("L1b", 2)]
    assert rows(book.toc_chapters(flat, 1), "title", "file_path", "html_id") == [("S1", "a", "1")]


def test_reading_order_and_titles(make):
    items = make([("b", "a", 0, "chapter_one.xhtml", "document", "<title>  </title><h1>T</h1>"), ("b", "c", 1, "c.png", "image", None)], ITEM)
    spine = make([("b", 0, "a"), ("b", 1, "missing"), ("b", 2, "c")], "doc_id string, pos int, item_id string")
    assert rows(book.manifest_chapters(items, spine), "title", "file_path", "confidence") == [("Chapter One", "chapter_one.xhtml", 0.6)]
    toc = make([], "doc_id string, seq int, level int, title string, href string")
    got = book.detect_epub(items, spine, toc)
    assert rows(got, "detection_method", "html_id", "content_length") == [("structural", None, 0)]
    s = book.summarize_epub(items, toc, got).first()
    assert (s["strategy_used"], s["total_files"], s["has_toc"]) == ("structural (fallback)", 1, False)


def test_missing_contents_and_names(make):
    chapters = make([("b", i, f"t{i}", f"f{i}", None) for i in (1, 2, 3)], "doc_id string, chapter_index int, title string, file_path string, html_id string")
    items = make([("b", f"i{i}", 0, f"f{i}", "document", "<p>x</p>") for i in (1, 3)], ITEM)
    plan = split.plan_epub(chapters)
    assert rows(split.chapter_contents(plan, items), "output_name", "content") == [("01_t1.epub", "<p>x</p>"), ("02_t2.epub", None), ("03_t3.epub", "<p>x</p>")]
    assert rows(split.chapter_contents(split.plan_epub(chapters, output="pdf"), items, False), "output_name") == [("01_t1.pdf",), ("03_t3.pdf",)]
    assert split.collisions(split.plan_epub(chapters, "same")).first()["chapters"] == 3


def test_resources(make):
    refs = make([("b", 1, "text/a.xhtml", "css", "s.css#v"), ("b", 1, "text/a.xhtml", "img", "../img/x.png"), ("b", 1, "text/a.xhtml", "img", "http://e/x.png")], "doc_id string, chapter_index int, file_path string, kind string, ref string")
    items = make([("b", "s", 0, "text/s.css", "css", None), ("b", "x", 1, "img/x.png", "image", None)], ITEM)
    assert rows(split.resolve_resources(refs, items), "kind", "item_id", "resolved_by") == [("css", "s", "folder")]


def test_inverted_ranges_hold_no_page(make):
    plan = make([("d", 1, 3, 2), ("d", 2, 3, 4)], "doc_id string, chapter_index int, start_page long, end_page long")
    pages = make([("d", i) for i in range(1, 5)], "doc_id string, page long")
    assert sorted(rows(split.chapter_pages(plan, pages), "chapter_index", "page")) == [(2, 3), (2, 4)]  # pages of a chapter come in no order


def test_metadata_merge(make):
    plan = make([("d", 1, "T", True), ("d", 2, "U", False)], "doc_id string, chapter_index int, title string, preserve_metadata boolean")
    meta = make([("d", {"title": "whole", "author": "x"})], "doc_id string, metadata map<string,string>")
    assert rows(split.merged_metadata(meta, plan), "metadata") == [({"author": "x", "title": "T"},), ({"title": "U"},)]


def test_sections_of_any_bytes(make):
    rows_ = [("b", 1, "<p>caf\u00e9</p><p id='x'>\u00e9</p>".encode("latin-1"), "x"), ("b", 2, b"<p>\xe9</p>", ""), ("b", 3, None, "x"), ("b", 4, b"<p>a</p>", "none")]
    got = split.chapter_sections(make(rows_, "doc_id string, chapter_index int, content binary, html_id string"))
    assert rows(got, "content") == [("<html><head></head><body><p id='x'>\u00e9</p></body></html>",), ("<p>\u00e9</p>",), (None,), ("<p>a</p>",)]


def test_first_entries_of_each_document(make):
    out = [(d, i, 1 + i % 2, f"t{i}", i) for d in ("a", "b") for i in range(1, 5)]
    got = layout.first_entries(make(out, OUT), 2).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["entry"]) for r in got] == [("a", "  t1"), ("a", "t2"), ("b", "  t1"), ("b", "t2")]


def test_own_patterns(make):
    spans = make([("d", 1, 0, 0, 0, 0, "Chapter 1", 11.0), ("d", 2, 0, 0, 0, 0, "KAPITEL 2", 11.0)], SPAN)
    got = layout.detect_pdf(make([("d", 3)], DOC), make([], OUT), spans, patterns=[r"^Kapitel \d+$"])
    assert rows(got, "title", "start_page", "end_page", "confidence") == [("KAPITEL 2", 2, 3, 0.9)]


TREE = "doc_id string, node_id string, parent_id string, ordinal int, title string, href string"


def test_a_bad_tree_has_an_error_of_its_own(make):
    """A node that is its own parent below a root, a circle that no root leads to, a parent that isn't there, and a good book."""
    good = [("good", "r", None, 1, "R", "r"), ("good", "k", "r", 2, "K", "k"), ("good", "j", "r", 1, "J", "j"), ("good", "r2", None, 0, "Q", "q")]
    again = [("again", "x", None, 0, "X", "a"), ("again", "y", "x", 0, "Y", "b"), ("again", "x", "y", 0, "X", "c")]
    circle = [("circle", "a", "c", 0, "A", "a"), ("circle", "b", "a", 0, "B", "b"), ("circle", "c", "b", 0, "C", "c"), ("circle", "r", None, 0, "R", "r")]
    alone = [("alone", "s", "s", 0, "S", "s")]
    lost = [("lost", "r", None, 0, "R", "r"), ("lost", "o", "gone", 0, "O", "o"), ("lost", "p", "o", 0, "P", "p"), ("lost", "l", "r", 0, "L", "l"), ("lost", "l", "r", 1, "L", "l")]
    found = book.flatten_toc(make(good + again + circle + alone + lost, TREE))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = [("good", 1, 1, "Q", "q", None), ("good", 2, 1, "R", "r", None), ("good", 3, 2, "J", "j", None), ("good", 4, 2, "K", "k", None), ("again", None, None, None, None, book.REPEATS)]
    want += [("circle", None, None, None, None, book.CIRCLE), ("alone", None, None, None, None, book.CIRCLE), ("lost", 1, 1, "R", "r", None), ("lost", 2, 2, "L", "l", None), ("lost", 3, 2, "L", "l", None)]
    assert got == sorted(want, key=repr)
    assert {r["doc_id"] for r in book.toc_chapters(found, 0).collect()} == {"good", "lost"}
    assert book.flatten_toc(make([], TREE)).count() == 0


def test_a_deep_tree(make):
    """A chain of 200 nodes, each with a leaf beside its child, against a walk by hand."""
    nodes = [("b", f"n{k}", f"n{k - 1}" if k else None, 1, f"N{k}", "n") for k in range(200)] + [("b", f"l{k}", f"n{k}", 0 if k % 2 else 2, f"L{k}", "l") for k in range(200)]
    kids = {}
    for _, name, up, at, title, _ in nodes:
        kids.setdefault(up, []).append((at, name, title))
    want, todo = [], [(None, 0)]
    while todo:
        name, level = todo.pop()
        todo += [(n, level + 1) for _, n, _ in sorted(kids.get(name, []), reverse=True)]
        want += [(name.upper(), level)] if name else []
    got = [(r["title"], r["level"]) for r in book.flatten_toc(make(nodes, TREE)).orderBy("seq").collect()]
    assert got == want


def test_trees_need_no_loop_of_jobs(make):
    """The plan is one recursive query: it is made without running anything."""
    nodes = make([("b", "r", None, 0, "R", "r")], TREE)
    tracker = nodes.sparkSession.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    found = book.flatten_toc(nodes)
    assert "UnionLoop" in found._jdf.queryExecution().optimizedPlan().toString() and len(tracker.getJobIdsForGroup()) == before


NESTED = "doc_id string, page long, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string,size:double>>>>>>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nested_pages_equal_their_spans(make):
    """Images, blank spans, sizes of zero, nulls in place of arrays, a page without text; and nothing is shuffled."""
    line = lambda *spans: {"spans": [{"text": t, "size": s} for t, s in spans]}
    blocks = [
        {"type": 0, "lines": [line((" ", 40.0), ("Chapter 1", 11.0), ("BIG", 30.0)), line(("plain", 11.0), ("0 size", 0.0))]}, {"type": 1, "lines": [line(("Chapter 9", 50.0))]},
        {"type": 0, "lines": [line(("small", 9.0), ("LARGE", 30.0)), line(), {"spans": None}]}, {"type": 0, "lines": None},
    ]
    pages = [("d", 1, blocks), ("d", 2, [{"type": 1, "lines": []}]), ("d", 3, None), ("e", 1, [{"type": 0, "lines": [line(("1. One", 11.0))]}])]
    flat = [(d, p, i, b["type"], j, k, s["text"], s["size"]) for d, p, bs in pages for i, b in enumerate(bs or []) for j, x in enumerate(b["lines"] or []) for k, s in enumerate(x["spans"] or [])]
    cols = ["doc_id", "page", "block", "line", "span", "text", "size", "avg_size", "confidence"]
    found = layout.nested_headings(make(pages, NESTED), "high")
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(found) == key(layout.heading_candidates(make(flat, SPAN), "high")) and len(key(found)) == 3
    assert "Exchange" not in plan_of(found)
    docs = make([("d", 3), ("e", 1)], DOC)
    both = [layout.detect_pdf(docs, make([], OUT), source, "heuristic") for source in (make(pages, NESTED), make(flat, SPAN))]
    assert rows(both[0], "doc_id", "title", "start_page", "end_page") == rows(both[1], "doc_id", "title", "start_page", "end_page")


def test_ranges_of_any_length(make):
    """A range to three thousand million pages, ranges at borders of bins, overlapping and inverted ones, a document without pages."""
    ranges = [("d", 1, 1, 3_000_000_000), ("d", 2, 60, 70), ("d", 3, 64, 64), ("d", 4, 128, 127), ("d", 5, -5, 2), ("d", 6, 200, 3_000_000_000), ("e", 1, 1, 9)]
    plan = make(ranges, "doc_id string, chapter_index int, start_page long, end_page long")
    pages = make([("d", p, p * 2) for p in range(1, 151)], "doc_id string, page long, size long")
    got = sorted((r["chapter_index"], r["page"]) for r in split.chapter_pages(plan, pages).collect())
    assert got == sorted((c, p) for d, c, a, b in ranges for p in range(1, 151) if d == "d" and a <= p <= b)
    assert split.chapter_pages(plan, pages).columns == ["doc_id", "page", "chapter_index", "size"]
    bins = split.chapter_pages(plan, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan_of(split.chapter_pages(plan, pages)) and "explode" in bins


def test_folded_lines_equal_the_worker(make):
    texts = ["", None, " \n ", "x" * 200, "a " + "y" * 90 + " b", "one\n\ntwo\u2003three", "\n".join(["w" * 79 + " z"] * 60), " ".join(["word"] * 3000), "é" * 81 + "\x1cq"]
    df = make([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: [tuple(x) for x in r["l"]] for r in df.select("i", paginate.folded_lines(df["text"]).alias("l")).collect()}
    assert got == {i: paginate.lay_out(t or "") for i, t in enumerate(texts)}
    assert not any(x in plan_of(df.select(paginate.folded_lines(df["text"]))) for x in ("Python", "Arrow"))


def test_elements_are_intervals():
    page = '<html><body><div id="a"><p>x<br><h2 id="h">T <b>u</b></h2><img src="i.png"></div><section id="s"><style>p{background:url(u.png)}</style><h3>Open</section><div id="a">again</body>'
    found = html.element_rows(page)
    of = {e["id"]: e for e in reversed(found) if e["id"]}
    assert [e["first"] for e in found] == list(range(len(found))) and [e["tag"] for e in found][:6] == ["html", "body", "div", "p", "br", "h2"]
    assert [found[k]["tag"] for k in range(of["a"]["first"], of["a"]["last"] + 1)] == ["div", "p", "br", "h2", "b", "img"]
    assert page[of["a"]["start"] : of["a"]["past"]] == page[page.index('<div id="a">') : page.index("<section")] and of["h"]["text"] == "T u"
    assert [e["refs"] for e in found if e["refs"]] == [[{"kind": "img", "ref": "i.png"}], [{"kind": "style_url", "ref": "u.png"}]]
    assert page[of["s"]["start"] : of["s"]["past"]].endswith("</section>") and found[-1]["past"] == len(page) - len("</body>") + len("</body>")
    for anchor in ("a", "h", "s"):  # cut alike by the one element's parse
        assert html.section(page, anchor) == f"<html><head></head><body>{page[of[anchor]['start'] : of[anchor]['past']]}</body></html>"
    assert html.element_rows(None) == [] and html.element_rows(b"") == [] and html.element_rows("no markup") == []


def test_sections_from_elements(make):
    items = make([("b", "p", b'<h1>T</h1><div id="x"><h2>In</h2><img src="i"></div><h2>Out</h2>'), ("b", "q", b"\xe9<i id='x'>1</i>"), ("b", "n", None)], "doc_id string, href string, content binary")
    chapters = make([("b", "p", "x"), ("b", "p", "gone"), ("b", "q", "x"), ("b", "p", ""), ("b", "n", "x"), ("b", "lost", "x")], "doc_id string, file_path string, html_id string")
    found = markup.elements(items)
    bounds = markup.sections(chapters, found)
    got = {(r["file_path"], r["html_id"]): r["content"] for r in markup.section_contents(bounds, items).collect()}
    old = split.chapter_sections(chapters.join(items.withColumnRenamed("href", "file_path"), ["doc_id", "file_path"]))
    assert got == {(r["file_path"], r["html_id"]): r["content"] for r in old.collect()} and len(got) == 5
    assert [(r["html_id"], r["text"], r["place"]) for r in markup.section_headings(bounds, found).collect()] == [("x", "In", 1)]
    assert [(r["file_path"], r["kind"], r["ref"]) for r in markup.section_refs(bounds, found).collect()] == [("p", "img", "i")]


PAGES = [f"<h1>T{i}</h1>" + "<p>some text</p>" * 250 for i in range(600)] + [None, "", "<i>" + "x" * 600_000]  # 2.4 MB in short pages, a long one


def test_elements_leave_a_worker_in_small_parts():
    """What a worker holds follows from the bytes of a part, not from the rows of a batch."""
    found = list(html.elements_of.func(iter([pd.Series(PAGES, dtype=object)])))
    assert len(found) > 4 and max(map(len, found)) < 200
    assert [e for part in found for e in part] == [html.element_rows(x) for x in PAGES]
    texts = list(html.text_of.func(iter([pd.Series(PAGES, dtype=object)])))
    assert len(texts) > 4 and [x for part in texts for x in part] == PAGES


def _batch_bytes(spark, make_plan):
    """The bound that a session with a large one has after the plan is made."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        make_plan()
        return int(spark.conf.get(name))
    finally:
        spark.conf.set(name, before)


def test_elements_come_in_small_batches(spark, make):
    items = make([("b", "p", b"<h1>T</h1>")], "doc_id string, href string, content binary")
    assert _batch_bytes(spark, lambda: markup.elements(items)) <= 4 << 20
    bounds = markup.sections(make([("b", "p", "x")], "doc_id string, file_path string, html_id string"), markup.elements(items))
    assert _batch_bytes(spark, lambda: markup.section_contents(bounds, items)) <= 4 << 20


def test_parsed_pages_leave_a_worker_in_small_parts(spark, make):
    found = list(html.parsed.func(iter([(pd.Series(PAGES, dtype=object), pd.Series(["a_b.x"] * len(PAGES)))])))
    assert len(found) > 4 and max(map(len, found)) < 200
    whole = pd.concat(found)
    assert list(whole["text"]) == [html.parse(x)["text"] for x in PAGES] and list(whole["refs"]) == [html.parse(x)["refs"] for x in PAGES] and list(whole["name"])[-3:] == ["A B"] * 3
    cut = list(html.section_of.func(iter([(pd.Series(PAGES, dtype=object), pd.Series([""] * len(PAGES)))])))
    assert len(cut) > 4 and [x for part in cut for x in part] == PAGES
    items = make([("b", 1, "p", "<img src='i'>", "x")], "doc_id string, chapter_index int, file_path string, content string, html_id string")
    assert _batch_bytes(spark, lambda: split.resource_refs(items)) <= 4 << 20 and _batch_bytes(spark, lambda: split.chapter_sections(items)) <= 4 << 20
    pages = make([("b", "i", 1, "p", "document", "<h1>T</h1>")], ITEM)
    assert _batch_bytes(spark, lambda: book.heading_chapters(pages)) <= 4 << 20


def test_ranges_of_an_outline(make):
    """Against the window by document: one that holds most entries, gaps in the ordinals, pages that are null, go back or repeat, ranges that keep nothing."""
    rng = random.Random(7)
    entries = [("big", 7 * k + rng.randrange(7), rng.choice([1, 1, 2]), f" T{k} ", rng.choice([None, k // 3, k // 3, 0])) for k in range(400)]
    entries += [("d", k, 1, f"D{k}", p) for k, p in enumerate([3, 3, 9, 2, 50, 7])] + [("none", 1, 2, "x", 1)]
    docs, outline = make([("big", 120), ("d", 60), ("none", 1), ("bare", 1)], DOC), make(entries, OUT)
    want = layout.outline_chapters(docs, outline)
    for size in (1, 7, 64, 65536):
        got = layout.ranged_chapters(docs, outline, 1, size)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_window_sees_a_whole_outline(make):
    """Rows that reach a task are those of its ranges: with one document, several tasks have some."""
    outline = make([("big", k, 1, "t", k) for k in range(4000)], OUT)
    made = layout.ranged_chapters(make([("big", 4000)], DOC), outline, 1, 50)
    spark = outline.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = made.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000
