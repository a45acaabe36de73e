import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafwork import options
from leafwork.functions import html, paginate
from leafwork.functions import strings as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_thresholds():
    assert [(t.ratio, t.least) for t in map(options.thresholds, ("low", "medium", "high", "?"))] == [(1.5, 0.8), (1.3, 0.6), (1.2, 0.4), (1.3, 0.6)]
    assert [options.heading_depth(s) for s in ("low", "medium", "high", "?")] == [1, 2, 3, 2]
    assert options.choice("HyBrid", options.PDF_STRATEGIES) == "hybrid"
    with pytest.raises(ValueError):
        options.choice("best", options.PDF_STRATEGIES)


def test_heading_patterns(spark):
    texts = {
        "Chapter 1: Intro": True, "CHAPTER IV": True, "part 2 - x": True, "1. Intro": True, "Chapter Introduction": True, "Part my car": True, "Chapter One": False, "1.Intro": False,
        "A Chapter 1": False, "Chapter 3": True, "Chapter ٣": True, "Chapter 1 a b": True, "Chapter\x1f1": True, "12. ": False,
    }
    df = spark.createDataFrame(list(texts.items()), "t string, want boolean")
    assert df.where(S.is_heading(F.col("t")) != F.col("want")).collect() == []


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [("Chapter 1: Introduction", 16.0, 1.0), ("Some regular paragraph text here", 12.0, 0.5), ("Chapter 1 " + "w " * 9, 12.0, 0.7), ("Chapter 1 a b c d e", 14.0, 0.8500000000000001), ("a b c", 14.0, 0.55), ("a b c d e f g", 14.0, 0.45000000000000007), ("x", 16.0, 0.6)],
)
def test_heading_score(spark, text, size, want):
    assert one(spark, S.heading_score(S.strip(F.col("t")), F.col("s")), t=text, s=size) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [("Chapter 1: Introduction/Overview", "Chapter_1_Introduction_Overview"), ("Multiple   spaces", "Multiple_spaces"), ("A" * 150, "A" * 100), ("", "untitled"), ("???", "untitled"), ("  a__b  ", "a_b"), ("a" * 99 + " bcd", "a" * 99), ("a\x1fb", "a_b")],
)
def test_safe_name(spark, title, want):
    assert one(spark, S.safe_name(F.col("t")), t=title) == want


def test_templates(spark):
    fields = {"index": F.col("i"), "title": F.col("t")}
    assert one(spark, S.template("{index:02d}_{title}.pdf", fields), i=7, t="x") == "07_x.pdf"
    assert one(spark, S.template("{index:02d}", fields), i=123, t="x") == "123"
    with pytest.raises(KeyError):
        S.template("{nothing}", fields)
    name = F.col("n")
    assert one(spark, S.with_suffix(name, ".pdf"), n="a.PDF") == "a.PDF"
    assert one(spark, S.with_suffix(name, ".epub", ".pdf"), n="01_Intro.pdf") == "01_Intro.epub"
    assert one(spark, S.with_suffix(name, ".pdf"), n="a") == "a.pdf"


def test_hrefs_and_paths(spark):
    h = F.col("h")
    for href, file, anchor in (("a.xhtml#x#y", "a.xhtml", "x#y"), ("a.xhtml", "a.xhtml", ""), ("#z", "", "z")):
        assert one(spark, F.struct(S.href_file(h), S.href_anchor(h)), h=href) == (file, anchor)
    for base, href, want in (("text", "../img/a.png", "text/../img/a.png"), ("text", "/x.png", "/x.png"), ("", "s.css", "s.css"), (".", "s.css", "s.css"), ("/", "a", "/a")):
        assert one(spark, S.join_path(F.col("b"), h), b=base, h=href) == want
    assert one(spark, S.default_output(h), h="/a/b.c/book.epub") == "/a/b.c/book_chapters"
    assert one(spark, S.shown_file(h, F.lit("x")), h="text/a.xhtml") == "a.xhtml#x"
    assert one(spark, S.ellipsis(h), h="y" * 51) == "y" * 47 + "..."
    assert one(spark, F.struct(S.colour(F.lit(0.55)), S.colour(F.lit(0.55), 0.5), S.percent(F.lit(0.85))), h="") == ("red", "yellow", "85%")


def test_named_references_end_with_a_semicolon():
    got = html.parse('<title>a&amp;&amp</title><h1>b&am</h1><h1>&lt;&ampé; &ampx; & &#38;&#x26</h1><img src="i?a=1&copy=2&amp;b"><style>x{a:url(u?&lt)}</style>&quot\ufdd0')
    assert got["title"] == "a&&amp" and [h["text"] for h in got["headings"]] == ["b&am", "<&ampé; &ampx; & &&"]
    assert [r["ref"] for r in got["refs"]] == ["i?a=1&copy=2&b", "u?&lt"] and got["text"].endswith("&quot\ufdd0")
    assert [(e["id"], e["tag"], e["start"], e["past"]) for e in html.element_rows('&amp<p id="a&lt">x&gt</p>')] == [("a&lt", "p", 4, 25)]
    assert html.section('&amp<p id="a&lt">x&gt</p>', "a&lt") == '<html><head></head><body><p id="a&lt">x&gt</p></body></html>'


def test_html():
    got = html.parse("<h2>a</h2><h1 id='s1'>b <i>c</i></h1><h2> </h2><img src=''><img src='i.png'><link rel=stylesheet href=s.css><style>x{a:url('u.woff')}</style>&amp;<!-- no -->")
    assert [(h["level"], h["text"], h["id"]) for h in got["headings"]] == [(2, "a", None), (1, "b c", "s1"), (2, "", None)]
    assert [(r["kind"], r["ref"]) for r in got["refs"]] == [("img", "i.png"), ("css", "s.css"), ("style_url", "u.woff")]
    assert got["text"].endswith("&") and "no" not in got["text"]
    assert html.parse("<title>  </title><h1>T</h1>")["title"] == ""
    assert html.parse("<title></title><h1>T</h1>")["title"] == "T"
    assert html.parse("<h1></h1><h2>x</h2>")["title"] == ""
    assert html.parse("<h2>x</h2>")["title"] == "x"
    assert html.parse(None)["title"] == ""
    assert [html.stem_title(x) for x in ("ch-01a.xhtml", "o'neil_part2.x", "chapter_one.xhtml")] == ["Ch-01A", "O'Neil Part2", "Chapter One"]
    cut = html.section("<body><h1 id='s'>T</h1><p>body</p></body>", "s")
    assert "T" in cut and "body</p>" not in cut
    assert html.section("<p>x</p>", "none") == "<p>x</p>" == html.section("<p>x</p>", "")


def test_unclosed_headings():
    got = html.parse("<div><h1>a<h2 id='x'>b</div>c<h1>d<p>e")["headings"]
    assert [(h["level"], h["text"], h["id"]) for h in got] == [(1, "a", None), (2, "b", "x"), (1, "de", None)]
    many = html.parse("<h1>some words" * 3000)
    assert sum(len(h["text"]) for h in many["headings"]) == 30_000


def test_wrapping():
    assert [len(x) for x in paginate.wrap("a" * 40 + " " + "b" * 39)] == [80]
    assert [len(x) for x in paginate.wrap("a" * 40 + " " + "b" * 40)] == [40, 40]
    assert [len(x) for x in paginate.wrap("a" * 81)] == [0, 81]
    assert [len(x) for x in paginate.wrap("a " + "b" * 81)] == [1, 81]
    assert [len(x) for x in paginate.wrap("a" * 81 + " " + "b" * 81)] == [0, 81, 81]
    pages = lambda t: max((p for p, _, _ in paginate.lay_out(t)), default=1)
    assert [pages(" ".join(["x" * 80] * n)) for n in (50, 51)] == [1, 2]
    assert [pages("\n".join(["x"] * n)) for n in (34, 35)] == [1, 2]
    assert paginate.lay_out("") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=400))
def test_layout_keeps_all_words(text):
    lines = paginate.lay_out(text)
    assert " ".join(t for _, _, t in lines).split() == text.split()
    assert all(len(t) <= 80 or " " not in t for _, _, t in lines)
    assert all(50 <= y <= 792 for _, y, _ in lines)
    assert lines == sorted(lines, key=lambda x: x[:2])


def test_package_files_in_the_jvm_equal_the_file_reader(spark):
    """Against the reader of EPUB files, on a book of its own writer, and without a Python worker."""
    import io
    import zipfile

    from leafwork.operators import book
    from leafwork.sources import epub_files

    meta = [{"namespace": epub_files.DC, "key": k, "value": v, "attrs": a} for k, v, a in (("creator", "A & B", {"id": "x"}), ("creator", "you", {}), ("subject", "s", {}))]
    data = epub_files.book_bytes("T <1>", [("text/a b+c.xhtml", "<h1>x</h1>")], [("i.png", "image/png", b"p")], meta)
    want, names = epub_files.read_epub(data), zipfile.ZipFile(io.BytesIO(data))
    files = spark.createDataFrame([("good", names.read("book.opf").decode(), names.read("toc.ncx").decode()), ("bad", "<package><metadata>", "no xml"), ("none", None, None), ("empty", "<package/>", "<ncx/>")], "doc_id string, xml string, ncx string")
    made = book.package_tables(files)
    got = {k: [r.asDict() for r in v.orderBy("doc_id", *(["ordinal"] if k == "items" else ["pos"] if k == "spine" else ["namespace", "key", "ordinal"])).collect()] for k, v in made.items()}
    assert [(i["item_id"], i["ordinal"], i["href"], i["item_type"]) for i in got["items"]] == [(i["item_id"], i["ordinal"], i["href"], i["item_type"]) for i in want["items"]]
    assert [(s["pos"], s["item_id"]) for s in got["spine"]] == [(s["pos"], s["item_id"]) for s in want["spine"]]
    short = {epub_files.DC: "dc", epub_files.OPF: "opf"}
    assert [(m["namespace"], m["key"], m["ordinal"], m["value"], m["attrs"]) for m in got["metadata"]] == sorted(((short[m["namespace"]], m["key"], m["ordinal"], m["value"], m["attrs"]) for m in want["metadata"]), key=lambda m: m[:3])
    toc = book.ncx_toc(files.select("doc_id", files["ncx"].alias("xml")))
    assert [(r["seq"], r["level"], r["title"], r["href"]) for r in toc.collect()] == [(1, 1, "T <1>", "text/a%20b%2Bc.xhtml")]
    assert [t["title"] for t in want["toc"]] == ["T <1>"]
    for df in (*made.values(), toc):
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
