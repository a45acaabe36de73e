import inspect
import io
import random
import sys
import types
import zipfile
import zlib

import pytest
from leafwork import cli
from leafwork.operators import book, split
from leafwork.sources import epub_files, epub_scan, pdf_files, sinks, writers
from leafwork.streaming import ingest


def test_book_round_trip():
    got = epub_files.read_epub(epub_files.book_bytes("A & B", [("c.xhtml", "<h1>x</h1>")], [("s.css", "text/css", b"p{}")], [{"namespace": epub_files.DC, "key": "creator", "value": "me", "attrs": {}}]))
    assert [(i["href"], i["item_type"]) for i in got["items"]][:2] == [("c.xhtml", "document"), ("s.css", "text/css")]
    assert got["toc"] == [{"seq": 1, "level": 1, "title": "A & B", "href": "c.xhtml"}]
    assert got["spine"] == [{"pos": 0, "item_id": "nav"}, {"pos": 1, "item_id": "c0"}]
    assert {m["key"]: m["value"] for m in got["metadata"]}["creator"] == "me"


def test_files_to_chapters_to_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.EPUB").write_bytes(epub_files.book_bytes("Book", [("c.xhtml", "<html><body><h1>One</h1><p>text</p></body></html>")]))
    (src / "bad.epub").write_bytes(b"no zip")
    (src / "c.txt").write_text("x")
    books = epub_files.read_epubs(spark, str(src)).persist()
    assert {r["path"].rsplit("/")[-1]: r["error"] is None for r in books.collect()} == {"a.EPUB": True, "bad.epub": False}
    items, spine, toc = (epub_files.table(books, n) for n in ("items", "spine", "toc"))
    plan = split.plan_epub(book.detect_epub(items, spine, toc))
    made = writers.write_epub(split.chapter_contents(plan, items), str(tmp_path / "out")).collect()
    assert [m["path"].rsplit("/")[-1] for m in made] == ["01_Book.epub"]
    assert "c.xhtml" in zipfile.ZipFile(io.BytesIO(open(made[0]["path"], "rb").read())).namelist()
    plan = split.plan_epub(book.detect_epub(items, spine, toc), output="pdf")
    made = writers.write_text_pdf(split.chapter_contents(plan, items, False), str(tmp_path / "out")).collect()
    data = open(made[0]["path"], "rb").read()
    assert data.startswith(b"%PDF-") and b"(One) Tj" not in data and b"text" in data


def test_text_pdf_pages():
    data = pdf_files.text_pdf(" ".join(["x" * 80] * 51), "t(1)", "me")
    assert b"/Count 2" in data and b"t\\(1\\)" in data
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[start : start + 4] == b"xref"


def test_stream(spark, tmp_path):
    src, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    src.mkdir()
    for n in ("a", "b"):
        (src / f"{n}.epub").write_bytes(epub_files.book_bytes(n, [("c.xhtml", "<h1>x</h1>")]))
        ingest.append_books(spark, str(src), str(out), str(mark)).awaitTermination(120)
    assert sorted(r["path"].rsplit("/")[-1] for r in spark.read.parquet(str(out)).collect()) == ["a.epub", "b.epub"]


def entry(key, value, namespace=epub_files.DC, **attrs):
    return {"namespace": namespace, "key": key, "value": value, "attrs": attrs}


def files(folder):
    return [f for f in folder.rglob("*.*") if f.is_file()]


def test_command_line_splits_with_resources_and_metadata(spark, tmp_path, capsys):
    page = '<html><head><link rel="stylesheet" href="../s.css"/></head><body><h1>One</h1><img src="a b.png"/><img src="a b.png#x"/><img src="lost.png"/></body></html>'
    source = [entry("identifier", "urn:x:1", id="own"), entry("title", "Whole", id="t"), entry("creator", "A & B", id="id"), entry("meta", "main", epub_files.OPF, refines="#t", property="title-type"), entry("meta", "2020-01-01T00:00:00Z", epub_files.OPF, property="dcterms:modified")]
    resources = [("text/a b.png", "image/png", b"png"), ("text/../s.css", "text/css", b"p{}"), ("unused.css", "text/css", b"")]
    (tmp_path / "b.epub").write_bytes(epub_files.book_bytes("Whole", [("text/c.xhtml", page)], resources, source))
    assert cli.main(["preview", str(tmp_path / "b.epub"), "--strategy", "Structural"]) == 0
    assert cli.main(["preview", str(tmp_path / "b.epub"), "--strategy", "native"]) == 0
    assert cli.main(["split", str(tmp_path / "b.epub"), "--strategy", "structural"]) == 0
    assert "1 files" in capsys.readouterr().out
    (made,) = files(tmp_path / "b_chapters")
    assert made.name == "01_One.epub"
    got = epub_files.read_epub(made.read_bytes())
    assert {i["href"]: i["content"] for i in got["items"] if i["item_type"] in ("image/png", "text/css")} == {"text/a b.png": b"png", "text/../s.css": b"p{}"}
    assert [i["href"] for i in got["items"] if i["item_type"] == "document"] == ["text/c.xhtml"]
    assert sorted((m["key"], m["value"], m["attrs"].get("id")) for m in got["metadata"]) == [("creator", "A & B", None), ("identifier", "urn:x:1", "id"), ("language", "en", None), ("meta", "2020-01-01T00:00:00Z", None), ("title", "One", None)]
    assert cli.main(["split", str(tmp_path / "b.epub"), "--no-metadata", "-o", str(tmp_path / "bare")]) == 0
    (made,) = files(tmp_path / "bare")
    assert {m["key"] for m in epub_files.read_epub(made.read_bytes())["metadata"]} == {"identifier", "language", "title"}
    assert cli.main(["split", str(tmp_path / "b.epub"), "--output-format", "pdf", "-o", str(tmp_path / "pdf")]) == 0
    (made,) = files(tmp_path / "pdf")
    assert made.name == "01_Whole.pdf" and b"/Title (Whole)" in made.read_bytes()
    assert cli.main(["split", str(tmp_path / "b.epub"), "--output-format", "pdf", "--no-metadata", "-o", str(tmp_path / "pdf")]) == 0
    assert b"/Title ()" in made.read_bytes()


def test_command_line_refuses():
    for wrong in (["split", "a.pdf", "--strategy", "native"], ["preview", "a.epub", "--strategy", "bookmarks"], ["split", "a.epub", "--output-format", "txt"], ["merge", "a.pdf"]):
        with pytest.raises(SystemExit):
            cli.parse(wrong)
    assert cli.parse(["preview", "x/A.PDF"]).kind == "pdf" and cli.parse(["preview", "x"]).kind == "epub"


def pdf_with_outline(streams=False):
    """Three pages of two fonts, nested bookmarks of each kind of target; with `streams`, objects in an object stream and a cross-reference stream under a predictor."""
    page = lambda n, body: [f"<< /Type /Page /Parent 2 0 R /Contents {n} 0 R >>".encode(), zipped(body)]

    def zipped(body, head=b""):
        data = zlib.compress(body)
        return b"<< /Filter /FlateDecode " + head + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream"

    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00C9> endbfchar 1 beginbfrange <41> <5A> <0061> endbfrange"
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R /Names << /Dests << /Names [(two) [5 0 R /Fit]] >> >> >>",
        b"<< /Type /Pages /Kids [3 0 R 5 0 R 7 0 R] /Count 3 /MediaBox [0 0 300 300] /Resources << /Font << /F1 9 0 R /F2 15 0 R >> >> >>",
        *page(4, b"BT /F1 24 Tf 50 250 Td (Chapter 1: \\(One\\)) Tj /F1 12 Tf 0 -60 Td (plain ) Tj (text) Tj T* ET"),
        *page(6, b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 1 0 0 1 20 100 Tm [(Ch) -10 (apter) -300 (2)] TJ 0 -12 TD <7465787432> Tj T* (third) Tj ET Q"),
        *page(8, b"BT /F2 9 Tf 10 10 Td <0141> Tj ET"),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        b"<< /Type /Outlines /First 11 0 R /Last 13 0 R >>",
        b"<< /Title (First) /Parent 10 0 R /Dest [3 0 R /XYZ 0 0 0] /First 12 0 R /Next 13 0 R >>",
        b"<< /Title <FEFF00E9> /Parent 11 0 R /A << /S /GoTo /D (two) >> >>",
        b"<< /Title (Last) /Parent 10 0 R /Dest [2 /Fit] /Next 14 0 R >>",
        b"<< /Title (Away) /Parent 10 0 R /A << /S /URI /URI (http://x) >> >>",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Odd /ToUnicode 16 0 R >>",
        zipped(cmap),
        b"<< /Title (Whole) /Author (\\351t\\351) /Creator (me) >>",
    ]
    out, places = bytearray(b"%PDF-1.5\n"), {}
    boxed = [i for i, b in enumerate(bodies, 1) if b"stream" not in b] if streams else []
    for i, b in enumerate(bodies, 1):
        if i not in boxed:
            places[i] = len(out)
            out += b"%d 0 obj\n" % i + b + b"\nendobj\n"
    n = len(bodies) + 1
    if not streams:
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % n + b"".join(b"%010d 00000 n \n" % places[i] for i in range(1, n))
        return bytes(out + b"trailer << /Size %d /Root 1 0 R /Info 17 0 R >>\nstartxref\n%d\n%%%%EOF" % (n, start))
    heads, body = "", b""
    for i in boxed:
        heads += f"{i} {len(body)} "
        body += bodies[i - 1] + b" "
    places[n] = len(out)
    out += b"%d 0 obj\n" % n + zipped(heads.encode() + body, b"/Type /ObjStm /N %d /First %d " % (len(boxed), len(heads))) + b"\nendobj\n"
    start = places[n + 1] = len(out)
    rows = [bytes([0, 0, 0, 0])] + [bytes([2, *n.to_bytes(2, "big"), boxed.index(i)]) if i in boxed else bytes([1, *places[i].to_bytes(2, "big"), 0]) for i in range(1, n + 2)]
    above, filtered = bytes(4), b""
    for r in rows:  # each row less the one above
        filtered += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above))
        above = r
    out += b"%d 0 obj\n" % (n + 1) + zipped(filtered, b"/Type /XRef /W [1 2 1] /Size %d /Root 1 0 R /Info 17 0 R /DecodeParms << /Predictor 12 /Columns 4 >> " % (n + 2)) + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


@pytest.mark.parametrize("kind", ["table", "streams", "broken"])
def test_pdf_reader(kind):
    data = pdf_with_outline(kind == "streams")
    if kind == "broken":
        data = data[: data.rindex(b"startxref")].replace(b"xref", b"xxxx") + b"startxref 7"
    got = pdf_files.parse_pdf(None, data)
    assert got["total_pages"] == 3
    assert [(o["level"], o["title"], o["page"]) for o in got["outline"]] == [(1, "First", 1), (2, "é", 2), (1, "Last", 3), (1, "Away", -1)]
    assert got["metadata"] == {"title": "Whole", "author": "été", "creator": "me"}
    spans = [(s["page"], s["block"], s["line"], s["span"], s["text"], s["size"]) for s in got["spans"]]
    assert spans == [(1, 0, 0, 0, "Chapter 1: (One)", 24.0), (1, 1, 0, 0, "plain text", 12.0), (2, 0, 0, 0, "Chapter 2", 20.0), (2, 0, 1, 0, "text2", 20.0), (2, 0, 2, 0, "third", 20.0), (3, 0, 0, 0, "Éa", 9.0)]
    chapters = [{"title": "Ä", "start_page": 2, "end_page": 3, "preserve_metadata": True}, {"title": "x", "start_page": 1, "end_page": 1, "preserve_metadata": False}]
    two, one = (pdf_files.parse_pdf(None, part) for _, part in pdf_files.cut(None, data, chapters))
    assert [(s["page"], s["text"], s["size"]) for s in two["spans"]] == [(1, "Chapter 2", 20.0), (1, "text2", 20.0), (1, "third", 20.0), (2, "Éa", 9.0)]
    assert two["total_pages"] == 2 and two["metadata"] == {"title": "Ä", "author": "été", "creator": "me"}
    assert [s["text"] for s in one["spans"]] == ["Chapter 1: (One)", "plain text"] and one["metadata"] == {} and one["outline"] == []


def test_pdf_reader_reads_what_the_writer_writes():
    text = "\n".join(["(a) line \\ of text"] * 40)
    got = pdf_files.parse_pdf(None, pdf_files.text_pdf(text, "t(1)", "me"))
    assert got["total_pages"] == 2 and got["metadata"] == {"title": "t(1)", "creator": "me"}
    assert [(s["text"], s["size"]) for s in got["spans"]] == [("(a) line \\ of text", 11.0)] * 40
    for bad in (b"", b"%PDF-1.4 nothing", b"no pdf at all"):
        with pytest.raises(ValueError):
            pdf_files.parse_pdf(None, bad)


def test_pdf_files_to_chapters_to_files(spark, tmp_path, capsys):
    """The commands on real files, bad ones among them."""
    (tmp_path / "a.PDF").write_bytes(pdf_with_outline())
    (tmp_path / "s.pdf").write_bytes(pdf_with_outline(True))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4")
    parsed = pdf_files.parse_pdfs(pdf_files.pdf_contents(spark, str(tmp_path)))
    assert {r["path"].rsplit("/")[-1]: r["error"] is None for r in parsed.select("path", "error").collect()} == {"a.PDF": True, "s.pdf": True, "bad.pdf": False}
    assert cli.main(["outline", str(tmp_path / "a.PDF")]) == 0 and "First" in capsys.readouterr().out
    # a bookmark to no page counts as page -1: the one before it ends before it starts, and goes
    for strategy, names in (("bookmarks", ["01_First.pdf", "02_Away.pdf"]), ("heuristic", ["01_Chapter_1_(One).pdf", "02_Chapter_2.pdf"])):
        assert cli.main(["split", str(tmp_path / "s.pdf"), "--strategy", strategy, "-o", str(tmp_path / strategy)]) == 0
        made = sorted(files(tmp_path / strategy))
        assert [f.name for f in made] == names
    first, second = (pdf_files.parse_pdf(None, f.read_bytes()) for f in made)
    assert (first["total_pages"], second["total_pages"]) == (1, 2) and second["metadata"]["title"] == "Chapter 2" and second["metadata"]["author"] == "été"


def test_folders_are_injective():
    ids = ["a/b", "a:b", "a_b", "..", ".", "", "a%2Fb", "file:/x/y.epub"]
    folders = [writers.folder_of(i) for i in ids]
    assert len(set(folders)) == len(ids) and not {"..", ".", ""} & set(folders) and not any("/" in f for f in folders)


def test_bad_chapters_have_errors(spark, tmp_path):
    rows = [("d", 1, "a.pdf", "t", "s", 1, 1, False, False), ("bad", 1, "a.pdf", "t", "s", 1, 1, False, False)]
    plan = spark.createDataFrame(rows, "doc_id string, chapter_index int, output_name string, title string, x string, start_page long, end_page long, is_inverted boolean, preserve_metadata boolean")
    contents = spark.createDataFrame([("d", pdf_with_outline()), ("bad", b"x")], "doc_id string, content binary")
    got = {r["doc_id"]: r for r in writers.write_pdf(plan, contents, str(tmp_path)).collect()}
    assert got["d"]["error"] is None and got["bad"]["path"] is None and "not a PDF" in got["bad"]["error"]


def test_broken_contents_are_none():
    book_file = epub_files.book_bytes("B", [("c.xhtml", "<h1>x</h1>")])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book_file)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, b"\x00 <broken" if name in ("nav.xhtml", "toc.ncx") else old.read(name))
    got = epub_files.read_epub(out.getvalue())
    assert got["toc"] == [] and len(got["spine"]) == 2


class Paper:
    """What the PDF library offers, as far as it is used: pages are the words of the content, bookmarks those that begin with a capital."""

    def __init__(self, stream=b"", filetype=None):
        self.pages, self.metadata = stream.decode().split(), {"author": "me", "title": "all"} if stream else {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __len__(self):
        return len(self.pages)

    def __iter__(self):
        line = lambda w: {"type": 0, "lines": [{"spans": [{"text": w, "size": 11}]}]}
        return iter([types.SimpleNamespace(get_text=lambda _, w=w: {"blocks": [line(w)]}) for w in self.pages])

    def get_toc(self):
        return [[1, w, i] for i, w in enumerate(self.pages, 1) if w[0].isupper()]

    def insert_pdf(self, doc, from_page, to_page):
        self.pages += doc.pages[from_page : to_page + 1]

    def set_metadata(self, metadata):
        self.metadata = metadata

    def tobytes(self):
        return f"{self.pages} {sorted(self.metadata.items())}".encode()


def test_pdf_pages_of_chapters():
    lib = types.SimpleNamespace(open=Paper)
    got = pdf_files.parse_pdf(lib, b"pre One a Two b")
    assert got["total_pages"] == 5 and [(o["title"], o["page"]) for o in got["outline"]] == [("One", 2), ("Two", 4)]
    assert [(s["page"], s["text"], s["size"]) for s in got["spans"]][1:3] == [(2, "One", 11.0), (3, "a", 11.0)]
    chapters = [{"title": "One", "start_page": 2, "end_page": 3, "preserve_metadata": True}, {"title": "Two", "start_page": 4, "end_page": 5, "preserve_metadata": False}]
    made = [data for _, data in pdf_files.cut(lib, b"pre One a Two b", chapters)]
    assert made == [b"['One', 'a'] [('author', 'me'), ('title', 'One')]", b"['Two', 'b'] []"]


def test_pdf_commands(spark, tmp_path, monkeypatch, capsys):
    """From files to files, the library's stand-in in the workers too."""
    (tmp_path / "fitz.py").write_text("import types\n\n\n" + inspect.getsource(Paper) + "\n\nopen = Paper\n")
    monkeypatch.setattr(sys, "path", [*sys.path])
    spark.sparkContext.addPyFile(str(tmp_path / "fitz.py"))
    for name, text in (("a", "pre One a Two b"), ("plain", "x y z")):
        (tmp_path / f"{name}.pdf").write_text(text)
    assert cli.main(["outline", str(tmp_path / "a.pdf")]) == 0
    assert "Two" in capsys.readouterr().out
    assert cli.main(["preview", str(tmp_path), "--kind", "pdf"]) == 0
    assert "no bookmarks" in capsys.readouterr().out
    assert cli.main(["split", str(tmp_path / "a.pdf"), "--strategy", "bookmarks"]) == 0
    made = {f.name: f.read_text() for f in files(tmp_path / "a_chapters")}
    assert made == {"01_One.pdf": "['One', 'a'] [('author', 'me'), ('title', 'One')]", "02_Two.pdf": "['Two', 'b'] [('author', 'me'), ('title', 'Two')]"}
    assert cli.main(["split", str(tmp_path / "plain.pdf")]) == 1 and not (tmp_path / "plain_chapters").exists()
    assert cli.main(["split", str(tmp_path / "plain.pdf"), "--yes"]) == 0
    assert [f.name for f in files(tmp_path / "plain_chapters")] == ["01_Complete_Document.pdf"]
    sys.modules.pop("fitz", None)


ROW = "doc_id string, chapter_index int, output_name string, data binary, error string"


def tree(folder):
    return sorted(str(f.relative_to(folder)) for f in folder.rglob("*") if f.is_file() and sinks.LISTS not in f.parts)


def test_actions_on_what_was_written_write_nothing(spark, tmp_path):
    rows = [("a/b", 1, "01_x.epub", b"one", None), ("a/b", 2, "02_y.epub", b"", None), ("c", 1, "01_z.epub", None, "ValueError: bad"), ("_manifest", 1, "m.epub", b"m", None)]
    made = sinks.write_files(spark.createDataFrame(rows, ROW).repartition(3), str(tmp_path))
    assert tree(tmp_path) == ["%5Fmanifest/m.epub", "a%2Fb/01_x.epub", "a%2Fb/02_y.epub"]
    (tmp_path / "a%2Fb/01_x.epub").write_bytes(b"own")
    for _ in range(2):
        assert made.count() == 4
        got = {(r["doc_id"], r["chapter_index"]): r for r in made.collect()}
    assert (tmp_path / "a%2Fb/01_x.epub").read_bytes() == b"own"
    assert got["a/b", 1]["path"] == str(tmp_path / "a%2Fb/01_x.epub") and [got["a/b", k]["bytes"] for k in (1, 2)] == [3, 0]
    assert got["c", 1]["path"] is None and got["c", 1]["error"] == "ValueError: bad"
    more = sinks.write_files(spark.createDataFrame([("c", 2, "n.epub", b"n", None)], ROW), str(tmp_path))
    assert more.count() == 1 and sinks.manifest(spark, str(tmp_path)).count() == 5 and made.count() == 4
    assert sinks.write_files(spark.createDataFrame([], ROW), str(tmp_path)).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    def broken(parts):
        for part in parts:
            yield part
        if (part["doc_id"] == "z").any():
            raise RuntimeError("lost")

    rows = spark.createDataFrame([(d, 1, "x", b"x", None) for d in "abcz"], ROW).repartitionByRange(4, "doc_id")
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(rows.mapInPandas(broken, ROW), str(tmp_path))
    assert {f.name for f in tmp_path.iterdir()} <= {sinks.ATTEMPTS}  # of a task that outlived the job


def test_killed_and_repeated_attempts_leave_nothing(tmp_path):
    """Attempts as executors run them: one dies half-way, one is run twice and only the second counts."""
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("doc_id", "chapter_index", "output_name", "data", "error"), r)) for r in rows], pa.schema([("doc_id", pa.string()), ("chapter_index", pa.int32()), ("output_name", pa.string()), ("data", pa.binary()), ("error", pa.string())]))
    writer = sinks.FilesWriter(str(tmp_path), "job")

    def dies():
        yield batch(("a", 1, "x", b"half", None))
        raise MemoryError

    with pytest.raises(MemoryError):
        writer.write(dies())
    first = writer.write(iter([batch(("a", 1, "x", b"old", None), ("a", 2, "y", b"y", None))]))
    again = writer.write(iter([batch(("a", 1, "x", b"new", None), ("a", 2, "y", b"y", None))]))
    assert tree(tmp_path) and not any(n.startswith("a/") for n in tree(tmp_path)) and first != again
    other = sinks.FilesWriter(str(tmp_path), "other")
    kept = other.write(iter([batch(("b", 1, "z", b"z", None))]))
    writer.commit([again, None, writer.write(iter([]))])
    assert [n for n in tree(tmp_path) if not n.startswith(sinks.ATTEMPTS)] == ["a/x", "a/y"] and (tmp_path / "a/x").read_bytes() == b"new"
    other.commit([kept])
    assert tree(tmp_path) == ["a/x", "a/y", "b/z"] and not (tmp_path / sinks.ATTEMPTS).exists()


def test_scan_reads_what_the_columns_need(spark, tmp_path):
    """Native chapters read the directory, the package and the contents of a book, and none of its chapters or images."""
    noise = random.Random(1).randbytes(400_000)
    (tmp_path / "deep").mkdir()
    for n in ("a", "deep/b"):
        pages = [(f"c{k}.xhtml", f"<h1>{n} {k}</h1>" + "x" * 50_000) for k in range(5)]
        (tmp_path / f"{n}.epub").write_bytes(epub_files.book_bytes(n, pages, [("i.png", "image/png", noise)], [entry("creator", "me")]))
    (tmp_path / "bad.epub").write_bytes(b"no zip at all")
    (tmp_path / "c.txt").write_text("x")
    whole = {r["path"]: r for r in epub_files.read_epubs(spark, str(tmp_path)).collect()}
    full = {r["path"]: r for r in epub_scan.scan_epubs(spark, str(tmp_path)).drop("bytes_read").collect()}
    assert {p: r for p, r in full.items() if not r["error"]} == {p: r for p, r in whole.items() if not r["error"]} and set(full) == set(whole) and len(full) == 3
    assert [r["items"] for r in full.values() if r["error"]] == [[]]
    light = epub_scan.scan_epubs(spark, str(tmp_path), ["toc", "items", "spine", "metadata"])
    for r in light.where("error IS NULL").collect():
        assert 0 < r["bytes_read"] < 8_000 and "content" not in r["items"][0].asDict()
        assert [t["title"] for t in r["toc"]] == [r["path"].rpartition("/")[2][0] if "/deep/" not in r["path"] else "deep/b"]
    got = book.toc_chapters(epub_files.table(light, "toc")).collect()
    assert sorted(r["file_path"] for r in got) == ["c0.xhtml"] * 2
    heavy = epub_scan.scan_epubs(spark, str(tmp_path), ["contents"])
    assert all(r["bytes_read"] > 400_000 for r in heavy.where("error IS NULL").collect())


def test_scan_takes_filters_on_the_path(spark, tmp_path):
    for n in ("a", "b", "ab"):
        (tmp_path / f"{n}.epub").write_bytes(epub_files.book_bytes(n, [("c.xhtml", "<h1>x</h1>")]))
    books = epub_scan.scan_epubs(spark, str(tmp_path), ["toc"])
    path = lambda n: f"file:{tmp_path}/{n}.epub"
    names = lambda df: sorted(r["path"].rpartition("/")[2] for r in df.collect())
    assert names(books.where(books["path"] == path("b"))) == ["b.epub"]
    assert names(books.where(books["path"].isin(path("a"), path("b"), "x"))) == ["a.epub", "b.epub"]
    assert names(books.where(books["path"].startswith(f"file:{tmp_path}/a"))) == ["a.epub", "ab.epub"]
    assert names(books.where(books["path"].endswith("b.epub"))) == ["ab.epub", "b.epub"]
    one = books.where(books["path"] == path("b"))
    assert "Filter (path" not in one._jdf.queryExecution().executedPlan().toString()  # nothing is left of it above the scan
    reader = epub_scan.BookReader(str(tmp_path), epub_scan.book_schema(["toc"]))
    assert [f for f in reader.pushFilters([epub_scan.EqualTo(("path",), path("b")), epub_scan.EqualTo(("error",), "x")])] == [epub_scan.EqualTo(("error",), "x")]
    assert [p.paths for p in reader.partitions()] == [[path("b")]]
    assert epub_scan.scan_epubs(spark, str(tmp_path / "a.epub"), ["spine"]).count() == 1
    with pytest.raises(ValueError, match="no chapters"):
        epub_scan.scan_epubs(spark, str(tmp_path), ["chapters"])
