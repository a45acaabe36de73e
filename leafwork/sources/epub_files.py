"""EPUB files as tables, and tables as EPUB files."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Collection, Iterator
from html import escape
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = "*.[eE][pP][uU][bB]"  # other files are not read
DOCUMENT_TYPES = ("application/xhtml+xml", "text/html")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I = T.StringType(), T.IntegerType()
ITEM = _struct(item_id=_S, ordinal=_I, href=_S, item_type=_S, content=T.BinaryType())
SPINE = _struct(pos=_I, item_id=_S)
TOC = _struct(seq=_I, level=_I, title=_S, href=_S)
META = _struct(namespace=_S, key=_S, ordinal=_I, value=_S, attrs=T.MapType(_S, _S))
BOOK = T.StructType([T.StructField("path", _S), T.StructField("error", _S), *(T.StructField(n, T.ArrayType(t)) for n, t in (("items", ITEM), ("spine", SPINE), ("toc", TOC), ("metadata", META)))])


def _name(tag: str) -> tuple[str, str]:
    space, _, local = tag.rpartition("}")
    return space.lstrip("{"), local


def _find(node: ElementTree.Element, local: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if _name(x.tag)[1] == local]


def _ncx(node: ElementTree.Element, level: int, out: list[dict]) -> None:
    for point in [x for x in node if _name(x.tag)[1] == "navPoint"]:
        label = next((x for x in point if _name(x.tag)[1] == "navLabel"), None)
        target = next((x.get("src") for x in point if _name(x.tag)[1] == "content"), None)
        if label is not None and target:
            out.append({"level": level, "title": "".join(label.itertext()).strip(), "href": target})
        _ncx(point, level + 1, out)


def _nav(node: ElementTree.Element, level: int, out: list[dict]) -> None:
    for entry in [x for x in node if _name(x.tag)[1] == "li"]:
        link = next((x for x in entry if _name(x.tag)[1] == "a"), None)
        if link is not None and link.get("href"):
            out.append({"level": level, "title": "".join(link.itertext()).strip(), "href": link.get("href")})
        for below in [x for x in entry if _name(x.tag)[1] == "ol"]:
            _nav(below, level + 1, out)


PARTS = ("items", "contents", "spine", "toc", "metadata")


def read_book(book: zipfile.ZipFile, wanted: Collection[str] = PARTS) -> dict:
    """Of one book what is wanted, reading no file that isn't needed for it: items (with content only if contents are wanted),
    spine, toc (pre-order) and metadata. A contents file that can't be read gives an empty toc."""
    names = set(book.namelist())
    box = ElementTree.fromstring(book.read("META-INF/container.xml"))
    package = _find(box, "rootfile")[0].get("full-path")
    base = posixpath.dirname(package)
    opf = ElementTree.fromstring(book.read(package))
    items, toc_files = [], []
    for n, x in enumerate(_find(opf, "item")):
        kind, href = x.get("media-type", ""), unquote(x.get("href", ""))
        full = posixpath.join(base, href)
        special = "nav" in (x.get("properties") or "").split() or kind == "application/x-dtbncx+xml"
        if special:
            toc_files.append((kind != "application/x-dtbncx+xml", full))
        item = {"item_id": x.get("id"), "ordinal": n, "href": href, "item_type": "navigation" if special else "document" if kind in DOCUMENT_TYPES else kind}
        if "contents" in wanted:
            item["content"] = book.read(full) if full in names else None
        items.append(item)
    out: dict = {"items": items} if {"items", "contents"} & set(wanted) else {}
    if "spine" in wanted:
        out["spine"] = [{"pos": n, "item_id": x.get("idref")} for n, x in enumerate(_find(opf, "itemref"))]
    if "toc" in wanted:
        out["toc"] = [{"seq": i + 1, **t} for i, t in enumerate(_contents(book, toc_files))]
    if "metadata" in wanted:
        meta, seen = [], {}
        for holder in _find(opf, "metadata"):
            for x in holder:
                space, key = _name(x.tag)
                seen[key] = seen.get(key, -1) + 1
                meta.append({"namespace": space, "key": key, "ordinal": seen[key], "value": (x.text or "").strip(), "attrs": dict(x.attrib)})
        out["metadata"] = meta
    return out


def _contents(book: zipfile.ZipFile, toc_files: list[tuple[bool, str]]) -> list[dict]:
    """Entries of the first contents file that has any, the older kind first."""
    for is_nav, full in sorted(toc_files):
        toc: list[dict] = []
        try:
            tree = ElementTree.fromstring(book.read(full))
            if is_nav:
                for nav in _find(tree, "nav"):
                    for top in [x for x in nav if _name(x.tag)[1] == "ol"]:
                        _nav(top, 1, toc)
            else:
                for top in _find(tree, "navMap"):
                    _ncx(top, 1, toc)
        except Exception:  # noqa: BLE001  whatever is wrong with it, it has no entries then
            continue
        if toc:
            return toc
    return []


def read_epub(content: bytes) -> dict:
    """items, spine, toc and metadata of a whole book."""
    return read_book(zipfile.ZipFile(io.BytesIO(content)))


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, error (null if it could be read), items, spine, toc, metadata. Any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(path)
    return parse_epubs(files.select("path", "content"))


def parse_epubs(files: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                row = {"path": path, "error": None, "items": [], "spine": [], "toc": [], "metadata": []}
                try:
                    row |= read_epub(content)
                except Exception as e:  # noqa: BLE001  one bad book doesn't end the job
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([row], columns=[f.name for f in BOOK])  # unpacked, a book at a time

    return files.mapInPandas(run, BOOK)


def table(books: DataFrame, name: str) -> DataFrame:
    """items, spine, toc or metadata of the books, keyed by doc_id (the path). Persist the books to parse each once."""
    return books.select(F.col("path").alias("doc_id"), F.explode(name).alias("r")).select("doc_id", "r.*")


DC, OPF = "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/opf"


def _attributes(attrs: dict[str, str]) -> str:
    """Attributes without a name space, of the package's own and of XML's; others go."""
    out = []
    for name, value in attrs.items():
        space, local = _name(name)
        prefix = {"": "", OPF: "opf:", "http://www.w3.org/XML/1998/namespace": "xml:"}.get(space)
        if prefix is not None:
            out.append(f' {prefix}{local}="{escape(value)}"')
    return "".join(out)


def _metadata(title: str, source: list[dict]) -> str:
    """The source's entries, but its titles, with the title given. The first identifier becomes the book's; what refined either goes."""
    lines, replaced, named = [], set(), False
    for m in source:
        if m["key"] == "title" or (m["key"] == "identifier" and not replaced):
            replaced.add("#" + m["attrs"].get("id", ""))
    for m in source:
        attrs = dict(m["attrs"])
        if m["namespace"] == DC and m["key"] != "title":
            if m["key"] == "identifier" and not named:
                attrs, named = {**attrs, "id": "id"}, True
            elif attrs.get("id") == "id":
                del attrs["id"]
            lines.append(f"<dc:{m['key']}{_attributes(attrs)}>{escape(m['value'])}</dc:{m['key']}>")
        elif m["namespace"] == OPF and m["key"] == "meta" and attrs.get("refines") not in replaced:
            lines.append(f"<meta{_attributes(attrs)}>{escape(m['value'])}</meta>")
    if not named:
        lines.insert(0, '<dc:identifier id="id">urn:leafwork:book</dc:identifier>')
    if not any(m["key"] == "language" for m in source):
        lines.append("<dc:language>en</dc:language>")
    return "".join(lines) + f"<dc:title>{escape(title)}</dc:title>"


def book_bytes(title: str, chapters: list[tuple[str, str | bytes]], resources: list[tuple[str, str, bytes]] = (), metadata: list[dict] = ()) -> bytes:
    """A small EPUB 3 with both kinds of contents. chapters: (file name, XHTML); resources: (file name, media type, bytes); metadata: as read_epub gives it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, data: str | bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, how)

        taken = {name for name, _ in chapters}
        resources = [r for r in {r[0]: r for r in resources}.values() if r[0] not in taken]
        taken |= {name for name, _, _ in resources}
        nav, ncx = (next(n for n in (stem + end, "leafwork-" + stem + end) if n not in taken) for stem, end in (("nav", ".xhtml"), ("toc", ".ncx")))
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        files = [(f"c{i}", name, "application/xhtml+xml") for i, (name, _) in enumerate(chapters)] + [(f"r{i}", name, kind) for i, (name, kind, _) in enumerate(resources)]
        listed = "".join(f'<item id="{i}" href="{escape(quote(n))}" media-type="{escape(t)}"/>' for i, n, t in files)
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
        put("book.opf", f'<?xml version="1.0"?><package xmlns="{OPF}" xmlns:opf="{OPF}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{DC}">{_metadata(title, list(metadata))}</metadata><manifest>{listed}<item id="nav" href="{nav}" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="{ncx}" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx"><itemref idref="nav"/>{refs}</spine></package>')
        links = "".join(f'<li><a href="{escape(quote(n))}">{escape(title)}</a></li>' for n, _ in chapters[:1])
        put(nav, f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        points = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{escape(title)}</text></navLabel><content src="{escape(quote(n))}"/></navPoint>' for i, (n, _) in enumerate(chapters[:1]))
        put(ncx, f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        for name, data in [*chapters, *((n, d) for n, _, d in resources)]:
            put(name, data)
    return out.getvalue()
