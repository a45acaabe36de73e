"""Package and contents files of books as Column functions: XML text in, arrays and maps out, all in the JVM.

Names are local names, whatever their prefixes. Text that is no XML, or lacks what is asked, gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions import strings as S

# The elements of the Dublin Core set, in its order, and the attributes that entries of a package carry.
TERMS = ("title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights")
ATTRIBUTES = ("id", "role", "file-as", "scheme", "lang", "event", "name", "content", "property", "refines")
DOCUMENT_TYPES = ("application/xhtml+xml", "text/html")
CONTENTS_TYPE = "application/x-dtbncx+xml"
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_ENTRY = "array<struct<_VALUE:string," + ",".join(f"`_{a}`:string" for a in ATTRIBUTES) + ">>"
_METADATA = "metadata struct<" + ",".join(f"`{t}`:{_ENTRY}" for t in (*TERMS, "meta")) + ">"
_MANIFEST = "manifest struct<item:array<struct<_id:string,_href:string,`_media-type`:string,_properties:string>>>"
_SPINE = "spine struct<itemref:array<struct<_idref:string>>>"
_VALUES = "array<struct<value:string,attrs:map<string,string>>>"


def _entries(found: Column) -> Column:
    named = lambda x: F.map_filter(F.create_map(*(p for a in ATTRIBUTES for p in (F.lit(a), x[f"_{a}"]))), lambda k, v: v.isNotNull())
    return F.coalesce(F.transform(found, lambda x: F.struct(F.coalesce(S.strip(x["_VALUE"]), F.lit("")).alias("value"), named(x).alias("attrs"))), F.array()).cast(_VALUES)


def package_metadata(xml: Column) -> Column:
    """namespace (dc or opf) -> key -> values with attributes, in the order of the file: a map of maps without empty entries."""
    own = F.from_xml(xml, _METADATA, _OPTIONS)["metadata"]
    some = lambda m: F.map_filter(m, lambda k, v: F.size(v) > 0)
    terms = some(F.create_map(*(p for t in TERMS for p in (F.lit(t), _entries(own[t])))))
    return some(F.create_map(F.lit("dc"), terms, F.lit("opf"), some(F.create_map(F.lit("meta"), _entries(own["meta"])))))


def package_items(xml: Column) -> Column:
    """array of (item_id, href, item_type), in the order of the file; type and unquoting as the reader of files has them."""
    own = F.from_xml(xml, _MANIFEST, _OPTIONS)["manifest"]["item"]
    plain = lambda h: F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h, F.lit(""))
    listed = lambda x: F.array_contains(F.split(F.coalesce(x["_properties"], F.lit("")), r"\s+"), "nav")
    kind = lambda x: F.when(listed(x) | (x["_media-type"] == CONTENTS_TYPE), "navigation").when(x["_media-type"].isin(*DOCUMENT_TYPES), "document").otherwise(F.coalesce(x["_media-type"], F.lit("")))
    return F.coalesce(F.transform(own, lambda x: F.struct(x["_id"].alias("item_id"), plain(x["_href"]).alias("href"), kind(x).alias("item_type"))), F.array()).cast("array<struct<item_id:string,href:string,item_type:string>>")


def package_spine(xml: Column) -> Column:
    """array of item ids in reading order."""
    own = F.from_xml(xml, _SPINE, _OPTIONS)["spine"]["itemref"]
    return F.coalesce(F.transform(own, lambda x: x["_idref"]), F.array().cast("array<string>"))


def ncx_entries(xml: Column, deepest: int = 8) -> Column:
    """array of (level, title, href) of an NCX file in pre-order, from level 1 to `deepest`, which the XML schema spells out.

    A point without label or target has no entry and hands its children on.
    """
    kind = ""
    for _ in range(deepest):
        kind = f"struct<navLabel:struct<text:string>,content:struct<_src:string>{kind}>"
        kind = f",navPoint:array<{kind}>"
    points = F.from_xml(xml, f"navMap struct<{kind[1:]}>", _OPTIONS)["navMap"]["navPoint"]

    def below(found: Column, level: int) -> Column:
        def rows(p: Column) -> Column:
            own = F.array(F.struct(F.lit(level).alias("level"), S.strip(p["navLabel"]["text"]).alias("title"), p["content"]["_src"].alias("href")))
            return F.concat(own, below(p["navPoint"], level + 1)) if level < deepest else own

        return F.coalesce(F.flatten(F.transform(found, rows)), F.array().cast("array<struct<level:int,title:string,href:string>>"))

    return F.filter(below(points, 1), lambda e: e["title"].isNotNull() & (e["href"] != ""))
