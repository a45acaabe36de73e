"""The test tables seen as documents: orders as outlines, texts as page layouts, web pages as files of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Lazy views over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # outlines: a customer's orders by date
    def outline(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        before = F.coalesce(F.sum(F.col("o_orderkey") % 5).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return self("orders").select(
            F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("seq"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"),
            F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), (before + 1).alias("page"),
        )

    def outline_documents(self) -> DataFrame:
        return self.outline().groupBy("doc_id").agg((F.max("page") + 2).alias("total_pages"))

    # layouts: a source's documents as its pages, lines as lines
    def _pages(self) -> DataFrame:
        n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
        page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
        return self("documents").select("doc_id", "source", "text", n.alias("n"), page.alias("page"))

    def layout_documents(self) -> DataFrame:
        return self("documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("total_pages"))

    def spans(self) -> DataFrame:
        lines = self._pages().select("doc_id", "source", "n", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
        c = F.col
        early = c("n") < 16
        size = F.when(early & (c("line") == 0), F.element_at(F.array(*[F.lit(float(x)) for x in (18, 16, 14, 12)]), (c("doc_id") % 4).cast("int") + 1)).otherwise(F.lit(11.0))
        page = c("page").cast("string")
        text = F.when(early & (c("line") == 0) & (c("doc_id") % 3 == 0), F.concat(F.lit("Chapter "), page, F.lit(": "), c("raw"))).when(early & (c("line") == 1) & (c("doc_id") % 5 == 0), F.concat(F.lit("Part "), page, F.lit(" "), c("raw"))).otherwise(c("raw"))
        return lines.select(c("source").alias("doc_id"), "page", F.lit(0).alias("block"), F.lit(0).alias("block_type"), "line", F.lit(0).alias("span"), text.alias("text"), size.alias("size"))

    def mixed_spans(self) -> DataFrame:
        """Lines cut into two spans, the second of another size; three lines make a block, and each fourth block is an image."""
        c, cut = F.col, 12
        block = F.floor(c("line") / 3).cast("int")
        two = F.array(F.struct(F.lit(0).alias("span"), F.substring("text", 1, cut).alias("text"), c("size")), F.struct(F.lit(1).alias("span"), F.expr(f"substring(text, {cut + 1})").alias("text"), (c("size") + c("page") % 2 * 3.0).alias("size")))
        return self.spans().select("doc_id", "page", block.alias("block"), F.when(block % 4 == 3, 1).otherwise(0).alias("block_type"), "line", F.inline(two))

    def nested_pages(self) -> DataFrame:
        """The pages of mixed_spans as a row each: blocks of three lines, lines of two spans."""
        c, cut = F.col, 12
        page, n = c("page").cast("string"), c("n")
        sizes = F.element_at(F.array(*[F.lit(float(x)) for x in (18, 16, 14, 12)]), (c("doc_id") % 4).cast("int") + 1)

        def line(x: Column, i: Column) -> Column:
            text = F.when((n < 16) & (i == 0) & (c("doc_id") % 3 == 0), F.concat(F.lit("Chapter "), page, F.lit(": "), x)).when((n < 16) & (i == 1) & (c("doc_id") % 5 == 0), F.concat(F.lit("Part "), page, F.lit(" "), x)).otherwise(x)
            size = F.when((n < 16) & (i == 0), sizes).otherwise(F.lit(11.0))
            two = F.array(F.struct(F.substring(text, 1, cut).alias("text"), size.alias("size")), F.struct(F.substring(text, F.lit(cut + 1), F.length(text)).alias("text"), (size + c("page") % 2 * 3.0).alias("size")))
            return F.struct(two.alias("spans"))

        # explode keeps the optimizer from splitting the text once more for each block
        cut_up = self._pages().select("doc_id", "source", "page", "n", F.explode(F.array(F.split("text", "\n"))).alias("raw")).where("raw IS NOT NULL")
        block = lambda b: F.struct(F.when(b % 4 == 3, 1).otherwise(0).alias("type"), F.transform(F.slice("raw", b * 3 + 1, F.lit(3)), lambda x, k: line(x, b * 3 + k)).alias("lines"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("raw") - 1) / 3).cast("int")), block)
        return cut_up.withColumn("blocks", blocks).select(c("source").alias("doc_id"), "page", F.explode(F.array("blocks")).alias("blocks"))

    def layout_outline(self) -> DataFrame:
        p = self._pages().where("n % 3 < 2")
        level = F.when(F.col("n") % 3 == 0, (F.col("doc_id") % 2 + 1).cast("int")).otherwise(F.lit(2))
        return p.select(F.col("source").alias("doc_id"), F.col("page").cast("int").alias("seq"), level.alias("level"), F.concat(F.lit("Entry "), F.col("doc_id").cast("string")).alias("title"), "page")

    # books: a host's web pages
    def _files(self) -> DataFrame:
        host, path = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
        return self("pages").select("page_id", host.alias("doc_id"), F.row_number().over(Window.partitionBy(host).orderBy("page_id")).alias("pos"), path.alias("href"), "html")

    def items(self) -> DataFrame:
        return self._files().select("doc_id", F.col("page_id").cast("string").alias("item_id"), F.col("pos").alias("ordinal"), "href", F.lit("document").alias("item_type"), F.col("html").alias("content"))

    def spine(self) -> DataFrame:
        return self._files().select("doc_id", "pos", F.col("page_id").cast("string").alias("item_id"))

    def toc(self) -> DataFrame:
        """Navigation links, in the order of pages."""
        link = '<li><a href="([^"]*)">([^<]*)</a>'
        both = self._files().select("doc_id", "page_id", F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("t")).alias("z"))
        rows = both.select("doc_id", "page_id", F.posexplode("z").alias("at", "z"))
        seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id", "at"))
        return rows.select("doc_id", seq.alias("seq"), F.lit(1).alias("level"), F.col("z.t").alias("title"), F.concat("z.h", F.lit("#p"), F.col("page_id").cast("string")).alias("href"))

    def toc_tree(self) -> DataFrame:
        """Regions hold nations, nations hold customers."""
        r, n, c = self("region"), self("nation"), self("customer")
        key = lambda kind, k: F.concat(F.lit(kind), F.col(k).cast("string"))
        top = r.select(F.col("r_regionkey").alias("doc_id"), key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), F.col("r_name").alias("title"), key("r", "r_regionkey").alias("href"))
        mid = n.select(F.col("n_regionkey").alias("doc_id"), key("n", "n_nationkey").alias("node_id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ordinal"), F.col("n_name").alias("title"), F.concat(key("r", "n_regionkey"), F.lit("#"), key("n", "n_nationkey")).alias("href"))
        low = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("doc_id"), key("c", "c_custkey").alias("node_id"), key("n", "n_nationkey").alias("parent_id"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("title"), F.concat(key("n", "n_nationkey"), F.lit("#"), key("c", "c_custkey"), F.lit("#x")).alias("href"))
        return top.unionByName(mid).unionByName(low)

    # books with resources: pages with a style sheet, an image and a font put in front
    def rich_items(self) -> DataFrame:
        f, k = self._files(), F.col("page_id")
        head = F.concat(
            F.lit('<link rel="stylesheet" href="css/s'), (k % 3).cast("string"), F.lit('.css#v1"><img src="/img/'), (k % 7).cast("string"),
            F.lit('.png"><style>@font-face{src:url("fonts/f'), (k % 5).cast("string"), F.lit('.woff")}</style>'),
        )
        pages = f.select("doc_id", k.cast("string").alias("item_id"), F.col("pos").alias("ordinal"), "href", F.lit("document").alias("item_type"), F.concat(head, "html").alias("content"))
        folders = f.select("doc_id", F.regexp_extract("href", r"^(.*)/[^/]*$", 1).alias("dir")).distinct()
        hrefs = F.array(F.lit("css/s0.css"), F.concat("dir", F.lit("/css/s1.css")), F.lit("/img/3.png"), F.lit("/img/5.png"), F.concat("dir", F.lit("/fonts/f2.woff")), F.lit("fonts/f4.woff"))
        files = folders.where("dir <> ''").select("doc_id", F.explode(hrefs).alias("href")).distinct()
        return pages.unionByName(files.select("doc_id", F.col("href").alias("item_id"), F.lit(0).alias("ordinal"), "href", F.lit("resource").alias("item_type"), F.lit(None).cast("string").alias("content")))

    # books whose pages have a deep heading in front and a lower one, with an id, behind; empty references too
    def headed_items(self) -> DataFrame:
        k = F.col("item_id")
        front = F.concat(F.lit('<img src=""><img><link rel="stylesheet" href=""><img src="/i'), k, F.lit('.png"><h3>Deep '), k, F.lit("</h3>"))
        back = F.concat(F.lit('<h2 id="s'), k, F.lit('">Sub '), k, F.lit("</h2><h2> </h2>"))
        return self.items().withColumn("content", F.concat(front, "content", back))

    # books of which each third page is an image, and whose reading order names pages that they don't have
    def gappy_items(self) -> DataFrame:
        return self.items().withColumn("item_type", F.when(F.col("ordinal") % 3 == 0, "image").otherwise("document"))

    def gappy_spine(self) -> DataFrame:
        both = F.array(F.struct((F.col("pos") * 2).alias("pos"), F.col("item_id")), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.concat(F.lit("x"), "item_id").alias("item_id")))
        return self.spine().select("doc_id", F.inline(both))

    # labelled documents as chapters, whose contents are partly missing
    def labelled_plan(self) -> DataFrame:
        d = self("documents").select("doc_id", "source")
        w = Window.partitionBy("source").orderBy("doc_id")
        return self("labels").join(d, "doc_id").select(F.col("source").alias("doc_id"), F.row_number().over(w).alias("chapter_index"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.when(F.col("quality") == 1, 0.9).otherwise(0.45).alias("confidence"))

    def labelled_items(self) -> DataFrame:
        d = self("documents").where("doc_id % 3 <> 0")
        return d.select(F.col("source").alias("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("href"), F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("content"))

    # books of a page each, as the XML texts of their package and contents files
    def packages(self) -> DataFrame:
        k, text = F.col("page_id").cast("string"), lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        head = '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><dc:title id="t'
        xml = F.concat(
            F.lit(head), k, F.lit('">'), text(F.col("url")), F.lit('</dc:title><dc:creator opf:role="aut">Author '), k, F.lit("</dc:creator><dc:creator> Other </dc:creator>"),
            F.when(F.col("page_id") % 3 == 0, F.lit("<dc:language>en</dc:language>")).otherwise(""), F.lit('<meta name="cover" content="i'), k, F.lit('"/></metadata><manifest><item id="a" href="text/c%20'), k,
            F.lit('.xhtml" media-type="application/xhtml+xml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/></spine></package>'),
        )
        return self("pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 10 == 9, F.substring(xml, 1, 200)).otherwise(xml).alias("xml"))  # one in ten is cut off

    def contents_files(self) -> DataFrame:
        """A point for the page, below it one for each navigation link, below each of these one without a label that has one with a label below it."""
        link, text = '<li><a href="([^"]*)">([^<]*)</a>', lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
        both = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("t"))
        point = lambda title, href: F.concat(F.lit("<navPoint><navLabel><text>"), title, F.lit('</text></navLabel><content src="'), href, F.lit('"/>'))
        inner = F.transform(both, lambda z, i: F.concat(point(text(z["t"]), text(z["h"])), F.lit('<navPoint><content src="x"/>'), point(F.concat(F.lit("below "), i.cast("string")), F.lit("y")), F.lit("</navPoint></navPoint></navPoint>")))
        top = point(F.concat(F.lit("Page "), F.col("page_id").cast("string")), text(F.col("url")))
        return self("pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit('<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>'), top, F.array_join(inner, ""), F.lit("</navPoint></navMap></ncx>")).alias("xml"))

    # pages with two parts put in front, of which the first holds a paragraph with an id of its own
    def sectioned_items(self) -> DataFrame:
        k = F.col("item_id")
        front = F.concat(
            F.lit('<div id="a'), k, F.lit('"><img src="/i'), k, F.lit('.png"><p id="p'), k, F.lit('"><img src="/j.png"><h3>Deep '), k, F.lit('</h3></p></div><div id="b'), k,
            F.lit('"><link rel="stylesheet" href="s.css"><style>b{background:url(bg.png)}</style><h2>Sub '), k, F.lit('</h2><h1> </h1></div>'),
        )
        return self.items().withColumns({"content": F.concat(front, "content"), "href": F.concat_ws("/", "href", k)})  # no two pages of a book share a name

    def sections(self) -> DataFrame:
        """Chapters by anchor: the parts of each page, and one that isn't there."""
        kinds = F.explode(F.array(*map(F.lit, "abpx"))).alias("kind")
        return self.sectioned_items().select("doc_id", "item_id", F.col("href").alias("file_path"), kinds).select("doc_id", "item_id", "file_path", F.concat("kind", "item_id").alias("html_id"))
