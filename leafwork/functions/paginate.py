"""Wrapping of paragraphs and their place on pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import strings as S

# An A4 page in points, its margin, line height, gap after a paragraph, and the line length in characters.
WIDTH, HEIGHT, MARGIN, LINE, GAP, COLUMNS = 595, 842, 50, 15, 7, 80
LINES = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("text", T.StringType())]))


def paragraphs(text: str) -> list[str]:
    return [p for x in text.split("\n") if (p := x.strip())]


def wrap(paragraph: str, columns: int = COLUMNS) -> list[str]:
    """Greedy lines; a word longer than a line stands alone, and if it comes first an empty line stands before it."""
    lines, line = [], ""
    for word in paragraph.split():
        if len(line) + (1 if line else 0) + len(word) <= columns:
            line = f"{line} {word}" if line else word
        else:
            lines.append(line)
            line = word
    if line:
        lines.append(line)
    return lines


def lay_out(text: str) -> list[tuple[int, int, str]]:
    """(page, y, line): a page ends where the next line would lie below the bottom margin."""
    page, y, out = 1, MARGIN, []
    for p in paragraphs(text):
        for line in wrap(p):
            if y > HEIGHT - MARGIN:
                page, y = page + 1, MARGIN
            out.append((page, y, line))
            y += LINE
        y += GAP
    return out


@F.pandas_udf(LINES)
def _laid_out(text: pd.Series) -> pd.Series:
    return pd.Series([[{"page": p, "y": y, "text": t} for p, y, t in lay_out(x or "")] for x in text])


def page_lines(text: Column) -> Column:
    return _laid_out(text)


def wrapped(paragraph: Column, columns: int = COLUMNS) -> Column:
    """wrap() as a fold over words, in the JVM: the state is the lines that are full and the one that isn't."""
    words = F.filter(F.split(paragraph, rf"(?U){S.SPACE}+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(state: Column, word: Column) -> Column:
        line = state["line"]
        fits = F.length(line) + F.when(line != "", 1).otherwise(0) + F.length(word) <= columns
        longer = F.when(line != "", F.concat(line, F.lit(" "), word)).otherwise(word)
        return F.struct(F.when(fits, state["lines"]).otherwise(F.concat(state["lines"], F.array(line))).alias("lines"), F.when(fits, longer).otherwise(word).alias("line"))

    return F.aggregate(words, start, add, lambda state: F.when(state["line"] != "", F.concat(state["lines"], F.array(state["line"]))).otherwise(state["lines"]))


def folded_lines(text: Column) -> Column:
    """page_lines() in the JVM. One fold wraps each paragraph, one over paragraphs knows where each begins (page, y); its lines follow from that.

    Takes the square of a paragraph's lines, and of a text's paragraphs, in copies of arrays: page_lines() is for very long texts.
    """
    bottom, full = HEIGHT - MARGIN, (HEIGHT - 2 * MARGIN) // LINE + 1  # lines of a whole page
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), S.strip), lambda p: p != "")
    lines = F.transform(found, lambda p: wrapped(p))
    room = lambda y: F.when(y > bottom, 0).otherwise(F.floor((bottom - y) / LINE).cast("int") + 1)
    page = lambda at, i: at["page"] + F.when(i < room(at["y"]), 0).otherwise(1 + F.floor((i - room(at["y"])) / full).cast("int"))
    y = lambda at, i: F.when(i < room(at["y"]), at["y"] + i * LINE).otherwise(MARGIN + (i - room(at["y"])) % full * LINE)
    where = lambda p, v: F.struct(p.cast("int").alias("page"), v.cast("int").alias("y"))
    first = F.struct(F.array().cast("array<struct<page:int,y:int>>").alias("starts"), where(F.lit(1), F.lit(MARGIN)).alias("at"))

    def below(state: Column, n: Column) -> Column:
        at, last = state["at"], n - 1
        return F.struct(F.concat(state["starts"], F.array(at)).alias("starts"), where(page(at, last), y(at, last) + LINE + GAP).alias("at"))

    starts = F.aggregate(F.transform(lines, F.size), first, below, lambda state: state["starts"])
    placed = F.zip_with(lines, starts, lambda own, at: F.transform(own, lambda line, i: F.struct(page(at, i).cast("int").alias("page"), y(at, i).cast("int").alias("y"), line.alias("text"))))
    return F.flatten(placed)
