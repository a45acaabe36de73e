"""Text functions as Catalyst expressions; white space and digits are Unicode's, and U+001C-U+001F count as white space."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
# The heading patterns, case aside. The roman letters aren't followed by a boundary, so "Part my car" matches.
HEADINGS = (
    rf"^Chapter{SPACE}+(?:\d+|[IVXLCDM]+)[\s\x1c-\x1f:.-]*.*$",
    rf"^Part{SPACE}+(?:\d+|[IVXLCDM]+)[\s\x1c-\x1f:.-]*.*$",
    rf"^\d+\.{SPACE}+.+$",
)
# Fixed value: targets of url(...) in a style sheet, quotes aside.
URL = r"""url\(["']?([^"')]+)["']?\)"""
# Characters that a file name can't have, and its greatest length.
UNSAFE = '<>:"/\\|?*'
NAME_LENGTH = 100


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != ""))


def is_heading(c: Column, patterns: Sequence[str] = HEADINGS) -> Column:
    """Whether stripped text matches one of the patterns (Java's syntax, case aside): by default, whether it starts as a chapter, a part or a numbered heading does."""
    return c.rlike("(?iuUd)" + "|".join(patterns)) if patterns else F.lit(False)


def heading_score(text: Column, size: Column, patterns: Sequence[str] = HEADINGS) -> Column:
    """Confidence in [0, 1] of stripped text set in `size` points; sums are of doubles, in this order."""
    words = word_count(text)
    score = F.lit(0.5) + F.when(is_heading(text, patterns), F.lit(0.4)).otherwise(F.lit(0.0))
    score = score + F.when(size >= 16, F.lit(0.1)).when(size >= 14, F.lit(0.05)).otherwise(F.lit(0.0))
    score = score - F.when(words > 10, F.lit(0.2)).when(words > 6, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def safe_name(title: Column, length: int = NAME_LENGTH) -> Column:
    """A title as part of a file name: unsafe characters and white space become single underscores, none at the ends."""
    c = F.translate(title, UNSAFE, "_" * len(UNSAFE))
    c = F.regexp_replace(c, r"(?U)[\s_\x1c-\x1f]+", "_")
    c = F.regexp_replace(c, "^_+|_+$", "")
    c = F.when(F.length(c) > length, F.regexp_replace(F.substring(c, 1, length), "_+$", "")).otherwise(c)
    return F.when(c == "", F.lit("untitled")).otherwise(c)


def template(pattern: str, fields: dict[str, Column]) -> Column:
    """A file-name pattern such as `{index:02d}_{title}` as a concatenation; fields it doesn't know are an error now, not in a task."""
    parts: list[Column] = []
    for text, name, spec, conversion in string.Formatter().parse(pattern):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if name not in fields:
            raise KeyError(name)
        if conversion:
            raise ValueError(f"{{{name}!{conversion}}} is not supported")
        value = fields[name].cast("string")
        if spec:
            width = re.fullmatch(r"(0?)(\d+)d?", spec)
            if not width:
                raise ValueError(f"{{{name}:{spec}}} is not supported")
            value = F.when(F.length(value) >= int(width[2]), value).otherwise(F.lpad(value, int(width[2]), "0" if width[1] else " "))
        parts.append(value)
    return F.concat(*parts) if parts else F.lit("")


def with_suffix(name: Column, suffix: str, instead: str | None = None) -> Column:
    """name with the suffix, whatever its case; `instead` is another suffix that is replaced."""
    out = F.when(F.lower(name).endswith(suffix), name)
    if instead:
        out = out.when(F.lower(name).endswith(instead), F.concat(F.substring(name, F.lit(1), F.length(name) - len(instead)), F.lit(suffix)))
    return out.otherwise(F.concat(name, F.lit(suffix)))


def href_file(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def href_anchor(href: Column) -> Column:
    """What follows the first #, else empty."""
    at = F.instr(href, "#")
    return F.when(at > 0, F.substring(href, at + 1, F.length(href))).otherwise(F.lit(""))


def directory(path: Column) -> Column:
    """What stands before the last slash ("" if none; "/" for a name at the root)."""
    head = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.rlike(r"^/[^/]*$"), F.lit("/")).otherwise(head)


def join_path(base: Column, href: Column) -> Column:
    """href below a directory; an absolute href stands for itself, `..` stays as it is, a leading ./ goes."""
    plain = F.regexp_replace(href, r"^(?:\./)+", "")
    return F.when(href.startswith("/"), href).when(F.coalesce(base, F.lit("")).isin("", "."), plain).when(base == "/", F.concat(F.lit("/"), plain)).otherwise(F.concat(base, F.lit("/"), plain))


def percent(confidence: Column) -> Column:
    return F.format_string("%.0f%%", confidence * 100)


def colour(confidence: Column, middle: float = 0.6) -> Column:
    """green from 0.8 on, yellow from `middle` on (0.6 for page layouts, 0.5 for books), else red."""
    return F.when(confidence >= 0.8, "green").when(confidence >= middle, "yellow").otherwise("red")


def ellipsis(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def shown_file(path: Column, anchor: Column) -> Column:
    """Base name, and #anchor if there is one."""
    return F.concat(F.regexp_extract(path, r"([^/]*)$", 1), F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(F.lit("#"), anchor)).otherwise(F.lit("")))


def location(path: Column, anchor: Column) -> Column:
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(path, F.lit("#"), anchor)).otherwise(path)


def indent(level: Column) -> Column:
    return F.repeat(F.lit("  "), (level - 1).cast("int"))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def default_output(path: Column) -> Column:
    """`<parent>/<stem>_chapters` of a document's path."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit("_chapters"))


def is_kind(path: Column, kind: str) -> Column:
    return F.lower(path).endswith(f".{kind}")


def css_urls(style: Column) -> Column:
    """Targets of url(...), quotes aside."""
    return F.regexp_extract_all(style, F.lit(URL), F.lit(1))
