"""Wikitext to plain text, as rules in a fixed order.

Groups of rules that repeat, or take a text apart, get it as the variable of a lambda, so that the plan holds
every pattern once; a group runs only where its opening mark is still there. (?U) makes \\s what Unicode
holds for white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import replace_all

#: Fixed names of namespaces and order of language variants.
MEDIA = "File|Image|文件|图像|圖片"
CATEGORY = "Category|分類|分类"
VARIANTS = ("zh-cn", "zh-hans", "zh", "zh-hant", "zh-tw", "zh-hk")

#: Fixed patterns, which follow from the markup. A link's inside holds single brackets, but no double ones.
INSIDE = r"(?:(?!\[\[|\]\]).)"
COMMENT = (r"(?s)<!--.*?-->", "")
REFERENCE = (r"(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
TABLE = (r"(?s)\{\|.*?\|\}", "")
CATEGORIES = (rf"(?iU)\[\[\s*:?\s*(?:{CATEGORY})\s*:[^\[\]]*\]\]", "")
GALLERY = (r"(?is)<gallery[^>]*>.*?</gallery\s*>", "")
STRICT_VARIANT, ANY_VARIANT = r"-\{([^{}]*)\}-", r"(?s)-\{((?:(?!-\{|\}-).)*)\}-"
LANGUAGE = (r"(?iU)\{\{\s*lang(?:ue)?\s*[-|]\s*[a-zA-Z-]+\s*\|\s*([^{}|]+?)\s*\}\}", "$1")
TEMPLATE = (r"(?s)\{\{(?:(?!\{\{|\}\}).)*?\}\}", "")
PLAIN = rf"\[\[(?!\s*(?:{MEDIA}|{CATEGORY})\s*:)"
LINKS = (
    (rf"(?isU)\[\[(?:{MEDIA})\s*:{INSIDE}*?\]\]", ""),
    (rf"(?isU){PLAIN}{INSIDE}+?\|({INSIDE}+?)\]\]", "$1"),
    (rf"(?isU){PLAIN}({INSIDE}+?)\]\]", "$1"),
)
INLINE = ((r"(?U)\[https?://\S+\s*([^\]]*)\]", "$1"), (r"<[^>]{1,200}>", ""), (r"'''''|'''|''", ""), (r"__[A-Z]+__", ""))
#: What may stand alone between brackets that lost their content; dots are left out, as (...) is meant.
HOLLOW = r"[\s，。；：、,;:\-–—]*"
SHELLS = "(?U)" + "|".join(f"[{opening}]{HOLLOW}[{closing}]" for opening, closing in ("（( ）)".split(), "《》", "「『 」』".split(), "【】", "“”"))
PUNCTUATION = ((r"[，；、]*。[，。；、]*", "。"), (r"([，；、])[，；、]+", "$1"))
BLANKS = ((r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"))
TRIM = (r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
MARKS = ("[[", "]]", "{{", "}}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with its value made once, however often it is mentioned."""
    return F.transform(F.array(value), body)[0]


def where(text: Column, mark: str, body: Callable[[Column], Column]) -> Column:
    """The body of a text that holds the mark; any other as it is."""
    return let(text, lambda x: F.when(F.contains(x, F.lit(mark)), body(x)).otherwise(x))


def pick_variant(body: Column) -> Column:
    """the text of the first variant at hand; a body without any colon as it is, else what stands behind
    the first one; nothing where links or templates are left inside."""

    def picked(x: Column) -> Column:
        found = F.when(~F.contains(x, F.lit(":")), x).otherwise(F.regexp_extract(x, r"(?s)^[^:]*:([^;]*)", 1))
        for v in reversed(VARIANTS):
            pattern = rf"(?iU){v}\s*:\s*([^;}}]+)"
            found = F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(found)
        return let(F.regexp_replace(found, *TRIM), lambda y: F.when(F.greatest(*[F.contains(y, F.lit(m)) for m in MARKS]), "").otherwise(y))

    return let(F.regexp_replace(body, *TRIM), picked)


def _variants(pattern: str) -> Callable[[Column], Column]:
    """Replaces each -{...}- by its picked variant: texts between and bodies are taken apart and joined."""

    def body(text: Column) -> Column:
        between, bodies = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.array_join(F.transform(F.arrays_zip(between.alias("b"), bodies.alias("v")), lambda x: F.concat(x.b, F.coalesce(pick_variant(x.v), F.lit("")))), "")

    return body


def _times(n: int, *rules: tuple[str, str]) -> Callable[[Column], Column]:
    return lambda text: replace_all(text, *(rules * n))


def clean_wikitext(text: Column) -> Column:
    """Null gives the empty string; plain text comes back as it is but for white space."""
    c = F.coalesce(text, F.lit(""))
    c = where(c, "<!--", lambda x: F.regexp_replace(x, *COMMENT))
    c = where(c, "<", lambda x: F.regexp_replace(x, *REFERENCE))
    c = where(c, "{|", lambda x: F.regexp_replace(x, *TABLE))
    c = where(c, "[[", lambda x: F.regexp_replace(x, *CATEGORIES))
    c = where(c, "<", lambda x: F.regexp_replace(x, *GALLERY))
    c = where(c, "-{", _variants(STRICT_VARIANT))
    c = where(c, "{{", lambda x: _times(10, TEMPLATE)(F.regexp_replace(x, *LANGUAGE)))
    c = where(c, "[[", _times(8, *LINKS))
    c = where(c, "[http", lambda x: F.regexp_replace(x, *INLINE[0]))
    c = replace_all(c, *INLINE[1:])
    for _ in range(2):
        c = where(c, "-{", _variants(ANY_VARIANT))
    for _ in range(3):
        c = F.regexp_replace(c, SHELLS, "")
    return replace_all(c, *PUNCTUATION, *BLANKS, TRIM)
