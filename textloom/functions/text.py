"""Scalar text functions as Column builders. All but one stay inside the JVM."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed marks of refusals and of residual markup.
REFUSALS = ("cannot answer", "not mentioned", "no relevant", "unable to", "无法回答", "没有提到", "未提及", "資料中沒有")
MARKUP = ("{{", "}}", "[[", "]]", "<ref", "{|")
#: Fixed one-to-one pairs of traditional and simplified letters for the default normaliser.
TRADITIONAL, SIMPLIFIED = "張國學會歷來東車馬長門開關電話語說讀書寫體點時間問題實現發後數與這個們腦為過還進運動選舉戰爭聯區縣鄉", "张国学会历来东车马长门开关电话语说读书写体点时间问题实现发后数与这个们脑为过还进运动选举战争联区县乡"
#: Fixed stop words of the tokeniser.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "was")
STOP_PAIRS = ("的是", "这个", "那个", "我们", "他们")

#: Fixed patterns: what ends a sentence and a clause.
SENTENCE_END = r"[。！？；\n]+|(?<=[.!?])\s+"
CLAUSE_END = r"[，,；;：:]+|\s*[（(][^）)]{0,20}[）)]\s*"

SPACE = r"[\s 　]"
PUNCTUATION = r"[\s\p{P}\p{S}]"


def replace_all(text: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def squeeze(text: Column) -> Column:
    """Runs of two blanks or more to one, three or more line ends to two, trimmed."""
    return replace_all(text, (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))


def strip_tags(text: Column) -> Column:
    """Tags of up to 200 characters."""
    return F.regexp_replace(text, r"<[^>]{1,200}>", "")


def tokens(text: Column) -> Column:
    """C9 for Latin text: lower-case runs of two letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def mixed_tokens(text: Column, normalise: Callable[[Column], Column] | None = None) -> Column:
    """C9, C10 without a segmenter: words of two Latin letters or digits that are no number and no stop
    word, then the pairs of neighbouring letters of each Han run, after normalising the script."""
    t = F.lower((normalise or to_simplified)(text))
    words = F.filter(F.regexp_extract_all(t, F.lit("(?=[0-9]*[a-z])[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    runs = F.regexp_extract_all(t, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    return F.concat(words, F.filter(F.flatten(F.transform(runs, lambda r: grams(r, 2))), lambda w: ~w.isin(*STOP_PAIRS)))


def has_mixed_tokens(text: Column) -> Column:
    """Whether ``mixed_tokens`` finds any, by one search that ends at the first."""
    word = f"(?<![a-z0-9])(?!(?:{'|'.join(STOP_WORDS)})(?![a-z0-9]))(?=[0-9]*[a-z])[a-z0-9]{{2}}"
    return F.lower(to_simplified(text)).rlike(f"{word}|(?!{'|'.join(STOP_PAIRS)})[\\u4e00-\\u9fff]{{2}}")


def letter_ratio(text: Column, letters: str = "[A-Za-z]") -> Column:
    """C3 with the script as a parameter; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(letters)) / F.length(text))


def cjk_ratio(text: Column) -> Column:
    return letter_ratio(text, "[\\u4e00-\\u9fff]")


def max_char_share(text: Column) -> Column:
    """C4: share of the most frequent character; 1 for an empty text, null for a null one. Counted in Arrow
    batches, as no built-in function counts letters in one pass."""

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else max(Counter(t).values()) / len(t) if t else 1.0).astype("float64")

    return share(text)


def to_simplified(text: Column) -> Column:
    """Letter by letter; null gives the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), TRADITIONAL, SIMPLIFIED)


def traditional_ratio(text: Column) -> Column:
    """Share of letters that C6 changes."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(text, F.lit(f"[{TRADITIONAL}]")) / n)


def grams(text: Column, n: int) -> Column:
    """All n-grams of characters, with repetition; none for shorter texts."""
    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    none = F.array().cast("array<string>")
    return F.when(F.length(text) < n, none).otherwise(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def leak_ratio(question: Column, text: Column) -> Column:
    """Share of the question's 4-grams that occur in the text."""
    gs = grams(question, 4)
    return F.when(F.size(gs) == 0, 0.0).otherwise(F.size(F.filter(gs, lambda g: F.contains(text, g))) / F.size(gs))


def answer_coverage(answer: Column, text: Column) -> Column:
    """Share of the answer's distinct letters and digits that the text holds; 1 if there are none."""
    chars = F.array_distinct(F.filter(F.split(F.regexp_replace(answer, r"[^\p{L}\p{N}]", ""), ""), lambda c: c != ""))
    held = F.filter(chars, lambda c: F.contains(text, c))
    return F.when(F.size(chars) == 0, 1.0).otherwise(F.size(held) / F.size(chars))


def is_listy(text: Column) -> Column:
    """C14: many bullet lines, or many short ones; true without lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    n = F.size(lines)
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^[ ]*[-*#0-9]")))
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 12))
    return F.when(n == 0, True).otherwise((bullets / n >= 0.35) | ((n >= 5) & (short / n >= 0.6)))


def sentences(text: Column, least: int = 4) -> Column:
    """C17: trimmed sentences of ``least`` characters or more; a Latin full stop ends one before white space."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def clauses(sentence: Column) -> Column:
    """C17: parts between commas, colons, semicolons and short brackets."""
    return F.filter(F.transform(F.split(sentence, CLAUSE_END), lambda c: F.trim(c)), lambda s: s != "")


def citations(answer: Column) -> Column:
    """C20: distinct numbers in [n] with up to three digits, sorted."""
    found = F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def is_refusal(answer: Column, markers: tuple[str, ...] = REFUSALS) -> Column:
    """Any marker, case and spacing aside."""
    flat = F.regexp_replace(F.lower(answer), r"[\s\[\]]", "")
    return reduce(lambda a, b: a | b, [F.contains(flat, F.lit(m.replace(" ", ""))) for m in markers])


def numbers(text: Column) -> Column:
    """Distinct numbers outside of citations."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"\[[0-9]+\]", ""), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))))


def question_id(tag: Column, question: Column) -> Column:
    """C26."""
    return F.concat(tag, F.lit("-"), F.substring(F.md5(question), 1, 6))


def chunk_text_for_embedding(title: Column, section: Column, text: Column) -> Column:
    """C8."""
    return F.concat_ws("｜", title, F.nullif(section, F.lit("")), text)
