"""Whether answers are backed by the passages that they cite.

A record has an ``answer`` and ``contexts``, the texts given to the model in the order of their numbers.
Answers are cut into claims (sentences, and their clauses); a claim is held against the passages that it
cites itself, and one without citations against others: a sentence against all, a clause against those that
the answer cites anywhere, or all. Everything happens in the record's own row; only the summary shuffles.
Where the passages are all that was said before, they are no column but rows of their own (``turn_claims``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.answers import flat

#: How sentences begin that only announce something.
FILLER = r"^(答案是|结论|依据|参考|来源|说明|注[:：]?|以上|综上|以下是|主要依据|根据)"
#: Words that speak of the sources and not of facts; callers may pass their own.
META = ("参考资料", "资料", "原文", "上文", "依据", "根据", "记载", "说明", "明确", "指出", "表明", "提到", "显示", "一致", "综合", "判断", "由此", "可见", "因此", "来自", "内容", "是", "也", "和", "的", "在", "中")


def bigrams(flat_text: Column) -> Column:
    """Distinct 2-grams; a single letter counts as one."""
    none = F.array().cast("array<string>")
    return F.when(F.length(flat_text) >= 2, F.array_distinct(T.grams(flat_text, 2))).when(F.length(flat_text) == 1, F.array(flat_text)).otherwise(none)


def is_structural(text: Column, meta: tuple[str, ...] = META) -> Column:
    """Nothing is left without citations, punctuation and words about sources, or no content word is in it."""
    bare = F.regexp_replace(text, r"\[[0-9]{1,3}\]", "")
    longest_first = "|".join(sorted(meta, key=len, reverse=True))
    return ~T.has_mixed_tokens(bare) | flat(bare).rlike(rf"\A(?>{longest_first})*+\z")


def claims(records: DataFrame, meta: tuple[str, ...] = META, share: float = 0.6, word_share: float = 0.6) -> DataFrame:
    """One row a claim with all columns of its record: level, claim, coverage, word_coverage, num_missing,
    weight and four verdicts. A record without claims or contexts (null or empty) keeps one row whose level
    is null; a null answer is empty."""
    given = F.filter(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: c.isNotNull())
    told = F.transform(given, lambda c: F.struct(bigrams(flat(c)).alias("grams"), F.lower(T.to_simplified(c)).alias("norm"), T.numbers(c).alias("digits")))
    rows = _cut(records.withColumn("_told", told), F.size("_told") > 0, meta)
    picked = lambda numbers: F.filter("_told", lambda c, i: F.array_contains(numbers, i + 1))
    rows = rows.withColumns({"_grams": bigrams(F.col("_flat")), "_any": picked(F.col("_cited"))})
    rest = F.when((F.col("level") == "clause") & (F.size("_any") > 0), F.col("_any")).otherwise(F.col("_told"))
    rows = rows.withColumn("_src", F.when(F.col("cites"), picked(F.col("_own"))).otherwise(rest))
    n, k = F.size("_grams"), F.size("_words")
    by_grams = F.transform("_src", lambda c: F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect("_grams", c.grams)) / n))
    by_words = F.transform("_src", lambda c: F.when(k == 0, 1.0).otherwise(F.size(F.filter("_words", lambda w: F.contains(c.norm, w))) / k))
    missed = F.transform("_src", lambda c: F.array_except("_digits", c.digits))
    rows = rows.withColumns({"coverage": F.coalesce(F.array_max(by_grams), F.lit(0.0)), "word_coverage": F.coalesce(F.array_max(by_words), F.lit(0.0)), "_missed": missed})
    # numbers bind only a claim that cites; one passage with all of them is enough
    wrong = F.col("cites") & (F.size("_missed") > 0) & ~F.exists("_missed", lambda m: F.size(m) == 0)
    everywhere = F.aggregate("_missed", F.col("_digits"), lambda a, m: F.array_intersect(a, m))
    rows = rows.withColumn("_all", everywhere).withColumn(
        "num_missing", F.when(wrong, F.array_sort(F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.array_distinct(F.flatten("_missed"))))).otherwise(F.array().cast("array<string>"))
    )
    return _judged(rows, share, word_share).drop(*[c for c in rows.columns if c.startswith("_") and c not in records.columns])


def _cut(records: DataFrame, told: Column, meta: tuple[str, ...]) -> DataFrame:
    """Claims of each record's answer, where ``told``: level, claim, weight, cites, and for the comparison _cited,
    _own, _flat, _words, _digits."""
    answer = F.coalesce("answer", F.lit(""))
    rows = records.withColumns({"_cited": T.citations(answer), "_sentences": T.sentences(answer)})
    rows = rows.withColumn("_s", F.explode_outer(F.when(told, F.col("_sentences"))))
    announces = F.col("_s").rlike(FILLER) & ~F.col("_s").rlike(r"\[[0-9]{1,3}\]")
    none = F.array().cast("array<struct<level:string,claim:string>>")
    whole = F.when(announces, none).otherwise(F.array(F.struct(F.lit("sentence").alias("level"), F.col("_s").alias("claim"))))
    parts = F.filter(T.clauses(F.col("_s")), lambda c: ~is_structural(c, meta))
    parts = F.when(is_structural(F.col("_s"), meta), none).otherwise(F.transform(parts, lambda c: F.struct(F.lit("clause").alias("level"), c.alias("claim"))))
    both = F.when(F.col("_s").isNotNull(), F.concat(whole, parts))
    rows = rows.select("*", F.explode_outer(both).alias("_c")).select("*", "_c.level", "_c.claim")
    rows = rows.withColumns({"_own": T.citations(F.col("claim")), "_flat": flat(F.col("claim")), "_words": F.array_distinct(T.mixed_tokens(F.col("claim"))), "_digits": T.numbers(F.col("claim"))})
    return rows.withColumns({"weight": F.length("_flat"), "cites": F.size("_own") > 0})


def _judged(rows: DataFrame, share: float, word_share: float) -> DataFrame:
    sound = F.size("num_missing") == 0
    rows = rows.withColumns({"lenient": sound & (F.col("coverage") >= share), "words_lenient": sound & (F.col("word_coverage") >= word_share)})
    rows = rows.withColumns({"strict": F.col("cites") & F.col("lenient"), "words_strict": F.col("cites") & F.col("words_lenient")})
    return rows.withColumns({"coverage": F.round("coverage", 3), "word_coverage": F.round("word_coverage", 3)})


#: Turns of a conversation whose answers one task compares at a time, with all turns before.
BLOCK = 256
#: Claims, and distinct grams or words of theirs, that are compared at once; cells of a matrix.
CLAIMS, PARTS, CELLS = 512, 1 << 15, 1 << 22
_RUNS = re.compile("[a-z0-9]+|[\u4e00-\u9fff]+").findall


def turn_claims(turns: DataFrame, group: str, meta: tuple[str, ...] = META, share: float = 0.6, word_share: float = 0.6) -> DataFrame:
    """``claims`` for answers whose contexts are all turns before them in their ``group``: ``turns`` has place (1, 2,
    ... within the group), text, is_answer and answer. Every turn is told once to each block of answers after it
    instead of once to each claim; a null text keeps its number. Claims and turns meet as products of matrices,
    in parts that are bounded however long a conversation is."""
    block = lambda place: F.floor((F.col(place) - 1) / BLOCK).cast("int")
    last = F.max(F.when(F.col("is_answer"), F.col("place"))).alias("last")
    ends = turns.groupBy(F.col(group).alias("_told")).agg(last).where("last is not null")
    told = turns.select(F.col(group).alias("_told"), F.col("place").alias("_at"), flat(F.col("text")).alias("flat"), F.lower(T.to_simplified(F.col("text"))).alias("norm"), T.numbers(F.col("text")).alias("digits"))
    told = told.join(ends, "_told").where("_at < last").select("_told", F.explode(F.sequence(block("_at"), block("last"))).alias("_for"), "_at", "flat", "norm", "digits")
    rows = _cut(turns.where("is_answer").drop("text", "is_answer"), F.col("place") > 1, meta).drop("_sentences", "_s", "_c").withColumn("_block", block("place"))
    kept = [c for c in rows.columns if not c.startswith("_")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept] + ["coverage double", "word_coverage double", "num_missing array<string>"])

    def work(context: pa.Table, claims: pa.Table) -> pa.Table:
        context = context.sort_by("_at")
        columns = _compared(context.column("flat").to_pylist(), context.column("norm").to_pylist(), context.column("digits").to_pylist(), claims.select(["place", "level", "_own", "_cited", "_flat", "_words", "_digits"]).to_pylist())
        found = claims.select(kept)
        for name, values, kind in zip(("coverage", "word_coverage", "num_missing"), columns, (pa.float64(), pa.float64(), pa.list_(pa.string())), strict=True):
            found = found.append_column(name, pa.array(values, kind))
        return found

    found = told.groupBy("_told", "_for").cogroup(rows.groupBy(group, "_block")).applyInArrow(work, schema)
    return _judged(found, share, word_share)


def _compared(flats: list[str], norms: list[str], digits: list[list[str] | None], claims: list[dict]) -> tuple[list, list, list]:
    """coverage, word_coverage and num_missing of each claim; its contexts are those before its place."""
    held, wanted = {}, {w for c in claims for w in c["_words"] or ()}
    widths = sorted({len(w) for w in wanted})
    for at, norm in enumerate(norms):  # a word lies within one run of letters of its kind
        here = {run[i : i + k] for run in set(_RUNS(norm)) for k in widths if k <= len(run) for i in range(len(run) - k + 1)} & wanted
        for word in here:
            held.setdefault(word, []).append(at)
    grams = [{f[i : i + 2] for i in range(len(f) - 1)} | set(f) for f in flats]
    coverage, words, missing = [], [], []
    for part in _parts(claims):
        told = [_sources(c) for c in part]
        asked = [_grams(c["_flat"] or "") for c in part]
        places = {}
        for g in set().union(*asked):
            places[g] = []
        for at, gs in enumerate(grams):
            for g in gs & places.keys():
                places[g].append(at)
        coverage += [0.0 if most <= 0 else most / len(gs) for most, gs in zip(_most(asked, places, told, len(flats)), asked, strict=True)]
        asked = [c["_words"] or () for c in part]
        most = _most(asked, held, told, len(flats))
        words += [0.0 if m < 0 else 1.0 if not ws else m / len(ws) for m, ws in zip(most, asked, strict=True)]
        missing += [_missed(c, own, digits) for c, (_, own) in zip(part, told, strict=True)]
    return coverage, words, missing


def _grams(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)} if len(text) > 1 else {text} if text else set()


def _parts(claims: list[dict]) -> Iterator[list[dict]]:
    part, size = [], 0
    for c in claims:
        part.append(c)
        size += len(c["_flat"] or "")
        if len(part) >= CLAIMS or size >= PARTS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _sources(claim: dict) -> tuple[int, list[int] | None]:
    """How many contexts come before the claim, and of them the cited ones alone (from 0), where it is bound to these."""
    before = claim["place"] - 1
    own = [i - 1 for i in claim["_own"] or () if 1 <= i <= before]
    if claim["_own"]:
        return before, own
    cited = [i - 1 for i in claim["_cited"] or () if 1 <= i <= before] if claim["level"] == "clause" else []
    return before, cited or None


def _most(asked: list, places: dict[str, list[int]], told: list[tuple[int, list[int] | None]], n: int) -> np.ndarray:
    """The most parts of each claim that one of its contexts holds; -1 for a claim without contexts."""
    order = {p: i for i, p in enumerate(dict.fromkeys(p for ps in asked for p in ps))}
    has = np.zeros((len(asked), max(1, len(order))), np.float32)
    for row, ps in enumerate(asked):
        has[row, [order[p] for p in ps]] = 1
    before, best = np.array([b for b, _ in told]), np.full(len(asked), -1.0)
    where = [np.array(places.get(p, ()), np.int64) for p in order]
    row = np.repeat(np.arange(len(where)), [len(w) for w in where])
    col = np.concatenate(where) if where else np.zeros(0, np.int64)
    step = max(1, CELLS // has.shape[1])
    for start in range(0, n, step):
        width = min(step, n - start)
        at = (col >= start) & (col < start + width)
        holds = np.zeros((has.shape[1], width), np.float32)
        holds[row[at], col[at] - start] = 1
        allowed = np.arange(start, start + width)[None, :] < before[:, None]
        for i, (_, own) in enumerate(told):
            if own is not None:
                allowed[i] = False
                allowed[i, [o - start for o in own if start <= o < start + width]] = True
        best = np.maximum(best, np.where(allowed, has @ holds, -1.0).max(axis=1))
    return best


def _missed(claim: dict, own: list[int] | None, digits: list[list[str] | None]) -> list[str]:
    """Numbers bind only a claim that cites; one passage with all of them is enough."""
    if not claim["_own"] or not own:
        return []
    missed = [set(claim["_digits"] or ()) - set(digits[i]) if digits[i] is not None else set() for i in own]
    return sorted(set.intersection(*missed) or set.union(*missed)) if all(missed) else []


def faithfulness(judged_claims: DataFrame, *by: str) -> DataFrame:
    """E9 for each record (or whatever ``by`` names): shares of backed sentences, and of clauses by their
    length; null where there is none, as for records without contexts."""
    said, part = F.col("level") == "sentence", F.col("level") == "clause"
    whole = [F.round(F.avg(F.when(said, F.col(v).cast("double"))), 4).alias(f"ratio_{v}") for v in ("strict", "lenient", "words_strict", "words_lenient")]
    weight = lambda v: F.sum(F.when(part & F.col(v), F.col("weight")).otherwise(0))
    parts = [F.round(weight(v) / F.nullif(F.sum(F.when(part, F.col("weight")).otherwise(0)), F.lit(0)), 4).alias(f"clause_{v}") for v in ("strict", "lenient", "words_strict", "words_lenient")]
    return judged_claims.groupBy(*by).agg(F.count_if(said).alias("n_sent"), F.count_if(part).alias("n_clause"), *whole, *parts, F.count_if(said & (F.size("num_missing") > 0)).alias("num_violations"))
