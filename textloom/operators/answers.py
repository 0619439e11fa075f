"""Answers over retrieved chunks and their metrics.

A record has qid, kind (``oob``: the corpus can't answer it), question, answer, refused (as stored),
gold_chunk_id, gold_answer and hits: an array of structs (rank, chunk_id, text) in rank order. Everything
about one record is an expression over its own row; only the summaries shuffle, pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

Backend = Callable[[Column, Column], Column]
#: What a judge may say for yes and no.
YES = ("yes", "是", "有依据", "有依据的", "支持", "supported", "true")
NO = ("no", "否", "无依据", "无依据的", "不支持", "unsupported", "false")
BUCKETS = ("A answered out of base", "B refused in base", "C gold at hand, not cited", "D gold cited", "E no citation")


def context(hits: Column) -> Column:
    """G1: numbered blocks joined by a blank line; empty without hits."""
    return F.array_join(F.transform(F.array_sort(hits), lambda h: F.concat(F.lit("["), h.rank.cast("string"), F.lit("] "), F.coalesce(h.text, F.lit("")))), "\n\n")


def prompt(question: Column, ctx: Column) -> Column:
    """What a model is given; the echo backend's answer."""
    return F.concat(F.lit("Answer from the numbered passages alone and cite them as [n].\n\n"), ctx, F.lit("\n\nQuestion: "), question)


def echo(question: Column, ctx: Column) -> Column:
    return prompt(question, ctx)


def answered(records: DataFrame, backend: Backend = echo) -> DataFrame:
    """G3's hook: a backend is a function of the columns question and context, for a model a pandas UDF."""
    return records.withColumn("answer", backend(F.col("question"), context(F.col("hits"))))


def assemble(records: DataFrame) -> DataFrame:
    """What each answer cites and refuses. Numbers beyond the hits are ``bad_citations``;
    gold_rank is null where the gold chunk is not among the hits. A null answer counts as empty."""
    answer = F.coalesce("answer", F.lit(""))
    numbers = F.coalesce(T.citations(answer), F.array().cast("array<int>"))
    hits = F.coalesce("hits", F.array().cast(records.schema["hits"].dataType))
    found = records.withColumns({"answer": answer, "hits": hits, "numbers": numbers})
    legal = lambda x: (x >= 1) & (x <= F.size("hits"))
    found = found.withColumns({"cited": F.filter("numbers", legal), "bad_citations": F.filter("numbers", lambda x: ~legal(x)), "refused_measured": T.is_refusal(F.col("answer"))}).drop("numbers")
    ids = F.transform("hits", lambda h: h.chunk_id)
    at = lambda field: F.transform("cited", lambda i: F.get(F.col("hits"), i - 1)[field])
    return found.withColumns({"gold_rank": F.nullif(F.array_position(ids, F.col("gold_chunk_id")), F.lit(0)), "cited_chunk_ids": at("chunk_id"), "cited_texts": at("text")})


def flat(text: Column) -> Column:
    """Simplified, lower-case, without spaces and punctuation."""
    return F.regexp_replace(F.lower(T.to_simplified(text)), T.PUNCTUATION, "")


def judged(assembled: DataFrame) -> DataFrame:
    """The truth values behind the metrics, none of them null."""
    true = lambda c: F.coalesce(c, F.lit(False))
    out = assembled.withColumns({"oob": true(F.col("kind") == "oob"), "has_gold": F.col("gold_chunk_id").isNotNull(), "gold_here": F.col("gold_rank").isNotNull(), "cites": F.size("cited") > 0})
    wanted = flat(F.col("gold_answer"))
    has_answer = true(F.length("gold_answer") > 0)
    out = out.withColumns(
        {
            "gold_cited": true(F.array_contains("cited_chunk_ids", F.col("gold_chunk_id"))),
            "has_answer": has_answer,
            "answer_hit": has_answer & true(F.contains(flat(F.col("answer")), wanted)),
            "answer_in_cited": has_answer & true(F.exists("cited_texts", lambda t: F.contains(flat(F.coalesce(t, F.lit(""))), wanted))),
        }
    )
    return out.withColumn("passed", F.when(F.col("oob"), F.col("refused_measured")).otherwise(~F.col("refused_measured") & F.col("answer_hit")))


def generation_metrics(judged_records: DataFrame, *by: str) -> DataFrame:
    """E1-E6 for all records or by columns; a rate without a denominator is null."""
    c = F.col
    answered_, inside = ~c("refused_measured"), ~c("oob")
    strict = answered_ & inside & c("gold_here")
    lenient = answered_ & inside & c("has_answer") & c("cites")

    def rate(of: Column, among: Column, name: str) -> Column:
        return F.round(F.avg(F.when(among, of.cast("double"))), 4).alias(name)

    return judged_records.groupBy(*by).agg(
        F.count("*").alias("n"),
        rate(c("refused_measured"), c("oob"), "oob_refusal"),
        rate(c("refused_measured"), inside, "false_refusal"),
        rate(c("refused_measured"), inside & c("gold_here"), "false_refusal_gold_here"),
        rate(c("refused_measured"), inside & c("has_gold") & ~c("gold_here"), "refusal_gold_missing"),
        F.count_if(~c("refused_measured").eqNullSafe(F.coalesce("refused", F.lit(False)))).alias("flag_mismatch"),
        rate(~c("cites"), answered_, "no_cite"),
        F.count_if(answered_ & (F.size("bad_citations") > 0)).alias("bad_numbers"),
        rate(c("gold_cited"), strict, "citation_strict"),
        F.count_if(strict & ~c("gold_cited") & c("cites")).alias("miss_with_cite"),
        F.count_if(strict & ~c("gold_cited") & ~c("cites")).alias("miss_no_cite"),
        rate(c("answer_in_cited"), lenient, "citation_lenient"),
        F.count_if(answered_ & inside & c("has_gold") & ~c("gold_here") & c("cites")).alias("ghost_cites"),
        rate(c("answer_hit"), inside & c("has_answer"), "answer_hit"),
        rate(c("passed"), F.lit(True), "end_to_end"),
    )


def verdict(value: Column) -> Column:
    """Yes, no or null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*YES), "yes").when(v.isin(*NO), "no")


def judge_rates(clauses: DataFrame, answer: str = "qid", kind: str = "kind") -> DataFrame:
    """One row a kind: the rate over all judged clauses, and the mean of the answers' rates.
    ``clauses``: answer, kind, verdict; clauses without a known verdict don't count."""
    each = clauses.withColumn("v", verdict(F.col("verdict"))).where("v is not null").groupBy(kind, answer).agg(F.count_if(F.col("v") == "yes").alias("yes"), F.count("*").alias("n"))
    return each.groupBy(kind).agg(
        F.sum("n").alias("judged"), F.round(F.sum("yes") / F.sum("n"), 4).alias("pooled"), F.round(F.avg(F.col("yes") / F.col("n")), 4).alias("mean_of_answers")
    )


def timing_summary(runs: DataFrame, parts: list[str], total: str, *by: str, tolerance: float = 0.2) -> DataFrame:
    """Mean and upper median of the total, and the runs whose parts don't add up to it. The
    upper median is the smallest value with more than half of the values at or below it."""
    added = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts])
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    freq = runs.withColumn("off", F.abs(added - F.col(total)) > tolerance).groupBy(*by, F.col(total).alias("t")).agg(F.count("*").alias("c"), F.count_if("off").alias("off"))
    run = freq.withColumns({"below": F.sum("c").over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("c").over(w)})
    return run.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.round(F.sum(F.col("t") * F.col("c")) / F.sum("c"), 6).alias("mean"),
        F.min(F.when(F.col("below") > F.floor(F.col("all") / 2), F.col("t"))).alias("upper_median"),
        F.sum("off").alias("mismatches"),
    )


def audit_pick(judged_records: DataFrame, n: int) -> DataFrame:
    """At most n // 5 records (one at least) of each bucket, the smallest qid first. A record that a
    former bucket took is not picked again, though it uses a place of the later bucket."""
    c = F.col
    inside, said = ~c("oob"), ~c("refused_measured")
    rules = (c("oob") & said, inside & ~said, said & inside & c("gold_here") & ~c("gold_cited"), said & c("gold_cited"), said & ~c("cites"))
    fits = F.array(*[F.when(rule, F.lit(name)) for rule, name in zip(rules, BUCKETS)])
    placed = judged_records.select("qid", F.explode(F.array_compact(fits)).alias("bucket"))
    w = Window.partitionBy("bucket").orderBy("qid")
    picked = placed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, n // len(BUCKETS)))
    return picked.groupBy("qid").agg(F.min("bucket").alias("bucket"))


def calibrate(labelled: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Accuracy, precision and recall of ``score >= threshold`` for each threshold, in one pass."""
    rows = labelled.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    said = F.col(score) >= F.col("threshold")
    hit = F.count_if(said & F.col(truth))
    return rows.groupBy("threshold").agg(
        F.count("*").alias("n"),
        F.round(F.avg((said == F.col(truth)).cast("double")), 4).alias("accuracy"),
        F.round(hit / F.nullif(F.count_if(said), F.lit(0)), 4).alias("precision"),
        F.round(hit / F.nullif(F.count_if(F.col(truth)), F.lit(0)), 4).alias("recall"),
    )
