"""Checks of question sets. A set has qid, kind, question, answer,
gold_chunk_id and gold_title; the checks against the text need chunk_text too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Limits of the checks.
EASY_LEAK, HARD_LEAK, LEAST_COVERAGE, AUDIT_LEAK, MOST_REUSE = 0.85, 0.55, 0.85, 0.85, 3
#: Marks of several questions in one, words that point at something without naming it, marks of names.
MULTI_ASK = "各是|各为|各自|各多少|各有多|分别是|分别多少|分别有多"
DEIXIS = (
    "这本书", "这部书", "该条目", "此条目", "该片", "这部电影", "这部剧",
    "该公司", "该组织", "该人物", "这个人物", "该建筑", "该事件", "该作品",
    "这所", "这间", "该馆", "该站", "该地区", "该物种",
)
#: Kinds from easy to hard; those out of base come last.
KINDS = ("easy", "hard_anon", "hard_para", "t2s", "s2t")
ANCHOR = r"[《〈「『\"“]|（[^）]{2,}）|\([^)]{2,}\)"
NUMBER = r"\d+(?:\.\d+)?"


def asks_many(question: Column, answer: Column) -> Column:
    """C16 without the text: several amounts asked, one number given."""
    return question.rlike(MULTI_ASK) & (F.regexp_count(answer, F.lit(NUMBER)) == 1)


def local_checks(items: DataFrame) -> DataFrame:
    """Q3: leak, coverage, warn (problems joined by a slash) and pass_local. Null texts count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    scored = items.withColumns({"leak": F.round(T.leak_ratio(text("question"), text("chunk_text")), 3), "coverage": F.round(T.answer_coverage(text("answer"), text("chunk_text")), 3)})
    words = F.regexp_extract_all(T.to_simplified(text("gold_title")), F.lit("[\\u4e00-\\u9fa5]{2,}|[A-Za-z]{4,}"), F.lit(0))
    named = F.exists(words, lambda w: F.contains(T.to_simplified(text("question")), w))
    many = asks_many(text("question"), text("answer")) & (F.regexp_count(text("chunk_text"), F.lit(NUMBER)) >= 2)
    hard = F.col("kind").isin("hard_anon", "hard_para")
    problems = F.array_compact(
        F.array(
            F.when((F.col("kind") == "easy") & (F.col("leak") > EASY_LEAK), "leak"),
            F.when(hard & (F.col("leak") > HARD_LEAK), "leak"),
            F.when(F.col("coverage") < LEAST_COVERAGE, "coverage"),
            F.when((F.col("kind") == "hard_anon") & named, "title"),
            F.when(many, "many"),
        )
    )
    return scored.withColumn("warn", F.array_join(problems, "/")).withColumn("pass_local", F.col("warn") == "")


def script_labels(items: DataFrame, question: float = 0.02, chunk: float = 0.05) -> DataFrame:
    """Q4: measured scripts of question and chunk, and whether they differ."""
    marked = items.withColumns({"q_traditional": T.traditional_ratio(F.col("question")) >= question, "c_traditional": T.traditional_ratio(F.col("chunk_text")) >= chunk})
    return marked.withColumn("script_cross", F.col("q_traditional") != F.col("c_traditional"))


def audit(items: DataFrame) -> DataFrame:
    """Q8: (kind, qid, rule, level) for every rule that an item breaks. Needs leak, script_cross,
    q_traditional, c_traditional and answerable beside the set's columns; nulls break no rule but the
    missing answer. Repeated questions and chunks shared by three items or more give a row for each item."""
    q, title = F.coalesce("question", F.lit("")), F.coalesce("gold_title", F.lit(""))
    answer, oob = F.trim(F.coalesce("answer", F.lit(""))), F.coalesce(F.col("kind") == "oob", F.lit(False))
    points = F.exists(F.array(*map(F.lit, DEIXIS)), lambda d: F.contains(q, d)) & ~q.rlike(ANCHOR) & ~F.contains(q, title)
    names = (title != "") & (F.contains(q, title) | ((F.length(title) >= 3) & F.contains(q, F.substring(title, 1, 3))))
    rules = (
        ("unclear reference", "alarm", points),
        ("leak", "alarm", F.col("leak") >= AUDIT_LEAK),
        ("no overlap", "note", (F.col("kind") == "easy") & (F.col("leak") == 0)),
        ("title in question", "alarm", (F.col("kind") == "hard_anon") & names),
        ("short answer", "alarm", ~oob & (F.length(answer) < 2)),
        ("many asked", "note", ~oob & asks_many(q, answer)),
        ("script labels", "alarm", F.col("script_cross") != (F.col("q_traditional") != F.col("c_traditional"))),
        ("answerable", "alarm", oob & F.col("answerable")),
    )
    broken = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, when in rules]))
    own = items.select("kind", "qid", F.inline(broken))
    bare = F.regexp_replace(q, r"\s+", "")
    repeated = items.groupBy(bare.alias("bare")).agg(F.count("*").alias("c")).where("c > 1")
    twice = items.withColumn("bare", bare).join(repeated, "bare", "left_semi").select("kind", "qid", F.lit("repeated question").alias("rule"), F.lit("alarm").alias("level"))
    inside = items.where(~oob & F.col("gold_chunk_id").isNotNull())
    shared = inside.groupBy("gold_chunk_id").agg(F.count("*").alias("c")).where(F.col("c") >= MOST_REUSE)
    reused = inside.join(shared, "gold_chunk_id", "left_semi").select("kind", "qid", F.lit("shared chunk").alias("rule"), F.lit("alarm").alias("level"))
    return own.unionByName(twice).unionByName(reused)


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many items changed their verdict between two checks."""
    both = before.select("qid", F.col("pass_local").alias("a")).join(after.select("qid", F.col("pass_local").alias("b")), "qid")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("a") & F.col("b")).alias("now_pass"), F.count_if(F.col("a") & ~F.col("b")).alias("now_fail"))


def decided(items: DataFrame, tag: str, excluded: DataFrame) -> DataFrame:
    """Every item with the id of its question, its kind by the measured scripts, and the reason
    that keeps it out of the set (the first that holds, null if it stays). Items have pass_local and warn;
    q_traditional, c_traditional and answerable_in_kb may be missing and count as null then. ``excluded``:
    ids by hand in column value. An item out of base stays only if it is known not to be answerable."""
    optional = [c for c in ("q_traditional", "c_traditional", "answerable_in_kb") if c not in items.columns]
    full = items.withColumns({c: F.lit(None).cast("boolean") for c in optional})
    q, c = F.coalesce("q_traditional", F.lit(False)), F.coalesce("c_traditional", F.lit(False))
    crossing = F.coalesce(F.col("kind").isin("t2s", "s2t"), F.lit(False))
    oob = F.coalesce(F.col("kind") == "oob", F.lit(False))
    named = full.withColumns({"qid": T.question_id(F.lit(tag), F.coalesce("question", F.lit(""))), "kind": F.when(crossing & q & ~c, "t2s").when(crossing & c & ~q, "s2t").otherwise(F.col("kind"))})
    marked = named.join(excluded.select(F.col("value").alias("qid"), F.lit(True).alias("by_hand")).dropDuplicates(["qid"]), "qid", "left")
    why = (
        F.when(crossing & (q == c), "same script")
        .when(oob & F.col("answerable_in_kb"), "answerable")
        .when(oob & F.col("answerable_in_kb").isNull(), "not known to be out of base")
        .when(~oob & ~F.coalesce("pass_local", F.lit(False)), F.coalesce(F.nullif(F.col("warn"), F.lit("")) if "warn" in items.columns else F.lit(None), F.lit("local checks")))
        .when(F.col("by_hand"), "excluded by hand")
    )
    return marked.withColumn("reason", why).drop("by_hand", *optional)


def finalise(items: DataFrame, tag: str, excluded: DataFrame) -> DataFrame:
    """The items that stay, by kind from easy to out of base, then by id."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce("kind", F.lit("")))
    order = F.when(place > 0, place).when(F.col("kind") == "oob", len(KINDS) + 2).otherwise(len(KINDS) + 1)
    return decided(items, tag, excluded).where("reason is null").drop("reason").orderBy(order, "qid")
