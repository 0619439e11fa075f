"""Queries over indexes on disk, reranking, answers and question sets, each with its SQL.

No table holds answers of a model, so an extractive backend answers: it quotes the question's first 60
letters and cites the hits that hold them, or refuses where none does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answers, bm25, index, ranking, rerank, testsets
from textloom.plans.catalog import _FUSED, _RANKED, _SCORED, RERANK_POOL, _ranked, _scored, query, table
from textloom.session import fresh_path

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
LENGTHS = [256, 512, 1024]
_WORDS = "regexp_extract_all(lower({0}), '[a-z]{{2,}}')"


@query(f"WITH {_SCORED} SELECT item_id, doc_id, score, rank FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10")
def index_search(spark, sf_dir):
    """Builds the index's tables, checks them when loading, searches them."""
    built = index.build(table(spark, sf_dir, "documents"), fresh_path(spark, "index"))
    return index.search(built, table(spark, sf_dir, "benchmark"), 10)


_RERANKED = f"""{_RANKED}, {_FUSED}, pairs AS (SELECT f.item_id, f.doc_id, f.rank, b.text AS question, d.text AS passage, list_distinct({_WORDS.format('b.text')}) AS qw, {_WORDS.format('d.text')} AS dw
  FROM fused f JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE f.rank <= 50)"""


@query(f"""WITH {_RERANKED}, s AS (SELECT item_id, doc_id, rank, round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw)) / len(qw) ELSE 0 END, 6) AS rerank_score FROM pairs)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank) AS new_rank FROM s) WHERE new_rank <= 5""")
def rerank_topk(spark, sf_dir):
    """X1 (lexical), X2, X4."""
    got = rerank.retrieve(_ranked(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), topk=5, pool=RERANK_POOL)
    return got.select("item_id", "doc_id", "rank", "rerank_score", "new_rank")


@query(f"WITH {_RERANKED} SELECT max_length, rank, count(*) AS pairs, sum((len(dw) > max_length - len({_WORDS.format('question')}) - 4)::INT)::BIGINT AS truncated FROM pairs, (SELECT unnest([256, 512, 1024]) AS max_length) GROUP BY ALL")
def truncation_by_rank(spark, sf_dir):
    """X3, M5, M12."""
    fused = ranking.rrf(_ranked(spark, sf_dir), topn=RERANK_POOL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = fused.join(docs, "doc_id").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    sizes = pairs.select("rank", T.tokens(F.col("question")).alias("q"), T.tokens(F.col("text")).alias("d")).select("rank", F.size("q").alias("q"), F.size("d").alias("d"))
    each = sizes.withColumn("max_length", F.explode(F.array(*map(F.lit, LENGTHS))))
    return each.groupBy("max_length", "rank").agg(F.count("*").alias("pairs"), F.count_if(rerank.is_truncated(F.col("q"), F.col("d"), F.col("max_length"), lambda n: n)).alias("truncated"))


def _records(spark, sf_dir):
    """Records of the extractive backend over the best five; every fourth question counts as out of base."""
    hits = bm25.top_k(_scored(spark, sf_dir, 5), 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    hit = F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("text"))
    lists = hits.join(docs, "doc_id").groupBy(F.col("item_id").alias("qid")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    quote = F.substring("text", 1, 60)
    holding = F.filter("hits", lambda h: F.contains(h.text, quote))
    marks = F.array_join(F.transform(holding, lambda h: F.concat(F.lit("["), h.rank.cast("string"), F.lit("]"))), "")
    both = questions.join(lists, "qid").withColumn("whole", F.transform(F.filter("hits", lambda h: F.contains(h.text, F.col("text"))), lambda h: h.chunk_id))
    return both.select(
        "qid",
        F.when(F.col("qid") % 4 == 0, "oob").otherwise("kb").alias("kind"),
        F.when(F.size(holding) == 0, "cannot answer").otherwise(F.concat(quote, F.lit(" "), marks)).alias("answer"),
        (F.size(holding) == 0).alias("refused"),
        F.array_min("whole").alias("gold_chunk_id"),
        F.substring("text", 1, 30).alias("gold_answer"),
        "hits",
    )


_PUNCT = r"[\s\p{P}\p{S}]"
_JUDGED = rf"""{_SCORED}, top5 AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5),
 held AS (SELECT b.item_id AS qid, b.item_id % 4 = 0 AS oob, count(*) FILTER (contains(d.text, substring(b.text, 1, 60))) AS n_held, min(d.doc_id) FILTER (contains(d.text, b.text)) AS gold,
   coalesce(bool_or(contains(d.text, substring(b.text, 1, 60)) AND contains(lower(regexp_replace(d.text, '{_PUNCT}', '', 'g')), lower(regexp_replace(substring(b.text, 1, 30), '{_PUNCT}', '', 'g')))), false) AS in_cited
   FROM benchmark b JOIN top5 t ON t.item_id = b.item_id JOIN documents d USING (doc_id) GROUP BY ALL),
 j AS (SELECT *, n_held = 0 AS refused, gold IS NOT NULL AS gold_here FROM held)"""


@query(f"""WITH {_JUDGED} SELECT CASE WHEN oob THEN 'oob' ELSE 'kb' END AS kind, count(*) AS n, round(avg(refused::INT) FILTER (oob), 4) AS oob_refusal, round(avg(refused::INT) FILTER (NOT oob), 4) AS false_refusal,
  round(avg(refused::INT) FILTER (NOT oob AND gold_here), 4) AS false_refusal_gold_here, round(avg(CASE WHEN NOT refused AND NOT oob AND gold_here THEN 1.0 END), 4) AS citation_strict,
  round(avg(in_cited::INT) FILTER (NOT refused AND NOT oob), 4) AS citation_lenient, round(avg((NOT refused)::INT) FILTER (NOT oob), 4) AS answer_hit, round(avg(CASE WHEN oob THEN refused ELSE NOT refused END::INT), 4) AS end_to_end FROM j GROUP BY oob""")
def generation_metrics(spark, sf_dir):
    """E1-E6 of the extractive backend."""
    got = answers.generation_metrics(answers.judged(answers.assemble(_records(spark, sf_dir))), "kind")
    return got.select("kind", "n", "oob_refusal", "false_refusal", "false_refusal_gold_here", "citation_strict", "citation_lenient", "answer_hit", "end_to_end")


@query()
def audit_pick(spark, sf_dir):
    """E13."""
    return answers.audit_pick(answers.judged(answers.assemble(_records(spark, sf_dir))), 50)


@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars::DOUBLE))[(count(*) // 2 + 1)::INT] AS upper_median, sum((abs(coalesce(length(text), 0) - n_chars) > 0.2)::INT)::BIGINT AS mismatches FROM documents GROUP BY lang""")
def totals_upper_median(spark, sf_dir):
    """The parts are the texts' measured lengths, the total is the stated one."""
    runs = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("double").alias("measured"), F.col("n_chars").cast("double").alias("stated"))
    return answers.timing_summary(runs, ["measured"], "stated", "lang")


@query("""WITH v AS (SELECT toxic, doc_id % 20 AS qid, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS ok FROM labels), e AS (SELECT toxic, qid, sum(ok) AS y, count(ok) AS n FROM v WHERE ok IS NOT NULL GROUP BY ALL)
 SELECT toxic, sum(n)::BIGINT AS judged, round(sum(y) / sum(n), 4) AS pooled, round(avg(y / n), 4) AS mean_of_answers FROM e GROUP BY toxic""")
def judge_rates(spark, sf_dir):
    """The labels read as verdicts; some are none that is known."""
    said = F.when(F.col("doc_id") % 7 == 0, "unsure").when(F.col("quality") == 1, " Yes").otherwise("NO")
    clauses = table(spark, sf_dir, "labels").select("toxic", (F.col("doc_id") % 20).alias("qid"), said.alias("verdict"))
    return answers.judge_rates(clauses, kind="toxic")


@query("""WITH s AS (SELECT len(regexp_extract_all(d.text, '[A-Za-z]')) / length(d.text) AS score, l.quality = 1 AS truth FROM labels l JOIN documents d USING (doc_id) WHERE length(d.text) > 0)
 SELECT t::DOUBLE AS threshold, count(*) AS n, round(avg(((score >= t::DOUBLE) = truth)::INT), 4) AS accuracy, round(count(*) FILTER (score >= t::DOUBLE AND truth) / nullif(count(*) FILTER (score >= t::DOUBLE), 0), 4) AS "precision",
  round(count(*) FILTER (score >= t::DOUBLE AND truth) / nullif(count(*) FILTER (truth), 0), 4) AS recall FROM s, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS t) GROUP BY t""")
def calibrate_threshold(spark, sf_dir):
    """The letters' share against the quality labels."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    both = docs.select("doc_id", T.letter_ratio(F.col("text")).alias("score")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")
    return answers.calibrate(both, "score", "truth", THRESHOLDS)


def _items(spark, sf_dir):
    """The benchmark as a question set: each item's document is the one of its number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gold_chunk_id"), F.col("text").alias("chunk_text"))
    kind = F.element_at(F.array(F.lit("easy"), F.lit("hard_para"), F.lit("oob")), (F.col("item_id") % 3 + 1).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), kind.alias("kind"), F.col("text").alias("question"), F.substring("text", 1, 12).alias("answer"), F.lit("").alias("gold_title"))
    return asked.join(docs, F.col("qid") == F.col("gold_chunk_id"))


@query(r"""WITH p AS (SELECT b.item_id AS qid, ['easy', 'hard_para', 'oob'][(b.item_id % 3 + 1)::INT] AS kind, b.text AS q, d.text AS t, list_distinct(list_filter(string_split(regexp_replace(substring(b.text, 1, 12), '[^\p{L}\p{N}]', '', 'g'), ''), lambda c: c <> '')) AS cs FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
 s AS (SELECT qid, kind, CASE WHEN length(q) < 4 THEN 0 ELSE round(len(list_filter(list_transform(range(1, length(q) - 2), lambda i: substring(q, i, 4)), lambda g: contains(t, g))) / (length(q) - 3), 3) END AS leak,
  CASE WHEN len(cs) = 0 THEN 1 ELSE round(len(list_filter(cs, lambda c: contains(t, c))) / len(cs), 3) END AS coverage FROM p),
 w AS (SELECT *, concat_ws('/', CASE WHEN (kind = 'easy' AND leak > 0.85) OR (kind = 'hard_para' AND leak > 0.55) THEN 'leak' END, CASE WHEN coverage < 0.85 THEN 'coverage' END) AS warn FROM s)
 SELECT *, warn = '' AS pass_local FROM w""")
def testset_checks(spark, sf_dir):
    """Q3, C12, C13, C16."""
    return testsets.local_checks(_items(spark, sf_dir)).select("qid", "kind", "leak", "coverage", "warn", "pass_local")


@query()
def testset_audit(spark, sf_dir):
    """Q8, Q4, A13."""
    items = testsets.script_labels(testsets.local_checks(_items(spark, sf_dir)))
    return testsets.audit(items.withColumn("answerable", F.col("kind") == "oob"))


@query(r"""WITH p AS (SELECT item_id, ['easy', 'hard_para', 'oob', 't2s', 's2t'][(item_id % 5 + 1)::INT] AS kind, item_id % 3 = 0 AS qt, item_id % 4 = 0 AS ct, item_id % 7 <> 0 AS pass_local, 'set-' || substring(md5(text), 1, 6) AS qid,
  CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS known FROM benchmark)
 SELECT item_id, qid, CASE WHEN kind IN ('t2s', 's2t') AND qt AND NOT ct THEN 't2s' WHEN kind IN ('t2s', 's2t') AND ct AND NOT qt THEN 's2t' ELSE kind END AS kind,
  CASE WHEN kind IN ('t2s', 's2t') AND qt = ct THEN 'same script' WHEN kind = 'oob' AND known THEN 'answerable' WHEN kind = 'oob' AND known IS NULL THEN 'not known to be out of base' WHEN kind <> 'oob' AND NOT pass_local THEN 'leak'
   WHEN qid IN (SELECT 'set-' || substring(md5(text), 1, 6) FROM benchmark WHERE item_id % 9 = 0) THEN 'excluded by hand' END AS reason FROM p""")
def testset_decisions(spark, sf_dir):
    """Marks and verdicts made by rule, so that every reason occurs."""
    i = F.col("item_id")
    kind = F.element_at(F.array(*map(F.lit, ("easy", "hard_para", "oob", "t2s", "s2t"))), (i % 5 + 1).cast("int"))
    known = F.when(i % 6 == 0, F.lit(None)).otherwise(i % 6 == 1)
    asked = table(spark, sf_dir, "benchmark")
    items = asked.select(
        "item_id", kind.alias("kind"), F.col("text").alias("question"), (i % 3 == 0).alias("q_traditional"), (i % 4 == 0).alias("c_traditional"), (i % 7 != 0).alias("pass_local"), F.lit("leak").alias("warn"), known.alias("answerable_in_kb")
    )
    excluded = asked.where(i % 9 == 0).select(T.question_id(F.lit("set"), F.col("text")).alias("value"))
    return testsets.decided(items, "set", excluded).select("item_id", "qid", "kind", "reason")
