"""Queries over the whole corpus pipeline and over runs compared with each other, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import corpus, ranking, runs
from textloom.plans.catalog import _FUSED, _GOLD, _LEADS, _M, _RANKED, _ranked, _ranks, query, table

METRICS = ["recall_1", "recall_5", "recall_10", "mrr_10"]

_CHUNK_SHARE = "list_max(list_transform(list_distinct(string_split(chunk, '')), lambda c: length(chunk) - length(replace(chunk, c, '')))) / length(chunk)"
_BUILT = rf"""cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
 kept AS (SELECT * FROM cleaned WHERE length(t) >= 200), one AS (SELECT md5(t) AS doc_hash, min(doc_id) AS doc_id, any_value(t) AS t FROM kept GROUP BY 1),
 cut AS (SELECT doc_id, i - 1 AS ord, substring(t, (i - 1) * 700 + 1, 800) AS chunk FROM (SELECT doc_id, t, unnest(range(1, 2 + greatest(0, length(t) - 1) // 700)) AS i FROM one)),
 good AS (SELECT * FROM cut WHERE length(chunk) >= 50 AND len(regexp_extract_all(chunk, '[A-Za-z]')) / length(chunk) >= 0.3 AND {_CHUNK_SHARE} <= 0.4),
 final AS (SELECT md5(chunk) AS chunk_id, min({{'doc_id': doc_id, 'ord': ord}}) AS first, any_value(length(chunk)) AS char_len FROM good GROUP BY 1)"""


def _built(spark, sf_dir):
    """All documents, cut at a fixed stride, so that SQL can express the cut."""
    return corpus.build(table(spark, sf_dir, "documents"), clean=T.squeeze, chunk=corpus.stride_documents, script=T.letter_ratio)


@query(f"WITH {_BUILT} SELECT chunk_id, first.doc_id AS doc_id, first.ord AS ord, char_len FROM final")
def corpus_chunks(spark, sf_dir):
    """The chain of T19, P2, A2, S16, P3 and A2 again."""
    return _built(spark, sf_dir)[0].select("chunk_id", "doc_id", "ord", "char_len")


@query(f"""WITH {_BUILT}, n AS (SELECT (SELECT count(*) FROM cleaned) AS raw_docs, (SELECT count(*) FROM kept) AS clean_docs, (SELECT count(*) FROM one) AS dedup_docs, (SELECT count(*) FROM cut) AS chunks_before_filter, (SELECT count(*) FROM final) AS chunks_final)
 SELECT *, round(chunks_final / greatest(dedup_docs, 1), 2) AS avg_chunks_per_doc, round(1 - dedup_docs / greatest(clean_docs, 1), 4) AS doc_dedup_rate, round(1 - chunks_final / greatest(chunks_before_filter, 1), 4) AS chunk_filter_rate FROM n""")
def corpus_build_stats(spark, sf_dir):
    """K4, A5; the two statistics of time are left out, as they differ from run to run."""
    return _built(spark, sf_dir)[1].drop("elapsed_sec", "throughput_docs_per_sec")


@query(r"""SELECT lang, count(*) AS n, sum((length(coalesce(text, '')) <> n_chars)::INT)::BIGINT AS n_declared_off, sum(strlen(text))::BIGINT AS n_bytes, max(strlen(text)) AS most_bytes, sum(contains(text, chr(65533))::INT)::BIGINT AS n_broken,
  arg_max(doc_id, {'b': strlen(text), 'd': -doc_id}) AS largest FROM documents GROUP BY lang""")
def integrity_counters(spark, sf_dir):
    """P5: the declared length against the text's, in one pass."""
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count_if(F.length(F.coalesce("text", F.lit(""))) != F.col("n_chars")).alias("n_declared_off"),
        F.sum(size).alias("n_bytes"),
        F.max(size).alias("most_bytes"),
        F.count_if(F.contains("text", F.lit("�"))).alias("n_broken"),
        F.max_by("doc_id", F.struct(size, -F.col("doc_id"))).alias("largest"),
    )


@query("""SELECT lang, count(*) AS n, round(quantile_cont(k, 0.5), 4) AS p50, round(quantile_cont(k, 0.9), 4) AS p90, round(quantile_cont(k, 0.99), 4) AS p99, round(avg((k > 512)::INT), 4) AS truncated
  FROM (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}')) AS k FROM documents) GROUP BY lang""")
def token_length_percentiles(spark, sf_dir):
    """A9."""
    sizes = table(spark, sf_dir, "documents").select("lang", F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("k"))
    at = [F.round(F.percentile("k", F.lit(p)), 4).alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return sizes.groupBy("lang").agg(F.count("*").alias("n"), *at, F.round(F.avg((F.col("k") > 512).cast("int")), 4).alias("truncated"))


@query(f"WITH {_RANKED}, {_FUSED} SELECT f.item_id, f.doc_id, f.fused, f.rank, b.rank AS bm25_rank, c.rank AS coord_rank FROM fused f LEFT JOIN ranked b ON b.path = 'bm25' AND b.item_id = f.item_id AND b.doc_id = f.doc_id LEFT JOIN ranked c ON c.path = 'coord' AND c.item_id = f.item_id AND c.doc_id = f.doc_id WHERE f.rank <= 10")
def fused_path_ranks(spark, sf_dir):
    """J3."""
    return ranking.rrf(_ranked(spark, sf_dir), paths=("bm25", "coord"))


@query(f"WITH {_RANKED}, {_FUSED} SELECT path AS mode, item_id, doc_id, score, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT 'hybrid', item_id, doc_id, fused, rank FROM fused WHERE rank <= 10")
def search_modes(spark, sf_dir):
    """R4."""
    ranked = _ranked(spark, sf_dir)
    each = [ranking.by_mode(ranked, m).select(F.lit(m).alias("mode"), "item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank")) for m in ("bm25", "coord", "hybrid")]
    return each[0].union(each[1]).union(each[2])


_BY_SLICE = f"m AS (SELECT path, coalesce(long_q::VARCHAR, 'all') AS slice, {_M} FROM ranks GROUP BY GROUPING SETS ((path), (path, long_q)))"


@query(f"WITH {_RANKED}, {_FUSED}, {_GOLD}, {_BY_SLICE} SELECT slice, " + ", ".join(f"a.{m} AS {m}_a, b.{m} AS {m}_b, round(b.{m} - a.{m}, 4) AS {m}_delta" for m in METRICS) + " FROM m a JOIN m b USING (slice) WHERE a.path = 'bm25' AND b.path = 'hybrid'")
def ablation_deltas(spark, sf_dir):
    """What fusion adds to the lexical path, by slice."""
    ranks = _ranks(spark, sf_dir).where("path in ('bm25', 'hybrid')").withColumn("slice", F.explode(F.array(F.lit("all"), F.col("long_q").cast("string"))))
    found = ranking.metrics(ranks, "path", "slice")
    return runs.deltas(found.where("path = 'bm25'"), found.where("path = 'hybrid'"), ["slice"], METRICS)


@query(f"""WITH {_RANKED}, {_FUSED}, {_GOLD}, a AS (SELECT item_id, coalesce(rank <= 1, false) AS v FROM ranks WHERE path = 'bm25' AND item_id % 7 <> 0), b AS (SELECT item_id, coalesce(rank <= 1, false) AS v FROM ranks WHERE path = 'coord' AND item_id % 5 <> 0), j AS (SELECT a.v AS a, b.v AS b FROM a FULL JOIN b USING (item_id))
 SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS aligned, count(*) FILTER (b IS NULL) AS missing_in_b, count(*) FILTER (a IS NULL) AS missing_in_a, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM j""")
def run_alignment(spark, sf_dir):
    """Two runs that each lack some questions, as broken-off runs do; the lack is what is tested."""
    ranks = _ranks(spark, sf_dir).withColumn("first", F.col("rank") <= 1)
    return runs.align(ranks.where("path = 'bm25' and item_id % 7 <> 0"), ranks.where("path = 'coord' and item_id % 5 <> 0"), "item_id", "first")


@query(f"""WITH {_RANKED}, {_FUSED}, {_GOLD}, {_LEADS}, w AS (SELECT item_id, coalesce(max(rank) FILTER (path = 'bm25'), 1000000000) AS b, coalesce(max(rank) FILTER (path = 'coord'), 1000000000) AS c FROM ranks GROUP BY item_id)
 SELECT winner, count(*) AS n, round(quantile_cont(lead, 0.5), 6) AS median_lead FROM (SELECT CASE WHEN b = c THEN 'tie' WHEN b < c THEN 'bm25' ELSE 'coord' END AS winner, lead FROM w LEFT JOIN leads l ON l.item_id = w.item_id AND l.path = 'bm25') GROUP BY winner""")
def lead_by_winner(spark, sf_dir):
    """M7."""
    at = lambda p: F.max(F.when(F.col("path") == p, F.col("rank")))
    ranked = _ranked(spark, sf_dir)
    wide = _ranks(spark, sf_dir, ranked).groupBy("item_id").agg(at("bm25").alias("b"), at("coord").alias("c"))
    leads = ranking.lead(ranked.where("path = 'bm25'"))
    won = wide.select("item_id", runs.winner({"bm25": F.col("b"), "coord": F.col("c")}).alias("winner"))
    return runs.median_by(won.join(leads, "item_id", "left"), "lead", "winner")
