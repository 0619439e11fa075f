"""Queries over the driver's tables, each with the SQL that must give the same rows.

Keys name what SURVEY 7.4 lists. Retrieval uses the benchmark texts as questions and the documents as
chunks; the second path of the fusion queries is a lexical coordination score, because the embeddings are
not linked to documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.wikitext import clean_wikitext
from textloom.operators import bm25, chunking, ranking, vectors
from textloom.session import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
#: Documents that a path gives to fusion, and that fusion gives to reranking.
POOL, RERANK_POOL = 100, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        FOUND[f.__name__] = f, sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}


# ---- cleaning, filters, audits ----


@query(r"""SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]{1,200}>', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def doc_clean_whitespace(spark, sf_dir):
    """T13, T19, C5."""
    t = T.squeeze(T.strip_tags(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_SHARE = "list_max(list_transform(list_distinct(string_split(text, '')), lambda c: length(text) - length(replace(text, c, '')))) / length(text)"
_QUALITY = f"""SELECT doc_id, length(text) >= 50 AND len(regexp_extract_all(text, '[A-Za-z]')) / length(text) >= 0.3 AND {_SHARE} <= 0.4 AS good FROM documents"""


def _quality(docs: DataFrame) -> DataFrame:
    """P3 with the Latin letters' ratio: length, C3, C4."""
    good = (F.length("text") >= 50) & (T.letter_ratio(F.col("text")) >= 0.3) & (T.max_char_share(F.col("text")) <= 0.4)
    return docs.select("doc_id", "lang", good.alias("good"))


@query(f"SELECT d.lang, count(*) AS n, sum(q.good::INT)::BIGINT AS n_good, round(1 - avg(q.good::INT), 4) AS filter_rate FROM ({_QUALITY}) q JOIN documents d USING (doc_id) GROUP BY d.lang")
def quality_filter_stats(spark, sf_dir):
    """One pass."""
    good = F.col("good").cast("int")
    return _quality(table(spark, sf_dir, "documents")).groupBy("lang").agg(F.count("*").alias("n"), F.sum(good).alias("n_good"), F.round(1 - F.avg(good), 4).alias("filter_rate"))


@query(f"SELECT l.quality, q.good, count(*) AS n FROM ({_QUALITY}) q JOIN labels l USING (doc_id) GROUP BY ALL")
def quality_vs_labels(spark, sf_dir):
    return _quality(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "good").agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_exact(spark, sf_dir):
    """A2: the survivor is the smallest id; map-side partials, so a hot hash is no hot task."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT count(*) AS raw_docs, sum((length(text) >= 200)::INT)::BIGINT AS clean_docs, count(DISTINCT CASE WHEN length(text) >= 200 THEN md5(text) END) AS dedup_docs FROM documents")
def dedup_stage_counts(spark, sf_dir):
    """P2, A1, A2 in one aggregate."""
    kept = F.length("text") >= 200
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("raw_docs"), F.count_if(kept).alias("clean_docs"), F.countDistinct(F.when(kept, F.md5("text"))).alias("dedup_docs")
    )


@query("""SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(DISTINCT md5(text)) AS n_texts, min(length(text)) AS min_len, max(length(text)) AS max_len,
  round(avg(length(text)), 4) AS avg_len, sum((length(text) BETWEEN 50 AND 800)::INT)::BIGINT AS in_range, sum((text = '')::INT)::BIGINT AS n_empty, sum(contains(text, chr(65533))::INT)::BIGINT AS n_broken,
  sum((contains(text, '{{') OR contains(text, '}}') OR contains(text, '[[') OR contains(text, ']]') OR contains(text, '<ref') OR contains(text, '{|'))::INT)::BIGINT AS n_markup FROM documents""")
def corpus_audit_single_pass(spark, sf_dir):
    """A4, P7."""
    n = F.length("text")
    markup = F.lit(False)
    for m in T.MARKUP:
        markup = markup | F.contains("text", F.lit(m))
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"),
        F.countDistinct("doc_id").alias("n_ids"),
        F.countDistinct(F.md5("text")).alias("n_texts"),
        F.min(n).cast("long").alias("min_len"),
        F.max(n).cast("long").alias("max_len"),
        F.round(F.avg(n), 4).alias("avg_len"),
        F.count_if(n.between(50, 800)).alias("in_range"),
        F.count_if(F.col("text") == "").alias("n_empty"),
        F.count_if(F.contains("text", F.lit("�"))).alias("n_broken"),
        F.count_if(markup).alias("n_markup"),
    )


@query("""SELECT lang, round(stddev_pop(length(text)), 4) AS sd, round(quantile_cont(length(text), 0.5), 4) AS p50, round(quantile_cont(length(text), 0.9), 4) AS p90,
  list_sort(list(length(text)))[count(*) // 2 + 1] AS upper_median, round(avg((length(text) >= 800)::INT), 4) AS at_max, round(avg((length(text) < 100)::INT), 4) AS under_100 FROM documents GROUP BY lang""")
def length_percentiles(spark, sf_dir):
    """A8-A10. The upper median is the value at n/2 of the lengths' counts, not of a collected list."""
    n = F.length("text").cast("long")
    lengths = table(spark, sf_dir, "documents").select("lang", n.alias("n"))
    stats = lengths.groupBy("lang").agg(
        F.round(F.stddev_pop("n"), 4).alias("sd"),
        F.round(F.percentile("n", F.lit(0.5)), 4).alias("p50"),
        F.round(F.percentile("n", F.lit(0.9)), 4).alias("p90"),
        F.round(F.avg((F.col("n") >= 800).cast("int")), 4).alias("at_max"),
        F.round(F.avg((F.col("n") < 100).cast("int")), 4).alias("under_100"),
    )
    w = Window.partitionBy("lang")
    counts = lengths.groupBy("lang", "n").agg(F.count("*").alias("k"))
    counts = counts.withColumns({"upto": F.sum("k").over(w.orderBy("n")), "total": F.sum("k").over(w)})
    upper = counts.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("lang").agg(F.min("n").alias("upper_median"))
    return stats.join(upper, "lang")


@query("""SELECT doc_id, (i - 1)::BIGINT AS ord, md5(substring(text, (i - 1) * 700 + 1, 800)) AS chunk_md5 FROM
  (SELECT doc_id, text, unnest(range(1, 2 + greatest(0, length(text) - 1) // 700)) AS i FROM documents)""")
def chunk_fixed_stride(spark, sf_dir):
    """S16."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(chunking.fixed_stride(F.col("text"))).alias("ord", "chunk"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("chunk").alias("chunk_md5"))


@query()
def chunk_paragraph_pack(spark, sf_dir):
    """Packed chunks, exact copies removed (the first by document and place stays), quality-filtered."""
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), blank=r"\n")
    first = chunks.groupBy(F.md5("chunk_text").alias("chunk_id")).agg(F.min_by(F.struct("doc_id", "ord", "section", "chunk_text"), F.struct("doc_id", "ord")).alias("c"))
    rows = first.select("chunk_id", "c.*").withColumn("char_len", F.length("chunk_text"))
    return rows.where((F.col("char_len") >= 50) & (T.letter_ratio(F.col("chunk_text")) >= 0.3) & (T.max_char_share(F.col("chunk_text")) <= 0.4))


@query(r"""SELECT page_id, length(t) AS n_chars, md5(t) AS clean_md5 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '<!--.*?-->', '', 'gs'), '<ref[^>/]*/>|<ref[^>]*>.*?</ref>', '', 'gsi'), '\{\|.*?\|\}', '', 'gs'), '<gallery[^>]*>.*?</gallery\s*>', '', 'gsi'),
  '\[https?://\S+\s*([^\]]*)\]', '\1', 'g'), '<[^>]{1,200}>', '', 'g'), '''{5}|''{3}|''{2}', '', 'g'), '__[A-Z]+__', '', 'g'),
  '[（(][\s，。；：、,;:\-–—]*[）)]|《[\s，。；：、,;:\-–—]*》|[「『][\s，。；：、,;:\-–—]*[」』]|【[\s，。；：、,;:\-–—]*】|“[\s，。；：、,;:\-–—]*”', '', 'g'),
  '[，；、]*。[，。；、]*', '。', 'g'), '([，；、])[，；、]+', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def wikitext_clean(spark, sf_dir):
    """T1-T19, F1 over all pages. The pages hold no links, templates or variants, so that SQL can express
    what is left; the rules for these are held against cases worked out by hand."""
    c = clean_wikitext(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", c.alias("clean")).select("page_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("clean_md5"))


@query("""SELECT CASE WHEN url LIKE '%?%' THEN 'skip_query' WHEN html = '' THEN 'skip_empty' WHEN url LIKE 'http://m.%' OR url LIKE 'https://m.%' THEN 'skip_prefix' WHEN length(html) < 200 THEN 'skip_short' ELSE 'kept' END AS reason, count(*) AS n FROM pages GROUP BY 1""")
def reject_reason_counts(spark, sf_dir):
    """The first rule that holds names the reason."""
    reason = (
        F.when(F.contains("url", F.lit("?")), "skip_query")
        .when(F.col("html") == "", "skip_empty")
        .when(F.col("url").rlike("^https?://m\\."), "skip_prefix")
        .when(F.length("html") < 200, "skip_short")
        .otherwise("kept")
    )
    return table(spark, sf_dir, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[一-鿿]')) / length(text) END, 6) AS cjk, translate(text, '張國學會歷來東車馬長門開關電話語說讀書寫體點時間問題實現發後', '张国学会历来东车马长门开关电话语说读书写体点时间问题实现发后') = text AS simplified FROM documents""".replace("\\u4e00", "一").replace("\\u9fff", "鿿"))
def script_ratios(spark, sf_dir):
    """C3, C6, C7."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.cjk_ratio(c), 6).alias("cjk"), (T.to_simplified(c) == c).alias("simplified"))


# ---- sampling ----


@query("SELECT doc_id, md5('42' || doc_id::VARCHAR) AS h FROM documents ORDER BY h, doc_id LIMIT 50")
def hash_sample_topn(spark, sf_dir):
    """O1: a reproducible sample; the top 50 by a seeded hash."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(50)


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS g, count(*) OVER () AS n FROM documents)
  WHERE r <= greatest(1, round_even(100.0 * g / n, 0))""")
def stratified_sample(spark, sf_dir):
    """Quota per language by half-even rounding; counts come from a small aggregate, and each task cuts to 100 rows a group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("g"))
    total = sizes.agg(F.sum("g").alias("n"))
    quotas = sizes.join(F.broadcast(total)).select("lang", F.greatest(F.lit(1), F.bround(100.0 * F.col("g") / F.col("n"), 0)).alias("quota"))
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))), "doc_id")
    ranked = docs.withColumn("r", F.row_number().over(w)).where("r <= 100")
    return ranked.join(quotas, "lang").where("r <= quota").select("lang", "doc_id")


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def longest_per_group(spark, sf_dir):
    """A12 by max_by: partial aggregates, no sort of a hot source."""
    n = F.length("text").cast("long")
    best = F.max_by(F.struct("doc_id", n.alias("n")), F.struct(n, -F.col("doc_id"))).alias("b")
    return table(spark, sf_dir, "documents").groupBy("source").agg(best).select("source", "b.doc_id", "b.n")


# ---- BM25 ----

_TERMS = """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS ts FROM documents),
 dls AS (SELECT doc_id, len(ts) AS dl FROM toks), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dls),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2)"""
_SCORED = f"""{_TERMS}, q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM benchmark) GROUP BY ALL),
 scored AS (SELECT item_id, doc_id, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * qtf), 6) AS score, round(count(*) / sqrt(any_value(dl) + 1.0), 6) AS coordination
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dls USING (doc_id), st GROUP BY ALL)"""
_RANKED = f"""{_SCORED}, ranked AS (
 SELECT * FROM (SELECT item_id, 'bm25' AS path, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {POOL} UNION ALL
 SELECT * FROM (SELECT item_id, 'coord' AS path, doc_id, coordination AS score, row_number() OVER (PARTITION BY item_id ORDER BY coordination DESC, doc_id) AS rank FROM scored) WHERE rank <= {POOL})"""
_LEADS = "leads AS (SELECT item_id, path, round((s1 - s2) / greatest(abs(s2), 1e-9), 6) AS lead FROM (SELECT item_id, path, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM ranked GROUP BY ALL))"
_FUSED = "fused AS (SELECT item_id, doc_id, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (10 + rank)), 9) AS fused FROM ranked GROUP BY ALL))"


def _scored(spark, sf_dir, k: int) -> DataFrame:
    return bm25.top_lists(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k)


def _ranked(spark, sf_dir) -> DataFrame:
    """Both paths' pools from one scoring pass, each cut on its own. They are written, as every reader of a pool
    would score all documents again. No union of two ranked lists: Spark 4.1 may join rows of one with the
    names of another where both are partitioned alike."""
    place = lambda by: F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(by), "doc_id")).cast("long").alias("rank")
    path = lambda name, by: F.struct(F.lit(name).alias("path"), F.col(by).alias("score"), f"{by}_rank")
    ranks = _scored(spark, sf_dir, POOL).select("*", place("score").alias("score_rank"), place("coordination").alias("coordination_rank"))
    both = ranks.select("item_id", "doc_id", F.explode(F.array(path("bm25", "score"), path("coord", "coordination").cast("struct<path:string,score:double,score_rank:bigint>"))).alias("p"))
    pools = both.select("item_id", "p.path", "doc_id", "p.score", F.col("p.score_rank").alias("rank")).where(F.col("rank") <= POOL)
    return materialize(pools, "pools")


@query(f"WITH {_TERMS} SELECT term, df FROM df")
def term_df(spark, sf_dir):
    """A6, A7."""
    return bm25.document_frequencies(table(spark, sf_dir, "documents"))


@query(f"WITH {_TERMS} SELECT CASE WHEN df < 5 THEN 'a 2-4' WHEN df < 20 THEN 'b 5-19' WHEN df < 100 THEN 'c 20-99' WHEN df < 1000 THEN 'd 100-999' ELSE 'e 1000+' END AS bucket, count(*) AS n_terms, sum(df)::BIGINT AS n_postings FROM df GROUP BY 1")
def df_histogram(spark, sf_dir):
    """A11."""
    d = F.col("df")
    bucket = F.when(d < 5, "a 2-4").when(d < 20, "b 5-19").when(d < 100, "c 20-99").when(d < 1000, "d 100-999").otherwise("e 1000+")
    return bm25.document_frequencies(table(spark, sf_dir, "documents")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))


@query(f"WITH {_TERMS} SELECT term, doc_id, tf, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS tf_norm FROM tf JOIN df USING (term) JOIN dls USING (doc_id), st")
def bm25_postings(spark, sf_dir):
    """B1."""
    return bm25.posting_rows(table(spark, sf_dir, "documents")).select("term", "doc_id", "tf", F.round("tf_norm", 6).alias("tf_norm"))


@query(f"WITH {_SCORED} SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """The flagship; all questions in one batch."""
    return bm25.top_k(_scored(spark, sf_dir, 10), 10).select("item_id", "doc_id", "score", "rank")


# ---- fusion and metrics ----


@query(f"WITH {_RANKED}, {_FUSED} SELECT item_id, doc_id, fused, rank FROM fused WHERE rank <= 10")
def rrf_fuse(spark, sf_dir):
    return ranking.rrf(_ranked(spark, sf_dir))


@query(f"WITH {_RANKED}, {_LEADS} SELECT item_id, lead FROM leads WHERE path = 'bm25'")
def bm25_lead(spark, sf_dir):
    return ranking.lead(bm25.top_k(_scored(spark, sf_dir, 2), 2))


@query(f"""WITH {_RANKED}, {_LEADS}, weighted AS (SELECT r.*, CASE WHEN r.path <> 'bm25' THEN 1.0::DOUBLE WHEN coalesce(l.lead, 0) < 0.3 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM ranked r LEFT JOIN leads l ON l.item_id = r.item_id AND l.path = 'bm25')
 SELECT * FROM (SELECT item_id, doc_id, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(w / (10 + rank)), 9) AS fused FROM weighted GROUP BY ALL)) WHERE rank <= 10""")
def gate_rrf(spark, sf_dir):
    """R3 in its routing form."""
    return ranking.gated(_ranked(spark, sf_dir), margin=0.3, weak=1.0, strong=2.0)


@query(f"WITH {_RANKED} SELECT item_id, doc_id, round(sum(0.5 * s), 6) AS fused FROM (SELECT item_id, doc_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12) AS s FROM ranked WINDOW w AS (PARTITION BY item_id, path)) GROUP BY ALL")
def cc_minmax(spark, sf_dir):
    return ranking.convex(_ranked(spark, sf_dir), "minmax")


@query(f"WITH {_RANKED} SELECT item_id, doc_id, round(sum(0.5 * s), 6) AS fused FROM (SELECT item_id, doc_id, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-12) AS s FROM ranked WINDOW w AS (PARTITION BY item_id, path)) GROUP BY ALL")
def cc_zscore(spark, sf_dir):
    return ranking.convex(_ranked(spark, sf_dir), "zscore")


_GOLD = f"""lists AS (SELECT item_id, path, doc_id, rank FROM ranked UNION ALL SELECT item_id, 'hybrid', doc_id, rank FROM fused WHERE rank <= {POOL}),
 gold AS (SELECT item_id, min(doc_id) AS gold FROM (SELECT DISTINCT item_id, doc_id FROM ranked) JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE contains(d.text, b.text) GROUP BY item_id),
 ranks AS (SELECT g.item_id, length(b.text) >= 200 AS long_q, p.path, min(l.rank) AS rank FROM gold g JOIN benchmark b USING (item_id) CROSS JOIN (VALUES ('bm25'), ('coord'), ('hybrid')) p(path) LEFT JOIN lists l ON l.item_id = g.item_id AND l.path = p.path AND l.doc_id = g.gold GROUP BY ALL)"""
_M = "count(*) AS n, round(avg(coalesce((rank <= 1)::INT, 0)), 4) AS recall_1, round(avg(coalesce((rank <= 5)::INT, 0)), 4) AS recall_5, round(avg(coalesce((rank <= 10)::INT, 0)), 4) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 4) AS mrr_10"


def _ranks(spark, sf_dir, ranked: DataFrame | None = None) -> DataFrame:
    """M1: rank of the gold document in each path and the hybrid; null where it is missed. Gold: the
    smallest document of the pool that holds the question's text (U2 drops questions without)."""
    docs, questions = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = _ranked(spark, sf_dir) if ranked is None else ranked
    lists = ranked.select("item_id", "path", "doc_id", "rank").union(ranking.rrf(ranked, topn=POOL).select("item_id", F.lit("hybrid"), "doc_id", "rank"))
    pool = ranked.select("item_id", "doc_id").distinct().join(docs.select("doc_id", "text"), "doc_id").join(questions.select("item_id", F.col("text").alias("q")), "item_id")
    gold = pool.where(F.contains("text", F.col("q"))).groupBy("item_id", (F.length("q") >= 200).alias("long_q")).agg(F.min("doc_id").alias("doc_id"))
    wanted = gold.select("*", F.explode(F.array(F.lit("bm25"), F.lit("coord"), F.lit("hybrid"))).alias("path"))
    return materialize(wanted.join(lists, ["item_id", "path", "doc_id"], "left").select("item_id", "long_q", "path", "rank"), "ranks")


@query(f"WITH {_RANKED}, {_FUSED}, {_GOLD} SELECT path, {_M} FROM ranks GROUP BY path")
def retrieval_metrics(spark, sf_dir):
    """M1-M3."""
    return ranking.metrics(_ranks(spark, sf_dir), "path")


@query(f"WITH {_RANKED}, {_FUSED}, {_GOLD} SELECT path, coalesce(long_q::VARCHAR, 'all') AS slice, {_M} FROM ranks GROUP BY GROUPING SETS ((path), (path, long_q))")
def metrics_by_slice(spark, sf_dir):
    """M6: every question counts for its slice and for all."""
    ranks = _ranks(spark, sf_dir).withColumn("slice", F.explode(F.array(F.lit("all"), F.col("long_q").cast("string"))))
    return ranking.metrics(ranks, "path", "slice")


@query(f"""WITH {_RANKED}, {_FUSED}, {_GOLD}, wide AS (SELECT item_id, coalesce(max(rank) FILTER (path = 'hybrid'), 1000000) AS h, coalesce(max(rank) FILTER (path = 'bm25'), 1000000) AS b, coalesce(max(rank) FILTER (path = 'coord'), 1000000) AS c FROM ranks GROUP BY item_id)
 SELECT count(*) AS n, sum((h < b)::INT)::BIGINT AS hybrid_wins, sum((h > b)::INT)::BIGINT AS hybrid_loses, sum((h = b)::INT)::BIGINT AS ties, sum((least(b, c) < h)::INT)::BIGINT AS oracle_better FROM wide""")
def hybrid_win_loss(spark, sf_dir):
    """M8, M10, R6."""
    at = lambda p: F.coalesce(F.max(F.when(F.col("path") == p, F.col("rank"))), F.lit(1_000_000))
    wide = _ranks(spark, sf_dir).groupBy("item_id").agg(at("hybrid").alias("h"), at("bm25").alias("b"), at("coord").alias("c"))
    return wide.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("h") < F.col("b")).alias("hybrid_wins"),
        F.count_if(F.col("h") > F.col("b")).alias("hybrid_loses"),
        F.count_if(F.col("h") == F.col("b")).alias("ties"),
        F.count_if(F.least("b", "c") < F.col("h")).alias("oracle_better"),
    )


@query("""WITH t AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), w AS (SELECT coalesce(sum(n) FILTER (quality = 1 AND toxic = 1), 0)::BIGINT AS wins, coalesce(sum(n) FILTER (quality = 0 AND toxic = 0), 0)::BIGINT AS losses FROM t)
 SELECT wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5))) FROM range(0, least(wins, losses) + 1) r(i))) END, 6) AS p_value FROM w""")
def sign_test(spark, sf_dir):
    """E12."""
    a = (F.col("quality") == 1) & (F.col("toxic") == 1)
    b = (F.col("quality") == 0) & (F.col("toxic") == 0)
    w = table(spark, sf_dir, "labels").agg(F.count_if(a).alias("wins"), F.count_if(b).alias("losses"))
    return w.select("wins", "losses", F.round(ranking.sign_test(F.col("wins"), F.col("losses")), 6).alias("p_value"))


# ---- test-set functions, answers ----


@query(f"""WITH {_SCORED}, best AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank = 1),
  chars AS (SELECT item_id, list_distinct(list_filter(string_split(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'), ''), lambda c: c <> '')) AS cs FROM benchmark)
  SELECT l.item_id, d.doc_id, round(len(list_filter(list_transform(range(1, length(l.text) - 2), lambda i: substring(l.text, i, 4)), lambda g: contains(d.text, g))) / (length(l.text) - 3), 6) AS leak,
  round(len(list_filter(cs, lambda c: contains(d.text, c))) / len(cs), 6) AS coverage
  FROM benchmark l JOIN chars USING (item_id) JOIN best USING (item_id) JOIN documents d USING (doc_id)""")
def leak_and_coverage(spark, sf_dir):
    """Every question against the document that is found first for it."""
    best = bm25.top_k(_scored(spark, sf_dir, 1), 1).select("item_id", "doc_id")
    questions = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    pairs = best.join(questions, "item_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    q, t = F.col("q"), F.col("text")
    return pairs.select("item_id", "doc_id", F.round(T.leak_ratio(q, t), 6).alias("leak"), F.round(T.answer_coverage(q, t), 6).alias("coverage"))


_MIXED = """list_concat(list_filter(regexp_extract_all(t, '[a-z0-9]{2,}'), lambda w: regexp_matches(w, '[a-z]') AND NOT list_contains(['the', 'and', 'of', 'to', 'in', 'is', 'it', 'for', 'on', 'was'], w)),
  list_filter(flatten(list_transform(regexp_extract_all(t, '[\u4e00-\u9fff]{2,}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))), lambda w: NOT list_contains(['的是', '这个', '那个', '我们', '他们'], w)))"""


@query(f"""WITH rows AS (SELECT 'conv' AS kind, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'made', id, text FROM (VALUES (1, '數學與歷史 of 2024'), (2, '这个电脑 PC99 的'), (3, '')) v(id, text)),
  norm AS (SELECT kind, id, lower(translate(coalesce(text, ''), '{T.TRADITIONAL}', '{T.SIMPLIFIED}')) AS t FROM rows)
  SELECT kind, id::BIGINT AS id, term, count(*) AS tf FROM (SELECT kind, id, unnest({_MIXED}) AS term FROM norm) GROUP BY ALL""")
def mixed_tokens(spark, sf_dir):
    """C9, C10 for Latin and Han text, over all turns and a few made rows."""
    made = spark.createDataFrame([("made", 1, "數學與歷史 of 2024"), ("made", 2, "这个电脑 PC99 的"), ("made", 3, "")], "kind string, id long, text string")
    rows = table(spark, sf_dir, "conversations").select(F.lit("conv").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").union(made)
    return rows.select("kind", "id", F.explode(T.mixed_tokens(F.col("text"))).alias("term")).groupBy("kind", "id", "term").agg(F.count("*").alias("tf"))


@query(r"""SELECT doc_id, CASE WHEN n = 0 THEN true ELSE len(list_filter(ls, lambda x: regexp_matches(x, '^[ ]*[-*#0-9]'))) / n >= 0.35 OR (n >= 5 AND len(list_filter(ls, lambda x: length(x) <= 12)) / n >= 0.6) END AS listy
  FROM (SELECT doc_id, ls, len(ls) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls FROM documents))""")
def is_listy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_listy(F.col("text")).alias("listy"))


@query("SELECT 'bench-' || substring(md5(text), 1, 6) AS qid, item_id FROM benchmark")
def question_ids(spark, sf_dir):
    """C26."""
    return table(spark, sf_dir, "benchmark").select(T.question_id(F.lit("bench"), F.col("text")).alias("qid"), "item_id")


@query(r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all('[' || turn || '] ' || text || ' [3][12]', '\[([0-9]{1,3})\]', 1)::INT[])), ',') AS cited,
  contains(regexp_replace(lower(text), '[\s\[\]]', '', 'g'), 'cannotanswer') OR contains(regexp_replace(lower(text), '[\s\[\]]', '', 'g'), 'unableto') AS refused, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '\[[0-9]+\]', '', 'g'), '[0-9]+(?:\.[0-9]+)?'))), ',') AS digits FROM conversations""")
def citations_refusals_digits(spark, sf_dir):
    """C18, C20, C21."""
    t = F.col("text")
    cited = T.citations(F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), t, F.lit(" [3][12]")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(cited.cast("array<string>"), ",").alias("cited"), T.is_refusal(t, ("cannot answer", "unable to")).alias("refused"), F.array_join(T.numbers(t), ",").alias("digits")
    )


@query("SELECT conv_id, string_agg('[' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS context FROM conversations GROUP BY conv_id")
def context_concat(spark, sf_dir):
    """G1: numbered blocks of one conversation."""
    block = F.struct("turn", "role", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: F.concat(F.lit("["), b.turn, F.lit("] "), b.role, F.lit("\n"), b.text)), "\n\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined.alias("context"))


_FLAT = r"regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_GRAMS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2))) END"


@query(f"""WITH f AS (SELECT conv_id, turn, role, {_FLAT.format('text')} AS t FROM conversations),
 p AS (SELECT conv_id, turn, role, {_GRAMS.format('t')} AS g, lag(t) OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS c FROM f)
 SELECT conv_id, turn, CASE WHEN c IS NULL OR len(g) = 0 THEN NULL ELSE round(len(list_intersect(g, {_GRAMS.format('c')})) / len(g), 6) END AS coverage FROM p WHERE role = 'assistant'""")
def faithfulness_bigram(spark, sf_dir):
    """Share of an answer's 2-grams in the turn before it; null without a context."""
    flat = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "t")
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", flat.alias("t")).withColumn("c", F.lag("t").over(w))
    g = F.array_distinct(T.grams(F.col("t"), 2))
    share = F.size(F.array_intersect(g, T.grams(F.col("c"), 2))) / F.size(g)
    return p.where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("c").isNotNull() & (F.size(g) > 0), F.round(share, 6)).alias("coverage"))


# ---- lookups and vectors ----


@query("SELECT b.item_id, d.source, length(d.text) AS n FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 13")
def fetch_by_ids(spark, sf_dir):
    """Ranked ids to records; the wanted ids are the small side and Spark checks its size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(docs, F.col("doc_id") == F.col("item_id") * 13, "left").select("item_id", "source", "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_labelled(spark, sf_dir):
    """J7, U2."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"


_NEAREST = f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= 10"


@query(_NEAREST)
def vector_exact_topk(spark, sf_dir):
    """V1: the stated queries (ids divisible by 50) against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.exact_top_k(e, e.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "score", "rank")


@query("""WITH n AS (SELECT vec_id, len(embedding) AS dim, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, len(list_filter(embedding, lambda x: isnan(x))) > 0 AS nan FROM embeddings)
 SELECT count(*) AS n, count(DISTINCT vec_id) AS n_keys, min(dim) AS min_dim, max(dim) AS max_dim, sum(nan::INT)::BIGINT AS n_nan, sum((norm = 0)::INT)::BIGINT AS n_zero, sum((norm <= 0.99 OR norm >= 1.01)::INT)::BIGINT AS n_off FROM n""")
def vector_norm_audit(spark, sf_dir):
    return vectors.norm_audit(table(spark, sf_dir, "embeddings"))


@query()
def ivf_topk_recall(spark, sf_dir):
    """Recall at 10 of the inverted file against the exact search, with the share of vectors that
    are scanned, for several nprobe; enough marks the smallest nprobe that reaches a recall of 0.95."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0")
    truth = materialize(vectors.exact_top_k(e, q, 10).select("query_id", "vec_id"), "ivf-truth")
    sizes = truth.agg(F.count("*").alias("total")).join(F.broadcast(e.agg(F.count("*").alias("rows"))))  # one row each
    centres, placed = vectors.inverted_file(e, nlist=16)
    best, seen = vectors.inverted_sweep(centres, placed, q, 10, (1, 2, 4, 8, 16))
    asked = best.groupBy("nprobe").agg(F.count_distinct("query_id").alias("n"))
    hits = best.join(truth, ["query_id", "vec_id"], "left_semi").groupBy("nprobe").agg(F.count("*").alias("hits"))
    out = seen.join(asked, "nprobe").join(hits, "nprobe", "left").join(F.broadcast(sizes)).select(  # one row
        "nprobe", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"), F.round(F.col("seen") / (F.col("n") * (F.col("rows") - 1)), 4).alias("scan_ratio")
    )
    out = materialize(out, "ivf-sweep")
    least = out.where("recall >= 0.95").agg(F.min("nprobe").alias("least"))
    return out.join(F.broadcast(least)).select("nprobe", "recall", "scan_ratio", F.col("nprobe").eqNullSafe(F.col("least")).alias("enough"))


@query(_NEAREST)
def vector_two_stage_topk(spark, sf_dir):
    """K7, V4, V6: cells written to disk with 8-bit codes, 200 candidates a query, scored again. All cells are
    probed, as only then the exact result is what must come out; ivf_topk_recall shows what fewer cost."""
    e = table(spark, sf_dir, "embeddings")
    path = fresh_path(spark, "ivf")
    vectors.write_cells(*vectors.inverted_file(e, nlist=16), path)
    return vectors.two_stage_top_k(spark, path, e, e.where("vec_id % 50 = 0"), 10, 16, 200).select("query_id", "vec_id", "score", "rank")
