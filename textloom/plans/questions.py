"""Queries over the pool of question candidates. Titles, sections and marks are made by rule from the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import pool
from textloom.plans.catalog import query, table

OLD, BORN = T.TRADITIONAL[:20], "出生于"
_SECTIONS = ", ".join(f"'{s}'" for s in pool.NOISE_SECTIONS)
_POOL = rf"""made AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE substring(lang, 1, 2) || (doc_id % 150)::VARCHAR END AS title, CASE WHEN doc_id % 11 = 0 THEN '參見' ELSE '' END AS section,
   CASE WHEN doc_id % 3 = 0 THEN '{OLD}' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '{BORN}' ELSE '' END || coalesce(text, '') AS chunk_text FROM documents),
 lined AS (SELECT *, list_filter(string_split(chunk_text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls FROM made),
 told AS (SELECT * EXCLUDE (ls), CASE WHEN title = '' THEN 'title' WHEN section IN ({_SECTIONS}) THEN 'section' WHEN length(chunk_text) NOT BETWEEN 150 AND 800 THEN 'length'
   WHEN len(ls) = 0 OR len(list_filter(ls, lambda x: regexp_matches(x, '^[ ]*[-*#0-9]'))) / len(ls) >= 0.35 OR (len(ls) >= 5 AND len(list_filter(ls, lambda x: length(x) <= 12)) / len(ls) >= 0.6) THEN 'list' END AS reason FROM lined),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY length(chunk_text) DESC, chunk_id) AS r FROM told WHERE reason IS NULL) WHERE r = 1),
 pool AS (SELECT title, chunk_id, CASE WHEN len(regexp_extract_all(title || chunk_text, '[{T.TRADITIONAL}]')) / length(title || chunk_text) >= 0.02 THEN 'fanti' ELSE 'simp' END AS script,
   length(title) BETWEEN 2 AND 5 AND contains(substring(chunk_text, 1, 200), '{BORN}') AS person FROM best)"""


def _chunks(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat(F.when(i % 3 == 0, OLD).otherwise(""), F.when(i % 4 == 0, BORN).otherwise(""), F.coalesce("text", F.lit("")))
    title = F.when(i % 13 == 0, "").otherwise(F.concat(F.substring("lang", 1, 2), (i % 150).cast("string")))
    return table(spark, sf_dir, "documents").select(i.alias("chunk_id"), title.alias("title"), F.when(i % 11 == 0, "參見").otherwise("").alias("section"), text.alias("chunk_text"))


@query(f"WITH {_POOL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM told GROUP BY 1")
def candidate_counters(spark, sf_dir):
    """P8."""
    return pool.dropped(_chunks(spark, sf_dir)).select(F.coalesce("reason", F.lit("kept")).alias("reason"), "n")


@query(f"WITH {_POOL} SELECT title, chunk_id, script, person FROM pool")
def question_candidates(spark, sf_dir):
    """Q1, C15."""
    return pool.candidates(_chunks(spark, sf_dir)).select("title", "chunk_id", "script", "person")


@query(f"""WITH {_POOL}, placed AS (SELECT *, row_number() OVER (PARTITION BY script ORDER BY md5('42' || title), title) AS place FROM pool)
 SELECT title, chunk_id, script, place, CASE WHEN place <= 20 THEN 'easy' WHEN place <= 30 THEN 'hard_anon' WHEN place <= 40 THEN 'hard_para' WHEN script = 'simp' THEN 't2s' ELSE 's2t' END AS kind FROM placed WHERE place <= CASE WHEN script = 'simp' THEN 45 ELSE 46 END""")
def question_plan(spark, sf_dir):
    """40 easy, 20 without a name, 20 paraphrased and 11 across scripts."""
    planned = pool.assign(pool.candidates(_chunks(spark, sf_dir)), pool.shares(40, 20, 20, 11))
    return planned.select("title", "chunk_id", "script", F.col("place").cast("long").alias("place"), "kind")
