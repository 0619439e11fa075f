"""The corpus pipeline and comparisons of runs on cases worked out by hand."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import corpus, pool, ranking, runs

DOCS = "doc_id long, text string"


def test_build_counts_every_stage(spark):
    first, second = "alpha beta " * 30, "gamma delta " * 90  # 329 and 1079 characters once trimmed
    rows = [(3, first), (1, first), (2, second), (4, "short"), (5, None), (6, "7" * 400)]
    docs = spark.createDataFrame(rows, DOCS)
    chunks, stats = corpus.build(docs, clean=T.squeeze, script=T.letter_ratio)
    got = stats.first()
    assert (got.raw_docs, got.clean_docs, got.dedup_docs) == (6, 4, 3)
    assert (got.chunks_before_filter, got.chunks_final) == (4, 3)  # the digits' one chunk has no letters
    assert (got.avg_chunks_per_doc, got.doc_dedup_rate, got.chunk_filter_rate) == (1.0, 0.25, 0.25)
    assert got.elapsed_sec >= 0 and got.throughput_docs_per_sec > 0
    assert sorted((r.doc_id, r.ord, r.char_len) for r in chunks.collect()) == [(1, 0, 329), (2, 0, 800), (2, 1, 379)]


def test_build_of_nothing(spark):
    chunks, stats = corpus.build(spark.createDataFrame([], DOCS), clean=T.squeeze)
    assert chunks.count() == 0
    got = stats.first()
    assert (got.raw_docs, got.dedup_docs, got.chunks_final, got.avg_chunks_per_doc, got.doc_dedup_rate) == (0, 0, 0, 0.0, 1.0)


def test_build_keeps_the_first_of_equal_chunks(spark):
    same = "one two three " * 20
    docs = spark.createDataFrame([(9, f"{same}\n\n{'xyz abc ' * 95}"), (8, f"{same}\n\n{'uvw def ' * 95}")], DOCS)
    chunks, stats = corpus.build(docs, clean=T.squeeze, script=T.letter_ratio)
    assert stats.first().chunks_before_filter == 4
    assert sorted((r.doc_id, r.ord) for r in chunks.collect()) == [(8, 0), (8, 1), (9, 1)]


def test_controls(spark):
    rows = [("bm25", "w1", 0.5, None), ("bm25", "w2", 0.5, None), ("hybrid", "w1", 0.6, 0.1), ("hybrid", "w2", 0.7, 0.1)]
    got = runs.controls(spark.createDataFrame(rows, "path string, run string, recall double, mrr double"), "path", ["recall", "mrr"])
    assert {r.path: (r.runs, r.results, r.same) for r in got.collect()} == {"bm25": (2, 1, True), "hybrid": (2, 2, False)}


def test_winner_and_align(spark):
    rows = [(1, 1, 2), (2, None, 3), (3, 4, 4), (4, None, None)]
    df = spark.createDataFrame(rows, "q long, a long, b long")
    named = df.select("q", runs.winner({"a": F.col("a"), "b": F.col("b")}).alias("w"))
    assert {r.q: r.w for r in named.collect()} == {1: "a", 2: "b", 3: "tie", 4: "tie"}
    left = spark.createDataFrame([(1, True), (2, None), (3, True)], "q long, ok boolean")
    right = spark.createDataFrame([(1, False), (2, True), (7, True)], "q long, ok boolean")
    assert tuple(runs.align(left, right, "q", "ok").first()) == (2, 1, 1, 1, 1)


def test_persons_and_shares(spark):
    rows = [("李白", "李白（701年－762年）"), ("東車站", "出生于"), ("竹", "汉族"), ("王某", "生于山坡"), ("王某", "x" * 200 + "逝世")]
    df = spark.createDataFrame(rows, "title string, text string")
    assert [r[0] for r in df.select(pool.is_person_like(F.col("title"), F.col("text"))).collect()] == [True, False, False, False, False]
    assert sum(n for _, _, n in pool.shares(5, 3, 1, 7)) == 16


def test_one_sided_sign_test(spark):
    df = spark.createDataFrame([(3, 1), (1, 3), (0, 0)], "w long, l long")
    got = [r[0] for r in df.select(ranking.sign_test(F.col("w"), F.col("l"), one_sided=True)).collect()]
    assert got == [5 / 16, 15 / 16, 1.0]
