"""Sources, sinks and the index on disk, on small files."""

import bz2

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from textloom.operators import best, bm25, index, vectors
from textloom.sources import dumps, files

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">
 <siteinfo><sitename>x</sitename></siteinfo>
 <page><title>T0 &amp; &quot;co&quot;</title><ns>0</ns><id>7</id><revision><id>70</id><text bytes="9" xml:space="preserve">a &lt;b&gt;
  &amp;lt;c</text></revision></page>
 <page><title>2001-01-01</title><ns>0</ns><id>8</id><redirect title="T0" /><revision><id>80</id><text bytes="3">#R</text></revision></page>
 <page><title>Talk:T0</title><ns>1</ns><id>9</id><revision><id>90</id><text bytes="0" /></revision></page>
 <page><title>Empty</title><ns>0</ns><id>10</id><revision><id>91</id><text></text></revision></page>
</mediawiki>
"""


@pytest.mark.parametrize("packed", [False, True])
def test_dump_readers_agree(spark, tmp_path, packed):
    path = str(tmp_path / ("d.xml.bz2" if packed else "d.xml"))
    half = len(DUMP) // 2
    data = bz2.compress(DUMP[:half].encode()) + bz2.compress(DUMP[half:].encode()) if packed else DUMP.encode()
    with open(path, "wb") as f:
        f.write(data)
    want = [(7, 0, 'T0 & "co"', False, "a <b>\n  &lt;c"), (8, 0, "2001-01-01", True, "#R"), (9, 1, "Talk:T0", False, ""), (10, 0, "Empty", False, "")]
    for read in (dumps.read_dump, dumps.read_dump_text):
        assert sorted(map(tuple, read(spark, path).collect())) == want
    assert [r.doc_id for r in dumps.articles(dumps.read_dump(spark, path)).orderBy("doc_id").collect()] == [7, 10]


def test_lines_and_objects(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\n  b 2 \na\tx\n   #c\n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "q.txt")).collect()] == ["b 2", "a\tx"]
    assert [r.value for r in files.read_first_words(spark, str(tmp_path / "q.txt")).collect()] == ["b", "a"]
    rows = spark.createDataFrame([(1, "é"), (2, None)], "id long, text string")
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "j"), rows.schema).collect()) == [(1, "é"), (2, None)]
    (tmp_path / "bad.json").write_text('{"id": 1\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.json"), "id long").collect()


def test_append_missing_resumes(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([Row(id=i, extra=None) for i in ids], "id long, extra string")
    assert files.append_missing(rows(1, 2, 2), path, "id") == 2
    assert files.append_missing(rows(2, 3), path, "id") == 1
    assert files.append_missing(rows(1, 3), path, "id") == 0
    assert files.append_missing(rows(), path, "id") == 0
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_layout_and_differences(spark, tmp_path):
    left = spark.createDataFrame([(i, None if i == 3 else str(i)) for i in range(20)], "id long, t string")
    files.write_parquet(left, str(tmp_path / "p"), 4)
    files.write_sorted(left, str(tmp_path / "s"), "id", 3)
    assert [sum(r.n_rows for r in files.layout(spark, str(tmp_path / d)).collect()) for d in "ps"] == [20, 20]
    assert files.layout(spark, str(tmp_path / "p")).count() == 4
    back = spark.read.parquet(str(tmp_path / "s"))
    assert files.differing_rows(left, back, "id").isEmpty()
    assert [r.id for r in files.differing_rows(left, back.where("id <> 3"), "id").collect()] == [3]


def test_index_guards_and_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red dog"), (3, None), (4, ""), (5, "fox fox den")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fox fox"), (2, "absent"), (3, None)], "item_id long, text string")
    path = str(tmp_path / "i")
    built = index.build(docs, path, files=2)
    assert index.broken_terms(built).isEmpty()
    got = {(r.item_id, r.doc_id): r.score for r in index.search(built, asked, 10).collect()}
    assert got == {(r.item_id, r.doc_id): r.score for r in bm25.score_terms(docs, asked).collect()} and len(got) == 3
    assert {r.term for r in index.unknown_terms(built, asked).collect()} == {"absent"}
    with pytest.raises(ValueError):
        index.load(spark, path, "simplified")
    built.terms.limit(1).write.parquet(str(tmp_path / "i2" / "terms"))
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "i2"))


def test_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    built = index.build(docs, str(tmp_path / "i"), files=1)
    assert index.search(built, docs.withColumnRenamed("doc_id", "item_id"), 3).isEmpty()


def test_cells_on_disk(spark, tmp_path):
    """Codes are half a step off at most; a dimension without range and a null vector do no harm."""
    rows = [(i, [float(i % 7), 1.0, -float(i)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    placed = df.withColumn("cid", (F.col("vec_id") % 3).cast("int"))
    centres = spark.createDataFrame([(i, [3.0, 1.0, -30.0 + i]) for i in range(3)], "cid int, centre array<double>")
    vectors.write_cells(centres, placed, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "cells").iterdir() if p.is_dir()) == ["cid=0", "cid=1", "cid=2"]
    ends = {r.pos: (r.low, round(r.step * 255, 9)) for r in spark.read.parquet(f"{tmp_path}/bounds").collect()}
    assert ends == {0: (0.0, 6.0), 1: (1.0, 0.0), 2: (-59.0, 59.0)}
    queries = spark.createDataFrame([(100, [1.0, 2.0, 0.5])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in vectors.search_cells(spark, str(tmp_path), queries, 3).collect()}
    assert len(got) == 60
    assert all(abs(got[i] - (i % 7 + 2 - 0.5 * i)) <= 0.5 * 6 / 255 + 0.5 * 0.5 * 59 / 255 + 1e-9 for i in range(60))
    assert vectors.search_cells(spark, str(tmp_path), queries, 1).count() == 20
    best = vectors.two_stage_top_k(spark, str(tmp_path), df, queries, 2, 3, 10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in best] == [(6, 5.0), (5, 4.5)]


def test_searches_in_small_parts_give_the_first_of_all_pairs(spark, tmp_path):
    """Exact, by cells and in two stages, against all pairs; what a task gives out is k rows a query, ties apart."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(2)]) for i in range(300)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    full = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and len(v) == 4}
    asked = [i for i in full if i % 50 == 0]
    whole = {q: sorted((-round(float(v @ full[q]), 6), i) for i, v in full.items() if i != q) for q in asked}
    want = {(q, i, r + 1) for q in asked for r, (_, i) in enumerate(whole[q][:10])}
    queries = df.where("vec_id % 50 = 0 and vec_id < 300")
    assert {(r.query_id, r.vec_id, r["rank"]) for r in vectors.exact_top_k(df, queries, 10).collect()} == want
    centres = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "cid int, centre array<double>")
    cid = {i: int(np.argmax(v)) for i, v in full.items()}
    placed = spark.createDataFrame([(i, [float(x) for x in v], cid[i]) for i, v in full.items()], "vec_id long, embedding array<float>, cid int").repartition(3)
    found, seen = vectors.inverted_sweep(centres, placed, queries, 10, (1, 4))
    got = {n: {(r.query_id, r.vec_id, r["rank"]) for r in found.where(f"nprobe = {n}").collect()} for n in (1, 4)}
    near = {q: [(s, i) for s, i in whole[q] if cid[i] == cid[q]] for q in asked}
    assert got[4] == want and got[1] == {(q, i, r + 1) for q in asked for r, (_, i) in enumerate(near[q][:10])}
    assert {r.nprobe: r.seen for r in seen.collect()} == {1: sum(map(len, near.values())), 4: len(asked) * 299}
    vectors.write_cells(centres, placed, str(tmp_path))
    stage = vectors.search_cells(spark, str(tmp_path), queries, 4, depth=5)
    assert stage.count() <= len(asked) * 6 * max(1, stage.rdd.getNumPartitions()) < len(asked) * 299
    two = vectors.two_stage_top_k(spark, str(tmp_path), df, queries, 10, 4, 100)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in two.collect()} == want


def test_first_of_a_stream_holds_no_more_than_is_asked():
    rng = np.random.default_rng(1)
    score = rng.integers(0, 50, (3, 40_000)) / 7.0
    held = best.Best(3, 4)
    held.most = 100
    for i in range(0, 40_000, 50):
        held.add_matrix(score[:, i : i + 50], np.arange(i, i + 50), np.arange(3))
    q, keys, got = held.result()
    assert all(sorted(keys[q == i]) == list(np.flatnonzero(score[i] >= np.sort(score[i])[-4])) for i in range(3)) and (got == score[q, keys]).all()
    assert best.Best(2, 3).result() is None


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 3)
    yield
    spark.conf.unset(name)


def test_postings_and_searches_over_many_batches(spark, tmp_path, monkeypatch, small_batches):
    """Rare terms alone are counted over all documents; documents are scored whole however their rows are dealt."""
    words = ["red", "fox", "den", "Über", "a", "elm", "oak", "x1y", "zz"]
    texts = [" ".join(words[(i * j + j) % 9] for j in range(1 + i % 6)) + (f" rare{'abcdefgh'[i // 5]}" if i % 5 == 0 else "") for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (40, None), (41, "")], "doc_id long, text string").repartition(3).cache()
    asked = spark.createDataFrame([(1, "red fox fox raree"), (2, "oak elm ber"), (3, None), (4, "den rare")], "item_id long, text string")
    monkeypatch.setattr(bm25, "ENTRIES", 20)
    monkeypatch.setattr(bm25, "SEEN", 2)
    norm = F.round("tf_norm", 9).alias("n")
    got, want = (sorted(map(tuple, f(docs).select("term", "doc_id", "tf", norm).collect())) for f in (bm25.posting_rows, bm25.postings))
    assert got == want and {t for t, *_ in got} >= {"red", "ber"} and not any(t == "rarea" for t, *_ in got)
    scored = bm25.score_terms(docs, asked)
    pick = ["item_id", "doc_id", "score", "rank"]
    want = sorted(map(tuple, bm25.top_k(scored, 3).select(*pick).collect()))
    assert sorted(map(tuple, bm25.top_k(bm25.top_lists(docs, asked, 3), 3).select(*pick).collect())) == want and len(want) == 9
    built = index.build(docs, str(tmp_path / "i"), files=3)
    assert index.broken_terms(built).isEmpty()
    assert sorted(map(tuple, index.search(built, asked, 3).select(*pick).collect())) == want
    monkeypatch.setattr(bm25, "MAX_ENTRIES", 2)
    assert sorted(map(tuple, index.search(built, asked, 3).select(*pick).collect())) == want
