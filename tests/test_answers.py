"""Reranking, answers, their metrics and question sets, on cases worked out by hand."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import faithfulness as faith
from textloom.operators import answers, rerank, testsets

RECORD = "qid long, kind string, question string, answer string, refused boolean, gold_chunk_id string, gold_answer string, hits array<struct<rank:int,chunk_id:string,text:string>>"
HITS = [(1, "a", "The tower is 30 m."), (2, "b", None)]


def records(spark):
    rows = [
        (1, "kb", "q", "It is 30 m [1].", False, "a", "30 m", HITS),
        (2, "kb", "q", "Other [2][7]", False, "a", "40", HITS),
        (3, "kb", "q", "cannot answer", False, "a", "30 m", HITS),
        (4, "oob", "q", "Unable to [1]", True, None, None, HITS),
        (5, "oob", "q", "Sure", False, None, None, None),
        (6, "kb", "q", "30 M", False, "z", "30 m", HITS),
        (7, None, None, None, None, None, None, None),
        (8, "kb", "q", "x [1]", False, "z", "", HITS),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_assembly(spark):
    got = {r.qid: r for r in answers.assemble(records(spark)).collect()}
    assert got[1].cited == [1] and got[1].gold_rank == 1 and got[1].cited_chunk_ids == ["a"]
    assert got[2].cited == [2] and got[2].bad_citations == [7] and got[2].cited_texts == [None]
    assert got[3].refused_measured and got[5].cited == [] and got[6].gold_rank is None and got[7].answer == ""


def test_metrics(spark):
    m = answers.generation_metrics(answers.judged(answers.assemble(records(spark)))).first()
    assert m.n == 8 and m.oob_refusal == 0.5 and m.false_refusal == round(1 / 6, 4) and m.false_refusal_gold_here == round(1 / 3, 4)
    assert m.refusal_gold_missing == 0.0 and m.flag_mismatch == 1 and m.no_cite == 0.5 and m.bad_numbers == 1
    assert m.citation_strict == 0.5 and m.miss_with_cite == 1 and m.miss_no_cite == 0 and m.citation_lenient == 0.5
    assert m.ghost_cites == 1 and m.answer_hit == 0.5 and m.end_to_end == round(3 / 8, 4)
    none = answers.generation_metrics(answers.judged(answers.assemble(records(spark).limit(0)))).first()
    assert none.n == 0 and none.end_to_end is None


def test_pick_takes_each_record_once(spark):
    got = {r.qid: r.bucket[0] for r in answers.audit_pick(answers.judged(answers.assemble(records(spark))), 50).collect()}
    assert got == {5: "A", 3: "B", 2: "C", 1: "D", 6: "E", 7: "E"}


def test_context_and_backends(spark):
    got = {r.qid: r.answer for r in answers.answered(records(spark)).collect()}
    assert "[1] The tower is 30 m.\n\n[2] " in got[1] and got[1].endswith("Question: q")


def test_judge_rates_and_calibration(spark):
    clauses = spark.createDataFrame([(1, "k", "YES "), (1, "k", "no"), (1, "k", "maybe"), (2, "k", "有依据"), (3, "k", None)], "qid long, kind string, verdict string")
    assert tuple(answers.judge_rates(clauses).first()) == ("k", 3, 0.6667, 0.75)
    scored = spark.createDataFrame([(0.2, True), (0.6, True), (0.7, False), (None, True)], "s double, t boolean")
    got = {r.threshold: tuple(r)[1:] for r in answers.calibrate(scored, "s", "t", [0.5, 0.9]).collect()}
    assert got == {0.5: (3, 0.3333, 0.5, 0.5), 0.9: (3, 0.3333, None, 0.0)}


def test_upper_median(spark):
    runs = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, None, 1.0), (4.0, 4.0, 9.0), (1.0, 1.0, 2.0)], "a double, b double, total double")
    assert tuple(answers.timing_summary(runs, ["a", "b"], "total").first()) == (4, 3.5, 2.0, 1)


def test_rerank(spark):
    pool = spark.createDataFrame([(1, 5, 1, "red fox", "a dog"), (1, 6, 2, "red fox", "the red fox"), (1, 7, 3, "red fox", None), (1, 8, 4, "red fox", "red fox")], "item_id long, doc_id long, rank long, question string, text string")
    got = rerank.rerank(pool, 3)
    assert [(r.doc_id, r.new_rank) for r in got.orderBy("new_rank").collect()] == [(6, 1), (8, 2), (5, 3)]
    gold = spark.createDataFrame([(1, 8)], "item_id long, doc_id long")
    assert tuple(rerank.migration(got, gold).first()) == (1, 0, 0)
    cut = pool.select("doc_id", rerank.is_truncated(F.col("question"), F.col("text"), 8).alias("c"))
    assert {r.doc_id: r.c for r in cut.where("text is not null").collect()} == {5: False, 6: True, 8: False}


def test_question_sets(spark):
    rows = [
        (1, "easy", "what does the tower weigh", "30", "a", "", "what does the tower weigh 30"),
        (2, "hard_anon", "how tall is Tower", "99", "a", "Tower", "it is 30 m"),
        (3, "easy", "what does  the tower weigh", "30", "a", "", ""),
        (4, "oob", "该公司在哪", None, None, None, None),
        (5, None, None, None, None, None, None),
    ]
    items = spark.createDataFrame(rows, "qid long, kind string, question string, answer string, gold_chunk_id string, gold_title string, chunk_text string")
    checked = testsets.local_checks(items)
    assert {r.qid: r.warn for r in checked.collect()} == {1: "leak", 2: "coverage/title", 3: "coverage", 4: "", 5: ""}
    flags = {(r.qid, r.rule) for r in testsets.audit(testsets.script_labels(checked).withColumn("answerable", F.lit(True))).collect()}
    assert flags >= {(1, "leak"), (3, "no overlap"), (2, "title in question"), (5, "short answer"), (4, "answerable"), (1, "repeated question"), (3, "repeated question"), (1, "shared chunk")}
    assert (4, "short answer") not in flags and (2, "repeated question") not in flags
    after = checked.withColumn("pass_local", F.col("qid") <= 4)
    assert tuple(testsets.flips(checked, after).first()) == (5, 3, 1)
    out = spark.createDataFrame([("x",)], "value string")
    known = checked.withColumn("answerable_in_kb", F.lit(False))
    assert [r.kind for r in testsets.finalise(known, "v1", out).collect()] == [None, "oob"]  # the unknown kind before what is out of base
    assert {(r.kind, r.reason) for r in testsets.decided(checked, "v1", out).collect() if r.kind in ("oob", None)} == {("oob", "not known to be out of base"), (None, None)}


def test_claims_by_hand(spark):
    """A cited claim must have its numbers in one passage it cites; one without is held against all."""
    rows = [
        (1, "In 1982 the red house burned [1]. It was rebuilt, at great cost. Yes [9].", ["the red house burned in 1982", "it was rebuilt at great cost"]),
        (2, "In 1983 the red house burned [1].", ["the red house burned in 1982"]),
        (3, "根据资料[1]。鄧小平會見撒切尔夫人[1]。", ["鄧小平会见撒切尔夫人"]),
        (4, "Anything at all here.", None),
        (5, None, ["a passage"]),
    ]
    claims = faith.claims(spark.createDataFrame(rows, "qid long, answer string, contexts array<string>"))
    got = {(r.qid, r.claim): r for r in claims.where("level = 'sentence'").collect()}
    assert got[1, "In 1982 the red house burned [1]."].words_strict and got[1, "It was rebuilt, at great cost."].words_lenient
    assert not got[1, "It was rebuilt, at great cost."].words_strict
    assert got[1, "Yes [9]."].coverage == 0.0 and not got[1, "Yes [9]."].lenient  # cites a passage that isn't there
    wrong = got[2, "In 1983 the red house burned [1]."]
    assert wrong.num_missing == ["1983"] and not wrong.words_lenient
    assert (3, "根据资料[1]") in got  # with a citation it is no filler
    parts = {(r.qid, r.claim) for r in claims.where("level = 'clause'").collect()}
    assert (1, "at great cost.") in parts and (3, "根据资料[1]") not in parts
    sums = {r.qid: r for r in faith.faithfulness(claims, "qid").collect()}
    assert sums[1].n_sent == 3 and sums[2].num_violations == 1 and sums[2].ratio_lenient == 0.0
    assert (sums[4].n_sent, sums[4].ratio_lenient, sums[4].clause_lenient) == (0, None, None) and sums[5].n_clause == 0


def test_claims_of_a_long_conversation(spark, monkeypatch):
    """Two blocks and many parts give what each answer gives with the turns before it as its contexts; turns are
    told to blocks of answers and not to each claim."""
    said = ["the old tower is 30 m high, the mill is new", "der turm ist 30 m hoch; 鄧小平會見", "a", "It is so [2], or 31 m [1]! 小平会见. the, and"]
    rows = [(1, i + 1, f"{said[i % 4]} x{i % 7}y", i % 2 == 1, None if i == 5 else f"{said[(i * 3) % 4]}. Tower x{i % 5}y [{i % 4}], mill{i % 3}. 30 m.") for i in range(41)] + [(2, 1, "alone", True, "No context.")]
    turns = spark.createDataFrame(rows, "g long, place long, text string, is_answer boolean, answer string")
    told = [(g, p, a, [t for h, q, t, _, _ in rows if h == g and q < p]) for g, p, _, yes, a in rows if yes]
    records = spark.createDataFrame(told, "g long, place long, answer string, contexts array<string>")
    columns = ["g", "place", "level", "claim", "coverage", "word_coverage", "num_missing", "weight", "cites", "strict", "words_strict", "lenient", "words_lenient"]
    key = lambda r: str(tuple(r))
    want = sorted(faith.claims(records).select(*columns).collect(), key=key)
    monkeypatch.setattr(faith, "BLOCK", 16)
    monkeypatch.setattr(faith, "CLAIMS", 5)
    monkeypatch.setattr(faith, "CELLS", 300)
    got = faith.turn_claims(turns, "g").select(*columns)
    assert sorted(got.collect(), key=key) == want and len(want) > 100


def test_tokens_are_found_by_one_search(spark):
    texts = ["", None, "the and", "the x", "thE they", "12 34", "12 3b", "a b", "这个", "这个那", "我们 他们", "é the1", "x的"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == (r[1] > 0) for r in df.select(T.has_mixed_tokens(F.col("t")), F.size(T.mixed_tokens(F.col("t")))).collect())
    assert [r[0] for r in df.where("t = '12 3b'").select(T.mixed_tokens(F.col("t"))).collect()] == [["3b"]]
