"""The pipeline: every stage against plain Python on its own input, and run() as their chain."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import packing, pii, quality, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text_hash long, label string"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input, in order, and the last one's output."""
    found = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.materialize(stage(spark, found[-1], DIR), name.replace(" ", "-")))
    return found


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_names(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "PII", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage(stages):
    verdicts = by_id(quality.quality_verdicts(stages[0]))
    assert set(by_id(stages[1])) == {i for i, r in verdicts.items() if r.kept}


def test_toxicity_stage(spark, stages):
    model = toxicity.train(stages[1], spark.read.parquet(f"{DIR}/labels.parquet"))
    assert set(by_id(stages[2])) == {i for i, r in by_id(stages[1]).items() if model.score(r.text or "")[0] < 0.5}


def test_near_duplicate_stage(stages):
    sets = {}
    for i, r in by_id(stages[2]).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for _ in sets:  # smallest id reachable, by repeated relaxing
        before = dict(root)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert set(by_id(stages[3])) == set(root.values())


def test_personal_data_stage(stages):
    """Every base span is gone; texts without any span are as they were."""
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    spans = {r.doc_id: r.spans for r in pii.pii_digest(stages[3]).collect()}
    for i, r in before.items():
        assert after[i].n_chars == len(after[i].text or "")
        if not spans[i]:
            assert after[i].text == r.text
        out, reach = [], 0
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)):
            if start >= reach:
                out.append(r.text[reach:start] + f"<{kind.upper()}>")
            reach = max(reach, end)
        assert after[i].text == "".join(out) + (r.text or "")[reach:]


def test_packing_stage(stages):
    library = packing.tokenizer(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).library
    pieces, sizes = defaultdict(list), Counter()
    for r in stages[5].collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        sizes[r.sequence_id] += r.length
    for i, r in by_id(stages[4]).items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert b"".join(x for _, x in sorted(pieces.pop(i))) == np.array(ids, "<u4").tobytes()
    assert not pieces and all(n <= 4096 and not n & (n - 1) for n in sizes.values())


def test_run_is_the_chain(spark, stages):
    digest = lambda df: Counter((r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in df.collect())
    tokens = lambda df: Counter({i: sum(n for j, _, n in rows if j == i) for rows in [[(r.doc_id, r.start, r.length) for r in df.collect()]] for i in {x[0] for x in rows}})
    got = corpus_pipeline.run(spark, DIR)
    assert tokens(got) == tokens(stages[5]) and sum(digest(got).values()) > 0


def test_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, words, "en", "s", 1, "r", 1, "l"), (1, words, "en", "s", 1, "r", 1, "l"), (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "r", 1, "l"),
        (4, words + " write to a@b.co", "en", "s", 1, "r", 1, "l"), (None, words + " x", "en", None, 1, "r", 1, "l"),
    ]
    for table in (rows, []):
        docs = spark.createDataFrame(table, SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, DIR), name.replace(" ", "-"))
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        kept = Counter(r.doc_id for r in docs.collect())
        assert kept == (Counter({1: 1, None: 1}) if table else Counter())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() >= len(kept)
