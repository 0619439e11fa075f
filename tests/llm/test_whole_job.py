"""Cases in which an operator once did less than its whole job."""

import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers

from textloom import session
from textloom.llm import brown, jaccard, packing, quality

DIR = "/root/testdata/sf0.001"


def test_words_beyond_the_head_join_the_best_class(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 200)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    prepared = brown._prepared(docs)
    table = brown.materialize(brown._totals(brown.block_counts(prepared)), "t")
    head, of, others, kinds, _ = brown.fit(prepared, table)
    got = {r.h: r.cls for r in others.collect()}
    texts = [[brown.key(w) for w in brown.words_of(r.text)] for r in prepared.where("train").collect()]
    counts = Counter(w for t in texts for w in t)
    assert set(got) == {w for w, n in counts.items() if n >= brown.FLOOR} - set(head)
    assert kinds.sum() == len(counts) + 1

    # the class of some of them by brute force: the likelihood of all class bigrams with the word in each class
    units, shapes = {h: i for i, h in enumerate(head)}, {}
    for r in docs.collect():
        shapes.update((brown.key(w), brown.shape(w)) for w in brown.words_of(r.text))
    place = {w: int(of[units[w]]) if w in units else 40 + shapes[w] for w in counts}
    end = int(of[-1])

    def likelihood(word: int, cls: int) -> float:
        now, pairs = {**place, word: cls}, Counter()
        for t in texts:
            c = [end, *[now[w] for w in t], end]
            pairs.update(zip(c[:-1], c[1:], strict=True))
        mass = Counter()
        for (a, _), n in pairs.items():
            mass[a] += n
        f = lambda x: x * np.log(x)
        return sum(map(f, pairs.values())) - 2 * sum(map(f, mass.values()))

    for word in sorted(got, key=lambda w: (-counts[w], w))[:2]:
        each = [likelihood(word, d) for d in range(40)]
        assert each[got[word]] >= max(each) - 1e-6 * abs(max(each)) * 1e-3


def test_outliers_of_small_groups_are_rejected(spark):
    rng = random.Random(7)

    def text(mark: str = "") -> str:
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) + mark for _ in range(rng.randint(80, 200)))

    table = [(i, text(), "en", "big") for i in range(200)]
    table += [(1000, text("###$"), "en", "rare"), (1001, text(), "en", "rare2")]
    table += [(2000 + i, "few words", "en", "failing") for i in range(60)] + [(2100, text("###$"), "en", "failing")]
    table += [(3000, text("###$"), "xx", "s"), (3001, text(), "yy", None), (3002, text("###$"), None, None)]
    got = quality.quality_verdicts(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(table)
    assert {r.doc_id for r in got if not r.kept and not r.base_failed} == {1000, 2100, 3000, 3002}


def test_tables_written_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[Path]:
        return {p for d in manager.localDirs() for p in Path(d.getPath()).rglob("shuffle_*.data")}

    before = files()
    held = session.materialize(spark.range(100_000).repartition(4, "id"), "t")
    assert held.count() == 100_000
    for _ in range(50):  # they are deleted in the background
        if not [p for p in files() - before if p.stat().st_size > 10_000]:
            break
        time.sleep(0.2)
    else:
        raise AssertionError("shuffle files are left")


def test_chance_passages_do_not_bring_texts_into_one_tile(spark, monkeypatch):
    """Texts in a ring that share a fifth with the next one, and a family of near copies: only the family is cut
    into tiles, and the classes are those of all pairs."""
    rng = random.Random(3)
    passages = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(80)]
    own = lambda: [f"w{rng.randrange(10**6)}" for _ in range(90)]
    texts = [passages[i] + own() + own() + passages[(i + 1) % 80] for i in range(80)]
    family = own() + own() + own()
    for _ in range(30):
        copy = list(family)
        copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(copy)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    seen, cut = [], jaccard._tile_units

    def units(large, labels):
        seen.extend(r.rep for r in large.select("rep").collect())
        return cut(large, labels)

    monkeypatch.setattr(jaccard, "_tile_units", units)
    monkeypatch.setattr(jaccard, "SMALL_SHINGLES", 1500)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(table).collect()}
    assert got == {i: i if i < 80 else 80 for i in range(110)}
    assert sorted(seen) == list(range(80, 110))


def test_words_of_letters_and_a_sign_need_no_search_for_runs(monkeypatch):
    coder = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Onnd, heeath. shrent! hesten", "a' b\" c| d< E\\ n9 ,x don't's x,, <|", "Über élève. ıI İx ñandú,"]
    texts += [f"word{c}" for c in sorted(packing.SIGNS)]
    for text in texts:
        assert coder.encode(text) == b"".join(i.to_bytes(4, "little") for i in coder.library.encode(text, add_special_tokens=False).ids)

    def searched(word):
        raise AssertionError(word)

    monkeypatch.setattr(packing, "RUNS", searched)
    coder.words.clear()
    coder.words[""] = b""
    assert coder.encode(texts[0]) and coder.encode("élève")
