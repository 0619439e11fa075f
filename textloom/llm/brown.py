"""Class-based bigram language model: exchange clustering, class transitions, word emissions.

Counts of all words of all training texts are gathered: every task counts its own block of texts, words
are summed over blocks, and each block gets back the totals of its words that other blocks hold too. The
HEAD most frequent words are assigned to CLASSES classes by exchange: each word in turn moves to the class
that raises the likelihood of the class bigrams most, until a sweep moves none. Every other word that
occurs FLOOR times or more in the training texts then joins the class of the largest gain by the same
measure, from its counts of classes before and behind it, each word by itself against the classes of the
exchange. Words below the floor stand for unknown words: they and unknown words belong to a class by their
shape (letters, ending, length), as without any of them these classes would have no frequencies. The end
of a text is a class of its own. A word's probability is P(class | class before) * P(word | class), the
first with the class frequencies mixed in, the second with counts raised by a constant and one place left
for unknown words. The class bigrams are counted with all words in the classes they have in the end.

Words are told apart by 64-bit hashes. A block is what one task reads; a block's texts carry a checksum,
so that a scan that is split differently the second time fails instead of counting wrongly. What comes to
the driver is bounded: HEAD words, bigrams of HEAD + SHAPES + 1 units, and bigrams of classes.

Nulls: a null text counts as empty (its end only); a null doc_id trains and is not held out. Repeated rows
count each, an empty table gives an empty result, long texts are taken whole, other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.memory import give_back, tidy
from textloom.session import materialize

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
FOLDS = 10
HEAD = 1_000
CLASSES = 40
#: Least count of a word that joins a learned class.
FLOOR = 2
ADD = 0.1
MIX = 20.0
SHAPES = 48
CACHE_WORDS = 400_000
#: Tokens whose neighbours are counted at once.
NEAR_TOKENS = 2_000_000
#: Texts of one block beyond this many bytes of input are split further by their hash.
BLOCK_BYTES = 16 << 20


#: By a word's last byte: vowels, other letters (those beyond ASCII too), punctuation, other signs.
_ENDINGS = [0 if e in b"aeiou" else 1 if e.isalpha() or not e.isascii() else 2 if e in b".,;:!?" else 3 for e in (bytes([b]) for b in range(256))]
_GERMAN, _SPANISH = set("äöüß"), set("ñóíáú")


def shape(word: bytes) -> int:
    """0 to SHAPES - 1, by letters beyond ASCII, by what the word ends with, and by its length."""
    if word.isascii():
        marks = 0
    else:
        text = word.decode(errors="replace")
        marks = 1 if not _GERMAN.isdisjoint(text) else 2 if not _SPANISH.isdisjoint(text) else 3
    n = len(word)
    return (marks * 4 + _ENDINGS[word[-1]]) * 3 + (0 if n <= 4 else 1 if n <= 8 else 2)


def key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z, split at ASCII white space, as bytes methods do."""
    return (text or "").encode().lower().split()


def _prepared(docs: DataFrame) -> DataFrame:
    """block, train, doc_id, text; the block is the task that reads the row, split further if large."""
    conf = docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower()
    scale = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = conf.rstrip("bkmg")
    size = int(digits) * scale[conf[len(digits) :][:1] or "b"]
    parts = max(1, size // BLOCK_BYTES)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    block = F.spark_partition_id().cast("long") * parts + F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    return docs.select(block.alias("block"), F.coalesce(remainder != 0, F.lit(True)).alias("train"), "doc_id", "text")


def _check(total: int, doc_id: int | None, text: str | None) -> int:
    return (total + xxhash.xxh3_64_intdigest(f"{doc_id}:{text or ''}".encode())) & ((1 << 62) - 1)


_COUNTS = "block long, h long, n long, shape int"
#: Rows of these shapes hold a block's number of training texts, and its checksum.
ENDS, CHECKSUM = -1, -2


def block_counts(prepared: DataFrame) -> DataFrame:
    """Training count n (0 where only held-out texts have it) of every word of each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        others: dict[int, set] = {}
        ends, checks = Counter(), {}
        for batch in batches:
            for block, train, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                block, text, doc_id = block.as_py(), text.as_py(), doc_id.as_py()
                checks[block] = _check(checks.get(block, 0), doc_id, text)
                words = words_of(text)
                if train.as_py():
                    counts.setdefault(block, Counter()).update(words)
                    ends[block] += 1
                else:
                    others.setdefault(block, set()).update(words)
        for block, check in checks.items():
            mine = counts.pop(block, Counter())
            for w in others.pop(block, ()):
                if w not in mine:
                    mine[w] = 0
            for part in chain(batched(mine, 50_000), [None]):  # at the end what tells of the block
                h = [0, 0] if part is None else list(map(key, part))
                n = [ends[block], check] if part is None else list(map(mine.__getitem__, part))
                s = [ENDS, CHECKSUM] if part is None else list(map(shape, part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), block, np.int64)), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.int32())],
                    ["block", "h", "n", "shape"],
                )

    return prepared.mapInArrow(tidy(work), _COUNTS)


class Units:
    """Numbers of words: HEAD words first, then shapes, then the end of a text."""

    def __init__(self, head: list[int]) -> None:
        self.head = {h: i for i, h in enumerate(head)}
        self.size = len(head) + SHAPES + 1
        self.end = self.size - 1
        self.known: dict[bytes, int] = {}

    def of(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            found = self.head.get(key(word))
            found = len(self.head) + shape(word) if found is None else found
            if len(self.known) < CACHE_WORDS:
                self.known[word] = found
        return found


def unit_bigrams(prepared: DataFrame, head: list[int]) -> np.ndarray:
    """Counts of neighbouring units in training texts, an end before and behind each text."""
    size = Units(head).size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, cells, held, n = Units(head), np.zeros(size * size, np.int64), [], 0
        known, of = units.known, units.of
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                u = np.array([units.end, *[x if (x := known.get(w)) is not None else of(w) for w in words], units.end])
                held.append(u[:-1] * size + u[1:])
                n += len(u)
                if n > 500_000:
                    cells += np.bincount(np.concatenate(held), minlength=size * size)
                    held, n = [], 0
        if held:
            cells += np.bincount(np.concatenate(held), minlength=size * size)
        at = np.flatnonzero(cells)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    rows = prepared.where("train").select("text").mapInArrow(tidy(work), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[rows.cell.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, movable: int, classes: int = CLASSES) -> np.ndarray:
    """Classes of units: the first ``movable`` are exchanged between ``classes`` classes, each other unit
    keeps a class of its own. Starts with words dealt out by rank; raises sum f(N(c,d)) - 2 sum f(N(c)) with
    every move by more than rounding can, and so comes to an end."""
    n = len(bigrams)
    total = classes + n - movable
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)]).astype(int)
    pairs = np.zeros((total, total))
    np.add.at(pairs, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), bigrams)
    weight = bigrams.sum(axis=1).astype(float)
    mass = np.bincount(of, weight, total)
    least = max(1e-9, 1e-13 * float(_xlogx(weight.sum())))
    moved = movable
    while moved:
        moved = 0
        for w in range(movable):
            c, own = of[w], float(bigrams[w, w])
            after = np.bincount(of, bigrams[w], total)
            before = np.bincount(of, bigrams[:, w], total)
            after[c] -= own
            before[c] -= own
            pairs[c] -= after
            pairs[:, c] -= before
            pairs[c, c] -= own
            mass[c] -= weight[w]
            d = np.arange(classes)
            gain = (_xlogx(pairs[:classes] + after) - _xlogx(pairs[:classes])).sum(axis=1)
            gain += (_xlogx(pairs[:, :classes] + before[:, None]) - _xlogx(pairs[:, :classes])).sum(axis=0)
            cross = pairs[d, d]
            gain += _xlogx(cross + after[:classes] + before[:classes] + own) - _xlogx(cross + after[:classes]) - _xlogx(cross + before[:classes]) + _xlogx(cross)
            gain -= 2 * (_xlogx(mass[:classes] + weight[w]) - _xlogx(mass[:classes]))
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + least:
                best = int(c)
            moved += best != c
            of[w] = best
            pairs[best] += after
            pairs[:, best] += before
            pairs[best, best] += own
            mass[best] += weight[w]
    return of


def class_pairs(of: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    total = int(of.max()) + 1
    pairs = np.zeros((total, total))
    np.add.at(pairs, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), bigrams)
    return pairs


class Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


#: Cells of a word beyond the head: classes behind it, then classes before it, then the word itself behind.
_NEAR = "h long, shape int, cells binary"


def near_counts(prepared: DataFrame, head: list[int], of: np.ndarray) -> DataFrame:
    """How often each class stands next to each training word beyond the head: rows of a word's hash and
    its cells with counts, packed as cell << 40 | count. A word has a row for each NEAR_TOKENS tokens at
    most that one task reads."""
    total, end = int(of.max()) + 1, int(of[-1])
    width = 2 * total + 1
    number = {h: i for i, h in enumerate(head)}

    def counted(place: Places, parts: list[list[int]]) -> Iterator[pa.RecordBatch]:
        words = list(place)  # the first is the end of a text
        keys = list(map(key, words))
        shapes = of[len(head) + np.array([0, *map(shape, words[1:])])]
        units = np.array([number.get(h, -1) for h in keys])
        numbers = np.where(units >= 0, of[units], shapes)
        far = units < 0
        numbers[0], far[0] = end, False
        keys = np.array(keys, np.int64)
        ids = np.concatenate([np.array(p, np.int64) for p in parts])
        left, right = ids[:-1], ids[1:]
        own = left == right
        behind = np.where(own, 2 * total, numbers[right]) + left * width
        before = numbers[left] + total + right * width
        cells, n = np.unique(np.concatenate([behind[far[left]], before[far[right] & ~own]]), return_counts=True)
        packed = (cells % width << 40) | n
        starts = np.flatnonzero(np.diff(cells // width, prepend=-1))
        ends = np.append(starts[1:], len(cells))
        for i in range(0, len(starts), 20_000):
            a, b = starts[i : i + 20_000], ends[i : i + 20_000]
            some = cells[a] // width
            offsets = (np.append(a, b[-1]) - a[0]).astype(np.int32) * 8
            data = pa.py_buffer(packed[a[0] : b[-1]].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[some]),
                    pa.array(shapes[some].astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), data]),
                ],
                ["h", "shape", "cells"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, n = Places({b"": 0}), [[0]], 0  # no word is empty: this is the end of a text
        for batch in batches:
            for text in batch.column(0):
                parts.append([*[place[w] for w in words_of(text.as_py())], 0])
                n += len(parts[-1])
                if n > NEAR_TOKENS:
                    yield from counted(place, parts)
                    place, parts, n = Places({b"": 0}), [[0]], 0
        if n:
            yield from counted(place, parts)

    return prepared.where("train").select("text").mapInArrow(tidy(work), _NEAR)


def best_classes(word: np.ndarray, cell: np.ndarray, n: np.ndarray, own_class: np.ndarray, pairs: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of the largest gain and the count of each word: the gain of exchange() for a word that is
    taken out of ``own_class``, with ``word``, ``cell`` and ``n`` as sparse counts (see near_counts)."""
    size, total = len(own_class), len(pairs)
    n = n.astype(float)
    isown, isafter = cell == 2 * total, cell < total
    isbefore = ~isown & ~isafter
    own = np.bincount(word[isown], n[isown], size)
    aw, ax, an = word[isafter], cell[isafter], n[isafter]
    bw, bx, bn = word[isbefore], cell[isbefore] - total, n[isbefore]
    after, before = np.zeros((classes, size)), np.zeros((classes, size))
    learned = ax < classes
    np.add.at(after, (ax[learned], aw[learned]), an[learned])
    learned = bx < classes
    np.add.at(before, (bx[learned], bw[learned]), bn[learned])
    count = np.bincount(aw, an, size) + own
    mass = pairs.sum(axis=1)
    ahome, bhome = np.flatnonzero(ax == own_class[aw]), np.flatnonzero(bx == own_class[bw])
    terms = _xlogx(pairs)
    gain = np.empty((classes, size))
    for d in range(classes):
        held, term = pairs[d, ax], terms[d, ax]
        held[ahome] -= before[d, aw[ahome]]
        term[ahome] = _xlogx(held[ahome])
        gain[d] = np.bincount(aw, _xlogx(held + an) - term, size)
        held, term = pairs[bx, d], terms[bx, d]
        held[bhome] -= after[d, bw[bhome]]
        term[bhome] = _xlogx(held[bhome])
        gain[d] += np.bincount(bw, _xlogx(held + bn) - term, size)
        cross, a, b = pairs[d, d], after[d], before[d]
        gain[d] += _xlogx(cross + a + b + own) - _xlogx(cross + a) - _xlogx(cross + b) + _xlogx(cross)
        gain[d] -= 2 * (_xlogx(mass[d] + count) - _xlogx(mass[d]))
    return np.argmax(gain, axis=0), count


def assigned(prepared: DataFrame, head: list[int], of: np.ndarray, bigrams: np.ndarray, classes: int) -> DataFrame:
    """h, shape and cls of every training word beyond the head that occurs FLOOR times or more."""
    pairs = class_pairs(of, bigrams)

    def joined(h: np.ndarray, own_class: np.ndarray, sizes: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(h, prepend=h[0] - 1))
        word = np.repeat(np.cumsum(np.diff(h, prepend=h[0] - 1) != 0) - 1, sizes)
        width = 2 * len(pairs) + 1
        cell, n = packed >> 40, packed & ((1 << 40) - 1)
        total = np.bincount(word, np.where((cell < len(pairs)) | (cell == width - 1), n, 0), len(first))
        keep = total >= FLOOR  # most words are rare
        h, own_class = h[first][keep], own_class[first][keep]
        kept = keep[word]
        word, cell, n = (np.cumsum(keep) - 1)[word[kept]], cell[kept], n[kept]
        cells, at = np.unique(word * width + cell, return_inverse=True)
        cls, _ = best_classes(cells // width, cells % width, np.bincount(at, n, len(cells)), own_class, pairs, classes)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(own_class - classes, pa.int32()), pa.array(cls, pa.int32())], ["h", "shape", "cls"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last word, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(x) for x in batch.column(2).to_pylist()]) // 8
            packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8")
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), sizes, packed]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            at = int(now[2][:cut].sum())
            if cut:
                yield joined(*[x[:cut] for x in now[:3]], now[3][:at])
            held = [*[x[cut:] for x in now[:3]], now[3][at:]]
        if held is not None:
            yield joined(*held)

    near = near_counts(prepared, head, of)
    return near.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(work), "h long, shape int, cls int")


class Model:
    """Log10 probabilities of a fitted model, small enough to send to every task."""

    def __init__(self, pairs: np.ndarray, kinds: np.ndarray) -> None:
        share = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
        self.moves = np.log10((pairs + MIX * share) / (pairs.sum(axis=1, keepdims=True) + MIX))
        self.below = np.log10(pairs.sum(axis=0) + ADD * (kinds + 1))


def fit(prepared: DataFrame, table: DataFrame) -> tuple[list[int], np.ndarray, DataFrame, np.ndarray, tuple[int, int, int]]:
    """The head, classes of its units, the classes of the other words, the number of words of each class;
    and training tokens, distinct training tokens and training texts."""
    ends = table.where(F.col("shape") == ENDS).agg(F.sum("n")).first()[0] or 0
    firsts = table.where("first and c > 0")
    by_shape = {r["shape"]: (r["c"], r["k"]) for r in firsts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect()}
    top = firsts.orderBy(F.desc("c"), "h").limit(HEAD).select("h", "shape").collect()
    head = [r["h"] for r in top]
    tokens = sum(c for c, _ in by_shape.values()) + ends
    distinct = sum(k for _, k in by_shape.values()) + (1 if ends else 0)
    bigrams = unit_bigrams(prepared, head)
    classes = max(1, min(CLASSES, len(head)))
    of = exchange(bigrams, len(head), classes)
    others = materialize(assigned(prepared, head, of, bigrams, classes), "brown-classes")
    kinds = np.bincount(of[: len(head)], minlength=classes + SHAPES + 1).astype(float)
    kinds[classes : classes + SHAPES] = [by_shape.get(s, (0, 0))[1] for s in range(SHAPES)]
    kinds[-1] = 1
    for r in top:
        kinds[classes + r["shape"]] -= 1
    for r in others.groupBy("shape", "cls").count().collect():  # SHAPES times CLASSES rows at most
        kinds[r["cls"]] += r["count"]
        kinds[classes + r["shape"]] -= r["count"]
    return head, of, others, kinds, (int(tokens), int(distinct), int(ends))


_PARTS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, emitted double, classes binary"


def class_scores(docs: DataFrame) -> DataFrame:
    """Scores of every whole text under the unigram base and the class model."""
    spark = docs.sparkSession
    prepared = _prepared(docs)
    table = materialize(_totals(block_counts(prepared)), "brown-counts")
    head, of, others, kinds, sums = fit(prepared, table)
    told = spark.sparkContext.broadcast((head, of, *sums))  # HEAD words
    same = (F.col("t.h") == F.col("o.h")) & (F.col("t.shape") >= 0)
    back = (
        table.where(f"c <> n or shape = {CHECKSUM} or c >= {FLOOR}")
        .alias("t")
        .join(others.alias("o"), same, "left")
        .select("t.block", "t.h", "t.c", (F.col("t.shape") == CHECKSUM).alias("check"), F.coalesce("o.cls", F.lit(-1)).alias("cls"))
    )

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        head, of, tokens, distinct, ends = told.value
        checks = right.c[right.check]
        # Words become numbers as they come: a block's words are held once each, its texts as arrays.
        total, place, texts, trained = 0, Places(), [], []
        for doc_id, train, text in zip(left.doc_id, left.train, left.text, strict=True):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            text = text if isinstance(text, str) else None
            total = _check(total, doc_id, text)
            at = np.array([place[w] for w in words_of(text)], np.int32)
            texts.append(at)
            if train:
                trained.append(at)
        if len(left) and (len(checks) != 1 or int(checks.iloc[0]) != total):
            raise RuntimeError("the texts were split into other blocks than when they were counted")
        keys = np.fromiter(map(key, place), np.int64, len(place))
        count = np.bincount(np.concatenate([*trained, np.zeros(0, np.int32)]), minlength=len(place))
        other = right[~right.check].sort_values("h")
        h, c = other.h.to_numpy(np.int64), other.c.to_numpy(np.int64)
        learned = np.full(len(place), -1)
        if len(h):
            near = np.minimum(np.searchsorted(h, keys), len(h) - 1)
            count = np.where(h[near] == keys, c[near], count)
            learned = np.where(h[near] == keys, other.cls.to_numpy(np.int64)[near], -1)
        count = np.array([*count, ends], float)
        units = Units(head)
        number = (units.head.get(k, -1) for k in keys.tolist())
        known = (of[n] if n >= 0 else of[len(head) + shape(w)] if l < 0 else l for w, n, l in zip(place, number, learned.tolist(), strict=True))
        cls = np.array([*known, of[-1]], np.uint8)
        base = np.log10((count + ADD) / (tokens + ADD * (distinct + 1)))
        emit = np.log10(count + ADD)
        rows, end = [], len(place)
        for words in texts:
            at = np.append(words, end)
            rows.append((len(at), int((count[at] > 0).sum()), tokens, float(base[at].sum()), float(emit[at].sum()), cls[at].tobytes()))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "train_tokens", "base_score", "emitted", "classes"])
        out.insert(0, "doc_id", left.doc_id.astype("Int64").array)
        out.insert(1, "held_out", (~left.train.astype(bool)).array)
        del place, texts, trained
        give_back()
        return out

    parts = materialize(prepared.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(work, _PARTS), "brown-parts")
    return _scored(parts, Model(class_bigrams(parts, len(kinds)), kinds))


def _pairs_of(classes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and classes of a text's tokens; it starts behind an end."""
    c = np.frombuffer(classes, np.uint8).astype(np.int64)
    return np.concatenate([c[-1:], c[:-1]]), c


def class_bigrams(parts: DataFrame, total: int) -> np.ndarray:
    """Counts of neighbouring classes in training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(total * total, np.int64)
        for batch in batches:
            for classes in batch.column(0).to_pylist():
                before, c = _pairs_of(classes)
                np.add.at(cells, before * total + c, 1)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    rows = parts.where("not held_out").select("classes").mapInArrow(tidy(work), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(total * total)
    out[rows.cell.to_numpy(np.int64)] = rows.n.to_numpy(float)
    return out.reshape(total, total)


def _scored(parts: DataFrame, model: Model) -> DataFrame:
    """Adds each text's score: its emissions, and the moves between its classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = model.moves - model.below
        for batch in batches:
            moved = np.array([float(cost[_pairs_of(x)].sum()) for x in batch.column(7).to_pylist()])
            score = pa.array(batch.column(6).to_numpy() + moved, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], score], [*batch.schema.names[:6], "score"])

    return parts.mapInArrow(tidy(work), SCHEMA)


def _totals(counted: DataFrame) -> DataFrame:
    """Every row with the word's total c, and whether its block is the first of the word's. A word has at
    most one row for each block, so none is hotter than there are blocks. The rows that tell of a block
    take the same way under keys of their own, so that the texts are counted in one pass."""
    h = F.when(F.col("shape") < 0, F.xxhash64("block", "shape")).otherwise(F.col("h"))
    kind = (F.col("shape") < 0).cast("int")
    same = Window.partitionBy("h", "kind")
    return (
        counted.select("block", h.alias("h"), "n", "shape", kind.alias("kind"))
        .withColumns({"c": F.sum("n").over(same), "least": F.min("block").over(same)})
        .select("block", "h", "n", "shape", "c", ((F.col("block") == F.col("least")) & (F.col("kind") == 0)).alias("first"))
    )
