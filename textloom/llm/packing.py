"""Hierarchical packing of documents into training sequences of several context sizes.

A document's tokens are cut into whole windows of the longest tier and a rest; the rest goes to the
shortest tier that holds it. Tiers are packed from the longest down: a rest opens a window of its tier and
the gap behind it is filled from shorter tiers, the longest piece that fits first; what still gapes is
filled by cutting a piece of a shorter tier. Windows are closed full. Sequences are grouped into steps of
``STEP_TOKENS`` tokens each, of one window size.

This happens in the task that reads a document, in blocks bounded by tokens. What a task can't finish,
pieces for less than a window of each tier and sequences for less than a step, is written like the rest and
then pooled over ``POOLED`` tasks: their pieces are packed on, their sequences fill steps on (the last ones
of mixed sizes; powers of two fill a step without a gap), and only the very last pieces of a pool are cut
into powers of two, so that there is no padding. So a pool has one step that is not full, and what is
shuffled is bounded for each task, whatever it reads. Sequence ids carry the task's or the pool's number,
so they are distinct without any exchange.

A null text counts as empty and has its end token only. Repeated rows are packed each on its own, an
empty table gives an empty result, documents of any length are cut into windows, and columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.memory import tidy
from textloom.session import materialize

#: ids: the piece's tokens as little-endian unsigned 32-bit integers.
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 8 * 4096
END_ID = 2
#: Tasks whose rests are pooled, and where the numbers of pools begin.
POOLED, POOLS = 64, 1 << 26
#: Tokens gathered before a block is packed.
BLOCK_TOKENS = 2_000_000
#: Words, and runs of which words are made, kept with their ids in a worker; beyond this the rest are
#: encoded each time. Both are small enough for two workers beside an executor's heap in 3 GB.
CACHE_WORDS, CACHE_RUNS = 250_000, 60_000
#: What the vocabulary's splitting rule makes of a lower-case word, and the words it is applied to here.
RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
LATIN = re.compile(r"(?!.*<\|)[!-~\u00a1-\u0130\u0132-\u017e]*").fullmatch
#: Signs of which a single one behind letters is a run of its own.
SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: A gap below this is filled by cutting a piece at once instead of looking for one that fits.
SMALL_GAP = 16


class _Words(dict):
    """Ids of words; those that are missing are looked up by ``word_of``, which may put them here."""

    def __init__(self, word_of: Callable[[str], bytes]) -> None:
        super().__init__({"": b""})
        self.word_of = word_of

    def __missing__(self, word: str) -> bytes:
        return self.word_of(word)


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit integers. The vocabulary's splitting rule never lets a
    token pass white space, so each word between spaces or line ends is encoded on its own and kept, as
    are the runs of letters, digits and signs that words are made of. Words of other than Latin letters,
    or with marks to be composed, are left to the library as they are."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.runs: dict[str, bytes] = {}
        self.words = _Words(self._word)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _run(self, run: str) -> bytes:
        shown = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))  # no white space is in runs
        ids = self.model.tokenize(shown)
        found = b"".join([t.id.to_bytes(4, "little") for t in ids])
        if len(self.runs) < CACHE_RUNS and len(run) <= 64:
            self.runs[run] = found
        return found

    def _word(self, word: str) -> bytes:
        runs = self.runs
        last = word[-1]
        if word.isascii() and (word.isalpha() or word[:-1].isalpha() and last in SIGNS):  # letters, and one sign at most
            low = word.lower()
            run = low if last not in SIGNS else low[:-1]
            found = runs.get(run) or self._run(run)
            if last in SIGNS:
                found += runs.get(last) or self._run(last)
        elif LATIN(word):
            low = word.lower()
            found = b"".join([runs.get(r) or self._run(r) for r in ((low,) if low.isalpha() else RUNS(low))])
        else:
            found = b"".join([i.to_bytes(4, "little") for i in self.library.encode(word, add_special_tokens=False).ids])
        if len(self.words) < CACHE_WORDS and len(word) <= 64:
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path)


Piece = tuple[int | None, int, bytes, int]  # document, start, ids, the document's tokens


class Packer:
    """Packs a stream of documents; ``rows`` holds what has been placed since it was last taken."""

    def __init__(self, stream: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        self.tiers, self.step_tokens, self.base = tuple(sorted(tiers)), step_tokens, stream << 36
        self.sequences, self.rows, self.held, self.steps = 0, [], 0, 0
        self.open: dict[int, list[list[tuple]]] = {}  # by window size: the sequences of the step being filled
        self.waiting: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}  # (length, piece), sorted
        self.pieces: list[Piece] = []

    def _close(self, size: int, parts: list[Piece]) -> None:
        placed, offset = [], 0
        for doc, start, ids, total in parts:
            placed.append((doc, start, len(ids) // 4, ids, total, self.base | self.sequences, offset, size))
            offset += len(ids) // 4
        self.sequences += 1
        self.join(size, placed)

    def join(self, size: int, sequence: list[tuple]) -> None:
        """Puts a sequence into the step that is filled with its size."""
        held = self.open.setdefault(size, [])
        held.append(sequence)
        if len(held) * size >= self.step_tokens:
            self._step(held)
            self.open[size] = []

    def _step(self, sequences: list[list[tuple]]) -> None:
        step = self.base | self.steps
        self.steps += 1
        self.rows += [(*row, step) for sequence in sequences for row in sequence]

    def add(self, doc: int | None, ids: bytes) -> None:
        total, top = len(ids) // 4, self.tiers[-1]
        whole = total - total % top
        for start in range(0, whole, top):
            self._close(top, [(doc, start, ids[4 * start : 4 * (start + top)], total)])
        if total > whole:
            self._wait((doc, whole, ids[4 * whole :], total))

    def _wait(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        tier = next(t for t in self.tiers if n <= t)
        insort(self.waiting[tier], (n, len(self.pieces)))
        self.pieces.append(piece)
        self.held += n

    def _take(self, tiers: tuple[int, ...], most: int) -> tuple | None:
        """The longest waiting piece of these tiers with at most so many tokens."""
        for t in reversed(tiers):
            at = bisect_right(self.waiting[t], (most, 1 << 60))
            if at:
                n, k = self.waiting[t].pop(at - 1)
                self.held -= n
                return self.pieces[k]
        return None

    def _cut(self, tiers: tuple[int, ...], n: int) -> tuple | None:
        """The first n tokens of the shortest longer waiting piece; the rest waits again."""
        for t in tiers:
            if self.waiting[t]:
                size, k = self.waiting[t].pop()
                self.held -= size
                doc, start, ids, total = self.pieces[k]
                if size > n:
                    self._wait((doc, start + n, ids[4 * n :], total))
                return doc, start, ids[: 4 * n], total
        return None

    def pack(self) -> None:
        """Closes every window that can be filled; the rest stays for the next block."""
        for place in range(len(self.tiers) - 1, -1, -1):
            size, lower = self.tiers[place], self.tiers[:place] or self.tiers[:1]
            while self.waiting[size] and sum(n for n, _ in self.waiting[size][:1]):
                if self.held < size:
                    break
                n, k = self.waiting[size].pop()
                self.held -= n
                parts, gap = [self.pieces[k]], size - n
                while gap:
                    piece = self._take(lower, gap) if gap >= SMALL_GAP else None
                    piece = piece or self._cut(lower, gap) or self._cut(self.tiers[: place + 1], gap)
                    if piece is None:
                        break
                    parts.append(piece)
                    gap -= len(piece[2]) // 4
                if gap:  # nothing is left to fill with
                    for piece in parts:
                        self._wait(piece)
                    break
                self._close(size, parts)
        left = [(n, k) for t in self.tiers for n, k in self.waiting[t]]
        kept = [self.pieces[k] for _, k in left]
        self.waiting, self.pieces, self.held = {t: [] for t in self.tiers}, [], 0
        for piece in kept:
            self._wait(piece)

    def _left(self) -> list[Piece]:
        left = [self.pieces[k] for t in reversed(self.tiers) for _, k in reversed(self.waiting[t])]
        self.waiting, self.pieces, self.held = {t: [] for t in self.tiers}, [], 0
        return left

    def leave(self) -> None:
        """Gives out what can't be finished here: pieces without a sequence, sequences without a step."""
        self.pack()
        for place, (doc, start, ids, total) in enumerate(self._left()):
            self.rows.append((doc, start, len(ids) // 4, ids, total, None, place, None, None))
        self.rows += [(*row, None) for held in self.open.values() for sequence in held for row in sequence]
        self.open = {}

    def finish(self) -> None:
        """Cuts what is left into sequences of powers of two, longest first, and fills the last steps with
        the sequences of all sizes."""
        self.pack()
        rest = self._left()
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            parts, gap = [], size
            while gap:
                doc, start, ids, total = rest.pop()
                n = min(gap, len(ids) // 4)
                parts.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.append((doc, start + n, ids[4 * n :], total))
                gap -= n
            self._close(size, parts)
            left -= size
        last, held = [], 0
        for size in sorted(self.open, reverse=True):
            for sequence in self.open[size]:
                if held + size > self.step_tokens:
                    self._step(last)
                    last, held = [], 0
                last.append(sequence)
                held += size
        if last:
            self._step(last)
        self.open = {}

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_STREAMED = f"{SCHEMA}, stream long"
_ARROW = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _STREAMED.split(", ")])


def _batch(rows: list[tuple], stream: int) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True), [stream] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of each document, with its tokens and its place in a sequence."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(path), END_ID.to_bytes(4, "little")
        stream = TaskContext.get().partitionId()
        packer, held, given = Packer(stream, tiers, step_tokens), 0, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "")
                packer.add(key, ids + end)
                held += len(ids) // 4
                given += len(ids) // 4
                if held >= block_tokens:
                    packer.pack()
                    held = 0
                if given >= block_tokens and packer.rows:
                    yield _batch(packer.taken(), stream)
                    given = 0
        packer.leave()
        if packer.rows:
            yield _batch(packer.taken(), stream)

    def pooled(rows: pd.DataFrame) -> pd.DataFrame:
        # at most a step and a window of each size from each of POOLED tasks
        packer = Packer(POOLS + int(rows.stream.iloc[0]) // POOLED, tiers, step_tokens)
        rows = rows.sort_values(["stream", "sequence_id", "offset"], kind="stable")
        sequences: dict[int, list[tuple]] = {}
        for row in rows.itertuples(index=False):
            doc = None if pd.isna(row.doc_id) else int(row.doc_id)
            if pd.isna(row.sequence_id):
                packer._wait((doc, int(row.start), bytes(row.ids), int(row.doc_tokens)))
            else:
                key = int(row.sequence_id)
                sequences.setdefault(key, []).append((doc, int(row.start), int(row.length), bytes(row.ids), int(row.doc_tokens), key, int(row.offset), int(row.tier)))
        for sequence in sequences.values():
            packer.join(sequence[0][-1], sequence)
        packer.finish()
        out = pd.DataFrame(packer.taken(), columns=[x.split()[0] for x in SCHEMA.split(", ")])
        return out.astype({"doc_id": "Int64"})

    packed = materialize(docs.select("doc_id", "text").mapInArrow(tidy(work), _STREAMED), "packed")
    rest = packed.where("step_group is null").groupBy((F.col("stream") / POOLED).cast("long").alias("pool")).applyInPandas(pooled, SCHEMA)
    return packed.where("step_group is not null").drop("stream").unionByName(rest)


def pack_digests(packed: DataFrame) -> DataFrame:
    """The pieces with their tokens' checksum in place of the tokens."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
