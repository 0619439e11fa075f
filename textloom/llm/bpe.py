"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that its encoding can end with: the token t that
fills the prefix's last len(t) bytes and forms a valid pair with the last token of what stands before
(a pair is valid if the two tokens' joined bytes encode to just these two). Keeping that token for each
prefix gives the encoding by walking back from the end; appending bytes only adds entries, and an edit
only redoes entries from the edit until they agree with the old ones again.

A null text counts as empty: no tokens, the digests of no bytes. Repeated rows give repeated rows, an
empty table an empty result; other columns are ignored. Texts of any length take time in proportion.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces, and words with the space before them, kept with their ids in a worker; beyond this the rest
#: are encoded each time. The frequent ones come early.
CACHE_PIECES = 800_000
CACHE_WORDS = 500_000
TWO_SPACES = re.compile(r"\s\s").search


class Vocabulary:
    """Ranks of a byte-level vocabulary, with which pairs of tokens are valid (worked out when first asked)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        #: Every tail of a token, with the token that it is itself, or -1.
        self.tails = {t[i:]: ranks.get(t[i:], -1) for t in ranks for i in range(len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The defining procedure: join the adjacent pair of lowest rank, leftmost first, until none is left
        or ``least`` parts are."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose joining makes ``token``; (token, token) for a single byte; (-1, -1) if
        the token's own bytes encode to something else, so that it never occurs."""
        found = self.splits.get(token)
        if found is None:
            data = self.bytes_of[token]
            parts = self.merged(data, least=2)
            if len(data) == 1:
                found = (token, token)
            elif len(parts) == 2 and self.merged(data) == [token]:
                found = (parts[0], parts[1])
            else:
                found = (-1, -1)
            self.splits[token] = found
        return found

    def valid(self, left: int, right: int) -> bool:
        """Undoes the joins nearest the seam in the order in which they were made last; the pair is valid
        if no join across the seam would have come before one that was undone."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = self._valid(left, right)
        return found

    def _valid(self, a: int, b: int) -> bool:
        limit, ranks, names = 1 << 60, self.ranks, self.bytes_of
        while True:
            if ranks.get(names[a] + names[b], 1 << 60) < limit:
                return False
            x, y = self.split(a), self.split(b)
            if a > b and x[0] != a or y[0] == b:
                if x[0] == a:
                    return True
                limit, a = a, x[1]
            else:
                limit, b = b + 1, y[0]


class PrefixEncoder:
    """The last token of each prefix of a growing or edited piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, data, []
        self._extend()

    def _last_token(self, end: int) -> int:
        """Walks back from ``end`` as long as what was passed ends some token; of the tokens met, the
        longest first, exactly one fits the entry before it."""
        v, data, last = self.vocabulary, self.data, self.last
        tails, fits, start = v.tails, [], end - 1
        while start >= 0:
            token = tails.get(data[start:end])
            if token is None:
                break
            if token >= 0:
                fits.append((start, token))
            start -= 1
        for start, token in reversed(fits):
            if v.split(token)[0] >= 0 and (not start or v.valid(last[start - 1], token)):
                return token
        raise ValueError("a byte is missing from the vocabulary")

    def _extend(self) -> None:
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._last_token(end))

    def append(self, more: bytes) -> PrefixEncoder:
        self.data += more
        self._extend()
        return self

    def replace(self, start: int, end: int, by: bytes) -> PrefixEncoder:
        """Puts ``by`` in place of data[start:end]. The entries behind are redone only until as many in a
        row as the longest token has bytes equal the old ones: from there on each depends on equals only."""
        old, old_last = self.data, self.last
        self.data = old[:start] + by + old[end:]
        self.last, shift, same = old_last[:start], len(by) - (end - start), 0
        for stop in range(start + 1, len(self.data) + 1):
            self.last.append(self._last_token(stop))
            past = stop - shift - 1
            same = same + 1 if stop > start + len(by) and old_last[past] == self.last[-1] else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[past + 1 :]
                break
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Codec:
    """Encodes whole texts: each match of the pattern on its own, known pieces from a bounded cache."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, str, bytes]] = {}

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        if token is not None and self.vocabulary.split(token)[0] >= 0:
            return (token,)
        return tuple(PrefixEncoder(self.vocabulary, data).ids())

    def encode(self, text: str) -> list[int]:
        out, known = [], self.known
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._encode_piece(piece)
                if len(known) < CACHE_PIECES and len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out

    def _word(self, word: str) -> tuple[int, str, bytes]:
        ids = self.encode(word)
        found = len(ids), ",".join(map(str, ids)), self.decode(ids)
        if len(word) <= 64 and len(self.words) < CACHE_WORDS:
            self.words[word] = found
        return found

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded ids. No piece goes on over a single
        space, so where no two white-space characters meet each word with the space before it is taken
        from a bounded cache."""
        if not text:
            words = []
        elif TWO_SPACES(text):
            words = [text]
        else:
            first, *words = text.split(" ")
            words = [first, *map(" ".__add__, words)] if first else list(map(" ".__add__, words))
        known, get = self.words, self._word
        found = [known.get(w) or get(w) for w in words]
        n, digits, data = zip(*found, strict=True) if found else ((), (), ())
        return sum(n), hashlib.sha256(",".join(digits).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(Vocabulary.load(path), pattern)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns digests of both. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            rows = [coder.round_trip(text.as_py() or "") for text in batch.column(1)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)
