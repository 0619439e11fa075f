"""N-gram Jaccard join: exact, over distinct 5-word shingles.

1. Every whole text becomes a set of 64-bit shingle hashes; equal sets share one id, so that copies cost
   one document. The same pass counts shingles that several documents of a chunk share.
2. Prefix filter: two sets that link share e of each other's first n - ceil(t n) + e shingles in any
   fixed order. The order puts widely shared shingles last, so that passages common to many documents
   bring nothing together, and long ones first, as what is short meets by chance. Any order gives exact
   results; the counts and lengths only decide how much work is left.
   Sets that share a prefix shingle are joined to one set of the shingle's group (a star, not all pairs).
   Of the widely shared shingles that set is known to every task beforehand, so that none of them gathers
   its holders anywhere; of the others it is the smallest id. Each set then leaves its weakest stars, as
   long as the shingles that it shares in those stay below e / 2 in all: of the e shingles that linked sets
   share, some lie in a star that neither has left. Components of the stars that remain hold every possible
   link, and what shares but a passage falls apart.
   Chance grows with the table, though, and hangs ever more sets together. So the sets of large components
   are hung on stars once more, by all their shingles: linked ones share three quarters of the larger, and
   each leaves its weakest stars below half of that.
3. Small components are compared whole. In a large one, every set is first compared with the one whose
   prefix is shared most, in a join whose hot side is dealt over many keys; what links to it is one group.
   Only sets of different groups are left to compare. The component is cut into tiles by size band (sizes
   of one band differ by a third at most, so links lie within a band or between neighbours) and bounded by
   shingles; large groups have tiles of their own, which are not compared with each other. Within a pair of
   tiles, hashed bitmap signatures bound the overlap from above: |A & B| <= (|A| + |B| - popcount(a ^ b)) / 2.
   Pairs that may still link and are not connected yet are intersected exactly as sorted arrays.
4. Components of the links give every document its class.

Shingles, sets and texts are told apart by 64-bit hashes, so "exact" is up to a collision of these.

Nulls: a null or blank text has an empty set and is linked with nothing; a null doc_id has no id to give
its class but follows the class of its set. Rows that repeat a doc_id with other texts count as one
document whose rows are linked. Texts with fewer than five words are one shingle, the whole sequence. An
empty table gives an empty result; other columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.memory import tidy
from textloom.session import materialize, scratch

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The prefix is longer by this share of a set than one common shingle asks for; linked sets then share so
#: many prefix shingles, and stars that hold a few only can be dropped.
EXTRA_PERCENT = 6
#: Shingles of so many documents in all (counted where a chunk holds two) come last in the order; the
#: most frequent MAX_COMMON of them at most, which bounds what is broadcast.
COMMON = 16
MAX_COMMON = 400_000
CHUNK_SHINGLES = 3_000_000
#: Shingles of a tile, and of the small components that one group of rows gathers; a component with more
#: than SMALL_SHINGLES is a large one and is cut into at least LEAST_TILES parts.
TILE_SHINGLES, SMALL_SHINGLES, LEAST_TILES = 1_500_000, 50_000, 8
#: Sets of a large component that one key of the first comparison holds.
STAR_SETS = 200
CACHE_WORDS = 400_000
#: Bytes of words beyond which shingles count as equally long.
LONGEST = (1 << 16) - 1
EMPTY = np.empty(0, np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self.words) < CACHE_WORDS and len(word) <= 64:
            self.words[word] = found
        return found

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known, word_of = self.words, self._word
        h = np.array([known.get(w) or word_of(w) for w in words], np.uint64)
        n = max(1, len(h) - SHINGLE + 1)
        if len(h) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words))], np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            out = (out ^ h[i : i + n]) * _M
            out ^= out >> np.uint64(29)
        return out

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = _words(text)
        return np.unique(self._hashes(words)) if words else EMPTY

    def set_and_lengths(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The same, and the bytes of each shingle's words, LONGEST at most."""
        words = _words(text)
        if not words:
            return EMPTY, np.empty(0, np.int64)
        found, first = np.unique(self._hashes(words), return_index=True)
        ends = np.cumsum([0, *map(len, words)])
        return found, np.minimum(ends[np.minimum(first + SHINGLE, len(words))] - ends[first], LONGEST)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z only, ASCII white space only


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a set; 0 only for the empty one."""
    if not len(hashes):
        return 0
    x = xxhash.xxh3_64_intdigest(hashes.tobytes()) or 1
    return x - (1 << 64) if x >= 1 << 63 else x


def shared_at_least(n: int) -> int:
    """Prefix shingles that two linked sets share at least, the smaller of n shingles."""
    return max(1, n * EXTRA_PERCENT // 100)


def prefix_length(n: int) -> int:
    return min(n, n - -(-PERCENT * n // 100) + shared_at_least(n))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def band(n: int) -> int:
    return int(math.log(n) / math.log(100 / PERCENT) + 1e-9) if n else 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


_SETS = "kind int, doc_id long, n long, sid long, other long"


def document_sets(hashed: DataFrame) -> DataFrame:
    """Of doc_id, text and text_hash. Rows of kind 0: doc_id, n, sid and the text's hash. Rows of kind 1: a
    shingle (sid) with n, the different sets of one chunk of a task that share it, two or more, and one of
    these sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, sids, seen, total = Shingler(), [], [], set(), 0

        def rows(kind: int, doc_id: pa.Array, n: pa.Array, sid: pa.Array, other: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), doc_id, n, sid, other], ["kind", "doc_id", "n", "sid", "other"])

        def common() -> pa.RecordBatch:
            x, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            holder = np.repeat(np.array(sids, np.int64), [len(h) for h in held])[first[n > 1]]
            x, n = x[n > 1], n[n > 1]
            return rows(1, pa.nulls(len(x), pa.int64()), pa.array(n.astype(np.int64)), _signed(x), pa.array(holder))

        for batch in batches:
            sizes, ids = [], []
            for text in batch.column(1):
                found = shingler.set_of(text.as_py())
                sizes.append(len(found))
                ids.append(set_id(found))
                if len(found) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(found)
                    sids.append(ids[-1])
                    total += len(found)
                    if total >= CHUNK_SHINGLES:
                        yield common()
                        held, sids, seen, total = [], [], set(), 0
            yield rows(0, batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), batch.column(2))
        if held:
            yield common()

    return hashed.select("doc_id", "text", "text_hash").mapInArrow(tidy(work), _SETS)


def prefixes(docs: DataFrame, common: np.ndarray, counts: np.ndarray, centres: np.ndarray) -> DataFrame:
    """Rows (h, sid, m, w) for each different set: its prefix shingles h (m and w are 0), and for its widely
    shared ones the number w of those whose star has the centre m (h is 0). ``common``: sorted hashes that
    come last in the order, by their counts, with the centres of their stars."""
    told = docs.sparkSession.sparkContext.broadcast((common, counts, centres))  # MAX_COMMON of each at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts, centres = told.value
        shingler, seen, parts, held = Shingler(), set(), [], 0

        def rows() -> pa.RecordBatch:
            h, sid, m, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([_signed(h), pa.array(sid), pa.array(m), pa.array(w)], ["h", "sid", "m", "w"])

        for batch in batches:
            for text in batch.column(0):
                found, lengths = shingler.set_and_lengths(text.as_py())
                sid = set_id(found)
                if not sid or sid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                k = prefix_length(len(found))
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    rank = np.where(common[at] == found, counts[at], 0)
                    order = np.argsort(rank * (LONGEST + 1) - lengths, kind="stable")[:k]
                    wide = at[order][rank[order] > 0]
                    found = found[order][rank[order] == 0]
                    if len(wide):
                        m, w = np.unique(centres[wide], return_counts=True)
                        parts.append((np.zeros(len(m), np.uint64), np.full(len(m), sid, np.int64), m, w.astype(np.int64)))
                        held += len(m)
                else:
                    found = found[np.argsort(-lengths, kind="stable")[:k]]
                none = np.zeros(len(found), np.int64)
                parts.append((found, np.full(len(found), sid, np.int64), none, none))
                held += len(found)
                if held >= 200_000:
                    yield rows()
                    parts, held = [], 0
        if parts:
            yield rows()

    return docs.select("text").mapInArrow(tidy(work), "h long, sid long, m long, w long")


def stars(shared: DataFrame) -> DataFrame:
    """(sid, m, w): how many prefix shingles a set shares in the star around m. One exchange, dealt by the
    shingle or, where the centre is known, by set and centre; copies of a set give equal rows."""
    key = F.when(F.col("w") > 0, F.xxhash64("sid", "m")).otherwise(F.col("h"))
    dealt = shared.withColumns({"key": key, "told": F.col("w") > 0}).repartition(F.col("key")).dropDuplicates(["key", "told", "sid", "m", "w"])
    least = F.min("sid").over(Window.partitionBy("key", "told"))
    dealt = dealt.withColumn("m", F.when(F.col("told"), F.col("m")).otherwise(least)).where("sid <> m")
    return dealt.groupBy("sid", "m").agg(F.sum(F.greatest(F.col("w"), F.lit(1))).alias("w"))


def _kept(joined: DataFrame, sizes: DataFrame, least: Column) -> DataFrame:
    """Edges (a, b) of the stars that sets do not leave. ``sizes``: sid and n; ``least``: of n, what linked
    sets share in stars at least."""
    weakest = Window.partitionBy("sid").orderBy("w", "m")
    left = joined.join(sizes.select("sid", "n"), "sid").withColumn("upto", F.sum("w").over(weakest))
    return left.where(2 * F.col("upto") >= least).select(F.col("sid").alias("a"), F.col("m").alias("b"))


def _refined(large: DataFrame) -> DataFrame:
    """(sid, comp): components of the sets of ``large`` (sid, n, text) by all of their shingles. Sets that
    have no row are linked with nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                sids, found = batch.column(0)[low : low + 200].to_numpy(), [shingler.set_of(t.as_py()) for t in batch.column(1)[low : low + 200]]
                h = np.concatenate(found)
                none = pa.array(np.zeros(len(h), np.int64))
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(np.repeat(sids, [len(x) for x in found])), none, none], ["h", "sid", "m", "w"])

    whole = large.select("sid", "text").mapInArrow(tidy(work), "h long, sid long, m long, w long")
    joined = materialize(stars(whole), "jaccard-whole-stars")
    edges = _kept(joined, large, F.floor((F.col("n") * PERCENT + 99) / 100))
    return components(edges).select(F.col("node").alias("sid"), F.col("root").alias("comp"))


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits), bool)
    mask = np.uint64(bits - 1)
    for row, s in zip(out, sets, strict=True):
        row[(s >> np.uint64(20)) & mask] = True
    return np.packbits(out, axis=1).view(np.uint64)


def links_within(sets: list[np.ndarray], labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked at all: a spanning forest of the link graph of these sets. Sets of
    one label are connected already; where ``sides`` are given, only sets of different sides are compared."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    labels = None if labels is None else labels[order]
    sides = None if sides is None else sides[order]
    forest, found, bands = _Forest(len(order)), [], [band(int(n)) for n in sizes]
    start = 0
    while start < len(order):
        end, reach = start, start
        while end < len(order) and bands[end] == bands[start]:
            end += 1
        reach = end
        while reach < len(order) and bands[reach] <= bands[start] + 1:
            reach += 1
        bits = max(64, 1 << int(2 * sizes[reach - 1]).bit_length())
        step = max(1, 64_000_000 // bits)  # rows of bitmaps held at once
        for low in range(start, reach, step):
            part = range(low, min(reach, low + step))
            maps = _bitmaps([sets[order[j]] for j in part], bits)
            for i in range(start, min(end, part[-1] + 1)):
                first = max(low, i + 1)
                most = 100 * sizes[i] // PERCENT
                last = int(np.searchsorted(sizes[: part[-1] + 1], most, "right"))
                if first >= last:
                    continue
                others = np.arange(first, last)
                if labels is not None:
                    others = others[labels[first:last] != labels[i]]
                if sides is not None:
                    others = others[sides[others] != sides[i]]
                if not len(others):
                    continue
                own = maps[i - low] if i >= low else _bitmaps([sets[order[i]]], bits)[0]
                apart = np.bitwise_count(maps[others - low] ^ own).sum(axis=1)
                both = sizes[i] + sizes[others]
                overlap = (both - apart) // 2
                for j in others[np.flatnonzero(100 * overlap >= PERCENT * (both - overlap))]:
                    a, b = forest.root(i), forest.root(int(j))
                    if a != b and linked(sets[order[i]], sets[order[j]]):
                        forest.join(a, b)
                        found.append((order[i], order[int(j)]))
        start = end
    return found


def _small_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within each of the components of a bucket."""
    shingler, out = Shingler(), []
    for _, part in rows.groupby("comp", sort=False):
        reps = part.rep.tolist()
        out += [(reps[i], reps[j]) for i, j in links_within([shingler.set_of(t) for t in part.text])]
    return pd.DataFrame(out, columns=["a", "b"])


def _tile_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the sets of two tiles, or within a tile that is paired with itself."""
    shingler, reps = Shingler(), rows.rep.tolist()
    tiles = rows.tile.to_numpy()
    sides = pd.factorize(tiles)[0] if rows.pair.iloc[0] != "own" else None
    found = links_within([shingler.set_of(t) for t in rows.text], rows.label.to_numpy(), sides)
    return pd.DataFrame([(reps[i], reps[j]) for i, j in found], columns=["a", "b"])


def _star_links(large: DataFrame, strength: DataFrame) -> DataFrame:
    """Links of each set of a large component with the component's centre, the set that shares the largest
    part of its prefix. The centre's text is repeated for every STAR_SETS sets, under a key of its own."""
    weighed = large.join(strength, "sid").select("comp", "sid", (F.col("shared") / F.col("n")).alias("share"))
    centres = weighed.groupBy("comp").agg(F.max_by("sid", F.struct("share", "sid")).alias("centre"), F.ceil(F.count("*") / STAR_SETS).cast("int").alias("fan"))
    told = large.join(centres, "comp").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("fan")).cast("int"))
    middle = large.join(centres.withColumnRenamed("centre", "sid"), ["comp", "sid"]).select(
        "comp", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.col("rep").alias("b"), F.col("text").alias("other")
    )
    both = told.where("sid <> centre").select("comp", "salt", F.col("rep").alias("a"), "text").join(middle, ["comp", "salt"]).select("a", "b", "text", "other")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, centre = Shingler(), None, EMPTY
        for batch in batches:
            a, b = [], []
            for x, y, text, other in zip(*batch.columns, strict=True):
                if y != last:
                    last, centre = y, shingler.set_of(other.as_py())
                if linked(shingler.set_of(text.as_py()), centre):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialize(both.mapInArrow(tidy(work), "a long, b long"), "jaccard-star-links")


def _tile_units(large: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each pair of tiles that has to look at a set. ``labels``: rep and the group that it is
    known to belong to."""
    log = F.floor(F.log("n") / math.log(100 / PERCENT) + 1e-9).cast("int")
    rows = large.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root").withColumn("band", log)
    mixed = rows.groupBy("comp").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.sum("n").alias("total")).where("l1 <> l2").select("comp", "total")
    weights = rows.join(mixed, "comp").groupBy("comp", "total", "band", "label").agg(F.sum("n").alias("weight"))
    most = F.least(F.lit(TILE_SHINGLES), F.ceil(F.col("total") / LEAST_TILES))
    sized = weights.withColumn("tag", F.when(F.col("weight") >= most, F.col("label").cast("string")).otherwise("*"))
    counts = sized.groupBy("comp", "total", "band", "tag").agg(F.ceil(F.sum("weight") / F.first(most)).cast("int").alias("tiles"))
    tagged = rows.join(sized.select("comp", "band", "label", "tag"), ["comp", "band", "label"]).join(counts.drop("total"), ["comp", "band", "tag"])
    tagged = tagged.withColumn("tile", F.concat_ws(":", "band", "tag", F.pmod(F.xxhash64("sid"), F.col("tiles"))))
    tiles = counts.select("comp", "band", "tag", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k"))
    tiles = tiles.select("comp", "band", "tag", F.concat_ws(":", "band", "tag", "k").alias("tile"))
    # a component's tiles, not its sets, are paired
    x, y = tiles.alias("x"), tiles.alias("y")
    near = (F.col("x.comp") == F.col("y.comp")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1)
    pairs = x.join(y, near).where("x.tag <> y.tag or x.tag = '*'").select(
        F.col("x.comp").alias("comp"),
        F.col("x.tile").alias("tile"),
        F.when(F.col("x.tile") == F.col("y.tile"), "own").otherwise(F.concat_ws("|", F.least("x.tile", "y.tile"), F.greatest("x.tile", "y.tile"))).alias("pair"),
    )
    unit = F.when(F.col("pair") == "own", F.concat_ws("|", F.lit("own"), "tile")).otherwise(F.col("pair"))
    return tagged.join(pairs, ["comp", "tile"]).select("comp", unit.alias("unit"), F.when(F.col("pair") == "own", "own").otherwise("two").alias("pair"), "tile", "label", "rep", "text")


def _links(docs: DataFrame, comps: DataFrame, reps: DataFrame, strength: DataFrame, keep: list[str]) -> DataFrame:
    """Links between representatives that connect all that is linked."""
    members = comps.join(reps.where("rep is not null"), "sid")
    sizes = members.groupBy("comp").agg(F.sum("n").alias("total"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text_hash", "text")
    # rows of one doc_id and text are one set
    held = materialize(members.join(sizes, "comp").join(texts, ["rep", "text_hash"]).dropDuplicates(["sid"]), "jaccard-members")
    if not held.where(F.col("total") > SMALL_SHINGLES).isEmpty():
        large = held.where(F.col("total") > SMALL_SHINGLES).drop("comp", "total")
        fine = _refined(large).join(large, "sid")
        fine = fine.join(fine.groupBy("comp").agg(F.sum("n").alias("total")), "comp")
        held = held.where(F.col("total") <= SMALL_SHINGLES).unionByName(materialize(fine, "jaccard-refined"))
    small = held.where(F.col("total") <= SMALL_SHINGLES)
    sums = held.agg(F.sum(F.when(F.col("total") <= SMALL_SHINGLES, F.col("n"))).alias("small"), F.max("total").alias("most")).first()
    buckets = max(1, -(-int(sums.small or 0) // TILE_SHINGLES)) * 2
    bucket = F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket")
    links = small.select("comp", "rep", "text", bucket).groupBy("bucket").applyInPandas(_small_links, "a long, b long")
    if (sums.most or 0) > SMALL_SHINGLES:
        large = held.where(F.col("total") > SMALL_SHINGLES).drop("total")
        found = _star_links(large, strength)
        units = _tile_units(large, components(found))
        links = links.union(found).union(units.groupBy("comp", "unit").applyInPandas(_tile_links, "a long, b long"))
    return materialize(links, "jaccard-links", keep)


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    both = materialize(document_sets(docs), "jaccard-sets")
    sets = both.where("kind = 0").select("doc_id", "n", "sid", F.col("other").alias("text_hash"))
    counted = both.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n"), F.min("other").alias("m")).where(F.col("n") >= COMMON)
    top = counted.orderBy(F.desc("n"), "sid").limit(MAX_COMMON).toPandas()
    common = top.sid.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    # equal sets have one id; its smallest document stands for it
    first = F.min(F.struct("doc_id", "text_hash"))
    known = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), first.alias("x"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("y"), F.first("n").alias("n"))
    reps = materialize(known.select("sid", "rep", "n", F.coalesce("y.text_hash", "x.text_hash").alias("text_hash")), "jaccard-reps")
    smaller = F.floor((F.col("n") * PERCENT + 99) / 100)  # the least size of a linked set
    least = F.greatest(F.lit(1), F.floor(smaller * EXTRA_PERCENT / 100))
    with scratch(docs.sparkSession) as keep:
        joined = materialize(stars(prefixes(docs, common[order], top.n.to_numpy(np.int64)[order], top.m.to_numpy(np.int64)[order])), "jaccard-stars")
        comps = components(_kept(joined, reps, least)).select(F.col("node").alias("sid"), F.col("root").alias("comp"))
        strength = joined.groupBy("sid").agg(F.sum("w").alias("shared")).union(joined.select("m").distinct().select("m", F.lit(0).cast("long")))
        links = _links(docs, comps, reps, strength.groupBy("sid").agg(F.max("shared").alias("shared")), keep)
    # rows of one doc_id with different sets are one document
    repeated = sets.where("n > 0 and doc_id is not null").join(reps.select("sid", "rep"), "sid").where("doc_id <> rep")
    other = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("sid").alias("s1"), F.max("sid").alias("s2")).where("s1 <> s2").select("doc_id")
    repeated = repeated.join(other, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = components(links.union(repeated)).select(F.col("node").alias("rep"), "root")
    roots = reps.join(classes, "rep", "left").select("sid", F.coalesce("root", "rep").alias("root"))
    return sets.join(roots, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class with all its columns: the one of smallest doc_id. Where rows repeat that
    id, one row of each text stays (of rows that differ elsewhere, the one of least hash); rows without a
    doc_id stay, as no class can be named after them."""
    keepers = jaccard_classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    held = docs.where("doc_id is not null").select(F.struct("*").alias("row"))  # no column of the caller's meets one of ours
    kept = held.join(keepers, F.col("row.doc_id") == F.col("doc_id"), "left_semi")
    one = kept.groupBy("row.doc_id", F.xxhash64("row.text").alias("text_hash")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").union(docs.where("doc_id is null"))
