"""Vector search: exact by matrix products, an inverted file over k-means cells, in memory or on
disk with 8-bit codes, and both in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.operators.best import CELLS, Best
from textloom.session import materialize

#: More queries than this go block by block instead of as one broadcast.
MAX_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _in_blocks(queries: DataFrame, key: str, vector: str, run: Callable[[list, np.ndarray], DataFrame]) -> DataFrame:
    """``run`` for the ids and the matrix of at most about MAX_QUERIES queries at a time, dealt by hash."""
    usable = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    blocks = max(1, -(-usable.count() // MAX_QUERIES))

    def part(i: int) -> DataFrame:
        few = usable.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) if blocks > 1 else usable
        rows = few.collect()  # MAX_QUERIES rows
        return run([r[0] for r in rows], np.array([r[1] for r in rows], np.float64))

    return reduce(DataFrame.union, [part(i) for i in range(blocks)])


def _chunks(batch: pa.RecordBatch, dim: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the dimension ``dim`` of a batch of key, vector and perhaps cell: places, keys and their matrix, as many
    at once as give a bounded matrix of scores for ``n`` queries and lie in one cell."""
    offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff(offsets) == dim)
    step, cuts = max(1, CELLS // max(n, dim)), [0, len(at)]
    if batch.num_columns > 2:
        cells = batch.column(2).to_numpy()
        at = at[np.argsort(cells[at], kind="stable")]
        cuts = [0, *(np.flatnonzero(np.diff(cells[at])) + 1), len(at)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        for i in range(start, end, step):
            rows = at[i : min(i + step, end)]
            yield rows, keys[rows], values[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)


def _without_own(scores: np.ndarray, keys: np.ndarray, own: dict) -> int:
    """A query is not its own neighbour; gives how many such pairs there were."""
    n = 0
    for column, key in enumerate(keys):
        for q in own.get(key, ()):
            scores[q, column] = -np.inf
            n += 1
    return n


def _in_order(queries: np.ndarray, rows: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Products summed dimension by dimension, as ``dot`` and SQL do; so that they round alike."""

    def scores(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for d in range(queries.shape[1]):
            out += queries[q, d] * rows[at, d]
        return out

    return scores


def _own(ids: list) -> dict:
    own: dict = {}
    for q, i in enumerate(ids):
        own.setdefault(i, []).append(q)
    return own


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A stated block of queries against all rows by products of matrices of bounded size; each task
    keeps k rows per query (ties of rounded scores included) before the shuffle. Query sets beyond
    MAX_QUERIES are split by hash and run block by block. A query is not its own neighbour; rows without a
    key, a vector or the queries' dimension are left out."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]

    def part(ids: list, matrix: np.ndarray) -> DataFrame:
        told = spark.sparkContext.broadcast((ids, matrix))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = told.value
            if not len(ids):
                return
            best, own, every = Best(len(ids), k), _own(ids), np.arange(len(ids))
            for batch in batches:
                for _, keys, rows in _chunks(batch, matrix.shape[1], len(ids)):
                    scores = matrix @ rows.T
                    _without_own(scores, keys, own)
                    best.add_matrix(scores, keys, every, _in_order(matrix, rows))
            if found := best.result():
                q, keys, score = found
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), pa.array(keys), pa.array(score)], ["query_id", key, "score"])

        usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
        scored = usable.mapInArrow(work, f"query_id {kind}, {key} {kind}, score double").withColumn("score", F.round("score", 6))
        return best_k(scored, k, key).withColumn("rank", F.col("rank").cast("long"))

    return _in_blocks(queries, key, vector, part)


def norm_audit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows, distinct keys, NaN and zero vectors, norms outside of (0.99, 1.01)."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return vectors.select(key, F.size(vector).cast("long").alias("dim"), norm.alias("norm"), F.exists(vector, F.isnan).alias("nan")).agg(
        F.count("*").alias("n"),
        F.countDistinct(key).alias("n_keys"),
        F.min("dim").alias("min_dim"),
        F.max("dim").alias("max_dim"),
        F.count_if(F.col("nan")).alias("n_nan"),
        F.count_if(F.col("norm") == 0).alias("n_zero"),
        F.count_if((F.col("norm") <= 0.99) | (F.col("norm") >= 1.01)).alias("n_off"),
    )


def inverted_file(vectors: DataFrame, nlist: int, seed: int = 42, sample: int = 300_000, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """V2, V3: (centroids, vectors with their cell). Trained on at most ``sample`` rows, all are assigned."""
    train = materialize(vectors.orderBy(F.xxhash64(key)).limit(sample).select(vector), "ivf-train")  # sorted once, not in each round
    train = train.select(array_to_vector(vector).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=10, predictionCol="cell").fit(train)
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cid int, centre array<double>")
    return centres, place(vectors, model, key, vector)


def best_k(scored: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def inverted_top_k(centres: DataFrame, placed: DataFrame, queries: DataFrame, k: int, nprobe: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """V4: each query looks into its nprobe nearest cells only; the first k of each."""
    return inverted_sweep(centres, placed, queries, k, (nprobe,), key, vector)[0].drop("nprobe")


def _probed(centres: list, matrix: np.ndarray) -> np.ndarray:
    """For each query the place of every cell (in the order of ``centres``) among its nearest, from 0."""
    c = np.array([r["centre"] for r in centres], np.float64)
    near = matrix @ c.T - (c * c).sum(axis=1) / 2
    order = np.lexsort((np.broadcast_to([r["cid"] for r in centres], near.shape), -near), axis=1)
    return np.argsort(order, axis=1)


def inverted_sweep(centres: DataFrame, placed: DataFrame, queries: DataFrame, k: int, nprobes: tuple[int, ...], key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """V4, V5 for several nprobe in one pass over the vectors: (nprobe, query_id, key, score, rank) of the first k,
    and (nprobe, seen), the pairs that were scored for them. Only k rows a query, nprobe and task are shuffled."""
    spark, kind = placed.sparkSession, dict(placed.dtypes)[key]
    cells = centres.collect()  # nlist rows
    number = {r["cid"]: i for i, r in enumerate(cells)}

    def part(ids: list, matrix: np.ndarray) -> DataFrame:
        told = spark.sparkContext.broadcast((ids, matrix, _probed(cells, matrix) if len(ids) else None))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, places = told.value
            if not len(ids):
                return
            own, seen = _own(ids), [0] * len(nprobes)
            bests = [Best(len(ids), k) for _ in nprobes]
            for batch in batches:
                cids = batch.column(2).to_numpy()
                for at, keys, rows in _chunks(batch, matrix.shape[1], len(ids)):
                    place = places[:, number[cids[at[0]]]]
                    scores = matrix @ rows.T
                    _without_own(scores, keys, own)
                    for i, nprobe in enumerate(nprobes):
                        q = np.flatnonzero(place < nprobe)
                        if len(q):
                            bests[i].add_matrix(scores[q], keys, q, _in_order(matrix, rows))
                            seen[i] += len(q) * len(keys) - sum(place[o] < nprobe for x in keys for o in own.get(x, ()))
            names = ["nprobe", "query_id", key, "score", "seen"]
            for nprobe, best, n in zip(nprobes, bests, seen, strict=True):
                q, keys, score = best.result() or ((), (), ())
                columns = [pa.array([nprobe] * len(q), pa.int32()), pa.array([ids[i] for i in q], KEYS), pa.array(list(keys), KEYS), pa.array(score, pa.float64()), pa.array([0] * len(q), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
                yield pa.RecordBatch.from_arrays([pa.array([nprobe], pa.int32()), pa.array([None], KEYS), pa.array([None], KEYS), pa.array([None], pa.float64()), pa.array([n], pa.int64())], names)

        KEYS = to_arrow_type(placed.schema[key].dataType)
        usable = placed.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector, "cid")
        return usable.mapInArrow(work, f"nprobe int, query_id {kind}, {key} {kind}, score double, seen long")

    found = materialize(_in_blocks(queries, key, vector, part), "ivf-found")
    w = Window.partitionBy("nprobe", "query_id").orderBy(F.desc("score"), key)
    hits = found.where("query_id is not null").withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.drop("seen"), found.groupBy("nprobe").agg(F.sum("seen").alias("seen"))


def place(vectors: DataFrame, model: KMeansModel, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """V3: every vector with the number of its cell, row by row, without a row for each pair."""
    return model.transform(vectors.withColumn("features", array_to_vector(vector))).select(key, vector, F.col("cell").alias("cid"))


LEVELS = 255


def bounds(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """V4: (pos, low, step) of every dimension: its least value and a 255th of its range. Each task gives one
    row a dimension, so that the exchange does not grow with the vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.array(batch.column(0).to_pylist(), np.float64)
            low = rows.min(axis=0) if low is None else np.minimum(low, rows.min(axis=0))
            high = rows.max(axis=0) if high is None else np.maximum(high, rows.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], ["pos", "low", "high"])

    ends = vectors.where(F.col(vector).isNotNull()).select(vector).mapInArrow(work, "pos int, low double, high double")
    return ends.groupBy("pos").agg(F.min("low").alias("low"), ((F.max("high") - F.min("low")) / LEVELS).alias("step"))


def write_cells(centres: DataFrame, placed: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """K7: the inverted file on disk: ``cells`` partitioned by cid with 8-bit codes, ``centres`` and
    ``bounds``. Rows are dealt by cell and large cells split, so that a hot one is no single task."""
    ends = bounds(placed, vector)
    ends.write.mode("overwrite").parquet(f"{path}/bounds")
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    rows = placed.sparkSession.read.parquet(f"{path}/bounds").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "step"))).alias("b"))  # one entry a dimension
    code = lambda x, b: F.when(b.step > 0, F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.round((x - b.low) / b.step)))).otherwise(0).cast("short")
    coded = placed.where(F.col(vector).isNotNull()).join(F.broadcast(rows)).select(key, F.zip_with(vector, "b", code).alias("codes"), "cid")
    coded.hint("rebalance", "cid").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/cells")


def search_cells(spark: SparkSession, path: str, queries: DataFrame, nprobe: int, key: str = "vec_id", vector: str = "embedding", depth: int | None = None) -> DataFrame:
    """V4 on disk: (query_id, key, score) of the nprobe cells nearest to each query, of which alone the
    files are read; with ``depth`` no more than may be among a query's first so many. A vector's value is low +
    code * step, so a query is scaled once instead of each row."""
    cells = spark.read.parquet(f"{path}/centres").collect()  # nlist rows
    ends = sorted(spark.read.parquet(f"{path}/bounds").collect())  # a row a dimension
    low, step = (np.array([r[i] for r in ends], np.float64) for i in (1, 2))
    stored = spark.read.parquet(f"{path}/cells")
    number, kind = {r["cid"]: i for i, r in enumerate(cells)}, dict(queries.dtypes)[key]

    def part(ids: list, matrix: np.ndarray) -> DataFrame:
        places = _probed(cells, matrix) if len(ids) else np.zeros((0, len(cells)), int)
        told = spark.sparkContext.broadcast((ids, matrix @ low, matrix * step, places) if len(ids) else ([], None, None, None))
        probed = [c for c, i in number.items() if (places[:, i] < nprobe).any()]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, base, scaled, places = told.value
            best, own = Best(len(ids), depth) if depth else None, _own(ids)
            pack = lambda q, keys, score: pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), pa.array(keys), pa.array(score)], ["query_id", key, "score"])
            for batch in batches:
                cids = batch.column(2).to_numpy()
                for at, keys, rows in _chunks(batch, scaled.shape[1], len(ids)):
                    q = np.flatnonzero(places[:, number[cids[at[0]]]] < nprobe)
                    scores = base[:, None] + scaled @ rows.T
                    _without_own(scores, keys, own)
                    if best:
                        best.add_matrix(scores[q], keys, q)
                        continue
                    row, col = np.nonzero(scores[q] > -np.inf)
                    if len(row):
                        yield pack(q[row], keys[col], scores[q[row], col])
            if best and (found := best.result()):
                yield pack(*found)

        return stored.where(F.col("cid").isin(probed)).select(key, "codes", "cid").mapInArrow(work, f"query_id {kind}, {key} {kind}, score double")

    return _in_blocks(queries, key, vector, part)


def two_stage_top_k(spark: SparkSession, path: str, vectors: DataFrame, queries: DataFrame, k: int, nprobe: int, depth: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """V6: the best ``depth`` by codes are scored again by their vectors, of which k stay. A neighbour
    outside of the nprobe cells, or beyond ``depth`` by its codes, is missed."""
    near = best_k(search_cells(spark, path, queries, nprobe, key, vector, depth), depth, key).select("query_id", key)
    few = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("query_vector"))
    full = near.join(vectors.select(key, vector), key).join(few, "query_id")
    exact = full.select("query_id", key, F.round(dot(F.col(vector), F.col("query_vector")), 6).alias("score"))
    return best_k(exact, k, key).withColumn("rank", F.col("rank").cast("long"))
