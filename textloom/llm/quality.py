"""Quality rules by robust multivariate outliers, in SQL functions only.

Each text gives counts of words, word characters, signs, repeated lines and words in repeated 3-word
windows. Transformed to four statistics they are held against minimum covariance determinant estimates of
their language and source. An estimate starts from several places (medians with median deviations, plain
mean and covariance, and small subsets drawn by hash); from each, the h rows of smallest Mahalanobis
distance give a new mean and covariance, several times over (concentration steps, which never raise the
determinant); the start of least determinant wins, and all rows near it give the final, reweighted
estimate. Covariances are scaled to be consistent for normal rows. Determinants and distances are of the
covariance plus ``TOLERANCE`` squared on its diagonal, so that they exist for groups of any size.

Every language and source has an estimate, however few its rows: it is mixed with its language's, and that
with the one of all rows, by weights n and ``PRIOR``, so that nothing is switched by size. A row whose
distance exceeds the cut is rejected, as is one that fails the fixed rules. Every step aggregates with
map-side partials; estimates are small rows, a few for each group, and join back on a salted key, so that
a source with a third of all rows is spread over all tasks.

Nulls: a null text has no words and fails the fixed rule; a null language or source is a group of its own.
Repeated rows count each, an empty table gives an empty result, long texts are taken whole, other columns
are ignored. A group without a row that passes the fixed rules has its language's estimate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize

#: Fixed values of the base rules.
WHITE = r"[\x20\x09-\x0D]"
SIGNS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STATS = ("z_words", "z_length", "z_signs", "z_repeats")
#: Share of a group that the estimate rests on, and steps with all starts and with the two best.
KEEP_SHARE = 0.75
FIRST_STEPS, MORE_STEPS = 2, 3
DRAWN_STARTS, DRAWN_ROWS = 3, 20
#: Shares of normal rows within the distances of the reweighting and of the cut.
NEAR_SHARE, CUT_SHARE = 0.975, 0.99999
#: Rows that a group's language (a language's corpus) counts for beside its own.
PRIOR = 50
#: Differences of each statistic that are no fault of a text: by 65 % in words, 0.3 letters a word, signs of
#: 0.25 % and repeats of 1.4 %. Set by what they mean, not fitted; joined to every variance.
TOLERANCE = (0.5, 0.3, 0.05, 0.12)
SALTS = 16


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(share: float, degrees: int = len(STATS)) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-12 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < share else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows has to be multiplied with."""
    return share / chi_square(chi_square_quantile(share), len(STATS) + 2)


NEAR, CUT = chi_square_quantile(NEAR_SHARE), chi_square_quantile(CUT_SHARE)


def words_of(text: Column) -> Column:
    """Words as an array: what stands between white space, none for a blank text."""
    trimmed = F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{WHITE}+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Where no two windows' hashes are equal there
    is none; else the windows themselves are sorted with their places, in time n log n, and those with an
    equal neighbour are repeated ones. The gaps between these add up to the words covered."""
    places = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def window(i: Column) -> Column:
        # words hold no space, so that the joined words tell windows apart
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))

    def covered(windows: Column) -> Column:
        def repeats(x: Column, j: Column) -> Column:
            behind, ahead = F.get(windows, j - 1), F.get(windows, j + 1)
            return F.coalesce(behind.w == x.w, F.lit(False)) | F.coalesce(ahead.w == x.w, F.lit(False))

        starts = F.sort_array(F.transform(F.filter(windows, repeats), lambda x: x.i))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
            lambda s, i: F.struct((s.n + i + 3 - F.greatest(i, s.end)).alias("n"), (i + 3).alias("end")),
            lambda s: s.n,
        )

    # transform over a one-element array holds the sorted windows for the lambdas below
    found = F.transform(F.array(F.sort_array(F.transform(places, window))), covered)[0]
    unique = F.size(F.array_distinct(hashes)) == F.size(words) - 2
    return F.when(F.size(words) < 4, F.lit(0)).when(unique, F.lit(0)).otherwise(found)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; adds nothing else."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), text.alias("text")).select(
        "doc_id", "lang", "source", "text_hash", "text", words_of(F.col("text")).alias("words")
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return counted.select(
        "doc_id",
        "lang",
        "source",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(WHITE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SIGNS)).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") == 0, F.lit(0)).otherwise(F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def with_base(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted_stats(counts.withColumn("base_failed", failed))


def counted_stats(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "z_words": F.log1p(F.col("n_words").cast("double")),
            "z_length": F.col("word_chars") / n,
            "z_signs": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "z_repeats": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = [*[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS]]
FACTORS = [*[f"m{i}" for i in range(P)], *[f"d{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS if i > j]]


def _moments(rows: DataFrame, chosen: Column, scale: Column, *by: str) -> DataFrame:
    """Mean and scaled covariance of the chosen rows of each group, and their number; groups without any
    are left out."""
    few = rows.where(chosen)
    sums = [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)]
    products = [F.avg(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    est = few.groupBy(*by).agg(*sums, *products, F.count("*").alias("n"))
    cov = [((F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale).alias(f"c{i}{j}") for i, j in PAIRS]
    return est.select(*by, "n", *[f"m{i}" for i in range(P)], *cov)


def _factored(est: DataFrame) -> DataFrame:
    """The covariance with its tolerances as the factors of L D L', and the determinant's logarithm."""
    for j in range(P):
        d = F.col(f"c{j}{j}") + TOLERANCE[j] ** 2 - sum((F.col(f"l{j}{k}") ** 2 * F.col(f"d{k}") for k in range(j)), F.lit(0.0))
        est = est.withColumn(f"d{j}", F.greatest(d, F.lit(TOLERANCE[j] ** 2 / 2)))
        for i in range(j + 1, P):
            x = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}") for k in range(j)), F.lit(0.0))
            est = est.withColumn(f"l{i}{j}", x / F.col(f"d{j}"))
    return est.withColumn("log_det", sum((F.log(f"d{i}") for i in range(P)), F.lit(0.0)))


def _joined(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Rows with the estimates of their group. Each is repeated for every salt, so that no key of the join
    holds more than a small part of a large group, whichever way the join is run."""
    return rows.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["group", "salt"])


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i in range(P):
        back = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", F.col(STATS[i]) - F.col(f"m{i}") - back)
    return rows.withColumn("d2", sum((F.col(f"y{i}") ** 2 / F.col(f"d{i}") for i in range(P)), F.lit(0.0)))


def group_names(lang: Column, source: Column) -> list[Column]:
    """Names of a row's groups: all rows, the language, language and source. Lengths keep them apart."""
    told = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("null"))
    return [F.lit("all"), F.concat(F.lit("lang "), told(lang)), F.concat(F.lit("both "), told(lang), F.lit(" "), told(source))]


def _starts(parts: DataFrame) -> DataFrame:
    """group, start and the factors of each start's estimate."""
    sizes = parts.groupBy("group").agg(
        F.count("*").alias("rows"), *[F.percentile_approx(s, F.lit(0.5), F.lit(10_000)).alias(f"m{i}") for i, s in enumerate(STATS)]
    )
    sizes = materialize(sizes, "quality-medians")
    spread = _joined(parts, sizes).groupBy("group").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[F.percentile_approx(F.abs(F.col(s) - F.col(f"m{i}")), F.lit(0.5), F.lit(10_000)).alias(f"mad{i}") for i, s in enumerate(STATS)],
    )
    cov = [(F.pow(1.4826 * F.col(f"mad{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    robust = spread.select("group", F.lit(0).alias("start"), *[f"m{i}" for i in range(P)], *cov)
    numbers = F.sequence(F.lit(1), F.lit(1 + DRAWN_STARTS))
    drawn = _joined(parts, sizes.select("group", "rows")).withColumn("start", F.explode(numbers))
    share = F.pmod(F.xxhash64("start", "row_hash"), F.lit(1 << 30)) / (1 << 30)
    others = _moments(drawn, (F.col("start") == 1) | (share * F.col("rows") < DRAWN_ROWS), F.lit(1.0), "group", "start")
    return _factored(robust.unionByName(others.drop("n"))).select("group", "start", *FACTORS, "log_det")


def _step(parts: DataFrame, estimate: DataFrame) -> DataFrame:
    """A concentration step: the estimate of the h rows nearest to each estimate."""
    measured = _distance(_joined(parts, estimate))
    limits = measured.groupBy("group", "start").agg(F.percentile_approx("d2", F.lit(KEEP_SHARE), F.lit(10_000)).alias("h2"))
    told = materialize(estimate.join(limits, ["group", "start"]), "quality-limits")
    chosen = F.col("d2") <= F.col("h2")
    new = _moments(_distance(_joined(parts, told)), chosen, F.lit(consistency(KEEP_SHARE)), "group", "start")
    return materialize(_factored(new).select("group", "start", *FACTORS, "log_det"), "quality-estimate")


def _best(estimate: DataFrame, n: int) -> DataFrame:
    """The n starts of least determinant of each group; groups have a handful of starts."""
    least = Window.partitionBy("group").orderBy("log_det", "start")
    return materialize(estimate.withColumn("place", F.row_number().over(least)).where(F.col("place") <= n).drop("place"), "quality-best")


def estimates(parts: DataFrame) -> DataFrame:
    """group, n, mean and covariance of every group, reweighted."""
    estimate = materialize(_starts(parts), "quality-estimate")
    for _ in range(FIRST_STEPS):
        estimate = _step(parts, estimate)
    estimate = _best(estimate, 2)
    for _ in range(MORE_STEPS):
        estimate = _step(parts, estimate)
    near = _distance(_joined(parts, _best(estimate, 1)))
    return materialize(_moments(near, F.col("d2") <= NEAR, F.lit(consistency(NEAR_SHARE)), "group"), "quality-groups")


def shrunk(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The factors for every group of language and source: (n own + PRIOR parent) / (n + PRIOR), the
    parent being the language's estimate, mixed in the same way with that of all rows. ``groups`` has the
    names all, lang and group."""

    def named(level: int, key: str) -> DataFrame:
        return found.select(F.col("group").alias(key), F.col("n").alias(f"n_{level}"), *[F.col(m).alias(f"{m}_{level}") for m in MOMENTS])

    table = groups.join(named(0, "all"), "all", "left").join(named(1, "lang_group"), "lang_group", "left").join(named(2, "group"), "group", "left")

    def mixed(level: int, m: str) -> Column:
        if not level:
            return F.col(f"{m}_0")
        n = F.coalesce(f"n_{level}", F.lit(0))
        return (n * F.coalesce(f"{m}_{level}", F.lit(0.0)) + PRIOR * mixed(level - 1, m)) / (n + PRIOR)

    return _factored(table.select("group", *[mixed(2, m).alias(m) for m in MOMENTS])).select("group", *FACTORS)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, d2 (squared distance) and kept for every document."""
    names = dict(zip(("all", "lang_group", "group"), group_names(F.col("lang"), F.col("source")), strict=True))
    row_hash = F.xxhash64("doc_id", "word_chars", "n_words", "text_hash")
    stats = with_base(text_counts(docs)).withColumns({**names, "row_hash": row_hash, "salt": F.pmod(row_hash, F.lit(SALTS)).cast("int")})
    stats = materialize(stats, "quality-stats")
    parts = stats.where("not base_failed").select("salt", "row_hash", *STATS, F.explode(F.array(*names)).alias("group"))
    told = materialize(shrunk(stats.select(*names).distinct(), estimates(parts)), "quality-shrunk")
    final = _distance(_joined(stats, told))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUT)
    return final.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "source", "text_hash", F.round("d2", 6).alias("d2")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are kept. Rows are matched by id, text, language and
    source, by which the verdict is fixed."""
    key = ["doc_id", "lang", "source"]
    verdicts = quality_verdicts(docs.select(*key, "text")).where("kept").select(*key, "text_hash").distinct()
    held = docs.select(F.struct("*").alias("row"))  # no column of the caller's meets one of ours
    same = [F.col(f"row.{k}").eqNullSafe(F.col(k)) for k in key] + [F.xxhash64("row.text") == F.col("text_hash")]
    return held.join(verdicts, reduce(lambda a, b: a & b, same), "left_semi").select("row.*")
