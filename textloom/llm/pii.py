"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds. SQL functions only.

High-recall generators propose overlapping spans. The fixed kinds (email, ip, card, phone) are decided by
their own format and checksum rules and always stay. What other spans are redacted is decided by gradient
boosted trees over format features (length, share of digits, hex digits, the span's form) and context
features (a cue word, a word that speaks against personal data, an assignment or a quote before the span).
The trees learn from ``labelled_spans``: texts with planted spans whose truth is known from planting, not
from the features, personal ones and decoys (hashes, identifiers, dates, amounts) alike, with and without
cues. The same SQL expressions describe their candidates; features take few values each, so that the
boosting runs on a table of at most ``MAX_CELLS`` rows. On texts of another seed the scores are calibrated:
a kind's threshold is the lowest score from which on ``PRECISION`` of the candidates are true. The fitted
trees become one CASE expression, and the corpus is read once.

Positions are code points, ends exclusive; places in bytes go along with them, as bytes can be cut out of a
long text without reading it from its start.

Nulls: a null text counts as empty and has no span; a null doc_id stays. Repeated rows are treated alike,
an empty table gives an empty result, long texts are taken whole and every step runs in time in proportion
to the text (matches begin where a run begins, or where the last match ended; running sums are taken in
chunks of chunks). Other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which kinds are listed. No match begins inside a run
#: that has been tried from its start; repetitions are possessive where nothing behind could use less.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Generators beyond the base: opaque values, digit chains, and addresses written out.
WIDE = {
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+",
    "number": r"(?<![0-9+])[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
    "contact": r"(?<![A-Za-z0-9._%-])[A-Za-z0-9._%-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
}
WIDE_NEEDS = {"secret": r"[A-Za-z0-9_]{16}", "number": r"[0-9]{2}", "contact": r"[\[(]at[\])]"}
CUES = r"(?i)(?:token|secret|key|passw(?:or)?d|pass|auth|pin|ssn|iban|account|konto|tel|phone|mobile|call|fax|e?-?mail|contact)(?: is| no\.?)?\W{0,4}$"
TAME = r"(?i)(?:commit|md5|sha[0-9]*|rev|hash|isbn|order|invoice|version|build|date|since|until|page|total|sum|opens|meet)\W{0,4}$"
#: Bytes before a span that tell its context.
CONTEXT = 32
ROUNDS = 60
RATE = 0.3
PRECISION = 0.95
TRAIN_TEXTS = 3_000
FEATURES = {"kind": 3, "size": 4, "digits": 4, "form": 4, "hex": 2, "cue": 2, "tame": 2, "assigned": 2, "quoted": 2}
MAX_CELLS = math.prod(FEATURES.values())
CHUNK, CHUNK_BITS = 64, 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with its value made once, however often it is mentioned."""
    return F.transform(F.array(value), body)[0]


def running(xs: Column, op: Callable[[Column, Column], Column], zero: Column, depth: int = 2) -> Column:
    """What op makes of all elements before each: within chunks one by one, over chunks by the same way, so
    that the time is in proportion to the elements (up to CHUNK ** (depth + 1) of them)."""

    def folded(all_xs: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(all_xs, start + 1, n), zero, op)

    def body(all_xs: Column) -> Column:
        if not depth:
            return F.transform(all_xs, lambda _, i: folded(all_xs, F.lit(0), i))
        last = F.shiftright(F.size(all_xs) - 1, CHUNK_BITS)
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: folded(all_xs, c * CHUNK, F.lit(CHUNK)))

        def placed(heads: Column) -> Column:
            return F.transform(all_xs, lambda _, i: op(F.get(heads, F.shiftright(i, CHUNK_BITS)), folded(all_xs, F.shiftright(i, CHUNK_BITS) * CHUNK, i % CHUNK)))

        return F.when(F.size(all_xs) == 0, F.array_repeat(zero, 0)).otherwise(let(running(chunks, op, zero, depth - 1), placed))

    return let(xs, body)


def _add(a: Column, b: Column) -> Column:
    return F.struct((a.n + b.n).alias("n"), (a.b + b.b).alias("b"))


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _sized(text: Column) -> Column:
    return F.struct(F.length(text).alias("n"), F.octet_length(text).alias("b"))


def spans(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches with their places: what stands between matches and the matches
    themselves, measured in code points and bytes and added up."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,low:int,high:int,value:string>>")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"))

    def located(pairs: Column) -> Column:
        whole = running(F.transform(pairs, lambda x: _add(_sized(x.b), _sized(x.f))), _add, zero)

        def row(x: Column, before: Column) -> Column:
            at, own = _add(before, _sized(x.b)), _sized(x.f)
            return F.struct(at.n.alias("start"), (at.n + own.n).alias("end"), at.b.alias("low"), (at.b + own.b).alias("high"), x.f.alias("value"))

        return F.zip_with(pairs, whole, row)

    # zipped, so that both arrays are made once and not for every element; the last has no match behind it
    pairs = F.filter(F.arrays_zip(between.alias("b"), found.alias("f")), lambda x: x.f.isNotNull())
    return F.when(text.rlike(needs), let(pairs, located)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def weight(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + weight(i))
    return total % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s.value, r"\."), _small),
    "card": lambda s: F.when(F.length(_digits(s.value)).between(16, 19), luhn(s.value)).otherwise(False),
    "phone": lambda s: F.length(_digits(s.value)).between(8, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    return {k: F.filter(spans(text, p, NEEDS[k]), VALID[k]) for k, p in BASE.items()}


def _banded(x: Column, *edges: float) -> Column:
    return reduce(lambda a, b: a + b, [(x >= e).cast("int") for e in edges])


def _form(kind: str, value: Column) -> Column:
    """What the span looks like, 0 to 3 for each kind."""
    if kind == "secret":
        upper, lower, digit = value.rlike("[A-Z]"), value.rlike("[a-z]"), value.rlike("[0-9]")
        return F.when(~digit | ~(upper | lower), 0).when(upper & lower, 3).when(upper, 2).otherwise(1)
    if kind == "number":
        local, official = value.rlike(r"^[0-9]{3}[\x20().-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"), value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
        date = value.rlike(r"^(?:[12][0-9]{3}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.][12][0-9]{3}|[12][0-9]{3}-[12][0-9]{3})")
        return F.when(official, 2).when(date, 3).when(local, 1).otherwise(0)
    return F.when(value.rlike(r"[\[(]dot[\])]"), 2).when(value.rlike(r"\.[A-Za-z]{2,4}$"), 1).otherwise(0)


def candidates(text: Column) -> Column:
    """All wide spans with their coded features."""
    data = F.encode(text, "UTF-8")

    def described(code: int, kind: str) -> Callable[[Column], Column]:
        def row(s: Column) -> Column:
            # the context may begin within a letter, which no pattern minds, as all are anchored at its end
            left = F.substring(data, F.greatest(s.low - CONTEXT, F.lit(0)) + 1, F.least(s.low, F.lit(CONTEXT))).cast("string")
            digits = F.length(_digits(s.value)) / F.length(s.value)
            bare = F.regexp_replace(left, r"[\s\"'=:(]+$", "")
            return F.struct(
                s.start.alias("start"),
                s.end.alias("end"),
                s.low.alias("low"),
                s.high.alias("high"),
                F.lit(code).alias("kind"),
                _banded(F.length(s.value), 10, 20, 36).alias("size"),
                _banded(digits, 0.1, 0.4, 0.75).alias("digits"),
                _form(kind, s.value).alias("form"),
                s.value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int").alias("hex"),
                bare.rlike(CUES).cast("int").alias("cue"),
                bare.rlike(TAME).cast("int").alias("tame"),
                left.rlike(r"[=:]\s*[\"']?$").cast("int").alias("assigned"),
                left.rlike(r"[\"']$").cast("int").alias("quoted"),
            )

        return row

    return F.concat(*[F.transform(spans(text, p, WIDE_NEEDS[k]), described(i, k)) for i, (k, p) in enumerate(WIDE.items())])


def labelled_spans(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with planted spans and the places of the personal ones; what else is planted is a decoy."""
    rng = random.Random(seed)
    pick = rng.choice
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def some(letters: str, low: int, high: int) -> str:
        return "".join(rng.choices(letters, k=rng.randint(low, high)))

    def with_digits(letters: str, low: int, high: int) -> str:
        value = some(letters, low, high - 2)
        return value[:3] + pick(letters.strip(digits)) + pick(digits) + value[3:]

    def name() -> str:
        return some(lower, 2, 8)

    def shaped(form: str) -> str:
        return "".join(pick(digits) if c == "d" else pick(digits[1:]) if c == "n" else c for c in form)

    def opaque() -> str:
        return pick([
            lambda: with_digits("0123456789abcdef", 16, 44), lambda: with_digits(lower + upper + digits, 16, 44), lambda: with_digits(upper + digits, 16, 28),
        ])()

    def bare_key() -> str:
        return pick([lambda: some(upper, 4, 4) + with_digits(upper + digits, 14, 24), lambda: f"{name()[:3]}_{with_digits(lower + upper + digits, 20, 40)}"])()

    def assigned(cues: str, value: str) -> tuple[str, str]:
        quote = pick(["", "", '"', "'"])
        cue = pick(cues.split())
        return pick([cue, cue.upper(), cue.capitalize()]) + pick(["=", ": ", " = ", ":", " is ", " "]) + quote, value

    def date() -> str:
        y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
        return pick([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{y}/{m:02}/{d:02}", f"{y}-{y + rng.randint(1, 30)}", f"{y}-{m:02}-{d:02} {rng.randint(0, 23):02}"])

    local = ["ndd) ddd-dddd", "ndd-ddd-dddd", "ndd.ddd.dddd", "ndd ddd dddd"]
    address = lambda end: f"{name()}.{name()}{pick([' [at] ', ' (at) ', '(at)', '[at]'])}{name()}{end}"
    personal = [
        lambda: assigned("password passwd secret token api_key key auth pass", opaque()),
        lambda: assigned("password secret token key", opaque()),
        lambda: ("", bare_key()),
        lambda: assigned("ssn phone tel call fax mobile account konto pin iban", shaped(pick([*local, "ndd-dd-dddd", "0dd ddddddd", "nddddddd", "ndddddddddd"]))),
        lambda: ("", shaped(pick([*local[:2], "ndd-dd-dddd"]))),
        lambda: (pick(["", "", "mail ", "contact: "]), address(pick([" [dot] com", "(dot)org", ".com", ".net", ".de", " [dot] co [dot] uk"]))),
    ]
    decoys = [
        lambda: (pick(["commit ", "md5 ", "sha1: ", "rev ", "", "hash="]), some("0123456789abcdef", 32, 40)),
        lambda: ("", "_".join(some(lower, 3, 9) for _ in range(rng.randint(3, 5)))),
        lambda: ("", "".join(some(lower, 3, 8).capitalize() for _ in range(rng.randint(3, 5)))),
        lambda: (pick(["", "", "", "key: ", "token "]), some(lower, 16, 30)),
        lambda: ("", pick([some(upper, 16, 24), "_".join(some(upper, 4, 8) for _ in range(4))])),
        lambda: (pick(["", "order ", "invoice no. ", "total "]), shaped(pick(["ndddddddd", "ndddddddddddddddd", "n.ddd.ddd", "nd.ddd.ddd.ddd", "nddddddddd"]))),
        lambda: (pick(["", "since ", "date: ", "until "]), date()),
        lambda: (pick(["isbn ", "ISBN: "]), shaped("978-n-dd-dddddd-d")),
        lambda: (pick(["version ", "build ", ""]), shaped("nd.d.ddddd.dddd")),
        lambda: (pick(["opens ", "meet "]), f"{name()} (at) {name()}.{shaped('nd')}"),
        lambda: (pick(["build", "version "]), f"{some(lower, 5, 9)}{shaped('20dd0ndd')}_{some(lower, 4, 6)}"),
    ]
    out = []
    for _ in range(n):
        text, truth = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(name() for _ in range(rng.randint(2, 8))) + pick([" ", ". ", ", ", "\n"])
            good = rng.random() < 0.4
            before, value = pick(personal if good else decoys)()
            if good:
                truth.append((len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + pick([" ", ". ", '" ', ", ", "\n"])
        out.append((text, truth))
    return out


class Trees:
    """Additive two-level trees over the coded features, with one threshold for each kind."""

    def __init__(self, start: float, trees: list, limits: list[float]) -> None:
        self.start, self.trees, self.limits = start, trees, limits

    def score(self, cell: dict) -> float:
        total = self.start
        for (f, v), low, high in self.trees:
            g, w, a, b = high if cell[f] >= v else low
            total += b if cell[g] >= w else a
        return total

    def column(self, s: Column) -> Column:
        def leaf(node: tuple) -> Column:
            g, w, a, b = node
            return F.when(s[g] >= w, b).otherwise(a)

        if not self.trees:
            return F.lit(self.start)
        parts = [F.when(s[f] >= v, leaf(high)).otherwise(leaf(low)) for (f, v), low, high in self.trees]
        return reduce(lambda a, b: a + b, parts, F.lit(self.start))

    def chosen(self, s: Column) -> Column:
        limit = reduce(lambda rest, i: F.when(s.kind == i, self.limits[i]).otherwise(rest), range(len(self.limits)), F.lit(math.inf))
        return self.column(s) >= limit


def fit_trees(cells: list[dict], others: list[dict]) -> Trees:
    """Gradient boosting (Newton steps, logistic loss) over cells {feature codes, n, seeds}, of which seeds
    are true; thresholds from ``others``."""
    n, seeds = sum(c["n"] for c in cells), sum(c["seeds"] for c in cells)
    if not n:
        return Trees(0.0, [], [math.inf] * len(WIDE))
    start = math.log((seeds + 0.5) / (n - seeds + 0.5))
    margins, trees = [start] * len(cells), []
    cuts = [(f, v) for f, m in FEATURES.items() for v in range(1, m)]

    def best(members: list[int], grads: list[tuple[float, float]]) -> tuple[float, str, int, float, float]:
        found = None
        for f, v in cuts:
            sums = [[0.0, 1.0], [0.0, 1.0]]
            for i in members:
                side = sums[cells[i][f] >= v]
                side[0] += grads[i][0]
                side[1] += grads[i][1]
            gain = sum(g * g / h for g, h in sums)
            if found is None or gain > found[0] + 1e-12:
                found = gain, f, v, RATE * sums[0][0] / sums[0][1], RATE * sums[1][0] / sums[1][1]
        return found

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        grads = [(c["seeds"] - c["n"] * q, c["n"] * q * (1 - q)) for c, q in zip(cells, p, strict=True)]
        everyone = list(range(len(cells)))
        _, f, v, _, _ = best(everyone, grads)
        sides = [[i for i in everyone if (cells[i][f] >= v) == up] for up in (False, True)]
        low, high = (best(side, grads)[1:] for side in sides)
        trees.append(((f, v), low, high))
        for i, c in enumerate(cells):
            g, w, a, b = high if c[f] >= v else low
            margins[i] += b if c[g] >= w else a
    model = Trees(start, trees, [])
    for kind in range(len(WIDE)):
        mine = sorted(((model.score(c), c) for c in others if c["kind"] == kind), key=lambda x: -x[0])
        limit, total, good = math.inf, 0, 0
        for k, (m, c) in enumerate(mine):
            total, good = total + c["n"], good + c["seeds"]
            last_of_score = k + 1 == len(mine) or mine[k + 1][0] < m
            if last_of_score and good >= PRECISION * total:
                limit = m - 1e-9
        model.limits.append(limit)
    return model


def labelled_cells(spark: SparkSession, n: int, seed: int) -> list[dict]:
    """The candidates of planted texts, counted by their features; true where they overlap a planted span."""
    texts = spark.createDataFrame(labelled_spans(n, seed), "text string, truth array<struct<start:int,end:int>>")
    wide = texts.withColumn("wide", candidates(F.col("text"))).select("truth", F.inline("wide"))
    seed_of = F.exists("truth", lambda t: (t.start < F.col("end")) & (F.col("start") < t.end))
    rows = wide.withColumn("seed", seed_of.cast("int")).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"))
    return [r.asDict() for r in rows.orderBy(*FEATURES).collect()]  # MAX_CELLS rows at most


def train(spark: SparkSession, n: int = TRAIN_TEXTS) -> Trees:
    return fit_trees(labelled_cells(spark, n, 1), labelled_cells(spark, n, 2))


def find_spans(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """row, text, the arrays of base spans, and ``all_spans`` (kind, start, end, low, high; the last two in
    bytes), sorted as listed. Wide spans that lie inside a base span are left out."""
    trees = trees or train(docs.sparkSession)
    kinds = [*BASE, *WIDE]
    text = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = text.withColumns({**base_spans(F.col("text")), "wide": F.filter(candidates(F.col("text")), trees.chosen)})

    def named(rank: Column, s: Column) -> Column:
        return F.struct(s.start.alias("start"), rank.alias("rank"), s.end.alias("end"), s.low.alias("low"), s.high.alias("high"))

    def ranked(i: int) -> Callable[[Column], Column]:  # a second argument of a lambda would be the place
        return lambda s: named(F.lit(i), s)

    base = [F.transform(k, ranked(i)) for i, k in enumerate(BASE)]
    wide = F.transform("wide", lambda s: named(s.kind + len(BASE), s))

    def outside(ordered: Column) -> Column:
        # how far the base spans that begin no later reach; they sort first among those of one start
        reach = running(F.transform(ordered, lambda s: F.when(s["rank"] < len(BASE), s.end).otherwise(0)), _most, F.lit(0))
        both = F.zip_with(ordered, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r")))
        kept = F.filter(both, lambda x: (x.s["rank"] < len(BASE)) | (x.r < x.s.end))
        return F.sort_array(F.transform(kept, lambda x: F.struct(x.s["rank"].alias("rank"), x.s.start.alias("start"), x.s.end.alias("end"), x.s.low.alias("low"), x.s.high.alias("high"))))

    names = F.array(*[F.lit(k) for k in kinds])
    listed = F.transform(
        let(F.sort_array(F.concat(*base, wide)), outside),
        lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.low.alias("low"), s.high.alias("high")),
    )
    return found.withColumn("all_spans", listed).drop("wide")


def digest(found: DataFrame) -> DataFrame:
    def written(kind: str | None) -> callable:
        return lambda s: F.concat(F.lit(kind) if kind else s.kind, F.lit(":"), s.start, F.lit(":"), s.end)

    base = F.concat(*[F.transform(k, written(k)) for k in BASE])
    return found.select(
        "row.doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all_spans", written(None)), ",").alias("spans"),
    )


def redacted(text: Column, all_spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named
    after the first."""
    ordered = F.sort_array(F.transform(all_spans, lambda s: F.struct(s.low.alias("low"), s.high.alias("high"), s.kind.alias("kind"))))

    def cut(data: Column, low: Column, high: Column) -> Column:
        return F.substring(data, low + 1, high - low).cast("string")

    def body(x: Column) -> Column:
        reach = running(F.transform(x.spans, lambda s: s.high), _most, F.lit(0))

        def piece(s: Column, r: Column) -> Column:
            new = F.concat(cut(x.data, r, s.low), F.lit("<"), F.upper(s.kind), F.lit(">"))
            return F.when(s.low >= r, new).otherwise("")

        end = F.array_max(F.transform(x.spans, lambda s: s.high))
        return F.concat(F.array_join(F.zip_with(x.spans, reach, piece), ""), cut(x.data, end, F.octet_length(x.data)))

    held = F.struct(F.encode(text, "UTF-8").alias("data"), ordered.alias("spans"))
    return F.when(F.size(all_spans) == 0, text).otherwise(let(held, body))


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """The documents with their texts redacted; a null text stays null, n_chars follows the text."""
    found = find_spans(docs, trees).select("row", redacted(F.col("text"), F.col("all_spans")).alias("clean"))
    clean = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    new = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pii_digest(docs: DataFrame) -> DataFrame:
    return digest(find_spans(docs))
