"""Candidates for questions and their shares by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Sections without facts to ask for.
NOISE_SECTIONS = (
    "外部連結", "外部链接", "外部鏈接", "外部链结", "參見", "参见",
    "參考資料", "参考资料", "參考文獻", "参考文献", "注釋", "注释",
    "延伸閱讀", "延伸阅读", "相關條目", "相关条目", "来源", "來源",
    "連結", "链接", "参考", "參考", "外部資源", "外部资源",
)
#: What titles of things end with, and what the beginning of a text about a person holds.
THINGS = (
    "站語場年路線山河湖市縣區鎮村島國會黨軍戰歌書影劇學院系科門綱目瀑橋塔港灣峰嶺泉寺廟宮觀堂社城園嶼洲漠峽街巷里弄"
    "叶葉草花樹木竹藤蕨苔菌魚鳥蟲獸龍馬牛羊犬貓鼠蛇蛙蝶蜂器機車船機炮槍彈刀劍鐘錶鏡燈傘鞋帽衣褲裙襪杯碗盤瓶罐"
)
PERSON = r"[（(]\s*\d{3,4}\s*年|出生于|出生於|逝世|卒於|卒于|漢族|汉族"
SHORTEST, LONGEST, TRADITIONAL_SHARE = 150, 800, 0.02


def is_person_like(title: Column, text: Column) -> Column:
    """A short title that no thing's ending closes, over a text that begins like one about a person."""
    return F.length(title).between(2, 5) & ~title.rlike(f"[{THINGS}]$") & F.substring(text, 1, 200).rlike(PERSON)


def reason(title: Column, section: Column, text: Column) -> Column:
    """The first rule that keeps a chunk out of the pool, or null."""
    return (
        F.when(title == "", "title")
        .when(section.isin(*NOISE_SECTIONS), "section")
        .when(~F.length(text).between(SHORTEST, LONGEST), "length")
        .when(T.is_listy(text), "list")
    )


def _told(chunks: DataFrame) -> DataFrame:
    clean = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "section")}
    told = chunks.select("chunk_id", *[v.alias(c) for c, v in clean.items()], F.coalesce("chunk_text", F.lit("")).alias("chunk_text"))
    return told.withColumn("reason", reason(F.col("title"), F.col("section"), F.col("chunk_text")))


def dropped(chunks: DataFrame) -> DataFrame:
    """P8's counters: chunks by reason; those that stay have none."""
    return _told(chunks).groupBy("reason").agg(F.count("*").alias("n"))


def candidates(chunks: DataFrame) -> DataFrame:
    """Q1: of each title the longest chunk that may stay (of equally long ones the smallest chunk_id), with
    its script and whether it is about a person. ``chunks``: chunk_id, title, section, chunk_text; nulls are
    empty. Map-side partials reduce a title with very many chunks before the exchange."""
    row = F.struct("chunk_id", "section", "chunk_text")
    best = _told(chunks).where("reason is null").groupBy("title").agg(F.min_by(row, F.struct(-F.length("chunk_text"), F.col("chunk_id"))).alias("best"))
    script = F.when(T.traditional_ratio(F.concat("title", "chunk_text")) >= TRADITIONAL_SHARE, "fanti").otherwise("simp")
    return best.select("title", "best.*").withColumns({"script": script, "person": is_person_like(F.col("title"), F.col("chunk_text"))})


def shares(easy: int, anon: int, para: int, cross: int) -> list[tuple[str, str, int]]:
    """(script, kind, number) in the order in which a script's shuffled candidates are given out."""
    return [
        ("simp", "easy", easy // 2), ("simp", "hard_anon", anon // 2), ("simp", "hard_para", para // 2), ("simp", "t2s", cross // 2),
        ("fanti", "easy", easy - easy // 2), ("fanti", "hard_anon", anon - anon // 2), ("fanti", "hard_para", para - para // 2), ("fanti", "s2t", cross - cross // 2),
    ]


def assign(pool: DataFrame, wanted: list[tuple[str, str, int]], seed: str = "42") -> DataFrame:
    """Every script's candidates in the order of a seeded hash; consecutive ranges go to the kinds, so
    that no candidate has two. Each task cuts to the number that is wanted at all."""
    most = {s: sum(n for t, _, n in wanted if t == s) for s, _, _ in wanted}
    w = Window.partitionBy("script").orderBy(F.md5(F.concat(F.lit(seed), F.col("title"))), "title")
    ranked = pool.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(most.values()))
    kind, start = F.lit(None).cast("string"), dict.fromkeys(most, 0)
    for script, name, n in wanted:
        inside = (F.col("script") == script) & (F.col("place") > start[script]) & (F.col("place") <= start[script] + n)
        kind, start[script] = F.when(inside, name).otherwise(kind), start[script] + n
    return ranked.withColumn("kind", kind).where("kind is not null")
