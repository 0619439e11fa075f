"""MediaWiki dumps as DataFrames: no page goes through Python or the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An explicit schema: inference would make dates of titles.
PAGE = "title string, ns int, id long, redirect struct<_title:string>, revision struct<id:long, text:struct<_VALUE:string, _bytes:long>>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a dump (plain, gz or multi-stream bz2) by the XML reader: doc_id, ns, title, is_redirect,
    text. Entities come decoded; an empty or missing text is the empty string; the page's own id, not the
    revision's."""
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    text = F.coalesce("revision.text._VALUE", F.lit(""))
    return pages.select(F.col("id").alias("doc_id"), "ns", "title", F.col("redirect").isNotNull().alias("is_redirect"), text.alias("text"))


def _unescape(text: Column) -> Column:
    """The five entities that dumps use; the ampersand last, so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def read_dump_text(spark: SparkSession, path: str) -> DataFrame:
    """The same rows without an XML parser, cut at </page>; a broken page costs that page only."""
    cut = spark.read.option("lineSep", "</page>").text(path).select(F.regexp_extract("value", r"(?s)<page>(.*)", 1).alias("p")).where("p <> ''")
    head = F.regexp_extract("p", r"(?s)^(.*?)(?:<revision>|$)", 1)
    one = lambda c, tag: F.regexp_extract(c, f"<{tag}>([^<]*)</{tag}>", 1)
    return cut.select("p", head.alias("h")).select(
        F.nullif(one(F.col("h"), "id"), F.lit("")).cast("long").alias("doc_id"),
        F.nullif(one(F.col("h"), "ns"), F.lit("")).cast("int").alias("ns"),
        _unescape(one(F.col("h"), "title")).alias("title"),
        F.col("h").rlike("<redirect[ />]").alias("is_redirect"),
        _unescape(F.regexp_extract("p", r"<text(?:\s[^>]*[^/>])?>([^<]*)</text>", 1)).alias("text"),
    )


def articles(pages: DataFrame) -> DataFrame:
    """Main namespace, no redirects."""
    return pages.where("ns = 0 and not is_redirect").select("doc_id", "title", "text")
