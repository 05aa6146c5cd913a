"""Exact deduplication: 128-bit content hash, bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.runtime import cut

#: The characters that do not count when texts are compared: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs`` the row that stays in its place.

    Texts are equal when their characters other than blanks are. Of equal texts the one with the
    most code points stays, then the smallest id. Rows are grouped on the MD5 of the text together
    with the text itself, so that texts which collide under the hash stay apart; equal rows meet
    before the shuffle (map-side aggregation), so that a group of any size sends one row a task.
    A row finds its group by MD5 and SHA-256; only if two different texts agree in both does a
    second join compare the texts as well.

    Null texts count as empty and are one group with empty and blank ones. Repeated ids each give
    a row; a null id gives a row and stays only if its group has no other of its length. An empty
    table gives no rows. Other columns are ignored.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"))
    hashed = rows.withColumn("h", F.unhex(F.md5("norm"))).withColumn("sha", F.sha2("norm", 256))
    # Most code points first, then the smallest id, as one number that hash aggregation can hold.
    rank = (-F.col("n_points")).cast("decimal(11,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") + F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)")
    texts = hashed.withColumn("rank", rank).groupBy("h", "norm").agg(F.count("*").alias("group_size"), F.min_by("doc_id", "rank").alias("keep_id"), F.first("sha").alias("sha"))
    groups = cut(texts.select("h", "sha", "group_size", "keep_id", F.xxhash64("norm").alias("probe")))
    collided = groups.groupBy("h", "sha").count().filter("count > 1").limit(1).count() > 0
    if collided:
        found = hashed.withColumnRenamed("norm", "own").join(texts.withColumnsRenamed({"h": "g", "sha": "g_sha"}), (F.col("h") == F.col("g")) & (F.col("own") == F.col("norm")), "left")
    else:
        members = hashed.select("doc_id", "h", "sha")
        found = members.join(groups.drop("probe"), ["h", "sha"], "left")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
