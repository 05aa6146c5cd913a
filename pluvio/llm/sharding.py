"""Sharding by extendible hashing: oversized buckets alone split on another bit of the hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.runtime import cut

#: Bits that one job looks ahead, and bits of one hash.
STEP, WORD = 16, 64
#: Directories of up to so many shards, some 100 bytes each, and of so many depths are broadcast, a depth at a time.
BROADCAST_SHARDS, BROADCAST_DEPTHS = 1_000_000, 16


def _bits(h: Column) -> Column:
    return F.lpad(F.bin(h), WORD, "0")


def _split(rows: DataFrame, opened: DataFrame | None, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards found within ``STEP`` bits beyond ``depth``, and the prefixes that are still too large. ``opened``: the prefixes to split, None for the empty one."""
    if opened is not None:
        rows = rows.withColumn("prefix", F.substring("bits", 1, depth)).join(opened.select("prefix"), "prefix", "left_semi")
    cells = rows.groupBy(F.substring("bits", 1, depth + STEP).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    spread = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(depth + STEP)))).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    nodes = cut(spread.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
    full = nodes.where(~fits)
    shards = nodes.where(fits).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
    above = full.select(F.col("prefix").alias("parent"), (F.col("depth") + 1).alias("depth"))
    found = shards.join(above, ["parent", "depth"], "left_semi").drop("parent")
    if opened is None:
        found = found.unionByName(shards.where("depth = 0").drop("parent"))
    return found, full.where(F.col("depth") == depth + STEP).select("prefix")


def assign_shards(docs: DataFrame, limit: int = 64 << 20, least_shards: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard``, ``shard_bytes`` and ``shard_rows``; columns of these names are replaced.

    A row's hash is that of its id. The directory starts as one bucket; a bucket whose texts exceed
    ``limit`` bytes of UTF-8 splits on the next bit, and no other does. Where all texts together are
    less than ``least_shards`` times the limit, an even part of them is the limit, so that small
    tables give readers as many shards too. A shard is named by its bits (``s`` alone if there is
    one). Rows of one id cannot be told apart by its hash: where they alone exceed the limit, a hash
    of the row's number goes on for 64 more bits. One text above the limit is a shard of its own,
    the only kind above it.

    A null text has no bytes; a null id has a hash as others do. An empty table gives no rows. Texts
    are not copied: a directory of at most ``BROADCAST_SHARDS`` shards is looked up one depth after
    the other; a larger one is joined to the hashes alone first, and texts are shuffled once.
    """
    docs = docs.drop("shard", "shard_bytes", "shard_rows")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes")
    bits = _bits(F.xxhash64(F.lit(1), F.col(id_col).cast("string")))
    rows = cut(docs.select(bits.alias("bits"), size))
    if least_shards > 1:
        total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        limit = max(1, min(limit, total // least_shards))
    found, opened = _split(rows, None, 0, limit)
    directory, depth = found, STEP
    while not opened.isEmpty() and depth < 2 * WORD:
        if depth == WORD:
            docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
            bits = F.concat(bits, _bits(F.xxhash64(F.lit(2), F.col("__row"))))
            rows = cut(docs.select(bits.alias("bits"), size))
        found, opened = _split(rows, opened, depth, limit)
        directory, depth = directory.unionByName(found), depth + STEP
    names = {"prefix": "__prefix", "bytes": "shard_bytes", "n": "shard_rows"}
    directory = cut(directory.select("depth", "prefix", "bytes", "n").withColumnsRenamed(names))
    counts = {r["depth"]: r["count"] for r in directory.groupBy("depth").count().collect()}  # at most 129 rows
    held = docs.withColumn("__bits", bits)
    if sum(counts.values()) <= BROADCAST_SHARDS and len(counts) <= BROADCAST_DEPTHS:
        placed = held.withColumn("__at", F.lit(None).cast("struct<shard:string,shard_bytes:long,shard_rows:long>"))
        for d in sorted(counts):
            own = directory.where(F.col("depth") == d).select(F.col("__prefix"), F.struct(F.concat(F.lit("s"), "__prefix").alias("shard"), "shard_bytes", "shard_rows").alias("__own"))
            placed = placed.withColumn("__prefix", F.substring("__bits", 1, d)).join(F.broadcast(own), "__prefix", "left")
            placed = placed.withColumn("__at", F.coalesce("__at", "__own")).drop("__prefix", "__own")
        return placed.select(*[c for c in docs.columns if c != "__row"], "__at.*")
    prefixes = F.transform(F.array(*[F.lit(d) for d in sorted(counts)]).cast("array<int>"), lambda d: F.substring("__bits", F.lit(1), d))
    hashes = rows.select(F.col("bits").alias("__bits")).distinct().withColumn("__prefix", F.explode(prefixes))
    found = hashes.join(directory, "__prefix").select("__bits", F.concat(F.lit("s"), "__prefix").alias("shard"), "shard_bytes", "shard_rows")
    return held.join(found, "__bits").select(*[c for c in docs.columns if c != "__row"], "shard", "shard_bytes", "shard_rows")
