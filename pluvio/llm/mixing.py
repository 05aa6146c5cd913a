"""Mixing sources: temperature weights, realised as budgeted block permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.llm.runtime import cut

#: Tables of up to so many sources are broadcast.
BROADCAST_SOURCES = 100_000
#: Bisection steps that one job takes, and jobs.
STEPS, JOBS = 5, 6
#: Blocks of a source that one task orders.
BLOCKS = 4096
#: Rows of one id that stay together, and ways by which the rows of an id go to the join that tells how many there are.
SHARED, WAYS = 256, 64


def n_words(text: Column) -> Column:
    """Words of a text, which stand for its tokens; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def find_exponent(sources: DataFrame, budget: int, entropy: float | None, most_repeats: float | None, greatest: float = 1.0) -> float:
    """The largest exponent in 0 to ``greatest`` that meets both limits, by bisection; 0 if none does, and 1 without limits.

    ``sources`` has ``share`` and ``tokens``. The entropy of the weights, as a part of the greatest
    possible one, falls as the exponent grows, from 1 at 0; how often the most repeated source is
    repeated falls too. Where the entropy needs a smaller exponent than the repetition allows, the
    repetition limit wins. Each job looks at the ``2**STEPS - 1`` points of ``STEPS`` steps at once.
    """

    def search(low: float, high: float, holds) -> tuple[float, float]:
        """``holds(row)`` is true at ``low`` and false at ``high``."""
        for _ in range(JOBS):
            n = 1 << STEPS
            points = [low + (high - low) * i / n for i in range(1, n)]
            rows = {r["a"]: holds(r) for r in measure(points)}
            last = max((a for a in points if all(rows[b] for b in points if b <= a)), default=low)
            low, high = last, min((a for a in points if a > last), default=high)
        return low, high

    def measure(points: list[float]) -> list:
        at = sources.where("tokens > 0").withColumn("a", F.explode(F.array(*map(F.lit, points)))).withColumn("x", F.pow("share", "a"))
        sums = at.groupBy("a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("share")).alias("s"), F.max(F.col("x") / F.col("tokens")).alias("m"), F.count("*").alias("n"))
        return sums.select("a", (F.log("z") - F.col("a") * F.col("s") / F.col("z")).alias("entropy"), (F.lit(float(budget)) * F.col("m") / F.col("z")).alias("repeats"), F.log("n").alias("greatest")).collect()

    measured = {r["a"]: r for r in measure([0.0, 1.0, float(greatest)])}
    if not measured:
        return 1.0
    even, natural = measured[0.0], measured[float(greatest) if entropy is not None else 1.0]
    flat = lambda r: r["entropy"] >= entropy * r["greatest"] - 1e-12
    found = natural["a"]
    if entropy is not None and not flat(natural):
        found = search(0.0, found, flat)[0]
    often = lambda r: r["repeats"] > most_repeats
    if most_repeats is not None and often(even):
        found = max(found, 1.0 if often(measured[1.0]) else search(0.0, 1.0, often)[1])
    return found


def mix_sources(docs: DataFrame, budget: int | None = None, entropy: float | None = 0.95, most_repeats: float | None = 4.0, greatest: float = 1.0, block_tokens: int = 1_000_000, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document enters the mix.

    A source of token share p has weight p**a over the sum of these; ``find_exponent`` sets a, from
    0 (all alike) to ``greatest``: 1 leaves the shares as they are where these meet the limits, and
    more sharpens shares that are flatter than the target entropy until they meet it.
    ``budget`` tokens (all there are, if None) are dealt by weight. A source passes over its
    documents as often as its part allows; of the last pass it takes what comes first in a
    permutation: documents are dealt into blocks of about ``block_tokens`` by hash, blocks are
    permuted, and documents within a block. So no sort holds more than a block, whatever the
    source's size.

    A null source is a source; a text without words, or null, has no tokens and enters as often as
    its source makes full passes, once at least. Rows of one id are dealt to one block, or, where
    they are more than ``SHARED``, as those without id may be, to as many as so many ids would be;
    repeated rows count each. An empty table gives no rows; other columns are ignored.

    Returns ``doc_id, source, n_tokens, weight, copies``.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total, n_sources = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    budget = int(total if budget is None else budget)
    sources = cut(sources.withColumn("share", F.col("tokens") / F.lit(float(max(1, total)))))
    exponent = find_exponent(sources, budget, entropy, most_repeats, greatest)
    part = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    whole = sources.agg(F.sum(part)).first()[0] or 1.0
    plan = sources.select(F.col("source").alias("of"), "tokens", (part / F.lit(whole)).alias("weight"))
    dealt = F.floor(F.col("weight") * budget)
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(dealt / F.col("tokens"))).otherwise(1))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, dealt - F.col("passes") * F.col("tokens")).otherwise(0)).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)))
    if n_sources <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    # Ids of very many rows, or none, are spread over blocks as so many ids; they are told by a join in which they are spread too.
    often = rows.groupBy("doc_id").agg(F.count("*").alias("times")).where(F.col("times") > SHARED).select(F.col("doc_id").alias("id_"), F.ceil(F.col("times") / SHARED).alias("spread"), F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))).alias("way_"))
    rows = rows.withColumn("way", F.pmod("row", F.lit(WAYS)))
    rows = rows.join(often, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("way") == F.col("way_")), "left").withColumn("salt", F.coalesce(F.pmod("row", "spread"), F.lit(0))).drop("id_", "way_", "way", "spread", "row")
    key = F.when(F.col("salt") > 0, F.xxhash64(F.lit(seed), "doc_id", "salt")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(key, F.col("blocks")))
    sums = placed.groupBy("of", "block").agg(F.sum("n_tokens").alias("size"))
    # A permutation in two levels: groups of blocks, in their order, and blocks within a group.
    sums = sums.join(plan.select(F.col("of").alias("__of"), F.ceil(F.col("blocks") / BLOCKS).alias("groups")), F.col("of").eqNullSafe(F.col("__of"))).drop("__of")
    sums = cut(sums.withColumn("group", F.pmod(F.xxhash64(F.lit(seed + 2), "of", "block"), F.col("groups"))))
    above = Window.partitionBy("of").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    groups = sums.groupBy("of", "group").agg(F.sum("size").alias("whole"))
    groups = groups.select(F.col("of").alias("__of"), F.col("group").alias("__group"), (F.sum("whole").over(above) - F.col("whole")).alias("start"))
    order = Window.partitionBy("of", "group").orderBy(F.xxhash64(F.lit(seed), "of", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.join(groups, F.col("of").eqNullSafe(F.col("__of")) & (F.col("group") == F.col("__group")))
    sums = sums.select(F.col("of").alias("of_"), F.col("block").alias("block_"), (F.col("start") + F.sum("size").over(order) - F.col("size")).alias("before"))
    placed = placed.join(sums, F.col("of").eqNullSafe(F.col("of_")) & (F.col("block") == F.col("block_")))
    inside = Window.partitionBy("of", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = (F.col("before") + F.sum("n_tokens").over(inside) <= F.col("rest")) & (F.col("rest") > 0)
    copies = F.col("passes") + F.when(F.col("n_tokens") > 0, last.cast("long")).otherwise(F.when(F.col("passes") == 0, 1).otherwise(0))
    return placed.select("doc_id", "source", "n_tokens", "weight", copies.cast("long").alias("copies"))
