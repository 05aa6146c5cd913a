"""Filter interaction audit: what each filter removes in every order of the filters, from a cube over their failure flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.llm.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at the text alone: A under 200 words, B fewer distinct words than half, C more than 2 of 100 code points in A-Z, D any of ``#$%&*|``."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200, "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(2) * F.length(text), "D": text.rlike(MARKS),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, A .. E, n, good, toxic``: documents by part and by which filters they fail, and how many of them are labelled good and toxic.

    Filter E fails a text that a row with a smaller ``doc_id`` has too. All that the filters look at
    is equal within the rows of one text, so that rows are counted by text (its SHA-256) and id
    before anything else, and a text that very many rows share is one row for each part and label by
    the time its smallest id is sought.

    Null texts and sources are empty; a row without id is no smaller than any and has none smaller;
    rows of one id and text all stand where the first does. Of labels that repeat an id the highest
    counts, and null labels are none. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("same"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    flags, of = list(FILTERS[:-1]), ["part", "good", "toxic"]
    each = rows.groupBy("doc_id", "same", "part", *flags).agg(F.count("*").alias("n"))
    known = labels.select(F.col("doc_id").alias("of"), "quality", "toxic").groupBy("of").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    each = each.join(known, F.col("doc_id") == F.col("of"), "left").drop("of").fillna(False, ["good", "toxic"])
    few = each.groupBy("same", *of, *flags).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    # A text has at most one row for each part and label here.
    least = F.min("least").over(Window.partitionBy("same"))
    first = F.col("without") + F.when(F.col("least") == F.col("least_of_all"), F.col("first.n")).otherwise(0)
    few = few.withColumn("least_of_all", least).withColumn("passing", F.coalesce(first, F.col("without")))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("m")))).alias("s")
    few = few.select(*of, *flags, sides).select(*of, *flags, "s.E", "s.m").where("m > 0")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("m"))), F.lit(0)).alias
    return few.groupBy("part", *flags, "E").agg(F.sum("m").alias("n"), count(F.col("good"))("n_good"), count(F.col("toxic"))("n_toxic")).withColumnsRenamed({"n_good": "good", "n_toxic": "toxic"})


def survivors(found: DataFrame) -> DataFrame:
    """``part, subset, n, good, toxic`` of ``failure_counts``: documents of each part that fail no filter of each of the 32 subsets (bits, A the lowest).

    One cube over the flags and the part: the grouping set of a subset's flags and the part has, in
    the row where those flags are all false, its survivors. Subsets that nothing survives have zeros.
    """
    sums = [F.sum(c).alias(c) for c in COUNTS]
    taken = sum(((F.lit(1) - F.grouping(f)) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    cubed = found.cube("part", *FILTERS).agg(*sums, F.grouping("part").alias("over_parts"), taken.cast("int").alias("subset"))
    rows = cubed.where("over_parts = 0").where(~F.greatest(*[F.coalesce(f, F.lit(False)) for f in FILTERS]))
    rows = rows.select("part", "subset", *COUNTS)
    subsets = found.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return subsets.join(rows, ["part", "subset"], "left").fillna(0, list(COUNTS))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of every order of the five, in each part of ``docs``.

    ``docs`` has ``doc_id, text, source``, ``labels`` has ``doc_id, quality, toxic``; for odd rows
    see ``failure_counts``. A step is a pair of subsets of filters, before and with its own; what it
    removes is what the first leaves and the second does not.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``.
    """
    left = cut(survivors(failure_counts(docs, labels)))  # 32 rows a part
    steps = []
    for order in permutations(range(len(FILTERS))):
        word, before = "".join(FILTERS[i] for i in order), 0
        for k, i in enumerate(order):
            steps.append((word, k + 1, i, before, before | 1 << i))
            before |= 1 << i
    plan = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int, after int")
    at = lambda name, column: left.select("part", F.col("subset").alias(column), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])
    # What a filter fails at all, and alone: two pairs of subsets for each filter.
    own = docs.sparkSession.createDataFrame([(i, 0, 1 << i, ALL ^ 1 << i, ALL) for i in range(len(FILTERS))], "filter int, none int, only int, others int, every int")
    fails = at("none", "none").join(F.broadcast(own), "none")  # five rows
    for name, column in (("only", "only"), ("others", "others"), ("every", "every")):
        fails = fails.join(at(name, column), ["part", column])
    fails = fails.select("part", "filter", (F.col("none_n") - F.col("only_n")).alias("fails"), (F.col("others_n") - F.col("every_n")).alias("unique_fails"))
    rows = at("before", "before").join(F.broadcast(plan), "before").join(at("after", "after"), ["part", "after"])  # 600 rows
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    rows = rows.withColumns({"removed": lost("n"), "good_lost": lost("good"), "toxic_lost": lost("toxic")}).join(fails, ["part", "filter"])
    rows = rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))  # 120 rows
    return rows.select("part", "filter_order", "step", F.col("after_n").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
