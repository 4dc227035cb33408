"""Mixing sources to target weights by fitting each source's budget as a subset sum."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Budgets up to so many words are fitted by dynamic programming; more is first filled from the longest documents.
DP_WORDS = 1 << 14
#: Each class of equal sizes is dealt into so many buckets by hash at least, so that no task ranks a whole class; more where the session has more shuffle partitions.
BUCKETS = 64


def fit_budget(counts: dict[int, int], budget: int, dp_words: int = DP_WORDS) -> dict[int, int]:
    """How many documents to take of each size so that their words come near ``budget`` from below.

    A budget of at most ``dp_words`` is met by the best subset sum, by bounded-knapsack dynamic
    programming over bit sets of reachable sums (each count split into powers of two). Of a larger one
    every size first gives its share of documents in proportion; of the documents left, the longest
    that fit are taken until the rest is within ``dp_words``; the best subset sum of the documents left then
    meets that rest.
    """
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    whole = sum(s * n for s, n in counts.items())
    if budget <= 0 or not whole:
        return {}
    if budget >= whole:
        return counts
    take = {s: n * budget // whole if budget > dp_words else 0 for s, n in counts.items()}
    rest = budget - sum(s * n for s, n in take.items())
    for s in sorted(counts, reverse=True):
        if rest <= dp_words:
            break
        more = min(counts[s] - take[s], max(0, (rest - dp_words) // s + 1), rest // s)
        take[s] += more
        rest -= s * more
    items = []
    for s in sorted(counts, reverse=True):
        left, k = min(counts[s] - take[s], rest // s), 1
        while left > 0:
            k = min(k, left)
            items.append((s, k))
            left, k = left - k, k * 2
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for s, k in items:
        new = (reach | reach << s * k) & mask
        steps.append((s, k, reach))
        reach = new
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            take[s] += k
            at -= s * k
    return take


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Takes of one source's size classes; the rows are its distinct sizes."""
    target, whole = pdf["target"].iloc[0], int(pdf["source_size"].iloc[0])
    repeats = int(target // whole) if whole else 0
    take = fit_budget(dict(zip(pdf["size"].astype(int), pdf["n"].astype(int), strict=True)), round(target - repeats * whole))
    return pdf.assign(repeats=repeats, take=[take.get(int(s), 0) for s in pdf["size"]])[["src", "size", "repeats", "take"]]


def source_targets(totals: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds ``target`` to ``totals (src, source, source_size)``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share the total of all
    sizes by weight; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight, again and again until none is above.
    """
    spark = totals.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(
        totals.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    base, at = [], 0
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        base.append((r.part, at))
        at += r["count"]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("base")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ordered = cut(ordered.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part").withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "sources")
    whole = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    rate, full = (whole[0] or 0) / (whole[1] or 1.0), -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(rate)
        s = ordered.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if s[2] == full or not s[1]:
            break
        full, rate = s[2], ((whole[0] or 0) - (s[0] or 0.0)) / s[1]
    return ordered.select("src", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(float(rate))).alias("target"))


def mix_sources(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs (doc_id, text, source)``.

    size is the number of words (runs other than ASCII white space); a null or empty text has 0 and
    is taken 0 times. A source's target is met by whole repeats of all its documents plus a subset
    of them: sizes are counted exactly, ``fit_budget`` says how many documents of each size to take
    and the seeded hash of (doc_id, text) says which, so reruns agree. taken is size times the times
    the document is taken, never over ``most`` times. A null source is a source of its own, apart
    from the empty one, and comes last. Rows with null doc_id and repeated rows are documents like
    any other; an empty table gives no rows. Other columns than those and those in ``carry`` aren't
    read; columns named in ``carry`` are returned inside the struct ``row``.
    """
    ship(docs.sparkSession)
    src = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", src.alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed.alias("h"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")),
        "mix",
    )
    counted = cut(sized.groupBy("src", "size", "bucket").agg(F.first("source").alias("source"), F.count("*").alias("m")), "mix")
    totals = counted.groupBy("src").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = source_targets(totals, weights, float(most))
    classes = counted.groupBy("src", "size").agg(F.sum("m").alias("n")).join(targets, "src")
    quotas = classes.groupBy("src").applyInPandas(_quotas, "src string, size long, repeats int, take long")
    before = F.sum("m").over(Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    dealt = (
        counted.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(quotas, ["src", "size"]).join(targets, "src")
        .select("src", "size", "bucket", "source_size", "target", "repeats", F.greatest(F.lit(0), F.least("m", F.col("take") - F.col("before"))).alias("quota"))
    )
    keys = ["src", "size", "bucket"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("h") * F.lit(1), "doc_id"))
    times = F.col("repeats") + (F.col("rank") <= F.col("quota")).cast("int")
    return (
        sized.select("doc_id", "h", *keys, *(["row"] if carry else [])).withColumn("rank", rank).join(cut(dealt, "mix"), keys)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"), times.cast("int").alias("times"), *(["row"] if carry else []))
    )
