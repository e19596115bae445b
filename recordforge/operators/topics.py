"""Planning: how many records of which topic.

A topics table has `pos, topic, n`: n is null for a topic given as text only.
Ranks are made in slices of `WIDTH` positions, so no task orders a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordforge.functions.names import free_names
from recordforge.operators.inputs import global_rank, rank_within

WIDTH = 100_000


def _ranked(topics: DataFrame) -> DataFrame:
    return global_rank(topics, F.floor(F.col("pos") / WIDTH), [F.col("pos")], "_rn")


def first_topics(topics: DataFrame) -> DataFrame:
    """The first mention of each topic."""
    row = F.struct(*[c for c in topics.columns if c != "topic"])
    return topics.groupBy("topic").agg(F.min_by(row, "pos").alias("_row")).select(*["topic" if c == "topic" else F.col(f"_row.{c}").alias(c) for c in topics.columns])


def spread_evenly(topics: DataFrame, total: int) -> DataFrame:
    """n = total // k, one more for the first total % k topics; topics with 0 are dropped."""
    k = topics.agg(F.count("*").alias("_k"))
    ranked = _ranked(topics).crossJoin(F.broadcast(k))
    n = F.floor(F.lit(total) / F.col("_k")) + F.when(F.col("_rn") <= F.lit(total) % F.col("_k"), 1).otherwise(0)
    return ranked.withColumn("n", n.cast("long")).filter("n > 0").drop("_rn", "_k")


def fill_topics(topics: DataFrame, remaining: int, per_topic: int) -> DataFrame:
    """Each topic in turn takes `per_topic` until nothing remains; topics with 0 are dropped."""
    n = F.greatest(F.lit(0), F.least(F.lit(per_topic), F.lit(remaining) - F.lit(per_topic) * (F.col("_rn") - 1)))
    return _ranked(topics).withColumn("n", n.cast("long")).filter("n > 0").drop("_rn")


def new_topics(generated: DataFrame, known: DataFrame) -> DataFrame:
    return generated.join(known.select("topic").distinct(), "topic", "left_anti")


def auto_topics(known: DataFrame, n: int, spark: SparkSession | None = None) -> DataFrame:
    """The first n of auto_topic1, auto_topic2, .. that are not known: (pos, topic)."""
    taken = known.select("topic").distinct()
    most = n + taken.filter(F.col("topic").startswith("auto_topic")).count()
    free = (spark or known.sparkSession).range(1, most + 1).select(F.col("id").alias("pos"), F.concat(F.lit("auto_topic"), F.col("id")).alias("topic")).join(taken, "topic", "left_anti")
    return free.orderBy("pos").limit(n).select("pos", "topic")


def fan_out_topics(topics: DataFrame, span: int = WIDTH) -> DataFrame:
    """A topic row once for each of its n records, with k from 1.

    First in ranges of at most `span` records, which are dealt over the partitions, so one
    topic of very many records is many tasks' work and no array is longer than a range.
    """
    low, high, part = free_names(topics.columns, "_low", "_high", "_part")
    rows = topics.filter("n > 0").withColumns({low: F.lit(0).cast("long"), high: F.col("n").cast("long")})
    for size in (span * span, span):
        ranges = F.sequence(F.lit(0).cast("long"), F.floor((F.col(high) - F.col(low) - 1) / size))
        rows = rows.withColumn(part, F.explode(ranges)).withColumn(low, F.col(low) + F.col(part) * size).withColumn(high, F.least(high, F.col(low) + size))
    dealt = rows.repartition(F.xxhash64("topic", low))
    return dealt.select(*topics.columns, F.explode(F.sequence(F.col(low) + 1, F.col(high))).alias("k"))


def plan_topics(topics: DataFrame, generated: DataFrame, total: int | None, per_topic: int) -> DataFrame:
    """(kind, pos, topic, n): text topics, counted ones, then generated and automatic ones for the rest.

    Text topics share what the counted ones leave of the total; without a total
    each gets `per_topic`. Counted topics alone need a total, and may not exceed it.
    """
    unique = first_topics(topics)
    counted, text = unique.filter("n is not null"), unique.filter("n is null")
    fixed = counted.agg(F.sum("n")).first()[0] or 0
    texts = text.count()
    if total is None:
        if not texts:
            raise ValueError("counted topics need a total")
        planned_text, rest = text.withColumn("n", F.lit(per_topic).cast("long")), 0
    else:
        if fixed > total:
            raise ValueError("topics ask for more records than the total")
        planned_text, rest = spread_evenly(text, total - fixed) if texts else text, 0 if texts else total - fixed
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), "topic", F.col("n").cast("long").alias("n"))
    plan = shape(planned_text, "text").unionByName(shape(counted, "counted"))
    if rest > 0:
        fresh = fill_topics(new_topics(first_topics(generated), unique), rest, per_topic)
        left = rest - (fresh.agg(F.sum("n")).first()[0] or 0)
        plan = plan.unionByName(shape(fresh, "generated"))
        if left > 0:
            known = unique.select("topic").unionByName(generated.select("topic"))
            plan = plan.unionByName(shape(fill_topics(auto_topics(known, -(-left // per_topic)), left, per_topic), "auto"))
    return plan


def _in_slices(rows: DataFrame, keys: list[str], order: str, value: str, size: int) -> DataFrame:
    """(keys, slice, values): the values of each key in order, `size` of them a row."""
    ranked = rank_within(rows, keys, F.floor(F.col(order) / WIDTH), [F.col(order), F.col(value)], "_rank")
    part = F.floor((F.col("_rank") - 1) / size).cast("long").alias("slice")
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("value"))))
    return ranked.groupBy(*keys, part).agg(listed.alias("_l")).select(*keys, "slice", F.col("_l.value").alias("values"))


def exclude_text(topics: DataFrame, group: list[str] | None = None, size: int = WIDTH) -> DataFrame:
    """(group, slice, exclude): known topics in order, joined by commas; one row for each `size` of them."""
    return _in_slices(topics, group or [], "pos", "topic", size).select(*(group or []), "slice", F.array_join("values", ",").alias("exclude"))


def topic_history(rows: DataFrame, size: int = WIDTH) -> DataFrame:
    """(topic, slice, history): all values of a topic in the order of idx; one row for each `size` of them."""
    return _in_slices(rows, ["topic"], "idx", "value", size).withColumnRenamed("values", "history")


def earlier_example(rows: DataFrame, seed: int = 0, width: int = 100_000) -> DataFrame:
    """Adds example: the value of one earlier row of the same topic, null for the first.

    Instead of growing lists, each row draws the rank of an earlier row by a
    hash and joins it. Ranks are made in slices of `width` indexes. Rows of a
    null topic are a topic of their own.
    """
    rank, pick, of, source_rank = free_names([*rows.columns, "example"], "_rank", "_pick", "_topic", "_source")
    ranked = rank_within(rows.drop("example"), ["topic"], F.floor(F.col("idx") / width), [F.col("idx")], rank)
    h = F.conv(F.substring(F.md5(F.concat(F.col("idx").cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long")
    drawn = ranked.withColumn(pick, F.when(F.col(rank) > 1, h % (F.col(rank) - 1) + 1))
    source = ranked.select(F.col("topic").alias(of), F.col(rank).alias(source_rank), F.col("value").alias("example"))
    return drawn.join(source, F.col("topic").eqNullSafe(F.col(of)) & (F.col(pick) == F.col(source_rank)), "left").drop(rank, pick, of, source_rank)


def topic_batches(n: Column, size: int = 5) -> Column:
    """Sizes of the requests for n topics, `size` at a time."""
    k = F.ceil(n / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.least(F.lit(size), n.cast("int") - i * size))).otherwise(F.array().cast("array<int>"))


def plan_distribution(target: Column, most: int = 10) -> dict[str, Column]:
    """topics, subtopics, records and api_calls for a target number of records.

    Up to `most`: one topic, one subtopic. Else the largest divisor up to `most`
    is the number of records, and the rest is split into the two factors closest
    to its square root, the smaller one as topics.
    """
    t = target.cast("int")
    records = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda r: t % r == 0))
    rest = (t / records).cast("int")
    topics = F.array_max(F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(rest)).cast("int")), lambda d: rest % d == 0))
    small = t <= most
    a, b = F.when(small, 1).otherwise(topics), F.when(small, 1).otherwise((rest / topics).cast("int"))
    return {"topics": a.cast("int"), "subtopics": b.cast("int"), "records": F.when(small, t).otherwise(records).cast("int"), "api_calls": (1 + a + a * b).cast("int")}
