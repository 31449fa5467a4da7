"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, passed over up to three times.
A document's virtual finish time is the source's words up to and including it, divided by
the source's target; serving documents in order of that time gives each source its share
at every moment, and the mix ends at the total budget. Nothing is ordered in one task: the
running sums are kept by ranges of the shuffle hash, and the global order by ranges of the
finish time, of which only the one that the budget falls into is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, free_name, table, word_count

#: A source is passed over this often at most.
PASSES = 3
#: Documents in a range of the shuffle hash, on average, and ranges in a group of them: running sums are made in these three steps.
RANGE = 250
GROUP = 1000
#: Cells that the finish times are dealt into, over and over, to find the end of the mix.
CELLS = 4096
#: Finish times that are few enough to order in one task.
FEW = 20_000


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """A uniform number of 60 bits from a digest of id and text; the same in any engine that has MD5."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def _weighed(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, weight, most)``: weights 1, 2, 3 and again, in code point order of the sources, null last.

    Sources are sorted over all partitions; a source's rank is its place in its partition and
    the counts of the partitions before, which is one number a partition.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = durable(ranged)
    before, at = {}, 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):
        before[part], at = at, at + n
    offsets = sizes.sparkSession.createDataFrame(sorted(before.items()), "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weighed = ranged.join(F.broadcast(offsets), "part").withColumn("weight", (rank % 3 + 1).cast("long"))
    return durable(weighed.select("source", "source_size", "weight", (F.lit(PASSES) * F.col("source_size")).alias("most")))


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Sources in code point order, null last, weigh 1, 2, 3 and so on again. They share the
    total by weight; none gets over three times its size, and what it would is shared anew
    until none is above. Each sharing is one sum over the sources.
    """
    weighed = _weighed(sizes)
    ratio = F.col("most") / F.col("weight")
    held, level = -1, None  # sources held at their limits, and what a unit of weight gets
    while True:
        limited = F.lit(False) if level is None else ratio < F.lit(level)
        row = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(limited, F.col("most")).otherwise(F.lit(0))).alias("held"),
            F.sum(F.when(limited, F.lit(0)).otherwise(F.col("weight"))).alias("weights"),
            F.sum(limited.cast("long")).alias("n"),
        ).first()
        if not row["weights"] or row["n"] == held:
            break
        held, level = row["n"], (row["total"] - row["held"]) / row["weights"]
    share = F.col("weight") * F.lit(level)
    return weighed.select("source", "source_size", "weight", F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share).cast("double").alias("target"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        shuffle_key(F.col("doc_id"), F.col("text")).alias("key"),
    )


def _served(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, key, size, n, source_size, target, copies)`` of the different rows of ``docs(doc_id, text, source)``, n of each."""
    each = durable(_keyed(docs).groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n")))
    total = each.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("words")).first()
    ranges = max(1, -(-total["rows"] // RANGE))
    each = each.withColumn("range", F.floor(F.col("key") / F.lit((1 << 60) / ranges)).cast("long"))

    words = F.sum(F.col("size") * F.col("n"))
    by_range = durable(each.groupBy("source", "range").agg(words.alias("words")).withColumn("group", F.floor(F.col("range") / GROUP).cast("long")))
    by_group = by_range.groupBy("source", "group").agg(F.sum("words").alias("words"))
    earlier = lambda *by, order: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_group = by_group.select(F.col("source").alias("s"), F.col("group").alias("g"), earlier("source", order="group").alias("base"))
    starts = by_range.withColumn("start", earlier("source", "group", order="range"))
    starts = starts.join(by_group, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).select("source", "range", (F.col("start") + F.col("base")).alias("start"))
    source = targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")))
    starts = starts.join(source, starts["source"].eqNullSafe(source["source"])).select(starts["source"].alias("s"), F.col("range").alias("r"), "start", "source_size", "target")

    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    served = each.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(inside))
    served = served.join(starts, served["source"].eqNullSafe(starts["s"]) & (served["range"] == starts["r"]))
    passes = F.transform(F.sequence(F.lit(0), F.lit(PASSES - 1)), lambda p: (p * F.col("source_size") + F.col("start") + F.col("upto")) / F.col("target"))
    served = durable(served.select("doc_id", "source", "key", "size", "n", "source_size", "target", F.when(F.col("target") > 0, passes).otherwise(F.array()).alias("finish")))
    copies = F.size(F.filter("finish", lambda t: t <= F.lit(_end(served, total["words"]))))
    return served.select("doc_id", "source", "key", "size", "n", "source_size", "target", copies.cast("long").alias("copies"))


def plan_mix(docs: DataFrame) -> DataFrame:
    """How often the mix takes each row of ``docs(doc_id, text, source)``.

    Returns ``(doc_id, size, source_size, target, taken, copies)``, a row for each row of
    docs. size is the number of words (null or empty text: 0) and taken is size times
    copies. Documents without words finish with the one before them and count nothing. Rows
    are told apart by id and text; rows that agree in both and in source finish together, at the
    time of the last of them. A null source is a source of its own. Other columns are
    ignored; no rows give no rows.
    """
    served = _served(docs)
    each = served.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _end(served: DataFrame, budget: int) -> float:
    """The finish time of the last document within the budget, all sources taken in order of time.

    Times are dealt into equal cells whose sums find the one that the budget falls into;
    that cell is dealt anew until it is small enough to order.
    """
    queue = served.where("size > 0").select((F.col("size") * F.col("n")).alias("size"), F.explode("finish").alias("time"))
    low, high, used = 0.0, 4.0, 0  # at time 1 all sources have met their targets
    rising = Window.orderBy("cell")
    while True:
        part = queue.where((F.col("time") > low) & (F.col("time") <= high))
        cell = F.floor((F.col("time") - F.lit(low)) * F.lit(CELLS / (high - low))).cast("long")
        sums = part.groupBy(cell.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("time").alias("last"))
        row = (
            sums.withColumn("running", F.sum("words").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("previous", F.lag("last").over(rising))
            .where(F.col("running") + used > budget)
            .orderBy("cell")
            .limit(1)
            .collect()
        )
        if not row:
            return high
        used += row[0]["running"] - row[0]["words"]
        low, high = low if row[0]["previous"] is None else row[0]["previous"], row[0]["last"]
        if row[0]["n"] <= FEW or high <= low * (1 + 1e-12):
            break
    sums = queue.where((F.col("time") > low) & (F.col("time") <= high)).groupBy("time").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    end = sums.withColumn("running", running).where(F.col("running") + used <= budget).agg(F.max("time")).first()[0]
    return low if end is None else end


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``(size, source_size, target, taken, copies)``.

    A plan column whose name docs already has is called mix_ and its name, underscored while
    that is taken too. Rows without an id, and rows that share one, are taken each by its own
    text, as in plan_mix().
    """
    plan = _served(docs).where("copies > 0").withColumn("taken", F.col("size") * F.col("copies"))
    shown = {c: c if c.lower() not in {x.lower() for x in docs.columns} else free_name(f"mix_{c}", docs) for c in ("size", "source_size", "target", "taken", "copies")}
    own = {c: free_name(f"mix_row_{c}", docs) for c in ("doc_id", "source", "key", "size")}
    of = {c: f"of_{own[c]}" for c in own}
    keyed = docs.withColumns(
        {
            own["doc_id"]: F.col("doc_id").cast("long"),
            own["source"]: F.col("source").cast("string"),
            own["size"]: word_count(F.col("text").cast("string")),
            own["key"]: shuffle_key(F.col("doc_id").cast("long"), F.col("text")),
        }
    )
    plan = plan.select(*(F.col(c).alias(of[c]) for c in of), *(F.col(c).alias(f"plan {c}") for c in shown))
    same = (F.col(own["key"]) == F.col(of["key"])) & (F.col(own["size"]) == F.col(of["size"])) & F.col(own["doc_id"]).eqNullSafe(F.col(of["doc_id"])) & F.col(own["source"]).eqNullSafe(F.col(of["source"]))
    return keyed.join(plan, same).select(*docs.columns, *(F.col(f"`plan {c}`").alias(shown[c]) for c in shown))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM s WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(weight * (SELECT max(level) FROM r WHERE level <= ratio), (3 * source_size)::DOUBLE) AS target
  FROM r),
f AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.key, d.source,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size RANGE UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT size, unnest([upto / target, (source_size + upto) / target, (2 * source_size + upto) / target]) AS time
  FROM f WHERE target > 0 AND size > 0),
c AS (SELECT time, sum(sum(size)) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS running FROM q GROUP BY time),
e AS (SELECT coalesce(max(time), 0) AS stop FROM c WHERE running <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target,
       (CASE WHEN target > 0 THEN size * ((upto / target <= stop)::INT + ((source_size + upto) / target <= stop)::INT + ((2 * source_size + upto) / target <= stop)::INT) ELSE 0 END)::BIGINT AS taken
FROM f, e
"""
