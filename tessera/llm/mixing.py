"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, table

WORD = "[^\\x20\\x09-\\x0D]+"
#: A source's rows are dealt by the first hex digits of their hash, three or as many as leave about so
#: many rows or fewer in a bucket; only the rows of the bucket in which the fraction ends are ordered.
DIGITS, BUCKET_ROWS = 3, 250_000
#: Up to so many sources, their table (about 60 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: float = 3, budget: float = 1.0, weights: int = 3) -> DataFrame:
    """Water-filling over (source, source_size): adds weight and target.

    Sources in order of code points, null last, weigh 1, 2, ..., ``weights``, repeating. They share
    ``budget`` times all sizes; a target stops at ``max_epochs`` times its source's size, and the
    excess goes to the others by weight until none is above. Filling by weight raises one level,
    and a source is clamped when the level passes cap / weight: in the order of that ratio, level i
    = (budget - caps before i) / (weights from i on), and the first level that is not above its own
    ratio holds. Sizes of 0 have target 0.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % weights + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(every).cast("double") * F.lit(float(budget))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (total - F.col("caps_before")) / F.col("weights_left")).withColumn("no", F.row_number().over(by_ratio))
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("no", "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("water")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, max_epochs: float = 3, budget: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and the words taken of it.

    With ``keep`` it returns these input columns and ``__repeats`` instead, from another reading
    of ``docs`` rather than by a join.

    With r = target / source_size, every document is taken floor(r) times; the rest of the target
    is filled with documents in the order of their seeded hash, up to the one whose middle passes
    it, so that a source's words differ from its target by at most half a document. ``taken`` is
    size times repetitions. A null text has size 0, a null source is a source (the last one), a
    null id is hashed as an empty one; repeated rows are rows of their own; an empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    own = [F.col(f"`{c}`").alias(f"__in_{c}") for c in keep or []]
    narrow = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), key.alias("key")]
    rows = scratch.save(docs.select(*narrow))
    n, digits = rows.count(), DIGITS
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    bucket = F.conv(F.substring("key", 1, digits), 16, 10).cast("long")
    rows = rows.withColumn("bucket", bucket)
    summed = scratch.save(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    plan = targets(summed.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs, budget)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = scratch.save(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    small = plan.count() <= BROADCAST_SOURCES
    sized = F.broadcast(plan) if small else plan
    # The bucket in which the running sum of words first reaches what is needed; those before it are taken.
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = summed.withColumn("sum_to", F.sum("words").over(up_to)).alias("s").join(sized.alias("p"), F.expr("s.source <=> p.source")).where("s.sum_to >= p.need")
    cut = reached.groupBy("p.no").agg(F.min(F.struct("bucket", (F.col("sum_to") - F.col("words")).alias("before"))).alias("cut")).select("no", "cut.bucket", "cut.before")
    plan = scratch.save(plan.join(cut.withColumnsRenamed({"bucket": "cut_bucket", "before": "cut_before"}), "no", "left"))
    sized = F.broadcast(plan) if small else plan
    if keep:
        rows = docs.select(*own, *narrow).withColumn("bucket", bucket)
    joined = rows.alias("r").join(sized.alias("p"), F.expr("r.source <=> p.source")).select("r.*", "p.source_size", "p.target", "p.whole", "p.need", "p.no", "p.cut_bucket", "p.cut_before")
    at_cut = F.col("bucket").eqNullSafe(F.col("cut_bucket"))
    clear = joined.where(~at_cut).withColumn("extra", F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False)))
    running = F.sum("size").over(Window.partitionBy("no").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("cut_before")
    edge = joined.where(at_cut).withColumn("extra", 2 * running - F.col("size") <= 2 * F.col("need"))
    both = clear.unionByName(edge)
    repeats = F.col("whole") + F.when(F.col("extra") & (F.col("need") > 0), 1).otherwise(0)
    if keep:
        return both.select(*(F.col(f"`__in_{c}`").alias(c) for c in keep), repeats.alias("__repeats"))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def op9_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 100 % of all words, at most 3 epochs of a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS no FROM r),
water AS (SELECT min_by(level, no) AS water FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, coalesce(least(cap, weight * water), cap) AS target FROM l LEFT JOIN water ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS running
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN need > 0 AND 2 * running - size <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
