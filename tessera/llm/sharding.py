"""Shards of near equal size by longest-processing-time scheduling over groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, table, text_bytes

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: A group of at least 1 / (shards * LARGE) of all bytes is scheduled by itself, so at most shards * LARGE are.
LARGE = 100
#: Smaller groups are scheduled in shards * BUNDLES bundles of whole groups.
BUNDLES = 500
#: Rows of a shard are numbered in blocks, each by a task of its own: SLOT_BLOCKS, or more of about SLOT_ROWS rows.
SLOT_BLOCKS, SLOT_ROWS = 64, 100_000


def schedule(sizes: list[tuple[int, tuple]], shards: int) -> dict[tuple, int]:
    """LPT: items by falling size (ties by key), each to the least loaded shard (ties to the lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Deal all rows into shards 0 to ``shards - 1`` by the law ``bytes``: equal texts stay together.

    Adds size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot (0, 1, ... in each
    shard, in no other order) and grown_shard (null under this law) to the columns ``keep`` (all
    by default); an input column with one of these names is replaced. A null text has 16 bytes and
    the crc32 of no bytes, and is no equal of an empty one; null ids are rows like any other;
    an empty table gives an empty result. Repeated rows are all dealt.

    What the driver schedules is bounded by the parameters above whatever the input:
    a group that is large against a shard is an item of its own, the others are items in bundles
    by the hash of their text. Hence a shard's load differs from the mean by at most the largest
    item, as with LPT over single groups.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    scratch = Scratch(spark, "sharding")
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)),
        F.col(f"`{id_col}`").alias("__id"),
        (text_bytes(text) + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("__g1"),
        F.xxhash64(F.lit("second"), text).alias("__g2"),
    )
    groups = scratch.save(rows.groupBy("__g1", "__g2").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")))
    total, n_rows = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    slot_blocks = max(SLOT_BLOCKS, n_rows // (shards * SLOT_ROWS))
    large = F.col("weight") * (shards * LARGE) >= F.lit(total)
    bundle = F.pmod(F.col("__g1"), F.lit(shards * BUNDLES))
    alone = groups.where(large).collect()
    bundles = groups.where(~large).groupBy(bundle.alias("__bundle")).agg(F.sum("weight").alias("weight")).collect()
    dealt = schedule([(r["weight"], (0, r["__g1"], r["__g2"])) for r in alone] + [(r["weight"], (1, r["__bundle"], 0)) for r in bundles], shards)
    by_group = spark.createDataFrame([(k[1], k[2], s) for k, s in dealt.items() if k[0] == 0], "__g1 long, __g2 long, __own int")
    by_bundle = spark.createDataFrame([(k[1], s) for k, s in dealt.items() if k[0] == 1], "__bundle long, __shared int")
    placed = (
        rows.withColumn("__bundle", bundle)
        .join(F.broadcast(by_group), ["__g1", "__g2"], "left")
        .join(F.broadcast(by_bundle), "__bundle", "left")
        .withColumn("shard", F.coalesce("__own", "__shared"))
        .withColumn("__block", F.pmod(F.xxhash64("__id", "__g1"), F.lit(slot_blocks)))
    )
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n")).select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__block").orderBy("__id", "__g1", "__g2")
    return placed.join(F.broadcast(starts), ["shard", "__block"]).select(
        *(F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.row_number().over(within) - 1 + F.col("__start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, 40, keep=["doc_id"])
