"""A training corpus out of ``documents``, in five stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import decontaminate, mixing, ngram_join, quality, sharding
from tessera.llm.common import Scratch, table

#: Ids of dropped documents that are broadcast at most (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score 0.3 or more); null and empty texts are scored like others."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, rules).where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates.

    Rows without an id, or with one that other rows have too, are told apart by their text: they are
    compared like others, equal ones are one document, and rows with the same id but texts that do
    not link all stay. Texts without words link with nothing and stay.
    """
    scratch = Scratch(spark, "groups")
    odd = scratch.save(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").select(F.col("doc_id").alias("__odd")))
    rows, key = docs, F.col("doc_id").cast("long")
    if odd.take(1):
        rows = docs.join(odd.withColumn("__is_odd", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("__odd")), "left").drop("__odd")
        key = F.when(F.col("__is_odd"), F.xxhash64("doc_id", "text")).otherwise(key)
    keyed = rows.withColumn("__key", key)
    found = scratch.save(ngram_join.near_duplicates(keyed, "__key"))
    # hashed keys are no ids: of each component the least id stays, whatever its key
    ids = keyed.select("__key", "doc_id").dropDuplicates(["__key"]) if odd.take(1) else None
    if ids is None:
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct()
    else:
        least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "__key")).alias("least")
        members = found.select(F.col("doc_id").alias("__key"), "component_id").distinct().join(ids.withColumnRenamed("doc_id", "id"), "__key")
        staying = members.groupBy("component_id").agg(least).select(F.col("least.__key").alias("__key"))
        gone = scratch.save(members.select("__key").join(staying, "__key", "left_anti"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = keyed.join(gone, "__key", "left_anti")
    if ids is None:
        return kept.select(*docs.columns)
    again = scratch.save(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"))
    first = F.row_number().over(Window.partitionBy("__key").orderBy("doc_id"))
    repeated = kept.join(again, "__key", "left_semi").withColumn("__no", first).where("__no = 1").select(*docs.columns)
    return kept.join(again, "__key", "left_anti").select(*docs.columns).unionByName(repeated)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one, rows of equal ids are taken each by itself."""
    taken = mixing.mix(docs, keep=docs.columns)
    return taken.where("__repeats > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__repeats")))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 40 shards of near equal bytes, whatever their ids and texts; no rows give no rows."""
    return sharding.assign(docs, 40)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: Tree growing, lasso weights and SimHash have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
