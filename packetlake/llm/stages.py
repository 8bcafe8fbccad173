"""Stages of the pipeline: each calls one operator and lets its decision take effect.

Every stage but the last returns the columns of its documents; empty tables,
null ids and texts, repeated rows and further columns pass as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing, pii, queries, simhash_bktree, toxicity_pu


def _whole(docs: DataFrame) -> DataFrame:
    """(row): inside the stages a document is one struct, so that no column of its can clash with theirs."""
    return docs.select(F.struct("*").alias("row"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, d, g): the whole row, its id and the hash of its text."""
    return _whole(docs).select("row", F.col("row.doc_id").cast("bigint").alias("d"), F.xxhash64("row.text").alias("g"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the classifier learns from the labels of these documents."""
    model = toxicity_pu.train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity_pu.score(_whole(docs), model, text="row.text", keep=["row"])
    return scored.where(F.col("score") < toxicity_pu.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose id names it; of the group's rows that share the id, one.

    Of a group in which no document has an id, all stay.
    """
    found = simhash_bktree.near_duplicates(docs)
    named = found.where("doc_id = component_id")
    leaders = (named.groupBy("root").agg(F.min("doc_id").alias("kept_d"), F.min("digest").alias("kept_g")).drop("root")
               .unionByName(found.where("component_id IS NULL").select(F.col("doc_id").alias("kept_d"), F.col("digest").alias("kept_g")).distinct()))
    same = F.col("d").eqNullSafe(F.col("kept_d")) & F.col("g").eqNullSafe(F.col("kept_g"))
    rest = _keyed(docs).join(common.durable(leaders), same, "left_semi")
    repeated = named.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count()
    if repeated:
        rest = rest.where("d IS NOT NULL").dropDuplicates(["d", "g"]).unionByName(rest.where("d IS NULL"))
    return rest.select("row.*")


def rewrite_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with base spans masked and disclosing terms generalised or removed."""
    return pii.sanitised(docs, pii.find_spans(docs, everywhere=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents: its taken words over its size, rounded.

    Copies stand in the order of the slots that take them: a document's n-th copy at the slot where the
    n-th round over its source begins to take it.  Documents without words cost no source anything and
    stay once, at the front.  Equal rows share their copies evenly.
    """
    placed = mixing.taken_words(*mixing.mix(docs))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    named = placed.select(F.col("doc_id").cast("bigint").alias("of_d"), F.col("digest").alias("of_g"), F.col("source").alias("of_s"), times.alias("times"), "rounds")
    counts = named.groupBy("of_d", "of_g", "of_s").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("equal_rows"))
    # At most as many rounds as the mix goes over a source, so an array of them is short.
    slots = (named.select("of_d", "of_g", "of_s", F.explode("rounds").alias("r"))
             .groupBy("of_d", "of_g", "of_s", "r.round").agg(F.min("r.slot").alias("slot"))
             .groupBy("of_d", "of_g", "of_s").agg(F.array_sort(F.collect_list("slot")).alias("slots")))
    key = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ("of_d", "of_g", "of_s")]
    slots = slots.select(*[F.col(c).alias(f"s_{c}") for c in ("of_d", "of_g", "of_s")], "slots")
    plan = common.durable(counts.join(slots, key[0] & key[1] & key[2], "left").drop("s_of_d", "s_of_g", "s_of_s"))
    same = (F.col("d").eqNullSafe(F.col("of_d")) & F.col("g").eqNullSafe(F.col("of_g"))
            & F.col("row.source").cast("string").eqNullSafe(F.col("of_s")))
    copies = F.round(F.col("times") / F.col("equal_rows")).cast("int")
    slot = F.when(F.size("slots") > 0, F.element_at("slots", F.least(F.col("copy"), F.size("slots")))).otherwise(-1)
    return (_keyed(docs).join(plan, same).where(copies > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("slot", F.coalesce(slot, F.lit(-1)))
            .repartitionByRange("slot", "d", "g").sortWithinPartitions("slot", "d", "g", "copy").select("row.*"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, see :mod:`packing`."""
    from . import packing

    return packing.pack(queries.byte_pieces(docs))
