"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled by a hash and laid end to end; the
stream is cut into blocks of equal size.  The mix is a schedule of slots: the
golden-ratio point of a slot, mapped through the sources' cumulative targets,
names its source, and the slot's rank within its source names the block, around
the stream again when the source is used up.  Golden-ratio points are spread so
evenly that a source's share of any run of slots differs from its target by a
few slots only; slots at the end of the schedule make up the difference, and the
last slot of a source is cut, so a source is taken to the word of its target.
The mix is read in the order of its slots: they say when, and in which round, a document comes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import assign_index
from . import common

MAX_BLOCK_WORDS = 2_048   # words in a block of a large corpus
SLOTS_PER_SOURCE = 4_096  # in a small one, blocks are so small that a source has about as many slots
MAX_EPOCHS = 3
SLOTS_PER_BUCKET = 65_536
GOLDEN = (math.sqrt(5) - 1) / 2
CELLS = 4_096             # cells of the point line, at least, that bring points and intervals together


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, digest): the number of words of every row; null texts have none."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(text)).alias("digest"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, low): the share of each source and where its interval begins.

    Sources in code point order, null last, take the weights in turn and share
    all words by them; a target stops at ``max_epochs`` times its source and the
    excess goes to the others by weight.  Only two sums reach the driver a round.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = assign_index(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], out="_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    ranked = common.durable(ranked.select("source", "source_size", "_at", weight.alias("weight"),
                                          (F.col("source_size") * float(max_epochs)).alias("cap")))
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    per_weight = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * per_weight
        sums = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("capped"),
                          F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if not sums["weight"] or (again := (total - sums["capped"]) / sums["weight"]) <= per_weight:
            break
        per_weight = again
    target = F.least(F.col("cap"), F.col("weight") * per_weight)
    shared = common.durable(ranked.select("source", "source_size", "_at", target.alias("target")))
    # The running sum over sources: buckets of sources in order, then within each.
    shared = shared.withColumn("_all", F.lit(0)).withColumn("_b", F.floor(F.col("_at") / common.ROWS_PER_BUCKET))
    return (common.running_total(shared, ["_all"], ["_at"], F.col("target"), "_b", "low").drop("_all", "_b", "_at"))


def block_words(total: int, sources: int, max_block: int = MAX_BLOCK_WORDS, slots_per_source: int = SLOTS_PER_SOURCE) -> int:
    return max(1, min(max_block, total // (slots_per_source * max(1, sources))))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank, source_size, take): which source each slot takes, the slot's rank within it, and the words taken in all.

    Every source has a slot for each whole block of its target, rounded to words, and one for the rest.  Ranks that
    the points leave out follow at the end of the schedule; slots beyond the target are left out.
    """
    spark = targets.sparkSession
    targets = targets.where("target > 0").withColumn("take", F.round("target").cast("bigint"))
    whole = float(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("n")).first()["n"])
    n = math.ceil(whole / block)
    point = F.lit(GOLDEN) * (F.col("id") + 1)
    slots = (spark.range(n).select(F.col("id").alias("slot"), ((point - F.floor(point)) * whole).alias("point"),
                                   _div(F.col("id"), SLOTS_PER_BUCKET).alias("bucket")))
    # Cells of equal width bring a point and the few intervals around it together.
    cells = CELLS + targets.count()
    width = whole / cells if whole else 1.0
    cell = lambda c: F.least(F.floor(c / width), F.lit(cells - 1))
    spans = targets.select("source", "source_size", "take", "low", (F.col("low") + F.col("target")).alias("high"),
                           F.explode(F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("target")))).alias("cell"))
    hit = (slots.withColumn("cell", cell(F.col("point"))).join(spans, "cell")
           .where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))))
    hit = common.durable(hit.select("slot", "source", "source_size", "take", "bucket"))
    ranked = (common.running_total(hit, ["source"], ["slot"], F.lit(1), "bucket", "rank").drop("bucket")
              .where(F.col("rank") < _div(F.col("take"), block)).select("slot", "source", "rank", "source_size", "take"))
    counts = hit.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    held = F.least(F.coalesce("_n", F.lit(0)), _div(F.col("take"), block))
    rest = (targets.join(counts, F.col("source").eqNullSafe(F.col("_s")), "left").where(held * block < F.col("take"))
            .select("source", "source_size", "take", F.explode(F.sequence(held, _div(F.col("take") - 1, block))).alias("rank")))
    rest = assign_index(rest.withColumn("_null", F.col("source").isNull()), ["rank", "_null", "source"], base=n, out="slot")
    return ranked.unionByName(rest.select("slot", "source", "rank", "source_size", "take"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = 7,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix: (documents, taken parts).

    documents: (doc_id, source, size, digest, begin, source_size, target), one row per input row;
    ``begin`` is its place in its source's shuffled stream.  taken parts: (slot, source, begin, doc_id,
    digest, round, words): the words that a slot takes from a document, in its round of
    the source.  Equal rows are placed one after another, each with its own place.
    """
    sizes = document_sizes(docs, doc_id, text, source)
    sizes = common.durable(sizes.withColumn("_order", F.xxhash64("doc_id", "digest", F.lit(seed))))
    n = sizes.count()
    targets = common.durable(source_targets(sizes, weights, max_epochs))
    facts = targets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    block = block_words(int(facts["words"]), int(facts["n"]))
    # Buckets of the hash, in order, cut a hot source into parts of bounded size.
    buckets = common.bucket_count(n)
    placed = sizes.withColumn("_bucket", F.floor((F.shiftrightunsigned("_order", 32) * buckets) / F.lit(float(1 << 32))))
    placed = common.running_total(placed, ["source"], ["_order", "doc_id", "digest", "size"], F.col("size"), "_bucket", "begin")
    placed = common.durable(placed.drop("_bucket", "_order"))
    few = targets.withColumnRenamed("source", "_s")
    documents = (placed.join(few, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "low"))

    # Parts of documents by block, and the rounds of slots over each block of a source.
    end = F.col("begin") + F.col("size")
    parts = (placed.where("size > 0")
             .withColumn("block", F.explode(F.sequence(_div(F.col("begin"), block), _div(end - 1, block))))
             .withColumn("from", F.greatest(F.col("begin"), F.col("block") * block))
             .withColumn("to", F.least(end, (F.col("block") + 1) * block)))
    slots = schedule(targets, block)
    # Slot r holds the words [r*block, (r+1)*block) of the source's endless stream, which may run over its end once
    # or more: each round that it touches asks for the blocks of that round.
    first, last = F.col("rank") * block, F.least((F.col("rank") + 1) * block, F.col("take"))
    asked = (slots.withColumn("first", first).withColumn("last", last)
             .withColumn("round", F.explode(F.sequence(_div(F.col("first"), F.col("source_size")),
                                                       _div(F.col("last") - 1, F.col("source_size")))))
             .withColumn("lo", F.greatest(F.lit(0), F.col("first") - F.col("round") * F.col("source_size")))
             .withColumn("hi", F.least(F.col("source_size"), F.col("last") - F.col("round") * F.col("source_size")))
             .withColumn("block", F.explode(F.sequence(_div(F.col("lo"), block), _div(F.col("hi") - 1, block))))
             .select("slot", F.col("source").alias("_s"), F.col("block").alias("_b"), "round", "lo", "hi"))
    words = F.least(F.col("to"), F.col("hi")) - F.greatest(F.col("from"), F.col("lo"))
    taken = (parts.join(asked, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
             .withColumn("words", words).where("words > 0")
             .select("slot", "source", "begin", "doc_id", "digest", "round", "words"))
    return documents, taken


def taken_words(documents: DataFrame, taken: DataFrame) -> DataFrame:
    """``documents`` with taken: the words the mix takes of each, repeats counted, 0 if none; and rounds: the
    slots at which each round of its source begins to take it, as a sorted array of (round, slot), empty if none.

    A document with words has a place of its own in its source, so (source,
    begin) names it; documents without words are taken 0 times.
    """
    sums = (taken.groupBy(F.col("source").alias("_s"), F.col("begin").alias("_b"), "round")
            .agg(F.sum("words").alias("_words"), F.min("slot").alias("_slot"))
            .groupBy("_s", "_b").agg(F.sum("_words").alias("taken"),
                                     F.array_sort(F.collect_list(F.struct("round", F.col("_slot").alias("slot")))).alias("rounds")))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("begin") == F.col("_b")) & (F.col("size") > 0)
    none = F.array().cast("array<struct<round:bigint,slot:bigint>>")
    return (documents.join(sums, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
            .withColumn("rounds", F.coalesce("rounds", none)).drop("_s", "_b"))
