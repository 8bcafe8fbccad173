"""The training-data pipeline: toxicity, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  ``run`` applies them to the documents table; each result is
written as Parquet to the shared folder and read again by the next stage.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from packetlake.llm import common, stages

# Toxic documents go; one document of each near-duplicate group stays (the one with the smallest
# doc_id); spans of personal data are rewritten; documents are repeated or left out until the sources
# meet their targets; what is left is packed.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_dedup", stages.drop_near_duplicates),
    ("pii", stages.rewrite_personal_data),
    ("source_mix", stages.mix_sources),
    ("packing", stages.pack_documents),
]

# Fingerprints, classifiers and tokenizers have no SQL form: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = os.path.join(common.checkpoint_dir(spark), "corpus-pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
