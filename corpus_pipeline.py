"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, PII masking, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept. run() writes a stage's rows
as Parquet to the shared folder of the session and rereads them as the next stage's documents. Stages 1 to 4 return
the columns of documents; the last adds `ids` and `decoded`. What a stage has written is removed once the next one is
written; what the last one reads stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listloom.llm import bpe, decontaminate, langid, minhash, pii
from listloom.sources.folders import remove, shared_folder

STAGES = [
    ("language_id", langid.stage),
    ("minhash", minhash.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", pii.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL can't express the learned stages; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
