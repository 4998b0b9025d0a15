"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage works on all that the one before it kept, which is written as Parquet and read again. Toxic documents go; of each
group of near duplicates the document of smallest id stays; documents that hold a benchmark item go; secrets are masked; what
is left is packed. All but the last stage return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import decontaminate, jaccard, packing, secrets, textkit, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near duplicates", jaccard.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]

#: The score scan, the SimHash windows and best-fit over counts aren't SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = textkit.table(spark, sf_dir, "documents")
    place = textkit.shared_folder(spark) + f"/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = textkit.written(docs, f"{place}/{k}")
    return docs
