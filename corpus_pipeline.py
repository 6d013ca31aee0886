"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Language ID and toxicity drop the documents they reject, the n-gram join keeps one document of each group of near duplicates,
decontamination drops documents that hold a benchmark item, and packing lays the rest out in sequences.

All stages but the last return the columns of documents, whatever these are called. Null ids and repeated rows are documents like any other;
null and empty texts go at the first stage, which can't tell their language; texts of any length are read whole; an empty table gives
no sequences. Each stage's docstring tells what it does with ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import discard, materialize
from pulsegrid.llm.decontaminate import drop_contaminated
from pulsegrid.llm.language_id import keep_identified
from pulsegrid.llm.ngram_join import one_of_each
from pulsegrid.llm.packing import pack_documents
from pulsegrid.llm.toxicity import drop_toxic

STAGES = [
    ("language_id", keep_identified),
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: The learned stages and the tokenizer have no SQL form; tests hold each stage against a plain version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
