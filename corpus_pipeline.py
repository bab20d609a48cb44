"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. run() writes each stage's result in the shared folder and reads it
again before the next, so a lost executor costs one stage at most.

Edge cases: the stages keep rows with null or empty texts (nothing rejects them); see the operators
for ties, repeated rows and extra columns, which are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from tallyworks.llm.common import free_name, materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from labelled rows outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name("_toxicity", docs.columns)
    return toxicity.scores(docs, model, docs.columns, score).where(F.col(score) < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later ones without the line blocks of earlier ones; n_chars follows the text."""
    own = {c: free_name(f"_own_{c}", docs.columns) for c in docs.columns if c in ("n_lines", "n_removed", "blocks")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, n_tokens, and whether the ids decode to the text's bytes."""
    return bpe.encode_documents(docs, bpe.public_vocabulary(), check=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: Learned scores, MinHash and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
