"""The corpus pipeline: quality filter, line dedup, near-dedup, benchmark
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; ``run`` writes every stage's result as Parquet in the shared folder and
reads it again for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table
from tessera.llm.decontaminate import find_leaks
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash_forest import near_duplicates
from tessera.llm.packing import pack_documents, tokenizer_path
from tessera.llm.quality import score_quality


#: Near copies share this many hundredths of their five-word shingles.
NEAR_PERCENT = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    scored = score_quality(spark, docs, table(spark, sf_dir, "labels"))
    return scored.where("quality.kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the smallest doc_id that holds them; n_chars follows the text."""
    out = line_dedup(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays.  Rows that
    share a doc_id are one document."""
    gone = near_duplicates(spark, docs.select("doc_id", "text"), percent=NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    # sorted merge at every size, as in the operator
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    out = find_leaks(spark, docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.size("leaks") == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack_documents(spark, docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", drop_leaked),
    ("packing", pack),
]

#: The classifier's fit, the alignment and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs
