"""From raw documents to packed training sequences: five corpus operators one after another.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``. Decisions belong to rows: rows that share an id or have none are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, packing, pii, quality_classifier
from tidemark.llm.common import bounded_batches, materialise, table
from tidemark.llm.queries import tokenizer_path

#: Ids of dropped copies that may be broadcast: 8 MB of numbers.
BROADCAST_IDS = 1_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier predicts as 0."""
    bounded_batches(spark)
    own = next(name for name in ("_stats", "_stats_of_docs", "_stats_of_all_docs") if name not in docs.columns)
    # every text is read once: its statistics stay in its row, so that only they go to Python again
    known = materialise(quality_classifier.beside_statistics(docs, own), "statistics")
    model = quality_classifier.fit(known.select("doc_id", F.col(own).alias("stats")), table(spark, sf_dir, "labels"))
    return known.filter(model.of_stats(own) >= 0.3).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id, the first of equal ids.

    Verdicts belong to rows, not to ids: rows that share an id, or have none, are texts of their own.
    """
    bounded_batches(spark)
    row = next(name for name in ("_row", "_row_of_docs", "_row_of_all_docs") if name not in docs.columns)
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_dedup.near_duplicates(numbered.select(row, "text"), id_col=row).select(F.col("doc_id").alias(row), F.col("component_id").alias("_group"))
    found = materialise(found, "groups")
    # one row a group is found by a pre-aggregated minimum; the joins are by row, so a large group is no hot key
    ranked = found.join(numbered.select(row, "doc_id"), row)
    first = ranked.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))).alias("_first"))
    dropped = materialise(found.select(row).join(first.select(F.col(f"_first.{row}").alias(row)), row, "left_anti"), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return numbered.join(dropped, row, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which any benchmark window occurs."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts the characters anew."""
    bounded_batches(spark)
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; one row per piece."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Classifier, random field and tokenizer have no SQL form; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i + 1}")
    return docs
