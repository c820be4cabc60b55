"""From raw documents to packed training sequences, in five stages; each takes (spark, docs, sf_dir).

Every stage works on all rows that the one before it kept and is written as Parquet before the next one reads it. Stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from factmill.llm.common import fresh, quoted, scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores below one half; it is fitted on the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*quoted(docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes earlier-seen lines of a word or more out; a document that loses lines and has no word left goes. n_chars follows the text."""
    count, removed = fresh(docs, "n_lines", "removed_lines")
    found = line_dedup.dedup_lines(docs, CHUNK_BYTES, (count, removed))
    left = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    kept = found.where((F.size(removed) == 0) | left)
    length = F.when(F.size(removed) == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return kept.withColumn("n_chars", length).select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five-word shingles, similarity 0.8 or more): that with the least doc_id."""
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of whose words less than a twentieth lies in passages of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in sequences of 2048 ids."""
    return packing.pack(docs, scratch(spark, "pipeline"), cache_units=CACHE_UNITS)


#: Workers live through all stages, so each stage holds less than it would alone: pre-tokens that the last one keeps, bytes of a chunk of documents.
CACHE_UNITS, CHUNK_BYTES = 150_000, 4 << 20

STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL cannot express the classifier, the fingerprints' hash or the tokenizer; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
