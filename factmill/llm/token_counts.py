"""Token counts: an exact histogram of encoded lengths; suffix sums answer every context limit.

length_histogram() counts documents by number of ids. context_table() has a row for each length that occurs, taken as
a context limit: documents and tokens at, above and below it, and the tokens that are left when every document is
truncated to it. Between two lengths that occur these sums are linear in the limit, so truncated_total() and
quantile() answer any limit from the table exactly.

Null and empty texts have length 0 and count as documents. An empty table gives no rows. Copies count as often as they
occur. Other columns are not read.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, pieces, tidy

#: Lengths that one task sums up; the blocks' totals are summed up before.
BLOCK = 64


def _lengths(vocabulary: str, batches):
    encoder = bpe.encoder(vocabulary)
    for batch in batches:
        for piece in pieces(batch, "text"):
            yield pa.record_batch([pa.array(encoder.lengths(piece.column(0)), pa.int64())], names=["length"])


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length, n_docs: the count is made in each task before the shuffle, which moves a row for each length and task."""
    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(partial(_lengths, vocabulary or bpe.default_vocabulary())), "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """Suffix sums over the histogram, in two passes: totals of blocks of lengths, then within each block.

    length, n_docs, n_docs_over (longer documents), tokens_at_least (ids of documents of this length or more),
    total_docs, total_tokens, truncated_total (ids kept under this limit), quantile (share of documents within it).
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"), F.sum("bd").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_docs"), F.sum("bt").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(blocks, "block").withColumn("docs_at_least", F.col("docs_after") + F.sum("n_docs").over(within)).withColumn("tokens_at_least", F.col("tokens_after") + F.sum(F.col("n_docs") * F.col("length")).over(within))
    return s.select(
        "length",
        "n_docs",
        (F.col("docs_at_least") - F.col("n_docs")).alias("n_docs_over"),
        "tokens_at_least",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("truncated_total"),
        (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(table: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total for any limits: from the longest length within the limit, plus the rest of longer documents."""
    spark = table.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "limit long"))
    low = table.join(asked, F.col("length") <= F.col("limit"), "right").groupBy("limit").agg(F.max(F.struct("length", "truncated_total", "n_docs_over")).alias("s"))
    none = table.groupBy().agg(F.max("total_docs").alias("d"))
    return low.crossJoin(none).select("limit", F.coalesce(F.col("s.truncated_total") + F.col("s.n_docs_over") * (F.col("limit") - F.col("s.length")), F.col("d") * F.greatest("limit", F.lit(0)), F.lit(0)).alias("truncated_total"))


def quantile(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length within which at least this share of the documents lies."""
    asked = F.broadcast(table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return table.join(asked, F.col("quantile") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("length").alias("length"))


def op6_token_counts(docs: DataFrame) -> DataFrame:
    return context_table(cut(length_histogram(docs)))  # two branches read it; texts are encoded once
