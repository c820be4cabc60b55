"""Token-id output: one concatenated id array in shards, document boundaries Elias-Fano encoded.

write_token_files() orders documents by doc_id (nulls first; equal ids in any order), encodes their whole texts and
writes a table of shards through Spark's own committer, so any store that Spark can write holds it and lost executors
leave no half-written shard. A shard row has `part`, `seq`, `start` (ids of the part before it), `n_docs`, `n_tokens`
and `payload`, the shard's file image:

    "EFTK", u8 version, u8 bytes an id (2 or 4), u16 0, u64 documents, u64 ids, u64 documents without doc_id,
    i64 least doc_id, Elias-Fano(doc_id - least), Elias-Fano(end of each document), ids little-endian

export_shards() puts the images into plain files for trainers. Parts are ranges of doc_id, in order.

Null texts are empty, and an empty text has the end id alone. Very long texts make a shard of their own. An empty
table gives a table without shards. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import BROADCAST_ROWS, few_files, pieces, scratch, tidy
from .elias_fano import EliasFano

#: Ids after which a shard is closed.
SHARD_TOKENS = 2 << 20
#: Documents whose boundaries are selected at once.
BLOCK_DOCS = 4096
#: Tasks that a core gets at most: each makes a file of shards.
WAVES = 4
#: Ids hardly compress, and Parquet's codecs keep direct buffers of a page's size for each core. It looks at a page's size after 100 rows
#: unless told so: pages of 100 shards would stand in memory.
#: Spark's reader holds up to 4,096 rows of a row group at once, so a group has a few shards only.
_PLAIN = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": "4"}
_HEAD = struct.Struct("<4sBBHQQQq")
_SHARDS = "part int, seq int, start long, n_docs long, n_tokens long, payload binary"


@dataclass
class Shard:
    """A shard's file image, opened."""

    n_docs: int
    unknown: int  # documents without doc_id, which stand first
    least: int
    keys: EliasFano
    ends: EliasFano
    ids: np.ndarray

    @classmethod
    def build(cls, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
        known = np.array([x for x in doc_ids if x is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        head = _HEAD.pack(b"EFTK", 1, width, 0, len(doc_ids), len(ids), len(doc_ids) - len(known), least)
        return b"".join([head, EliasFano.build(known - least).to_bytes(), EliasFano.build(np.cumsum(lengths)).to_bytes(), ids.astype(f"<u{width}").tobytes()])

    @classmethod
    def open(cls, data: bytes) -> Shard:
        magic, version, width, _, docs, tokens, unknown, least = _HEAD.unpack_from(data, 0)
        if magic != b"EFTK" or version != 1:
            raise ValueError("not a token shard")
        keys, at = EliasFano.from_bytes(data, _HEAD.size)
        ends, at = EliasFano.from_bytes(data, at)
        ids = np.frombuffer(data, f"<u{width}", tokens, at)
        return cls(docs, unknown, least, keys, ends, ids)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self, block: int = BLOCK_DOCS):
        """(doc_ids, starts, ends) of the documents in order, a block at a time, each block by selects of its own."""
        for lo in range(0, self.n_docs, block):
            hi = min(lo + block, self.n_docs)
            ends = self.ends.select_range(lo, hi)
            starts = np.concatenate([[self.ends.select(lo - 1) if lo else 0], ends[:-1]])
            none = min(max(self.unknown - lo, 0), hi - lo)
            known = self.keys.select_range(lo + none - self.unknown, hi - self.unknown) + self.least
            yield pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(known, pa.int64())]), starts, ends


def _runs(batch: pa.RecordBatch):
    """(part, rows) of a batch; the rows of a part stand together."""
    part = np.asarray(batch.column(2))
    edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]).tolist()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            yield int(part[lo]), batch.slice(lo, hi - lo)


def _encode(vocabulary: str, end: int, shard_tokens: int, cache_units: int, batches):
    encoder = bpe.encoder(vocabulary, cache_units)
    part = None
    seq = start = size = 0
    keys, lengths, ids = [], [], []

    def closed():
        nonlocal seq, start, size
        payload = Shard.build(keys, np.concatenate(lengths), np.concatenate(ids))
        row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start]), pa.array([len(keys)]), pa.array([size]), pa.array([payload], pa.binary())], names=["part", "seq", "start", "n_docs", "n_tokens", "payload"])
        seq, start, size = seq + 1, start + size, 0
        keys.clear(), lengths.clear(), ids.clear()
        return row

    for batch in batches:
        for own_part, rows in _runs(batch):
            if own_part != part:
                if keys:
                    yield closed()
                part, seq, start = own_part, 0, 0
            for piece in pieces(rows, "text", min(2 << 20, 4 * shard_tokens)):
                own, n = encoder.encode(piece.column(1), end)
                keys += piece.column(0).to_pylist()
                ids.append(own)
                lengths.append(n)
                size += len(own)
                if size >= shard_tokens:
                    yield closed()
    if keys:
        yield closed()


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 0, shard_tokens: int = SHARD_TOKENS, cache_units: int = bpe.CACHE_UNITS) -> DataFrame:
    """Writes the shard table at path and returns it. cache_units: pre-tokens that a worker keeps; fewer need less memory and more time.

    A task may write several parts one after another, so that files do not grow in number with the parts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = few_files(ordered.withColumn("part", F.spark_partition_id()), WAVES).mapInArrow(tidy(partial(_encode, vocabulary or bpe.default_vocabulary(), end, shard_tokens, cache_units)), _SHARDS)
    shards.write.mode("overwrite").options(**_PLAIN).parquet(path)
    return open_token_files(docs.sparkSession, path)


def open_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARDS).parquet(path)


def with_global_start(shards: DataFrame) -> DataFrame:
    """Shards with `before`, the ids of all parts before theirs.

    Two passes of prefix sums: a shard carries its start within its part; here the parts' totals, one row for each
    partition of the writing job, are summed up in order. That frame is broadcast only up to BROADCAST_ROWS rows.
    """
    from pyspark.sql import Window

    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    few = totals.count() <= BROADCAST_ROWS
    return shards.join(F.broadcast(before) if few else before, "part")


def _documents(batches):
    for batch in batches:
        for before, start, payload in zip(*(batch.column(batch.schema.get_field_index(x)) for x in ("before", "start", "payload")), strict=True):
            shard = Shard.open(payload.as_buffer())
            ids = shard.ids.astype("<u4")
            first = start.as_py() + before.as_py()
            for keys, starts, ends in shard.documents():
                # offsets of Arrow's binary arrays are 32-bit: up to 2**28 ids at once
                at = 0
                while at < len(ends):
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 22), side="right")))
                    offsets = np.append(starts[at:to], ends[to - 1]) - starts[at]
                    data = ids[starts[at] : ends[to - 1]]
                    blob = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(data)])
                    yield pa.record_batch([keys.slice(at, to - at), pa.array(starts[at:to] + first), pa.array(ends[at:to] - starts[at:to]), blob], names=["doc_id", "start", "n_tokens", "ids"])
                    at = to


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    shards = with_global_start(open_token_files(spark, path)).select("before", "start", "payload")
    return few_files(shards, WAVES).mapInArrow(tidy(_documents), "doc_id long, start long, n_tokens long, ids binary")


def export_shards(spark: SparkSession, path: str, folder: str) -> None:
    """Writes each shard's image to folder/part-seq.eftk, from the executors; the folder must be mounted by all of them."""

    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            to = f"{folder}/{r.part:06d}-{r.seq:06d}.eftk"
            with open(f"{to}.{os.getpid()}", "wb") as f:
                f.write(r.payload)
            os.replace(f"{to}.{os.getpid()}", to)

    open_token_files(spark, path).select("part", "seq", "payload").foreachPartition(put)


def op4_token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch(spark, "tokens")
    write_token_files(docs, path, end=0)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
