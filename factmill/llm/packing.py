"""Packing by concatenation: documents in doc_id order form one id stream, cut into windows of a fixed length.

The stream is the token shard table of token_files. Two passes of prefix sums give each shard its global offset: a
shard carries its start within its part, and the parts' totals are summed up in order. Each shard is then cut
at the multiples of the window length; a document's ids in one window are a piece. A window that lies in one shard is whole at once; one that
crosses an edge comes as a boundary record from each shard that has a part of it, and the records are put together by sequence_id.

Every id lies in one piece, and only the last window is short. Null and empty texts have the end id alone. An empty
table gives no pieces. Documents with equal or null doc_id keep their own pieces.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE_UNITS
from .common import few_files, scratch, tidy
from .token_files import WAVES, Shard, open_token_files, with_global_start, write_token_files

WINDOW = 2048
#: Ids after which a shard is closed: of 512 KB, since the JVM and Arrow handle each shard as one value, at several places at once.
SHARD_TOKENS = 1 << 18
_PIECE = "struct<doc_id:bigint,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,offset:bigint>"


def _shards(batches):
    for batch in batches:
        for before, start, payload in zip(*(batch.column(batch.schema.get_field_index(x)) for x in ("before", "start", "payload")), strict=True):
            yield before.as_py() + start.as_py(), Shard.open(payload.as_buffer())


def _windows(window: int, with_ids: bool, batches, whole: bool | None = None):
    """A record for each window of each shard, whole or in part; its pieces, and its ids if asked for. whole: only those that are, or are not."""
    for base, shard in _shards(batches):
        ids = shard.ids.astype("<u4")
        data = memoryview(ids).cast("B")
        held, end = None, base  # pieces of the last window so far, which may go on in the next block
        inner, outer = -(-base // window), (base + len(ids)) // window  # the whole windows are those from inner to before outer
        for keys, starts, ends in shard.documents():
            lo, hi = base + starts, base + ends
            if whole is not None:
                inside, outside = (lo < outer * window) & (hi > inner * window), (lo < inner * window) | (hi > outer * window)
                some = np.flatnonzero(inside if whole else outside)
                keys, lo, hi = keys.take(pa.array(some)), lo[some], hi[some]
            n = (hi - 1) // window - lo // window + 1  # pieces of each document
            doc = np.repeat(np.arange(len(n)), n)
            sequence = lo[doc] // window + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            if whole is not None:
                some = np.flatnonzero(((sequence >= inner) & (sequence < outer)) == whole)
                doc, sequence = doc[some], sequence[some]
                if not len(doc):
                    continue
            begin = np.maximum(lo[doc], sequence * window)
            stop = np.minimum(hi[doc], (sequence + 1) * window)
            crc = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((begin - base).tolist(), (stop - base).tolist(), strict=True)], np.int64)
            columns = [begin - lo[doc], stop - begin, crc, (hi - lo)[doc], begin - sequence * window]
            pieces = pa.StructArray.from_arrays([keys.take(pa.array(doc)), *map(pa.array, columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"])
            if held is not None:
                pieces, sequence = pa.concat_arrays([held[0], pieces]), np.concatenate([held[1], sequence])
            last = int(np.searchsorted(sequence, sequence[-1]))
            yield from _records(window, base, end, pieces.slice(0, last), sequence[:last], sequence[last] * window, ids if with_ids else None)
            held, end = (pieces.slice(last), sequence[last:]), max(base, int(sequence[last]) * window)
        if held is not None:
            yield from _records(window, base, end, *held, base + len(ids), ids if with_ids else None)


def _records(window: int, base: int, begin: int, pieces: pa.StructArray, sequence: np.ndarray, stop: int, ids: np.ndarray | None):
    """The windows of the stream from begin to stop with their pieces."""
    if not len(sequence):
        return
    first = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
    starts = np.maximum(sequence[first] * window, begin)
    ends = np.minimum((sequence[first] + 1) * window, stop)
    for at in range(0, len(first), 256):
        to = min(at + 256, len(first))
        bounds = np.append(first[at:to], first[to] if to < len(first) else len(sequence))
        columns = [pa.array(sequence[first[at:to]]), pa.array(starts[at:to] % window), pa.array(ends[at:to] - starts[at:to]), pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pieces.slice(bounds[0], bounds[-1] - bounds[0]))]
        names = ["sequence_id", "offset", "length", "pieces"]
        if ids is not None:
            columns.append(pa.array([ids[a - base : b - base].tobytes() for a, b in zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True)], pa.binary()))
            names.append("ids")
        yield pa.record_batch(columns, names=names)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = 1, vocabulary: str | None = None, cache_units: int = CACHE_UNITS) -> DataFrame:
    """Encodes docs into a shard table at path; one row for each piece."""
    write_token_files(docs, path, vocabulary, end, SHARD_TOKENS, cache_units)
    return packed_pieces(docs.sparkSession, path, window)


def packed_sequences(spark: SparkSession, path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """sequence_id, length, pieces and, if asked for, ids (little-endian unsigned 32-bit): the sequences themselves, the last one short.

    The shards are read once for the whole windows and once for the boundary records (two of a shard at most), whose other windows are not cut.
    """
    shards = few_files(with_global_start(open_token_files(spark, path)).select("before", "start", "payload"), WAVES)
    schema = f"sequence_id long, offset long, length long, pieces array<{_PIECE}>" + ", ids binary" * with_ids
    inner, edges = (shards.mapInArrow(tidy(partial(_windows, window, with_ids, whole=x)), schema) for x in (True, False))
    own = [F.col("ids")] if with_ids else []
    whole = inner.select("sequence_id", "length", "pieces", *own)
    records = F.sort_array(F.collect_list(F.struct("offset", "pieces", *own)))
    edge = edges.groupBy("sequence_id").agg(F.sum("length").alias("length"), records.alias("r"))
    joined = [F.aggregate(F.col("r.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")] if with_ids else []
    return whole.unionByName(edge.select("sequence_id", "length", F.flatten("r.pieces").alias("pieces"), *joined))


def packed_pieces(spark: SparkSession, path: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece of the sequences."""
    rows = packed_sequences(spark, path, window, with_ids=False).select("sequence_id", F.explode("pieces").alias("p"))
    return few_files(rows.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset"), WAVES)


def op8_packing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs, scratch(spark, "pack"))
