"""Rounds between chunks of documents and buckets of keys.

Operators that compare parts of all documents with each other need two kinds of places: a chunk holds whole documents
(CHUNK_BYTES of text), a bucket holds what all chunks know about a share of the keys. Packed reads the documents once, puts
each chunk into one compressed row and cuts the lineage in the shared folder. Later rounds read the rows from there; where
answers join them, they are dealt by chunk, once for all rounds that are part of one plan. In a round every chunk sends one
message to each bucket (ask), each bucket answers each chunk that asked (answer), and the chunk goes on with the answers
(resume). Messages are arrays packed by the operator, so that rows stay few and the work on them is done on whole arrays.

A chunk says each thing once, however often its documents repeat it. So a key that a third of all documents have
costs its bucket one entry for each chunk.

There are (bytes / CHUNK_BYTES) * (bytes / BUCKET_BYTES) messages in a round; with larger executors both sizes should grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import cut, input_bytes, pieces, release, tidy

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
_ASKED = "bucket int, chunk long, payload binary"
_ANSWERED = "chunk long, bucket int, round int, payload binary"


def squeeze(parts: Iterable[np.ndarray | bytes], level: int = 1) -> bytes:
    """Arrays one after another, compressed."""
    return zstandard.ZstdCompressor(level=level).compress(b"".join(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in parts))


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _wrap(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def open_chunk(payload) -> pa.Table:
    """The documents of a chunk, with all columns that were packed."""
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _pack(column: str, chunk_bytes: int, batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, size, seq = [], 0, 0

    def closed():
        nonlocal size, seq
        row = pa.record_batch([pa.array([part << 24 | seq]), pa.array([_wrap(pa.Table.from_batches(held))], pa.binary())], names=["chunk", "payload"])
        seq, size = seq + 1, 0
        held.clear()
        return row

    for batch in batches:
        for piece in pieces(batch, column, min(1 << 20, chunk_bytes)):
            # a copy: slices would keep their whole batch
            held.append(pa.RecordBatch.from_pydict({str(i): pa.concat_arrays([a]) for i, a in enumerate(piece.columns)}).rename_columns(piece.schema.names))
            size += int(pa.compute.sum(pa.compute.fill_null(pa.compute.binary_length(piece.column(piece.schema.get_field_index(column))), 0)).as_py() or 0)
            if size >= chunk_bytes:
                yield closed()
    if held:
        yield closed()


class Packed:
    """Documents in chunks. buckets: how many shares the keys are dealt into."""

    def __init__(self, docs: DataFrame, column: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES):
        total = input_bytes(docs, column)
        self.buckets = max(8, -(-total // bucket_bytes))
        self.rows = cut(docs.mapInArrow(tidy(partial(_pack, column, chunk_bytes)), "chunk long, payload binary"))

    def ask(self, say: Callable) -> DataFrame:
        """say(documents) yields (bucket, message) pairs."""

        def go(batches):
            for batch in batches:
                for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from _messages(chunk, say(open_chunk(payload.as_buffer())))

        return self.rows.mapInArrow(tidy(go), _ASKED)

    def ask_with(self, answers: DataFrame, say: Callable) -> DataFrame:
        """say(documents, {(round, bucket): answer}) yields (bucket, message) pairs."""

        def go(left, right):
            release()
            out = list(_messages(left.column(0)[0].as_py(), say(open_chunk(left.column(1)[0].as_buffer()), _by_bucket(right)))) if left.num_rows else []
            return pa.Table.from_batches(out, _MESSAGE)

        return self.rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(go, _ASKED)

    def resume(self, answers: DataFrame, finish: Callable, schema) -> DataFrame:
        """finish(documents, {(round, bucket): answer}) returns a pyarrow table of the schema."""

        def go(left, right):
            release()
            return finish(open_chunk(left.column(1)[0].as_buffer()), _by_bucket(right))

        return self.rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(go, schema)


_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])


def _messages(chunk: int, said):
    for bucket, payload in said:
        yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([chunk]), pa.array([payload], pa.binary())], schema=_MESSAGE)


def _by_bucket(answers: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(r, b): p.as_buffer() for b, r, p in zip(answers.column("bucket").to_pylist(), answers.column("round").to_pylist(), answers.column("payload"), strict=True)}


def answer(asked: DataFrame, reply: Callable, number: int) -> DataFrame:
    """reply(messages) returns a message back for each message of a bucket, in order, or None for no answer."""

    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        release()
        back = reply([x.as_buffer() for x in table.column("payload")])
        kept = [(c, x) for c, x in zip(chunks, back, strict=True) if x is not None]
        return pa.table([pa.array([c for c, _ in kept], pa.int64()), pa.array([bucket] * len(kept), pa.int32()), pa.array([number] * len(kept), pa.int32()), pa.array([x for _, x in kept], pa.binary())], names=["chunk", "bucket", "round", "payload"])

    return asked.groupBy("bucket").applyInArrow(go, _ANSWERED)


def strings(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one array of UTF-8 bytes, and where each text begins and ends in it; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], column.type)
    arr = arr.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if arr.buffers()[2] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def answer_bits(data, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


__all__ = ["Packed", "answer", "answer_bits", "open_chunk", "squeeze", "strings", "unsqueeze"]
