import glob

import pyarrow.parquet as pq
import pytest

from factmill.llm import packing, token_files
from tests.llm.test_tokens import crc, library_ids


@pytest.fixture
def many_parts(spark):
    """Shuffles have 90 partitions, as for a larger input."""
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield 4 * spark.sparkContext.defaultParallelism
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(n):
    return [(i * 7 % n, f"word {i} " * (i % 23)) for i in range(n)]


def test_files_and_tasks_do_not_grow_with_the_parts(spark, tmp_path, many_parts):
    path = str(tmp_path / "p")
    docs = spark.createDataFrame(rows(500), "doc_id long, text string").repartition(20)
    pieces = packing.pack(docs, path, window=32)
    files = glob.glob(f"{path}/part-*.parquet")
    assert len(files) <= many_parts < 90
    assert token_files.open_token_files(spark, path).select("part").distinct().count() > many_parts
    assert pieces.rdd.getNumPartitions() <= many_parts
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    want, at = [], 0
    for key, text in sorted(rows(500)):
        ids, done = library_ids(text) + [1], 0
        while done < len(ids):
            own = ids[done : done + 32 - at % 32]
            want.append((key, done, len(own), crc(own), len(ids), at // 32, at % 32))
            at, done = at + len(own), done + len(own)
    assert [tuple(r) for r in got] == want
    tokens = sorted(token_files.read_token_files(spark, path).select("start", "doc_id", "n_tokens").collect())
    assert [r.doc_id for r in tokens] == list(range(500)) and sum(r.n_tokens for r in tokens) == at


def test_shards_are_stored_in_small_plain_pages(spark, tmp_path):
    """Codecs keep direct buffers of a page's size, and a page would take all shards of a task."""
    path = str(tmp_path / "s")
    docs = spark.createDataFrame([(i, f"{i} some words " * 4000) for i in range(40)], "doc_id long, text string").coalesce(1)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    token_files.write_token_files(docs, path, shard_tokens=1 << 14)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for f in glob.glob(f"{path}/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        if meta.num_rows:
            assert {meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)} == {"UNCOMPRESSED"}
            assert meta.num_rows > 8 and max(meta.row_group(g).num_rows for g in range(meta.num_row_groups)) <= 4


def test_a_window_over_several_shards(spark, tmp_path):
    """Shards that lie within one window, end at its edge, or hold whole ones only."""
    path = str(tmp_path / "w")
    docs = spark.createDataFrame([(i, " a" * n) for i, n in enumerate([3, 7, 7, 0, 15, 31, 1, 63, 40, 0, 0, 22])], "doc_id long, text string")
    token_files.write_token_files(docs, path, end=1, shard_tokens=1)
    got = packing.packed_sequences(spark, path, 16).collect()
    total = sum(r.n_tokens for r in token_files.read_token_files(spark, path).collect())
    assert sorted(r.sequence_id for r in got) == list(range(-(-total // 16)))
    assert all(r.length == min(16, total - 16 * r.sequence_id) == sum(p.length for p in r.pieces) and len(r.ids) == 4 * r.length for r in got)
    assert packing.packed_pieces(spark, path, 16).count() == sum(len(r.pieces) for r in got)
