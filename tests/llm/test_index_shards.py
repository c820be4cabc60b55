import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from factmill.llm import common
from factmill.llm import decontaminate as d


def test_packed_numbers():
    for most in (0, 255, 256, 65535, 65536, (1 << 32) - 1, 1 << 32, 1 << 40):
        numbers = np.array([most, 0, most // 2])
        data = d._packed(numbers)
        assert d._unpacked(pa.py_buffer(data)).tolist() == numbers.tolist()
        assert len(data) == 1 + 3 * (1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8)
    assert d._unpacked(pa.py_buffer(d._packed(np.zeros(0, np.int64)))).tolist() == []


def test_a_shard_as_it_was_built():
    texts = ["b a b", None, "", "été " * 300, "a" * 300 + " x1"]
    for some in (texts, texts[1:3], texts[:1]):
        built = d.Shard.build(range(len(some)), [7] * len(some), [0] * len(some), pa.array(some, pa.string()))
        both = pa.Table.from_batches([built.stored()] * 2).combine_chunks().to_batches()[0]
        for i in range(2):
            opened = d.Shard.opened(both, i)
            assert opened.terms.cast(pa.binary()).to_pylist() == built.terms.to_pylist()
            assert opened.bounds.tolist() == built.bounds.tolist() and opened.positions.tolist() == built.positions.tolist()
            assert (opened.rows, opened.doc_ids, opened.n_words.tolist(), opened.starts.tolist()) == (built.rows, built.doc_ids, built.n_words.tolist(), built.starts.tolist())


def test_the_executor_gets_no_value_for_each_term_and_few_tasks(spark):
    """Items of arrays fill an executor's heap; each file costs a process that counts as all of the executor's memory while it begins."""
    docs = spark.range(500).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 40), i -> concat('w', id * 50 + i))) AS text").repartition(60, "doc_id")
    item = spark.createDataFrame([(7, "W850 w851")], "item_id long, text string")
    small = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "200"}
    held = {k: spark.conf.get(k, None) for k in small}
    before = set(glob.glob(f"{common.shared_dir(spark)}/factmill-index-*"))
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = d.op3_decontaminate(docs, item)
        (index,) = set(glob.glob(f"{common.shared_dir(spark)}/factmill-index-*")) - before
        assert spark.read.parquet(index).rdd.getNumPartitions() > common.WAVES * spark.sparkContext.defaultParallelism >= found.rdd.getNumPartitions()
        assert sorted((r.doc_id, r.n_words, r.n_hit) for r in found.collect()) == [(i, 41, 2 if i == 17 else 0) for i in range(500)]
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = [pq.ParquetFile(x).metadata for x in glob.glob(f"{index}/part-*")]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert groups and all(g.num_rows <= d.GROUP for g in groups)
    columns = [g.column(c) for g in groups for c in range(g.num_columns)]
    assert {c.compression for c in columns} == {"UNCOMPRESSED"} and not any(c.has_dictionary_page for c in columns)
    assert max(c.num_values for c in columns) < 100
    assert not any(c.is_stats_set for c in columns)  # a writer would hold a shard's values until its file ends
