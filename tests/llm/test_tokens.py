import random
import sys
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factmill.llm import bpe, packing, token_counts, token_files
from factmill.llm.elias_fano import EliasFano

SCHEMA = "doc_id long, text string, lang string, length long, part int, ids string"
ROWS = [(5, "The cat's  nap\n\n x1 ", "en", 1, 2, "a"), (2, None, None, None, None, None), (9, "", "en", 0, 0, ""), (7, "été  \x1c b " * 900, "fr", 3, 1, "b"), (5, "The cat's  nap\n\n x1 ", "en", 1, 2, "a"), (None, "lost", "en", 1, 1, "c"), (-3, "<|endoftext|> 数字 ½", "en", 1, 1, "c")]


@cache
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], list(range(3000)), [2**40, 2**40, 2**41], np.cumsum(np.random.default_rng(1).integers(0, 900, 5000)).tolist(), [0] * 700 + [10**6] * 700])
def test_elias_fano_round_trip(values):
    ef, end = EliasFano.from_bytes(b"xx" + EliasFano.build(np.array(values, np.int64)).to_bytes(), 2)
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values
    for lo, hi in [(0, 1), (3, 300), (255, 257), (256, 512), (500, 1400), (0, 0)]:
        assert ef.select_range(min(lo, len(values)), min(hi, len(values))).tolist() == values[lo:hi]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(2).integers(1, 2000, 20000))
    assert len(EliasFano.build(v).to_bytes()) * 8 / len(v) < 2 + np.log2(2000) + 1


def test_encoder_equals_library():
    e = bpe.Encoder(bpe.default_vocabulary())
    texts = [r[1] or "" for r in ROWS] + ["a᠎b", " \t\n  x", "don't 12 34"]
    ids, n = e.encode(texts, 0)
    assert ids.tolist() == sum((library_ids(t) + [0] for t in texts), [])
    assert (n - 1).tolist() == e.lengths(texts).tolist() == [len(library_ids(t)) for t in texts]


def test_any_text_equals_library():
    """20,000 texts of code points from all of Unicode, assigned or not, white space, contractions and special strings."""
    r = random.Random(3)
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff"]
    rare = ["\U00013714", "\U000135b0", "\U00013b39", "\U0001df45", "\u180e", "\u2028", "\x85", "\x1c", "\x00", "\x01", "\u200b", "\ufeff", "é", "½", "数", "٣"]
    common = ["'s", "'ve", "'ll", "<|endoftext|>", "<|endof", " ", "  ", "\n", "\n\n", "\t", " a", "word", "Été", "12", "!?", "_"]
    texts = ["".join(r.choice(every) if x < 0.3 else r.choice(rare) if x < 0.45 else r.choice(common) for x in (r.random() for _ in range(r.randint(0, 12)))) for _ in range(20000)]
    e = bpe.Encoder(bpe.default_vocabulary())
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        ids, n = e.encode(some)
        want = [x.ids for x in library().encode_batch(some, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == sum(want, [])


def test_every_character_equals_library():
    e = bpe.Encoder(bpe.default_vocabulary())
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff"]
    texts = [f"a{c}'ve  {c}1" for c in every if c < "\U00034000" or c >= "\U000e0000" and c < "\U000e0200"]
    for at in range(0, len(texts), 20000):
        some = texts[at : at + 20000]
        ids, n = e.encode(some)
        want = [x.ids for x in library().encode_batch(some, add_special_tokens=False)]
        assert ids.tolist() == [i for x in want for i in x]


def test_special_strings_as_ordinary_text():
    e = bpe.Encoder(bpe.default_vocabulary(), specials=False)
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    for text in ("x <|endoftext|> y", "<|endoftext|>", "plain"):
        ids, _ = e.encode([text])
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, tmp_path):
    got = [tuple(r) for r in token_files.op4_token_files(spark, docs).collect()]
    at, want = 0, []
    for key, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library_ids(text) + [0]
        want.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, shard_tokens=50)
    assert token_files.open_token_files(spark, path).count() > 1
    again = token_files.read_token_files(spark, path).collect()
    assert sorted((r.start, r.n_tokens, crc(np.frombuffer(r.ids, "<u4"))) for r in again) == [w[1:] for w in want]
    token_files.export_shards(spark, path, str(tmp_path / "out"))
    shards = [token_files.Shard.open(p.read_bytes()) for p in sorted((tmp_path / "out").iterdir())]
    assert [crc(s.document(i)) for s in shards for i in range(s.n_docs)] == [w[3] for w in want]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_files.op4_token_files(spark, none).count() == 0
    assert packing.op8_packing(spark, none).count() == 0
    assert token_counts.op6_token_counts(none).count() == 0


def test_token_counts(spark, docs):
    lengths = [len(library_ids(r[1])) for r in ROWS]
    table = token_counts.op6_token_counts(docs)
    for r in table.collect():
        n = r.length
        assert (r.n_docs, r.n_docs_over, r.tokens_at_least) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.total_docs, r.total_tokens, r.truncated_total) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
        assert r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in token_counts.truncated_total(table, [0, 1, 4, 5, 2048, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.limit) for x in lengths)
    q = {r.share: r.length for r in token_counts.quantile(table, [0.0, 0.3, 0.5, 1.0]).collect()}
    assert q == {s: min(x for x in lengths if sum(y <= x for y in lengths) >= s * len(lengths)) for s in (0.0, 0.3, 0.5, 1.0)}


@pytest.mark.parametrize("shard_tokens", [1 << 20, 40])
def test_packing(spark, docs, tmp_path, shard_tokens):
    path = str(tmp_path / "p")
    token_files.write_token_files(docs, path, end=1, shard_tokens=shard_tokens)
    got = sorted(packing.packed_pieces(spark, path, 64).collect(), key=lambda r: (r.sequence_id, r.offset))
    stream, want = [], []
    for key, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids, at = library_ids(text) + [1], 0
        while at < len(ids):
            room = 64 - len(stream) % 64
            cut = ids[at : at + room]
            want.append((key, at, len(cut), crc(cut), len(ids), len(stream) // 64, len(stream) % 64))
            stream += cut
            at += len(cut)
    assert [tuple(r) for r in got] == want
    sequences = sorted(packing.packed_sequences(spark, path, 64).collect())
    assert [r.sequence_id for r in sequences] == list(range(-(-len(stream) // 64)))
    assert b"".join(bytes(r.ids) for r in sequences) == np.array(stream, "<u4").tobytes()
    assert [len(r.pieces) for r in sequences] == [sum(w[5] == i for w in want) for i in range(len(sequences))]


def test_blocks_of_documents(spark, docs, tmp_path, monkeypatch):
    """Windows that run across the blocks in which boundaries are selected, and across shards."""
    path = str(tmp_path / "b")
    token_files.write_token_files(docs.union(docs).union(docs), path, end=1, shard_tokens=70)
    want = sorted(map(tuple, packing.packed_pieces(spark, path, 16).collect()), key=str)
    shards = [r.asDict() for r in token_files.with_global_start(token_files.open_token_files(spark, path)).collect()]
    monkeypatch.setattr(token_files.Shard.documents, "__defaults__", (2,))
    rows = []
    for r in shards:
        batch = pa.record_batch([pa.array([r["before"]]), pa.array([r["start"]]), pa.array([bytes(r["payload"])], pa.binary())], names=["before", "start", "payload"])
        for out in packing._windows(16, False, [batch]):
            for x in out.to_pylist():
                assert sum(p["length"] for p in x["pieces"]) == x["length"]
                rows += [(p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"], x["sequence_id"], p["offset"]) for p in x["pieces"]]
    assert sorted(rows, key=str) == want
