import itertools
import random

import pyarrow as pa

from factmill.llm import bpe
from tests.llm.test_tokens import library, library_ids


def check(e, texts, some):
    ids, n = e.encode(some)
    want = [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_short_texts_side_by_side():
    """Every text of up to four of these characters: white space, apostrophes and letters at the edges of texts and of slices."""
    texts = ["".join(x) for k in range(5) for x in itertools.product(" \n　'sre1!", repeat=k)]
    texts += ["it'", "s", "a ", "b", "x'r", "e", "''s", "'re's", "'llama", "I'd've", "'\U00013714s", "a\x00b", "x <|endoftext|> y", "<|endoftext|>"]
    e = bpe.Encoder(bpe.default_vocabulary())
    every = pa.array(["before ", *texts], pa.string())
    check(e, texts, every.slice(1))
    check(e, texts[5000:5100], every.slice(5001, 100))


def test_units_are_kept_in_arrays():
    """Pre-tokens of up to 16 bytes are no Python objects, which took most of a worker's time and memory; the table grows and is trimmed."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgéß'1-") for _ in range(r.randint(1, 9))) for _ in range(60000)]
    for cache_units in (1000, bpe.CACHE_UNITS):
        e = bpe.Encoder(bpe.default_vocabulary(), cache_units=cache_units)
        for at in range(0, len(words), 10000):
            texts = [" ".join(words[i : i + 500]) for i in range(at, at + 10000, 500)]
            check(e, texts, texts)
            check(e, texts, texts)
        assert not [u for u in e.index if len(u.encode()) <= 16]
        assert (e.count > 10000) == (cache_units > 1000) or e.count > cache_units


def test_long_units():
    long = ["x" * n for n in (7, 8, 9, 15, 16, 17, 300)]
    texts = [w + " " + w for w in long] + ["=" * 40, "é" * 8, "é" * 9, " " * 16 + "a", " " * 17 + "a", " " * 18 + "a"]
    e = bpe.Encoder(bpe.default_vocabulary())
    for _ in range(2):
        check(e, texts, texts)
    assert e.lengths(texts).tolist() == [len(library_ids(t)) for t in texts]
