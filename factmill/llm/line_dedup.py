"""Line dedup within an edit bound: a deletion-neighbourhood join that keeps the earliest line.

The unit of edit is the word, and the edit bound one edit in NEAR_WORDS words, one at most. So a line goes if an earlier line has the same words;
and a line of NEAR_WORDS words or more also if an earlier line of that size lies within
one inserted, deleted or replaced word of it. "Earlier"
is by (doc_id, line number) over the whole table, and judged on the input, not on what is left. Lines without a word stay. Callers may
give another least number of words for either.

Round 1 sends, for each distinct line of a chunk, its hash with its first place, and hashes of its halves: one edit leaves
one half as it is, so a line whose halves no other line has is through. Round 2 sends the neighbourhoods of the lines that are left and are
the first of their kind: the line itself and each variant with one word deleted, as hashed keys with the deleted
word's place. Equal keys join. Two variants with the same place differ in that word alone; a variant and a whole line differ by the
deleted word; two variants with different places may be two edits apart and do not count. That verifies the edit distance
without pairs: each record's best earlier partner is a minimum over its join group.

Null texts stay null, empty ones empty. Rows with equal doc_id have equal places and do not remove each other's lines; a null doc_id
comes after all others. Very long texts are lines like any others. An empty table gives an empty result. Columns other
than the text, whatever their names, are handed through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .chunks import CHUNK_BYTES, Packed, answer, answer_bits, squeeze, strings, unsqueeze
from .common import cut, plainly_named

#: Words of a line that takes part, and of one that an edit may separate from an earlier one.
MIN_WORDS, NEAR_WORDS = 1, 10
_NO_ID = np.int64((1 << 63) - 1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_M = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_WHOLE = np.uint32((1 << 32) - 1)


def _mixed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = x ^ (n.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    x = (x ^ (x >> np.uint64(32))) * _M[0]
    x = (x ^ (x >> np.uint64(29))) * _M[1]
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _word_codes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word [start, start + size): its 8-byte parts are mixed in one after another."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    code = size.astype(np.uint64)
    some = np.arange(len(start))
    at = 0
    while len(some):
        part = words[start[some] + at].astype("<u8", copy=False) & _MASKS[np.minimum(size[some] - at, 8)]
        code[some] = _mixed(code[some] ^ part, size[some])
        at += 8
        some = some[size[some] > at]
    return code


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hashes:
    """Hashes of word ranges, from prefix sums of code * base ** place; two bases give 128 bits."""

    def __init__(self, codes: np.ndarray):
        self.sums, self.back = [], []
        for base in _BASE:
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(base, len(codes))[:-1], dtype=np.uint64)]))
            self.back.append(_powers(pow(base, -1, 1 << 64), len(codes) + 1))

    def raw(self, a: np.ndarray, b: np.ndarray, k: int = 0) -> np.ndarray:
        """Of the words [a, b)."""
        return (self.sums[k][b] - self.sums[k][a]) * self.back[k][a]

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, k: int = 0) -> np.ndarray:
        """Of the words [a, b) but word i."""
        return (self.sums[k][i] - self.sums[k][a]) * self.back[k][a] + (self.sums[k][b] - self.sums[k][i + 1]) * self.back[k][a + 1]


@dataclass
class Lines:
    """A chunk's lines that take part, in order, and the distinct ones among them."""

    n_lines: np.ndarray  # of each document
    document: np.ndarray
    number: np.ndarray
    order_doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hashes: _Hashes
    kind: np.ndarray  # each line's distinct line
    first: np.ndarray  # each distinct line's earliest line here, in order of the keys' buckets
    key: np.ndarray
    check: np.ndarray
    bucket: np.ndarray
    near_words: int

    @classmethod
    def of(cls, docs: pa.Table, buckets: int, least: tuple[int, int]) -> Lines:
        data, bounds = strings(docs.column("text"))
        feeds = np.flatnonzero(data == 10)
        before = np.searchsorted(feeds, bounds)
        n_lines = np.where(np.diff(bounds) > 0, np.diff(before) + 1, 0)
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True  # words do not run from one document into the next
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        first = np.flatnonzero(begins)
        length = np.flatnonzero(ends) + 1 - first
        document = np.searchsorted(bounds, first, side="right") - 1
        line = np.searchsorted(feeds, first)  # counted through the chunk; a document's end parts lines, too
        new = np.ones(len(first), bool)
        new[1:] = (line[1:] != line[:-1]) | (document[1:] != document[:-1])
        lead = np.flatnonzero(new)
        size = np.diff(np.append(lead, len(first)))
        some = size >= least[0]
        word = np.repeat(some, size)
        codes = _word_codes(data, first[word], length[word])
        lead, size = lead[some], size[some]
        document = document[lead]
        number = line[lead] - before[document]
        stop = np.cumsum(size)
        start = stop - size
        ids = docs.column("doc_id").cast(pa.int64()).fill_null(int(_NO_ID)).to_numpy()
        own = ids[document] if len(document) else np.zeros(0, np.int64)
        hashes = _Hashes(codes)
        key = _mixed(hashes.raw(start, stop), size)
        check = _mixed(hashes.raw(start, stop, 1), size)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((number, own, check, key, bucket))
        new = np.ones(len(by), bool)
        new[1:] = (key[by][1:] != key[by][:-1]) | (check[by][1:] != check[by][:-1])
        kind = np.empty(len(by), np.int64)
        kind[by] = np.cumsum(new) - 1
        first = by[new]
        return cls(n_lines, document, number, own, start, stop, hashes, kind, first, key[first], check[first], bucket[first], least[1])

    def parts(self, bucket: np.ndarray):
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist() if len(edge) else [], strict=True):
            yield int(bucket[a]), slice(a, b)

    def halves(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, distinct line, bucket) of what one edit may leave of each distinct long line, in order of the buckets."""
        a, b = self.start[self.first], self.stop[self.first]
        some = np.flatnonzero(b - a >= self.near_words)
        a, b = a[some], b[some]
        n = b - a
        # a line of n words and one of n or n + 1 share the first n // 2 words or the last (n + 1) // 2
        ends = [(a, a + n // 2, 1), (b - (n + 1) // 2, b, 2), (a, a + (n - 1) // 2, 1), (b - n // 2, b, 2)]
        keys = [_mixed(self.hashes.raw(x, y), 4 * (y - x) + side) for x, y, side in ends]
        key, line = np.concatenate(keys), np.tile(some, len(ends))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((line, key, bucket))
        key, line, bucket = key[by], line[by], bucket[by]
        new = np.ones(len(by), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        return key[new], line[new], bucket[new]

    def seen_before(self, answers: dict) -> np.ndarray:
        """Distinct lines that an earlier chunk's document has."""
        out = np.zeros(len(self.first), bool)
        for bucket, part in self.parts(self.bucket):
            if (1, bucket) in answers:
                out[part] = answer_bits(answers[1, bucket], part.stop - part.start)
        return out

    def neighbourhoods(self, answers: dict, buckets: int) -> tuple[np.ndarray, ...]:
        """(bucket, key, check, place, line) of the records of round 2, in order of the buckets."""
        key, line, bucket = self.halves(buckets)
        left = np.zeros(len(self.first), bool)
        mine = {b: p.stop - p.start for b, p in self.parts(self.bucket)}
        for number, part in self.parts(bucket):
            if (1, number) in answers:
                skip = mine.get(number, 0)
                told = answer_bits(answers[1, number], skip + part.stop - part.start)[skip:]
                left[line[part][told]] = True
        some = np.flatnonzero(left & ~self.seen_before(answers))
        a, b = self.start[self.first[some]], self.stop[self.first[some]]
        n = b - a
        each = np.repeat(np.arange(len(some)), n)
        i = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        shorter = n[each] - 1
        keys, checks = ([_mixed(self.hashes.without(a[each], b[each], a[each] + i, k), shorter), _mixed(self.hashes.raw(a, b, k), n)] for k in (0, 1))
        key, check = np.concatenate(keys), np.concatenate(checks)
        place = np.concatenate([i.astype(np.uint32), np.full(len(some), _WHOLE)])
        line = some[np.concatenate([each, np.arange(len(some))])]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((place, line, bucket))
        return bucket[by], key[by], check[by].astype(np.uint32), place[by], line[by]


def _say_lines(buckets: int, least: tuple[int, int], docs: pa.Table):
    s = Lines.of(docs, buckets, least)
    key, line, bucket = s.halves(buckets)
    own, half = dict(s.parts(s.bucket)), dict(s.parts(bucket))
    for b in sorted({*own, *half}):
        p, q = own.get(b, slice(0, 0)), half.get(b, slice(0, 0))
        at = s.first[p]
        n, m = p.stop - p.start, q.stop - q.start
        yield b, np.array([n, m], "<u4").tobytes() + squeeze([s.key[p], s.check[p].astype("<u4"), s.order_doc[at], s.number[at].astype("<u4"), key[q], s.key[line[q]]])


def _columns(raw: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _least(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row, the least value of its group; groups are contiguous and numbered upwards."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.repeat(np.minimum.reduceat(value, first), np.diff(np.append(first, len(group))))


def _ranks(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Dense ranks of the places (doc_id, line number)."""
    by = np.lexsort((number, doc))
    up = np.zeros(len(by), np.int64)
    up[1:] = (doc[by][1:] != doc[by][:-1]) | (number[by][1:] != number[by][:-1])
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(up)
    return out


def _reply_lines(messages):
    """A bit for each line: an earlier one is equal elsewhere; and for each half: a different line has it."""
    counts, lines, halves = [], [], []
    for m in messages:
        n, k = np.frombuffer(m, "<u4", 2).tolist()
        c = _columns(unsqueeze(memoryview(m)[8:]), ("<u8", n), ("<u4", n), ("<i8", n), ("<u4", n), ("<u8", k), ("<u8", k))
        counts.append((n, k))
        lines.append(c[:4])
        halves.append(c[4:])
    key, check, doc, number = (np.concatenate(x) for x in zip(*lines, strict=True))
    told = np.zeros(len(key), bool)
    if len(key):
        rank = _ranks(doc, number)
        by = np.lexsort((check, key))
        group = np.cumsum(np.concatenate([[False], (key[by][1:] != key[by][:-1]) | (check[by][1:] != check[by][:-1])]))
        told[by] = _least(group, rank[by]) < rank[by]
    key, line = (np.concatenate(x) for x in zip(*halves, strict=True))
    several = np.zeros(len(key), bool)
    if len(key):
        by = np.lexsort((line, key))
        first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        last = np.append(first[1:], len(by)) - 1
        several[by] = np.repeat(line[by][first] != line[by][last], last - first + 1)
    out, a, b = [], 0, 0
    for n, k in counts:
        bits = np.concatenate([told[a : a + n], several[b : b + k]])
        out.append(np.packbits(bits).tobytes() if bits.any() else None)
        a, b = a + n, b + k
    return out


def _say_variants(buckets: int, least: tuple[int, int], docs: pa.Table, answers: dict):
    s = Lines.of(docs, buckets, least)
    bucket, key, check, place, line = s.neighbourhoods(answers, buckets)
    at = s.first[line]
    for b, p in s.parts(bucket):
        yield b, np.array([p.stop - p.start], "<u4").tobytes() + squeeze([key[p], check[p], place[p], s.order_doc[at[p]], s.number[at[p]].astype("<u4")])


def _reply_variants(messages):
    """A bit for each record: an earlier line lies within one edit of its line, by this key."""
    counts, found = [], []
    for m in messages:
        n = int(np.frombuffer(m, "<u4", 1)[0])
        counts.append(n)
        found.append(_columns(unsqueeze(memoryview(m)[4:]), ("<u8", n), ("<u4", n), ("<u4", n), ("<i8", n), ("<u4", n)))
    key, check, place, doc, number = (np.concatenate(x) for x in zip(*found, strict=True))
    rank = _ranks(doc, number)
    by = np.lexsort((place, check, key))
    k, c, p, r = key[by], check[by], place[by], rank[by]
    new = np.concatenate([[False], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    group = np.cumsum(new)
    same_place = np.cumsum(new | np.concatenate([[False], p[1:] != p[:-1]]))
    whole = p == _WHOLE
    none = np.int64(len(rank))
    best = np.where(whole, _least(group, r), np.minimum(_least(group, np.where(whole, r, none)), _least(same_place, r)))
    told = np.empty(len(by), bool)
    told[by] = best < r
    ends = np.cumsum(counts)
    return [squeeze([np.packbits(told[e - n : e])]) if told[e - n : e].any() else None for n, e in zip(counts, ends, strict=True)]


def _finish(buckets: int, least: tuple[int, int], names: tuple[str, str], docs: pa.Table, answers: dict) -> pa.Table:
    s = Lines.of(docs, buckets, least)
    bucket, _, _, _, line = s.neighbourhoods(answers, buckets)
    near = np.zeros(len(s.first), bool)
    for b, p in s.parts(bucket):
        if (2, b) in answers:
            near[line[p][answer_bits(unsqueeze(memoryview(answers[2, b])), p.stop - p.start)]] = True
    drop = (near | s.seen_before(answers))[s.kind]
    lead = s.first[s.kind]
    drop |= (s.order_doc > s.order_doc[lead]) | ((s.order_doc == s.order_doc[lead]) & (s.number > s.number[lead]))
    gone: dict[int, list[int]] = {}
    for d, i in zip(s.document[drop].tolist(), s.number[drop].tolist(), strict=True):
        gone.setdefault(d, []).append(i)
    text = docs.column("text").to_pylist()
    for d, lines in gone.items():
        out = set(lines)
        text[d] = "\n".join(x for i, x in enumerate(text[d].split("\n")) if i not in out)
    at = docs.schema.get_field_index("text")
    docs = docs.set_column(at, "text", pa.array(text, pa.string()))
    docs = docs.append_column(names[0], pa.array(s.n_lines, pa.int64()))
    return docs.append_column(names[1], pa.array([gone.get(d, []) for d in range(len(text))], pa.list_(pa.int64())))


def dedup_lines(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, names: tuple[str, str] = ("n_lines", "removed_lines"), min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The columns of docs with the text's earlier-seen lines taken out, the number of lines and the numbers of those that went.

    names: of the two new columns, which docs must not have. min_words: lines of fewer words stay. near_words: lines of fewer words go for
    equality only; at least 2, so that an edit leaves a word.
    """
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {names[0]} or {names[1]}: give other names")
    if near_words < 2:
        raise ValueError("near_words must be 2 or more")
    rows = plainly_named(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    packed = Packed(rows, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes)
    k, least = packed.buckets, (min_words, near_words)
    seen = cut(answer(packed.ask(partial(_say_lines, k, least)), _reply_lines, 1))
    near = answer(packed.ask_with(seen, partial(_say_variants, k, least)), _reply_variants, 2)
    schema = StructType([*rows.schema.fields, StructField(names[0], LongType()), StructField(names[1], ArrayType(LongType()))])
    return packed.resume(seen.unionByName(near), partial(_finish, k, least, names), schema).toDF(*docs.columns, *names)


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_WORDS_SQL = "list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
          FROM (SELECT r, doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs WHERE text <> '')),
parts AS (SELECT r, doc_id, line_no, line, {_WORDS_SQL} AS w FROM lines),
kinds AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min((doc_id, line_no)) AS place FROM parts WHERE len(w) >= {MIN_WORDS} GROUP BY 1),
variants AS (SELECT k, place, i AS cut, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
             FROM (SELECT k, place, w, unnest(range(1, len(w) + 1)) AS i FROM kinds WHERE len(w) >= {NEAR_WORDS})
             UNION ALL SELECT k, place, 0, k FROM kinds WHERE len(w) >= {NEAR_WORDS}),
wholes AS (SELECT v, min(place) AS place FROM variants WHERE cut = 0 GROUP BY v),
every AS (SELECT v, min(place) AS place FROM variants GROUP BY v),
same AS (SELECT v, cut, min(place) AS place FROM variants GROUP BY v, cut),
near AS (SELECT k, min(p) AS place FROM (
           SELECT a.k, b.place AS p FROM variants a JOIN wholes b USING (v) WHERE a.cut > 0
           UNION ALL SELECT a.k, b.place FROM variants a JOIN same b USING (v, cut) WHERE a.cut > 0
           UNION ALL SELECT a.k, b.place FROM variants a JOIN every b USING (v) WHERE a.cut = 0) GROUP BY k),
judged AS (SELECT p.r, p.line_no, p.line,
             len(p.w) >= {MIN_WORDS} AND least(k.place, coalesce(n.place, k.place)) < (p.doc_id, p.line_no) AS gone
           FROM parts p LEFT JOIN kinds k ON k.k = array_to_string(p.w, ' ') LEFT JOIN near n ON n.k = k.k),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(gone, false)), '') AS text
         FROM judged GROUP BY r)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (r)
"""
