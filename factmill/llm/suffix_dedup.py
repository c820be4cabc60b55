"""Suffix-array dedup: bytes that a fixed-length string covers which also starts in a document with a smaller doc_id.

Every byte position starts a window of LENGTH bytes, the head of a suffix. All suffixes of 100 TB cannot be
sent to be sorted, nor need they: a window's anchor is the 16-byte gram in it with the least hash (the first such), which
equal windows share. Round 1 tells the buckets every chunk's anchors once, five bytes each; anchors that lie in one document
only are told back and their windows are through. Neighbouring windows with the same anchor are a segment. Round 2 sends the segments of shared
anchors, equal ones of a chunk once, with the least doc_id that has them.

A bucket puts its suffixes in order by deep-shallow sorting: multikey quicksort over 8-byte characters to a depth of SHALLOW bytes,
all open groups at once; then groups that still hold different windows, whose common prefix is long, are ordered by blind
tries (Patricia tries over the rest of the window: only the bits in which members differ are looked at). Equal windows are neighbours
then; where the least doc_id of a window's run is smaller than the segment's own, a bit tells the chunk. The chunk marks what its
windows cover. Bits are exact: windows are compared byte by byte, hashes only choose where they meet and which segments of equal
content (128 bits) are one.

Null and empty texts have nothing to remove. Rows with equal doc_ids do not remove from each other; a null doc_id counts as larger
than all others. Very long texts are handled window block by window block. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, Packed, answer, answer_bits, squeeze, strings, unsqueeze
from .common import cut

LENGTH = 50
GRAM = 16
#: Bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 24
#: Windows that are hashed at once.
BLOCK = 1 << 18
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_NO_ID = np.int64((1 << 63) - 1)


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8-byte word at each position: a view."""
    return np.ndarray((max(0, len(data) - 7),), kind, data, 0, (1,)) if len(data) >= 8 else np.zeros(0, kind)


def _mixed(x: np.ndarray, c: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C[c]
    return x ^ (x >> np.uint64(29))


def _contents(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the strings [start, start + size), which have 8 bytes at least."""
    a, b = size.astype(np.uint64) * _C[0], size.astype(np.uint64) * _C[1]
    for j in range(0, int(size.max(initial=0)), 8):
        live = np.flatnonzero(size > j)
        w = words[start[live] + np.minimum(j, size[live] - 8)].astype("<u8", copy=False)
        a[live] = _mixed((a[live] ^ w) * _C[2], 3)
        b[live] = _mixed((b[live] + w) * _C[4], 0)
    return a, b


@dataclass
class Segments:
    """Runs of windows with the same anchor, in the order of the text. key: hash of the anchor."""

    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    document: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray, length: int) -> Segments:
        span = length - GRAM + 1
        lengths = np.diff(bounds)
        long_ = np.flatnonzero(lengths >= length)
        found = []
        n = len(data) - length + 1
        valid = np.zeros(max(n, 0) + 1, np.int8)
        np.add.at(valid, bounds[long_], 1)
        np.add.at(valid, bounds[long_ + 1] - length + 1, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
        for at in range(0, max(n, 0), BLOCK):
            ok = valid[at : at + BLOCK]
            if not ok.any():
                continue
            w = _words(data[at : at + BLOCK + length - 1]).copy()
            h = _mixed(w[:-8] * _C[0] + (w[8:] ^ (w[8:] >> np.uint64(32))) * _C[1], 2)
            k = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            reach = 1
            while 2 * reach <= span:
                k = np.minimum(k[:-reach], k[reach:])
                reach *= 2
            if reach < span:
                k = np.minimum(k[: reach - span], k[span - reach :])
            place = np.flatnonzero(ok)
            anchor = (k[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)])
            first = np.flatnonzero(new)
            found.append((place[first] + at, np.diff(np.append(first, len(place))), _mixed(h[anchor[first]], 4)))
        if not found:
            none = np.zeros(0, np.int64)
            return cls(none, none, none.astype(np.uint64), none)
        start, windows, key = (np.concatenate(x) for x in zip(*found, strict=True))
        # a document's end parts segments: invalid windows lie between any two documents
        return cls(start, windows, key, np.searchsorted(bounds, start, side="right") - 1)


@dataclass
class Chunk:
    data: np.ndarray
    bounds: np.ndarray
    doc_ids: np.ndarray
    segments: Segments
    anchors: np.ndarray  # distinct (bucket << 40 | 40 bits of the key), in order
    anchor_of: np.ndarray
    shared_here: np.ndarray  # anchors that lie in documents with different ids in this chunk

    @classmethod
    def open(cls, docs: pa.Table, length: int, buckets: int) -> Chunk:
        data, bounds = strings(docs.column("text"))
        ids = docs.column("doc_id").fill_null(int(_NO_ID)).to_numpy().astype(np.int64)
        s = Segments.of(data, bounds, length)
        code = (s.key % np.uint64(buckets) << np.uint64(40)) | (s.key >> np.uint64(24))
        by = np.argsort(code, kind="stable")
        ordered = code[by]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(by) else np.zeros(0, np.int64)
        of = np.empty(len(by), np.int64)
        of[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
        own = ids[s.document[by]]
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(first) else np.zeros(0, bool)
        return cls(data, bounds, ids, s, ordered[first], of, several)

    def by_bucket(self, buckets_of: np.ndarray):
        """(bucket, slice) of an ascending array of buckets."""
        first = np.flatnonzero(np.concatenate([[True], buckets_of[1:] != buckets_of[:-1]])) if len(buckets_of) else []
        for a, b in zip(first, np.append(first[1:], len(buckets_of)) if len(first) else [], strict=True):
            yield int(buckets_of[a]), slice(int(a), int(b))

    def anchor_slices(self):
        return self.by_bucket((self.anchors >> np.uint64(40)).astype(np.int64))

    def shared(self, answers: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments whose anchor other documents share: their numbers, the number of each one's content, per content its first segment, and per content its bucket."""
        told = np.zeros(len(self.anchors), bool)
        for bucket, part in self.anchor_slices():
            if (1, bucket) in answers:
                told[part] = answer_bits(answers[1, bucket], part.stop - part.start)
        s = self.segments
        some = np.flatnonzero(told[self.anchor_of])
        size = s.windows[some] + (LENGTH if self.length is None else self.length) - 1
        a, b = _contents(_words(self.data), s.start[some], size)
        bucket = (self.anchors[self.anchor_of[some]] >> np.uint64(40)).astype(np.int64)
        by = np.lexsort((b, a, bucket))
        new = np.ones(len(by), bool)
        new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]) | (bucket[by][1:] != bucket[by][:-1])
        first = np.flatnonzero(new)
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(new) - 1
        return some, of, some[by[first]], bucket[by[first]]

    def least(self, some: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
        """Per content, the least doc_id of this chunk that has it."""
        out = np.full(count, _NO_ID)
        np.minimum.at(out, of, self.doc_ids[self.segments.document[some]])
        return out

    length: int | None = None


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings [start, start + size) one after another."""
    total = int(size.sum())
    at = np.repeat((start - (np.cumsum(size) - size)).astype(np.int64), size)
    at += np.arange(total)
    return data[at]


def _open(docs: pa.Table, length: int, buckets: int) -> Chunk:
    chunk = Chunk.open(docs, length, buckets)
    chunk.length = length
    return chunk


def _say_anchors(length: int, buckets: int, docs: pa.Table):
    chunk = _open(docs, length, buckets)
    for bucket, part in chunk.anchor_slices():
        keys = chunk.anchors[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        yield bucket, np.packbits(chunk.shared_here[part]).tobytes() + keys.tobytes()


def _reply_anchors(messages):
    """Which anchors lie in several documents: those said by several chunks, or by one about several of its documents."""
    keys, flags, sizes = [], [], []
    for m in messages:
        n = next(k for k in range(len(m) * 8 // 41, -1, -1) if 5 * k + (k + 7) // 8 <= len(m))
        flags.append(np.unpackbits(np.frombuffer(m, np.uint8, (n + 7) // 8), count=n))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(m, np.uint8, 5 * n, (n + 7) // 8).reshape(n, 5)
        keys.append(wide.view("<u8").ravel())
        sizes.append(n)
    key, flag = np.concatenate(keys), np.concatenate(flags).astype(bool)
    by = np.argsort(key, kind="stable")
    k = key[by]
    same = k[1:] == k[:-1]
    pair = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    told = flag.copy()
    told[by] |= pair
    ends = np.cumsum(sizes)
    return [np.packbits(told[e - n : e]).tobytes() if told[e - n : e].any() else None for n, e in zip(sizes, ends, strict=True)]


def _say_segments(length: int, buckets: int, docs: pa.Table, answers: dict):
    chunk = _open(docs, length, buckets)
    some, of, first, bucket = chunk.shared(answers)
    least = chunk.least(some, of, len(first))
    s = chunk.segments
    for number, part in chunk.by_bucket(bucket):
        windows = s.windows[first[part]]
        body = _gather(chunk.data, s.start[first[part]], windows + length - 1)
        yield number, len(windows).to_bytes(4, "little") + squeeze([windows.astype(np.uint8), least[part].astype("<i8"), body])


class BlindTrie:
    """A Patricia trie over distinct bit strings of equal length, given as integers: nodes hold a bit's place, and no text.

    To insert, a member is found by looking at the nodes' bits alone; the first bit in which it differs from the new one says where
    the new node belongs.
    """

    def __init__(self):
        self.root = None  # an integer, or [bit, zero, one]

    def insert(self, x: int) -> None:
        if self.root is None:
            self.root = x
            return
        node = self.root
        while type(node) is list:
            node = node[1 + (x >> node[0] & 1)]
        if node == x:
            return
        bit = (node ^ x).bit_length() - 1
        up, at, node = None, 0, self.root
        while type(node) is list and node[0] > bit:
            up, at = node, 1 + (x >> node[0] & 1)
            node = node[at]
        new = [bit, node, x] if x >> bit & 1 else [bit, x, node]
        if up is None:
            self.root = new
        else:
            up[at] = new

    def ordered(self) -> list[int]:
        out, stack = [], [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[2], node[1]]
            else:
                out.append(node)
        return out


def deep_shallow_sort(data: np.ndarray, start: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The windows [start, start + length) in lexicographic order: their numbers, and True where one differs from that before it."""
    words = _words(data, ">u8")
    n = len(start)
    order = np.argsort(words[start].astype("<u8"))
    w = words[start[order]]
    new = np.ones(n, bool)
    new[1:] = w[1:] != w[:-1]
    shallow = min(shallow, length // 8 * 8)
    for depth in range(8, shallow, 8):  # multikey quicksort: all groups of equal prefix are split by their next character
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        sub = order[open_]
        group = np.cumsum(new[open_])
        w = words[start[sub] + depth].astype("<u8")
        by = np.lexsort((w, group))
        order[open_] = sub[by]
        new[open_[1:]] |= w[by][1:] != w[by][:-1]
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    if not len(open_) or shallow >= length:
        return order, new
    # groups of one common window are done; the rest of the others goes to blind tries, equal windows once
    sub = order[open_]
    head = new[open_]
    group = np.cumsum(head) - 1
    lead = np.flatnonzero(head)
    differs = np.zeros(len(sub), bool)
    rest = [words[start[sub] + min(d, length - 8)].astype("<u8") for d in range(shallow, length, 8)]
    for r in rest:
        differs |= r != r[lead][group]
    mixed = np.zeros(len(lead), bool)
    mixed[group[differs]] = True
    deep = np.flatnonzero(mixed[group])
    if not len(deep):
        return order, new
    r = [x[deep] for x in rest]
    g = group[deep]
    by = np.lexsort((*r, g))  # any order that brings equal windows of a group together
    other = np.ones(len(by), bool)
    other[1:] = g[by][1:] != g[by][:-1]
    for x in r:
        other[1:] |= x[by][1:] != x[by][:-1]
    first = np.flatnonzero(other)
    member = sub[deep][by]
    size = np.diff(np.append(first, len(by)))
    at = start[member[first]].tolist()
    tail = memoryview(data)
    values = [int.from_bytes(tail[a + shallow : a + length], "big") for a in at]
    rank = np.empty(len(first), np.int64)
    gg = g[by][first]
    edges = np.flatnonzero(np.concatenate([[True], gg[1:] != gg[:-1]]))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(gg)).tolist(), strict=True):
        trie = BlindTrie()
        place = {}
        for i in range(a, b):
            trie.insert(values[i])
            place[values[i]] = i
        for k, v in enumerate(trie.ordered()):
            rank[place[v]] = a + k
    # the distinct windows in their new order, each with its copies
    into = np.argsort(rank)
    order_of = np.repeat(first[into] - (np.cumsum(size[into]) - size[into]), size[into]) + np.arange(len(by))
    slots = open_[deep]
    order[slots] = member[order_of]
    fresh = np.zeros(len(by), bool)
    fresh[np.cumsum(size[into]) - size[into]] = True
    new[slots] = fresh
    return order, new


def _reply_segments(length: int, messages):
    windows, least, bodies = [], [], []
    for m in messages:
        n = int.from_bytes(m[:4].to_pybytes() if isinstance(m, pa.Buffer) else m[:4], "little")
        raw = unsqueeze(memoryview(m)[4:])
        windows.append(np.frombuffer(raw, np.uint8, n).astype(np.int64))
        least.append(np.frombuffer(raw, "<i8", n, n))
        bodies.append(np.frombuffer(raw, np.uint8, -1, 9 * n))
    sizes = [len(x) for x in windows]
    win, own, data = np.concatenate(windows), np.concatenate(least), np.concatenate(bodies)
    size = win + length - 1
    start = np.cumsum(size) - size
    a, b = _contents(_words(data), start, size)
    by = np.lexsort((b, a))
    new = np.ones(len(by), bool)
    new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    first = np.flatnonzero(new)
    content = np.empty(len(by), np.int64)
    content[by] = np.cumsum(new) - 1
    lead = by[first]
    known = np.minimum.reduceat(own[by], first)  # least doc_id of each content
    count = win[lead]
    ends = np.cumsum(count)
    of = np.repeat(np.arange(len(lead)), count)
    place = np.repeat(start[lead] - (ends - count), count) + np.arange(int(ends[-1]))
    order, differs = deep_shallow_sort(data, place, length)
    run = np.flatnonzero(differs)
    best = np.minimum.reduceat(known[of[order]], run)
    earliest = np.empty(len(order), np.int64)
    earliest[order] = np.repeat(best, np.diff(np.append(run, len(order))))
    at = np.repeat((ends - count)[content] - (np.cumsum(win) - win), win) + np.arange(int(win.sum()))
    removed = earliest[at] < np.repeat(own, win)
    stop = np.cumsum(win)
    edge = np.cumsum(sizes)
    out = []
    for n, e in zip(sizes, edge, strict=True):
        bits = removed[stop[e - n - 1] if e > n else 0 : stop[e - 1]]
        out.append(squeeze([np.packbits(bits)]) if bits.any() else None)
    return out


_KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])


def _finish(length: int, buckets: int, docs: pa.Table, answers: dict) -> pa.Table:
    chunk = _open(docs, length, buckets)
    some, of, first, bucket = chunk.shared(answers)
    least = chunk.least(some, of, len(first))
    s = chunk.segments
    count = s.windows[first]
    ends = np.cumsum(count)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    for number, part in chunk.by_bucket(bucket):
        if (2, number) in answers:
            lo, hi = int(ends[part.start] - count[part.start]), int(ends[part.stop - 1])
            bits[lo:hi] = answer_bits(unsqueeze(memoryview(answers[2, number])), hi - lo)
    cover = np.zeros(len(chunk.data) + 1, np.int32)
    later = chunk.doc_ids[s.document[some]] > least[of]  # this chunk has an earlier document with the same segment
    a = s.start[some[later]]
    np.add.at(cover, a, 1)
    np.add.at(cover, a + s.windows[some[later]] + length - 1, -1)
    rest, content = some[~later], of[~later]
    n = s.windows[rest]
    at = np.repeat((ends - count)[content] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = np.repeat(s.start[rest] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = place[bits[at]]
    np.add.at(cover, place, 1)
    np.add.at(cover, place + length, -1)
    gone = np.cumsum(cover[:-1]) > 0
    spans, kept = [], []
    ids = docs.column("doc_id").to_pylist()
    for lo, hi in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True):
        own = gone[lo:hi]
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()
            spans.append([{"start": x, "stop": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(chunk.data[lo:hi][~own].tobytes())
        else:
            spans.append([])
            kept.append(chunk.data[lo:hi].tobytes())
    return pa.table([pa.array(ids, pa.int64()), pa.array(np.diff(chunk.bounds)), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], schema=_KEPT_ARROW)


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges) and kept (the remaining bytes) of each document."""
    if not GRAM + 8 <= length <= 200:
        raise ValueError("length must be from 24 to 200")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = Packed(rows, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes)
    k = packed.buckets
    shared = cut(answer(packed.ask(partial(_say_anchors, length, k)), _reply_anchors, 1))
    repeats = answer(packed.ask_with(shared, partial(_say_segments, length, k)), partial(_reply_segments, length), 2)
    return packed.resume(shared.unionByName(repeats), partial(_finish, length, k), _KEPT)


def op2_suffix_dedup(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: On hexadecimal texts: DuckDB takes no parts of blobs.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS k FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM docs WHERE length(h) >= {2 * LENGTH})),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM windows JOIN firsts USING (k) WHERE first < doc_id),
runs AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM gone) GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo, a AS hi FROM runs UNION ALL SELECT d.r, coalesce(max(b), 0), max(length(h)) // 2 FROM docs d LEFT JOIN runs USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS h FROM gaps JOIN docs USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM docs d LEFT JOIN sums USING (r) LEFT JOIN kept k USING (r)
"""
