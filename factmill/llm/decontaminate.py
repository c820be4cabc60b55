"""Benchmark decontamination over a distributed positional inverted index.

build_index() makes the index: it is sharded by document, and a shard holds, for some megabytes of documents, the postings (word
positions) of each term. Positions count through the shard's documents, which lie GAP positions apart, so no phrase runs across two of
them. The queries store it as a table in the shared folder and look test items up in what is stored; other test sets can be looked up in it later.

index_matches() finds exact phrases: every phrase starts from its rarest term in the shard, whose list is shifted by the
term's place in the phrase and intersected with the other terms' shifted lists, rarest first, for all phrases at once. With slop it
finds places where all terms of a phrase lie within a span that is `slop` words longer than the phrase, in any order.
Nothing is shuffled: the phrases travel to the shards. They are sent in blocks of at most BLOCK_BYTES of text, some 50 MB as arrays; a test set beyond
that takes several rounds over the stored index, whose matches are united by the documents' stored numbers.

Words are runs of a-z, 0-9 and characters from U+0080 on, after lower-casing A-Z alone. Null and empty texts have no words, no
hit and are clean; items without words match nothing. Rows that repeat are judged alike, each on its own; items with an
equal id are one item; an item without an id counts under the empty name. An empty test set leaves all documents clean;
an empty table gives an empty result. Very long texts are one document like any other. Only the columns named here are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .chunks import strings
from .common import few_files, fresh, input_bytes, pieces, quoted, small_side, stored, tidy

WINDOW = 13
GAP = 1024
#: Text bytes of one index shard, and of the test items that are sent at once.
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 4 << 20
#: Shards of a row group of the stored index: a reader holds a row group at once.
GROUP = 1
#: Positions hardly compress, and codecs and dictionaries hold copies of a page's values for each core. Statistics would be worse: a writer keeps
#: the least and the greatest value of each row group, here whole shards, until its file ends.
_PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false", "parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": str(GROUP)}
#: Tasks that a core gets at most in writing the index and in looking it up: each makes a file.
WAVES = 4
#: (phrase, position) candidates that are intersected at once.
CANDIDATES = 1 << 20
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))
_INDEX = "rows array<long>, doc_ids array<long>, prints array<long>, n_words array<long>, terms binary, lengths binary, counts binary, positions binary"
_SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
_MATCHES = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(_SPAN)), StructField("row", LongType()), StructField("print", LongType())])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


_BYTES = np.frombuffer(_TABLE, np.uint8)


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after another, and each text's number of words; without an object for each word."""
    data, bounds = strings(column)
    low = _BYTES[data]
    inside = low != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = bounds[:-1][np.diff(bounds) > 0]
    begins[at] = inside[at]  # words do not run from one text into the next
    first = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[first] - 1, np.count_nonzero(inside))
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).cast(pa.binary())
    return found, np.diff(np.searchsorted(first, bounds))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as one value, of as few bytes each as the largest needs: Spark makes an object of each item of an array."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) >> 8 * w == 0)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


@dataclass
class Phrases:
    """Distinct word windows of a block of items, and which items have them."""

    terms: dict[bytes, int]
    rows: np.ndarray  # term numbers, a phrase in each row; -1 behind the end of a short one
    width: np.ndarray
    names: list[str]
    owner: np.ndarray  # numbers of the items that have a phrase, phrase after phrase
    bounds: np.ndarray

    @classmethod
    def of(cls, items, window: int = WINDOW) -> Phrases:
        """items: (id, text). An item shorter than the window is one phrase."""
        terms: dict[bytes, int] = {}
        names: dict[str, int] = {}
        parts, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for key, text in items:
            own = np.array([terms.setdefault(w, len(terms)) for w in words(text)], np.int32)
            if not len(own):
                continue
            if len(own) < window:
                own = np.concatenate([own, np.full(window - len(own), -1, np.int32)])
            parts.append(np.lib.stride_tricks.sliding_window_view(own, window))
            owner.append(np.full(len(parts[-1]), names.setdefault("" if key is None else str(key), len(names))))
        every, owner = np.concatenate(parts), np.concatenate(owner)
        rows, phrase = np.unique(every, axis=0, return_inverse=True)
        phrase = phrase.reshape(-1)
        both = np.unique(np.stack([phrase, owner], 1), axis=0)
        bounds = np.searchsorted(both[:, 0], np.arange(len(rows) + 1))
        return cls(terms, rows, (rows >= 0).sum(axis=1), list(names), both[:, 1], bounds)


@dataclass
class Shard:
    """Postings of some documents. rows: a number of each document's row; starts: position of its first word."""

    rows: list[int]
    doc_ids: list[int | None]
    prints: list[int | None]
    n_words: np.ndarray
    starts: np.ndarray
    terms: pa.Array
    bounds: np.ndarray
    positions: np.ndarray

    @classmethod
    def build(cls, rows, doc_ids, prints, column: pa.Array) -> Shard:
        found, n = split(column)
        starts = np.cumsum(n + GAP) - n - GAP
        coded = found.dictionary_encode()
        ids = coded.indices.to_numpy()
        terms = coded.dictionary
        place = np.arange(len(ids)) + np.repeat(starts - (np.cumsum(n) - n), n)
        by = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits at a time are sorted by counting
        for shift in range(16, int(len(terms)).bit_length(), 16):
            by = by[np.argsort((ids[by] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(terms)))])
        return cls(list(rows), list(doc_ids), list(prints), n, starts, terms, bounds, place[by])

    def stored(self) -> pa.RecordBatch:
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (self.rows, self.doc_ids, self.prints, self.n_words.tolist())]
        data, ends = strings(self.terms)
        parts = (data.tobytes(), _packed(np.diff(ends)), _packed(np.diff(self.bounds)), _packed(self.positions))
        return pa.record_batch([*lists, *(pa.array([x], pa.binary()) for x in parts)], names=["rows", "doc_ids", "prints", "n_words", "terms", "lengths", "counts", "positions"])

    @classmethod
    def opened(cls, batch: pa.RecordBatch, i: int) -> Shard:
        at = lambda name: batch.column(batch.schema.get_field_index(name))[i]
        n = np.array(at("n_words").as_py(), np.int64)
        lengths, counts, positions = (_unpacked(at(x).as_buffer()) for x in ("lengths", "counts", "positions"))
        ends, bounds = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (lengths, counts))
        terms = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), at("terms").as_buffer()])
        return cls(at("rows").as_py(), at("doc_ids").as_py(), at("prints").as_py(), n, np.cumsum(n + GAP) - n - GAP, terms, bounds, positions)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term] : self.bounds[term + 1]] if term >= 0 else self.positions[:0]

    def numbers(self, phrases: Phrases) -> np.ndarray:
        """The shard's number of each of the phrases' terms, -1 where it has none; and -2 at the end, for the places behind a short phrase."""
        own = pc.index_in(pa.array(list(phrases.terms), pa.binary()), value_set=self.terms)
        return np.append(own.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), -2)

    def phrases(self, phrases: Phrases):
        """(phrase, first position) arrays of all exact matches, some phrases at a time."""
        if not len(self.positions) or not len(phrases.rows):
            return
        rows = self.numbers(phrases)[phrases.rows]
        some = np.flatnonzero((rows != -1).all(axis=1))
        rows = rows[some]
        size = np.where(rows >= 0, np.diff(self.bounds)[rows], np.iinfo(np.int64).max)
        order = np.argsort(size, axis=1, kind="stable")
        first = np.take_along_axis(rows, order[:, :1], 1)[:, 0]
        n = self.bounds[first + 1] - self.bounds[first]
        span = int(self.positions.max()) + rows.shape[1] + 1
        key = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)) * span + self.positions  # in order of terms, then places
        done = np.cumsum(n)
        lo, base = 0, 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(done, base + CANDIDATES, side="right")))
            phrase = np.repeat(np.arange(lo, hi), n[lo:hi])
            at = np.arange(len(phrase)) - np.repeat(done[lo:hi] - n[lo:hi] - base, n[lo:hi]) + self.bounds[first[phrase]]
            start = self.positions[at] - order[phrase, 0]
            for k in range(1, rows.shape[1]):
                term = rows[phrase, order[phrase, k]]
                short = term < 0
                if not len(phrase) or short.all():
                    break
                wanted = term * span + start + order[phrase, k]
                found = np.searchsorted(key, wanted)
                kept = short | (key[np.minimum(found, len(key) - 1)] == wanted)
                phrase, start = phrase[kept], start[kept]
            if len(phrase):
                yield some[phrase], start
            base, lo = int(done[hi - 1]), hi

    def _holds(self, term: int, places: np.ndarray) -> np.ndarray:
        own = self.postings(term)
        at = np.searchsorted(own, places)
        return (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == places) if len(own) else np.zeros(len(places), bool)

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """First positions p of spans [p, p + len(terms) + slop) that begin with a term and hold all of them, repeats as often."""
        reach = len(terms) + slop
        need = np.bincount(terms[terms >= 0], minlength=len(self.bounds) - 1)
        if (terms < 0).any():
            return self.positions[:0]
        rare = min(set(terms.tolist()), key=lambda t: self.bounds[t + 1] - self.bounds[t])
        around = self.postings(rare)
        starts = np.unique((around[:, None] - np.arange(reach)).ravel())
        begins = np.zeros(len(starts), bool)
        for t in np.flatnonzero(need):
            own = self.postings(t)
            inside = np.searchsorted(own, starts + reach) - np.searchsorted(own, starts)
            starts, begins = starts[inside >= need[t]], begins[inside >= need[t]]
            begins |= self._holds(t, starts)
        return starts[begins]

    def spans(self, phrases: Phrases, slop: int):
        """As phrases(), of spans that may be slop words longer."""
        numbers = self.numbers(phrases)
        for k, row in enumerate(phrases.rows):
            found = self.near(numbers[row[: phrases.width[k]]], slop)
            if len(found):
                yield np.full(len(found), k), found

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1


def _index_batches(shard_bytes: int, batches):
    held, size = [], 0

    def closed():
        table = pa.Table.from_batches(held)
        own = [table.column(i).to_pylist() for i in (2, 0, 3)]
        held.clear()
        return Shard.build(*own, table.column(1).combine_chunks()).stored()

    for batch in batches:
        for piece in pieces(batch, "text", min(1 << 20, shard_bytes)):
            held.append(piece)
            size += int(pc.sum(pc.fill_null(pc.binary_length(piece.column(1)), 0)).as_py() or 0)
            if size >= shard_bytes:
                yield closed()
                size = 0
    if held:
        yield closed()


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards as rows. Documents get the numbers by which matches of several blocks are united: store the frame before it is searched."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("print"))
    return rows.mapInArrow(tidy(partial(_index_batches, shard_bytes)), _INDEX)


def _matched(s: Shard, phrases: Phrases, slop: int | None):
    """A row for each document: the items with a match and the word spans that are hit, in order and disjoint."""
    found = list(s.phrases(phrases) if slop is None else s.spans(phrases, slop))
    items: dict[int, list[str]] = {}
    spans: dict[int, list] = {}
    if found:
        phrase, a = (np.concatenate(x) for x in zip(*found, strict=True))
        of = s.document(a)
        b = np.minimum(a + phrases.width[phrase] + (slop or 0), s.starts[of] + s.n_words[of])
        pairs = np.unique(np.stack([of, phrase], 1), axis=0)
        n = np.diff(phrases.bounds)[pairs[:, 1]]
        owner = phrases.owner[np.repeat(phrases.bounds[pairs[:, 1]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for d, i in np.unique(np.stack([np.repeat(pairs[:, 0], n), owner], 1), axis=0).tolist():
            items.setdefault(d, []).append(phrases.names[i])
        by = np.argsort(a, kind="stable")
        a, b = a[by], np.maximum.accumulate(b[by])
        new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
        a, b = a[new], b[np.append(new[1:], len(a)) - 1]
        for d, x, y in zip(s.document(a).tolist(), a.tolist(), b.tolist(), strict=True):
            spans.setdefault(d, []).append({"start": x - int(s.starts[d]), "stop": y - int(s.starts[d])})
    n = len(s.doc_ids)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for lo in range(0, n, 4096):
        at = range(lo, min(n, lo + 4096))
        columns = [pa.array(s.doc_ids[lo : lo + 4096], pa.int64()), pa.array(s.n_words[lo : lo + 4096]), pa.array([sorted(items.get(i, ())) for i in at], pa.list_(pa.string())), pa.array([spans.get(i, []) for i in at], kind), pa.array(s.rows[lo : lo + 4096], pa.int64()), pa.array(s.prints[lo : lo + 4096], pa.int64())]
        yield pa.record_batch(columns, names=_MATCHES.names)


def _blocks(items: DataFrame, window: int, block_bytes: int):
    """The items' phrases, in blocks that the driver and each task can hold."""
    own = items.select(F.col("item_id").cast("string").alias("k"), F.col("text").cast("string").alias("t"))
    n = -(-input_bytes(own, "t") // block_bytes)
    for i in range(max(n, 1)):
        some = own if n <= 1 else own.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        yield Phrases.of(((r.k, r.t) for r in some.toLocalIterator()), window)


def _united(found: list[DataFrame]) -> DataFrame:
    """Matches of several blocks as one row for each document; spans are merged."""
    if len(found) == 1:
        return found[0].drop("row")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)

    def merge(a, x):
        last = F.element_at(a, -1)
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(a) > 0) & (x["start"] <= F.try_element_at(a, F.lit(-1))["stop"]), grown).otherwise(F.concat(a, F.array(x)))

    own = [F.first(c).alias(c) for c in ("doc_id", "n_words", "print")]
    g = every.groupBy("row").agg(*own, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    return g.select("doc_id", "n_words", "items", F.aggregate("s", F.array().cast("array<struct<start:bigint,stop:bigint>>"), merge).alias("spans"), "print")


def index_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, items, spans of every document of a stored index, and a hash of its text, `print`.

    slop: None for exact phrases, else words that a span may be longer; window and slop are GAP at most together.
    """
    if slop is not None and window + slop > GAP:
        raise ValueError(f"window and slop must not exceed {GAP} together")

    def go(phrases, batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _matched(Shard.opened(batch, i), phrases.value, slop)

    sc = index.sparkSession.sparkContext
    return _united([few_files(index.mapInArrow(tidy(partial(go, sc.broadcast(p))), _MATCHES), WAVES) for p in _blocks(items, window, block_bytes)])


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """index_matches() over an index of docs that is stored for it."""
    index = stored(few_files(build_index(docs), WAVES), "index", **_PLAIN)
    return index_matches(index, items, window, slop, block_bytes)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    return phrase_matches(docs, items, window, slop)


def contamination(matches: DataFrame) -> DataFrame:
    """The matches with n_hit, n_items and contaminated (a twentieth of the words or more is hit)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    m = matches.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return m.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated. A verdict hangs on the text alone, so rows are found again by doc_id and text."""
    key, print_ = fresh(docs, "key", "print")
    bad = contamination(phrase_matches(docs, items)).where("contaminated").select(F.col("doc_id").alias(key), F.col("print").alias(print_)).distinct()
    bad = small_side(stored(bad, "contaminated"))
    rows = docs.withColumns({key: F.col("doc_id").cast("long"), print_: F.xxhash64(F.col("text").cast("string"))})
    left = rows.join(bad, rows[key].eqNullSafe(bad[key]) & (rows[print_] == bad[print_]), "left_anti")
    return few_files(left.select(*quoted(docs.columns)))


def op3_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(phrase_matches(docs, items))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS p
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.replace("text", "coalesce(text, '')")} AS w FROM documents),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n),
found AS (SELECT r, i, p.n, item FROM places d JOIN phrases p ON p.n = d.n AND p.p = array_to_string(d.w[i:i + d.n - 1], ' ')),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
