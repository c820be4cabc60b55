"""Byte-level BPE ids by the tokenizers library, each distinct pre-token encoded once per worker.

A byte-level BPE never merges across pre-tokens, so the ids of a text are the ids of its pre-tokens
put one after another. Texts are split by the vocabulary's pattern, on whole arrays of their bytes; the library encodes the pre-tokens
that the worker has not met yet. The cache is a hash table of arrays: pre-tokens of up to 16 bytes are their own keys, longer ones stand in a
dict. It is bounded; when it is full, what was met again stays.

What a character is (letter, number, white space, none of them) is asked of the library when a worker first meets it, so no other engine's
version of Unicode matters. A text with a special token's string is encoded by the library as a whole.
So the ids are those of Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False), special tokens' strings included; with
specials=False these strings are ordinary text.
"""

from __future__ import annotations

import itertools
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker keeps.
CACHE_UNITS = 600_000

#: Kinds of characters; the library has not been asked about UNKNOWN ones, and its answers on ODD ones make no sense.
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD, _UNKNOWN = range(6)
#: Masks of the first bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Splits texts into pre-tokens and encodes each one once. Python sees only those that are new or longer than 16 bytes.

    The pattern is that of byte-level BPE: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """

    def __init__(self, vocabulary: str, cache_units: int = CACHE_UNITS, specials: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(vocabulary)
        self.cache_units = cache_units
        self.library.encode_special_tokens = not specials
        self.whole = ["\0", *(x.content for x in self.library.get_added_tokens_decoder().values() if specials)]  # NUL fills keys up
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self._ask(range(0x80))
        vocab = self.library.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        for token, i in vocab.items():
            self.leads[i] = token.startswith("Ġ")
        self._hold({}, np.zeros((2, 0), np.uint64), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), np.zeros(0, np.int32))

    def _hold(self, index: dict[str, int], keys: np.ndarray, numbers: np.ndarray, flat: np.ndarray, length: np.ndarray):
        """index: numbers of long units; keys: short ones, which have these numbers; flat, length: ids of all units in order."""
        self.index, self.flat, self.count = index, flat, len(length)
        self.used = int(length.sum())
        self.length = np.zeros(max(1 << 16, 2 * len(length)), np.int32)
        self.length[: len(length)] = length
        self.start = np.zeros(len(self.length), np.int32)
        self.start[: len(length)] = np.cumsum(length) - length
        self.hits = np.zeros(len(self.length), np.int32)
        self._table(keys, numbers)

    def _table(self, keys: np.ndarray, numbers: np.ndarray):
        """An empty hash table, twice as large as these keys need at least, with these keys."""
        self.bits = max(16, int(4 * len(numbers)).bit_length())
        self.keys = np.zeros((2, 1 << self.bits), np.uint64)
        self.number = np.zeros(1 << self.bits, np.int32)
        self.filled = 0
        self._insert(keys, numbers)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * _MIX[0] ^ keys[1] * _MIX[1]
        h ^= h >> np.uint64(32)
        h *= _MIX[2]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, numbers: np.ndarray):
        """Distinct keys that the table has not."""
        self.filled += len(numbers)
        slot, left = self._slots(keys), np.arange(len(numbers))
        while len(left):
            free = left[self.keys[0][slot[left]] == 0]
            self.number[slot[free]] = numbers[free]  # of several at one slot the last one stays
            free = free[self.number[slot[free]] == numbers[free]]
            self.keys[:, slot[free]] = keys[:, free]
            done = np.zeros(len(numbers), bool)
            done[free] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 where the table has none."""
        slot = self._slots(keys)
        have = self.keys[0][slot]
        same = (have == keys[0]) & (self.keys[1][slot] == keys[1])
        out = np.where(same, self.number[slot], np.int32(-1))
        left = np.flatnonzero(~same & (have != 0))
        while len(left):
            slot = (slot[left] if len(slot) > len(left) else slot) + 1 & ((1 << self.bits) - 1)
            have, own = self.keys[0][slot], keys[:, left]
            same = (have == own[0]) & (self.keys[1][slot] == own[1])
            out[left[same]] = self.number[slot[same]]
            go = ~same & (have != 0)
            left, slot = left[go], slot[go]
        return out

    def _trim(self):
        """Keeps the units that were met again, the most frequent half of the cache at most."""
        n = self.count
        hits = self.hits[:n]
        least = max(2, int(np.partition(hits, -self.cache_units // 2)[-self.cache_units // 2]) + 1) if n > self.cache_units // 2 else 2
        keep = hits >= least
        length = self.length[:n][keep]
        place = np.arange(int(length.sum())) + np.repeat(self.start[:n][keep] - (np.cumsum(length) - length), length)
        new = np.cumsum(keep, dtype=np.int32) - 1
        used = np.flatnonzero(self.keys[0])
        used = used[keep[self.number[used]]]
        keys, numbers = self.keys[:, used], new[self.number[used]]
        self.keys = self.number = None  # the old table goes before the new one is made
        long = {u: int(new[i]) for u, i in self.index.items() if keep[i]}
        self._hold(long, keys, numbers, np.concatenate([self.flat[place], np.zeros(1 << 16, np.uint32)]), length)

    def _learn(self, units: list[str]) -> np.ndarray:
        """Adds units and tells their numbers. Words with their space go to the library as one text, whose ids part where a token leads with a space."""
        is_word = np.array([u[:1] == " " and u[1:].isalpha() for u in units], bool)
        out = np.empty(len(units), np.int32)
        words = list(itertools.compress(units, is_word.tolist()))
        if len(words) > 1:
            flat = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.leads[flat])
            if len(first) == len(words):
                out[is_word] = self._add(flat, np.diff(np.append(first, len(flat))).astype(np.int32))
            else:
                is_word[:] = False
        else:
            is_word[:] = False
        if not is_word.all():
            ids = [x.ids for x in self.library.encode_batch_fast([u[1:] if u[:1] == "\0" else u for u in itertools.compress(units, (~is_word).tolist())], add_special_tokens=False)]
            length = np.fromiter(map(len, ids), np.int32, len(ids))
            out[~is_word] = self._add(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(length.sum())), length)
        return out

    def _add(self, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Appends units' ids; the units' numbers."""
        n, m = self.count, len(length)
        if n + m > len(self.start):
            more = np.zeros(max(m, len(self.start)), np.int32)
            self.start, self.length, self.hits = (np.concatenate([x, more]) for x in (self.start, self.length, self.hits))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat) // 2), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[n : n + m] = length
        self.start[n : n + m] = self.used + np.cumsum(length) - length
        self.used += len(flat)
        self.count += m
        return np.arange(n, n + m, dtype=np.int32)

    def _ask(self, codes):
        """Asks the library what these characters are: with which others do they make one unit?"""
        split = self.library.pre_tokenizer.pre_tokenize_str
        for i in codes:
            told = [len(split(lead + chr(i))) == 1 for lead in "a1!"]
            self.kinds[i] = {(): _SPACE, (0,): _LETTER, (1,): _NUMBER, (2,): _OTHER}.get(tuple(k for k in range(3) if told[k]), _ODD)

    def _kinds_of(self, data: np.ndarray) -> np.ndarray:
        """The kind of each byte's character; data has three more bytes behind."""
        out = self.kinds[data]
        at = np.flatnonzero(data >= 0xC0)
        if len(at):
            lead, code = data[at], (data[at] & 0x1F).astype(np.int32) << 6 | data[at + 1] & 0x3F
            three, four = np.flatnonzero(lead >= 0xE0), np.flatnonzero(lead >= 0xF0)
            code[three] = (code[three] & 0x3FF) << 6 | data[at[three] + 2] & 0x3F
            code[four] = (code[four] & 0x7FFF) << 6 | data[at[four] + 3] & 0x3F
            kind = self.kinds[code]
            if (kind == _UNKNOWN).any():
                self._ask(np.unique(code[kind == _UNKNOWN]).tolist())
                kind = self.kinds[code]
            out[at] = out[at + 1] = kind
            out[at[three] + 2] = kind[three]
            out[at[four] + 3] = kind[four]
        return out

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, padded; where units begin, and the end; the texts' numbers of units; which units are texts for the library."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        n = int(bounds[-1] - bounds[0])
        data = np.zeros(n + 16, np.uint8)
        if n:
            data[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        kind = self._kinds_of(data[: n + 3])[:n]
        first = np.zeros(n + 3, bool)  # of texts; what lies behind belongs to no text
        first[bounds] = first[n:] = True
        begin = first.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        # white space: the last character before something else is a unit, or goes with it if it is a blank
        last = np.flatnonzero((kind == _SPACE) & begin[1 : n + 1] & ~first[1 : n + 1])
        blank = last[data[last] == 0x20] + 1
        for _ in range(3):
            last = last - ((data[last] & 0xC0) == 0x80)
        begin[last] = True
        begin[blank] = False
        # an apostrophe alone takes its letters with it, unless a blank stands before it
        at = np.flatnonzero((data[:n] == 0x27) & begin[:n] & begin[1 : n + 1] & ~first[1 : n + 1])
        a, b = data[at + 1], np.where(first[at + 2], 0, data[at + 2])
        letters = np.isin(a, list(b"stmd")) + 2 * (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        at, letters = at[letters > 0], letters[letters > 0]
        begin[at + 1] = False
        after = at + 1 + letters
        after = after[~first[after]]
        begin[after[kind[after] == _LETTER]] = True
        odd = np.zeros(len(texts), bool)
        for x in self.whole:
            odd |= np.asarray(pc.match_substring(texts, x).to_numpy(zero_copy_only=False), bool)
        strange = np.flatnonzero(kind == _ODD)
        odd[np.searchsorted(bounds, strange, "right") - 1] = True
        for i in np.flatnonzero(odd).tolist():
            begin[bounds[i] + 1 : bounds[i + 1]] = False
        begin[n:] = False
        starts = np.flatnonzero(begin)
        to = np.searchsorted(starts, bounds)
        whole = np.zeros(len(starts), bool)
        whole[to[:-1][odd]] = True
        return data, np.append(starts, n), np.diff(to), whole

    def _look_up(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cache's number of each unit, text after text; and the number of units of each text."""
        if self.count > self.cache_units:
            self._trim()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        data, bounds, counts, whole = self._split(texts.cast(pa.string()).fill_null(""))
        starts, size = bounds[:-1], np.diff(bounds)
        eight = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
        keys = np.zeros((2, len(starts)), np.uint64)
        keys[0] = eight[starts] & _FIRST[np.minimum(size, 8)]
        more = np.flatnonzero(size > 8)
        keys[1, more] = eight[starts[more] + 8] & _FIRST[np.minimum(size[more] - 8, 8)]
        at = self._find(keys)
        long = whole | (size > 16)
        at[long] = -1
        units = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        missing = np.flatnonzero(at < 0)
        fresh = missing[~long[missing]]
        if len(fresh):
            coded = units.take(pa.array(fresh)).dictionary_encode()
            each = np.asarray(coded.indices)
            one = np.empty(len(coded.dictionary), np.int64)  # an occurrence of each
            one[each] = fresh
            numbers = self._learn(coded.dictionary.to_pylist())
            at[fresh] = numbers[each]
            if 2 * (self.filled + len(one)) > len(self.number):
                used = np.flatnonzero(self.keys[0])
                self._table(np.concatenate([self.keys[:, used], keys[:, one]], 1), np.concatenate([self.number[used], numbers]))
            else:
                self._insert(keys[:, one], numbers)
        fresh = missing[long[missing]]
        if len(fresh):
            named = [("\0" if w else "") + u for u, w in zip(units.take(pa.array(fresh)).to_pylist(), whole[fresh].tolist(), strict=True)]
            new = list(dict.fromkeys(u for u in named if u not in self.index))
            if new:
                self.index.update(zip(new, self._learn(new).tolist(), strict=True))
            at[fresh] = [self.index[u] for u in named]
        self.hits[: self.count] += np.bincount(at, minlength=self.count).astype(np.int32)
        return at, counts

    def lengths(self, texts: pa.Array | list[str]) -> np.ndarray:
        """Number of ids of each text."""
        at, counts = self._look_up(texts)
        done = np.concatenate([[0], np.cumsum(self.length[at], dtype=np.int64)])
        stop = np.cumsum(counts)
        return done[stop] - done[stop - counts]

    def encode(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one uint32 array, the id `end` after each text if given; and the number of ids of each text."""
        at, counts = self._look_up(texts)
        n = self.length[at]
        done = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        stop = np.cumsum(counts)
        lengths = done[stop] - done[stop - counts]
        place = np.repeat(self.start[at] - done[:-1].astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        flat = self.flat[place]
        if end is None:
            return flat, lengths
        return np.insert(flat, done[stop], np.uint32(end)), lengths + 1


@cache
def encoder(vocabulary: str, cache_units: int = CACHE_UNITS) -> Encoder:
    """One for each worker process."""
    return Encoder(vocabulary, cache_units=cache_units)
