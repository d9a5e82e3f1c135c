"""Operator 7: byte-level BPE encoding and decoding.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary answers whole pre-tokens that are
tokens themselves with one probe and one comparison of bytes. The others are merged by rank: a heap of
candidate merges over a doubly linked list of bytes. Each Python worker remembers what it has resolved, up to
a fixed number of entries, so that a word is merged once and not once per occurrence. The memory is a hash table in flat
arrays, and all words of many texts are looked up in it at once; only unknown ones are resolved one by one. Where the
pattern is known to begin a pre-token at both ends of a run of white space and between letters, digits and other signs
(public_tokenizers.PATTERN), texts are cut there; with any other pattern whole texts take the place of words.

Null and empty texts have no ids. Repeated rows give repeated rows; an empty table gives an empty one. Very long texts
are encoded whole. Other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import free_name, map_batches, text_slices

#: Pre-tokens that one worker remembers before it starts afresh (about 200 bytes each).
PIECE_ENTRIES = 20_000

#: Slots, as a power of two, of the tables for parts of up to 8, 16 and 32 bytes; longer parts aren't remembered. A worker
#: starts afresh when five eighths of a table are taken. All of it: 70 MB, and about 8 bytes of ids for each part.
MEMO_BITS = {1: 20, 2: 21, 4: 18}

#: Bytes of text that are looked up at once, unless one text is longer, and parts of it.
_RUN_BYTES, _RUN_PARTS = 1 << 18, 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_STEP, _FACTOR, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def _slots(codes: np.ndarray, tries: np.ndarray, n: int) -> np.ndarray:
    """Slot of each hash code in each try; candidate() computes the same for one code."""
    x = codes + tries * np.uint64(_STEP)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_FACTOR)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: as many slots as keys, found by two array reads."""

    def __init__(self, keys: list[bytes]):
        n = self.size = max(1, len(keys))
        self.buckets = n // 3 + 1
        codes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys] or [0], dtype=np.uint64)[: len(keys)]
        if len(np.unique(codes)) != len(keys):
            raise ValueError("two vocabulary entries share a hash code")
        which = (codes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        self.shift = np.zeros(self.buckets, np.int64)
        self.entry = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[edges[b] : edges[b + 1]]
            first = 0
            while True:  # each try draws all slots of the bucket anew
                slots = _slots(codes[own][None, :], tries[:, None] + np.uint64(first), n)
                good = free[slots].all(axis=1)
                t = next((t for t in np.flatnonzero(good) if len(set(slots[t].tolist())) == len(own)), None)
                if t is not None:
                    break
                first += len(tries)
            self.shift[b] = int(t) + first
            free[slots[t]], self.entry[slots[t]] = False, own
        for b, slot in zip(np.flatnonzero(sizes == 1), np.flatnonzero(free), strict=False):
            self.shift[b] = -slot - 1  # a lone key is sent straight to a free slot
            self.entry[slot] = order[edges[b]]
        self.shift_list, self.entry_list = self.shift.tolist(), self.entry.tolist()

    def candidate(self, key: bytes) -> int:
        """The only entry that key can be; -1 for none."""
        code = xxhash.xxh3_64_intdigest(key)
        shift = self.shift_list[code % self.buckets]
        if shift < 0:
            return self.entry_list[-shift - 1]
        code = (code + shift * _STEP) & _MASK
        code = ((code ^ (code >> 32)) * _FACTOR) & _MASK
        return self.entry_list[(code ^ (code >> 29)) % self.size]


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Table:
    """Open addressing in flat arrays: parts of up to 8 * width bytes, compared whole, and where their ids stand."""

    def __init__(self, width: int, bits: int):
        self.width, self.shift, self.last, self.most = width, np.uint64(64 - bits), (1 << bits) - 1, 5 << bits - 3
        self.words = [np.zeros(1 << bits, np.uint64) for _ in range(width)]
        self.sizes = np.zeros(1 << bits, np.uint8)  # bytes of the part, 0 for a free slot
        self.at, self.counts = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint8)
        self.used = 0

    def clear(self) -> None:
        self.sizes[:] = 0
        self.used = 0

    def keys(self, loads: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Bytes of each part as numbers, and the slot where the search for it begins. loads: the eight bytes from each place on."""
        words = [loads[starts + 8 * k] & _LOW_BYTES[np.clip(sizes - 8 * k, 0, 8)] for k in range(self.width)]
        code = sizes.astype(np.uint64)
        for w in words:
            code = (code ^ w) * np.uint64(_FACTOR)
            code ^= code >> np.uint64(32)
        return [*words, sizes.astype(np.uint8), ((code * np.uint64(_STEP)) >> self.shift).astype(np.int64)]

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """Slot of each part, -1 for unknown ones."""
        *words, sizes, slots = keys
        out, left = np.full(len(slots), -1), np.arange(len(slots))
        while len(left):
            held = self.sizes[slots]
            same = held == sizes
            for own, w in zip(self.words, words, strict=True):
                same &= own[slots] == w
            out[left[same]] = slots[same]
            on = np.flatnonzero((held != 0) & ~same)
            left, sizes, slots, words = left[on], sizes[on], (slots[on] + 1) & self.last, [w[on] for w in words]
        return out

    def add(self, keys: list[np.ndarray], at: np.ndarray, counts: np.ndarray) -> None:
        """Parts that are unknown and all different."""
        *words, sizes, slots = keys
        self.used += len(slots)
        left = np.arange(len(slots))
        while len(left):
            free = self.sizes[slots] == 0
            self.at[slots[free]] = left[free]  # of several parts for one slot the last stays
            won = free & (self.at[slots] == left)
            to, own = slots[won], left[won]
            for held, w in zip(self.words, words, strict=True):
                held[to] = w[own]
            self.sizes[to], self.at[to], self.counts[to] = sizes[own], at[own], counts[own]
            left, slots = left[~won], (slots[~won] + 1) & self.last


#: White space where the pattern may be cut (1), bytes that end a character which is no white space (2) or begin one (4).
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = 6
_KINDS[[9, 10, 13, 32]] = 1
_KINDS[0x80:0xC0] = 2
_KINDS[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = 0  # the last bytes of wider white space
_KINDS[0xC3:0xF5] = 4
_KINDS[0xE1:0xE4] = 0  # its first bytes

#: Letters (1), digits (2) and other signs (3) but apostrophes, which may begin a pre-token of letters; second bytes of letters behind 0xC3.
_SIGNS = np.zeros(256, np.uint8)
_SIGNS[33:127] = 3
_SIGNS[ord("'")] = 0
_SIGNS[48:58] = 2
_SIGNS[65:91] = _SIGNS[97:123] = 1
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def _part_starts(data: np.ndarray, offsets: np.ndarray, cut: bool) -> np.ndarray:
    """Where the texts begin that aren't empty and, with cut, the first and the last character of each run of white space
    (the last only if something follows it) and all runs of letters, of digits and of other signs. Characters of which
    single bytes, or 0xC3 and another, don't tell what they are remain with those beside them."""
    begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
    if not cut:
        return begins
    kinds = _KINDS[data]
    here = np.zeros(len(data), bool)
    np.not_equal(kinds[1:] & 4, 0, out=here[:-1])
    here[begins[1:] - 1] = False
    here[1:] |= kinds[:-1] & 2 != 0
    here &= kinds == 1
    signs = _SIGNS[data]
    wide = (data[:-1] == 0xC3) & _SECOND[data[1:]]
    signs[:-1] |= wide
    signs[1:] |= wide
    here[1:] |= (signs[1:] != signs[:-1]) & (signs[1:] != 0) & (signs[:-1] != 0)
    here[begins] = True
    return np.flatnonzero(here)


class Encoder:
    """Encodes many texts at a time; small enough to send to every task (its size is the vocabulary's)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.ids = [ranks[k] for k in self.keys]
        self.hash = PerfectHash(self.keys)
        self.cut = pattern == public_tokenizers.PATTERN
        told = hashlib.sha256(pattern.encode())
        for key, rank in sorted(ranks.items()):
            told.update(b"%d %d " % (len(key), rank) + key)
        self.digest = told.digest()
        self._ready = False

    def __getstate__(self):
        return self.__dict__ | {"_ready": False, "find": None, "tables": None, "pool": None, "pieces": None, "pairs": None, "bytes_of": None, "text_of": None}

    def prepare(self) -> None:
        if self._ready:
            return
        self.find = regex.compile(self.pattern).findall
        self.tables = [_Table(width, bits) for width, bits in MEMO_BITS.items()]
        self.pieces: dict[str, bytes] = {}
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        top = max(self.ids, default=-1) + 1
        self.kind = np.uint16 if top <= 1 << 16 else np.uint32
        self.pool, self.pooled = np.zeros(1 << 16, self.kind), 0  # ids of all remembered parts
        spelt = [b""] * top
        for k, i in self.ranks.items():
            spelt[i] = k
        self.bytes_of = _Strings(spelt)
        self.text_of = _Strings([b"%d," % i for i in range(top)])
        self._ready = True

    def merge(self, piece: bytes) -> list[int]:
        """Second tier: repeatedly merge the adjacent pair of lowest rank, leftmost first."""
        get, pairs, n = self.ranks.get, self.pairs, len(piece)
        bits = n.bit_length()
        place = (1 << bits) - 1
        end = list(range(1, n + 1))  # part i is piece[i:end[i]]; it begins the list entry i
        before = list(range(-1, n - 1))
        # rank of part i joined with the next, then i; below 0 for none
        pair = [pairs[a << 8 | b] << bits | i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False))]
        pair.append(-1)
        heap = [x for x in pair if x >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & place
            if pair[i] != x:
                continue  # one of the two parts has changed since
            j = end[i]
            pair[j] = pair[i] = -1
            after = end[i] = end[j]
            if after < n:
                before[after] = i
                r = get(piece[i : end[after]])
                if r is not None:
                    x = pair[i] = r << bits | i
                    heappush(heap, x)
            k = before[i]
            if k >= 0:
                r = get(piece[k:after])
                if r is None:
                    pair[k] = -1
                else:
                    x = pair[k] = r << bits | k
                    heappush(heap, x)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one pre-token, as 32-bit numbers."""
        known = self.pieces.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "replace")
            entry = self.hash.candidate(raw)
            found = [self.ids[entry]] if entry >= 0 and self.keys[entry] == raw else self.merge(raw)
            known = array("I", found).tobytes()
            if len(raw) <= 64:
                if len(self.pieces) >= PIECE_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as valid UTF-8 and the places where each begins and the last ends; and where the ids
        of each begin and those of the last end."""
        starts = _part_starts(data, offsets, self.cut)
        sizes = np.diff(starts, append=len(data))
        padded = np.concatenate([data, np.zeros(8 * self.tables[-1].width, np.uint8)])
        loads = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))
        raw = data.tobytes()
        made, counts = [], np.zeros(len(starts) + 1, np.int64)
        for at in range(0, len(starts), _RUN_PARTS):
            to = min(at + _RUN_PARTS, len(starts))
            ids, counts[at + 1 : to + 1] = self._parts(raw, loads, starts[at:to], sizes[at:to])
            made.append(ids)
        ends = np.cumsum(counts)
        return np.concatenate(made) if made else np.zeros(0, self.kind), ends[np.searchsorted(starts, offsets)]

    def _parts(self, raw: bytes, loads: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these parts, one after another, and how many each has."""
        at, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        todo, least = [], 0
        for table in self.tables:
            own = np.flatnonzero((sizes > least) & (sizes <= 8 * table.width))
            least = 8 * table.width
            keys = table.keys(loads, starts[own], sizes[own])
            slots = table.find(keys)
            at[own], counts[own] = table.at[slots], table.counts[slots]
            new = np.flatnonzero(slots < 0)
            todo.append((table, own[new], [k[new] for k in keys]))
        todo.append((None, np.flatnonzero(sizes > least), []))
        filled, adds = self.pooled, []
        for table, own, keys in todo:
            ids, which, first = self._resolved(raw, starts[own], sizes[own])
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ids = np.frombuffer(b"".join(ids), np.uint32)
            places = filled + np.cumsum(n) - n
            at[own], counts[own] = places[which], n[which]
            if filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), self.kind)])
            self.pool[filled : filled + len(ids)] = ids
            filled += len(ids)
            if table:
                self.pooled = filled
                adds.append((table, [k[first] for k in keys], places, n))
        out = self.pool[_places(at, counts)]
        if any(t.used + len(n) > t.most for t, _, _, n in adds):
            for table in self.tables:
                table.clear()
            self.pool, self.pooled = np.zeros(1 << 16, self.kind), 0
        else:
            for table, keys, places, n in adds:
                table.add(keys, places, n)
            if len(self.pool) > 1 << 16 and len(self.pool) > 4 * self.pooled:  # a very long part has been there
                self.pool = self.pool[: max(1 << 16, self.pooled)].copy()
        return out, counts

    def _resolved(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray, list[int]]:
        """Ids of each different part, which of them each part is, and where each stands first."""
        known: dict[bytes, int] = {}
        ids, which, first = [], [], []
        for k, (start, end) in enumerate(zip(starts.tolist(), (starts + sizes).tolist(), strict=True)):
            part = raw[start:end]
            number = known.get(part)
            if number is None:
                number = known[part] = len(ids)
                ids.append(b"".join(map(self.piece_ids, self.find(part.decode()))))
                first.append(k)
            which.append(number)
        return ids, np.array(which, np.int64), first


#: Ids that are joined at once, so that a very long text needs little more memory than itself.
_GATHER = 1 << 18


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ..., sizes[k] of them for each k."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return ends
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(ends[-1])
    return out


class _Strings:
    """Byte strings in one flat array, so that many can be joined by one gather."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings] or [0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        if len(ids) > _GATHER:
            return b"".join(self.joined(ids[at : at + _GATHER]) for at in range(0, len(ids), _GATHER))
        return self.flat[_places(self.starts[ids], self.sizes[ids])].tobytes()

    def of_texts(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The joined strings of each text, whose ids stand between two ends."""
        if len(ids) > _GATHER:
            yield from (self.joined(ids[a:b]) for a, b in pairwise(ends.tolist()))
            return
        all_of_them = self.joined(ids)
        places = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends]
        yield from (all_of_them[a:b] for a, b in pairwise(places.tolist()))


#: One encoder for each vocabulary, pattern and Python worker, kept over tasks with what it has resolved.
_WARM: dict[bytes, Encoder] = {}


def warm(encoder: Encoder) -> Encoder:
    own = _WARM.setdefault(encoder.digest, encoder)
    own.prepare()
    return own


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        if not value.is_valid:
            yield ""
            continue
        try:
            yield value.as_py()
        except UnicodeDecodeError:
            yield value.as_buffer().to_pybytes().decode("utf-8", "replace")


def encoded(encoder: Encoder, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Encoder.ids_of() for runs of whole texts, null ones as empty; what is no UTF-8 is replaced."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        column = pa.array(_texts(column), pa.large_string())
    for _, data, offsets in text_slices(column, _RUN_BYTES):
        yield encoder.ids_of(data, offsets)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every whole text: the columns of keep and ids array<int>; null and empty texts have no ids.

    Repeated rows give repeated rows. Pre-tokens of any length are merged in O(n log n).
    """
    return _run(df, ranks_path, pattern, text, keep, "ids array<int>", _ids_column)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode, then decode: the columns of keep, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex)."""
    return _run(df, ranks_path, pattern, text, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest_columns)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Replaces the ids column by decoded (binary); null ids and ids outside the vocabulary give null."""
    shared = df.sparkSession.sparkContext.broadcast({i: k for k, i in read_ranks(ranks_path).items()})
    name = free_name(df, "decoded")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            out = [None if x is None or any(i not in table for i in x) else b"".join(map(table.__getitem__, x)) for x in batch.column(at).to_pylist()]
            rest = [c for c in range(batch.num_columns) if c != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.binary())], [*(batch.schema.names[c] for c in rest), name])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids)
    return map_batches(df, task, f"{rest + ', ' if rest else ''}`{name}` binary")


def _ids_column(encoder: Encoder, texts: pa.Array) -> list[pa.Array]:
    runs = list(encoded(encoder, texts))
    offsets = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(np.concatenate([np.diff(ends) for _, ends in runs] or [offsets[1:]]), out=offsets[1:])
    flat = np.concatenate([ids for ids, _ in runs] or [np.zeros(0, np.uint32)])
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))]


def _digest_columns(encoder: Encoder, texts: pa.Array) -> list[pa.Array]:
    counts, ids_hex, text_hex = [], [], []
    for ids, ends in encoded(encoder, texts):
        counts += np.diff(ends).tolist()
        ids_hex += [hashlib.sha256(x[:-1]).hexdigest() for x in encoder.text_of.of_texts(ids, ends)]
        text_hex += [hashlib.sha256(x).hexdigest() for x in encoder.bytes_of.of_texts(ids, ends)]
    return [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]


def _run(df, ranks_path, pattern, text, keep, added, columns) -> DataFrame:
    ranks = read_ranks(ranks_path)
    shared = df.sparkSession.sparkContext.broadcast(Encoder(ranks, pattern))
    names = [x.split()[0] for x in added.split(", ")]
    inner = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), F.col(f"`{text}`").cast("string").alias("t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages left in this worker
        encoder = warm(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # few texts at a time: ids of a batch are held until it is sent
                part = batch.slice(at, 1000)
                made = columns(encoder, part.column(len(inner)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(inner))), *made], [*inner, *names])

    schema = ", ".join([*(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, inner, strict=True)), added])
    out = map_batches(rows, task, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)), *names)
