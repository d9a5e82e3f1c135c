"""Operator 12: periodic runs of words, found by recompression.

A run is a stretch of words with smallest period q (words q apart are identical), long enough (min_length words and
min_exponent periods), that no neighbouring word extends. Each task takes its texts in slices of a few megabytes of whole
texts and works on all words of a slice as arrays:

1. words become numbers (exact dictionary); a separator of its own stands before, between and behind texts;
2. recompression: block compression replaces each maximal repetition a^k by one symbol of (a, k), pair compression each
   neighbouring pair whose first symbol drew 0 and whose second drew 1 by one symbol, in turns, until nothing shrinks.
   Equal stretches are parsed alike but for a symbol or two at their ends on each level: this is the run-length grammar;
3. a longest common extension of two places climbs while both stand at the edge of equal symbols and descends where they
   differ; two blocks of one base are passed in one step. So a query costs the height of the grammar, whatever it spans;
4. words q apart agree over at least need(q) = max(min_length - q, (min_exponent - 1) * q) places in a run of period q, so
   some multiple of need(q) lies in that stretch. These places, for all q, form a harmonic grid: n log n / 3 candidates a
   text. Where the words there agree, two extensions tell the exact stretch;
5. of equal stretches the smallest period stays.

No suffix array is built. Null texts, empty ones and texts without words have no runs; every text is read whole, however
long; repeated rows are each answered; an empty table gives an empty one; other columns are not read, so their names can't
clash. A text is one row and is never split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import map_batches, mix, text_slices

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.int64(0xFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    #: A run has at least so many words and so many periods (2 or more).
    min_length: int = 6
    min_exponent: int = 4
    #: Bytes of text in a slice and candidates that are looked at together.
    slice_bytes: int = 1 << 20
    candidates: int = 1 << 19


# ---------------------------------------------------------------- words


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of the texts, each with one blank behind it, and where each text's words begin."""
    kept = ~_SPACES[data]
    cuts = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    first[cuts] = kept[cuts]
    starts = np.flatnonzero(first)
    word = np.cumsum(first)[kept] - 1
    lengths = np.bincount(word, minlength=len(starts)) + 1
    edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=edges[1:])
    out = np.full(int(edges[-1]), 32, np.uint8)
    out[np.arange(len(word)) + word] = data[kept]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(out)])
    return words, np.searchsorted(starts, offsets)


def _sequence(words: pa.LargeBinaryArray, first: np.ndarray) -> np.ndarray:
    """Numbers of the words; before each text and at the end a negative number that occurs once."""
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    texts = len(first) - 1
    out = np.empty(len(codes) + texts + 1, np.int64)
    marks = first + np.arange(texts + 1)
    out[marks] = -1 - np.arange(texts + 1)
    inside = np.ones(len(out), bool)
    inside[marks] = False
    out[inside] = codes
    return out


# ---------------------------------------------------------------- grammar


class Grammar:
    """Levels of a recompression, flattened: nodes of a level are neighbours, level 0 comes first.

    symbol, words (length), count (children in a block level, 0 elsewhere), base (their symbol), up (parent, -1 at the
    top), down[0] and down[1] (first and last child, -1 at level 0), edge[0] and edge[1] (is first or last child).
    """

    def __init__(self, sequence: np.ndarray):
        self._levels: list[dict[str, np.ndarray]] = []
        self._add(sequence, np.ones(len(sequence), np.int64), np.zeros(len(sequence), np.int64), sequence, None)
        fresh = int(sequence.max(initial=0)) + 1
        turn = 0
        while True:
            size = len(self._levels[-1]["symbol"])
            fresh = self._blocks(fresh)
            turn += 1
            fresh = self._pairs(fresh, turn)
            if len(self._levels[-1]["symbol"]) == size or turn > 400:
                break
        at = np.cumsum([0, *(len(x["symbol"]) for x in self._levels)])
        join = lambda name: np.concatenate([x[name] for x in self._levels])
        self.symbol, self.words, self.count, self.base = (join(n) for n in ("symbol", "words", "count", "base"))
        self.up = np.full(at[-1], -1, np.int64)
        self.down = (np.full(at[-1], -1, np.int64), np.full(at[-1], -1, np.int64))
        self.edge = (np.zeros(at[-1], bool), np.zeros(at[-1], bool))
        for k, level in enumerate(self._levels[1:], 1):
            starts = level["starts"]
            below = len(self._levels[k - 1]["symbol"])
            ends = np.append(starts[1:], below) - 1
            self.down[0][at[k] : at[k + 1]], self.down[1][at[k] : at[k + 1]] = starts + at[k - 1], ends + at[k - 1]
            self.edge[0][starts + at[k - 1]], self.edge[1][ends + at[k - 1]] = True, True
            self.up[at[k - 1] : at[k]] = at[k] + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, below)))
        self.height = len(self._levels)
        self._levels = []

    def _add(self, symbol, words, count, base, starts) -> None:
        self._levels.append({"symbol": symbol, "words": words, "count": count, "base": base, "starts": starts})

    def _blocks(self, fresh: int) -> int:
        """a^k, maximal, becomes one symbol of (a, k); nothing is added where no symbol has an equal neighbour."""
        now = self._levels[-1]
        s = now["symbol"]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) == len(s):
            return fresh
        count = np.diff(np.append(starts, len(s)))
        base = s[starts]
        symbol = base.copy()
        many = count > 1
        found, number = np.unique((base[many] << 32) | count[many], return_inverse=True)
        symbol[many] = fresh + number
        self._add(symbol, np.add.reduceat(now["words"], starts), count, base, starts)
        return fresh + len(found)

    def _pairs(self, fresh: int, turn: int) -> int:
        """A symbol that drew 0 and its neighbour behind it that drew 1 become one symbol. Separators take no part."""
        now = self._levels[-1]
        s = now["symbol"]
        drew = (mix((s + np.int64(turn) * (1 << 40)).view(np.uint64)) >> np.uint64(17)).astype(np.int64) & 1
        pair = (drew[:-1] == 0) & (drew[1:] == 1) & (s[:-1] >= 0) & (s[1:] >= 0)
        at = np.flatnonzero(pair)
        if not len(at):
            return fresh
        lead = np.ones(len(s), bool)
        lead[at + 1] = False
        starts = np.flatnonzero(lead)
        symbol = s[starts]
        found, number = np.unique((s[at] << 32) | (s[at + 1] & _LOW), return_inverse=True)
        symbol[np.searchsorted(starts, at)] = fresh + number
        self._add(symbol, np.add.reduceat(now["words"], starts), np.zeros(len(starts), np.int64), symbol, starts)
        return fresh + len(found)

    def _rest(self, node: np.ndarray, above: np.ndarray, side: int) -> np.ndarray:
        """How many equal symbols there are from a node to the end of its block (its start, if side is 1); 1 outside blocks."""
        end = self.down[1 - side][above]
        return np.where((above >= 0) & (self.count[above] > 0), np.abs(end - node) + 1, 1)

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from places i and j on (back: up to them) agree, for arrays of places of one text each."""
        side, step = int(back), -1 if back else 1
        edge, down = self.edge[side], self.down[side]
        total = np.zeros(len(i), np.int64)
        who, a, b = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64)
        falling = np.zeros(len(i), bool)
        while len(who):
            ua, ub = self.up[a], self.up[b]
            climb = ~falling & edge[a] & edge[b] & (ua >= 0)
            climb[climb] = self.symbol[ua[climb]] == self.symbol[ub[climb]]
            same = ~climb & (self.symbol[a] == self.symbol[b])
            fall = ~climb & ~same
            # inside blocks all symbols up to the nearer end are passed at once
            ahead = np.where(same, np.minimum(self._rest(a, ua, side), self._rest(b, ub, side)), 0)
            total[who] += ahead * self.words[a]
            a, b = np.where(climb, ua, a + step * ahead), np.where(climb, ub, b + step * ahead)
            go = np.flatnonzero(fall)
            if len(go):
                ga, gb = a[go], b[go]
                da, db = down[ga], down[gb]
                block = (self.count[ga] > 0) & (self.base[ga] == self.base[gb])
                skip = np.where(block, np.minimum(self.count[ga], self.count[gb]), 0)
                total[who[go]] += np.where(skip > 0, skip * self.words[da], 0)
                a[go], b[go] = da + step * skip, db + step * skip
                falling[go] = True
                if (da < 0).any():
                    stay = np.ones(len(who), bool)
                    stay[go[da < 0]] = False
                    who, a, b, falling = who[stay], a[stay], b[stay], falling[stay]
        return total


# ---------------------------------------------------------------- runs


def _candidates(lengths: np.ndarray, first: np.ndarray, need: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid of every text, in chunks; first: each text's first place in the sequence."""
    most = np.where(lengths >= settings.min_length, lengths // settings.min_exponent, 0)
    text = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (lengths[text] - period - 1) // need[period] + 1
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + settings.candidates, side="right")))
        n = points[at:to]
        row = np.repeat(np.arange(at, to), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield first[text[row]] + number * need[period[row]], period[row]
        at = to


def runs_of(sequence: np.ndarray, first: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (places in the sequence), lengths and periods of all runs, by start, then period."""
    texts = len(first) - 1
    places = first[:-1] + np.arange(texts) + 1
    lengths = np.diff(first)
    longest = int(lengths.max(initial=0)) // settings.min_exponent + 1
    q = np.arange(longest + 1)
    need = np.maximum(np.maximum(settings.min_length - q, (settings.min_exponent - 1) * q), 1)
    grammar, found = None, []
    for i, period in _candidates(lengths, places, need, settings):
        alike = np.flatnonzero(sequence[i] == sequence[i + period])
        if not len(alike):
            continue
        i, period = i[alike], period[alike]
        grammar = grammar or Grammar(sequence)
        ahead = grammar.extend(i, i + period)
        behind = grammar.extend(i - 1, i + period - 1, back=True)
        long = ahead + behind >= need[period]
        start, stretch = (i - behind)[long], (ahead + behind + period)[long]
        if len(start):
            found.append(np.unique(np.stack([start, stretch, period[long]], axis=1), axis=0))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))  # of one stretch the smallest period
    rows = rows[fresh]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _slice_runs(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[pa.Array, ...]:
    texts = len(offsets) - 1
    words, first = split_words(data, offsets)
    sequence = _sequence(words, first)
    start, length, period = runs_of(sequence, first, settings)
    places = first[:-1] + np.arange(texts) + 1
    text = np.searchsorted(places, start, side="right") - 1
    # words that stay: those in no run behind its first period
    depth = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    inside = np.ones(len(sequence), bool)
    inside[first + np.arange(texts + 1)] = False
    stays = (np.cumsum(depth[:-1]) == 0)[inside]
    left = words.filter(pa.array(stays))
    kept = np.zeros(len(stays) + 1, np.int64)
    np.cumsum(stays, out=kept[1:])
    edges = np.frombuffer(left.buffers()[1], np.int64)[left.offset : left.offset + len(left) + 1] if len(left) else np.zeros(1, np.int64)
    raw = left.buffers()[2].to_pybytes() if len(left) else b""
    cuts = edges[kept[first]]
    collapsed = pa.array([raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())
    each = np.zeros(texts + 1, np.int32)
    np.cumsum(np.bincount(text, minlength=texts), out=each[1:])
    rows = pa.StructArray.from_arrays([pa.array(start - places[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    return pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(each), rows), collapsed


def find_runs(df: DataFrame, text: str = "text", id_column: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """id, n_words, runs (array of start, length, period in words, by start, then period) and collapsed: the words in no run
    behind its first period, joined by one blank. One row for each row of df; null texts count as empty."""
    s = settings or Settings()
    if s.min_exponent < 2 or s.min_length < 1:
        raise ValueError("a run has at least two periods and one word")
    docs = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1), s.slice_bytes):
                n, runs, collapsed = _slice_runs(data, offsets, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), n, runs, collapsed], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema["id"].dataType.simpleString()
    found = map_batches(docs, task, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.select(F.col("id").alias(id_column), "n_words", "runs", "collapsed")
