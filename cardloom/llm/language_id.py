"""Operator 8: language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary of byte strings, all of them, and the single bytes. Each language has a
probability for each piece; a word's probability is the sum over all its segmentations of the product of their pieces,
computed by the forward algorithm; a text's is the product over its words. Piece probabilities are fitted by expectation
maximisation (forward-backward) on word counts of a bounded sample of labelled documents: each round is a Spark job over
the words, which adds up expected piece counts; the driver holds pieces x languages numbers, whatever the number of words.

A word is a lower-cased run of letters with a leading space, whole, however long. In a task, the distinct words of a few
megabytes are scored at once: piece numbers come from a hash table over rolling hashes, and the forward sums of all short
words of a length are array operations; those of a long word go along its places, on logarithms.

Null texts and texts without letters are `und` with score 0. Without any labelled sample everything is `und`. Labelled
rows without language are not learnt from. Every language of the labelled rows can be predicted; of languages with equal
probability the first by name is. Texts are read whole, however long. Repeated rows are predicted alike; an empty table
gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, WordTable, map_batches, mix, text_slices

UNKNOWN = "und"
#: Words of more bytes are summed one by one on logarithms, place by place, and so are those with a sum under _LEAST: the
#: same sums, safe from underflow.
_TOGETHER, _LEAST = 48, 1e-250


@dataclass(frozen=True)
class Training:
    """Bound of the labelled sample: documents of each language. All their words are learnt from."""

    documents: int = 200
    rounds: int = 4


class Pieces:
    """Open-addressed hash table from byte strings to piece numbers, probed by whole arrays."""

    SLOTS = 1 << 18

    def __init__(self, pieces: list[bytes]):
        pieces = [p for p in dict.fromkeys(pieces) if p]
        self.longest = max(map(len, pieces), default=1)
        known = set(pieces)
        pieces += [bytes([b]) for b in range(256) if bytes([b]) not in known]
        self.count = len(pieces)
        self.codes = np.zeros(self.SLOTS, np.uint64)
        self.numbers = np.full(self.SLOTS, -1, np.int32)
        codes = np.array([self._code(p) for p in pieces], np.uint64)
        self.probes = 0
        todo = np.arange(len(pieces))
        while len(todo):
            slot = self._slot(codes[todo], self.probes)
            free = self.numbers[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            put = first[free[first]]
            self.codes[slot[put]], self.numbers[slot[put]] = codes[todo[put]], todo[put]
            todo = np.delete(todo, put)
            self.probes += 1

    @staticmethod
    def _code(piece: bytes) -> int:
        code = 0
        for b in piece:
            code = ((code + b + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
        return code

    def _slot(self, codes: np.ndarray, probe: int) -> np.ndarray:
        return ((mix(codes) + np.uint64(probe)) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        base = self._slot(codes, 0)
        out = np.where(self.codes[base] == codes, self.numbers[base], -1)
        for probe in range(1, self.probes):
            open_ = np.flatnonzero((out < 0) & (self.numbers[base] >= 0))
            if not len(open_):
                break
            slot = (base[open_] + probe) & (self.SLOTS - 1)
            out[open_] = np.where(self.codes[slot] == codes[open_], self.numbers[slot], -1)
        return out

    def lattice(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """words: n x size bytes. Piece numbers of all words' bytes [i, j), -1 where there is no such piece; no entry where
        no word has one."""
        size = words.shape[1]
        step = np.uint64(0x9E3779B97F4A7C15)
        out = {}
        for i in range(size):
            code = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                code = (code + words[:, j - 1].astype(np.uint64) + np.uint64(1)) * step
                number = self.find(code)
                if number.max(initial=-1) >= 0:
                    out[i, j] = number
        return out


    def along(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece number) of all pieces in one word of any length, by their ends."""
        data = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        step, code = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(data), np.uint64)
        starts, ends, numbers = [], [], []
        for size in range(1, min(self.longest, len(data)) + 1):
            code = (code[: len(data) - size + 1] + data[size - 1 :]) * step
            number = self.find(code)
            at = np.flatnonzero(number >= 0)
            starts.append(at), ends.append(at + size), numbers.append(number[at])
        start, end, number = (np.concatenate(x) for x in (starts, ends, numbers))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], number[order]


def _log_sums(start: np.ndarray, end: np.ndarray, logp: np.ndarray, size: int) -> np.ndarray:
    """Logarithms of the forward sums at each place of a word (size + 1 x languages); pieces sorted by their ends."""
    out = np.full((size + 1, logp.shape[1]), -np.inf)
    out[0] = 0.0
    cuts = np.searchsorted(end, np.arange(size + 2))
    for j in range(1, size + 1):
        part = slice(cuts[j], cuts[j + 1])
        terms = out[start[part]] + logp[part]
        top = np.maximum(terms.max(axis=0), -1e300)
        out[j] = top + np.log(np.exp(terms - top).sum(axis=0))
    return out


def _forward(lattice: dict, n: int, size: int, prob: np.ndarray) -> list[np.ndarray]:
    """prob: (pieces + 1) x languages, the last row 0. Forward sums at each position, n x languages."""
    alpha = [np.ones((n, prob.shape[1]))]
    for j in range(1, size + 1):
        total = np.zeros((n, prob.shape[1]))
        for i in range(j):
            if (i, j) in lattice:
                total += alpha[i] * prob[lattice[i, j]]
        alpha.append(total)
    return alpha


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    prob: np.ndarray

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word, whole, in each language."""
        out = np.zeros((len(words), len(self.languages)))
        with np.errstate(divide="ignore"):
            logp = np.log(self.prob)
        alone = [k for k, word in enumerate(words) if len(word) > _TOGETHER]
        for index, matrix in _by_size(words):
            lattice = self.pieces.lattice(matrix)
            sums = _forward(lattice, len(index), matrix.shape[1], self.prob)[-1]
            out[index] = np.log(np.maximum(sums, _LEAST))
            alone += index[(sums < _LEAST).any(axis=1)].tolist()
        for k in alone:
            start, end, number = self.pieces.along(words[k])
            out[k] = _log_sums(start, end, logp[number], len(words[k]))[-1]
        return out


def _by_size(words: list[bytes], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of up to _TOGETHER bytes by their size: numbers and bytes."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes[sizes <= _TOGETHER]):
        whole = np.flatnonzero(sizes == size)
        for index in np.array_split(whole, -(-len(whole) // most)):
            yield index, np.frombuffer(b"".join(words[i] for i in index), np.uint8).reshape(len(index), size)


def read_pieces(path: str) -> list[bytes]:
    """Byte strings of a rank file."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


#: Expected counts are added up as whole numbers of this unit, so that the order of adding doesn't matter.
_UNIT = 2.0**-24


def _expected(pieces: Pieces, words: list[bytes], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of words with counts (words x languages), by forward and backward sums."""
    k = counts.shape[1]
    numbers, shares = [np.zeros(0, np.int64)], [np.zeros((0, k))]
    alone = [row for row, word in enumerate(words) if len(word) > _TOGETHER]
    for index, matrix in _by_size(words):
        size, lattice = matrix.shape[1], pieces.lattice(matrix)
        alpha = _forward(lattice, len(index), size, prob)
        low = (alpha[size] < _LEAST).any(axis=1)
        alone += index[low].tolist()
        beta = [np.zeros((len(index), k)) for _ in range(size)] + [np.ones((len(index), k))]
        for i, j in sorted(lattice, reverse=True):
            beta[i] += beta[j] * prob[lattice[i, j]]
        scale = np.where(low[:, None], 0.0, counts[index]) / np.maximum(alpha[size], _LEAST)
        for (i, j), number in lattice.items():
            seen = np.flatnonzero(number >= 0)
            numbers.append(number[seen])
            shares.append(alpha[i][seen] * prob[number[seen]] * beta[j][seen] * scale[seen])
    with np.errstate(divide="ignore"):
        logp = np.log(prob)
    for row in alone:
        start, end, number = pieces.along(words[row])
        size = len(words[row])
        ahead = _log_sums(start, end, logp[number], size)
        back = np.argsort(-start, kind="stable")  # the same sums from the end: the word mirrored
        behind = _log_sums(size - end[back], size - start[back], logp[number[back]], size)[::-1]
        numbers.append(number)
        shares.append(np.exp(ahead[start] + logp[number] + behind[end] - ahead[size]) * counts[row])
    number, share = np.concatenate(numbers), np.concatenate(shares)
    return np.column_stack([np.bincount(number, share[:, c], minlength=pieces.count + 1) for c in range(k)])


def _maximise(pieces: Pieces, words: DataFrame, languages: int, rounds: int) -> np.ndarray:
    """Piece probabilities (pieces + 1 x languages, the last row 0) from words (w, langs array<int>, counts array<bigint>)."""
    prob = np.full((pieces.count + 1, languages), 1.0 / pieces.count)
    prob[-1] = 0
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((pieces, prob))  # pieces x languages

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = shared.value
            total = np.zeros(now.shape)
            for batch in batches:
                parts: list[bytes] = []
                counts = []
                for w, langs, ns in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    row = np.zeros(now.shape[1])
                    row[langs] = ns
                    parts.append(b" " + w.encode())
                    counts.append(row)
                if parts:
                    total += _expected(own, parts, np.array(counts), now)
            piece, lang = np.nonzero(total[:-1])
            units = np.rint(total[piece, lang] / _UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(units)], ["piece", "lang", "n"])

        counted = map_batches(words, task, "piece int, lang int, n bigint").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        total = np.zeros((pieces.count + 1, languages))
        total[counted["piece"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy() * _UNIT
        pooled = total.sum(axis=1, keepdims=True) + 1e-3
        pooled[-1] = 0
        smooth = total + 0.01 * total.sum(axis=0) * pooled / pooled.sum()
        prob = smooth / np.maximum(smooth.sum(axis=0), 1e-300)
    return prob


def _letters(text: Column) -> Column:
    """Lower-cased text with everything but letters turned into single spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+", " ")


def fit(docs: DataFrame, pieces_path: str, use: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id", settings: Training | None = None) -> Model:
    """use: a condition on the id that admits a document to training."""
    s = settings or Training()
    known = docs.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & use).select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t")
    )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    pieces = Pieces(read_pieces(pieces_path))
    if not languages:
        return Model([], pieces, np.zeros((pieces.count + 1, 0)))
    # about `documents` of each language, by a hash of the id
    table = F.create_map(*(F.lit(x) for i, r in enumerate(sizes) for x in (r["lang"], F.struct(F.lit(i).alias("number"), F.lit(min(1.0, s.documents / r["n"])).alias("share")))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.withColumn("l", F.element_at(table, F.col("lang"))).filter(draw < F.col("l.share"))
    word = F.explode(F.split(_letters(F.col("t")), " "))
    counted = sample.select("l.number", word.alias("w")).filter("w <> ''").groupBy("number", "w").agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("of"))
    with Scratch(docs.sparkSession) as hold:
        words = hold.table(pairs.select("w", F.col("of.number").alias("langs"), F.col("of.n").alias("counts")).repartitionByRange("w").sortWithinPartitions("w"), "words")
        if words.isEmpty():
            return Model([], pieces, np.zeros((pieces.count + 1, 0)))
        return Model(languages, pieces, _maximise(pieces, words, len(languages), s.rounds))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score (posterior with equal priors)."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(_letters(F.col(f"`{text}`")).alias("t"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, both bounded
    kept = np.ones(256, bool)
    kept[32] = False
    table = WordTable(kept, fold_ascii=False)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(0), 1 << 22):
                n = len(offsets) - 1
                starts, ends, codes = table.words(data, offsets[:-1])
                owner = np.searchsorted(offsets, starts, side="right") - 1
                total = np.zeros((n, len(m.languages)))
                if len(starts) and m.languages:
                    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
                    scores = m.word_scores([b" " + data[starts[i] : ends[i]].tobytes() for i in first.tolist()])
                    for c in range(len(m.languages)):
                        total[:, c] = np.bincount(owner, scores[which, c], minlength=n)
                worded = np.bincount(owner, minlength=n) > 0
                langs, score = [UNKNOWN] * n, np.zeros(n)
                if m.languages:
                    best = total.argmax(axis=1)
                    post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    langs = [m.languages[b] if w else UNKNOWN for b, w in zip(best.tolist(), worded.tolist(), strict=True)]
                    score = np.where(worded, post, 0.0)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)), "lang_pred string, score double"])
    return map_batches(rows, task, schema).select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "lang_pred", "score")
