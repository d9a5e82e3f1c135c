"""Operator 9: near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A document is a weighted set: its five-word shingles (words of lower-cased letters and digits), each with its
number of occurrences as weight; texts of one to four words are one shingle. An element of weight w covers w unit
columns; darts hit a column one after another at hashed, exponentially spaced ranks, each with a hashed
coordinate; the earliest dart on each coordinate is the signature. Two signatures agree on a coordinate with
probability equal to the weighted Jaccard similarity. Columns hit too late to matter are never followed up, so a
document costs its length plus the number of darts that fill all coordinates.

Steps, all as joins on written tables:
1. one Python pass over the texts makes content keys, band keys and a parity bitmap of the elements' hashes;
2. equal content is collapsed to one representative;
3. each bucket (band key) has a hub; a member is compared with the hub that it meets in most of its buckets;
4. what the exact similarity of shingle multisets confirms is a link; links are contracted to components;
5. members of buckets that still hold several components meet 16 hashed hubs of the bucket, links are contracted
   again, and what is left in mixed buckets is joined by prefixes: two sets of the similarity share one of the rarest
   elements of each, a fifth of them and one more. Elements that one set alone holds are the rarest of all, so a
   document with a fifth of its own is in no pair. So no pair is lost to a cap on bucket sizes, members known to
   belong together are never paired, and a bucket of many unlike documents is not compared with itself.
A pair is only verified if two exact bounds allow the similarity: sizes, and parity bitmaps. Each element that one
set alone holds flips one bit, so two bitmaps differ in at most as many bits as the sets have elements of their own;
this rules out nearly all pairs below the similarity, and none at or above it. With 32 bands of 5 coordinates a pair
of similarity 0.8 shares no bucket once in 300,000; nothing else can lose a link.

Null texts are never duplicates. Texts without words are duplicates only of equal texts. Repeated rows are
duplicates of each other. Ids may be of any type that can be ordered and printed. An empty table gives an empty one. Other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, WordTable, ascii_words, bitmap_of, in_bitmap, map_batches, materialise, mix, text_key, text_slices

_GOLDEN, _ROUND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    #: 64-bit words of the parity bitmap (a multiple of 8).
    parity_words: int = 32
    #: Members of a bucket that all others meet before the rest is joined by prefixes.
    hubs: int = 16

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def darts(self) -> float:
        """Expected darts of a document: enough that few documents have an empty coordinate."""
        k = self.coordinates
        return k * np.log(k) + 6 * k


# ---------------------------------------------------------------- arrays of a batch


def elements(data: np.ndarray, offsets: np.ndarray, table: WordTable, shingle: int):
    """Per text: words, two content hashes; per element: text number and a hash of (shingle, occurrence)."""
    texts = len(offsets) - 1
    starts, _, words = table.words(data, offsets[:-1])
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    doc = np.repeat(np.arange(texts), counts)
    place = (np.arange(len(words)) - first[doc]).astype(np.uint64)
    keys = []
    for salt in (_GOLDEN, _ROUND):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + (place + np.uint64(1)) * salt), out=total[1:])
        keys.append(mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64) * salt))
    odd = mix(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - shingle + 1)
    codes = np.zeros(n, np.uint64)
    for j in range(shingle):
        codes += words[j : j + n] * odd[j]
    inside = place[:n].astype(np.int64) + shingle <= counts[doc[:n]]
    codes, owner = codes[inside], doc[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        extra = keys[0][short]
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        codes, owner = np.concatenate([codes, extra])[order], owner[order]
    # the j-th occurrence of a shingle is an element of its own: a multiset becomes a set of unit columns
    single = mix(mix(codes) ^ mix(owner.astype(np.uint64) + _GOLDEN))
    order = np.argsort(single)
    same = np.zeros(len(order), bool)
    same[1:] = single[order][1:] == single[order][:-1]
    if same.any():
        run = np.arange(len(order))
        nth = run - np.maximum.accumulate(np.where(same, 0, run))
        layer = np.empty(len(order), np.uint64)
        layer[order] = nth.astype(np.uint64)
        codes = codes + layer * _ROUND
    return counts, keys, owner, mix(codes)


def signatures(owner: np.ndarray, codes: np.ndarray, texts: int, settings: Settings) -> np.ndarray:
    """texts x coordinates; all zero for texts without elements."""
    k = settings.coordinates
    weight = np.bincount(owner, minlength=texts)
    out = np.zeros((texts, k), np.uint64)
    todo, reach = np.flatnonzero(weight), settings.darts
    while len(todo):
        number = np.full(texts, -1)
        number[todo] = np.arange(len(todo))
        mine = number[owner] >= 0
        who, state = number[owner[mine]], codes[mine]
        limit = (reach / weight[todo])[who]
        rank = np.zeros(len(who))
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(who):
            step += 1
            hit = mix(state + np.uint64(step * int(_GOLDEN) % (1 << 64)))
            share = ((hit >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            if step == 1:  # most columns of a long text end here: no logarithm for them
                near = share < -np.expm1(-limit)
                who, state, limit, rank, hit, share = who[near], state[near], limit[near], rank[near], hit[near], share[near]
            rank = rank - np.log1p(-share)
            near = rank < limit
            who, state, limit, rank, hit = who[near], state[near], limit[near], rank[near], hit[near]
            if len(who):
                darts.append((who, rank, hit))
        best = np.full(len(todo) * k, np.inf)
        sign = np.zeros(len(todo) * k, np.uint64)
        if darts:
            who, rank, hit = (np.concatenate(x) for x in zip(*darts, strict=True))
            code = mix(hit ^ _ROUND)
            cell = who * k + (code % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            first = rank == best[cell]
            sign[cell[first]] = code[first] | np.uint64(1)
        sign, full = sign.reshape(len(todo), k), np.isfinite(best).reshape(len(todo), k).all(axis=1)
        out[todo[full]] = sign[full]
        todo, reach = todo[~full], reach * 2
    return out


def band_keys(sign: np.ndarray, settings: Settings) -> np.ndarray:
    parts = sign.reshape(len(sign), settings.bands, settings.rows)
    out = np.broadcast_to(mix(np.arange(settings.bands, dtype=np.uint64) + _GOLDEN), parts.shape[:2]).copy()
    for r in range(settings.rows):
        out = mix(out + parts[:, :, r] * _ROUND)
    return out.view(np.int64)


def parity(owner: np.ndarray, codes: np.ndarray, texts: int, words: int) -> np.ndarray:
    """texts x words bitmap: a bit is set if an odd number of elements hash to it."""
    out = np.zeros(texts * words, np.uint64)
    bit = mix(codes ^ _GOLDEN) % np.uint64(words * 64)
    np.bitwise_xor.at(out, owner * words + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(texts, words).view(np.int64)


# ---------------------------------------------------------------- Spark steps

#: Texts that are signed at once: each needs some 60 kB of darts, however short it is.
_TEXTS_AT_ONCE = 512
_FOLD = 8


def _sign(docs: DataFrame, settings: Settings) -> DataFrame:
    """rows (id, t, r1, r2) to id, r1, r2, content keys k1, k2 (null without text), size, bands, parity."""
    table = WordTable(ascii_words())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for at, data, offsets in text_slices(column, 1 << 20, _TEXTS_AT_ONCE):
                n = len(offsets) - 1
                counts, keys, owner, codes = elements(data, offsets, table, settings.shingle)
                sign = signatures(owner, codes, n, settings)
                k1, k2 = (k.view(np.int64).copy() for k in keys)
                for i in np.flatnonzero(counts == 0):  # no words: the raw text is the content
                    code = xxhash.xxh3_128_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
                    k1[i], k2[i] = np.array([code >> 64, code & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64)
                missing = np.asarray(column.slice(at, n).is_null())
                bands = band_keys(sign, settings)
                lengths = np.where((counts > 0) & ~missing, settings.bands, 0)
                edges = np.zeros(n + 1, np.int32)
                np.cumsum(lengths, out=edges[1:])
                odd = parity(owner, codes, n, settings.parity_words)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), part.column(3), pa.array(k1, mask=missing), pa.array(k2, mask=missing),
                        pa.array(np.bincount(owner, minlength=n).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(bands[lengths > 0].ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * odd.shape[1]), pa.array(odd.ravel())),
                    ],
                    ["id", "r1", "r2", "k1", "k2", "size", "bands", "parity"],
                )

    return map_batches(docs, task, f"id {docs.schema['id'].dataType.simpleString()}, r1 bigint, r2 bigint, k1 bigint, k2 bigint, size bigint, bands array<bigint>, parity array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """k1, k2 and the elements of the wanted contents (and of a few others): a second pass, filtered by a Bloom
    filter of fixed size, which recomputes what would be too large to keep for every document."""
    table = WordTable(ascii_words())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "k1"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies in one task are sent once
        bitmap = shared.value
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(1), 1 << 21):
                n = len(offsets) - 1
                counts, keys, owner, codes = elements(data, offsets, table, settings.shingle)
                for i in np.flatnonzero(in_bitmap(bitmap, keys[0]) & (counts > 0)):
                    key = int(keys[0][i])
                    if key in sent:
                        counts[i] = 0
                    sent.add(key)
                pick = np.flatnonzero(in_bitmap(bitmap, keys[0]) & (counts > 0))
                if not len(pick):
                    continue
                edges = np.searchsorted(owner, np.arange(n + 1))
                values = codes.view(np.int64)
                for some in np.array_split(pick, max(1, len(pick) // 200)):
                    flat = np.concatenate([values[edges[i] : edges[i + 1]] for i in some])
                    cuts = np.zeros(len(some) + 1, np.int32)
                    np.cumsum(edges[some + 1] - edges[some], out=cuts[1:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[0][some].view(np.int64)), pa.array(keys[1][some].view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                        ["k1", "k2", "elements"],
                    )

    return map_batches(docs, task, "k1 bigint, k2 bigint, elements array<bigint>")


def _may_reach(a: str, b: str, settings: Settings) -> Column:
    """Exact bounds on a pair: sizes, and the bits in which parity bitmaps differ (no more than elements of one set only).

    The bitmap folded to 8 words, a parity bitmap too, goes first: it rules out most pairs at a small part of the cost.
    """
    bits = F.zip_with(f"{a}_parity", f"{b}_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return _may_reach_folded(a, b, settings) & (F.aggregate(bits, F.lit(0), lambda n, x: n + x) <= _most_apart(a, b, settings))


def _most_apart(a: str, b: str, settings: Settings) -> Column:
    """Most elements of one set only that a pair of the similarity has."""
    t = settings.similarity
    return (F.col(f"{a}_size") + F.col(f"{b}_size")) * ((1 - t) / (1 + t)) + 1e-6


def _may_reach_folded(a: str, b: str, settings: Settings) -> Column:
    sized = F.least(f"{a}_size", f"{b}_size") >= settings.similarity * F.greatest(f"{a}_size", f"{b}_size") - 1e-9
    folded = sum((F.bit_count(F.col(f"{a}_f{i}").bitwiseXOR(F.col(f"{b}_f{i}"))) for i in range(_FOLD)), F.lit(0))
    return sized & (folded <= _most_apart(a, b, settings))


def _sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, settings: Settings, hold: Scratch) -> DataFrame:
    """rep, elements of the reps named."""
    wanted = hold.table(reps.select("rep", "k1", "k2").join(ids, "rep", "left_semi"), "wanted")
    sets = _sets(docs, wanted, settings).join(wanted, ["k1", "k2"])
    return hold.table(sets.dropDuplicates(["rep"]).select("rep", "elements"), "sets")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, settings: Settings, hold: Scratch, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose element sets have the similarity asked for."""
    if sets is None:
        ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        sets = _sets_of(ids, reps, docs, settings, hold)
    left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    close = both >= settings.similarity * (F.size("ea") + F.size("eb") - both) - 1e-9
    return hold.table(pairs.join(left, "a").join(right, "b").filter(close).select("a", "b"), "links")


def _roots(links: DataFrame, hold: Scratch) -> DataFrame:
    """rep, comp of the nodes of a forest (a: node, b: parent; one row per node), by doubling the jumps."""
    now = links.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    tops = links.select(F.col("b").alias("rep")).distinct().join(now, "rep", "left_anti").select("rep", F.col("rep").alias("comp"))
    now = hold.table(now.unionByName(tops), "jumps")
    while True:
        above = now.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        jumped = now.join(above, "comp").select("rep", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved"))
        jumped = hold.table(jumped, "jumps")
        now = jumped.select("rep", "comp")
        if jumped.filter("moved").isEmpty():
            return now


def _traits(reps: DataFrame, name: str, settings: Settings) -> DataFrame:
    """The reps (as name) with what _may_reach() looks at."""
    word = lambda i: F.get("parity", F.lit(i))
    folded = [reduce(Column.bitwiseXOR, (word(i) for i in range(f, settings.parity_words, _FOLD))) for f in range(_FOLD)]
    return reps.select(F.col("rep").alias(name), F.col("size").alias(f"{name}_size"), F.col("parity").alias(f"{name}_parity"), *(x.alias(f"{name}_f{i}") for i, x in enumerate(folded)))


def components(edges: DataFrame, hold: Scratch) -> DataFrame:
    """node, root (smallest node of its component) for every node of edges (a, b), by alternating large-star and
    small-star contractions; each pass is a join and an aggregate over a written table."""
    now = hold.table(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = hold.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = hold.table(large, "edges")
        low = hold.table(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = hold.table(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        # stars: every node has one edge, and no root has one
        done = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() and small.join(
            small.select(F.col("u").alias("v")), "v", "left_semi"
        ).isEmpty()
        now = small
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _relabel(labels: DataFrame, edges: DataFrame, hold: Scratch) -> DataFrame:
    """Labels (rep, comp) after new links between reps; reps not in labels are their own component."""
    of = lambda side: labels.select(F.col("rep").alias(side), F.col("comp").alias(f"c{side}"))
    lifted = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    roots = hold.table(components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), hold), "roots")
    moved = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("comp"))
    new = roots.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(labels, "rep", "left_anti")
    return hold.table(moved.union(new), "labels")


def find_groups(df: DataFrame, text: str = "text", id_column: str = "doc_id", settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (row, id, r1, r2, rep: null without text) and labels (rep, comp) of reps with a partner."""
    s = settings or Settings()
    docs = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    with Scratch(df.sparkSession) as hold:
        r1, r2 = text_key(F.col("t"))
        signed = _sign(docs.select("id", "t", r1.alias("r1"), r2.alias("r2")), s).withColumn("row", F.monotonically_increasing_id())
        signed = hold.table(signed, "signed")
        contents = hold.table(signed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("row").alias("rep")), "contents")
        rows = signed.select("row", "id", "r1", "r2", "k1", "k2").join(contents, ["k1", "k2"], "left").drop("k1", "k2")
        rows = materialise(rows, "rows")
        reps = hold.table(signed.join(contents.select(F.col("rep").alias("row")), "row", "left_semi").filter("size > 0")
                          .select(F.col("row").alias("rep"), "k1", "k2", "size", "bands", "parity"), "reps")
        return rows, materialise(_labels(docs, reps, s, hold), "labels")


def _labels(docs: DataFrame, reps: DataFrame, s: Settings, hold: Scratch) -> DataFrame:
    """Components (rep, comp) of the links between representatives."""
    placed = reps.select("rep", F.explode("bands").alias("key"))
    sizes = hold.table(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = hold.table(placed.join(sizes, "key"), "placed")
    # the hub is the most central member, whose buckets hold most others: near a group's origin and like most of it
    central = members.groupBy("rep").agg(F.sum("n").alias("score"))
    scored = hold.table(members.join(central, "rep"), "members")
    tops = scored.groupBy("key").agg(F.max(F.struct("score", "rep")).alias("top")).select("key", F.col("top.rep").alias("hub"))
    # of a member's hubs that one counts with which it shares most buckets; what this misses is searched below
    shared = members.join(hold.table(tops, "hubs"), "key").filter("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = shared.groupBy("rep").agg(F.max(F.struct("times", "hub")).alias("top")).select(F.col("rep").alias("a"), F.col("top.hub").alias("b"))
    best = best.join(_traits(reps, "a", s), "a").join(_traits(reps, "b", s), "b").filter(_may_reach("a", "b", s)).select("a", "b")
    # a hub's (score, rep) is larger than its member's, so these links are a forest
    labels = _roots(_verified(hold.table(best, "pairs"), reps, docs, s, hold), hold)

    # only reps that stand in a bucket of several components are looked at again
    held = _mixed(members, labels, hold)
    traits = hold.table(_traits(reps.join(held.select("rep").distinct(), "rep", "left_semi"), "rep", s), "traits")
    drawn = F.pmod(F.xxhash64("rep"), F.col("n")) < s.hubs  # all members of a bucket of so many
    if not held.isEmpty():
        side = hold.table(held.join(traits, "rep"), "sides")
        hub = side.filter(drawn).select(*(F.col(c).alias(f"hub_{c.removeprefix('rep_')}" if c.startswith("rep_") else f"hub_{c}") for c in side.columns))
        met = side.join(hub, (F.col("key") == F.col("hub_key")) & (F.col("comp") != F.col("hub_comp")) & _may_reach("rep", "hub", s))
        pairs = met.select(F.least("rep", "hub_rep").alias("a"), F.greatest("rep", "hub_rep").alias("b")).distinct()
        links = _verified(hold.table(pairs, "pairs"), reps, docs, s, hold)
        if not links.isEmpty():
            labels = _relabel(labels, links, hold)
            held = _mixed(held.drop("comp"), labels, hold)
    if not held.isEmpty():
        left = hold.table(held.select("rep", "comp").distinct(), "left")
        sets = _sets_of(left.select("rep"), reps, docs, s, hold)
        links = _verified(hold.table(_prefix_pairs(sets, left, traits, s, hold), "pairs"), reps, docs, s, hold, sets)
        if not links.isEmpty():
            labels = _relabel(labels, links, hold)
    return labels


def _prefix_pairs(sets: DataFrame, held: DataFrame, traits: DataFrame, s: Settings, hold: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share an element of both prefixes and pass the exact bounds.

    Of a set of n elements in one order for all, similarity t leaves at least ceil(t n) in common, so the first
    n - ceil(t n) + 1 of each set meet. The order is by number of sets that hold an element, rarest first.
    """
    sized = sets.select("rep", F.size("elements").alias("n"), "elements")
    tokens = sized.select("rep", F.explode("elements").alias("e"))
    shared = hold.table(tokens.groupBy("e").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"), "elements")
    known = tokens.join(shared, "e").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("sets", "e"))).alias("known"))
    alone = F.col("n") - F.size("known")  # first in the order, and in no other set
    reach = F.col("n") - F.ceil(s.similarity * F.col("n") - 1e-9) + 1 - alone
    prefix = known.join(sized.select("rep", "n"), "rep").withColumn("reach", reach).filter("reach > 0")
    folds = [f"rep_f{i}" for i in range(_FOLD)]
    short = traits.select("rep", "rep_size", *folds).join(held, "rep")
    prefix = prefix.join(short, "rep").select("rep", "comp", "rep_size", *folds, F.explode(F.slice("known", 1, F.col("reach").cast("int"))).alias("x")).select("rep", "comp", "rep_size", *folds, "x.e")
    prefix = hold.table(prefix, "prefixes")
    side = lambda name: prefix.select("e", F.col("comp").alias(f"{name}_comp"), F.col("rep").alias(name), *(F.col(c).alias(c.replace("rep", name, 1)) for c in ("rep_size", *folds)))
    on = (F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & _may_reach_folded("a", "b", s)
    pairs = side("a").join(side("b").withColumnRenamed("e", "b_e"), (F.col("e") == F.col("b_e")) & on).select("a", "b").distinct()
    trait = lambda name: traits.select(*(F.col(c).alias(c.replace("rep", name, 1)) for c in traits.columns))
    return pairs.join(trait("a"), "a").join(trait("b"), "b").filter(_may_reach("a", "b", s)).select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame, hold: Scratch) -> DataFrame:
    """key, rep, n, comp of the members of buckets that hold several components."""
    held = hold.table(members.join(labels, "rep", "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "held")
    several = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    return hold.table(held.join(hold.table(several, "several"), "key", "left_semi"), "mixed")


def group_documents(df: DataFrame, text: str = "text", id_column: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """One row per row of df: its id, class_id (smallest id in its class; null if all are) and is_first.

    is_first is true for the rows with that id and the class's first text, so for one row where ids are unique.
    """
    rows, labels = find_groups(df, text, id_column, settings)
    return _classes(rows, labels).select(F.col("id").alias(id_column), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("first")).alias("class_id"), "is_first")


def _classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """row, id, r1, r2, class (null without text), first (smallest id) and is_first (exactly one row per class)."""
    rows = materialise(
        rows.join(labels, "rep", "left").select("row", "id", "r1", "r2", F.coalesce("comp", "rep").alias("class")), "rows"
    )
    first = rows.filter("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("low"))
    first = materialise(first.select("class", F.col("low.id").alias("first"), F.col("low.row").alias("first_row")), "classes")
    return rows.join(first, "class", "left").withColumn("is_first", F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)))


def groups_of_texts(df: DataFrame, text: str = "text", id_column: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """d1, d2 (text_key of each text that isn't null) and group: texts of one class have the same."""
    rows, labels = find_groups(df, text, id_column, settings)
    texts = rows.filter("rep is not null").select(F.col("r1").alias("d1"), F.col("r2").alias("d2"), "rep").distinct()
    return materialise(texts.join(labels, "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("group")), "groups")


def keep_one(df: DataFrame, text: str = "text", id_column: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """The rows of df with one document of each group: that of the smallest id.

    The rows to drop are named by id and text hash, so one join takes them out. Where a kept row has twins of the same
    id and text, one of them is kept: only if there are such rows, they are taken apart and de-duplicated.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    id_at, text_at = names[df.columns.index(id_column)], names[df.columns.index(text)]
    rows, labels = find_groups(df, text, id_column, settings)
    all_rows = _classes(rows, labels).filter("class is not null").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("i"), F.col("id").isNull().alias("z"), "r1", "r2", "is_first")
    fate = all_rows.groupBy("i", "z", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.max("is_first").alias("stays")).filter("not stays or n > 1")
    fate = materialise(fate, "fate")
    key = text_key(F.col(text_at).cast("string"))
    ident = F.col(id_at).cast("string")
    on = ["i", "z", "r1", "r2"]
    # no key where the text is null: such a row meets nothing
    keyed = df.toDF(*names).withColumns({"i": F.when(F.col(text_at).isNotNull(), F.coalesce(ident, F.lit(""))), "z": ident.isNull(), "r1": key[0], "r2": key[1]})
    out = keyed.join(fate.select(*on), on, "left_anti").select(*names)
    twins = fate.filter("stays")
    if not twins.isEmpty():
        out = out.union(keyed.join(twins.select(*on), on, "left_semi").dropDuplicates(on).select(*names))
    return out.toDF(*df.columns)
