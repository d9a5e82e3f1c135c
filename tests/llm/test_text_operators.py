"""Operators that work on each text: quality rules, toxicity, line dedup, byte-level BPE, language id."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.llm import byte_bpe, language_id, line_dedup, quality_rules, toxicity
from cardloom.llm.queries import BPE_RANKS
from tests.llm.fixtures import awkward, clashing, frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    loop = "one two three four five six " * 4
    rows = [*awkward(), (20, prose(1), "en", "s"), (21, loop, "en", "s"), (22, prose(2) + "\n" + loop + "\n" + prose(2), "en", "s"), (23, "### a | b" * 9, "en", "s")]
    got = quality_rules.apply_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = measured(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r["kept"] and r["base_failed"])
    english = "the cat is in the house and the dog was at the door with a bone for me " + "of all that is good to see on a day " * 1
    kept = quality_rules.keep_good(clashing(frame(spark, [(1, english, "en", "s"), (2, english.upper(), "en", "s"), (3, "a a a a " + english.replace(" ", " % "), "en", "s"), (4, None, None, None)])))
    assert [r["doc_id"] for r in kept.collect()] == [1]
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0
    taken = quality_rules.apply_rules(clashing(frame(spark, rows))).filter("doc_id = 21").select("n_words", "n_words_", "kept", "kept_", "word_chars").first()
    assert tuple(taken)[:3] == (1, measured(loop)[0], 1) and taken["kept_"] is False and taken["word_chars"] == measured(loop)[1]


def lines_dropped(texts, chars, documents):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for t in texts for k in {key(x) for x in t.split("\n")})
    bad = {k for k, n in held.items() if n >= documents and len(k) >= chars}
    return [("\n".join(x for x in t.split("\n") if key(x) not in bad), sum(key(x) in bad for x in t.split("\n"))) for t in texts]


@pytest.mark.parametrize("chars", [1, 6])
def test_line_dedup(spark, chars):
    shared = ["Licence A", "  licence a\t", "LICENCE A ", "ÀÉ", "short", ""]
    rng = random.Random(3)
    rows = awkward() + [(100 + i, "\n".join(rng.choice([*shared, f"own {i} {j}"]) for j in range(8)), "en", "s") for i in range(40)]
    df = clashing(frame(spark, rows).withColumn("n", F.monotonically_increasing_id()))
    out = line_dedup.drop_shared_lines(df, min_key_chars=chars, min_documents=5)
    assert out.columns[: len(df.columns)] == df.columns
    got = {r["n"]: r for r in out.toDF(*df.columns, "lines_", "dropped_").collect()}
    texts = {r["n"]: r["text"] or "" for r in df.collect()}
    want = dict(zip(texts, lines_dropped(list(texts.values()), chars, 5), strict=True))
    assert {n: (r["text"], r["dropped_"]) for n, r in got.items()} == want
    assert line_dedup.drop_shared_lines(frame(spark, [])).count() == 0


def test_bpe_equals_library(spark):
    ranks = byte_bpe.read_ranks(BPE_RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    letters = "ab Zé9'\n\t \x85\xa0漢字!#\x1c​\U0001f44d́st  "
    rows = [*awkward(), *((200 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(40))), "en", "s") for i in range(300))]
    rows += [(600, "<|endoftext|> it's", "en", "s"), (601, "y" * 3000 + " " + "ab" * 2000, "en", "s")]
    got = byte_bpe.round_trip(clashing(frame(spark, rows)), BPE_RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(frame(spark, rows), BPE_RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text")), BPE_RANKS)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    odd = spark.createDataFrame([(1, None), (2, [99_999_999]), (3, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in byte_bpe.decode(odd, BPE_RANKS).orderBy("doc_id").collect()] == [None, None, b""]


def test_bpe_of_two_vocabularies_and_other_patterns(spark, tmp_path):
    """One process, two vocabularies of the same size and last entry; a pattern that doesn't split at white space."""
    import base64

    docs = spark.createDataFrame([(1, "abc"), (2, ".\n"), (3, "ab c\nd")], "doc_id long, text string").coalesce(1)
    single = [bytes([b]) for b in range(256)]
    for name, merged in (("one", [b"ab", b"abc"]), ("two", [b"bc", b"abc"])):
        own = single + merged[:1] + [b".\n", b"zz"]
        (tmp_path / name).write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % i for i, k in enumerate(own)))
    for name in ("one", "two", "one"):
        for pattern in (public_tokenizers.PATTERN, r"[^ ]+|\s+"):
            ranks = byte_bpe.read_ranks(str(tmp_path / name))
            library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            got = {r["doc_id"]: list(r["ids"]) for r in byte_bpe.encode(docs, str(tmp_path / name), pattern).collect()}
            assert got == {r["doc_id"]: library.encode_ordinary(r["text"]) for r in docs.collect()}
    clash = docs.withColumn("ids", F.lit(7)).withColumn("k0", F.lit(8))
    kept = byte_bpe.encode(clash, str(tmp_path / "one"), public_tokenizers.PATTERN, keep=("doc_id", "k0"))
    assert kept.columns == ["doc_id", "k0", "ids"] and kept.filter("k0 = 8").count() == 3
    assert byte_bpe.encode(docs.limit(0), str(tmp_path / "one"), public_tokenizers.PATTERN).count() == 0


def merges_counted():
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(BPE_RANKS), public_tokenizers.PATTERN)
    encoder.prepare()
    pieces, merge = [], encoder.merge
    encoder.merge = lambda piece: pieces.append(piece) or merge(piece)
    return encoder, pieces


def test_bpe_merges_a_word_once():
    """More words than were remembered before, each once more with other signs behind it: none is merged again."""
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiouéü") for _ in range(5)) for _ in range(150_000)]
    texts = [" " + " ".join(w + sign for w in words[at : at + 5000]) for sign in ("", ".", "!!") for at in range(0, len(words), 5000)]
    encoder, pieces = merges_counted()
    got = byte_bpe._digest_columns(encoder, pa.array(texts))
    assert len(pieces) == len(set(pieces)) and len(pieces) <= len(set(words)) + 2
    assert sum(x.nbytes for t in encoder.tables for x in (*t.words, t.sizes, t.at, t.counts)) + encoder.pool.nbytes < 85 << 20
    assert got[2].to_pylist() == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_bpe_of_runs_small_tables_and_broken_text(monkeypatch):
    """Tables that are full after a few words; white space, signs and letters in all orders; neighbours that are UTF-8 only together."""
    monkeypatch.setattr(byte_bpe, "MEMO_BITS", {1: 8, 2: 8, 4: 6})
    monkeypatch.setattr(byte_bpe, "_RUN_PARTS", 100)
    encoder = merges_counted()[0]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(12)
    letters = "ab  \n\t\r\x1c\x85\xa0\u2028\u3000'stlé×ÀñЖ漢ª²5٣\u0301\u200b0#!.&\0\x7f\U0001f600"
    raw = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))).encode() for _ in range(3000)]
    raw += [None, b"", b"\xc3", b"\xa9 ab", b"a\xed\xa0\x80b", b"x" * 32, b"x" * 33, b" " * 500, b"ab " * 5000]
    texts = [(x or b"").decode("utf-8", "replace") for x in raw]
    held = pa.array(raw, pa.binary())
    runs = list(byte_bpe.encoded(encoder, pa.Array.from_buffers(pa.string(), len(held), held.buffers())))
    got = [ids[a:b].tolist() for ids, ends in runs for a, b in zip(ends, ends[1:], strict=False)]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal():
    keys = [b"k%d" % i for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.candidate(k) for k in keys) == list(range(5000)) and table.size == 5000
    assert byte_bpe.PerfectHash([]).candidate(b"x") in (-1, 0)


def test_toxicity(spark):
    rng = random.Random(7)
    insults = ["bastrudo", "vilkazza", "grumpfone", "schnarkel"]
    rows, labels = [], []
    for i in range(240):
        words = prose(i, 80).split(" ")
        if i % 4 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((1000 + i, " ".join(words), "en", "s"))
        labels.append((1000 + i, 1 - i % 2, int(i % 4 == 0)))
    labels += [(None, 1, 1), (1000, None, None), (5, 1, None)]
    docs = frame(spark, rows + awkward())
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 5 != 0
    model = toxicity.fit(docs, marks, use=held, settings=toxicity.Training(documents=100))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(clashing(docs), model).collect()}
    right = [(got[i] >= 0.5) == bool(t) for i, _, t in labels if i is not None and i in got and t is not None and i >= 1000 and i % 5 == 0]
    assert len(right) > 40 and sum(right) / len(right) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and toxicity.score(docs, model).count() == docs.count()
    # brute force: gains of every window, and the score that the model makes of their counts
    plain, bad = toxicity._compressor(model.ordinary), toxicity._compressor(model.toxic + model.ordinary)
    for i, t, *_ in rows[:20]:
        counts = Counter(min(max(len(plain(w)) - len(bad(w)) - toxicity.LOWEST, 0), toxicity.BINS - 1) for w in toxicity.windows(t.lower().encode()))
        assert got[i] == pytest.approx(model.scores(toxicity.np.array([[counts[k] for k in range(toxicity.BINS)]], float))[0])
    assert any(w.encode() in model.toxic for w in insults) and not any(w.encode() in model.ordinary for w in insults)
    two = docs.unionByName(frame(spark, [(1000, "zz " + t, "en", "s") for i, t, *_ in rows if i == 1000]))  # the smallest text of an id counts
    assert toxicity.fit(clashing(two), clashing(marks), use=held, settings=toxicity.Training(documents=100)) == model
    nothing = toxicity.fit(docs.limit(0), marks.limit(0), use=held)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, nothing).collect())
    empty = toxicity.fit(docs, marks.filter("toxic = 0"), use=held)
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_language_forward_sums_all_segmentations():
    pieces = language_id.Pieces([b"ab", b"bc", b"abc"])
    names = {bytes([b]): None for b in range(256)}
    prob = {p: random.Random(i).random() / 10 for i, p in enumerate([b"ab", b"bc", b"abc", *names])}
    array = language_id.np.zeros((pieces.count + 1, 1))
    for p, v in prob.items():
        array[pieces.find(language_id.np.array([pieces._code(p)], language_id.np.uint64))[0], 0] = v
    model = language_id.Model(["x"], pieces, array)

    def total(word):
        return 1.0 if not word else sum(prob[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in prob)

    for word in (b"abcabc", b"cab", b"zzabcb"):
        assert model.word_scores([word])[0, 0] == pytest.approx(language_id.np.log(total(word)))


def test_language(spark):
    rng = random.Random(11)
    lexicon = {"aa": "quel mare sole della notte ancora vento", "bb": "the house wind over night under stone", "cc": "straße nicht über himmel und wasser"}
    rows = [(i, " ".join(rng.choice(lexicon[lang].split()) for _ in range(12)), lang, "s") for i, lang in ((i, rng.choice(list(lexicon))) for i in range(200))]
    rows += [(300, "THE HOUSE!! WIND", None, "s"), (301, "12 %% 3", "aa", "s"), (302, "é" * 5000, None, "s")]
    docs = frame(spark, rows + awkward())
    model = language_id.fit(docs, BPE_RANKS, use=F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(clashing(docs), model).collect()}
    held = [got[i][0] == lang for i, _, lang, _ in rows[:200] if i % 4 == 2 and i > 9]
    assert sum(held) / len(held) > 0.95 and got[301] == ("und", 0.0) and got[300][0] == "bb" and got[1] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    # brute force: each word scored alone, added up, the largest sum wins
    for doc, text, *_ in [*rows[:40], rows[200], rows[202]]:
        scores = sum(model.word_scores([b" " + w.encode()])[0] for w in re.findall(r"[^\W\d_]+", text.lower()))
        best = int(scores.argmax())
        if doc > 9:
            assert got[doc] == (model.languages[best], pytest.approx(1 / language_id.np.exp(scores - scores.max()).sum()))
    again = language_id.fit(clashing(docs.repartition(3)).withColumn("langs", F.lit(1)), BPE_RANKS, use=F.col("doc_id") % 4 != 2)
    assert (again.prob == model.prob).all()  # however the table is split
    twins = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(("zz", "mm", "nn") * 3)], "doc_id long, text string, lang string")
    tied = language_id.fit(twins, BPE_RANKS, use=F.lit(True))
    assert tied.languages == ["mm", "nn", "zz"] and {(r["lang_pred"], round(r["score"], 6)) for r in language_id.predict(twins, tied).collect()} == {("mm", 0.333333)}
    many = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("bo", "ka", "re")), f"l{i:03d}") for i in range(230)], "doc_id long, text string, lang string")
    assert len(language_id.fit(many, BPE_RANKS, use=F.lit(True), settings=language_id.Training(rounds=1)).languages) == 230
    nothing = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), BPE_RANKS, use=F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(frame(spark, []), model).count() == 0


def _segmentations(word, known):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            for rest in _segmentations(word[n:], known):
                yield [word[:n], *rest]


def _toy_pieces():
    np = language_id.np
    pieces = language_id.Pieces([b"ab", b"bc", b"abc", b"bb", b"cab", b"aabb"])
    rng = np.random.default_rng(3)
    prob = rng.random((pieces.count + 1, 2)) ** 3 * 1e-3
    prob[-1] = 0
    number = lambda p: int(pieces.find(np.array([pieces._code(p)], np.uint64))[0])
    return pieces, prob, number


def test_expected_counts_equal_enumeration(monkeypatch):
    """Counts of forward and backward sums against all segmentations of short words, by either way of summing."""
    np = language_id.np
    pieces, prob, number = _toy_pieces()
    known = {b"a", b"b", b"c", b"ab", b"bc", b"abc", b"bb", b"cab", b"aabb"}
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    counts = np.array([[rng.randint(0, 5), rng.randint(1, 3)] for _ in words], float)
    want = np.zeros((pieces.count + 1, 2))
    for word, n in zip(words, counts, strict=True):
        ways = [[number(p) for p in way] for way in _segmentations(word, known)]
        weight = np.array([np.prod(prob[way], axis=0) for way in ways])
        for way, share in zip(ways, weight / weight.sum(axis=0), strict=True):
            for p in way:
                want[p] += share * n
    for together in (24, 0):
        monkeypatch.setattr(language_id, "_TOGETHER", together)
        assert np.allclose(language_id._expected(pieces, words, counts, prob), want, rtol=1e-10)
    assert np.allclose(want[:-1].sum(axis=0) > 0, True)


def test_words_of_any_length_are_summed_whole():
    """1 to 5,000 bytes against sums in exact logarithms; a word is no sum of its parts."""
    pieces, prob, number = _toy_pieces()
    model = language_id.Model(["x", "y"], pieces, prob)
    rng = random.Random(6)
    known = {p: number(p) for p in (b"a", b"b", b"c", b"ab", b"bc", b"abc", b"bb", b"cab", b"aabb")}
    for size in (1, 23, 24, 25, 26, 47, 48, 49, 200, 5000):
        word = bytes(rng.choice(b"abc") for _ in range(size))
        for c in range(2):
            logs = [0.0]
            for j in range(1, size + 1):
                terms = [logs[j - len(p)] + math.log(prob[n, c]) for p, n in known.items() if word[:j].endswith(p)]
                logs.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
            assert model.word_scores([word])[0, c] == pytest.approx(logs[-1], rel=1e-11)
    long = b"aabb" * 15
    assert model.word_scores([long])[0, 0] > model.word_scores([long[:39], long[39:]])[:, 0].sum()


def test_languages_of_the_given_tables(spark):
    """Held-out accuracy of the registered query."""
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no generated tables here")
    from cardloom.llm import queries

    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    met = queries.op8_language_id(spark, data).join(truth, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, n = met.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.99
