"""Operator 1: quality rules, a threshold table compiled into one projection of built-in expressions.

No Python runs on the executors and nothing is shuffled: each text is measured where it is read.
Null text: no words. Empty text: no words, one line. Both fail the base rule. Repeated rows are measured alike;
an empty table gives an empty one; texts of any length are measured whole. Other columns are passed through untouched;
where one has a measure's name, the measure gets an underscore behind its name.

The stop words are those of four languages: a text in another language has few of them and is rejected, so use other
rules for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import free_name

#: Characters that split words (space, tab to carriage return), and characters counted as symbols.
WORD_BREAK, SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for on with as by at it be this are was from an a "
    "der die das und den von zu mit nicht ist ein eine im auf des sich dem als auch "
    "la le les de du et en un une que qui pour dans par sur est pas il elle au aux avec "
    "el los las y del se por con una su para no lo es"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject when left * measure > right * base (both measures are whole numbers, so no rounding decides)."""

    name: str
    left: int
    measure: str
    right: int
    base: str


#: The base rules of the contract, then the method's own thresholds.
BASE_RULES = (
    Rule("too_short", 10, "one", 1, "n_words"),
    Rule("repeated_windows", 100, "n_repeat_words", 20, "n_words"),
)
RULES = (
    Rule("symbols", 100, "n_symbols", 10, "n_words"),
    Rule("few_stop_words", 3, "n_words", 100, "n_stop_words"),
    Rule("short_words", 2, "n_words", 1, "word_chars"),
    Rule("long_words", 1, "word_chars", 12, "n_words"),
    Rule("duplicate_lines", 100, "n_dup_lines", 50, "n_lines"),
    Rule("capitals", 100, "n_capitals", 40, "word_chars"),
    Rule("stutter", 100, "n_stutter", 25, "n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals", "n_stutter")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once and not again for each element of a lambda inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(grams: Column) -> Column:
    """Words inside 5-word windows whose content occurs twice or more: sort the windows, keep those that equal a
    neighbour, and add up the union of their spans in order of position."""
    placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    again = _bind(F.sort_array(placed), lambda ranked: F.filter(
        F.transform(
            ranked,
            lambda x, k: F.when((F.get(ranked, k - 1)["g"] == x["g"]) | (F.get(ranked, k + 1)["g"] == x["g"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    ))
    return F.aggregate(
        F.sort_array(again),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + i + 5 - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )


def _grams(codes: Column) -> Column:
    """Chained 64-bit hashes of the 5-word windows."""
    windows = F.transform(F.sequence(F.lit(0), F.size(codes) - 5), lambda i: F.xxhash64(*(F.get(codes, i + k) for k in range(5))))
    return F.when(F.size(codes) >= 5, windows).otherwise(F.array().cast("array<bigint>"))


def _measures(own: Column, words: Column, codes: Column, lines: Column, grams: Column) -> Column:
    stop = [F.lit(w) for w in dict.fromkeys(STOP_WORDS)]
    values = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": _count(own, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(_repeat_words(grams)),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))),
        "n_capitals": _count(own, "[A-Z]+"),
        "n_stutter": F.size(F.filter(codes, lambda c, i: c == F.get(codes, i - 1))),
    }
    return F.struct(*(v.cast("bigint").alias(k) for k, v in values.items()))


def _broken(m: Column, rules: tuple[Rule, ...]) -> Column:
    of = lambda name: F.lit(1) if name == "one" else m[name]
    return F.array_compact(F.array(*(F.when(F.lit(r.left) * of(r.measure) > F.lit(r.right) * of(r.base), F.lit(r.name)) for r in rules)))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one expression: struct of the measures, base_failed, broken_rules and kept.

    Every intermediate array is bound to a lambda variable, so it is built once per row wherever the optimizer
    moves the expression.
    """
    def judged(m: Column) -> Column:
        base, own = _broken(m, BASE_RULES), _broken(m, rules)
        return F.struct(
            *(m[k].alias(k) for k in MEASURES), (F.size(base) > 0).alias("base_failed"), F.concat(base, own).alias("broken_rules"),
            ((F.size(base) == 0) & (F.size(own) == 0)).alias("kept"),
        )

    def by_codes(own: Column, words: Column, codes: Column) -> Column:
        lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _bind(lines, lambda ls: _bind(_grams(codes), lambda gs: _bind(_measures(own, words, codes, ls, gs), judged)))

    own = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(own, WORD_BREAK), "")
    return _bind(words, lambda ws: _bind(F.transform(ws, lambda w: F.xxhash64(w)), lambda cs: by_codes(own, ws, cs)))


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, base_failed, broken_rules (names, array<string>) and kept at the end."""
    name = free_name(df, "_verdict")
    names = [*MEASURES, "base_failed", "broken_rules", "kept"]
    judged = df.withColumn(name, verdict(F.col(f"`{text}`"), rules))
    return judged.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"{name}.{n}").alias(free_name(df, n)) for n in names))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Only the rows that no rule rejects, with their columns as they were."""
    return df.filter(verdict(F.col(f"`{text}`"), rules)["kept"])
