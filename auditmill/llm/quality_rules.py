"""Quality rules: a table of thresholds compiled into one projection of Spark's own expressions.

RULES names a measure, its least and its largest value. compile_rules() turns them into one column of failed rules over the counts that
counted() projects. There are no user functions and no shuffle: a row is judged on its own text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = """
a an and are as at be by for from has have in is it of on or that the they this to was were will with
am auf aus bei das dem den der des die ein eine einen er es für ich im ist mit nicht sich sie und von wie zu zum
au aux ce dans de des du elle en est et il je la le les ne par pas plus pour que qui se sur un une vous
al como con del el ella en es esta la las lo los no para por que se su un una y ya
"""


class Rule(NamedTuple):
    name: str
    measure: str
    least: float | None
    largest: float | None
    #: A base rule rejects whatever the others say.
    base: bool = False


RULES = (
    Rule("words", "n_words", 50, None, True),
    Rule("repeats", "repeat_ratio", None, 0.5, True),
    Rule("word_length", "mean_word_chars", 2.5, 14),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.05, None),
    Rule("same_lines", "dup_line_ratio", None, 0.5),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
#: Bits of a window's code that are its place; the others are of its hash.
_PLACE = 31


def stop_forms() -> list[str]:
    """What counts as a stop word: in lower case, capitalised or in upper case, with one mark after it at most."""
    words = dict.fromkeys(STOP_WORDS.split())
    return list(dict.fromkeys(form + mark for w in words for form in (w, w.capitalize(), w.upper()) for mark in ("", *".,;:!?")))


def _windows(words: Column) -> Column:
    """For each three-word window a number: bits of its hash, then its place; sorted, so that equal windows are neighbours."""
    hashed = F.lit(-(1 << _PLACE))
    code = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(hashed).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), code))


def _neighbours(codes: Column) -> Column:
    """Of the sorted codes, those whose hash bits their neighbour has too: a few hundred places at most in most texts."""
    own = lambda x: F.shiftright(x, _PLACE)
    return F.filter(codes, lambda x, k: (own(x) == own(F.get(codes, k - 1))) | (own(x) == own(F.get(codes, k + 1))))


def _spelt(words: Column, codes: Column) -> Column:
    """The windows of these codes as (text, place), sorted."""

    def window(x: Column) -> Column:
        i = x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("t"), i.alias("i"))

    return F.sort_array(F.transform(codes, window))


def _covered(windows: Column) -> Column:
    """Words in the windows that equal a neighbour."""
    same = F.filter(windows, lambda x, k: (x["t"] == F.get(windows, k - 1)["t"]) | (x["t"] == F.get(windows, k + 1)["t"]))
    return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def counted(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns keep and COUNTS (as long) of each row. Steps that several counts need are columns, computed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    at = docs.select(*keep, F.regexp_count(text, F.lit(SYMBOL)).alias("_symbols"), words.alias("_words"), lines.alias("_lines"))
    at = at.select("*", _windows(F.col("_words")).alias("_codes"))
    at = at.select("*", _neighbours(F.col("_codes")).alias("_same"))
    at = at.select("*", _spelt(F.col("_words"), F.col("_same")).alias("_windows"))
    made = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.col("_symbols"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*stop_forms()))),
        "n_repeat_words": _covered(F.col("_windows")),
    }
    return at.select(*keep, *(made[c].cast("long").alias(c) for c in COUNTS))


def ratios() -> dict[str, Column]:
    of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"mean_word_chars": of("word_chars", "n_words"), "symbol_ratio": of("n_symbols", "n_words"), "stop_ratio": of("n_stop_words", "n_words"), "dup_line_ratio": of("n_dup_lines", "n_lines"), "repeat_ratio": of("n_repeat_words", "n_words")}


def compile_rules(rules: tuple[Rule, ...], base: bool | None = None) -> Column:
    """The names of failed rules (only base rules, or only others, if asked)."""
    has = ratios()
    failed = []
    for r in rules:
        if r.measure not in {*COUNTS, *has}:
            raise ValueError(f"{r.name}: no measure {r.measure}")
        if base is None or r.base == base:
            x = has.get(r.measure, F.col(r.measure))
            outside = F.lit(False)
            outside = outside | (x < r.least) if r.least is not None else outside
            outside = outside | (x > r.largest) if r.largest is not None else outside
            failed.append(F.when(outside, F.lit(r.name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs (doc_id, text), the counts, base_failed, kept and failed (names of rules), of each row.

    A null or empty text has no words, and fails. Ratios of nothing are 0. Rows are judged alone: repeated rows are judged alike. Columns
    of docs that are not in keep are dropped, so that their names cannot clash."""
    failed = counted(docs, keep).select("*", compile_rules(rules, True).alias("_base"), compile_rules(rules, False).alias("_own"))
    base = F.size("_base") > 0
    return failed.select(*keep, *COUNTS, base.alias("base_failed"), (~base & (F.size("_own") == 0)).alias("kept"), F.concat("_base", "_own").alias("failed"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs (with a column text) that all rules pass; all columns."""
    judged = judge(docs.select(F.struct("*").alias("_row"), "text"), rules, keep=("_row",))
    # a filter on plain columns would be pushed below the steps, with a copy of every step in it for each use; it stays above what isn't deterministic
    return judged.select("_row", "kept", F.monotonically_increasing_id().alias("_at")).where("kept and _at >= 0").select("_row.*")
