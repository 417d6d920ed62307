"""Scalar text functions, Column to Column, in the JVM but for NFC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.profiles import LangProfile

#: White space as str.split() has it, and line ends as str.splitlines() has them.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: No-break, wide, thin, zero-width and narrow spaces, byte-order mark, tab.
ODD_SPACES = "            ​ ﻿\t"
SENTENCE_END = r"[.!?\x{0964}\x{0965}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def lines(c: Column) -> Column:
    """Lines as str.splitlines(): a line end at the end of the text begins no line."""
    return let(F.split(c, LINE_END), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def sentences(c: Column) -> Column:
    return F.split(c, rf"(?<={SENTENCE_END})[{SPACE}]+")


def word_ngrams(tokens: Column, n: int) -> Column:
    """Lists of n tokens on end; none if there are fewer."""
    grams = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))
    return let(tokens, lambda a: F.when(F.size(a) >= n, grams(a)).otherwise(F.array().cast("array<array<string>>")))


def _runs(a: Column, n: int, between: str) -> Column:
    """Every n neighbours of a list joined; neighbours are picked by place, which costs the same anywhere in a list."""
    return F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.concat_ws(between, *[F.get(a, i + k) for k in range(n)]))


def word_shingles(tokens: Column, n: int = 3) -> Column:
    """n tokens joined by a space; the whole list as one shingle if there are fewer."""
    return let(tokens, lambda a: F.when(F.size(a) >= n, _runs(a, n, " ")).otherwise(F.array(F.array_join(a, " "))))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """n characters on end after spaces are deleted; the whole text, empty too, if there are fewer."""
    letters = F.split(F.replace(c, F.lit(" "), F.lit("")), "")
    return let(letters, lambda a: F.when(F.size(a) >= n, _runs(a, n, "")).otherwise(F.array(F.array_join(a, ""))))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """NFC; only texts that are not all ASCII can change, but Spark runs the function over all."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_nfc(c))


def normalize_whitespace(c: Column, collapse_blank_lines: bool = True) -> Column:
    c = F.translate(c, ODD_SPACES, " " * len(ODD_SPACES))
    for pattern, to in ((r" {2,}", " "), (r" +\n", "\n"), (r"\n +", "\n"), *([(r"\n{3,}", "\n\n")] if collapse_blank_lines else [])):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def remove_emojis(c: Column, profile: LangProfile) -> Column:
    return F.regexp_replace(c, f"[{profile.emoji}]+", "")


def fix_ravattu_brackets(c: Column, profile: LangProfile) -> Column:
    if not profile.brackets:
        return c
    return F.regexp_replace(c, rf"[(\[{{](['\"‘“{SPACE}]*[{profile.brackets}]{profile.virama}\x{{0C30}})", "$1")


def web_clean(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(nfc(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def flatten(c: Column) -> Column:
    return strip(F.regexp_replace(nfc(c), f"[{SPACE}]+", " "))


def remove_boilerplate(c: Column, starts: list[str]) -> Column:
    """Delete from each of the starts (regexes) to the next blank line or the end."""
    for start in starts:
        c = F.regexp_replace(c, rf"(?is){start}.*?(?:\n\s*\n|\z)", "")
    return strip(c)


#: What is taken out of wikitext, in order, and what is left of it.
WIKITEXT = [
    (r"\{\{[^}]*\}\}", ""),
    (r"(?i)\[\[(?:File|Image|Category|వర్గం|దస్త్రం):[^\]]*\]\]", ""),
    (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<[^>]+>", ""),
    (r"'{2,}", ""),
    (r"={2,}[^=]+={2,}", ""),
    (r"\n{3,}", "\n\n"),
]


def strip_wikitext(c: Column) -> Column:
    for pattern, to in WIKITEXT:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\p{Nd}+", "#")


def safe_filename(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_\-]", "_"), 1, most)


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", "")


def answer_is_correct(generated: Column, option: Column, full: Column, profile: LangProfile) -> Column:
    """Whether a generated answer is the gold option or the full answer, alone, after the marker, or inside."""
    bare = lambda c: F.regexp_replace(collapse(c), r"[\x{0964}.]+$", "")
    marker = profile.answer_marker

    def judge(s: Column) -> Column:
        g, o, f = s["g"], s["o"], s["f"]
        gc, oc, fc = compact(g), compact(o), compact(f)
        after = compact(F.regexp_replace(strip(F.regexp_replace(g, rf"(?s)^.*?{marker}", "")), r"[\x{0964}.]+$", ""))
        return (g != "") & (o != "") & (
            (g == o)
            | (g == f)
            | F.contains(g, F.concat(F.lit(f"{marker} "), o))
            | (gc == oc)
            | (gc == fc)
            | F.contains(gc, F.concat(F.lit(marker), oc))
            | (~oc.rlike(r"^\p{Nd}+$") & (F.length(oc) >= 3) & F.contains(gc, oc))
            | (F.contains(g, F.lit(marker)) & (after == oc))
        )

    return let(F.struct(bare(generated).alias("g"), bare(option).alias("o"), bare(full).alias("f")), judge)


def cut_at_stops(c: Column, stops: list[str]) -> Column:
    for stop in stops:
        c = F.when(F.contains(c, F.lit(stop)), strip(F.substring_index(c, stop, 1))).otherwise(c)
    return c


def prompt(question: Column, profile: LangProfile) -> Column:
    return F.concat(F.lit(f"{profile.question_tag} "), question, F.lit(f"\n{profile.answer_marker}:"))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    c = F.lit(template)
    for name, value in values.items():
        c = F.replace(c, F.lit(f"{{{name}}}"), value)
    return c


def join_names(names: Column, last: str = "and") -> Column:
    """a, b and c."""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(
        F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(f" {last} "), F.element_at(names, -1))
    )


def sample_tag(name: Column) -> Column:
    """The last number of a name as 100, 2k or 1.5k."""
    n = F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).cast("bigint")
    return F.when(n < 1000, n.cast("string")).when(n % 1000 == 0, F.concat((n / 1000).cast("bigint").cast("string"), F.lit("k"))).otherwise(
        F.concat((n / 1000).cast("string"), F.lit("k"))
    )


def split_prefixed_line(c: Column) -> tuple[Column, Column]:
    """First word and the rest of a line, both '' for a blank line."""
    s = strip(c)
    return F.regexp_extract(s, rf"^([^{SPACE}]+)", 1), F.regexp_replace(s, rf"^[^{SPACE}]+[{SPACE}]*", "")


def label_of(prefix: Column) -> Column:
    """A label's prefix in lower case without colons and spaces around it; null if it is no label."""
    p = F.lower(F.regexp_replace(prefix, r"^[: \x{a0}]+|[: \x{a0}]+$", ""))
    return F.when(p.isin("manual", "public"), p)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def pick_prompt(hop: Column, category: Column, question: Column, order: Column, wanted: str) -> Column:
    """Over a group: the first question, in order, of two hops and the wanted category, or else the first of all."""
    fits = (hop == 2) & (category == wanted)
    return F.coalesce(F.min_by(F.when(fits, question), F.when(fits, order)), F.min_by(question, order))


def numeric_order(path: Column) -> Column:
    """What paths are ordered by: the first number of a file's name, paths without one last, then the path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.struct(F.when(digits == "", float("inf")).otherwise(digits.cast("double")).alias("number"), path.alias("path"))
