"""Column expressions over texts: tokens, checksums, line splits, complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .ids import as_col

BLANK = r"[ \t\n\x0B\f\r]+"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def words(c: Column | str) -> Column:
    """Whitespace-separated words; blanks are the ASCII ones."""
    return F.filter(F.split(as_col(c), BLANK), lambda w: w != "")


def spaced_words(c: Column | str) -> Column:
    """Words, each with the blanks before it: joined, they are the text up to its last word."""
    return F.regexp_extract_all(as_col(c), F.lit(r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+"), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(as_col(c), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("bigint")


def token_count(c: Column | str, mode: str = "words") -> Column:
    """Token length: ``words`` or ``chars4`` (a quarter of the characters)."""
    if mode == "words":
        return word_count(c)
    if mode == "chars4":
        return F.floor(F.length(as_col(c)) / 4).cast("bigint")
    raise ValueError(f"unknown token mode {mode!r}")


def checksum(c: Column | str) -> Column:
    return F.sha2(F.encode(as_col(c), "UTF-8"), 256)


def line_chunk_id(source: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(as_col(source), F.lit("::L"), as_col(start).cast("string"), F.lit("-L"), as_col(end).cast("string"))


def token_chunk_id(source: Column | str, n: Column | str) -> Column:
    return F.concat(as_col(source), F.lit("::chunk_"), as_col(n).cast("string"))


def embed_text(source: Column | str, symbol: Column | str | None, text: Column | str) -> Column:
    """Text with a location header, as fed to the embedding model."""
    head = F.concat(F.lit("# File: "), as_col(source))
    if symbol is not None:
        s = as_col(symbol)
        head = F.concat(head, F.when(F.coalesce(F.length(s), F.lit(0)) > 0, F.concat(F.lit("\n# Symbol: "), s)).otherwise(""))
    return F.concat(head, F.lit("\n\n"), as_col(text))


def lines(c: Column | str) -> Column:
    """Lines without ends; a final line end adds no empty line."""
    cut = F.split(as_col(c), LINE_END)
    n = F.size(cut)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), n - 1)).otherwise(cut)


def keyword_complexity(c: Column | str) -> Column:
    """Branch keywords as whole words plus branch marks as substrings."""
    c = as_col(c)
    total = F.lit(0)
    for w in rules.COMPLEXITY_WORDS:
        total = total + F.regexp_count(c, F.lit(rf"\b{w}\b"))
    for m in rules.COMPLEXITY_MARKS:
        total = total + F.floor((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m))
    return total.cast("bigint")


def complexity_delta(old: Column | str, new: Column | str) -> Column:
    """Percent change cut toward zero; 0 when there was nothing before."""
    o, n = as_col(old).cast("double"), as_col(new).cast("double")
    return F.when(o == 0, F.lit(0)).otherwise(((n - o) / F.nullif(o, F.lit(0.0)) * 100).cast("int"))


def cache_key(task: Column | str, path: Column | str, content: Column | str, extra: Column | str) -> Column:
    raw = F.concat_ws(":", as_col(task), as_col(path), checksum(F.coalesce(as_col(content), F.lit(""))), F.coalesce(as_col(extra), F.lit("")))
    return checksum(raw)
