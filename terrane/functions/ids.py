"""Column expressions over paths, dotted ids and symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def unix_path(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit("\\"), F.lit("/"))


def file_name(c: Column | str) -> Column:
    return F.substring_index(unix_path(c), "/", -1)


def parent_path(c: Column | str) -> Column:
    """Directory of a path; empty at the top."""
    return F.regexp_extract(unix_path(c), r"^(.+)/[^/]*$", 1)


def suffix(c: Column | str) -> Column:
    """Last extension with its dot, empty for none or for dot-files."""
    return F.regexp_extract(file_name(c), r"^.+(\.[^.]+)$", 1)


def module_id(c: Column | str) -> Column:
    """Path minus its last suffix, separators turned into dots."""
    c = as_col(c)
    stem = F.left(c, F.length(c) - F.length(suffix(c)))
    return F.translate(stem, "/\\", "..")


def language(c: Column | str) -> Column:
    """Language named by the suffix, NULL when unknown."""
    pairs = [F.lit(x) for kv in rules.LANGUAGE_BY_SUFFIX.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(suffix(c)))


def last_segment(c: Column | str) -> Column:
    """Last non-empty dotted part."""
    return F.regexp_extract(as_col(c), r"([^.]+)\.*$", 1)


def display_name(c: Column | str) -> Column:
    return F.substring_index(as_col(c), ".", -1)


def prefix_of(c: Column | str) -> Column:
    """Everything before the last dot, empty when there is none."""
    return F.regexp_extract(as_col(c), r"^(.*)\.[^.]*$", 1)


# Every check in one pattern, so that a row is scanned once.
_SEMANTIC = r"^(?!ast\.)(?!.*(?:" + "|".join(re.escape(m) for m in rules.SYNTAX_DUMP_MARKERS) + r"))[^ \t\n=<>]+$"
# Parts never hold a dot, so the dotted names in the list cannot match.
_NOISE = r"(?i)(?:^|\.)(?:" + "|".join(re.escape(s) for s in rules.NOISE_SEGMENTS if "." not in s) + r")(?:\.|$)"


def is_semantic_id(c: Column | str) -> Column:
    """True for text that can name a module or symbol."""
    return F.coalesce(F.trim(as_col(c), F.lit(" \t\n\r\f\x0b")).rlike(_SEMANTIC), F.lit(False))


def is_noise_namespace(c: Column | str) -> Column:
    """True when any dotted part names a dependency or cache folder."""
    return F.coalesce(as_col(c).rlike(_NOISE), F.lit(False))


def edge_id(source: Column | str, target: Column | str, kind: Column | str) -> Column:
    text = F.concat(as_col(source), F.lit(">"), as_col(target), F.lit(":"), as_col(kind))
    return F.regexp_replace(text, r"[^A-Za-z0-9_:\-.>]+", "_")


def dotted_prefixes(c: Column | str) -> Column:
    """Proper dotted prefixes as array, longest first."""
    n = dots(c)
    made = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: before_dot(c, i))
    return F.when(n > 0, made).otherwise(strings([]))


def dots(c: Column | str) -> Column:
    """Number of dots in a text."""
    return F.length(as_col(c)) - F.length(F.replace(as_col(c), F.lit(".")))


def before_dot(c: Column | str, i: Column) -> Column:
    """Text before the ``i``-th dot; of a negative ``i`` the text after the dot that is ``-i``-th from the end."""
    return F.call_function("substring_index", as_col(c), F.lit("."), i)


def path_prefixes(c: Column | str) -> Column:
    """Every ancestor folder of a path, shallowest first."""
    parts = F.split(as_col(c), "/")
    n = F.size(parts)
    made = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(n > 1, made).otherwise(strings([]))
