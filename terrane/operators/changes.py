"""Change analytics over pairs of texts and versions of tables."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, rules, text
from ..functions.ids import as_col
from ..session import written
from ..sources.bucketed import Change, Snapshot, Store
from . import extract, graph

WS = "workspace_id"


def diff_pairs(pairs: DataFrame, key: str = "doc_id", path: Column | None = None) -> DataFrame:
    """(key, diff, matched, old_lines, new_lines) of each (old_text, new_text) pair, diffed where it lies.

    ``matched`` sums the matching blocks of a sequence matcher, which is not
    the longest common subsequence.
    """
    name = path if path is not None else F.col(key).cast("string")
    kind = dict(pairs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, p, old, new in zip(pdf[key], pdf["_path"], pdf["old_text"], pdf["new_text"]):
                a, b = old.splitlines(), new.splitlines()
                same = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
                shown = difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{p}", f"b/{p}", lineterm="")
                out.append((k, "\n".join(shown), same, len(a), len(b)))
            yield pd.DataFrame(out, columns=[key, "diff", "matched", "old_lines", "new_lines"])

    return pairs.select(key, name.alias("_path"), "old_text", "new_text").mapInPandas(run, f"`{key}` {kind}, diff string, matched int, old_lines int, new_lines int")


def diff_summary(diffed: DataFrame) -> DataFrame:
    """Adds lines_added, lines_removed, percent_change, lines_changed and a sentence."""
    added, removed = F.col("new_lines") - F.col("matched"), F.col("old_lines") - F.col("matched")
    longest = F.greatest("old_lines", "new_lines")
    parts = F.concat_ws(
        ", ", F.when(added > 0, F.concat(added.cast("string"), F.lit(" lines added"))), F.when(removed > 0, F.concat(removed.cast("string"), F.lit(" lines removed")))
    )
    return diffed.withColumns({
        "lines_added": added, "lines_removed": removed, "percent_change": (added - removed) / F.greatest(longest, F.lit(1)) * 100.0,
        "lines_changed": longest - F.col("matched"), "summary": F.when(parts == "", "No changes").otherwise(parts),
    })


def change_sentence(lines_changed: Column | str, delta: Column | str) -> Column:
    d = as_col(delta)
    sign = F.when(d >= 0, "+").otherwise("")
    return F.concat(F.lit("~"), as_col(lines_changed).cast("string"), F.lit(" lines changed, complexity delta: "), sign, d.cast("string"), F.lit("%"))


def parse_diff(diffs: DataFrame, key: str = "diff_id") -> DataFrame:
    """Typed lines of unified diffs with old and new line numbers.

    Numbers are the hunk's start plus the lines of the right kinds before it
    in the hunk.  A diff is one text, so each window spans one input row.
    """
    header = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    rows = diffs.select(key, F.posexplode(F.split("diff", "\n")).alias("pos", "raw"))
    kind = (
        F.when(F.col("raw").rlike(r"^(--- |\+\+\+ )"), "meta").when(F.col("raw").rlike(header), "hunk")
        .when(F.col("raw").startswith("+"), "add").when(F.col("raw").startswith("-"), "remove").when(F.col("raw") != "", "context")
    )
    typed = rows.withColumn("type", kind).filter("type IS NOT NULL")
    start = {c: F.when(F.col("type") == "hunk", F.regexp_extract("raw", header, i).cast("int")) for i, c in ((1, "_old0"), (2, "_new0"))}
    order = Window.partitionBy(key).orderBy("pos")
    hunks = typed.withColumns({"_hunk": F.count_if(F.col("type") == "hunk").over(order), **start})
    before = Window.partitionBy(key, "_hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key, "_hunk")

    def number(first: str, kinds: list[str]) -> Column:
        base = F.coalesce(F.max(first).over(whole), F.lit(0))
        passed = F.coalesce(F.count_if(F.col("type").isin(kinds)).over(before), F.lit(0))
        return F.when(F.col("type").isin(kinds), (base + passed).cast("int"))

    body = F.when(F.col("type").isin("add", "remove"), F.substr("raw", F.lit(2))).when(
        (F.col("type") == "context") & F.col("raw").startswith(" "), F.substr("raw", F.lit(2))
    ).otherwise(F.col("raw"))
    return hunks.select(
        key, "pos", "type", number("_old0", ["remove", "context"]).alias("old_line"), number("_new0", ["add", "context"]).alias("new_line"), body.alias("content")
    )


def line_set_diff(old: Column | str, new: Column | str) -> Column:
    """struct(added, removed): sorted distinct lines found on one side only."""
    o, n = text.lines(old), text.lines(new)
    return F.struct(F.array_sort(F.array_except(n, o)).alias("added"), F.array_sort(F.array_except(o, n)).alias("removed"))


def change_summary(pairs: DataFrame) -> DataFrame:
    """Set-based line counts, percent change and complexity delta of each pair."""
    lined = pairs.withColumns({"_o": F.array_distinct(text.lines("old_text")), "_n": F.array_distinct(text.lines("new_text"))})
    added, removed = F.size(F.array_except("_n", "_o")), F.size(F.array_except("_o", "_n"))
    most = F.greatest(F.size("_o"), F.size("_n"))
    return lined.withColumns({"lines_added": added, "lines_removed": removed}).withColumns({
        "percent_change": F.round(F.when(most > 0, (F.col("lines_added") - F.col("lines_removed")) / most * 100).otherwise(0.0), 2),
        "complexity_delta": text.complexity_delta(text.keyword_complexity("old_text"), text.keyword_complexity("new_text")),
    }).drop("_o", "_n")


def removed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(module, kind, message): functions and classes that a new version lost."""
    kept = new.select(WS, "module_name", "kind", "name").distinct()
    lost = (
        old.filter(F.col("kind").isin("function", "class")).select(WS, "module_name", "kind", "name").distinct()
        .join(kept, [WS, "module_name", "kind", "name"], "left_anti")
    )
    noun = F.when(F.col("kind") == "class", "Removed classes: ").otherwise("Removed functions: ")
    names = F.array_join(F.array_sort(F.collect_list("name")), ", ")
    return lost.groupBy(WS, "module_name", "kind").agg(names.alias("_names")).select(WS, "module_name", "kind", F.concat(noun, "_names").alias("message"))


def removed_imports(old: DataFrame, new: DataFrame) -> DataFrame:
    """(module, import): imported names (or modules) that a new version lost."""
    what = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("raw_module"), F.lit("")))

    def named(df: DataFrame) -> DataFrame:
        return df.select(WS, "module_name", what.alias("import")).filter("import IS NOT NULL").distinct()

    return named(old).join(named(new), [WS, "module_name", "import"], "left_anti")


# Brackets, strings and comments in order of appearance.  Strings may span
# lines; a backslash also escapes the first character of the next line.
_JS_TOKENS = re.compile(
    r"//[^\n\r]*|/\*.*?\*/|(?P<comment>/\*)|(?P<quote>['\"`])(?:\\[\r\n]*.|(?!(?P=quote))[^\\])*(?P<closed>(?P=quote))?|(?P<bracket>[()\[\]{}])", re.S
)
_OPENER = {")": "(", "}": "{", "]": "["}


def js_syntax_errors(code: str) -> list[tuple[int | None, str]]:
    """(line, message) of unmatched, mismatched and unclosed brackets, strings and comments."""
    errors, stack, line, at = [], [], 1, 0
    tail = []
    for m in _JS_TOKENS.finditer(code):
        line += len(re.findall(r"\r\n|[\n\r]", code[at : m.start()]))
        at = m.start()
        if m["comment"]:
            tail.append((None, "Unclosed block comment"))
            break
        if m["quote"] and not m["closed"]:
            tail.append((None, f"Unclosed string literal ({m['quote']})"))
            break
        b = m["bracket"]
        if not b:
            continue
        if b not in _OPENER:
            stack.append((b, line))
        elif not stack:
            errors.append((line, f"Unmatched closing bracket '{b}'"))
        else:
            top, where = stack.pop()
            if _OPENER[b] != top:
                errors.append((line, f"Mismatched bracket '{b}', expected closing for '{top}' from line {where}"))
    if stack:
        tail.append((None, f"Unclosed bracket '{stack[-1][0]}' opened at line {stack[-1][1]}"))
    return errors + tail


def syntax_check(files: DataFrame) -> DataFrame:
    """(workspace_id, path, line, message) of syntax problems; clean files give no row."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for ws, path, code in zip(pdf["workspace_id"], pdf["path"], pdf["content"]):
                if path.endswith(".py"):
                    try:
                        ast.parse(code)
                    except (SyntaxError, ValueError) as e:
                        rows.append((ws, path, getattr(e, "lineno", None), getattr(e, "msg", None) or str(e)))
                else:
                    rows += [(ws, path, ln, msg) for ln, msg in js_syntax_errors(code)]
            out = pd.DataFrame(rows, columns=["workspace_id", "path", "line", "message"])
            yield out.assign(line=out["line"].astype("Int32"))

    source = files.filter(F.lower(ids.suffix("path")).isin(rules.SOURCE_SUFFIXES)).select(WS, "path", "content")
    return source.mapInPandas(check, "workspace_id string, path string, line int, message string")


def validate_changes(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Per changed file: validity, error and breaking-change counts, dependents, complexity delta.

    ``pairs`` carries (workspace_id, path, old_text, new_text).  Breaking
    changes are reported but do not invalidate.
    """
    old, new = (pairs.select(WS, "path", F.col(c).alias("content")) for c in ("old_text", "new_text"))
    before, after = extract.extract_corpus(old, settle=True), extract.extract_corpus(new, settle=True)
    syntax = syntax_check(new).groupBy(WS, "path").agg(F.count("*").alias("syntax_errors"))
    # a Python file that does not parse has no symbols to compare
    broken = syntax.filter(F.col("path").endswith(".py")).select(WS, ids.module_id("path").alias("module_name"))
    lost = removed_imports(before["imports"], after["imports"]).join(broken, [WS, "module_name"], "left_anti").groupBy(WS, "module_name").agg(F.count("*").alias("import_errors"))
    gone = removed_symbols(before["symbols"], after["symbols"]).join(broken, [WS, "module_name"], "left_anti").groupBy(WS, "module_name").agg(F.count("*").alias("breaking_changes"))
    near = graph.affected_dependents(edges, pairs).groupBy(WS, "path").agg(F.count("*").alias("affected_dependents"))

    def branches(tables: dict[str, DataFrame], source: DataFrame, name: str) -> DataFrame:
        parsed = tables["modules"].select(WS, "path", F.col("complexity").alias("_ast"))
        words = source.select(WS, "path", text.keyword_complexity("content").alias("_words"))
        return words.join(parsed, [WS, "path"], "left").select(WS, "path", F.coalesce("_ast", "_words").alias(name))

    counts = ["syntax_errors", "import_errors", "breaking_changes", "affected_dependents"]
    joined = (
        pairs.select(WS, "path", ids.module_id("path").alias("module_name")).join(syntax, [WS, "path"], "left").join(lost, [WS, "module_name"], "left")
        .join(gone, [WS, "module_name"], "left").join(near, [WS, "path"], "left")
        .join(branches(before, old, "_c0"), [WS, "path"]).join(branches(after, new, "_c1"), [WS, "path"])
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
    )
    return joined.select(
        WS, "path", ((F.col("syntax_errors") == 0) & (F.col("import_errors") == 0)).alias("is_valid"), *counts,
        F.when((F.col("syntax_errors") > 0) & F.col("path").endswith(".py"), F.lit(0)).otherwise(text.complexity_delta("_c0", "_c1")).alias("complexity_delta"),
    )


def batch_verdict(changes: DataFrame) -> DataFrame:
    """Every change with its batch's verdict: one invalid item fails the batch."""
    verdict = changes.groupBy(WS, "batch_id").agg(F.bool_and("is_valid").alias("applied"))
    return changes.join(verdict, [WS, "batch_id"])


def apply_batch(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Store with the files of passing batches replaced; failed batches leave no trace."""
    passed = batch_verdict(changes).filter("applied").select(*store.columns)
    return graph.merge_snapshots(store, passed, (WS, "path"))


def commit_batch(store: Store, table: str, changes: DataFrame) -> Snapshot:
    """Publish the files of passing batches as one version of a bucketed table keyed by (workspace_id, path).

    Of two writers of the same files one wins and the other starts again
    from its version; every version stays readable (``store.snapshot(n)``).
    """
    passed = written(batch_verdict(changes).filter("applied"), "passed")

    def put(change: Change) -> None:
        rows = passed.select(*change.base.schema(table).names)
        change.upsert(table, graph.merge_snapshots(rows.limit(0), rows, tuple(change.base.keys(table))))

    return store.transact(put)


def versioned_snapshot(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Prior version of every changed file under a time-stamped name beside it.

    ``changes`` carries (workspace_id, path, changed_at).
    """
    name, ext = ids.file_name("path"), F.coalesce(F.nullif(ids.suffix("path"), F.lit("")), F.lit(".py"))
    stem = F.left(name, F.length(name) - F.length(ids.suffix("path")))
    backup = F.concat(stem, F.lit("_backup_"), F.date_format("changed_at", "yyyyMMdd_HHmmss"), ext)
    folder = ids.parent_path("path")
    full = F.when(folder == "", backup).otherwise(F.concat(folder, F.lit("/"), backup))
    return store.join(changes.select(WS, "path", "changed_at"), [WS, "path"]).withColumn("backup_path", full)


def restore(versions: DataFrame, at: Column) -> DataFrame:
    """Latest version of each file saved no later than ``at``."""
    rest = [c for c in versions.columns if c not in (WS, "path")]
    best = versions.filter(F.col("changed_at") <= at).groupBy(WS, "path").agg(F.max_by(F.struct(*rest), "changed_at").alias("v"))
    return best.select(WS, "path", "v.*")
