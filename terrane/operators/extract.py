"""Extraction jobs: source files in, normalised symbol tables out.

Python files are parsed once inside ``mapInArrow`` and leave as tagged
rows; everything after that is DataFrame work.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import ids, rules, text
from ..session import cut_lineage
from . import js, resolve

WS = "workspace_id"
TAGGED = (
    "workspace_id string, path string, tag string, ord int, kind string, class_name string, name string, alias string, raw string, level int, "
    "is_async boolean, args array<struct<name:string,annotation:string>>, returns string, docstring string, decorators array<string>, "
    "attributes array<string>, keywords array<struct<arg:string,value:string>>, start_line int, end_line int, text string, complexity int"
)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCHES = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.ExceptHandler)
_FAILS = (SyntaxError, ValueError, RecursionError)
#: Tags of the symbol table, and tags that carry text.
SYMBOLS = ("module", "import", "symbol", "call", "base")
CUT = frozenset({"chunk", "definition"})
#: Rows of a batch that leaves a parser, and characters of text in it.
FRAME_ROWS, FRAME_CHARS = 20_000, 8 << 20


def _source(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def callee_name(expr: ast.AST) -> str:
    """Dotted name of what a call reaches; only the attributes when the base is no plain name."""
    while isinstance(expr, ast.Call):
        expr = expr.func
    attributes = []
    while isinstance(expr, ast.Attribute):
        attributes.append(expr.attr)
        expr = expr.value
    if isinstance(expr, ast.Name):
        attributes.append(expr.id)
    return ".".join(reversed(attributes))


class _Lines:
    """Text of syntax nodes by position; columns count UTF-8 bytes."""

    def __init__(self, code: str) -> None:
        self.rows = [r.encode() for r in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", code)]

    def of(self, node: ast.AST) -> str:
        rows = self.rows[node.lineno - 1 : node.end_lineno]
        if not rows:
            return ""
        rows = [*rows[:-1], rows[-1][: node.end_col_offset]]
        rows[0] = rows[0][node.col_offset :]
        return b"".join(rows).decode()


def _signature(fn: ast.AST) -> dict:
    a = fn.args
    listed = [(x.arg, x) for x in [*a.posonlyargs, *a.args]]
    listed += [("*" + a.vararg.arg, a.vararg)] if a.vararg else []
    listed += [(x.arg, x) for x in a.kwonlyargs]
    listed += [("**" + a.kwarg.arg, a.kwarg)] if a.kwarg else []
    return {
        "is_async": isinstance(fn, ast.AsyncFunctionDef), "args": [{"name": n, "annotation": _source(x.annotation)} for n, x in listed],
        "returns": _source(fn.returns), "docstring": ast.get_docstring(fn), "decorators": [_source(d) for d in fn.decorator_list],
    }


def _tagged_rows(code: str, want: frozenset[str]) -> list[dict]:
    """Rows of one parse; texts that cannot be cut make an error only where nothing else is wanted."""
    try:
        tree = ast.parse(code if code.strip() else "")
    except _FAILS as e:
        return [_error_row(e)]
    rows: list[dict] = []
    for part, mine in ((_symbol_table, want - CUT), (lambda t, w: _cut_rows(t, code, w), want & CUT)):
        try:
            rows += list(part(tree, mine)) if mine else []
        except _FAILS as e:
            if part is _symbol_table or mine == want:
                rows.append(_error_row(e))
    return rows


def _error_row(e: Exception) -> dict:
    return {"tag": "error", "raw": getattr(e, "msg", None) or str(e), "start_line": getattr(e, "lineno", None)}


def _symbol_table(tree: ast.Module, want: frozenset[str]) -> Iterator[dict]:
    if "module" in want:
        branches = sum(isinstance(n, _BRANCHES) for n in ast.walk(tree))
        yield {"tag": "module", "docstring": ast.get_docstring(tree), "complexity": branches}
    if "import" in want:
        n = 0
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    yield {"tag": "import", "ord": n, "kind": "import", "raw": a.name, "name": a.name, "alias": a.asname, "level": 0}
                    n += 1
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    yield {"tag": "import", "ord": n, "kind": "from_import", "raw": node.module, "name": a.name, "alias": a.asname, "level": node.level}
                    n += 1
    ord_ = 0
    for top in tree.body:
        if isinstance(top, (*_DEFS, ast.ClassDef)) and want & {"symbol", "call", "base"}:
            for row in _symbol_rows(top):
                if row["tag"] == "symbol":
                    row["ord"] = ord_
                    ord_ += 1
                if row["tag"] in want:
                    yield row


def _cut_rows(tree: ast.Module, code: str, want: frozenset[str]) -> Iterator[dict]:
    lines = _Lines(code)
    if "chunk" in want:
        for top in tree.body:
            if isinstance(top, (*_DEFS, ast.ClassDef)):
                yield _chunk_row(top, lines, None)
                inner = top.body if isinstance(top, ast.ClassDef) else []
                yield from (_chunk_row(m, lines, top.name) for m in inner if isinstance(m, _DEFS))
    if "definition" in want:
        found = [d for d in ast.walk(tree) if isinstance(d, (*_DEFS, ast.ClassDef))]
        for d in sorted(found, key=lambda d: d.lineno):
            yield {"tag": "definition", "name": d.name, "start_line": d.lineno, "end_line": d.end_lineno, "text": lines.of(d)}


def _chunk_row(node: ast.AST, lines: _Lines, parent: str | None) -> dict:
    return {
        "tag": "chunk", "kind": type(node).__name__, "name": node.name, "class_name": parent, "start_line": node.lineno,
        "end_line": node.end_lineno, "text": lines.of(node), "docstring": ast.get_docstring(node),
    }


def _symbol_rows(node: ast.AST) -> Iterator[dict]:
    """The symbol itself, its methods, and their calls and bases."""
    if isinstance(node, ast.ClassDef):
        named = [t.id for s in node.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)]
        named += [s.target.id for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
        yield {
            "tag": "symbol", "kind": "class", "name": node.name, "docstring": ast.get_docstring(node), "attributes": sorted(set(named)),
            "decorators": [_source(d) for d in node.decorator_list], "keywords": [{"arg": k.arg, "value": _source(k.value)} for k in node.keywords],
        }
        for i, b in enumerate(node.bases):
            yield {"tag": "base", "ord": i, "name": node.name, "raw": _source(b)}
        functions, owner = [m for m in node.body if isinstance(m, _DEFS)], node.name
    else:
        functions, owner = [node], None
    for fn in functions:
        yield {"tag": "symbol", "kind": "method" if owner else "function", "class_name": owner, "name": fn.name, **_signature(fn)}
        for target in sorted({callee_name(c.func) for c in ast.walk(fn) if isinstance(c, ast.Call)} - {""}):
            yield {"tag": "call", "class_name": owner, "name": fn.name, "raw": target}


def parse_python(files: DataFrame, tags: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """Tagged rows of every Python file, one parse each; a file that fails gives one ``error`` row.

    Tags: module, import, symbol, call, base, chunk, definition.
    """
    want = frozenset(tags)

    schema = to_arrow_schema(T.StructType.fromDDL(TAGGED))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for ws, path, code in zip(*(c.to_pylist() for c in b.columns)):
                rows += [{"workspace_id": ws, "path": path, **r} for r in _tagged_rows(code or "", want)]
                held += len(code or "")
                if len(rows) > FRAME_ROWS or held > FRAME_CHARS:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    python = files.filter(F.lower(ids.suffix("path")) == ".py").select(WS, "path", "content")
    return python.mapInArrow(parse, TAGGED)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def split_python(tagged: DataFrame) -> dict[str, DataFrame]:
    """Normalised tables from tagged rows: modules, imports, symbols, calls, bases, errors."""
    mod = ids.module_id("path")
    of = {t: tagged.filter(F.col("tag") == t).withColumn("module_name", mod) for t in ("module", "import", "symbol", "call", "base", "error")}
    owned = F.concat_ws(".", "module_name", "class_name", "name")
    return {
        "modules": of["module"].select(WS, "path", "module_name", F.lit("python").alias("language"), "docstring", "complexity"),
        "imports": of["import"].select(WS, "path", "module_name", F.col("ord").cast("bigint").alias("ord"), F.col("kind").alias("type"), F.coalesce("raw", F.lit("")).alias("raw_module"), "name", "alias", "level"),
        "symbols": of["symbol"].select(WS, "path", "module_name", "kind", "class_name", "name", owned.alias("symbol_id"), "ord", "is_async", "args", "returns", "docstring", "decorators", "attributes", "keywords"),
        "calls": of["call"].select(WS, "path", "module_name", owned.alias("caller_id"), F.col("raw").alias("raw_target")),
        "bases": of["base"].select(WS, "path", "module_name", F.concat_ws(".", "module_name", "name").alias("class_id"), F.col("raw").alias("raw_base")),
        "errors": of["error"].select(WS, "path", F.col("start_line").alias("line"), F.col("raw").alias("message")),
    }


def extract_js(files: DataFrame, settle: bool = False) -> dict[str, DataFrame]:
    """The same tables for JS/TS files; imports still hold the specifier as written."""
    web = files.filter(F.lower(ids.suffix("path")).isin(rules.JS_SUFFIXES))
    mod = ids.module_id("path")
    blocks = js.segment_js_blocks(web)
    if settle:
        blocks = cut_lineage(blocks)
    methods = js.mine_js_methods(blocks)
    imports = js.mine_js_imports(web)
    member = F.concat_ws(".", mod, "class_name", "name")
    own = F.concat_ws(".", mod, "name")
    function_calls = js.mine_js_calls(blocks.filter("kind = 'function'")).select(WS, "path", mod.alias("module_name"), own.alias("caller_id"), F.col("callee").alias("raw_target"))
    method_calls = methods.select(WS, "path", mod.alias("module_name"), member.alias("caller_id"), F.explode("calls").alias("raw_target"))
    nothing = F.lit(None).cast("string")
    tops = blocks.select(WS, "path", mod.alias("module_name"), "kind", nothing.alias("class_name"), "name", own.alias("symbol_id"), (F.col("ord") * 1000).alias("ord"))
    members = methods.select(
        WS, "path", mod.alias("module_name"), F.lit("method").alias("kind"), "class_name", "name", member.alias("symbol_id"), (F.col("block_ord") * 1000 + F.col("ord") + 1).alias("ord")
    )
    language = F.when(F.col("path").rlike(r"\.(js|jsx|mjs|cjs)$"), "javascript").otherwise("typescript")
    return {
        "modules": web.select(WS, "path", mod.alias("module_name"), language.alias("language")),
        "imports": imports.select(WS, "path", mod.alias("module_name"), F.col("ord").cast("bigint").alias("ord"), "type", F.col("spec").alias("raw_module"), F.col("spec").alias("name"), nothing.alias("alias"), F.lit(0).alias("level")),
        "symbols": tops.unionByName(members),
        "calls": function_calls.unionByName(method_calls).distinct(),
        "bases": blocks.filter("base IS NOT NULL").select(WS, "path", mod.alias("module_name"), own.alias("class_id"), F.col("base").alias("raw_base")),
    }


def extract_corpus(files: DataFrame, settle: bool = False, tagged: DataFrame | None = None) -> dict[str, DataFrame]:
    """modules, imports, symbols, calls, bases and errors of a mixed corpus.

    Files of other kinds become empty modules of language ``unknown`` named
    by their whole path.  With ``settle`` the parse is checkpointed, so that
    reading several of the tables parses each file once; ``tagged`` is a
    parse of the same files that is there already.
    """
    parsed = parse_python(files) if tagged is None else tagged
    py = split_python(cut_lineage(parsed) if settle and tagged is None else parsed)
    web = extract_js(files, settle)
    out = {k: py[k].unionByName(web[k], allowMissingColumns=True) for k in web}
    other = files.filter(~F.lower(ids.suffix("path")).isin(rules.SOURCE_SUFFIXES)).select(WS, "path", F.col("path").alias("module_name"), F.lit("unknown").alias("language"))
    return out | {"modules": out["modules"].unionByName(other, allowMissingColumns=True), "errors": py["errors"]}


def link_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with relative JS/TS specifiers replaced by the module ids they reach among ``files``."""
    web = F.lower(ids.suffix("path")).isin(rules.JS_SUFFIXES)
    asked = imports.filter(web).withColumns({"importer": F.col("path"), "spec": F.col("raw_module")})
    linked = resolve.resolve_js_specifiers(asked, files).withColumn("raw_module", F.col("target"))
    return imports.filter(~web).unionByName(linked.select(*imports.columns))


def chunk_ast(files: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """Top-level functions and classes of Python files, and each method tagged with its class."""
    rows = (tagged if tagged is not None else parse_python(files, ("chunk",))).filter("tag = 'chunk' AND text <> ''")
    symbol = F.concat_ws(".", "class_name", "name")
    return rows.select(
        WS, F.col("path").alias("source"), text.line_chunk_id("path", "start_line", "end_line").alias("id"), F.col("kind").alias("type"), "name",
        F.col("class_name").alias("parent_class"), "start_line", "end_line", "text", text.embed_text("path", symbol, "text").alias("embed_text"),
        text.checksum("text").alias("checksum"), text.token_count("text").cast("int").alias("token_count"), "docstring",
    )


def split_definitions(files: DataFrame) -> DataFrame:
    """(start_line, end_line, text) of every function and class at any depth; bad syntax gives none."""
    return parse_python(files, ("definition",)).filter("tag = 'definition'").select(WS, "path", "name", "start_line", "end_line", "text")


def chunk_corpus(
    files: DataFrame, max_tokens: int = rules.CHUNK_TOKENS, overlap: int = rules.CHUNK_OVERLAP, tagged: DataFrame | None = None,
) -> DataFrame:
    """Definition chunks for Python files that have any, token windows for everything else.

    The parse is written once, since it is read twice; ``tagged`` is a parse
    of the same files, chunks included, that is there already.
    """
    from .chunks import chunk_tokens

    by_ast = chunk_ast(files, cut_lineage(parse_python(files, ("chunk",))) if tagged is None else tagged)
    covered = by_ast.select(WS, F.col("source").alias("path")).distinct()
    rest = files.join(covered, [WS, "path"], "left_anti").select(WS, F.col("path").alias("source"), F.col("content").alias("text"))
    return by_ast.unionByName(chunk_tokens(rest, max_tokens, overlap), allowMissingColumns=True)
