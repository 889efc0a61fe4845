"""Hand-written JS/TS sources with rows typed from the semantics."""

import pytest
from pyspark.sql import functions as F

from terrane.functions import ids
from terrane.operators import changes, extract, js, resolve

APP = """import React, { useState } from 'react';
import { a,
  b } from "./lib/util.js";
export { x } from '../shared';
const fs = require( 'fs' );

export default class Panel extends Base {
  constructor(a) {
    super(a);
  }
  render() {
    return draw(this.x) + `}`;
  }
}

export async function load(url) {
  if (url) { fetchAll(url); }
  const m = await import('./lazy');
}
}
const pick = (a) => a.id;
const make = async (a) => {
  build(a);
};
"""


@pytest.fixture(scope="module")
def files(spark):
    data = [
        ("w", "web/app.ts", APP), ("w", "web/lib/util.ts", ""), ("w", "shared/index.tsx", ""), ("w", "web/lazy.jsx", ""),
        ("w", "bad/bracket.js", "f(1;\n"), ("w", "bad/mismatch.js", "f(1];\n"), ("w", "bad/string.js", "x = 'abc\ny\n"), ("w", "bad/comment.js", "a();\n/* open\n"),
        ("w", "bad/extra.js", "// )\n'('\n)\n"), ("w", "ok/all.js", "/* ( */ f(`${a}`, \"it's\", '\\'');\n"),
    ]
    return spark.createDataFrame(data, "workspace_id string, path string, content string")


def test_imports_in_family_order(files):
    got = js.mine_js_imports(files).filter("path = 'web/app.ts'").orderBy("ord").select("type", "spec").collect()
    assert [tuple(r) for r in got] == [
        ("import", "react"), ("import", "./lib/util.js"), ("import", "../shared"), ("require", "fs"), ("dynamic_import", "./lazy"),
    ]


def test_specifiers_reach_files(files):
    imports = js.mine_js_imports(files).withColumnRenamed("path", "importer")
    got = {r["spec"]: r["target"] for r in resolve.resolve_js_specifiers(imports, files).collect()}
    assert got == {"react": "react", "./lib/util.js": "web.lib.util", "../shared": "shared.index", "fs": "fs", "./lazy": "web.lazy"}


def test_specifiers_ask_for_two_keys_and_rank_as_their_guesses(spark):
    paths = ["a/b", "a/b.ts", "a/b.js", "a/b/index.ts", "a/c.js", "a/c/index.mjs", "a/d.tsx", "a/d.ts/index.js", "a/e.js.ts", "a/f/index.cjs", "x.ts", "index.js", ".ts", "a/ts", "a/g.py"]
    specs = ["./b", "./b.js", "./c", "./c.js", "./c.mjs", "./d.ts", "./d", "./d.js", "./e.js", "./f", "./f.ts", "../x", "../x.jsx", "..", ".", "./ts", "./g.py", "./g", "./none", "react", "b", None]
    files = spark.createDataFrame([("w", p) for p in paths * 2] + [("v", "a/none.ts"), ("w", None), (None, "a/none.ts")], "workspace_id string, path string")
    asked = [("w", i, s) for s in specs for i in ("a/m.ts", "m.ts", None)] + [(None, "a/m.ts", "./none"), ("w", "a/m.ts", "./b")]
    imports = spark.createDataFrame(asked, "workspace_id string, importer string, spec string")
    hits = resolve.js_guesses(imports).join(files.distinct(), ["workspace_id", "path"]).groupBy("workspace_id", "folder", "spec").agg(F.min_by("path", "rank").alias("hit"))
    slow = imports.withColumn("folder", ids.parent_path("importer")).join(hits, ["workspace_id", "folder", "spec"], "left")
    want = slow.select("workspace_id", "importer", "spec", F.coalesce(ids.module_id("hit"), "spec").alias("target"))
    got = resolve.resolve_js_specifiers(imports, files)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns and want.filter("target <> spec").count() > 15
    # a specifier was exploded into up to 25 file names, all of which were shuffled
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_blocks(files):
    got = js.segment_js_blocks(files).filter("path = 'web/app.ts'").orderBy("ord").select("kind", "name", "base", "start_line", "end_line").collect()
    # the template string's brace closes the class one line early, and the stray brace afterwards costs nothing
    assert [tuple(r) for r in got] == [("class", "Panel", "Base", 7, 13), ("function", "load", None, 16, 19), ("function", "pick", None, 21, 21), ("function", "make", None, 22, 24)]


def test_methods_and_calls(files):
    blocks = js.segment_js_blocks(files)
    methods = js.mine_js_methods(blocks).collect()
    assert [(r["class_name"], r["name"]) for r in methods] == [("Panel", "render")]
    assert methods[0]["calls"] == ["constructor", "draw", "render", "super"]
    calls = js.mine_js_calls(blocks).filter("name = 'load'").collect()
    assert sorted(r["callee"] for r in calls) == ["fetchAll", "load"]


def test_tables(files):
    t = extract.extract_corpus(files)
    assert {r["symbol_id"] for r in t["symbols"].collect()} == {"web.app.Panel", "web.app.Panel.render", "web.app.load", "web.app.pick", "web.app.make"}
    assert [tuple(r) for r in t["bases"].select("class_id", "raw_base").collect()] == [("web.app.Panel", "Base")]
    linked = extract.link_imports(t["imports"], files)
    assert {r["raw_module"] for r in linked.collect()} == {"react", "web.lib.util", "shared.index", "fs", "web.lazy"}


def test_syntax(files):
    got = {(r["path"], r["line"], r["message"]) for r in changes.syntax_check(files).filter("path LIKE 'bad/%' OR path LIKE 'ok/%'").collect()}
    assert got == {
        ("bad/bracket.js", None, "Unclosed bracket '(' opened at line 1"), ("bad/mismatch.js", 1, "Mismatched bracket ']', expected closing for '(' from line 1"),
        ("bad/string.js", None, "Unclosed string literal (')"), ("bad/comment.js", None, "Unclosed block comment"), ("bad/extra.js", 3, "Unmatched closing bracket ')'"),
    }


def test_classes_of_one_name_keep_their_own_methods(spark):
    code = "class A {\n  one() {\n  }\n}\nclass A {\n  two() {\n  }\n}\n"
    files = spark.createDataFrame([("w", "a.ts", code)], "workspace_id string, path string, content string")
    got = [r["name"] for r in extract.extract_js(files)["symbols"].filter("kind = 'method'").collect()]
    assert sorted(got) == ["one", "two"]
