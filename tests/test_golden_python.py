"""Hand-written Python sources with rows typed from the semantics."""

import pytest
from terrane.operators import build, changes, extract

MAIN = '''"""Doc."""
import os
import numpy as np
from . import sibling
from ..pkg.mod import thing as other

def outer(a, /, b: int = 1, *rest, c, **kw) -> str:
    """Outer doc."""
    import json
    a().b()
    a().b.c()
    os.path.join(b)
    table[0]()
    f()()
    if b:
        for x in rest:
            pass
    def inner():
        return helper()
    return inner()

@decorated
@deco.factory(1)
async def fetch():
    pass

class Model(base.Model, Mixin, metaclass=Meta):
    """Model doc."""
    size = 1
    name: str = "x"

    def save(self):
        self.check()
        try:
            pass
        except ValueError:
            pass

    def check(self):
        pass
'''


@pytest.fixture(scope="module")
def files(spark):
    data = [
        ("w", "app/core/main.py", MAIN), ("w", "app/core/sibling.py", ""), ("w", "app/pkg/mod.py", "def thing():\n    pass\n"),
        ("w", "app/broken.py", "def f(:\n    pass\n"), ("w", "app/bom.py", "\ufeffdef g():\n    pass\n"), ("w", "notes.txt", "hello world"),
    ]
    return spark.createDataFrame(data, "workspace_id string, path string, content string")


@pytest.fixture(scope="module")
def tables(files):
    return extract.extract_corpus(files, settle=True)


def test_imports(tables):
    got = tables["imports"].filter("module_name = 'app.core.main'").orderBy("ord").select("type", "raw_module", "name", "alias", "level").collect()
    assert [tuple(r) for r in got] == [
        ("import", "os", "os", None, 0), ("import", "numpy", "numpy", "np", 0), ("from_import", "", "sibling", None, 1),
        ("from_import", "pkg.mod", "thing", "other", 2), ("import", "json", "json", None, 0),
    ]


def test_symbols(tables):
    rows = {r["symbol_id"]: r for r in tables["symbols"].filter("module_name = 'app.core.main'").collect()}
    assert set(rows) == {f"app.core.main.{n}" for n in ("outer", "fetch", "Model", "Model.save", "Model.check")}
    outer, model, fetch = (rows[f"app.core.main.{n}"] for n in ("outer", "Model", "fetch"))
    assert [(a["name"], a["annotation"]) for a in outer["args"]] == [("a", None), ("b", "int"), ("*rest", None), ("c", None), ("**kw", None)]
    assert outer["returns"] == "str" and outer["docstring"] == "Outer doc." and not outer["is_async"]
    assert fetch["is_async"] and fetch["decorators"] == ["decorated", "deco.factory(1)"]
    assert model["attributes"] == ["name", "size"] and [(k["arg"], k["value"]) for k in model["keywords"]] == [("metaclass", "Meta")]
    assert rows["app.core.main.Model.save"]["kind"] == "method" and rows["app.core.main.Model.save"]["class_name"] == "Model"


def test_calls_and_bases(tables):
    calls = tables["calls"].filter("caller_id = 'app.core.main.outer'").select("raw_target").collect()
    assert sorted(r[0] for r in calls) == ["a", "b", "b.c", "f", "helper", "inner", "os.path.join"]
    bases = tables["bases"].filter("module_name = 'app.core.main'").select("class_id", "raw_base").collect()
    assert sorted(map(tuple, bases)) == [("app.core.main.Model", "Mixin"), ("app.core.main.Model", "base.Model")]


def test_modules_and_errors(tables):
    got = {r["path"]: (r["module_name"], r["language"], r["complexity"]) for r in tables["modules"].collect()}
    assert got == {
        "app/core/main.py": ("app.core.main", "python", 4), "app/core/sibling.py": ("app.core.sibling", "python", 0),
        "app/pkg/mod.py": ("app.pkg.mod", "python", 0), "notes.txt": ("notes.txt", "unknown", None),
    }
    errors = {r["path"]: r["line"] for r in tables["errors"].collect()}
    # a byte-order mark stays in the text, and the parser refuses it
    assert errors == {"app/broken.py": 1, "app/bom.py": 1}


def test_graph_of_the_sources(files, tables):
    nodes, edges, meta = build.build_graph(tables["modules"], tables["imports"], tables["symbols"], tables["calls"], tables["bases"])
    got = {(r["source"], r["target"], r["type"]) for r in edges.filter("source LIKE 'app.core.main%'").collect()}
    m = "app.core.main"
    assert {(m, "app.core.sibling", "imports"), (m, "app.pkg.mod", "imports"), (m, "numpy", "imports"), (m, f"{m}.Model", "contains"),
            (f"{m}.Model", f"{m}.Model.save", "contains"), (f"{m}.Model.save", f"{m}.Model.check", "calls"), (f"{m}.Model", "Mixin", "inherits")} <= got
    outside = {r["id"] for r in nodes.filter("is_external").collect()}
    assert {"numpy", "os", "json", "Mixin", "base.Model"} <= outside
    assert meta.select("builder_version", "graph_level").first() == (2, 3)


def test_definition_chunks(files):
    got = extract.chunk_ast(files).filter("source = 'app/core/main.py'").orderBy("start_line").collect()
    assert [(r["type"], r["name"], r["parent_class"]) for r in got] == [
        ("FunctionDef", "outer", None), ("AsyncFunctionDef", "fetch", None), ("ClassDef", "Model", None), ("FunctionDef", "save", "Model"), ("FunctionDef", "check", "Model"),
    ]
    save = got[3]
    assert save["text"].startswith("def save(self):\n        self.check()") and save["id"] == f"app/core/main.py::L{save['start_line']}-L{save['end_line']}"
    assert save["embed_text"].startswith("# File: app/core/main.py\n# Symbol: Model.save\n\ndef save")
    every = {r["name"] for r in extract.split_definitions(files).filter("path = 'app/core/main.py'").collect()}
    assert every == {"outer", "inner", "fetch", "Model", "save", "check"}


def test_chunking_falls_back_to_windows(files):
    got = {(r["source"], r["id"]) for r in extract.chunk_corpus(files).collect()}
    assert ("notes.txt", "notes.txt::chunk_0") in got and ("app/broken.py", "app/broken.py::chunk_0") in got
    assert not any(s == "app/core/sibling.py" for s, _ in got)


def test_syntax_and_validation(spark, files):
    found = changes.syntax_check(files).filter("path = 'app/broken.py'").collect()
    assert [r["line"] for r in found] == [1]
    new = MAIN.replace("import os\n", "").replace("async def fetch", "async def load")
    pairs = spark.createDataFrame([("w", "app/core/main.py", MAIN, new), ("w", "app/pkg/mod.py", "x = 1\n", "x = (\n")], "workspace_id string, path string, old_text string, new_text string")
    edges = spark.createDataFrame([("w", "app.x", "app.core.main", "imports")], "workspace_id string, source string, target string, type string")
    got = {r["path"]: r for r in changes.validate_changes(pairs, edges).collect()}
    main, mod = got["app/core/main.py"], got["app/pkg/mod.py"]
    assert not main["is_valid"] and main["import_errors"] == 1 and main["breaking_changes"] == 1 and main["affected_dependents"] == 1
    assert not mod["is_valid"] and mod["syntax_errors"] == 1
