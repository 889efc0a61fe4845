"""Source files written by Spark from the derived views, so that extraction has known answers.

Every module of ``src/`` becomes a file whose imports, classes, functions,
calls and bases are those of fx_imports, fx_symbols, fx_calls and fx_bases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derived import stored, view

WS = "workspace_id"


def _listed(df: DataFrame, keys: list[str], order: list, line, name: str) -> DataFrame:
    """Lines of one module (or symbol) joined in order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_r"))
    return rows.select(*keys, F.array_join(F.transform("_r", lambda r: r["_line"]), "\n").alias(name))


def _by_symbol(df: DataFrame, keys: list[str], symbol: str, value: str) -> DataFrame:
    """One row a module, with ``value`` of each of its symbols as a map; ids of symbols begin with their module."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(symbol, value))).alias(value))


def source_files(spark, sf: str) -> DataFrame:
    """files(workspace_id, path, module_name, content), written once like the views."""
    return stored(spark, sf, "source_files", lambda: _written_files(spark, sf))


def _written_files(spark, sf: str) -> DataFrame:
    modules = view(spark, sf, "fx_modules").filter("path LIKE 'src/%'").withColumn("is_py", F.col("path").endswith(".py"))
    language = modules.select(WS, "module_name", "is_py")
    key = [WS, "module_name"]

    imports = view(spark, sf, "fx_imports").join(language, key)
    py = F.when(F.col("type") == "from_import", F.concat(F.lit("from "), "raw_module", F.lit(" import "), "name")).otherwise(F.concat(F.lit("import "), "raw_module"))
    third = F.col("ord") % 3
    web = (
        F.when(third == 0, F.concat(F.lit("import { x } from '"), "raw_module", F.lit("';")))
        .when(third == 1, F.concat(F.lit('const x = require("'), "raw_module", F.lit('");')))
        .otherwise(F.concat(F.lit("import( '"), "raw_module", F.lit("' );")))
    )
    heads = _listed(imports, key, ["ord"], F.when(F.col("is_py"), py).otherwise(web), "heads")

    # Calls, bases and symbols lie by module throughout: what a symbol needs is looked up in a map of its module.
    calls = view(spark, sf, "fx_calls").select(WS, "module_name", "caller_id", "raw_target").repartition(*key).distinct().join(language, key)
    call = F.when(F.col("is_py"), F.concat(F.lit("        "), "raw_target", F.lit("()"))).otherwise(
        F.concat(F.lit("    "), F.substring_index("raw_target", ".", -1), F.lit("(1);"))
    )
    bodies = _by_symbol(_listed(calls, [*key, "caller_id"], ["raw_target"], call, "body"), key, "caller_id", "body")

    bases = view(spark, sf, "fx_bases").select(*key, "class_id", "raw_base").repartition(*key).distinct()
    all_bases = _by_symbol(bases.groupBy(*key, "class_id").agg(F.array_sort(F.collect_list("raw_base")).alias("_b")), key, "class_id", "_b")
    symbols = view(spark, sf, "fx_symbols").filter("ord < 4").join(language, key).join(bodies, key, "left").join(all_bases, key, "left")
    symbols = symbols.withColumns({name: F.try_element_at(name, F.col("symbol_id")) for name in ("body", "_b")})
    kind, name = F.col("kind"), F.col("name")
    inherit = F.coalesce(F.concat(F.lit("("), F.array_join("_b", ", "), F.lit(")")), F.lit(""))
    py_symbol = (
        F.when(kind == "class", F.concat(F.lit("class "), name, inherit, F.lit(":\n    size: int = 0")))
        .when(kind == "method", F.concat(F.lit("    def "), name, F.lit("(self, *rest):\n"), F.coalesce("body", F.lit("        pass"))))
        .otherwise(F.concat(F.lit("async def "), name, F.lit("(a, /, b: int = 1, *, c=None, **d) -> str:\n"), F.coalesce("body", F.lit("        pass"))))
    )
    extends = F.coalesce(F.concat(F.lit(" extends "), F.get(F.filter("_b", lambda b: ~b.contains(".")), F.lit(0))), F.lit(""))
    body = F.coalesce(F.concat("body", F.lit("\n")), F.lit(""))
    js_symbol = (
        F.when(kind == "class", F.concat(F.lit("export class "), name, extends, F.lit(" {")))
        .when(kind == "method", F.concat(F.lit("  "), name, F.lit("(a) {\n"), body, F.when(name == "m1", "  }\n}").otherwise("  }")))
        .otherwise(F.concat(F.lit("const "), name, F.lit(" = async (a) => {\n"), body, F.lit("}")))
    )
    code = _listed(symbols, key, ["ord"], F.when(F.col("is_py"), py_symbol).otherwise(js_symbol), "code")
    return modules.join(heads, key, "left").join(code, key, "left").select(
        WS, "path", "module_name", F.concat_ws("\n", "heads", "code").alias("content")
    )
