"""Reference resolution: imports, calls and bases to stable ids.

First-match-wins rules are written once as ranked candidates: explode them,
make one equi-join with a lookup table, keep the best rank with ``min_by``.
Requests are deduplicated before they are exploded, so a name imported a
million times costs one lookup; joins whose left side may hold a hot key
(a package everyone imports) are left to adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..functions.ids import strings
from ..session import bounded_broadcast

WS = "workspace_id"
#: Guesses are sifted by how keys begin while there are at most so many beginnings.
BEGINNINGS = 50_000


def module_suffix_index(modules: DataFrame) -> DataFrame:
    """Each proper dotted suffix with the shallowest module that owns it.

    Two owners at the same depth make the suffix ambiguous: target NULL.
    """
    n = ids.dots("module_name")
    tails = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: ids.before_dot("module_name", -i))
    owned = (
        modules.select(WS, "module_name").distinct()
        .select(WS, "module_name", (n + 1).alias("depth"), F.explode(F.when(n > 0, tails)).alias("suffix"))
    )
    per_depth = owned.groupBy(WS, "suffix", "depth").agg(F.min("module_name").alias("owner"), F.count("*").alias("owners"))
    best = per_depth.groupBy(WS, "suffix").agg(F.min_by(F.struct("owner", "owners"), "depth").alias("b"))
    return best.select(WS, "suffix", F.when(F.col("b.owners") == 1, F.col("b.owner")).alias("target"))


def absolute_module(module_name: Column | str, raw: Column | str, level: Column | str) -> Column:
    """Absolute form of a relative import; level 0 leaves the text alone."""
    raw, level = ids.as_col(raw), F.coalesce(ids.as_col(level), F.lit(0))
    package = F.split(ids.as_col(module_name), r"\.")
    package = F.filter(package, lambda p: p != "")
    keep = F.greatest(F.size(package) - 1 - (level - 1), F.lit(0))
    keep = F.least(keep, F.greatest(F.size(package) - 1, F.lit(0)))
    own = F.filter(F.split(F.coalesce(raw, F.lit("")), r"\."), lambda p: p != "")
    full = F.array_join(F.concat(F.slice(package, F.lit(1), keep), own), ".")
    return F.when(level <= 0, F.coalesce(raw, F.lit(""))).otherwise(full)


def absolutize_imports(imports: DataFrame) -> DataFrame:
    return imports.withColumn("abs_module", absolute_module("module_name", "raw_module", "level"))


def _candidates() -> Column:
    """Ranked (kind, key) guesses for one import; kind m = module, s = suffix."""
    raw, name = F.col("raw"), F.col("name")
    n = ids.dots(raw) + 1

    def guess(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    none = F.array().cast("array<struct<kind:string,key:string>>")
    with_name = F.concat(raw, F.lit("."), name)
    named = F.when(F.length(name) > 0, F.array(guess("m", with_name))).otherwise(none)
    prefixes = F.transform(ids.dotted_prefixes(raw), lambda p: guess("m", p))
    tails = F.when(
        n > 2,
        F.transform(F.sequence(n - 1, F.lit(2), F.lit(-1)), lambda i: guess("m", ids.before_dot(raw, -i))),
    ).otherwise(none)
    suffixes = F.when(
        n > 1,
        F.concat(
            F.array(guess("s", raw)), F.when(F.length(name) > 0, F.array(guess("s", with_name))).otherwise(none)
        ),
    ).otherwise(none)
    return F.concat(F.array(guess("m", raw)), named, prefixes, tails, suffixes)


def usable_imports(imports: DataFrame) -> DataFrame:
    """Imports that can name a module, with ``abs_module`` and ``_name``."""
    return (
        absolutize_imports(imports)
        .withColumn("abs_module", F.trim("abs_module"))
        .filter(ids.is_semantic_id("abs_module") & ~ids.is_noise_namespace("abs_module"))
        .withColumn("_name", F.coalesce(F.trim("name"), F.lit("")))
    )


def import_guesses(requests: DataFrame) -> DataFrame:
    """Every column of ``requests`` (abs_module, _name, …) with each ranked (kind, key) it may be found by."""
    named = requests.select("*", F.col("abs_module").alias("raw"), F.col("_name").alias("name"))
    return named.select(*requests.columns, F.posexplode(_candidates()).alias("rank", "g")).select(
        *requests.columns, "rank", F.col("g.kind").alias("kind"), F.col("g.key").alias("key")
    )


def module_lookup(modules: DataFrame) -> DataFrame:
    """(workspace_id, kind, key, hit): module names, and the suffixes one module owns."""
    named = modules.filter(ids.is_semantic_id("module_name"))
    return (
        named.select(WS, F.lit("m").alias("kind"), F.col("module_name").alias("key"), F.col("module_name").alias("hit")).distinct()
        .unionByName(
            module_suffix_index(named)
            .filter("target IS NOT NULL").select(WS, F.lit("s").alias("kind"), F.col("suffix").alias("key"), F.col("target").alias("hit"))
        )
    )


def _beginning(key: Column | str) -> list[Column]:
    """Number of dots of a key, and its first part if it names a module."""
    return [ids.dots(key).alias("dots"), F.when(F.col("kind") == "m", F.substring_index(ids.as_col(key), ".", 1)).otherwise("").alias("first")]


def _beginnings(modules: DataFrame) -> DataFrame:
    """(kind, dots, first) of all keys that can be found; suffixes of a module have fewer dots than it."""
    named = modules.select(F.lit("m").alias("kind"), "module_name").select("kind", *_beginning("module_name")).distinct()
    fewer = F.explode(F.when(F.col("dots") > 0, F.sequence(F.lit(0), F.col("dots") - 1))).alias("dots")
    return named.unionByName(named.select(F.lit("s").alias("kind"), fewer, F.lit("").alias("first")).distinct())


def _possible(guesses: DataFrame, beginnings: DataFrame) -> DataFrame:
    """Guesses without those that begin like no key, dropped before they move."""
    small = bounded_broadcast(beginnings, BEGINNINGS)
    if small is beginnings:
        return guesses
    return guesses.select("*", *_beginning("key")).join(small, ["kind", "dots", "first"], "left_semi").select(*guesses.columns)


def resolve_imports(imports: DataFrame, modules: DataFrame | None = None, lookup: DataFrame | None = None) -> DataFrame:
    """Imports with the graph id they point at, unusable ones dropped.

    Order: exact module; module plus name; longest module prefix; longest
    tail of two or more parts; suffix owner of the module; suffix owner of
    module plus name; otherwise the text itself, as an external package.
    ``lookup`` is ``module_lookup(modules)``, or the part of it that holds
    every key the imports may be found by.
    """
    usable = usable_imports(imports)
    # a request repeats a key at most twice, so this bounds the rows of any key below
    guesses = import_guesses(usable.select(WS, "abs_module", "_name").distinct())
    if lookup is None:
        guesses, lookup = _possible(guesses, _beginnings(modules)), module_lookup(modules)
    resolved = guesses.join(lookup, [WS, "kind", "key"]).groupBy(WS, "abs_module", "_name").agg(F.min_by("hit", "rank").alias("hit"))
    return (
        usable.join(resolved, [WS, "abs_module", "_name"], "left")
        .withColumn("target", F.coalesce("hit", "abs_module")).drop("hit", "_name")
    )


def _normal_path(path: Column) -> Column:
    """Collapse ``.`` and ``..`` like a POSIX path, then strip leading dots and slashes."""
    empty = strings([])

    def step(acc: Column, p: Column) -> Column:
        stuck = (F.size(acc) == 0) | (F.element_at(F.concat(F.array(F.lit("")), acc), -1) == "..")
        up = F.when(stuck, F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when((p == "") | (p == "."), acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    return F.ltrim(F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"), F.lit("./"))


def _reached_path() -> Column:
    """Path a relative ``spec`` names from ``folder``."""
    return _normal_path(F.when(F.col("folder") == "", F.col("spec")).otherwise(F.concat("folder", F.lit("/"), "spec")))


def _swapped(base: str) -> tuple[Column, Column]:
    """Last suffix of a path, and the path without it."""
    own = ids.suffix(base)
    return own, F.left(F.col(base), F.length(base) - F.length(own))


def js_guesses(imports: DataFrame) -> DataFrame:
    """(workspace_id, folder, spec, rank, path): the files each relative specifier may mean, best first."""
    asked = imports.select(WS, ids.parent_path("importer").alias("folder"), "spec").distinct()
    based = asked.filter(F.col("spec").startswith(".")).withColumn("base", _reached_path())
    suffix_list = strings(rules.JS_SUFFIXES)

    def grown(stem: Column) -> Column:
        plain = F.transform(suffix_list, lambda s: F.concat(stem, s))
        index = F.transform(suffix_list, lambda s: F.concat(stem, F.lit("/index"), s))
        return F.concat(plain, index)

    own, bare = _swapped("base")
    swap = F.when(own.isin(rules.JS_SUFFIXES), grown(bare)).otherwise(strings([]))
    return based.select(WS, "folder", "spec", F.posexplode(F.concat(F.array("base"), grown(F.col("base")), swap)).alias("rank", "path"))


def _js_lookup(files: DataFrame) -> DataFrame:
    """(workspace_id, key, whole, grown): is ``key`` a file, and the best file that adds a suffix or an index to it."""
    tail = F.concat(F.lit("."), F.substring_index("path", ".", -1))
    stem = F.when(F.col("path").endswith(tail) & tail.isin(rules.JS_SUFFIXES), F.left(F.col("path"), F.length("path") - F.length(tail)))
    rank = F.array_position(strings(rules.JS_SUFFIXES), tail)
    folder = F.when(stem.endswith("/index"), F.left(stem, F.length(stem) - len("/index")))
    ways = F.array(*[
        F.struct(key.alias("key"), order.cast("bigint").alias("order"))
        for key, order in ((F.col("path"), F.lit(0)), (stem, rank), (folder, rank + len(rules.JS_SUFFIXES)))
    ])
    found = files.select(WS, "path", F.explode(F.filter(ways, lambda w: w["key"].isNotNull())).alias("w"))
    added = F.col("w.order") > 0
    return found.groupBy(WS, F.col("w.key").alias("key")).agg(
        F.bool_or(~added).alias("whole"), F.min_by(F.when(added, F.col("path")), F.when(added, F.col("w.order"))).alias("grown")
    )


def resolve_js_specifiers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative JS/TS specifiers to module ids; packages and misses unchanged.

    ``imports`` needs (workspace_id, importer, spec).  Order: exact file,
    added suffix, folder index, then the same with a JS suffix swapped out.
    Files are listed by what a specifier may leave out of them, so a path
    asks for two keys at most, not for each file name it could grow into.
    """
    relative = F.col("spec").startswith(".")
    placed = imports.withColumn("folder", ids.parent_path("importer")).withColumns({
        "_base": F.when(relative, _reached_path()).otherwise(F.col("importer")), "_relative": relative,
    }).drop("folder")
    asked = placed.filter("_relative").select(WS, "_base").distinct()
    own, bare = _swapped("_base")
    keys = F.array(F.struct(F.col("_base").alias("key"), F.lit(0).alias("rank")), F.struct(F.when(own.isin(rules.JS_SUFFIXES), bare).alias("key"), F.lit(1).alias("rank")))
    path = F.when((F.col("rank") == 0) & F.col("whole"), F.col("key")).otherwise(F.col("grown"))
    hits = (
        asked.select(WS, "_base", F.explode(keys).alias("k")).select(WS, "_base", "k.*").filter("key IS NOT NULL")
        .join(_js_lookup(files), [WS, "key"]).withColumn("path", path).filter("path IS NOT NULL")
        .groupBy(WS, "_base").agg(F.min_by("path", "rank").alias("hit")).withColumn("_relative", F.lit(True))
    )
    return (
        placed.join(hits, [WS, "_base", "_relative"], "left")
        .withColumn("target", F.coalesce(ids.module_id("hit"), F.col("spec"))).drop("_base", "_relative", "hit")
    )


def import_scope(resolved: DataFrame) -> DataFrame:
    """What each imported name means inside its module.

    kind ``symbol`` for from-imports, ``module`` otherwise.  The last import
    of a name wins; a bare first segment only fills a gap.
    """
    live = resolved.filter(F.col("target") != F.col("module_name"))
    is_from = (F.col("type") == "from_import") & (F.coalesce(F.length("name"), F.lit(0)) > 0)
    alias = F.when(F.coalesce(F.length("alias"), F.lit(0)) > 0, F.col("alias"))
    named = F.when(
        F.endswith(F.col("target"), F.concat(F.lit("."), F.col("name"))), F.col("target")
    ).otherwise(F.concat("target", F.lit("."), "name"))
    symbols = live.filter(is_from).select(
        WS, "module_name", F.lit("symbol").alias("kind"), F.coalesce(alias, "name").alias("name"), named.alias("target"), F.lit(1).alias("strength"), "ord"
    )
    whole = live.filter(~is_from)
    aliases = whole.select(
        WS, "module_name", F.lit("module").alias("kind"), F.coalesce(alias, ids.display_name("target")).alias("name"), "target", F.lit(1).alias("strength"), "ord"
    )
    first = F.substring_index("target", ".", 1)
    heads = whole.select(WS, "module_name", F.lit("module").alias("kind"), first.alias("name"), first.alias("target"), F.lit(0).alias("strength"), "ord")
    return (
        symbols.unionByName(aliases).unionByName(heads)
        .groupBy(WS, "module_name", "kind", "name")
        .agg(F.max_by("target", F.struct("strength", "ord", "target")).alias("target"))
    )


def resolve_calls(calls: DataFrame, symbols: DataFrame, modules: DataFrame, level: int = 3) -> DataFrame:
    """Calls with the symbol they reach; calls that reach no project symbol are dropped.

    A local method wins over a local function (first declared method of a
    name), then any dotted target whose prefix is a project module.
    """
    wanted = (
        calls.withColumn("_raw", F.trim("raw_target"))
        .filter(ids.is_semantic_id("_raw") & ~ids.is_noise_namespace("_raw"))
        .withColumn("_last", ids.last_segment("_raw")).filter("_last <> ''")
    )
    if level < 3:
        wanted = wanted.filter(~F.col("_last").isin(rules.STRING_METHODS))
    local = (
        symbols.filter(F.col("kind").isin("method", "function"))
        .groupBy(WS, "module_name", F.col("name").alias("_last"))
        .agg(F.min_by("symbol_id", F.struct((F.col("kind") == "function").alias("f"), "ord")).alias("_local"))
    )
    owners = modules.select(WS, F.col("module_name").alias("_prefix"), F.lit(True).alias("_owned")).distinct()
    seen = (
        wanted.join(local, [WS, "module_name", "_last"], "left")
        .withColumn("_prefix", F.when(F.col("_local").isNull(), ids.prefix_of("_raw")))
    )
    placed = seen.filter("_local IS NOT NULL").withColumn("target", F.col("_local"))
    foreign = seen.filter("_local IS NULL").join(owners, [WS, "_prefix"], "left_semi").withColumn("target", F.col("_raw"))
    return placed.unionByName(foreign).select(*calls.columns, "target")


def resolve_bases(bases: DataFrame, classes: DataFrame, scope: DataFrame) -> DataFrame:
    """Base-class text to class ids using local classes and the import scope."""
    names = (
        classes.select(WS, "module_name", "name", F.lit("class").alias("kind"), F.col("symbol_id").alias("target"))
        .unionByName(scope.select(WS, "module_name", "name", "kind", "target"))
        .groupBy(WS, "module_name", F.col("name").alias("_head"))
        .agg(*[F.max(F.when(F.col("kind") == k, F.col("target"))).alias(f"_{k}") for k in ("class", "symbol", "module")])
    )
    raw = F.trim("raw_base")
    asked = bases.withColumn("_raw", raw).filter(ids.is_semantic_id("_raw")).withColumn("_head", F.substring_index("_raw", ".", 1))
    known = asked.join(names, [WS, "module_name", "_head"], "left")
    dotted = F.col("_raw").contains(".")
    rest = F.expr("substring(_raw, length(_head) + 2)")
    through = F.coalesce("_module", "_symbol")
    target = (
        F.when(~dotted, F.coalesce("_class", "_symbol", "_raw"))
        .when(through.isNotNull(), F.concat(through, F.lit("."), rest)).otherwise(F.col("_raw"))
    )
    return known.select(*bases.columns, target.alias("target"))
