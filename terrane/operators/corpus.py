"""File tables: skip rules, roots, listings, reference lookup, languages, frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..functions.ids import as_col, strings

WS = "workspace_id"


def drop_skipped_paths(files: DataFrame) -> DataFrame:
    """Files outside dependency, cache and hidden folders."""
    parts = F.split(F.lower(ids.unix_path("path")), "/")
    listed = F.arrays_overlap(parts, strings(rules.SKIP_DIRS))
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))
    kept_dot = F.arrays_overlap(parts, strings(rules.DOT_NAMES_KEPT))
    return files.filter(~(listed | (hidden & ~kept_dot)))


def source_files(files: DataFrame) -> DataFrame:
    return files.filter(F.lower(ids.suffix("path")).isin(rules.SOURCE_SUFFIXES))


def filter_archive_members(members: DataFrame) -> DataFrame:
    """Archive members that are safe to extract and not dependency or cache output."""
    path = ids.unix_path("path")
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: (p != "") & (p != "."))
    unsafe = path.startswith("/") | (F.size(parts) == 0) | F.array_contains(parts, "..")
    pruned = F.arrays_overlap(parts, strings([d.lower() for d in rules.ARCHIVE_SKIP_DIRS] + ["__macosx"]))
    junk = (F.lower(ids.file_name("path")) == ".env") | F.lower(ids.suffix("path")).isin(rules.ARCHIVE_SKIP_SUFFIXES)
    return members.filter(~(unsafe | pruned | junk))


def detect_repo_root(files: DataFrame) -> DataFrame:
    """(workspace_id, root): the only top-level folder, or empty when there are none or several."""
    path = ids.unix_path("path")
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1))
    counted = F.when(~top.isin(rules.ROOT_IGNORED), top)
    ends = files.groupBy(WS).agg(F.min(counted).alias("lo"), F.max(counted).alias("hi"))
    return ends.select(WS, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("root"))


def tag_modules(files: DataFrame) -> DataFrame:
    """Adds module_name, suffix and language."""
    return files.withColumns({"module_name": ids.module_id("path"), "suffix": F.lower(ids.suffix("path")), "language": ids.language("path")})


def visible_files(files: DataFrame) -> DataFrame:
    """Files a listing shows: nothing inside hidden folders or virtual environments."""
    folders = ids.path_prefixes("path")
    names = F.transform(folders, lambda p: F.substring_index(p, "/", -1))

    def hidden(name: Column) -> Column:
        low = F.lower(name)
        return name.isin(rules.SKIP_DIRS) | low.startswith("venv") | low.startswith(".venv") | low.endswith(".egg-info")

    name = ids.file_name("path")
    own = name.isin(rules.SKIP_DIRS) | (name == ".env") | F.lower(name).endswith(".zip")
    shown = files.filter(~(own | F.exists(names, hidden)))
    homes = files.filter(name == "pyvenv.cfg").select(WS, ids.parent_path("path").alias("home")).filter("home <> ''").distinct()
    inside = shown.select(WS, "path", F.explode(folders).alias("home")).join(homes, [WS, "home"], "left_semi").select(WS, "path").distinct()
    return shown.join(inside, [WS, "path"], "left_anti")


def tree_listing(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Every folder and file of each workspace, with its ``position`` in its folder (folders first, then by name).

    Depth, parent and position give the breadth-first order, so a caller who
    wants the first entries filters on them; no window spans a workspace.
    """
    shown = visible_files(files)
    folders = shown.select(WS, F.explode(ids.path_prefixes("path")).alias("path")).distinct().select(
        WS, "path", F.lit(True).alias("is_dir"), F.lit(None).cast("bigint").alias("size")
    )
    leaves = shown.select(WS, "path", F.lit(False).alias("is_dir"), F.col("size").cast("bigint").alias("size"))
    entries = folders.unionByName(leaves).withColumns({
        "name": ids.file_name("path"), "depth": F.size(F.split("path", "/")), "parent": ids.parent_path("path"),
        "kind": F.when(F.col("is_dir"), "folder").otherwise("file"), "language": F.when(~F.col("is_dir"), ids.language("path")),
    })
    if depth is not None:
        entries = entries.filter(F.col("depth") <= depth)
    siblings = Window.partitionBy(WS, "depth", "parent").orderBy(F.col("is_dir").cast("int").desc(), F.lower("name"), "path")
    return entries.withColumn("position", F.row_number().over(siblings))


def folder_rollup(files: DataFrame) -> DataFrame:
    """File count and bytes under every folder; per-folder sums combine before the shuffle."""
    here = files.groupBy(WS, ids.parent_path("path").alias("dir")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    above = F.concat(ids.path_prefixes("dir"), F.array("dir"))
    up = here.filter("dir <> ''").select(WS, F.explode(above).alias("folder"), "n", "b")
    return up.groupBy(WS, "folder").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"))


def resolve_file_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Reference text to a file: path, dotted id, shorter dotted prefixes, each with usual extensions; last its bare name."""
    clean = F.trim(F.replace("ref", F.lit("\\"), F.lit("/")), F.lit("/"))
    asked = refs.select(WS, "ref").distinct().withColumn("clean", clean)
    known = F.lit(False)
    for e in rules.REF_KNOWN_EXTENSIONS:
        known = known | F.col("clean").endswith(e)
    parts = F.split("clean", r"\.")
    shorter = F.transform(ids.dotted_prefixes("clean"), lambda p: F.replace(p, F.lit("."), F.lit("/")))
    dotted = F.when(
        F.col("clean").contains(".") & ~known, F.concat(F.array(F.replace("clean", F.lit("."), F.lit("/"))), shorter)
    ).otherwise(strings([]))

    def with_extensions(stem: Column, extensions: list[str]) -> Column:
        return F.transform(strings(extensions), lambda e: F.when(F.endswith(stem, e), stem).otherwise(F.concat(stem, e)))

    stems = F.concat(F.array("clean"), dotted)
    tries = F.concat(F.array("ref"), F.flatten(F.transform(stems, lambda s: with_extensions(s, rules.REF_PATH_EXTENSIONS))))
    on_path = (
        asked.select(WS, "ref", F.posexplode(tries).alias("rank", "path")).join(files.select(WS, "path").distinct(), [WS, "path"])
        .groupBy(WS, "ref").agg(F.min_by("path", "rank").alias("direct"))
    )
    # one file per bare name, so that "index.ts" stays a single row
    open_files = files.filter(~F.arrays_overlap(F.split("path", "/"), strings(rules.SKIP_DIRS)))
    by_name = open_files.groupBy(WS, ids.file_name("path").alias("name")).agg(F.min("path").alias("path"))
    on_name = (
        asked.select(WS, "ref", F.posexplode(with_extensions(F.substring_index("clean", "/", -1), rules.REF_NAME_EXTENSIONS)).alias("rank", "name"))
        .join(by_name, [WS, "name"]).groupBy(WS, "ref").agg(F.min_by("path", "rank").alias("named"))
    )
    found = asked.select(WS, "ref").join(on_path, [WS, "ref"], "left").join(on_name, [WS, "ref"], "left")
    return refs.join(found.select(WS, "ref", F.coalesce("direct", "named").alias("path")), [WS, "ref"], "left")


def strip_root_prefix(path: Column | str, root: Column | str) -> Column:
    """Relative path without leading separators and without a repeated root name."""
    rel = F.regexp_replace(F.ltrim(F.replace(as_col(path), F.lit("\\"), F.lit("/")), F.lit("/")), r"^\./", "")
    name = ids.file_name(root)
    inside = F.substr(rel, F.length(name) + 2)
    return F.when((F.length(name) == 0), rel).when(rel == name, "").when(F.startswith(rel, F.concat(name, F.lit("/"))), inside).otherwise(rel)


def language_counts(files: DataFrame) -> DataFrame:
    s = F.lower(ids.suffix("path"))
    return files.groupBy(WS).agg(
        F.count_if(s == ".py").alias("py"), F.count_if(s.isin(".ts", ".tsx")).alias("ts"),
        F.count_if(s.isin(".js", ".jsx", ".mjs", ".cjs")).alias("js"),
        F.bool_or(F.col("path") == "tsconfig.json").alias("has_tsconfig"),
    )


def detect_language(files: DataFrame) -> DataFrame:
    py, ts, js = F.col("py"), F.col("ts"), F.col("js")
    name = (
        F.when(F.col("has_tsconfig"), "typescript").when((py > 0) & (py >= F.greatest(ts, js)), "python")
        .when(ts > 0, "typescript").when(js > 0, "javascript").otherwise("unknown")
    )
    return language_counts(files).select(WS, name.alias("language"))


def dominant_extension(files: DataFrame) -> DataFrame:
    """Most frequent extension per workspace, ties by name; names without a dot count as themselves."""
    ext = F.substring_index(ids.file_name("path"), ".", -1)
    n = files.groupBy(WS, ext.alias("ext")).agg(F.count("*").alias("n")).filter("ext <> ''")
    best = n.groupBy(WS).agg(F.min_by("ext", F.struct((-F.col("n")).alias("n"), "ext")).alias("ext"))
    return files.select(WS).distinct().join(best, WS, "left").select(WS, F.coalesce("ext", F.lit("unknown")).alias("extension"))


def detect_framework(files: DataFrame) -> DataFrame:
    """(workspace_id, framework, language, project_type) by the first rule that applies.

    ``files`` carries ``content`` for manifests at the workspace root.
    """
    deps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    named = F.concat(*[F.coalesce(F.map_keys(deps[c]), strings([])) for c in ("dependencies", "devDependencies")])
    low = F.lower(F.coalesce("content", F.lit("")))
    guesses = []
    for rank, (manifest, needle, framework, kind, language) in enumerate(rules.FRAMEWORK_RULES):
        holds = F.lit(True) if needle is None else F.array_contains(F.col("_deps"), needle) if manifest == "package.json" else low.contains(needle)
        made = F.struct(F.lit(rank).alias("rank"), F.lit(framework).alias("framework"), F.lit(kind).alias("project_type"), F.lit(language).cast("string").alias("own"))
        guesses.append(F.when((F.col("path") == manifest) & holds, made))
    manifests = {r[0] for r in rules.FRAMEWORK_RULES}
    judged = files.filter(F.col("path").isin(sorted(manifests))).withColumn("_deps", F.when(F.col("path") == "package.json", named).otherwise(strings([])))
    best = judged.select(WS, F.array_min(F.array_compact(F.array(*guesses))).alias("g")).groupBy(WS).agg(F.min("g").alias("g"))
    return detect_language(files).join(best, WS, "left").select(
        WS, F.coalesce("g.framework", F.lit("Unknown")).alias("framework"), F.coalesce("g.own", "language").alias("language"),
        F.coalesce("g.project_type", F.lit("unknown")).alias("project_type"),
    )


def search_files(files: DataFrame, text: str, kind: str = "All") -> DataFrame:
    """Files whose name or kind contains the text, and whose kind contains the filter."""
    low = text.strip().lower()
    hit = F.lower("name").contains(low) | F.lower("kind").contains(low)
    return files.filter(hit if kind == "All" else hit & F.lower("kind").contains(kind.lower()))
