import corpus_pipeline as C
import __spark_entry__ as entry
from terrane.llm.common import components


def near_copies(docs, spark):
    """Three near copies (0.88 of five-word shingles) of a clean document's text with a word changed in every line, so that no line of theirs is a copy."""
    text = next(r.text for r in docs.filter("lang = 'en' AND n_chars > 1500").orderBy("doc_id").collect())
    words = text.split()[:400]
    rows = []
    for n in range(3):
        lines = [words[i : i + 80] for i in range(0, len(words), 80)]
        for k, line in enumerate(lines):
            line[len(line) // 2] = f"other{chr(97 + n)}{chr(97 + k)}"
        rows.append((10**9 + n, "\n".join(map(" ".join, lines)), "en", "s", 0))
    return spark.createDataFrame(rows, docs.schema)


def test_stages_keep_columns_and_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    copies = near_copies(docs, spark)
    seen, columns = docs.unionByName(copies), docs.columns
    counts = [seen.count()]
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id for r in seen.select("doc_id").collect()}
        seen = spark.createDataFrame(stage(spark, seen, folder).toPandas(), docs.schema)
        assert seen.columns == columns
        counts.append(seen.count())
        if name == "near_duplicates":
            # lines that are copies are gone by now; copies that differ in every line go here, all but the first
            gone = before - {r.doc_id for r in seen.select("doc_id").collect()}
            assert gone == {10**9 + 1, 10**9 + 2} & before and gone
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    packed = C.STAGES[-1][1](spark, seen.coalesce(1), folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in seen.select("doc_id").collect()}


EDGES = "doc_id long, text string, lang string, source string, n_chars long, score string, sig int, target string, component_id string"


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names; what each stage keeps is stated in its docstring."""
    folder, long_text = "/root/testdata/sf0.001", "a long line of words without an end " * 3000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here\nanother line of it", "en", "a", 5), (3, "same words here\nanother line of it", "en", "a", 5),
        (None, "text without an id", "en", None, 3), (4, long_text, "en", "b", 9), (5, "same words here\nonly here, nowhere else", "en", "b", 7),
    ]
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], EDGES)
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0 and empty.columns == out.columns
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            # every id comes out, once or more
            ids = {r.doc_id for r in got}
            assert ids <= {r[0] for r in rows} and (name in ("quality", "mixing") or ids == {r[0] for r in rows})
        if name == "lines":
            texts = {(r.doc_id, r.text) for r in got}
            assert (5, "only here, nowhere else") in texts and (4, long_text) in texts and len(got) == 7
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "5", "None"]
        if name == "packing":
            assert {r.doc_id for r in got} == {r[0] for r in rows} and sum(r.start == 0 for r in got) == 7


def test_run_and_registry(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
