"""Readers and writers: JSON arrays in ranges, forms, feet, tables by text; whole jobs from file to log."""

import json

import pytest
from pyspark.sql import functions as F

from stichos.functions import phonemes as ph
from stichos.operators import evaluate as ev, folds as fo, learn as le, scansion as sc, tokens as tk
from stichos.plans import pipeline
from stichos.sources import corpus, json_arrays as ja
from test_scansion import VERSES

ELEMENTS = [{"text": "a]b[c", "poem": "x\\", "book": 1, "line": 1}, {"text": 'quote " and \\" and \\\\', "poem": "},{", "book": None, "line": 2}, {"text": "é日本\U0001f600", "poem": "\n\t", "line": 3},
            {"text": "\\\\\\", "poem": "[[", "book": 2, "line": 4}, {"text": "", "poem": "long " * 40, "book": 3, "line": 5}, {"text": "tail\\\"", "poem": "{", "book": 3, "line": 6}]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 61, 5000])
def test_json_arrays_in_ranges(spark, tmp_path, size):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(ELEMENTS, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "in" / "two.json").write_text(" \n" + json.dumps([[1, [2, "]"]], "x,\"y", 3, None, {"k": [{}]}], separators=(",", ":")) + "\n")
    (tmp_path / "in" / "none.json").write_text(" [ \n ] ")
    (tmp_path / "in" / "_SUCCESS").write_text("[1]")
    got = [json.loads(r.value) for r in ja.json_elements(spark, str(tmp_path / "in"), size).collect()]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(got, key=key) == sorted([*ELEMENTS, [1, [2, "]"]], "x,\"y", 3, None, {"k": [{}]}], key=key)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"text": f"line, [{k}]", "poem": "p", "book": k % 7, "line": k} for k in range(5000)]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    found = ja.json_elements(spark, f"file:{tmp_path}/big.json", 4096)
    per = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 5000 and len(per) > 4
    lines = corpus.read_lines(spark, f"{tmp_path}/big.json")
    assert lines.agg(F.sum("line"), F.count_distinct("text")).first()[:] == (sum(range(5000)), 5000)


def test_no_file_and_a_file_that_ends_early(spark, tmp_path):
    assert ja.json_elements(spark, str(tmp_path)).collect() == []
    (tmp_path / "cut.json").write_text('[{"line": 1}, {"line": 2}, {"li')
    assert [r.value for r in ja.json_elements(spark, str(tmp_path / "cut.json"), 5).orderBy("value").collect()] == ['{"line": 1}', '{"line": 2}']


def test_arrays_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(f"t {k}", "P", k, k) for k in range(100)], "text string, poem string, book int, line int").repartition(5)
    ja.write_json_arrays(df, str(tmp_path / "out"))
    assert all(isinstance(json.loads(p.read_text()), list) for p in (tmp_path / "out").glob("part-*"))
    assert sorted(corpus.read_lines(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())
    ja.write_json_arrays(df.filter("line < 0"), str(tmp_path / "none"))
    assert corpus.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_lines_in_all_shapes(spark, tmp_path):
    df = spark.createDataFrame([(e["text"], e["poem"], e.get("book"), e["line"]) for e in ELEMENTS], "text string, poem string, book int, line int")
    df.write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(e) for e in ELEMENTS))
    (tmp_path / "c.json").write_text(json.dumps(ELEMENTS))
    want = sorted(df.collect(), key=lambda r: r.line)
    for name in ("a.parquet", "b.jsonl", "c.json"):
        assert sorted(corpus.read_lines(spark, str(tmp_path / name)).collect(), key=lambda r: r.line) == want


def test_form_table(spark, tmp_path):
    (tmp_path / "forms.json").write_text(json.dumps([["te", [{"form": "te", "lemma": "te", "pos": "partic"}, {"form": "te", "lemma": "su/", "case": "acc"}]], ["none", []]]))
    got = corpus.read_forms(spark, str(tmp_path / "forms.json")).collect()
    assert sorted((r.token, r.parse_no, r.lemma, r.pos, r.case) for r in got) == [("te", 0, "te", "partic", None), ("te", 1, "su/", None, "acc")]


def test_manifest(spark):
    rows = {r.text_name: r for r in corpus.manifest(spark).collect()}
    assert len(rows) == 31 and rows["Iliad"].num_books == 24 and rows["Iliad"].divide_by_book and not rows["Iliad"].skip_for_accuracy
    assert rows["Works of Bion"].is_combined and rows["Works of Bion"].source_texts == ["Epithalamium Achillis et Deidameiae", "Epitaphius Adonis", "Fragmenta"]
    assert rows["Fragmenta"].to_be_combined and rows["Fragmenta"].increments == [*range(3, 19)] and rows["Theogony"].increments[:3] == [1, 29, 53]
    assert rows["Odyssey1"].skip_for_accuracy and not rows["Odyssey1"].is_combined


def test_feet_and_tables_by_text(spark, tmp_path):
    (tmp_path / "feet.txt").write_text("DDSDD\r\nDSDSD\n\nSSDDD\n")
    truth = corpus.read_feet(spark, str(tmp_path / "feet.txt"), "A", first_line=1)
    assert sorted((r.line, r.feet5) for r in truth.collect()) == [(1, "DDSDD"), (2, "DSDSD"), (4, "SSDDD")]
    lines = spark.createDataFrame([("A", 1, n, t) for n, t, _, _ in VERSES], "text_name string, book int, line int, text string")
    scans = sc.scan_lines(sc.clean_verses(lines))
    corpus.write_by_text(scans.select("text_name", "book", "line", "feet"), str(tmp_path / "scans"))
    back = spark.read.parquet(str(tmp_path / "scans"))
    assert [p.name for p in (tmp_path / "scans").glob("text_name=*")] == ["text_name=A"]
    assert {r.line: r.feet for r in back.collect()} == {r.line: r.feet for r in scans.collect()}
    out = ev.compare(back.withColumn("scanned", F.col("feet").isNotNull()), ev.truth(truth), ["line"])
    assert {r.line: r.outcome for r in out.collect()} == {1: "agree", 2: "agree", 4: "agree"}


def test_words_wrapped_over_line_ends(spark):
    rows = [("A", 1, "mh=nin a)/ei-"), ("A", 2, "de qea\\ phlh-  "), ("A", 3, "i+a/dew"), ("A", 4, " a)xilh=os ou)lo-"), ("A", 5, "  me/nhn te--"), ("B", 1, "a)/llo"), ("B", 2, "mo-"), ("B", 3, "no-"), ("B", 4, "s")]
    df = spark.createDataFrame(rows, "t string, line int, text string").repartition(4)
    got = {(r.t, r.line): r.w for r in tk.tokens_of_wrapped_blocks(df, ["t"]).groupBy("t", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), " ").alias("w")).collect()}
    assert got == {("A", 1): "mh=nin a)/eide", ("A", 2): "qea\\ phlhi+a/dew", ("A", 4): "a)xilh=os ou)lo", ("A", 5): "me/nhn te", ("B", 1): "a)/llo", ("B", 2): "mo", ("B", 3): "nos"}


# ---- whole jobs --------------------------------------------------------------------------------------------

def test_from_files_to_the_log(spark, tmp_path):
    """Manifest, combined texts, both readings, features, dialects, matrix, classifiers."""
    names = ["Iliad", "Odyssey", "Theogony", "Eros Drapeta", "Europa", "Phaenomena"]
    rows = [{"text": VERSES[(k + n) % 5][1], "poem": name, "book": 1 + k % 2, "line": k + 1} for n, name in enumerate(names) for k in range(12)]
    (tmp_path / "lines.json").write_text(json.dumps(rows))
    words = sorted({w for v in VERSES for w in tk.tokens_of_lines(spark.createDataFrame([(v[1],)], "text string"), []).toPandas()["token"]})
    forms = [[w, [{"form": w, "lemma": w, "pos": "noun", "case": "nom", "number": "sg", "gender": "fem", "dialect": "epic ionic"}]] for w in words if w != "te"]
    forms.append(["te", [{"form": "te", "lemma": "te", "pos": "partic"}]])
    (tmp_path / "forms.json").write_text(json.dumps(forms))
    lines = corpus.read_lines(spark, str(tmp_path / "lines.json")).withColumnRenamed("poem", "text_name")
    every = pipeline.corpus_with_combinations(spark, lines)
    assert {r.text_name for r in every.select("text_name").distinct().collect()} == {"Iliad", "Odyssey", "Theogony", "Works of Moschus", "Phaenomena"}
    table = corpus.read_forms(spark, str(tmp_path / "forms.json")).withColumn("case", F.col("case"))
    entries = table.select("lemma").distinct().select("lemma", F.lit("noun").alias("entry_pos"), F.lit("firstDeclensionEta").alias("ending_type"))
    stems = entries.select("lemma", F.lit("*").alias("slot"), F.lit(0).alias("variant_no"), F.regexp_replace(F.translate("lemma", "/=", ""), "[^aeiouhw]*[aeiouhw]+[^aeiouhw]*$", "").alias("stem"))
    stems = stems.withColumn("stem_lengths", F.translate(ph.default_lengths("stem"), "?", "s"))
    scans = pipeline.scan_corpus(every, table, entries, stems)
    total = pipeline.total_success(scans, spark)
    rate = {(r.text_name, r.skipped): (r.n_lines, r.n_scanned) for r in total.collect()}
    assert rate["Works of Moschus", False][0] == 24 and rate["Total", None] == tuple(map(sum, zip(*(v for k, v in rate.items() if k[0] != "Total"))))
    assert 0 < rate["Total", None][1] <= 72
    per_text, per_rule = pipeline.judge_dialects(every, table, str(tmp_path / "dialects"))
    matrix = pipeline.feature_matrix(scans, per_text, per_rule)
    names = [f"{r.text_name}: {r['sub']}" for r in matrix.select("text_name", "sub").distinct().collect()]
    assert "Iliad: Book 1" in names
    rows = spark.createDataFrame([(n, str(k % 2)) for k, n in enumerate(sorted(names))], "name string, fold string")
    log = pipeline.classify(matrix, rows, [le.Cell(0.0, "scale", "logistic"), le.Cell(0.0, "pca2", "knn2")], str(tmp_path / "grid"), steps=5)
    got = log.collect()
    assert got and {r.cell for r in got} == {"all -> scale -> logistic", "all -> pca2 -> knn2"} and {r.label for r in got} <= set(range(10))


def test_stratified_groups(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["Iliad"] * 10 + ["Odyssey"] * 5 + ["Hymns"] * 10 + ["HymnsLong"] * 5 + ["Theogony"] * 15)], "name int, text_name string")
    folds = fo.stratified_folds(df.withColumn("grp", fo.three_groups("text_name")), "name", "grp")
    got = {(r.grp, r.fold): r["count"] for r in folds.groupBy("grp", "fold").count().collect()}
    assert got == {(g, f): 3 for g in ("homeric", "pseudo", "other") for f in range(1, 6)}
