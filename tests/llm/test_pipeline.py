"""The stages one after another, each on what the one before kept."""

import corpus_pipeline as cp
from stichos.llm import exact_dedup, near_dedup, quality_rules, suffix_dedup
from tests.llm.test_dedup import brute_components, brute_removed

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in cp.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept.append(docs.count())
        if name == "quality_rules":
            good = quality_rules.quality_rules(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in good.collect()}
        elif name == "exact_dedup":
            last = {}
            for i, t in rows:
                last[t] = max(i, last.get(t, i))
            assert {r.doc_id for r in docs.collect()} == set(last.values())
        elif name == "minhash_near_dedup":
            want, _ = brute_components(rows, cp.SHINGLE_WORDS, cp.SIMILARITY)
            assert {r.doc_id for r in docs.collect()} == set(want.values())
        elif name == "suffix_array_dedup":
            want = brute_removed(rows, suffix_dedup.WIDTH)
            for r in docs.collect():
                text = dict(rows)[r.doc_id]
                size, removed, _, _ = want[True, r.doc_id, text]
                assert 0 <= size - removed - len(r.text.encode()) <= 8 and r.n_chars == len(r.text)
        else:
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in rows}
    assert kept[0] > kept[1] >= kept[2] == kept[3] and exact_dedup and near_dedup


def test_run(spark):
    assert cp.run(spark, SF).count() > 0 and cp.ORACLE_SQL is None


def test_stages_on_nothing_and_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.filter("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
    text = " ".join(f"word{i} and" for i in range(100))
    odd = spark.createDataFrame([(None, text, "en", "src1", 1), (None, None, "en", "src1", None), (5, "", None, None, 0), (6, text, "en", "src1", 1), (6, text, "en", "src1", 1), (6, text + " more", "en", "src1", 1), (7, "few", "en", "src1", 1)], docs.schema)
    for name, stage in cp.STAGES:
        stage(spark, odd, SF).write.parquet(f"{tmp_path}/{name}")
        odd = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id for r in odd.collect()} <= {None, 5, 6, 7}
