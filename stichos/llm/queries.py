"""Queries of this subpackage on the given tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stichos.llm import (bpe, exact_dedup, fill_middle, html_blocks, mil_quality, near_dedup, packing, pitman_yor, quality_rules, suffix_dedup,
                         token_store, toxicity, vector_codes)
from stichos.llm.common import cut, load, salted_left_join, vocabulary_file


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.encode_documents(load(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_text(load(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), PATTERN)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(load(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(load(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(fill_middle.restored("output", "form")).alias("restored_sha256"))


def op12_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_shards(load(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))
    return token_store.read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, codebooks = vector_codes.compress_vectors(load(spark, sf_dir, "embeddings"))
    rows = cut(table).withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0)),
                                   "_row": F.coalesce("vec_id", F.monotonically_increasing_id())})
    same = rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    return salted_left_join(rows, same, ["_none", "_label"], "_row").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_sha256(codebooks)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_html_blocks, op4_packing, op5_exact_dedup,
                                  op6_attention_quality, op7_toxicity, op8_pitman_yor, op9_suffix_array, op10_minhash,
                                  op11_fill_in_middle, op12_wavelet_store, op13_vector_codes)}


def _lloyd_sql() -> str:
    """Six rounds written out one after another, every part against every entry."""
    near = """a{0} AS MATERIALIZED (SELECT row, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (SELECT p.row, p.part, entry,
  list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM p JOIN c{0} USING (part)) GROUP BY ALL)"""
    mean = """c{1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.c, o.c) AS c FROM c{0} o LEFT JOIN (SELECT part, entry, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c
  FROM (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, a{0}.entry, x, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a{0} USING (row, part)) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""
    steps = [t.format(k, k + 1) for k in range(6) for t in (near, mean)] + [near.format(6)]
    return """WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM k, range(8) t(part)),
c0 AS MATERIALIZED (SELECT part, row AS entry, x AS c FROM p WHERE row < 16),
""" + ",\n".join(steps) + """,
f AS (SELECT row, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY row),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (row), b"""


ORACLES = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm,
  text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM d),
c AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:], '') AS suffix FROM k)
SELECT doc_id, len(u) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars,
  CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(CASE WHEN plain THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM c""",
    "op13_vector_codes": _lloyd_sql(),
}
