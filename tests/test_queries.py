"""Every registered query with SQL agrees with DuckDB on the smallest data set."""

import duckdb
import pytest
from pyspark.sql import functions as F

from check import TABLES, rows_of
from queries import all_oracles, all_queries, common

SF = "/root/testdata/sf0.001"
# what these compute is part of a longer query that runs here
PARTS = {"e04_approaches", "f02_dialect_vector", "r08_long_features"}
NAMES = sorted(set(all_oracles()) - PARTS)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got, want = all_queries()[name](spark, SF).toPandas(), con.execute(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A large file of one row group has many splits, all but one of them empty."""
    spark.range(2000).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(0, 30), k -> md5(string(id * 31 + k)))) text", "'en' lang", "'src1' source") \
        .coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    conf = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        splits = common.documents(spark, str(tmp_path))
        cores = spark.sparkContext.defaultParallelism
        assert splits.rdd.getNumPartitions() >= cores
        assert splits.select(F.spark_partition_id()).distinct().count() == 1
        for lines in (common.verses(spark, str(tmp_path)), common.doc_lines(spark, str(tmp_path))):
            dealt = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
            assert len(dealt) >= cores and max(dealt) < 2 * sum(dealt) / cores
    finally:
        for key in conf:
            spark.conf.unset(key)
