"""Names are compared once for two different ones, not once for each pair of rows."""

from pyspark.sql import functions as F

from linkmill.functions import similarity as S
from linkmill.plans import steps


def test_graded_links_compare_names_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(100 * i,) for i in range(60)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(100 * i,) for i in range(200)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        seen.add(1)
        return 100.0

    monkeypatch.setattr(S, "token_sort_ratio", counted)
    got = steps.QUERIES["graded_links"](spark, str(tmp_path)).collect()
    assert len(got) == 40  # "ann lee" and "ann leightan" differ too much in length
    assert 0 < seen.value < 200  # 12,000 pairs of rows, at most 12 of names


def test_variant_tiers_compare_names_once(spark, tmp_path, monkeypatch):
    rows = [(k, ["red box", "rod bax", "rad bix"][k % 3], "B", ["ECONOMY", "x"][k % 2], k % 30) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        seen.add(1)
        return 100.0

    monkeypatch.setattr(S, "ratio", counted)
    got = steps.QUERIES["variant_tiers"](spark, str(tmp_path)).collect()
    assert len(got) == 40  # "ann lee" and "ann leightan" differ too much in length0  # of each three names the ones not before the own one: 3 + 2 + 1, for 100 parts each
    assert 0 < seen.value < 200
