import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wavecohort.operators import thresholds as H
from wavecohort.plans import evaluation, proxies


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_score_tables_have_partitions_by_number_of_orders_and_are_not_shuffled_again(spark, sf, monkeypatch):
    monkeypatch.setattr(proxies, "ORDERS", 100)
    n = proxies.read(spark, sf, "orders").count()
    assert proxies.scores(spark, sf).rdd.getNumPartitions() == 1 + n // 100
    for name in ("P11_label_matrix", "P12_auxiliary_targets", "W32_combine_views", "T1_top_classes"):
        p = plan(__spark_entry__.queries()[name](spark, sf))
        assert p.count("Exchange hashpartitioning") == 2 and "BroadcastExchange" not in p, name  # orders and their lines
    assert evaluation.pairs(spark, sf).rdd.getNumPartitions() == 1 + n // 100


def test_score_pairs_meet_by_record_and_class_also_where_keys_repeat(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 8), (2, 9), (None, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "F", "A"), (1, "F", "A"), (1, "O", "R"), (2, "X", "Y"), (3, "F", "A")], "l_orderkey long, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    s, b = proxies.scores(spark, str(tmp_path)), proxies.scores_b(spark, str(tmp_path)).select("record_id", "class_idx", F.col("prob").alias("b"))
    assert sorted((r.patient_id, r["class"]) for r in s.where("y = 1").collect()) == [(p, c) for p in (7, 8) for c in ("FA", "OR")]
    assert s.count() == 24
    want = s.withColumnRenamed("prob", "a").join(b, ["record_id", "class_idx"]).select("record_id", "patient_id", "class", "y", "a", "b")
    got = evaluation.pairs(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_platt_rounds_read_the_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(p):
        seen.add(1)
        return p

    rows = [("g", int(math.sin(k * 12.9) > 0.8 - k / 50), k / 50) for k in range(1, 50)]
    df = spark.createDataFrame(rows, "class string, y int, prob double")
    fit = H.platt_fit(df.withColumn("prob", F.udf(counted, "double")("prob")), ["class"]).first()
    assert seen.value == len(rows) and fit.slope == pytest.approx(H.platt_fit(df, ["class"]).first().slope)
