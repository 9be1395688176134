import numpy as np
from pyspark.sql import functions as F

from corvane.llm.sample import bounded


def test_the_choice_spreads_over_all_keys(spark):
    n = 300_000
    rows = spark.range(n).select(F.col("id"), (F.col("id") * 2).alias("y"))
    ids = np.sort([r.id for r in bounded(rows.unionAll(rows.limit(50)), "id", 1_000).collect()])
    assert 990 <= len(ids) <= 1_000 and len(set(ids)) == len(ids)
    # each tenth of the range has its share
    assert (np.abs(np.bincount(ids * 10 // n, minlength=10) - 100) < 40).all()
    assert [r.id for r in bounded(rows, "id", 1_000).orderBy("id").collect()] == ids.tolist()


def test_all_keys_of_a_small_table_may_stay_and_null_keys_go(spark):
    rows = spark.createDataFrame([(None, 1), (3, 1), (3, 0), (4, 1)], "id long, y int")
    assert sorted(tuple(r) for r in bounded(rows, "id", 1_000_000).collect()) == [(3, 0), (4, 1)]
