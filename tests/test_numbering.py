import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.plans.numbering import numbered, with_previous

from .conftest import rows


@pytest.mark.parametrize("largest", [10, 10_000])
def test_large_groups_equal_windows(spark, largest):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(data, "k string, i long, x double").repartition(7)
    window = Window.partitionBy("k").orderBy("i")
    assert rows(numbered(df, "k", ["i"], largest=largest), "k", "i", "number") == rows(df.withColumn("number", F.row_number().over(window).cast("long")), "k", "i", "number")
    expected = df.withColumns({"before": F.lag("i").over(window), "y": F.lag("x").over(window)})
    assert rows(with_previous(df, "k", "i", {"before": "i", "y": "x"}, largest=largest), "k", "i", "x", "before", "y") == rows(expected, "k", "i", "x", "before", "y")
    assert numbered(df.limit(0), "k", ["i"], largest=largest).count() == 0
