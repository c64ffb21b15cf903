"""How an extraction's score is counted."""

from __future__ import annotations

from tallyspark.operators import quality

SCHEMA = "doc string, ord long, date string, amount_paise long, description string"


def test_rows_are_counted_where_their_key_lies(spark):
    """No map of a split's keys before the shuffle; equal keys, nulls and sides without rows count."""
    truth = spark.createDataFrame([("a", 1, "d", 5, "x"), ("a", 2, "d", 5, "y"), ("a", 3, None, 7, "z"), ("b", 1, "d", 1, "x")], SCHEMA)
    predicted = spark.createDataFrame([("a", 1, "d", 5, "x"), ("a", 2, None, 7, "w"), ("a", 3, "d", 9, "x"), ("c", 1, "d", 1, "x")], SCHEMA)
    scored = quality.extraction_score(truth, predicted, "doc")
    assert sorted(map(tuple, scored.select("doc", "truth", "predicted", "matched", "precision", "recall").collect())) == [("a", 3, 3, 2, 0.666667, 0.666667), ("b", 1, 0, 0, 0.0, 0.0), ("c", 0, 1, 0, 0.0, 1.0)]
    below = scored._jdf.queryExecution().executedPlan().toString().split("Union", 1)[1]
    assert "HashAggregate" not in below and "SortAggregate" not in below
