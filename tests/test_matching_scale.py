"""Containment of labels that begin alike: every pair is found, and candidates stay few."""

import random

import pytest
from pyspark.sql import functions as F

from labelgrid.operators import matching as ma


def test_contained_labels_against_all_pairs(spark):
    rnd = random.Random(3)
    a = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 15))) for _ in range(150)})
    b = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30))) for _ in range(150)} | {"x" + t + "y" for t in a[::7]})
    found = ma._by_containment(spark.createDataFrame([(t,) for t in a], "a string"), spark.createDataFrame([(t,) for t in b], "b string"))
    expected = {(x, y) for x in a for y in b if (len(x) >= 3 and x in y) or (len(y) >= 3 and y in x)}
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 100


@pytest.mark.parametrize("n", [100_000])
def test_labels_of_one_beginning(spark, n):
    """One leading gram for all; each label stands under a gram of its own number."""
    names = spark.range(n).select(F.concat(F.lit("project report "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("b"))
    typed = names.where("substring(b, 21, 1) = '7'").select(F.concat("b", F.lit(" draft")).alias("a")).limit(300)
    keys = ma._grams(typed, "a").join(ma._rarest(names, "b", ma._grams(typed, "a")), "key")
    candidates = keys.count()
    heads = typed.count() * n  # what the leading gram alone would pair
    found = ma._by_containment(typed, names)
    assert found.count() == 300 and candidates < heads / 100, (candidates, heads)
