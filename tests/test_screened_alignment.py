"""Which rows reach the Python matcher, and that those that do not have the same results."""

import random

from pyspark.sql import functions as F

from scriptloom.functions import alignment


def test_rows_of_any_shape_align_as_the_matcher_says(spark):
    draw, rows = random.Random(4), [([], []), (["7"], []), ([], ["a"])]
    for _ in range(800):
        ref = [draw.choice("ab1") for _ in range(draw.randint(0, 9))]
        hyp = [draw.choice([w, w, w, "7", "b", ""]) for w in ref if draw.random() < draw.choice([0.7, 1])]
        rows.append(([h for h in hyp if h], ref))
    table = spark.createDataFrame(rows, "h array<string>, r array<string>").coalesce(1)
    found = table.select("h", "r", alignment.aligns(F.col("h"), F.col("r")).alias("ok"), alignment.align(F.col("h"), F.col("r")).alias("a")).collect()
    assert 100 < sum(x.ok for x in found) < 700
    for x in found:
        ok, spans = alignment.spans_of(x.h, x.r)
        assert x.ok == alignment.spells(x.h, x.r) == x.a.ok == ok
        assert [(s.digits, s.words) for s in x.a.spans] == spans


def test_only_possible_rows_reach_the_matcher(spark):
    rows = [(["7", "b"], ["a", "b"], False), (["7", "a"], ["a", "b", "c"], False), (["7", "c"], ["a", "b", "c"], True), (["b", "c"], ["a", "b", "c"], False)]
    table = spark.createDataFrame(rows, "h array<string>, r array<string>, asked boolean")
    assert all(x.asked == x.m for x in table.select("asked", alignment._may_fit(F.col("h"), F.col("r")).alias("m")).collect())
