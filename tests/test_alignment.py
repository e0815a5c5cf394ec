import random

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import alignment


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def splits(hyp, ref):
    if not hyp:
        return not ref
    if any(c.isdecimal() for c in hyp[0]):
        return any(len(ref) >= k and splits(hyp[1:], ref[k:]) for k in range(1, 6))
    return bool(ref) and hyp[0] == ref[0] and splits(hyp[1:], ref[1:])


def test_distance_equals_the_whole_table():
    rng = random.Random(1)
    for n in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [x for x in a if rng.random() > 0.1] if n % 2 else [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert alignment.words_apart(a, b) == table_distance(a, b)
    assert alignment.words_apart([], []) == 0 and alignment.words_apart(["a"], []) == 1


@pytest.mark.parametrize("band", [1, 2, 7, 64, 200])
def test_a_band_that_holds_the_distance_gives_it(band):
    rng = random.Random(band)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 60))] for _ in range(2))
        want = table_distance(a, b)
        if band >= abs(len(a) - len(b)):
            got = alignment._apart_within(a, b, band)
            assert got == want if want <= band else got >= want


def test_distance_of_long_texts():
    rng = random.Random(2)
    a = [f"w{rng.randint(0, 3000)}" for _ in range(30_000)]
    dropped = set(rng.sample(range(len(a)), 300))
    assert alignment.words_apart(a, [w for i, w in enumerate(a) if i not in dropped]) == 300
    assert alignment.words_apart(a, [f"{w}!" if i in dropped else w for i, w in enumerate(a)]) == 300


def test_wildcards_equal_every_split():
    rng = random.Random(3)
    for _ in range(2500):
        ref = [rng.choice("ab") for _ in range(rng.randint(0, 14))]
        hyp = [rng.choice(["a", "b", "7", "x1", "٣"]) for _ in range(rng.randint(0, 8))]
        assert alignment.spells(hyp, ref) == alignment.spans_of(hyp, ref)[0] == splits(hyp, ref)


def test_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"]), (None, ["a"]), (["x"] * 5000, ["x"] * 4000)], "r array<string>, h array<string>")
    assert [r.d for r in df.select(alignment.edit_distance_udf(F.col("r"), F.col("h")).alias("d")).collect()] == [1, 1, 1, 1000]
