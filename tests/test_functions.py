from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.alphabets import AA, DNA, STATES62, STATES90, checked, cleaned, decoded, encoded, letter_counts


def test_alphabet_sizes():
    assert (AA.size, DNA.size, STATES62.size, STATES90.size) == (20, 4, 62, 90)
    assert AA.codes()["B"] == AA.codes()["D"] and AA.codes()["U"] == AA.codes()["C"] and AA.codes()["J"] == AA.any
    assert len(set(STATES90.letters)) == 90


def test_encode_decode(spark):
    df = spark.createDataFrame([(c,) for c in "ARNDx-.z"], "c string").select("c", encoded(F.col("c"), AA).alias("a"))
    got = {r.c: r.a for r in df.collect()}
    assert got == {"A": 0, "R": 1, "N": 2, "D": 3, "x": 20, "-": 21, ".": 21, "z": AA.codes()["E"]}
    back = df.select("c", decoded(F.col("a"), AA).alias("d"))
    assert {r.c: r.d for r in back.collect()}["x"] == "X"


def test_invalid_letters_raise(spark):
    df = spark.createDataFrame([("ACGT",), ("ACNT",)], "s string")
    assert df.select(cleaned(F.lit(" A-C.G\n")).alias("s")).first().s == "ACG"
    with pytest.raises(Exception, match="not in the alphabet: N"):
        df.select(checked(F.col("s"), DNA)).collect()


def test_letter_counts(spark):
    x = spark.createDataFrame([("abBz ß",)], "t string").select(letter_counts(F.col("t"), AA).alias("x")).first().x
    n = {r.a: r.n for r in x if r.n}
    assert n == {0: 1, AA.codes()["D"]: 2, AA.codes()["E"]: 1}


@pytest.mark.parametrize(("x", "y"), [(0.5, 1), (-0.5, 0), (-1.5, -1), (2.4999, 2), (-2.51, -3)])
def test_iround(spark, x, y):
    assert spark.range(1).select(scalars.iround(F.lit(x)).alias("y")).first().y == y


def test_normalise_skips_near_and_zero_sums(spark):
    df = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("n", 0.5), ("n", 0.5 + 5e-7), ("f", 1.0), ("f", 3.0)], "id string, v double")
    got = {}
    for r in scalars.normalized(df, ["id"]).collect():
        got.setdefault(r.id, []).append(r.v)
    assert sorted(got["z"]) == [0, 0] and sorted(got["n"]) == [0.5, 0.5 + 5e-7] and sorted(got["f"]) == [0.25, 0.75]


def test_neff_of_one_hot_and_two_letter_columns(spark):
    rows = [("one", i, 0, 1.0) for i in range(100)] + [("two", i, a, 0.5) for i in range(100) for a in (0, 1)]
    got = {r.id: r.neff for r in scalars.profile_neff(spark.createDataFrame(rows, "id string, i int, a int, v double")).collect()}
    assert got["one"] == pytest.approx(1.0) and got["two"] == pytest.approx(2.0)


def test_window_weights():
    assert scalars.window_weights(5) == pytest.approx([1.6 * 0.7225, 1.36, 1.6, 1.36, 1.6 * 0.7225])
    with pytest.raises(ValueError):
        scalars.window_weights(4)


def test_insert_clips(spark):
    a = spark.createDataFrame([("p", i, 0, 1.0) for i in range(4)], "id string, i int, a int, v double")
    b = spark.createDataFrame([("p", i, 0, 9.0) for i in range(3)], "id string, i int, a int, v double")
    assert [r.v for r in scalars.inserted(a, b, 2).orderBy("i").collect()] == [1, 1, 9, 9]


def test_small_scalars(spark):
    r = spark.range(1).select(
        scalars.match_symbol(F.lit(0.7)).alias("m"), scalars.confidence_digit(F.lit(1.0)).alias("c"), scalars.colour_text(F.lit(0.5), F.lit(1.0), F.lit(0.25)).alias("t"), scalars.parsed_colour(F.lit("0.40, 0.5,1")).alias("p"), scalars.lattice_name(F.lit(0), F.lit(1), F.lit(1), 2, F.lit(3)).alias("n"),
        scalars.relative_difference(F.lit(2.0), F.lit(1.0)).alias("d"), scalars.extension(F.lit("/a/b.c/x.prf")).alias("e"), scalars.directory(F.lit("/a/b.c/x.prf")).alias("f"), scalars.base_name(F.lit("/a/b")).alias("b"), scalars.tokens(F.lit(" a  b ")).alias("w"),
    ).first()
    assert (r.m, r.c, r.t, tuple(r.p), r.n) == ("+", 9, "0.50,1.00,0.25", (0.4, 0.5, 1.0), "EBA3")
    assert (r.d, r.e, r.f, r.b, r.w) == (0.5, "prf", "/a/b.c", "b", ["a", "b"])


def test_trapezoid_starting_points(spark):
    p = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double")
    assert scalars.trapezoid(p, []).first().area == pytest.approx(6.0)
    assert scalars.trapezoid(p, [], start=(0.0, 1.0)).first().area == pytest.approx(7.5)
    assert math.isclose(spark.range(1).select(scalars.e_from_p(scalars.p_from_e(F.lit(0.3), F.lit(10.0)), F.lit(10.0)).alias("e")).first().e, 0.3)
