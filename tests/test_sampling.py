from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.operators import ranking, sampling


def test_drawn_has_no_repeats_and_stays(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(9, 99)], "g int, k int")
    one, two = (sorted(map(tuple, sampling.drawn(df.repartition(n), ["g"], ["k"], 4, 1).collect())) for n in (1, 5))
    assert one == two and len(one) == len(set(one)) == 13
    assert sampling.drawn(df.limit(0), ["g"], ["k"], 4).count() == 0


def test_pool_pairs_are_all_pairs_once(spark):
    pool = spark.createDataFrame([("f", k) for k in range(5)] + [("g", 7)], "g string, k int")
    got = sampling.pool_pairs(pool, ["g"], "k", 3).collect()
    assert {frozenset((r.struct, r.target)) for r in got} == {frozenset((a, b)) for a in range(5) for b in range(a)} and len(got) == 10


def test_exceptions_of_families(spark):
    rows = [("b.66.1.1", "b.70.2.1", True), ("b.66.1.1", "b.7.2.1", False), ("c.2.1.1", "c.111.1.1", True), ("c.1.1.1", "c.2.1.1", False), ("i.1.1.1", "a.1.1.1", True), ("a.118.24.1", "d.211.1.1", True), ("a.1.2.1", "d.58.1.2", True), ("a.2.1.1", "d.3.1.1", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(ranking.excepted(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_accepted_by_one_criterion(spark):
    df = spark.createDataFrame([(1, 0.9, 9.0, 0.1), (2, 0.1, 1.0, 0.1), (3, 0.9, 1.0, 0.9)], "k int, tm_score double, rmsd double, identity double")
    assert [r.k for r in ranking.accepted(df, rmsd=None).collect()] == [1]
    assert [r.k for r in ranking.accepted(df, tm=None).collect()] == [2]


def test_alignments_are_checked(spark):
    p = spark.createDataFrame([("x/a_1.prf", 3), ("x/b.prf", 2)], "path string, columns int")
    a = spark.createDataFrame([("y/a_1.a3m", 3), ("y/b.a3m", 5)], "path string, matches int")
    assert {r.name: r.fits for r in sampling.with_alignments(p, a).collect()} == {"a_1": True, "b": False}
    assert sampling.checked_alignments(p.limit(1), a).count() == 1
    with pytest.raises(Exception, match="instead of"):
        sampling.checked_alignments(p, a).collect()


def test_lengths_and_statistics(spark):
    s = spark.createDataFrame([(k, "a" * n) for k, n in enumerate([10, 14, 15, 19, 20, 9])], "k int, seq string")
    got = sampling.length_sample(s, ["k"], 10, 19, 5, 9)
    assert {r.k: r.bin for r in got.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    fill = sampling.length_fill(got, "AC", 10, 19, 5, 3).collect()
    assert sorted((r.bin, len(r.seq)) for r in fill) == [(0, 10), (1, 15)] and all(set(r.seq) <= set("AC") for r in fill)
    n = spark.createDataFrame([(2.0,), (3.0,)], "n double")
    assert tuple(sampling.count_statistics(n, 4).first()) == (5.0, 0.0, 3.0, 1.25)
    assert tuple(sampling.count_statistics(n, 2).first()) == (5.0, 2.0, 3.0, 2.5)
    assert tuple(sampling.training_neff(spark.createDataFrame([([1.0, 2.0],)], "y array<double>"), None).first()) == (1.0, 3.0)
