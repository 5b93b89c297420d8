from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.alphabets import DNA, cells
from strandline.operators import search


def brute(query, text):
    """Best segment of each diagonal under +1 / -1."""
    out = {}
    for d in range(-len(query) + 1, len(text)):
        best = run = 0
        for i in range(len(query)):
            if 0 <= i + d < len(text):
                run = max(0, run + (1 if query[i] == text[i + d] else -1))
                best = max(best, run)
        if best:
            out[d] = best
    return out


def scored(spark, q):
    rows = [("q", i, a, 1.0 if DNA.letters[a] == c else -1.0) for i, c in enumerate(q) for a in range(4)]
    return spark.createDataFrame(rows, "query string, i int, a int, s double")


def test_scan_finds_best_segments(spark):
    rng = np.random.default_rng(0)
    q, t = ("".join("ACGT"[k] for k in rng.integers(0, 4, n)) for n in (12, 40))
    db = spark.createDataFrame([("t", t)], "target string, seq string")
    found = search.scan(scored(spark, q), cells(db, "seq", DNA, ["target"]).select("target", "pos", "a")).collect()
    assert {r.diagonal: r.score for r in found} == brute(q, t)
    for r in found:
        same = [q[i] == t[i + r.diagonal] for i in range(r.q_start, r.q_end + 1)]
        assert sum(1 if x else -1 for x in same) == r.score


def test_iterated_search_settles(spark):
    seqs = {"q": "ACGTACGTAC", "near": "TTACGTACGTACTT", "far": "GGGGGGGGGGGG"}
    queries = spark.createDataFrame([("q", seqs["q"])], "id string, seq string")
    db = spark.createDataFrame([(k, v) for k, v in seqs.items() if k != "q"], "id string, seq string")
    letters = cells(db, "seq", DNA, ["id"]).withColumnRenamed("id", "target")
    bg = spark.createDataFrame([(a, 0.25) for a in range(4)], "a int, p double")
    o = search.SearchOptions(iterations=4, inclusion=0.5)

    def profile(ali):
        if ali is None:
            c = cells(queries, "seq", DNA, ["id"])
            flat = c.select("id", "pos").distinct().crossJoin(bg)
            return search.sequence_profile(c, lambda _: flat, DNA, search.SearchOptions(admix=0.4))
        from strandline.functions.alphabets import encoded

        c = ali.select("ali", "k", "i", encoded(F.col("chr"), DNA).alias("a"))
        counts = search.alignment_profile(c, DNA, search.SearchOptions(global_weights=True))
        flat = counts.select("id", "pos").distinct().crossJoin(bg)
        return flat.join(counts.withColumnRenamed("p", "f"), ["id", "pos", "a"], "left").select("id", "pos", "a", (F.lit(0.4) * F.col("p") + F.lit(0.6) * F.coalesce("f", F.lit(0.0))).alias("p"))

    hits, changed = search.iterate(queries, lambda p, r: search.as_hits(search.scan(search.log_odds_bits(p, bg), letters, o), queries, db, o), profile, o)
    rows = hits.collect()
    assert [r.definition for r in rows] == ["near"] and changed[-1] == 0
    assert rows[0].hsps[0].q_seq == seqs["q"] and rows[0].hsps[0].s_start == 3


def test_options():
    o = search.SearchOptions.parse({"x": "0.5", "j": "3", "best": "true", "W": "3"})
    assert (o.admix, o.iterations, o.best_only, o.passed) == (0.5, 3, True, {"W": "3"})
    assert search.external("cat", lambda s: [{"text": s}], search.SearchOptions())("x") == [{"text": "x"}]


def test_global_and_position_profiles_sum_to_one(spark):
    rows = [("x", k, i, DNA.codes()[c]) for k, s in enumerate(["ACGTACGTACGT", "ACGAACGTACGA"]) for i, c in enumerate(s)]
    c = spark.createDataFrame(rows, "ali string, k int, i int, a int")
    for g in (True, False):
        p = search.alignment_profile(c, DNA, search.SearchOptions(global_weights=g))
        assert all(r.s == pytest.approx(1) for r in p.groupBy("pos").agg(F.sum("p").alias("s")).collect())


def test_scan_over_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE", 2)
    monkeypatch.setattr(search, "BLOCK", 40)
    rng = np.random.default_rng(3)
    queries = {f"q{k}": "".join("ACGT"[x] for x in rng.integers(0, 4, n)) for k, n in enumerate((1, 5, 9, 9, 14))}
    texts = {k: "".join("ACGT"[x] for x in rng.integers(0, 4, n)) for k, n in enumerate((3, 60, 25, 1))}
    rows = [(q, i, a, 1.0 if DNA.letters[a] == c else -1.0) for q, t in queries.items() for i, c in enumerate(t) for a in range(4)]
    db = spark.createDataFrame([(k, i, DNA.letters.index(c)) for k, t in texts.items() for i, c in enumerate(t)], "target int, pos int, a int")
    found = search.scan(spark.createDataFrame(rows, "query string, i int, a int, s double"), db).collect()
    assert {(r.query, r.target, r.diagonal): r.score for r in found} == {(q, k, d): v for q, x in queries.items() for k, t in texts.items() for d, v in brute(x, t).items()}
    for r in found:
        part = range(r.q_start, r.q_end + 1)
        assert r.t_start == r.q_start + r.diagonal and sum(1 if queries[r.query][i] == texts[r.target][i + r.diagonal] else -1 for i in part) == r.score
    assert search.scan(spark.createDataFrame(rows, "query string, i int, a int, s double"), db.limit(0)).count() == 0
