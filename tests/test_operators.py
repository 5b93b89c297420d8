from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.alphabets import DNA
from strandline.operators import alignments, contexts, hmm, learning, profiles, ranking, sequences
from strandline.streaming import blocks


def cells(spark, rows, ali="x"):
    return spark.createDataFrame([(ali, k, i, DNA.codes()[c]) for k, s in enumerate(rows) for i, c in enumerate(s)], "ali string, k int, i int, a int")


def test_end_gaps(spark):
    got = alignments.mark_end_gaps(cells(spark, ["-A-C-", "-----"]), DNA).orderBy("k", "i").collect()
    assert [r.a for r in got] == [6, 0, 5, 1, 6] + [6] * 5


def test_reference_columns_and_inserts(spark):
    c = alignments.match_by_reference(cells(spark, ["A-C", "AGC"]), DNA)
    assert {(r.k, r.i): r.a for r in alignments.without_inserts(c).collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 1}
    assert {r.a for r in alignments.blank_inserts(c, DNA).filter("i = 1").collect()} == {DNA.gap}
    m = alignments.match_index(c.select("ali", "i", "is_match").distinct())
    assert {r.i: r.m for r in m.collect()} == {0: 0, 1: None, 2: 1}


def test_gap_rule_with_shares(spark):
    c = alignments.mark_end_gaps(cells(spark, ["A-C", "A-C", "AGC"]), DNA)
    w = spark.createDataFrame([("x", k, 1 / 3) for k in range(3)], "ali string, k int, w double")
    assert {r.i: r.is_match for r in alignments.match_by_gaps(c, w, DNA, 50.0).collect()} == {0: True, 1: False, 2: True}
    assert {r.i: r.is_match for r in alignments.match_by_gaps(c, w, DNA, 0.3).collect()} == {0: True, 1: True, 2: True}


def test_position_weights_share_equal_columns(spark):
    c = alignments.mark_end_gaps(cells(spark, ["ACGTACGTACGT", "ACGTACGTACGA", "CCGTTCGTACGA"]), DNA)
    w, n = alignments.position_weights(c, DNA)
    by = {}
    for r in w.collect():
        by.setdefault(r.i, {})[r.k] = round(r.w, 12)
    assert len({tuple(sorted(x.items())) for x in by.values()}) == 1 and sum(by[0].values()) == pytest.approx(1)
    assert by[0][2] > by[0][0] and n.select("neff").distinct().count() == 1


def test_merge_keeps_repeats_of_the_new_rows(spark):
    m = spark.createDataFrame([("x", 0, "a"), ("x", 1, "b")], "ali string, k long, header string")
    o = spark.createDataFrame([("x", 0, "b"), ("x", 1, "c"), ("x", 2, "c")], "ali string, k long, header string")
    assert [(r.k, r.header) for r in alignments.merged(m, o).orderBy("k").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "c")]


def test_alignment_from_hits(spark):
    rows = [("q", 5, "ACGTA", 1, [(2, "C-G", "CTA")])]
    h = spark.createDataFrame(rows, "query_id string, query_length int, query_seq string, oid int, hsps array<struct<q_start:int,q_seq:string,s_seq:string>>")
    got = alignments.from_hits(h).orderBy("k", "i").collect()
    assert "".join(r.chr for r in got if r.k == 0) == "ACGTA" and "".join(r.chr for r in got if r.k == 1) == "-CA--"


def test_tamura_nei_and_matches(spark):
    q = {(r.a, r.b): r.q for r in profiles.tamura_nei(spark, purines=2.0, pyrimidines=2.0).collect()}
    assert sum(q.values()) == pytest.approx(1) and q[0, 2] == pytest.approx(q[2, 0]) and q[0, 2] > q[0, 1]
    m, b = profiles.from_joint(profiles.match_mismatch(spark, DNA, 1.0, -1.0))
    s = {(r.a, r.b): r.s for r in m.collect()}
    assert s[0, 0] - s[0, 1] == pytest.approx(2.0) and {round(r.p, 9) for r in b.collect()} == {0.25}


def test_prefix_filter_is_a_cut(spark):
    h = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 5.0), ("q", 3, 0.2)], "q string, oid int, evalue double")
    assert [r.oid for r in ranking.prefix_filter(h, 1.0, ["q"], ["oid"]).collect()] == [1]
    n = h.withColumn("hsps", F.expr("array(named_struct('evalue', 0.1D), named_struct('evalue', 9.0D), named_struct('evalue', 0.1D))"))
    assert [len(r.hsps) for r in ranking.prefix_filter_nested(n, 1.0, ["q"], ["oid"]).collect()] == [1]


def test_relations(spark):
    r = spark.range(1).select(ranking.relation(F.lit("a.1.2.3"), F.lit("a.1.9.3")).alias("r")).first().r
    assert r == 2
    k = spark.createDataFrame([(5,), (3,), (2,), (1,)], "r int").select(ranking.classified(F.col("r")).alias("c"))
    assert [x.c for x in k.collect()] == [None, "TP", None, "FP"]


def test_target_neff(spark):
    rng = np.random.default_rng(0)
    f, pc = [], []
    for n in range(3):
        for pos in range(5):
            f += [(n, pos, a, float(a == pos % 4)) for a in range(4)]
            pc += [(n, pos, a, float(x)) for a, x in enumerate(rng.dirichlet(np.ones(4) * 5))]
    out = contexts.admix_to_neff(spark.createDataFrame(f, "id int, pos int, a int, f double"), spark.createDataFrame(pc, "id int, pos int, a int, p double"), 2.0)
    rows = out.collect()
    assert len(rows) == 3 and all(abs(r.neff - 2.0) <= 0.025 for r in rows)
    far = contexts.admix_to_neff(spark.createDataFrame(f, "id int, pos int, a int, f double"), spark.createDataFrame(pc, "id int, pos int, a int, p double"), 50.0)
    assert {r.tau for r in far.collect()} == {1.0}


def test_dense_posteriors_equal_joins(spark):
    from strandline.plans import inputs

    e = spark.createDataFrame([(1, p, a) for p, a in enumerate([0, 3, 1, 4, 5, 2])], "id int, pos int, a int")
    joined = contexts.posteriors(contexts.scores(e, inputs.model(spark), inputs.weights(spark), inputs.WIDTH), inputs.states(spark))
    dense = contexts.posteriors_dense(e, [(k, j, a, float(np.log(p))) for k, j, a, p in inputs.MODEL], inputs.PRIOR, inputs.WJ, inputs.SIZE, top=3)
    a = {(r.pos, r.k): r.pp for r in joined.collect()}
    b = {(r.pos, r.k): r.pp for r in dense.collect()}
    assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x]) for x in a)


def test_em_does_not_fall(spark):
    from strandline.plans import inputs

    rng = np.random.default_rng(1)
    rows = [(w, j, int(rng.integers(5)), 1.0) for w in range(60) for j in range(3)]
    w = spark.createDataFrame(rows, "wid int, j int, a int, v double")
    _, prior, lls = learning.em(w, inputs.model(spark).select("k", "j", "a", "p"), inputs.states(spark), inputs.background(spark), inputs.weights(spark), pca=1e-6, most=4)
    assert all(b >= a - 1e-6 for a, b in zip(lls, lls[1:], strict=False)) and sum(r.prior for r in prior.collect()) == pytest.approx(1)


def test_gradient_is_the_slope(spark):
    rng = np.random.default_rng(2)
    m, bg = learning.Crf.gaussian(3, 3, 4, 0.5), np.full(4, 0.25)
    x, y = rng.integers(0, 5, (6, 3)), rng.dirichlet(np.ones(4), 6)
    _, g = learning.crf_batch(m, x, y, bg)
    v = m.vector()
    for i in range(0, len(v), 5):
        d = np.zeros(len(v))
        d[i] = 1e-6
        up, down = (learning.crf_batch(m.with_vector(v + s * d), x, y, bg)[0] for s in (1, -1))
        assert (up - down) / 2e-6 == pytest.approx(g[i], abs=1e-5)
    train = spark.createDataFrame([(r.tolist(), t.tolist()) for r, t in zip(x, y, strict=True)], "x array<int>, y array<double>")
    ll, dist = learning.crf_gradient(train, m, bg)
    assert np.allclose(dist, g) and ll == pytest.approx(learning.crf_batch(m, x, y, bg)[0])


@pytest.mark.parametrize("kind", ["gauss", "lasso", "unsymmetric"])
def test_prior_gradient(kind):
    m = learning.Crf.gaussian(2, 3, 4, 0.5, seed=3)
    p = learning.Prior(kind, penalty=0.1)
    v, g = m.vector(), p(m)[1]
    k, w, a = m.cw.shape
    free = [i for i in range(len(v)) if not (k + a <= i < k + 2 * a or k + w * a + a <= i < k + w * a + 2 * a)]  # not the central column: its coupling is left out
    for i in free[::3]:
        d = np.zeros(len(v))
        d[i] = 1e-6
        assert (p(m.with_vector(v + d))[0] - p(m.with_vector(v - d))[0]) / 2e-6 == pytest.approx(g[i], abs=1e-4)


def test_sgd_learns_a_planted_rule(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in range(200):
        x = rng.integers(0, 4, 3)
        rows.append((n, x.tolist(), np.eye(4)[x[1]].tolist()))
    t = spark.createDataFrame(rows, "n int, x array<int>, y array<double>")
    bg = np.full(4, 0.25)
    m, lls = learning.sgd(t, t, learning.Crf.gaussian(4, 3, 4, 0.1, 5), bg, learning.Prior(sigma_context=5.0, sigma_pc_max=10.0), learning.SgdParams(blocks=2, eta=0.02, most_epochs=6), ["n"])
    assert lls[-1] > lls[0] and learning.crf_gradient(t, m, bg)[0] == pytest.approx(max(lls))


def test_hmm_against_all_paths(spark):
    rng = np.random.default_rng(6)
    h = hmm.Hmm(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2))
    x = [0, 2, 3, 1]
    total, at = 0.0, np.zeros((4, 2))
    e = np.concatenate([h.emit, np.ones((2, 1))], 1)
    for path in itertools.product(range(2), repeat=4):
        p = h.start[path[0]] * e[path[0], x[0]]
        for i in range(1, 4):
            p *= h.move[path[i - 1], path[i]] * e[path[i], x[i]]
        total += p
        for i, s in enumerate(path):
            at[i, s] += p
    c = spark.createDataFrame([(1, p, a) for p, a in enumerate(x)], "id int, pos int, a int")
    rows = hmm.state_posteriors(c, h).collect()
    assert all(r.pp == pytest.approx(at[r.pos, r.k] / total) and r.ll == pytest.approx(np.log2(total)) for r in rows)
    _, lls = hmm.baum_welch(c, h, most=4, tolerance=0)
    assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:], strict=False))


def test_map_and_search():
    rng = np.random.default_rng(7)
    lib = rng.dirichlet(np.ones(4), (5, 3))
    cells_ = learning.som(lib, np.full(5, 0.2), np.full(4, 0.25), 2, 200)
    assert cells_.shape == (8, 3, 4) and np.allclose(cells_.sum(2), 1)
    best, top = learning.coordinate_search(lambda p: -((p["x"] - 3) ** 2) - (p["y"] - 2) ** 2, {"x": 0.0, "y": 1.0}, {"x": ("add", 0.7), "y": ("mult", 1.3)})
    assert best["x"] == pytest.approx(3, abs=0.05) and top > -0.1


def test_windows_and_samples(spark):
    c = spark.createDataFrame([(1, p, p % 3) for p in (0, 1, 2, 3, 7, 8, 9)], "id int, pos int, a int")
    assert [(r.start, r.letters) for r in sequences.full_windows(c, 3, ["id"]).orderBy("start").collect()] == [(0, [0, 1, 2]), (1, [1, 2, 0]), (7, [1, 2, 0])]
    w = spark.createDataFrame([(i, s) for i in range(3) for s in range(10 * (i + 1))], "id int, start int")
    n = {r.id: r["count"] for r in sequences.proportional_sample(w, 25, 20, ["id"], "start").groupBy("id").count().collect()}
    assert n == {0: 5, 1: 10, 2: 10}
    y = spark.createDataFrame([(1, a, v) for a, v in enumerate((0.2, 0.4, 0.4))], "id int, a int, y double")
    assert {r.a: r.y for r in sequences.one_hot_central(y, ["id"]).collect()} == {0: 0, 1: 1, 2: 0}


def test_crf_shrinks_by_bias():
    m = learning.Crf.gaussian(4, 1, 2)
    m.bias = np.array([0.1, 0.5, 0.3, 0.4])
    assert m.shrunk(2).bias.tolist() == [0.5, 0.4] and m.distance(m) == 0


def test_block_em_stream(spark, tmp_path):
    from strandline.plans import inputs

    rows = [(w, j, (w + j) % 5, 1.0) for w in range(20) for j in range(3)]
    spark.createDataFrame(rows, "wid int, j int, a int, v double").write.parquet(str(tmp_path / "in"))
    em = blocks.BlockEm(inputs.model(spark).select("k", "j", "a", "p"), inputs.states(spark), inputs.background(spark), inputs.weights(spark))
    stream = spark.readStream.schema("wid int, j int, a int, v double").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(em).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(em.lls) == 1 and sum(r.prior for r in em.prior.collect()) == pytest.approx(1)
    em(spark.createDataFrame(rows, "wid int, j int, a int, v double"), 0)  # a repeated batch
    assert len(em.lls) == 1


def test_kimura_follows_the_table(spark):
    """Formula, table and what is beyond: values of the published table."""
    p = [0.0, 0.5, 0.749, 0.75, 0.803, 0.86, 0.929, 0.93, 0.931, 1.0]
    want = [0.0, 0.798508, 1.974723, 1.95, 2.5, 3.54, 9.45, 9.88, 10.0, 10.0]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = [r.d for r in df.select("p", sequences.kimura(F.col("p")).alias("d")).orderBy("p").collect()]
    assert got == pytest.approx(want, abs=2e-3) and len(sequences.PAMS) == 181
    cells = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 4), (0, 0, 1, 4), (0, 1, 1, 1)], "ali int, i int, k int, a int")
    assert [tuple(r) for r in sequences.kimura_distances(cells, 4).collect()] == [(0, 0, 1, 10.0)]


def test_kimura_of_repeated_rows_gaps_and_nulls_counts_cells(spark):
    """Cells of one row twice count twice, gaps and null columns do not, and rows without a letter have a distance of 10."""
    cells = [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 0, 1), (0, 1, 0, 1), (0, 1, 1, 3), (0, 2, 0, 5), (0, 2, None, 1), (0, None, 0, 1), (None, 0, 0, 1), (1, 0, 0, 1)]
    got = sequences.aligned_differences(spark.createDataFrame([(0, 0, [0, 1, 0], [1, 2, 1]), (0, 1, [0, 1], [1, 3])], "ali int, k long, i array<long>, a array<int>"), 4)
    assert [tuple(r) for r in got.collect()] == [(0, 0, 1, 1 / 3)]
    d = sequences.kimura_distances(spark.createDataFrame(cells, "ali int, k long, i int, a int"), 4).collect()
    assert sorted((r.ali, r.x, r.y, round(r.d, 6)) for r in d) == [(0, 0, 1, 0.439367), (0, 0, 2, 10.0), (0, 1, 2, 10.0)]


def test_repeat_sums_of_long_and_sparse_sequences_equal_the_scores_of_pairs(spark):
    import random

    from strandline.operators import sequences

    r = random.Random(4)
    rows = [(u, p, k, r.random()) for u in ("a", "b") for p in sorted(r.sample(range(20000), 400)) for k in range(3) if r.random() < 0.7]
    pp, prior = spark.createDataFrame(rows, "id string, pos int, k int, pp double"), spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "k int, prior double")
    want = {(x.id, x.pos): x.scale for x in sequences.repeat_penalty(sequences.repeat_scores(pp, prior)).collect()}
    got = {(x.id, x.pos): x.scale for x in sequences.repeat_scale(sequences.repeat_sums(pp, prior)).collect()}
    assert got.keys() == want.keys() and len(got) > 300 and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
