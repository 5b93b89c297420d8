"""Queries over models: conversion, EM, conditional models, maps, chains, translation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contexts, hmm, learning, profiles, sequences
from .catalog import query
from .inputs import BACKGROUND, CENTRAL, EVENTS, MODEL, MODEL_SQL, PREDICTED, PRIOR, SCORES, SIZE, STATES, WIDTH, WJ, background, central, event_cells, model, r6, states, values, weights

_C = (WIDTH - 1) // 2
FIVES = f"{EVENTS}, {MODEL_SQL}, win AS (SELECT c.id, c.pos, wj.j, x.a FROM ev c JOIN wj ON true JOIN ev x ON x.id = c.id AND x.pos = c.pos + wj.j - {_C})"
EM = FIVES + f""", es AS (SELECT win.id, win.pos, m.k, sum((ln(m.p) - ln(bg.p)) * w) AS s FROM win JOIN model m ON m.j = win.j AND m.a = win.a JOIN wj ON wj.j = win.j JOIN bg ON bg.a = win.a GROUP BY 1, 2, 3),
ef AS (SELECT id, pos, es.k, s + ln(prior) AS s FROM es JOIN state ON state.k = es.k), em AS (SELECT id, pos, max(s) AS m FROM ef GROUP BY id, pos),
el AS (SELECT ef.id, ef.pos, m + ln(sum(exp(s - m))) AS lse FROM ef JOIN em ON em.id = ef.id AND em.pos = ef.pos GROUP BY ef.id, ef.pos, m),
ep AS (SELECT ef.id, ef.pos, ef.k, exp(s - lse) AS pp FROM ef JOIN el ON el.id = ef.id AND el.pos = ef.pos),
st AS (SELECT ep.k, win.j, win.a, sum(pp) AS n FROM ep JOIN win ON win.id = ep.id AND win.pos = ep.pos GROUP BY 1, 2, 3),
nm AS (SELECT m.k, m.j, m.a, 0.01::DOUBLE * bg.p + coalesce(n, 0) AS p FROM model m JOIN bg ON bg.a = m.a LEFT JOIN st ON st.k = m.k AND st.j = m.j AND st.a = m.a)"""


def _windows(spark, sf_dir):
    w = contexts.windows(event_cells(spark, sf_dir), WIDTH)
    return w.select(F.struct("id", "pos").alias("wid"), "j", "a", F.lit(1.0).alias("v"))


def _em(spark, sf_dir):
    return learning.em_step(_windows(spark, sf_dir), model(spark).select("k", "j", "a", "p"), states(spark), background(spark), weights(spark))


@query(f"WITH {EM} SELECT k, j, a, round(p / sum(p) OVER (PARTITION BY k, j), 6) + 0 AS p FROM nm")
def em_step_model(spark, sf_dir):
    return _em(spark, sf_dir)[0].select("k", "j", "a", r6(F.col("p")).alias("p"))


@query(f"WITH {EM} SELECT k, round(sum(pp) / sum(sum(pp)) OVER (), 6) + 0 AS prior FROM ep GROUP BY k")
def em_step_prior(spark, sf_dir):
    return _em(spark, sf_dir)[1].select("k", r6(F.col("prior")).alias("prior"))


@query(f"WITH {EM} SELECT round(avg(lse) / (SELECT sum(w) FROM wj), 6) + 0 AS ll FROM el")
def em_step_likelihood(spark, sf_dir):
    return _em(spark, sf_dir)[2].select(r6(F.col("ll")).alias("ll"))


@query()
def em_fit(spark, sf_dir):
    """EM until its gain is at most the tolerance; the likelihood does not fall (tested)."""
    m, _, lls = learning.em(_windows(spark, sf_dir).checkpoint(), model(spark).select("k", "j", "a", "p"), states(spark), background(spark), weights(spark))
    return m.withColumn("ll", F.lit(float(lls[-1])))


@query(f"WITH {MODEL_SQL} SELECT m.k, m.j, m.a, round(w * ln(p), 6) + 0 AS w FROM model m JOIN wj ON wj.j = m.j")
def library_to_crf(spark, sf_dir):
    _, cw, _ = contexts.library_to_crf(states(spark), model(spark).select("k", "j", "a", "p"), central(spark), weights(spark))
    return cw.select("k", "j", "a", r6(F.col("w")).alias("w"))


def _crf_weights():
    return [(k, j, a, 0.1 * ((3 * k + 5 * j + 7 * a) % 11 - 5)) for k in range(STATES) for j in range(WIDTH) for a in range(SIZE)]


BIAS = [(k, 0.2 * k - 0.1) for k in range(STATES)]


@query(f"""WITH {MODEL_SQL}, {values('cw', 'k, j, a, w', _crf_weights())}, {values('bias', 'k, b', BIAS)}, l AS (SELECT k, cw.j, wj.w AS wj, ln(sum(exp(cw.w / wj.w))) AS lse FROM cw JOIN wj ON wj.j = cw.j GROUP BY 1, 2, 3),
e AS (SELECT bias.k, exp(b + d) AS e FROM bias JOIN (SELECT k, sum(wj * lse) AS d FROM l GROUP BY k) s ON s.k = bias.k) SELECT k, round(e / sum(e) OVER (), 6) + 0 AS prior FROM e""")
def crf_to_library_prior(spark, sf_dir):
    p, _ = contexts.crf_to_library(spark.createDataFrame(BIAS, "k int, bias double"), spark.createDataFrame(_crf_weights(), "k int, j int, a int, w double"), weights(spark))
    return p.select("k", r6(F.col("prior")).alias("prior"))


@query(f"""WITH {MODEL_SQL}, {values('cw', 'k, j, a, w', _crf_weights())} SELECT cw.k, cw.j, cw.a, round(exp(cw.w / wj.w) / sum(exp(cw.w / wj.w)) OVER (PARTITION BY cw.k, cw.j), 6) + 0 AS p FROM cw JOIN wj ON wj.j = cw.j""")
def crf_to_library_cells(spark, sf_dir):
    _, c = contexts.crf_to_library(spark.createDataFrame(BIAS, "k int, bias double"), spark.createDataFrame(_crf_weights(), "k int, j int, a int, w double"), weights(spark))
    return c.select("k", "j", "a", r6(F.col("p")).alias("p"))


EMIT = [(k, a, w) for k, j, a, w in _crf_weights() if j == _C]


@query(f"WITH {values('e', 'k, a, w', EMIT)} SELECT k, a, round(exp(w) / sum(exp(w)) OVER (PARTITION BY k), 6) + 0 AS p FROM e")
def crf_softmax(spark, sf_dir):
    return contexts.softmax_columns(spark.createDataFrame(EMIT, "k int, a int, w double")).select("k", "a", r6(F.col("p")).alias("p"))


TARGET = PREDICTED + ", y AS (SELECT x.id, x.pos, x.a FROM ev x)"


def _targets(spark, sf_dir):
    return event_cells(spark, sf_dir).withColumn("y", F.lit(1.0))


@query(f"WITH {TARGET} SELECT round(sum(ln(pc.p) - ln(bg.p)), 3) + 0 AS ll FROM y JOIN pc ON pc.id = y.id AND pc.pos = y.pos AND pc.a = y.a JOIN bg ON bg.a = y.a")
def crf_likelihood(spark, sf_dir):
    pp = contexts.posteriors(contexts.scores(event_cells(spark, sf_dir), model(spark), weights(spark), WIDTH), states(spark))
    return learning.likelihood_terms(pp, central(spark), _targets(spark, sf_dir), background(spark)).select((F.round("ll", 3) + F.lit(0.0)).alias("ll"))


FIT = TARGET + f", fit AS (SELECT pp.id, pp.pos, pp.k, pp.pp * (m.p / pc.p - 1) AS g FROM pp JOIN y ON y.id = pp.id AND y.pos = pp.pos JOIN pc ON pc.id = y.id AND pc.pos = y.pos AND pc.a = y.a JOIN model m ON m.k = pp.k AND m.j = {_C} AND m.a = y.a)"


def _fit(spark, sf_dir):
    pp = contexts.posteriors(contexts.scores(event_cells(spark, sf_dir), model(spark), weights(spark), WIDTH), states(spark))
    return learning.fit_terms(pp, central(spark), _targets(spark, sf_dir))


@query(f"WITH {FIT} SELECT k, round(sum(g), 3) + 0 AS g FROM fit GROUP BY k")
def crf_bias_gradient(spark, sf_dir):
    return learning.bias_gradient(_fit(spark, sf_dir)).select("k", (F.round("g", 3) + F.lit(0.0)).alias("g"))


@query(f"WITH {FIT} SELECT fit.k, win.j, win.a, round(sum(g), 3) + 0 AS g FROM fit JOIN win ON win.id = fit.id AND win.pos = fit.pos GROUP BY 1, 2, 3")
def crf_context_gradient(spark, sf_dir):
    g = learning.context_gradient(_fit(spark, sf_dir), event_cells(spark, sf_dir), WIDTH, SIZE)
    return g.select("k", "j", "a", (F.round("g", 3) + F.lit(0.0)).alias("g"))


def _training(spark, sf_dir):
    """Windows of three events and the type of the event that follows."""
    w = sequences.full_windows(event_cells(spark, sf_dir), WIDTH + 1, ["id"])
    y = F.element_at("letters", WIDTH + 1)
    return w.select("id", "start", F.slice("letters", 1, WIDTH).alias("x"), F.array(*[F.when(y == a, F.lit(1.0)).otherwise(F.lit(0.0)) for a in range(SIZE)]).alias("y"))


def _parts(training):
    """(rows to learn from, rows to validate on): a tenth of the users, by hash, is for validation."""
    held = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    return training.filter(~held), training.filter(held)


@query()
def sgd_fit(spark, sf_dir):
    """Block-wise ascent until the likelihood of other users' windows calms down; that likelihood by epoch."""
    t, v = _parts(_training(spark, sf_dir).checkpoint())
    _, lls = learning.sgd(t, v, learning.Crf.gaussian(STATES, WIDTH, SIZE), np.array(BACKGROUND), learning.Prior(), learning.SgdParams(), ["id", "start"])
    return spark.createDataFrame(list(enumerate(map(float, lls))), "epoch int, ll double")


@query()
def hmc_sample(spark, sf_dir):
    """All steps and leapfrogs of two replicas; a job each, so it takes long (see README)."""
    t = _training(spark, sf_dir).checkpoint()
    _, lls = learning.hmc(t, learning.Crf.gaussian(STATES, WIDTH, SIZE), np.array(BACKGROUND), learning.Prior(), learning.HmcParams(), replicas=2)
    return spark.createDataFrame(list(enumerate(map(float, lls))), "step int, ll double")


def _chain():
    move = np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.2, 0.7]])
    emit = np.array([[p for k, _, p in CENTRAL if k == s] for s in range(STATES)])
    return hmm.Hmm(np.array(PRIOR), move, emit)


@query()
def hmm_posteriors(spark, sf_dir):
    """Forward and backward passes over every user's events, tested against sums over all paths."""
    return hmm.state_posteriors(event_cells(spark, sf_dir), _chain())


@query()
def hmm_baum_welch(spark, sf_dir):
    h, lls = hmm.baum_welch(event_cells(spark, sf_dir), _chain())
    return spark.createDataFrame([(i, j, float(h.move[i, j]), float(lls[-1])) for i in range(STATES) for j in range(STATES)], "src int, dst int, w double, ll double")


@query(f"WITH {SCORES}, b AS (SELECT id, pos, k FROM (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY pp DESC, k) AS r FROM pp) WHERE r = 1), n AS (SELECT x.k AS src, y.k AS dst, count(*) AS n FROM b x JOIN b y ON y.id = x.id AND y.pos = x.pos + 1 GROUP BY 1, 2) SELECT src, dst, round(n::DOUBLE / sum(n) OVER (PARTITION BY src), 6) + 0 AS w FROM n")
def state_transitions(spark, sf_dir):
    pp = contexts.posteriors(contexts.scores(event_cells(spark, sf_dir), model(spark), weights(spark), WIDTH), states(spark))
    return hmm.transitions(contexts.best_state(pp)).select("src", "dst", r6(F.col("w")).alias("w"))


@query(f"WITH {SCORES}, b AS (SELECT id, pos, k FROM (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY pp DESC, k) AS r FROM pp) WHERE r = 1) SELECT id, string_agg(k::VARCHAR, '' ORDER BY pos) AS states FROM b GROUP BY id")
def translate_states(spark, sf_dir):
    pp = contexts.posteriors(contexts.scores(event_cells(spark, sf_dir), model(spark), weights(spark), WIDTH), states(spark))
    s = F.sort_array(F.collect_list(F.struct("pos", F.col("k").cast("string").alias("k"))))
    return contexts.best_state(pp).groupBy("id").agg(F.array_join(F.transform(s, lambda x: x["k"]), "").alias("states"))


@query(f"WITH {MODEL_SQL}, s AS (SELECT x.k, y.k AS l, x.j, sum(x.p * y.p / bg.p) AS s FROM model x JOIN model y ON y.j = x.j AND y.a = x.a JOIN bg ON bg.a = x.a GROUP BY 1, 2, 3) SELECT k, l, round(sum(w * ln(s)), 6) + 0 AS score FROM s JOIN wj ON wj.j = s.j GROUP BY k, l")
def co_emission(spark, sf_dir):
    m = model(spark).select("k", "j", "a", "p")
    return profiles.co_emission(m, m.select(F.col("k").alias("l"), "j", "a", F.col("p").alias("q")), background(spark), WJ).select("k", "l", r6(F.col("score")).alias("score"))


@query()
def som_colors(spark, sf_dir):
    """A map of eight cells over the model and the colour of each state's cell."""
    lib = np.zeros((STATES, WIDTH, SIZE))
    for k, j, a, p in MODEL:
        lib[k, j, a] = p
    cells = learning.som(lib, np.array(PRIOR), np.array(BACKGROUND), 2, 500)
    rows = [(c, j, a, float(cells[c, j, a])) for c in range(8) for j in range(WIDTH) for a in range(SIZE)]
    best = learning.best_match(profiles.co_emission(model(spark).select("k", "j", "a", "p"), spark.createDataFrame(rows, "l int, j int, a int, q double"), background(spark), WJ))
    return learning.lattice_colours(best, 2)


@query(f"WITH {MODEL_SQL}, h AS (SELECT k, -sum(p * log2(p)) AS h FROM model WHERE j = {_C} GROUP BY k) SELECT k, round(h, 6) + 0 AS h, row_number() OVER (ORDER BY h, k) AS rank FROM h")
def library_by_entropy(spark, sf_dir):
    return profiles.by_entropy(model(spark), _C).select("k", r6(F.col("h")).alias("h"), "rank")


@query(f"WITH {MODEL_SQL} SELECT k, prior FROM state ORDER BY prior DESC LIMIT 2")
def library_top_states(spark, sf_dir):
    return profiles.chosen_states(states(spark), None, "prior", 2).select("k", "prior")


@query(f"WITH {EVENTS}, n AS (SELECT a, lead(a) OVER (PARTITION BY id ORDER BY pos) AS b FROM ev) SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY a, b")
def successor_counts(spark, sf_dir):
    c = event_cells(spark, sf_dir).withColumn("b", F.lead("a").over(Window.partitionBy("id").orderBy("pos"))).filter("b is not null")
    return c.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
