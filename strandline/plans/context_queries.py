"""Queries over context windows: posteriors, pseudocounts, admixture, windows, samples, distances."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import contexts, sequences
from .catalog import query
from .inputs import BACKGROUND, CELLS, EVENTS, MODEL, MODEL_SQL, PREDICTED, PRIOR, SCORES, SIZE, WIDTH, WJ, background, central, embedding_rows, event_cells, model, r6, states, table, weights


def _scores(spark, sf_dir, bg=False):
    return contexts.scores(event_cells(spark, sf_dir), model(spark), weights(spark), WIDTH, background=background(spark) if bg else None)


def _pp(spark, sf_dir):
    return contexts.posteriors(_scores(spark, sf_dir), states(spark))


def _pc(spark, sf_dir):
    return contexts.predicted(_pp(spark, sf_dir), central(spark))


@query(f"WITH {SCORES} SELECT id, pos, k, round(s, 6) + 0 AS score FROM score")
def ctx_emission(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", "pos", "k", r6(F.col("score")).alias("score"))


@query(f"WITH {SCORES} SELECT win.id, win.pos, m.k, round(sum((ln(m.p) - ln(bg.p)) * wj.w), 6) + 0 AS score FROM win JOIN model m ON m.j = win.j AND m.a = win.a JOIN wj ON wj.j = win.j JOIN bg ON bg.a = win.a GROUP BY win.id, win.pos, m.k")
def ctx_emission_background(spark, sf_dir):
    return _scores(spark, sf_dir, True).select("id", "pos", "k", r6(F.col("score")).alias("score"))


@query(f"WITH {SCORES} SELECT id, pos, k, round(pp, 6) + 0 AS pp FROM pp")
def ctx_posterior(spark, sf_dir):
    return _pp(spark, sf_dir).select("id", "pos", "k", r6(F.col("pp")).alias("pp"))


@query(f"WITH {SCORES} SELECT id, pos, k, round(pp, 6) + 0 AS pp FROM pp")
def ctx_posterior_dense(spark, sf_dir):
    """The same by matrix products, the form for models of thousands of states; any letter adds nothing to a score."""
    rows = [(k, j, a, math.log(p)) for k, j, a, p in MODEL]
    pp = contexts.posteriors_dense(event_cells(spark, sf_dir), rows, PRIOR, WJ, SIZE, top=len(PRIOR))
    return pp.select("id", "pos", "k", r6(F.col("pp")).alias("pp"))


@query(f"WITH {SCORES} SELECT id, pos, k, round(pp, 6) + 0 AS pp, CASE WHEN pp > 0.8::DOUBLE THEN '|' WHEN pp > 0.6::DOUBLE THEN '+' WHEN pp > 0.4::DOUBLE THEN '.' WHEN pp > 0.2::DOUBLE THEN '-' ELSE '=' END AS mark FROM (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY pp DESC, k) AS r FROM pp) WHERE r = 1")
def ctx_argmax_state(spark, sf_dir):
    return contexts.best_state(_pp(spark, sf_dir)).select("id", "pos", "k", r6(F.col("pp")).alias("pp"), scalars.match_symbol(F.col("pp")).alias("mark"))


@query(f"WITH {PREDICTED} SELECT id, pos, a, round(p, 6) + 0 AS p FROM pc")
def ctx_predicted(spark, sf_dir):
    return _pc(spark, sf_dir).select("id", "pos", "a", r6(F.col("p")).alias("p"))


@query(f"WITH {PREDICTED}, mixed AS (SELECT pc.id, pc.pos, pc.a, 0.9::DOUBLE * p + CASE WHEN pc.a = ev.a THEN 1 - 0.9::DOUBLE ELSE 0 END AS p FROM pc JOIN ev ON ev.id = pc.id AND ev.pos = pc.pos) SELECT id, pos, a, round(p / sum(p) OVER (PARTITION BY id, pos), 6) + 0 AS p FROM mixed")
def ctx_pseudocount_profile(spark, sf_dir):
    out = contexts.admixed_sequence(event_cells(spark, sf_dir), _pc(spark, sf_dir), contexts.constant(0.9), SIZE)
    return out.select("id", "pos", "a", r6(F.col("p")).alias("p"))


@query(f"WITH {PREDICTED}, mixed AS (SELECT pc.id, pc.pos, pc.a, 0.9::DOUBLE * p + CASE WHEN pc.a = ev.a THEN 1 - 0.9::DOUBLE ELSE 0 END AS p FROM pc JOIN ev ON ev.id = pc.id AND ev.pos = pc.pos) SELECT id, pos, a, round(p / sum(p) OVER (PARTITION BY id, pos) * pow(2::DOUBLE, -0.005::DOUBLE), 6) + 0 AS p FROM mixed")
def profile_shift_pssm(spark, sf_dir):
    out = contexts.admixed_sequence(event_cells(spark, sf_dir), _pc(spark, sf_dir), contexts.constant(0.9), SIZE)
    return out.select("id", "pos", "a", r6(scalars.shifted(F.col("p"), -0.005)).alias("p"))


BG_VALUES = MODEL_SQL[MODEL_SQL.index("bg(") :]


@query(f"WITH {PREDICTED} SELECT pc.id, pc.pos, pc.a, floor(1000::DOUBLE * ln(pc.p / bg.p) + 0.5::DOUBLE)::BIGINT AS s FROM pc JOIN bg ON bg.a = pc.a")
def pssm_log_odds(spark, sf_dir):
    pc = _pc(spark, sf_dir).join(background(spark).withColumnRenamed("p", "bg"), "a")
    return pc.select("id", "pos", "a", scalars.iround(F.lit(1000.0) * scalars.log_odds(F.col("p"), F.col("bg"))).cast("long").alias("s"))


ADMIX = EVENTS + """, cnt AS (SELECT id, pos, a, 4::DOUBLE AS v FROM ev)"""


def _admix_sql(tau: str) -> str:
    return f"WITH {PREDICTED}, mixed AS (SELECT pc.id, pc.pos, pc.a, ({tau}) * p + (1 - ({tau})) * CASE WHEN pc.a = ev.a THEN 1 ELSE 0 END AS p FROM pc JOIN ev ON ev.id = pc.id AND ev.pos = pc.pos) SELECT id, pos, a, round(p / sum(p) OVER (PARTITION BY id, pos), 6) + 0 AS p FROM mixed"


def _admixed(spark, sf_dir, tau):
    e = event_cells(spark, sf_dir)
    counts, columns = e.withColumn("v", F.lit(4.0)), e.select("id", "pos", F.lit(4.0).alias("neff"))
    return contexts.admixed_profile(counts, columns, _pc(spark, sf_dir), tau).select("id", "pos", "a", r6(F.col("p")).alias("p"))


@query(_admix_sql("least(1::DOUBLE, 0.9::DOUBLE * 13 / (12::DOUBLE + 4))"))
def admix_decreasing(spark, sf_dir):
    return _admixed(spark, sf_dir, contexts.decreasing(0.9, 12.0))


@query(_admix_sql("least(1::DOUBLE, 0.9::DOUBLE / (1 + pow(4::DOUBLE / 12, 1.5::DOUBLE)))"))
def admix_hhsearch(spark, sf_dir):
    return _admixed(spark, sf_dir, contexts.hyperbolic(0.9, 12.0, 1.5))


@query()
def admix_target_neff(spark, sf_dir):
    """Bisection, tested against a brute-force one."""
    e = event_cells(spark, sf_dir).withColumn("f", F.lit(1.0))
    return contexts.admix_to_neff(e, _pc(spark, sf_dir), 2.0)


@query(f"WITH {EVENTS}, w AS (SELECT id, pos AS start, list(a) OVER x AS letters, count(*) OVER x AS n FROM ev WINDOW x AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT id, start, array_to_string(letters, ',') AS letters FROM w WHERE n = 7")
def train_windows(spark, sf_dir):
    w = sequences.full_windows(event_cells(spark, sf_dir), 7, ["id"])
    return w.select("id", "start", F.array_join("letters", ",").alias("letters"))


@query(f"WITH {EVENTS}, w AS (SELECT id, pos AS start, count(*) OVER x AS n, max(CASE WHEN a = 1 THEN 1 ELSE 0 END) OVER x AS bad FROM ev WINDOW x AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)), v AS (SELECT id, start FROM w WHERE n = 7 AND bad = 0), s AS (SELECT t.id, coalesce(u, 0)::DOUBLE / n AS s FROM (SELECT id, count(*) AS n FROM ev GROUP BY id) t LEFT JOIN (SELECT id, count(*) AS u FROM v GROUP BY id) y ON y.id = t.id) SELECT round(avg(s), 6) + 0 AS mean, round(stddev_pop(s), 6) + 0 AS sd, min(s) AS least, max(s) AS most FROM s")
def train_stats(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    w = sequences.full_windows(e, 7, ["id"], bad=F.col("a") == 1)
    s = sequences.used_share(e.withColumnRenamed("pos", "i"), w.withColumnRenamed("start", "i"))
    return s.select(r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"), "least", "most")


@query()
def train_sample(spark, sf_dir):
    """A proportional sample of windows by hash rank; tested by its quotas."""
    w = sequences.full_windows(event_cells(spark, sf_dir), 7, ["id"])
    return sequences.proportional_sample(w, 1000, 20, ["id"], "start").select("id", "start")


@query("""WITH h AS (SELECT user_id AS id, CAST(date_part('hour', ts) AS INT) // 6 AS round, count(DISTINCT event_type)::DOUBLE AS neff FROM events GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round) AS r FROM h WHERE neff BETWEEN 2 AND 4) SELECT id, round, neff FROM f WHERE r = 1""")
def first_qualifying_round(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.floor(F.hour("ts") / 6).cast("int").alias("round"), "event_type")
    h = e.groupBy("id", "round").agg(F.countDistinct("event_type").cast("double").alias("neff"))
    return sequences.first_round(sequences.in_range(h, "neff", 2, 4))


@query("""WITH h AS (SELECT user_id AS id, CAST(date_part('hour', ts) AS INT) // 6 AS round, count(DISTINCT event_type)::DOUBLE AS neff FROM events GROUP BY 1, 2)
SELECT x.id, x.round AS rx, y.round AS ry, y.neff - x.neff AS d FROM h x JOIN h y ON x.id = y.id WHERE y.neff - x.neff BETWEEN 1 AND 3""")
def neff_interval_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.floor(F.hour("ts") / 6).cast("int").alias("round"), "event_type")
    h = e.groupBy("id", "round").agg(F.countDistinct("event_type").cast("double").alias("neff"))
    return sequences.neff_pairs(h, h, 1, 3).select("id", "rx", "ry", (F.col("ny") - F.col("nx")).alias("d"))


@query("SELECT o_custkey AS id, bit_or((1 << CAST(date_part('month', o_orderdate) AS INT))::BIGINT) AS rounds, max(CAST(date_part('month', o_orderdate) AS INT)) AS last FROM orders GROUP BY 1")
def round_sets(spark, sf_dir):
    from ..sources.records import round_sets as grouped

    names = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("_"), F.month("o_orderdate").cast("string"), F.lit(".prf")).alias("name"))
    return grouped(names).select(F.col("id").cast("long").alias("id"), "rounds", "last")


SEQ = EVENTS + ", sq AS (SELECT id, string_agg(a::VARCHAR, '' ORDER BY pos) AS seq, count(*) AS l FROM ev GROUP BY id)"
K_MER = 4


@query(f"""WITH {SEQ}, km AS (SELECT id, substr(seq, p::INT, {K_MER}) AS kmer FROM sq, LATERAL (SELECT unnest(range(1, l - {K_MER} + 1)) AS p)), n AS (SELECT id, kmer, count(*) AS n FROM km GROUP BY id, kmer), t AS (SELECT id, sum(n) AS t FROM n GROUP BY id)
SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n))::BIGINT AS shared, round(1 - sum(least(x.n, y.n))::DOUBLE / least(max(tx.t), max(ty.t)), 6) + 0 AS distance FROM n x JOIN n y ON x.kmer = y.kmer AND x.id < y.id JOIN t tx ON tx.id = x.id JOIN t ty ON ty.id = y.id GROUP BY x.id, y.id""")
def kmer_distance(spark, sf_dir):
    s = F.sort_array(F.collect_list(F.struct("pos", F.col("a").cast("string").alias("c"))))
    seqs = event_cells(spark, sf_dir).groupBy("id").agg(F.array_join(F.transform(s, lambda x: x["c"]), "").alias("seq"))
    d = sequences.kmer_distances(sequences.kmer_counts(seqs, K_MER))
    return d.select("a", "b", "shared", r6(F.col("distance")).alias("distance"))


KIMURA = f""", q AS (SELECT x.ali, x.k AS x, y.k AS y FROM (SELECT DISTINCT ali, k FROM cells) x JOIN (SELECT DISTINCT ali, k FROM cells) y ON y.ali = x.ali AND x.k < y.k)
SELECT q.ali, q.x, q.y, round(CASE WHEN p IS NULL OR p > 0.93::DOUBLE THEN 10 WHEN p < 0.75::DOUBLE THEN -ln(1 - p - p * p / 5) ELSE list_extract({list(sequences.PAMS)}, floor((p - 0.75::DOUBLE) * 1000 + 0.5::DOUBLE)::INT + 1) / 100::DOUBLE END, 6) + 0 AS d FROM q LEFT JOIN p ON p.ali = q.ali AND p.x = q.x AND p.y = q.y"""


@query(f"""WITH {CELLS}, p AS (SELECT x.ali, x.k AS x, y.k AS y, sum(CASE WHEN x.a <> y.a THEN 1 ELSE 0 END)::DOUBLE / count(*) AS p FROM cells x JOIN cells y ON y.ali = x.ali AND y.i = x.i AND x.k < y.k WHERE x.a < 4 AND y.a < 4 GROUP BY 1, 2, 3)
{KIMURA}""")
def kimura_distance(spark, sf_dir):
    """Over rows of letters; which gaps are end gaps makes no difference to columns where both rows have a letter."""
    from ..functions.alphabets import DNA

    d = sequences.kimura_row_distances(embedding_rows(spark, sf_dir), DNA.size)
    return d.select("ali", "x", "y", r6(F.col("d")).alias("d"))


@query("""WITH p AS (SELECT l_orderkey % 1000 AS n, 0.7::DOUBLE + (l_orderkey % 1000)::DOUBLE / 4000::DOUBLE AS p FROM lineitem GROUP BY ALL)
SELECT n, round(CASE WHEN p < 0.75::DOUBLE THEN -ln(1 - p - p * p / 5) WHEN p > 0.93::DOUBLE THEN 10 ELSE list_extract(""" + str(list(sequences.PAMS)) + """, floor((p - 0.75::DOUBLE) * 1000 + 0.5::DOUBLE)::INT + 1) / 100::DOUBLE END, 6) + 0 AS d FROM p""")
def kimura_range(spark, sf_dir):
    """Distances of shares from 0.7 to 0.95: the formula, the table and what is beyond it."""
    n = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("n")).distinct()
    return n.select("n", r6(sequences.kimura(F.lit(0.7) + F.col("n").cast("double") / F.lit(4000.0))).alias("d"))


@query(f"""WITH {SCORES}, b AS (SELECT * FROM pp WHERE pp >= 0.5::DOUBLE), r AS (SELECT x.id, x.pos AS i, y.pos AS j, log2(sum(x.pp * y.pp / prior)) AS s FROM b x JOIN b y ON y.id = x.id AND y.k = x.k AND x.pos <> y.pos AND abs(x.pos - y.pos) <= 10 JOIN state ON state.k = x.k GROUP BY 1, 2, 3)
SELECT id, i AS pos, round(pow(2::DOUBLE, -(0 + 0.1::DOUBLE * sqrt(sum(s)))), 6) + 0 AS scale FROM r WHERE s >= 0 GROUP BY id, i""")
def repeat_penalty(spark, sf_dir):
    s = sequences.repeat_scores(_pp(spark, sf_dir), states(spark), 10, 0.5)
    return sequences.repeat_penalty(s).select("id", "pos", r6(F.col("scale")).alias("scale"))


@query(f"""WITH {SCORES}, b AS (SELECT * FROM pp WHERE pp >= 0.02::DOUBLE), r AS (SELECT x.id, x.pos AS i, y.pos AS j, log2(sum(x.pp * y.pp / prior)) AS s FROM b x JOIN b y ON y.id = x.id AND y.k = x.k AND x.pos <> y.pos AND abs(x.pos - y.pos) <= 100 JOIN state ON state.k = x.k GROUP BY 1, 2, 3)
SELECT id, i AS pos, round(pow(2::DOUBLE, -(0 + 0.1::DOUBLE * sqrt(sum(s)))), 6) + 0 AS scale FROM r WHERE s >= 0 GROUP BY id, i""")
def repeat_penalty_whole(spark, sf_dir):
    """repeat_penalty with the window and least posterior of the reference; its SQL states a narrow window."""
    s = sequences.repeat_sums(_pp(spark, sf_dir), states(spark))
    return sequences.repeat_scale(s).select("id", "pos", r6(F.col("scale")).alias("scale"))


@query(f"""WITH {SCORES}, {EVENTS.replace('ev AS', 'ev2 AS')}, pr AS (SELECT x.id, x.pos AS i, y.pos AS j FROM ev x JOIN ev y ON y.id = x.id AND y.pos = x.pos + 1)
SELECT pp.k, ev2.a AS s, round(sum(pp.pp), 5) + 0 AS n FROM pr JOIN pp ON pp.id = pr.id AND pp.pos = pr.i JOIN ev2 ON ev2.id = pr.id AND ev2.pos = pr.j GROUP BY 1, 2""")
def state_substitutions(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    n = F.lead("pos").over(Window.partitionBy("id").orderBy("pos"))
    pairs = e.select(F.col("id").cast("string").alias("query"), F.concat(F.col("id").cast("string"), F.lit("'")).alias("target"), F.col("pos").alias("i"), n.alias("j"), F.lit(1.0).alias("confidence")).filter("j is not null")
    targets = e.select(F.concat(F.col("id").cast("string"), F.lit("'")).alias("id"), "pos", F.col("a").alias("s"))
    out = sequences.state_substitutions(pairs, _pp(spark, sf_dir).withColumn("id", F.col("id").cast("string")), targets)
    return out.select("k", "s", (F.round("n", 5) + F.lit(0.0)).alias("n"))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY pp DESC, k) AS r FROM pp) SELECT id, pos, k, round(pp, 6) + 0 AS p FROM r WHERE r = 1 OR (pp >= 0.3::DOUBLE AND r <= 255)")
def sparse_columns(spark, sf_dir):
    s = sequences.sparse(_pp(spark, sf_dir).withColumnRenamed("pp", "p").withColumnRenamed("k", "a"), ["id", "pos"], 0.3)
    return s.select("id", "pos", F.col("a").alias("k"), r6(F.col("p")).alias("p"))


assert abs(sum(BACKGROUND) - 1) < 1e-9
