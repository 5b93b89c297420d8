"""Context states: window scores, posteriors, predicted columns, admixture and translation.

A model is three small tables: states (k, prior), cells (k, j, a, lp) with log probabilities, and
central columns (k, a, p). Windows are formed by an equi-join of cells with offsets (never a range
join): position pos meets window center pos - (j - c). Model tables are joined plainly; adaptive
execution broadcasts them when their measured size is small. `posteriors_dense` is the form for
models of thousands of states: windows as one-hot rows times the weight matrix, by Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import window_weights


def offsets(spark: SparkSession, width: int, center: float = 1.6, decay: float = 0.85) -> DataFrame:
    """j, w: window offsets with their weights."""
    return spark.createDataFrame(list(enumerate(window_weights(width, center, decay))), "j int, w double")


def windows(cells: DataFrame, width: int, keys: tuple[str, ...] = ("id",), pos: str = "pos") -> DataFrame:
    """keys, pos (window center), j, and the other columns of each cell in the window; the ends drop what is missing."""
    c = (width - 1) // 2
    own = cells.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    centers = cells.select(*keys, pos).distinct()
    out = own.withColumn(pos, F.col(pos) - F.col("_j") + F.lit(c)).withColumnRenamed("_j", "j")
    return out.join(centers, [*keys, pos], "left_semi")


def scores(cells: DataFrame, model: DataFrame, weights: DataFrame, width: int, keys: tuple[str, ...] = ("id",), value: str | None = None, background: DataFrame | None = None) -> DataFrame:
    """keys, pos, k, score: the weighted log probabilities of a window's letters (or counts) under each state.

    model: (k, j, a, lp); with background (a, p) its log is taken off. Windows reach the model by (j, a).
    """
    m = model
    if background is not None:
        m = m.join(background.select("a", F.ln("p").alias("lb")), "a").withColumn("lp", F.col("lp") - F.col("lb")).drop("lb")
    m = m.join(weights, "j").select("j", "a", "k", (F.col("lp") * F.col("w")).alias("s"))
    w = windows(cells, width, keys)
    term = F.col("s") if value is None else F.col("s") * F.col(value)
    return w.join(m, ["j", "a"]).groupBy(*keys, "pos", "k").agg(F.sum(term).alias("score"))


def posteriors(score: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, pos, k, pp: the stable softmax of score + ln prior over states."""
    w = Window.partitionBy(*keys, "pos")
    s = score.join(states.select("k", F.ln("prior").alias("lprior")), "k").withColumn("score", F.col("score") + F.col("lprior"))
    s = s.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    return s.select(*keys, "pos", "k", (F.col("_e") / F.sum("_e").over(w)).alias("pp"))


def log_evidence(score: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, pos, lse: the log of the summed exponentials."""
    s = score.join(states.select("k", F.ln("prior").alias("lprior")), "k").withColumn("score", F.col("score") + F.col("lprior"))
    m = s.groupBy(*keys, "pos").agg(F.max("score").alias("m"))
    return s.join(m, [*keys, "pos"]).groupBy(*keys, "pos", "m").agg((F.col("m") + F.ln(F.sum(F.exp(F.col("score") - F.col("m"))))).alias("lse")).drop("m")


def best_state(pp: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, pos, k, pp: the most likely state; ties go to the lowest."""
    x = pp.groupBy(*keys, "pos").agg(F.max(F.struct("pp", (-F.col("k")).alias("m"))).alias("x"))
    return x.select(*keys, "pos", (-F.col("x.m")).cast("int").alias("k"), F.col("x.pp").alias("pp"))


def predicted(pp: DataFrame, central: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, pos, a, p: the posterior mean of the states' central columns, normalised."""
    s = pp.join(central.select("k", "a", F.col("p").alias("pc")), "k").groupBy(*keys, "pos", "a").agg(F.sum(F.col("pp") * F.col("pc")).alias("p"))
    t = F.sum("p").over(Window.partitionBy(*keys, "pos"))
    return s.select(*keys, "pos", "a", (F.col("p") / t).alias("p"))


def constant(tau: float):
    return lambda neff: F.lit(float(tau))


def decreasing(a: float, b: float):
    """min(1, a (b + 1) / (b + neff))"""
    return lambda neff: F.least(F.lit(1.0), F.lit(float(a)) * F.lit(b + 1.0) / (F.lit(float(b)) + neff))


def hyperbolic(a: float, b: float, c: float):
    """min(1, a / (1 + (neff / b) ** c))"""
    return lambda neff: F.least(F.lit(1.0), F.lit(float(a)) / (F.lit(1.0) + F.pow(neff / F.lit(float(b)), F.lit(float(c)))))


def admixed_sequence(cells: DataFrame, pc: DataFrame, tau, size: int, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, pos, a, p: tau * predicted + (1 - tau) for the letter itself; any letter gets 0; columns sum to 1."""
    t = tau(F.lit(1.0))
    own = cells.select(*keys, "pos", F.col("a").alias("own"))
    mix = pc.join(own, [*keys, "pos"]).withColumn("p", t * F.col("p") + F.when(F.col("a") == F.col("own"), F.lit(1.0) - t).otherwise(F.lit(0.0))).filter(F.col("a") < size).drop("own")
    total = F.sum("p").over(Window.partitionBy(*keys, "pos"))
    return mix.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(F.lit(0.0)))


def admixed_profile(cells: DataFrame, columns: DataFrame, pc: DataFrame, tau, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, pos, a, p from counts (keys, pos, a, v) and effective numbers (keys, pos, neff)."""
    own = cells.select(*keys, "pos", "a", "v")
    mix = pc.join(own, [*keys, "pos", "a"], "left").join(columns, [*keys, "pos"]).withColumn("t", tau(F.col("neff")))
    mix = mix.withColumn("p", F.col("t") * F.col("p") + (F.lit(1.0) - F.col("t")) * F.when(F.col("neff") > 0, F.coalesce("v", F.lit(0.0)) / F.col("neff")).otherwise(F.lit(0.0)))
    total = F.sum("p").over(Window.partitionBy(*keys, "pos"))
    return mix.select(*keys, "pos", "a", F.when(total > 0, F.col("p") / total).otherwise(F.lit(0.0)).alias("p"))


def admix_to_neff(freq: DataFrame, pc: DataFrame, target: float, tolerance: float = 0.025, steps: int = 20, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, tau, neff: bisection of tau on all profiles at once, from 0.5 until 2 ** mean entropy is within tolerance of target.

    freq and pc: (keys, pos, a, f) and (keys, pos, a, p). A profile stops when tau leaves (0.01, 0.99), with tau 0 or 1.
    The joined columns are computed once; each step is one grouped sum over them.
    """
    c = freq.join(pc, [*keys, "pos", "a"], "full").select(*keys, "pos", "a", F.coalesce("f", F.lit(0.0)).alias("f"), F.coalesce("p", F.lit(0.0)).alias("p"))
    state = c.select(*keys).distinct().withColumns({"l": F.lit(0.0), "r": F.lit(1.0), "tau": F.lit(0.5), "neff": F.lit(0.0), "done": F.lit(False)}).checkpoint()
    c = c.checkpoint()
    for _ in range(steps):
        m = c.join(state.filter("not done"), list(keys)).withColumn("v", F.col("tau") * F.col("p") + (F.lit(1.0) - F.col("tau")) * F.col("f"))
        h = m.groupBy(*keys, "pos").agg((-F.sum(F.when(F.col("v") > F.lit(1.2e-38), F.col("v") * F.log2("v")).otherwise(F.lit(0.0)))).alias("h")).groupBy(*keys).agg(F.pow(F.lit(2.0), F.avg("h")).alias("now"))
        s = state.join(h, list(keys), "left").withColumn("neff", F.coalesce("now", "neff"))
        ok = F.abs(F.col("neff") - F.lit(float(target))) <= F.lit(tolerance)
        low = F.col("neff") < F.lit(float(target))
        s = s.withColumns({"l": F.when(~F.col("done") & low & ~ok, F.col("tau")).otherwise(F.col("l")), "r": F.when(~F.col("done") & ~low & ~ok, F.col("tau")).otherwise(F.col("r")), "hit": F.col("done") | ok})
        nxt = (F.col("l") + F.col("r")) / F.lit(2.0)
        s = s.withColumns({"out": ~F.col("hit") & ((F.col("l") > F.lit(0.99)) | (F.col("r") < F.lit(0.01))), "nxt": nxt})
        state = s.select(*keys, "l", "r", F.when(F.col("hit"), F.col("tau")).when(F.col("out"), F.when(F.col("l") > F.lit(0.99), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.col("nxt")).alias("tau"), "neff", (F.col("hit") | F.col("out")).alias("done")).checkpoint()
        if state.filter("not done").isEmpty():
            break
    return state.select(*keys, "tau", "neff")


def posteriors_dense(cells: DataFrame, model: list[tuple[int, int, int, float]], prior: list[float], weights: list[float], size: int, id_col: str = "id", top: int = 1) -> DataFrame:
    """id, pos, k, pp of the `top` states of each window, by matrix products for models of thousands of states.

    model: (k, j, a, lp) rows on the driver, a fixed-size parameter of K * W * A numbers; sequences are gathered by id.
    """
    import numpy as np

    n_states, width = len(prior), len(weights)
    table = np.zeros((width, size + 1, n_states))
    for k, j, a, lp in model:
        table[j, a, k] = lp * weights[j]
    lprior, c = np.log(np.array(prior)), (width - 1) // 2

    def run(it):
        import pandas as pd

        for pdf in it:
            out = []
            for i, letters in zip(pdf["id"], pdf["letters"], strict=True):
                a = np.minimum(np.asarray(letters, int), size)
                s = np.tile(lprior, (len(a), 1))
                for j in range(width):
                    lo, hi = max(0, c - j), min(len(a), len(a) + c - j)
                    if lo < hi:
                        s[lo:hi] += table[j, a[lo + j - c : hi + j - c]]
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                best = np.argsort(-s, axis=1, kind="stable")[:, :top]
                out.append(pd.DataFrame({"id": i, "pos": np.repeat(np.arange(len(a)), top), "k": best.ravel(), "pp": np.take_along_axis(s, best, 1).ravel()}))
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "pos": [], "k": [], "pp": []})

    seqs = cells.groupBy(F.col(id_col).alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]).alias("letters"))
    return seqs.mapInPandas(run, f"id {seqs.schema['id'].dataType.simpleString()}, pos int, k int, pp double")


def library_to_crf(states: DataFrame, cells: DataFrame, central: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, bias; k, j, a, w; k, a, w): logs with a floor at the smallest normal double."""
    floor = lambda x: F.ln(F.greatest(x, F.lit(2.2250738585072014e-308)))
    return states.select("k", floor(F.col("prior")).alias("bias")), cells.join(weights, "j").select("k", "j", "a", (F.col("w") * floor(F.col("p"))).alias("w")), central.select("k", "a", floor(F.col("p")).alias("w"))


def crf_to_library(bias: DataFrame, cw: DataFrame, weights: DataFrame, neff: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(k, prior; k, j, a, p): each column normalised, what that takes is moved into the priors."""
    x = cw.join(weights.withColumnRenamed("w", "wj"), "j").withColumn("x", F.col("w") / F.col("wj"))
    m = x.groupBy("k", "j").agg(F.max("x").alias("m"))
    lse = x.join(m, ["k", "j"]).groupBy("k", "j", "wj", "m").agg((F.col("m") + F.ln(F.sum(F.exp(F.col("x") - F.col("m"))))).alias("lse"))
    cells = x.join(lse.select("k", "j", "lse"), ["k", "j"]).select("k", "j", "a", F.exp(F.col("x") - F.col("lse")).alias("p"))
    shift = lse.groupBy("k").agg(F.sum(F.col("wj") * F.col("lse")).alias("d"))
    every = Window.partitionBy(F.lit(0))
    b = bias.join(shift, "k").withColumn("b", F.col("bias") + F.lit(float(neff)) * F.col("d")).withColumn("e", F.exp(F.col("b") - F.max("b").over(every)))
    return b.select("k", (F.col("e") / F.sum("e").over(every)).alias("prior")), cells


def softmax_columns(weights: DataFrame) -> DataFrame:
    """k, a, p: emission weights as probabilities, none below the smallest normal double."""
    w = Window.partitionBy("k")
    e = weights.withColumn("e", F.exp(F.col("w") - F.max("w").over(w)))
    return e.select("k", "a", F.greatest(F.col("e") / F.sum("e").over(w), F.lit(2.2250738585072014e-308)).alias("p"))
