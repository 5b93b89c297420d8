"""Hidden chains over context states: forward and backward passes, Baum-Welch, transition tables.

The recursions carry a state vector from position to position, so a sequence is one array and the
passes run in Arrow batches; parameters are of states * states size and go with the function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Hmm:
    """start (K), transitions (K, K) and emissions (K, A)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def pruned(self, least: float) -> "Hmm":
        m = np.where(self.move < least, 0, self.move)
        return Hmm(self.start, m / m.sum(1, keepdims=True), self.emit)


def passes(h: Hmm, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Scaled forward and backward values, scales and log2 likelihood of codes x (any letter emits 1 everywhere)."""
    n, k = len(x), len(h.start)
    e = np.concatenate([h.emit, np.ones((k, 1))], 1)[:, np.minimum(x, h.emit.shape[1])].T
    f, b, s = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for i in range(n):
        v = (h.start if i == 0 else f[i - 1] @ h.move) * e[i]
        s[i] = v.sum()
        f[i] = v / s[i]
    for i in range(n - 2, -1, -1):
        b[i] = h.move @ (e[i + 1] * b[i + 1]) / s[i + 1]
    return f, b, s, float(np.log2(s).sum())


def _letters(cells: DataFrame) -> DataFrame:
    return cells.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]).alias("letters"))


def state_posteriors(cells: DataFrame, h: Hmm) -> DataFrame:
    """id, pos, k, pp and the sequence's log2 likelihood."""

    def run(it):
        import pandas as pd

        for pdf in it:
            out = []
            for i, x in zip(pdf["id"], pdf["letters"], strict=True):
                f, b, _, ll = passes(h, np.asarray(x, int))
                pp = f * b
                n, k = pp.shape
                out.append(pd.DataFrame({"id": i, "pos": np.repeat(np.arange(n), k), "k": np.tile(np.arange(k), n), "pp": pp.ravel(), "ll": ll}))
            if out:
                yield pd.concat(out)

    seqs = _letters(cells)
    return seqs.mapInPandas(run, f"id {seqs.schema['id'].dataType.simpleString()}, pos int, k int, pp double, ll double")


def baum_welch_step(cells: DataFrame, h: Hmm) -> tuple[Hmm, float]:
    """Re-estimated parameters and the log2 likelihood; expected counts are summed by task, then by Spark."""
    k, a = h.emit.shape

    def run(it):
        import pandas as pd

        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, a + 1)), 0.0
        for pdf in it:
            for x in pdf["letters"]:
                x = np.asarray(x, int)
                f, b, s, ll = passes(h, x)
                pp = f * b
                start += pp[0]
                np.add.at(emit.T, np.minimum(x, a), pp)
                e = np.concatenate([h.emit, np.ones((k, 1))], 1)[:, np.minimum(x, a)].T
                if len(x) > 1:
                    move += h.move * (f[:-1].T @ (e[1:] * b[1:] / s[1:, None]))
                total += ll
        v = np.concatenate([[total], start, move.ravel(), emit[:, :a].ravel()])
        yield pd.DataFrame({"i": np.arange(len(v)), "v": v})

    rows = _letters(cells).select("letters").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(1 + k + k * k + k * a)
    for r in rows:
        v[r["i"]] = r["v"]
    start, move, emit = v[1 : 1 + k], v[1 + k : 1 + k + k * k].reshape(k, k), v[1 + k + k * k :].reshape(k, a)
    unit = lambda m, old: np.where(m.sum(-1, keepdims=True) > 0, m / np.maximum(m.sum(-1, keepdims=True), 1e-300), old)
    return Hmm(unit(start, h.start), unit(move, h.move), unit(emit, h.emit)), float(v[0])


def baum_welch(cells: DataFrame, h: Hmm, most: int = 50, tolerance: float = 1e-4, prune: float = 0.0) -> tuple[Hmm, list[float]]:
    lls: list[float] = []
    for _ in range(most):
        h, ll = baum_welch_step(cells, h)
        if prune:
            h = h.pruned(prune)
        lls.append(ll)
        if len(lls) > 1 and lls[-1] - lls[-2] <= tolerance * abs(lls[-2]):
            break
    return h, lls


def pseudocounts(cells: DataFrame, h: Hmm) -> DataFrame:
    """id, pos, a, p: the posterior mean of the states' emissions."""
    pp = state_posteriors(cells, h)
    spark = cells.sparkSession
    emit = spark.createDataFrame([(k, a, float(v)) for k, r in enumerate(h.emit) for a, v in enumerate(r)], "k int, a int, e double")
    return pp.join(emit, "k").groupBy("id", "pos", "a").agg(F.sum(F.col("pp") * F.col("e")).alias("p"))


def transitions(states: DataFrame, keys: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """src, dst, w: the share of moves from each state, from state sequences (id, pos, k)."""
    from pyspark.sql import Window

    nxt = states.withColumn("dst", F.lead("k").over(Window.partitionBy(*keys).orderBy("pos"))).filter("dst is not null")
    n = nxt.groupBy(F.col("k").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy("src").agg(F.sum("n").alias("t"))
    return n.join(t, "src").select("src", "dst", (F.col("n").cast("double") / F.col("t")).alias("w"))


def similar_states(scores: DataFrame, least: float) -> DataFrame:
    """Transitions between states whose co-emission is at least a threshold, by equal shares."""
    s = scores.filter(F.col("score") >= F.lit(float(least))).select(F.col("k").alias("src"), F.col("l").alias("dst"))
    t = s.groupBy("src").agg(F.count(F.lit(1)).alias("t"))
    return s.join(t, "src").select("src", "dst", (F.lit(1.0) / F.col("t")).alias("w"))
