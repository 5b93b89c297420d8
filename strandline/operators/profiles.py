"""Substitution matrices, consensus and conservation of profiles, co-emission, logos."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabets import Alphabet
from ..functions.scalars import plogp


def from_joint(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, q, rx = P(a | b), ry = P(b | a), s = log2 odds; a, p) of joint frequencies (a, b, q), normalised first.

    A matrix has a few hundred cells: its sums are windows over all of it.
    """
    every = Window.partitionBy(F.lit(0))
    q = q.withColumn("q", F.col("q") / F.sum("q").over(every))
    t = q.withColumns({"px": F.sum("q").over(Window.partitionBy("a")), "py": F.sum("q").over(Window.partitionBy("b"))})
    t = t.withColumns({"rx": F.col("q") / F.col("py"), "ry": F.col("q") / F.col("px"), "s": F.log2(F.col("q") / (F.col("px") * F.col("py")))})
    return t.select("a", "b", "q", "rx", "ry", "s"), t.select("a", F.col("px").alias("p")).distinct()


def matrix_neff(matrix: DataFrame, background: DataFrame) -> DataFrame:
    """neff: the sum over b of p(b) * 2 ** entropy of P(a | b)."""
    h = matrix.groupBy("b").agg((-F.sum(plogp(F.col("rx")))).alias("h"))
    return h.join(background.withColumnRenamed("a", "b"), "b").agg(F.sum(F.col("p") * F.pow(F.lit(2.0), F.col("h"))).alias("neff"))


def triangular(spark: SparkSession, path: str, abc: Alphabet) -> DataFrame:
    """Joint frequencies from a text of a lower triangle: row a has a + 1 numbers; the file is a parameter."""
    rows = spark.read.text(path, wholetext=True).first()[0]
    parts = [[float(x) for x in line.split()] for line in rows.splitlines() if line.strip() and not line.startswith("#")]
    cells = [(a, b, v / (1 if a == b else 2)) for a, r in enumerate(parts) for b, v in enumerate(r)]
    cells += [(b, a, v) for a, b, v in cells if a != b]
    return spark.createDataFrame(cells, "a int, b int, q double")


def match_mismatch(spark: SparkSession, abc: Alphabet, match: float, mismatch: float) -> DataFrame:
    """Joint frequencies whose log2 odds against an even background are the two scores, up to normalisation."""
    n = abc.size
    return spark.createDataFrame([(a, b, 2.0 ** (match if a == b else mismatch) / n**2) for a in range(n) for b in range(n)], "a int, b int, q double")


def tamura_nei(spark: SparkSession, background: tuple[float, ...] = (0.3, 0.2, 0.2, 0.3), purines: float = 1.0, pyrimidines: float = 1.0, transversions: float = 0.5, distance: float = 1.0) -> DataFrame:
    """Joint frequencies of nucleotides after `distance`, by the exponential of the rate matrix of the model."""
    import numpy as np

    p = np.array(background, float)
    rate = np.full((4, 4), transversions) * p
    for a, b, r in ((0, 2, purines), (2, 0, purines), (1, 3, pyrimidines), (3, 1, pyrimidines)):
        rate[a, b] = r * p[b]
    np.fill_diagonal(rate, 0)
    np.fill_diagonal(rate, -rate.sum(1))
    rate /= -(p * np.diag(rate)).sum()
    sym = np.sqrt(p)[:, None] * rate / np.sqrt(p)
    val, vec = np.linalg.eigh((sym + sym.T) / 2)
    step = (vec * np.exp(val * distance)) @ vec.T * np.sqrt(p) / np.sqrt(p)[:, None]
    return spark.createDataFrame([(a, b, float(p[a] * step[a, b])) for a in range(4) for b in range(4)], "a int, b int, q double")


def consensus(freq: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code: the letter whose share exceeds its background most; 0 where none does; ties go to the lowest code."""
    d = freq.join(background, "a").withColumn("d", F.col("f") - F.col("p"))
    best = d.groupBy(*keys).agg(F.max(F.struct("d", (-F.col("a")).alias("m"))).alias("x"))
    return best.select(*keys, F.when(F.col("x.d") > 0, -F.col("x.m")).otherwise(F.lit(0)).cast("int").alias("code"))


def conservation(freq: DataFrame, background: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, score, mark: similarity of a column to its leading letter; U above 0.6, L above 0.4, else ~."""
    top = freq.join(background, "a").withColumn("d", F.col("f") - F.col("p")).groupBy(*keys).agg((-F.max(F.struct("d", (-F.col("a")).alias("m")))["m"]).alias("m"))
    diag = matrix.filter("a = b").select("a", F.col("q").alias("qa"))
    sim = matrix.join(diag, "a").join(diag.select(F.col("a").alias("b"), F.col("qa").alias("qb")), "b").select(F.col("a").alias("m"), F.col("b").alias("a"), (F.col("q") * F.col("q") / (F.col("qa") * F.col("qb"))).alias("sim"))
    s = freq.join(top, keys).join(sim, ["m", "a"]).groupBy(*keys, "m").agg(F.sum(F.col("f") * F.col("sim") * F.col("sim")).alias("score"))
    return s.select(*keys, F.col("m").cast("int").alias("code"), "score", F.when(F.col("score") > F.lit(0.6), "U").when(F.col("score") > F.lit(0.4), "L").otherwise("~").alias("mark"))


def conservation_scores(freq: DataFrame, background: DataFrame, id_col: str = "id", pos: str = "i") -> DataFrame:
    """id, i, score, z: ln of weighted squares over ln of weighted shares, and its standard score (sample deviation)."""
    s = freq.join(background, "a").groupBy(id_col, pos).agg((F.ln(F.sum(F.col("f") * F.col("f") / F.col("p"))) / F.ln(F.sum(F.col("f") / F.col("p")))).alias("score"))
    m = s.groupBy(id_col).agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    return s.join(m, id_col).select(id_col, pos, "score", ((F.col("score") - F.col("m")) / F.col("sd")).alias("z"))


def co_emission(left: DataFrame, right: DataFrame, background: DataFrame, weights: list[float]) -> DataFrame:
    """k, l, score: the weighted sum over columns of ln of the sum of p * q / background; (k, j, a, p) and (l, j, a, q)."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("j").cast("int") + 1)
    per = left.join(right, ["j", "a"]).join(background.select("a", F.col("p").alias("bg")), "a").groupBy("k", "l", "j").agg(F.sum(F.col("p") * F.col("q") / F.col("bg")).alias("s"))
    return per.groupBy("k", "l").agg(F.sum(w * F.ln("s")).alias("score"))


def matrix_predicted(freq: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, p: the sum over b of P(a | b) f(b)."""
    r = matrix.select(F.col("a").alias("to"), F.col("b").alias("a"), "rx")
    return freq.join(r, "a").groupBy(*keys, "to").agg(F.sum(F.col("rx") * F.col("f")).alias("p")).withColumnRenamed("to", "a")


def logo(freq: DataFrame, abc: Alphabet, keys: list[str]) -> DataFrame:
    """keys, a, f, height: letter heights f * (log2 size - entropy of the column)."""
    h = freq.groupBy(*keys).agg((-F.sum(plogp(F.col("f")))).alias("h"))
    return freq.join(h, keys).select(*keys, "a", "f", (F.col("f") * (F.lit(math.log2(abc.size)) - F.col("h"))).alias("height"))


def chosen_states(states: DataFrame, ranges: str | None = None, by: str | None = None, most: int | None = None) -> DataFrame:
    """States of a list like 1-3,7 (from 1), sorted by a column descending, the first `most`."""
    if ranges:
        parts = [p.split("-") for p in ranges.split(",")]
        keep = F.lit(False)
        for p in parts:
            keep = keep | F.col("k").between(int(p[0]) - 1, int(p[-1]) - 1)
        states = states.filter(keep)
    if by:
        states = states.orderBy(F.col(by).desc(), "k")
    return states if most is None else states.limit(most)


def by_entropy(cells: DataFrame, center: int) -> DataFrame:
    """k, h, rank: states in ascending order of the entropy of their central column."""
    h = cells.filter(F.col("j") == center).groupBy("k").agg((-F.sum(plogp(F.col("p")))).alias("h"))
    return h.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h", "k")))
