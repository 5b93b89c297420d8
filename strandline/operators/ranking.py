"""Ranked hits and their evaluation: prefix filters, ROC, FDR, calibration, binned means, alignment quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_filter(hits: DataFrame, threshold: float, by: list[str], order: list[str], value: str = "evalue") -> DataFrame:
    """The hits of each list in front of the first one above the threshold (a cut, not a filter)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("_over", F.max((F.col(value) > F.lit(float(threshold))).cast("int")).over(w)).filter("_over = 0").drop("_over")


def prefix_filter_nested(hits: DataFrame, threshold: float, by: list[str], order: list[str]) -> DataFrame:
    """Hit lists cut at the threshold, and each hit's aligned pairs likewise, by array functions."""
    cut = prefix_filter(hits, threshold, by, order)
    first = F.expr(f"array_position(transform(hsps, h -> h.evalue > {float(threshold)}D), true)")
    return cut.withColumn("hsps", F.when(first > 0, F.slice("hsps", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("hsps")))


def best_pair(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hsps", F.slice("hsps", 1, 1))


def converged(before: DataFrame, now: DataFrame, key: str = "query_id", item: str = "definition") -> DataFrame:
    """key, same: whether two rounds have the same sorted list of hits."""
    lists = lambda d, n: d.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(n))
    return lists(before, "x").join(lists(now, "y"), key, "full").select(key, F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def relation(a: Column, b: Column, levels: int = 4) -> Column:
    """How many levels of two dotted labels agree from the first on; one more if all do."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    n = F.lit(0)
    same = F.lit(True)
    for k in range(levels):
        same = same & (F.get(x, F.lit(k)) == F.get(y, F.lit(k)))
        n = n + F.coalesce(same, F.lit(False)).cast("int")
    return n


# Families of labels whose members may be related although their labels differ, by pattern.
RELATED = (
    r"^b\.(66|67|68|69|70)",
    r"c\.(2|3|4|5|30|66|78|79|111)\.",
    r"(a\.118\.24)|(d\.211\.1)",
    r"(a\.1\.2)|(d\.58\.1)",
)
# Fixed value: labels that say nothing about a relation.
UNSURE = r"i\."


def excepted(a: Column, b: Column) -> Column:
    """Whether two labels that seem unrelated are not to count as false: both of one family, or one of them unsure."""
    out = a.rlike(UNSURE) | b.rlike(UNSURE)
    for x in RELATED:
        out = out | (a.rlike(x) & b.rlike(x))
    return out


def classified(rel: Column, tp_from: int = 3, fp_to: int = 1, itself: int = 5, excepted: Column | None = None) -> Column:
    """TP from a relation on, FP up to one, null between, for the hit itself and for excepted pairs."""
    out = F.when(rel == itself, F.lit(None).cast("string")).when(rel >= tp_from, "TP").when(rel <= fp_to, "FP")
    return out if excepted is None else F.when(excepted & (rel < tp_from), F.lit(None).cast("string")).otherwise(out)


def score_bin(e: Column, low: float, width: float, bins: int) -> Column:
    """Histogram bin of -log10 e, cut to [0, bins)."""
    b = F.floor((-F.log10(e) - F.lit(float(low))) / F.lit(float(width)))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)).cast("int")


def weighted_histogram(hits: DataFrame, bin_col: str, weight: str) -> DataFrame:
    """bin, tp, fp: weighted counts by class."""
    one = lambda c: F.sum(F.when(F.col("class") == c, F.col(weight)).otherwise(F.lit(0.0)))
    return hits.groupBy(bin_col).agg(one("TP").alias("tp"), one("FP").alias("fp"))


def level_sizes(items: DataFrame, levels: list[str]) -> DataFrame:
    """The size of every group of a hierarchy, all levels in one pass."""
    depth = sum((F.grouping(c) for c in levels[1:]), F.grouping(levels[0]))
    return items.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), depth.cast("int").alias("open"))


def roc_points(hist: DataFrame, bin_col: str = "bin") -> DataFrame:
    """fp, tp: cumulated from the best bin down; of points with equal fp the last one stays."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(bin_col).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a histogram of bounded size
    c = hist.select(F.sum("fp").over(w).alias("fp"), F.sum("tp").over(w).alias("tp"))
    return c.groupBy("fp").agg(F.max("tp").alias("tp"))


def fdr_points(hist: DataFrame, positives: float, bin_col: str = "bin") -> DataFrame:
    """bin, sensitivity, fdr along the cumulated histogram."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(bin_col).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = hist.withColumns({"ctp": F.sum("tp").over(w), "cfp": F.sum("fp").over(w)})
    return c.filter(F.col("ctp") + F.col("cfp") > 0).select(bin_col, (F.col("ctp") / F.lit(float(positives))).alias("sensitivity"), (F.col("cfp") / (F.col("ctp") + F.col("cfp"))).alias("fdr"))


def rocx(hits: DataFrame, x: int, order: list[Column], query: str = "query") -> DataFrame:
    """query, rocx: the mean share of positives in front of each of the first x false positives.

    Queries without positives are left out; missing false positives count as found behind all.
    """
    w = Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_tp, is_fp = (F.col("class") == "TP").cast("int"), (F.col("class") == "FP").cast("int")
    c = hits.filter("class is not null").withColumns({"_tp": F.sum(is_tp).over(w), "_fp": F.sum(is_fp).over(w), "_is": is_fp, "_pos": is_tp})
    s = c.groupBy(query).agg(F.sum(F.when((F.col("_is") == 1) & (F.col("_fp") <= x), F.col("_tp")).otherwise(0)).alias("area"), F.sum("_pos").alias("pos"), F.sum("_is").alias("neg"))
    full = F.col("area") + F.greatest(F.lit(0), F.lit(x) - F.col("neg")) * F.col("pos")
    return s.filter("pos > 0").select(query, (full.cast("double") / (F.col("pos") * F.lit(x))).alias("rocx"))


def rocx_distribution(scores: DataFrame, value: str = "rocx") -> DataFrame:
    """rocx, share: the share of queries with at least that score; equal scores are one point.

    Counts by score first, so the running sum is over distinct scores.
    """
    n = scores.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    down = every.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.select(value, (F.sum("n").over(down).cast("double") / F.sum("n").over(every)).alias("share"))


def calibration(hits: DataFrame, queries: int, value: str = "evalue", grain: int = 2) -> DataFrame:
    """reported, actual: false positives per query at or below each reported value, on a logarithmic grid."""
    b = F.floor(F.log10(F.col(value)) * F.lit(float(grain))).cast("int")
    n = hits.filter((F.col("class") == "FP") & (F.col(value) > 0)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.select(F.pow(F.lit(10.0), (F.col("b") + 1) / F.lit(float(grain))).alias("reported"), (F.sum("n").over(up).cast("double") / F.lit(queries)).alias("actual"))


def at_fdr(points: DataFrame, threshold: float) -> DataFrame:
    """sensitivity at an FDR threshold, interpolated between the last point below and the first above it."""
    lo = points.filter(F.col("fdr") <= F.lit(float(threshold))).agg(F.max(F.struct("sensitivity", "fdr")).alias("lo"))
    hi = points.filter(F.col("fdr") > F.lit(float(threshold))).agg(F.min(F.struct("sensitivity", "fdr")).alias("hi"))
    both = lo.crossJoin(hi)  # one row each
    part = (F.lit(float(threshold)) - F.col("lo.fdr")) / (F.col("hi.fdr") - F.col("lo.fdr"))
    return both.select(F.when(F.col("lo").isNull(), F.lit(0.0)).when(F.col("hi").isNull() | (F.col("hi.sensitivity") < F.col("lo.sensitivity")), F.col("lo.sensitivity")).otherwise(F.col("lo.sensitivity") + part * (F.col("hi.sensitivity") - F.col("lo.sensitivity"))).alias("sensitivity"))


def worst_false(hits: DataFrame, group: list[str], most: int, weight: str | None = None) -> DataFrame:
    """The groups with the most false positives, by count or by weight."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    return hits.filter(F.col("class") == "FP").groupBy(*group).agg(n.alias("n")).orderBy(F.col("n").desc(), *group).limit(most)


def binned(df: DataFrame, x: str, y: str, low: float, width: float) -> DataFrame:
    """bin, n, mean, sd (of the population) of y by equal bins of x."""
    b = F.floor((F.col(x) - F.lit(float(low))) / F.lit(float(width))).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"))


def alignment_quality(predicted: DataFrame, reference: DataFrame, key: str = "pair") -> DataFrame:
    """pair, precision, sensitivity of aligned positions (pair, i, j) against reference ones; pairs without prediction have 0."""
    hit = predicted.join(reference, [key, "i", "j"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("ok"))
    n = predicted.groupBy(key).agg(F.count(F.lit(1)).alias("np"))
    r = reference.groupBy(key).agg(F.count(F.lit(1)).alias("nr"))
    out = r.join(n, key, "left").join(hit, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return out.select(key, F.when(zero(F.col("np")) > 0, zero(F.col("ok")) / F.col("np")).otherwise(F.lit(0.0)).alias("precision"), (zero(F.col("ok")) / F.col("nr")).alias("sensitivity"))


def accepted(pairs: DataFrame, tm: float | None = 0.6, rmsd: float | None = 4.0, low: float = 0.0, high: float = 0.3) -> DataFrame:
    """Pairs with identities from low to high, a score of at least tm and a deviation of at most rmsd; None asks for nothing."""
    ok = F.col("identity").between(low, high)
    if tm is not None:
        ok = ok & (F.col("tm_score") >= tm)
    if rmsd is not None:
        ok = ok & (F.col("rmsd") <= rmsd)
    return pairs.filter(ok)


def found_by_all(found: DataFrame, methods: int, item: str = "pair", method: str = "method") -> DataFrame:
    return found.groupBy(item).agg(F.countDistinct(method).alias("n")).filter(F.col("n") == methods).select(item)


def found_by_any(found: DataFrame, item: str = "pair") -> DataFrame:
    return found.select(item).distinct()


def compared(runs: DataFrame, value: str, name: str) -> DataFrame:
    """Runs by value, best first, with how far each is below the best in percent."""
    best = F.max(value).over(Window.partitionBy(F.lit(0)))
    return runs.select(name, value, (F.lit(100.0) * (best - F.col(value)) / best).alias("below_best")).orderBy(F.col(value).desc(), name)
