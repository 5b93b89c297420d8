"""Queries over ranked hits and binned values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import profiles, ranking
from .catalog import query
from .inputs import HIST, HITS, hits, r6, table

ORDER = ["evalue", "target", "o", "n"]


def _hist(spark, sf_dir):
    h = hits(spark, sf_dir).withColumns({"bin": ranking.score_bin(F.col("evalue"), 0.0, 0.5, 30), "w": F.lit(1.0)})
    return ranking.weighted_histogram(h, "bin", "w")


@query(f"WITH {HITS}, x AS (SELECT *, max(CASE WHEN price < 50000 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY price DESC, target, o, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cut FROM hits) SELECT query, target, o, n FROM x WHERE cut = 0")
def hits_prefix_filter(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("e", -F.col("price"))
    return ranking.prefix_filter(h, -50000.0, ["query"], ["e", "target", "o", "n"], "e").select("query", "target", "o", "n")


@query(f"WITH {HITS} SELECT query, target, max(price) AS price FROM hits GROUP BY query, target")
def hits_best_pair(spark, sf_dir):
    h = hits(spark, sf_dir).groupBy("query", "target").agg(F.sort_array(F.collect_list("price"), asc=False).alias("hsps"))
    return ranking.best_pair(h).select("query", "target", F.col("hsps")[0].alias("price"))


@query("""WITH l AS (SELECT l_suppkey AS query_id, l_linestatus AS s, list(l_partkey ORDER BY l_partkey) AS x FROM lineitem GROUP BY 1, 2)
SELECT coalesce(f.query_id, o.query_id) AS query_id, coalesce(f.x = o.x, false) AS same FROM (SELECT * FROM l WHERE s = 'F') f FULL JOIN (SELECT * FROM l WHERE s = 'O') o ON f.query_id = o.query_id""")
def hits_converged(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("definition"), "l_linestatus")
    return ranking.converged(h.filter("l_linestatus = 'F'").drop("l_linestatus"), h.filter("l_linestatus = 'O'").drop("l_linestatus"))


@query(f"WITH {HIST} SELECT bin, tp, fp FROM hist")
def hit_histogram(spark, sf_dir):
    return _hist(spark, sf_dir)


CUM = HIST + ", c AS (SELECT bin, sum(tp) OVER (ORDER BY bin DESC) AS tp, sum(fp) OVER (ORDER BY bin DESC) AS fp FROM hist)"


@query(f"WITH {CUM} SELECT fp, max(tp) AS tp FROM c GROUP BY fp")
def roc_curve(spark, sf_dir):
    return ranking.roc_points(_hist(spark, sf_dir))


@query(f"WITH {CUM}, p AS (SELECT fp AS x, max(tp) AS y FROM c GROUP BY fp), d AS (SELECT x - lag(x) OVER (ORDER BY x) AS dx, (y + lag(y) OVER (ORDER BY x)) / 2 AS my FROM p) SELECT round(sum(coalesce(dx * my, 0)), 3) + 0 AS area FROM d")
def roc_area(spark, sf_dir):
    p = ranking.roc_points(_hist(spark, sf_dir)).select(F.col("fp").alias("x"), F.col("tp").alias("y"))
    return scalars.trapezoid(p, []).select((F.round("area", 3) + F.lit(0.0)).alias("area"))


FDR = CUM + ", p AS (SELECT bin, tp / (SELECT sum(tp) FROM hist) AS sensitivity, fp / (tp + fp) AS fdr FROM c WHERE tp + fp > 0)"


def _fdr(spark, sf_dir):
    h = _hist(spark, sf_dir)
    total = h.agg(F.sum("tp")).first()[0]
    return ranking.fdr_points(h, total)


@query(f"WITH {FDR} SELECT bin, round(sensitivity, 6) + 0 AS sensitivity, round(fdr, 6) + 0 AS fdr FROM p")
def fdr_sensitivity(spark, sf_dir):
    return _fdr(spark, sf_dir).select("bin", r6(F.col("sensitivity")).alias("sensitivity"), r6(F.col("fdr")).alias("fdr"))


@query(f"""WITH {FDR}, lo AS (SELECT sensitivity, fdr FROM p WHERE fdr <= 0.95::DOUBLE ORDER BY sensitivity DESC, fdr DESC LIMIT 1), hi AS (SELECT sensitivity, fdr FROM p WHERE fdr > 0.95::DOUBLE ORDER BY sensitivity, fdr LIMIT 1)
SELECT round(CASE WHEN lo.fdr IS NULL THEN 0 WHEN hi.fdr IS NULL OR hi.sensitivity < lo.sensitivity THEN lo.sensitivity ELSE lo.sensitivity + (0.95::DOUBLE - lo.fdr) / (hi.fdr - lo.fdr) * (hi.sensitivity - lo.sensitivity) END, 6) + 0 AS sensitivity FROM (SELECT 1 AS one) LEFT JOIN lo ON true LEFT JOIN hi ON true""")
def sensitivity_at_fdr(spark, sf_dir):
    return ranking.at_fdr(_fdr(spark, sf_dir), 0.95).select(r6(F.col("sensitivity")).alias("sensitivity"))


ROCX = HITS + """, r AS (SELECT *, sum(CASE WHEN class = 'TP' THEN 1 ELSE 0 END) OVER w AS ctp, sum(CASE WHEN class = 'FP' THEN 1 ELSE 0 END) OVER w AS cfp FROM hits WHERE class IS NOT NULL WINDOW w AS (PARTITION BY query ORDER BY price DESC, target, o, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT query, sum(CASE WHEN class = 'FP' AND cfp <= 5 THEN ctp ELSE 0 END) AS area, sum(CASE WHEN class = 'TP' THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN class = 'FP' THEN 1 ELSE 0 END) AS neg FROM r GROUP BY query),
rx AS (SELECT query, (area + greatest(0, 5 - neg) * pos)::DOUBLE / (pos * 5) AS rocx FROM s WHERE pos > 0)"""


def _rocx(spark, sf_dir):
    return ranking.rocx(hits(spark, sf_dir), 5, [F.col("price").desc(), F.col("target"), F.col("o"), F.col("n")])


@query(f"WITH {ROCX} SELECT query, round(rocx, 6) + 0 AS rocx FROM rx")
def rocx_per_query(spark, sf_dir):
    return _rocx(spark, sf_dir).select("query", r6(F.col("rocx")).alias("rocx"))


@query(f"WITH {ROCX} SELECT DISTINCT round(rocx, 6) + 0 AS rocx, round(count(*) OVER (ORDER BY rocx DESC)::DOUBLE / count(*) OVER (), 6) + 0 AS share FROM rx")
def rocx_distribution(spark, sf_dir):
    return ranking.rocx_distribution(_rocx(spark, sf_dir)).select(r6(F.col("rocx")).alias("rocx"), r6(F.col("share")).alias("share"))


@query(f"WITH {HITS}, b AS (SELECT floor(-price / 5000::DOUBLE)::INT AS b, count(*) AS n FROM hits WHERE class = 'FP' GROUP BY 1) SELECT pow(10::DOUBLE, (b + 1) / 2::DOUBLE) AS reported, round(sum(n) OVER (ORDER BY b)::DOUBLE / 100, 6) + 0 AS actual FROM b")
def evalue_calibration(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("evalue", F.pow(F.lit(10.0), F.floor(-F.col("price") / F.lit(5000.0)) / F.lit(2.0) + F.lit(0.01)))
    return ranking.calibration(h, 100).select("reported", r6(F.col("actual")).alias("actual"))


@query(f"WITH {HITS} SELECT query, count(*)::DOUBLE AS n FROM hits WHERE class = 'FP' GROUP BY query ORDER BY n DESC, query LIMIT 10")
def worst_false_positives(spark, sf_dir):
    return ranking.worst_false(hits(spark, sf_dir), ["query"], 10)


@query("SELECT n_regionkey AS region, n_nationkey AS nation, c_mktsegment AS segment, count(*) AS n, (grouping(n_regionkey) + grouping(n_nationkey) + grouping(c_mktsegment))::INT AS open FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey, c_mktsegment)")
def hierarchy_sizes_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ranking.level_sizes(c.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), ["region", "nation", "segment"])


@query("SELECT floor((l_extendedprice - 0) / 1000::DOUBLE)::BIGINT AS bin, count(*) AS n, round(avg(l_quantity), 6) + 0 AS mean, round(stddev_pop(l_quantity), 6) + 0 AS sd FROM lineitem GROUP BY 1")
def binned_mean_sd(spark, sf_dir):
    b = ranking.binned(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 0.0, 1000.0)
    return b.select("bin", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS pair, l_partkey AS i, l_linenumber AS j FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_suppkey AS pair, l_partkey AS i, l_linenumber AS j FROM lineitem WHERE l_linestatus = 'F'),
h AS (SELECT p.pair, count(*) AS ok FROM p JOIN r ON p.pair = r.pair AND p.i = r.i AND p.j = r.j GROUP BY p.pair), np AS (SELECT pair, count(*) AS n FROM p GROUP BY pair), nr AS (SELECT pair, count(*) AS n FROM r GROUP BY pair)
SELECT nr.pair, round(CASE WHEN coalesce(np.n, 0) > 0 THEN coalesce(ok, 0)::DOUBLE / np.n ELSE 0 END, 6) + 0 AS precision, round(coalesce(ok, 0)::DOUBLE / nr.n, 6) + 0 AS sensitivity FROM nr LEFT JOIN np ON np.pair = nr.pair LEFT JOIN h ON h.pair = nr.pair""")
def alignment_quality(spark, sf_dir):
    cell = lambda c: table(spark, sf_dir, "lineitem").filter(c).select(F.col("l_suppkey").alias("pair"), F.col("l_partkey").alias("i"), F.col("l_linenumber").alias("j")).distinct()
    q = ranking.alignment_quality(cell("l_returnflag = 'A'"), cell("l_linestatus = 'F'"))
    return q.select("pair", r6(F.col("precision")).alias("precision"), r6(F.col("sensitivity")).alias("sensitivity"))


@query("SELECT l_partkey AS pair FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def pairs_found_by_all(spark, sf_dir):
    return ranking.found_by_all(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pair"), F.col("l_returnflag").alias("method")), 3)


@query("SELECT DISTINCT l_partkey AS pair FROM lineitem")
def pairs_found_by_any(spark, sf_dir):
    return ranking.found_by_any(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pair")))


@query("SELECT p_brand, round(avg(p_retailprice), 6) + 0 AS v, round(100::DOUBLE * (max(avg(p_retailprice)) OVER () - avg(p_retailprice)) / max(avg(p_retailprice)) OVER (), 6) + 0 AS below_best FROM part GROUP BY p_brand")
def compared_runs(spark, sf_dir):
    r = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    return ranking.compared(r, "v", "p_brand").select("p_brand", r6(F.col("v")).alias("v"), r6(F.col("below_best")).alias("below_best"))


@query("SELECT o_orderkey, round(1 - exp(-o_totalprice / 100000::DOUBLE), 6) + 0 AS p, round(o_totalprice, 6) + 0 AS e FROM orders")
def p_and_e_values(spark, sf_dir):
    n = F.lit(100000.0)
    p = scalars.p_from_e(F.col("o_totalprice"), n)
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(p).alias("p"), F.round(scalars.e_from_p(p, n), 3).alias("x"), r6(F.col("o_totalprice")).alias("e")).drop("x")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey BETWEEN 0 AND 2 OR p_partkey = 6 ORDER BY p_size DESC, p_partkey LIMIT 3")
def chosen_states(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return profiles.chosen_states(p, "1-3,7", "p_size", 3).select(F.col("k").alias("p_partkey"), "p_size")
