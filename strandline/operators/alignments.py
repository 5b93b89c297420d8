"""Alignments in cell form: (ali, k, i, a), k the row, i the column, a the letter code.

Every operator is a composition of equi-joins and grouped sums over cells; what is kept per
alignment is one row a column and letter, or one row a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabets import Alphabet
from ..functions.scalars import plogp

ONE = F.lit  # doubles are written F.lit(1.0): a bare decimal literal would be a decimal


def mark_end_gaps(cells: DataFrame, abc: Alphabet) -> DataFrame:
    """Gaps in front of the first letter and behind the last one of a row become end gaps."""
    w = Window.partitionBy("ali", "k")
    letter = F.when(F.col("a") <= abc.any, F.col("i"))
    lo, hi = F.min(letter).over(w), F.max(letter).over(w)
    end = (F.col("a") >= abc.gap) & (lo.isNull() | (F.col("i") < lo) | (F.col("i") > hi))
    return cells.withColumn("a", F.when(end, F.lit(abc.end_gap)).otherwise(F.col("a")))


def letter_counts(cells: DataFrame, abc: Alphabet) -> DataFrame:
    """ali, i, a, n: letters (any letter left out) of each column."""
    return cells.filter(F.col("a") < abc.any).groupBy("ali", "i", "a").agg(F.count(F.lit(1)).alias("n"))


def distinct_letters(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ali", "i").agg(F.count(F.lit(1)).alias("d"))


def global_weights(cells: DataFrame, abc: Alphabet) -> DataFrame:
    """ali, k, w: the sum over a row's letters of 1 / (letters of the column * their count * letters of the row), normalised."""
    letters = cells.filter(F.col("a") < abc.any)
    counts = letter_counts(cells, abc)
    per_column = counts.join(distinct_letters(counts), ["ali", "i"])
    length = letters.groupBy("ali", "k").agg(F.count(F.lit(1)).alias("len"))
    raw = letters.join(per_column, ["ali", "i", "a"]).join(length, ["ali", "k"]).groupBy("ali", "k").agg(F.sum(F.lit(1.0) / (F.col("d") * F.col("n") * F.col("len"))).alias("raw"))
    total = raw.groupBy("ali").agg(F.sum("raw").alias("total"))
    rows = cells.select("ali", "k").distinct().join(raw, ["ali", "k"], "left").join(total, "ali", "left")
    return rows.select("ali", "k", F.coalesce(F.col("raw") / F.col("total"), F.lit(0.0)).alias("w"))


def weighted_frequencies(cells: DataFrame, weights: DataFrame, abc: Alphabet) -> DataFrame:
    """ali, i, a, f: weighted letter shares of each column that has letters."""
    s = cells.filter(F.col("a") < abc.any).join(weights, ["ali", "k"]).groupBy("ali", "i", "a").agg(F.sum("w").alias("s"))
    t = s.groupBy("ali", "i").agg(F.sum("s").alias("t"))
    return s.join(t, ["ali", "i"]).select("ali", "i", "a", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(F.lit(0.0)).alias("f"))


def diversity(cells: DataFrame, weights: DataFrame, abc: Alphabet, pairs: bool = False) -> DataFrame:
    """ali, neff: 2 to the mean column entropy; with pairs the mean of N + 1 - N * sum of squares.

    A column of gaps has entropy 0 and is left out of the mean of pairs.
    """
    f = weighted_frequencies(cells, weights, abc)
    if pairs:
        n = cells.select("ali", "k").distinct().groupBy("ali").agg(F.count(F.lit(1)).cast("double").alias("n"))
        q = f.groupBy("ali", "i").agg(F.sum(F.col("f") * F.col("f")).alias("q")).join(n, "ali")
        return q.groupBy("ali").agg(F.avg(F.col("n") + F.lit(1.0) - F.col("n") * F.col("q")).alias("neff"))
    length = cells.select("ali", "i").distinct().groupBy("ali").agg(F.count(F.lit(1)).alias("len"))
    h = f.groupBy("ali").agg((-F.sum(F.when(F.col("f") > F.lit(1e-10), F.col("f") * F.log2("f")).otherwise(F.lit(0.0)))).alias("h"))
    return length.join(h, "ali", "left").select("ali", F.pow(F.lit(2.0), F.coalesce("h", F.lit(0.0)) / F.col("len")).alias("neff"))


def count_profile(cells: DataFrame, weights: DataFrame, neff: DataFrame, abc: Alphabet) -> DataFrame:
    """ali, i, a, v: weighted counts, each column scaled to the alignment's (or column's) effective number."""
    f = weighted_frequencies(cells, weights, abc)
    return f.join(neff, [c for c in ("ali", "i") if c in neff.columns]).select("ali", "i", "a", (F.col("f") * F.col("neff")).alias("v"))


MAX_END_GAPS, LEAST_COLUMNS = 0.1, 10


#: Values of a block of columns that position_weights holds at a time.
BLOCK_VALUES = 4_000_000


def position_weights_of(a, g, letters: int, end_gap: int, share: float, least: int):
    """(weights, effective numbers) of one alignment: a is rows by columns (codes, -1 for no cell), g the rows' global weights.

    What a column's rows have in common with every column are products of 0/1 matrices, a block of columns at a time.
    """
    import numpy as np

    rows, cols = a.shape
    has = (a >= 0) & (a < letters)
    hot = np.zeros((rows, cols * letters), np.float32)
    r, c = np.nonzero(has)
    hot[r, c * letters + a[r, c]] = 1
    ends = (a == end_gap).astype(np.float32)
    w_out, neff = np.zeros((rows, cols)), np.ones(cols)
    for lo in range(0, cols, max(1, BLOCK_VALUES // max(1, cols * letters))):
        own = has[:, lo : lo + max(1, BLOCK_VALUES // max(1, cols * letters))].astype(np.float32)
        size = own.sum(0)
        n = (own.T @ hot).reshape(-1, cols, letters).astype(np.float64)
        usable = own.T @ ends <= np.float64(share) * size[:, None].astype(np.float64)
        d = (n > 0).sum(2)
        counted = usable & (d > 0)
        term = np.where((n > 0) & counted[:, :, None], 1.0 / np.maximum(n * d[:, :, None], 1), 0.0)
        raw = (hot.astype(np.float64) @ term.reshape(len(term), -1).T) * own
        total, n_cols = raw.sum(0), counted.sum(1)
        w = np.where(n_cols < least, g[:, None], raw / np.where(total > 0, total, 1)) * own
        s = (w.T @ hot.astype(np.float64)).reshape(-1, cols, letters) * usable[:, :, None]
        t = s.sum(2, keepdims=True)
        f = np.where(t > 0, s / np.where(t > 0, t, 1), 0.0)
        h = -np.where(f > 1e-10, f * np.log2(np.where(f > 1e-10, f, 1)), 0.0).sum((1, 2))
        neff[lo : lo + len(h)] = np.where(n_cols > 0, 2.0 ** (h / np.maximum(n_cols, 1)), 1.0)
        w_out[:, lo : lo + w.shape[1]] = w
    return w_out, neff


def position_weights(cells: DataFrame, abc: Alphabet, share: float = MAX_END_GAPS, least: int = LEAST_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(ali, i, k, w; ali, i, neff): weights and effective numbers from the sub-alignment of the rows that have a letter in column i.

    An alignment is one call; rows that columns have in common are counted by matrix products, so what moves is the
    cells, once. cells have end gaps marked. Fewer than `least` usable columns fall back on global weights.
    """
    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("ali", "i", "k")}
    own = cells.select("ali", "i", "k", F.col("a").cast("int").alias("a")).join(global_weights(cells, abc).select("ali", "k", F.col("w").alias("g")), ["ali", "k"], "left").select("ali", "i", "k", "a", "g")

    def run(of_rows: bool):
        def weigh(t):
            import numpy as np
            import pyarrow as pa

            ks, k = np.unique(t.column("k").to_numpy(), return_inverse=True)
            js, j = np.unique(t.column("i").to_numpy(), return_inverse=True)
            a, g = np.full((len(ks), len(js)), -1), np.zeros(len(ks))
            a[k, j] = t.column("a").fill_null(abc.end_gap).to_numpy()
            g[k] = t.column("g").fill_null(0.0).to_numpy()
            w, neff = position_weights_of(a, g, abc.any, abc.end_gap, share, least)
            c, r = np.nonzero(((a >= 0) & (a < abc.any)).T) if of_rows else (np.flatnonzero(((a >= 0) & (a < abc.any)).any(0)), None)
            ali = t.column("ali").combine_chunks().take(pa.array(np.zeros(len(c), np.int64)))
            out = {"ali": ali, "i": pa.array(js[c]).cast(t.schema.field("i").type)}
            out |= {"k": pa.array(ks[r]).cast(t.schema.field("k").type), "w": pa.array(w[r, c])} if of_rows else {"neff": pa.array(neff[c])}
            return pa.table(out)

        return weigh

    by = own.groupBy("ali")
    return by.applyInArrow(run(True), f"ali {kinds['ali']}, i {kinds['i']}, k {kinds['k']}, w double"), by.applyInArrow(run(False), f"ali {kinds['ali']}, i {kinds['i']}, neff double")


def match_by_reference(cells: DataFrame, abc: Alphabet, reference: int = 0) -> DataFrame:
    """is_match for columns where the reference row has a letter; inserts of the other rows become gaps."""
    own = cells.filter((F.col("k") == reference) & (F.col("a") <= abc.any)).select("ali", "i", F.lit(True).alias("is_match"))
    out = cells.join(own, ["ali", "i"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))
    return out


def blank_inserts(cells: DataFrame, abc: Alphabet, reference: int = 0) -> DataFrame:
    return cells.withColumn("a", F.when(~F.col("is_match") & (F.col("k") != reference), F.lit(abc.gap)).otherwise(F.col("a")))


def match_by_gaps(cells: DataFrame, weights: DataFrame, abc: Alphabet, threshold: float = 50.0) -> DataFrame:
    """ali, i, is_match: above 1 the threshold is the largest percentage of gaps, else the least share of letters; end gaps count for neither."""
    s = cells.filter(F.col("a") != abc.end_gap).join(weights, ["ali", "k"]).groupBy("ali", "i").agg(F.sum(F.when(F.col("a") <= abc.any, F.col("w")).otherwise(F.lit(0.0))).alias("res"), F.sum(F.when(F.col("a") == abc.gap, F.col("w")).otherwise(F.lit(0.0))).alias("gap"))
    all_w = weights.groupBy("ali").agg(F.sum("w").alias("all"))
    total = F.col("res") + F.col("gap")
    if threshold > 1:
        ok = F.when(total > 0, F.lit(100.0) * F.col("gap") / total <= F.lit(float(threshold))).otherwise(F.lit(False))
    else:
        ok = F.col("res") / F.col("all") > F.lit(float(threshold))
    columns = cells.select("ali", "i").distinct()
    return columns.join(s.join(all_w, "ali").select("ali", "i", ok.alias("ok")), ["ali", "i"], "left").select("ali", "i", F.coalesce("ok", F.lit(False)).alias("is_match"))


def without_inserts(cells: DataFrame) -> DataFrame:
    """Match columns only, numbered anew from 0."""
    w = Window.partitionBy("ali").orderBy("i")
    kept = cells.filter("is_match").select("ali", "i").distinct().withColumn("m", (F.row_number().over(w) - 1).cast("int"))
    return cells.filter("is_match").join(kept, ["ali", "i"]).drop("i").withColumnRenamed("m", "i")


def match_index(columns: DataFrame) -> DataFrame:
    """Running index of match columns (from 0); null for inserts."""
    run = F.sum(F.col("is_match").cast("int")).over(Window.partitionBy("ali").orderBy("i"))
    return columns.withColumn("m", F.when(F.col("is_match"), run - 1))


def merged(master: DataFrame, other: DataFrame) -> DataFrame:
    """(ali, k, header, ...) rows: those of other whose header master lacks go behind master's, repeats in other stay."""
    last = master.groupBy("ali").agg((F.max("k") + 1).alias("base"))
    new = other.join(master.select("ali", "header").distinct(), ["ali", "header"], "left_anti").join(last, "ali", "left")
    new = new.withColumn("k", F.coalesce("base", F.lit(0)) + F.row_number().over(Window.partitionBy("ali").orderBy("k")) - 1).drop("base")
    return master.unionByName(new.select(master.columns))


def rearranged(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows in the order (ali, header, rank) of a list; others go."""
    return rows.drop("k").join(order.select("ali", "header", F.col("rank").alias("k")), ["ali", "header"])


def from_hits(hits: DataFrame, best_only: bool = False) -> DataFrame:
    """ali (query), k, i, chr: hits' aligned pairs anchored on the query; columns where the query has a gap are dropped.

    hits: query_id, query_length, query_seq, oid, hsps. Row 0 is the query. Padding left and right is gaps.
    """
    h = hits.select("query_id", "query_length", "oid", F.posexplode("hsps").alias("x", "hsp"))
    if best_only:
        h = h.filter("x = 0")
    order = Window.partitionBy("query_id").orderBy("oid", "x")
    h = h.withColumn("k", F.row_number().over(order))
    pair = h.select("query_id", "k", F.col("hsp.q_start").alias("q0"), F.posexplode(F.arrays_zip(F.split("hsp.q_seq", "").alias("q"), F.split("hsp.s_seq", "").alias("s"))).alias("p", "z"))
    pair = pair.select("query_id", "k", "q0", "p", F.col("z.q").alias("q"), F.col("z.s").alias("s")).filter("q != ''")
    run = F.sum((F.col("q") != "-").cast("int")).over(Window.partitionBy("query_id", "k").orderBy("p"))
    placed = pair.withColumn("i", F.col("q0") - 1 + run - 1).filter("q != '-'").select("query_id", "k", "i", F.col("s").alias("chr"))
    grid = h.select("query_id", "k", F.explode(F.sequence(F.lit(0), F.col("query_length") - 1)).alias("i"))
    full = grid.join(placed, ["query_id", "k", "i"], "left").withColumn("chr", F.coalesce("chr", F.lit("-")))
    query = hits.select("query_id", F.lit(0).alias("k"), "query_seq").distinct().select("query_id", "k", F.posexplode(F.split("query_seq", "")).alias("i", "chr")).filter("chr != ''")
    return query.unionByName(full).withColumnRenamed("query_id", "ali")


def sequence_of(cells: DataFrame, abc: Alphabet) -> DataFrame:
    """ali, k, letters: the codes of each row without gaps, in order."""
    s = F.sort_array(F.collect_list(F.struct("i", "a")))
    return cells.filter(F.col("a") <= abc.any).groupBy("ali", "k").agg(F.transform(s, lambda x: x["a"]).alias("letters"))


def column_entropies(f: DataFrame) -> DataFrame:
    return f.groupBy("ali", "i").agg((-F.sum(plogp(F.col("f")))).alias("h"))
