"""K-mers, distances, repeats, training windows and samples of sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def letter_totals(df: DataFrame, key: str, text: str, abc) -> DataFrame:
    """key, a, n: letters of whole texts by key, any case; aliases count as what they are read as.

    Letters are single bytes, so a batch is counted by one pass over its bytes; tasks send sums only.
    """
    table = [-1] * 256
    for c, k in abc.codes().items():
        if k <= abc.any:
            table[ord(c)] = table[ord(c.lower())] = k
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code, total = np.array(table), {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            names = [*keys.dictionary.to_pylist(), None]
            of = keys.indices.fill_null(len(names) - 1)
            for k in np.unique(of.to_numpy(zero_copy_only=False)).tolist():
                own = "".join(batch.column(1).filter(pc.equal(of, k)).drop_null().to_pylist()).encode()
                n = np.bincount(np.frombuffer(own, np.uint8), minlength=256)
                total[names[k]] = total.get(names[k], 0) + n
        rows = [(k, a, int(n[code == a].sum())) for k, n in total.items() for a in range(abc.any + 1)]
        names, a, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, batch_type(kind)), pa.array(a, pa.int32()), pa.array(n, pa.int64())], [key, "a", "n"])

    def batch_type(name):
        import pyarrow as pa

        return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, a int, n long").groupBy(key, "a").agg(F.sum("n").alias("n"))


def kmer_length(median_length: float, size: int) -> int:
    return 1 + int(math.floor(math.log(median_length) / math.log(size) + 0.5))


def kmer_counts(seqs: DataFrame, k: int, seq: str = "seq", id_col: str = "id") -> DataFrame:
    """id, kmer, n: windows of k letters; the last window is left out (length - k of them)."""
    own = seqs.filter(F.length(seq) > k)
    return own.select(id_col, F.explode(F.transform(F.sequence(F.lit(1), F.length(seq) - k), lambda p: F.substring(F.col(seq), p, F.lit(k)))).alias("kmer")).groupBy(id_col, "kmer").agg(F.count(F.lit(1)).alias("n"))


#: Rows of a block that meets others, blocks of a group (a row is sent once to each), and rows of a tile that is compared at a time.
SIDE, BLOCKS, AT_ONCE = 8192, 16, 1024
#: Columns of a matrix of ones, positions of a block of a sequence, and of a run of them that meets its neighbours at a time.
WIDE, STRETCH, RUN = 4096, 8192, 256


def block_pairs(rows: DataFrame, id_col: str, group: str | None = None) -> DataFrame:
    """rows with bi <= bj, a pair of blocks of their group, and own, the one of them that a row is of; dealt out by pair.

    Every two rows of a group are in one pair of blocks, and rows of one id in one block. Null ids and groups meet nothing.
    """
    rows = rows.filter(F.col(id_col).isNotNull() if group is None else F.col(id_col).isNotNull() & F.col(group).isNotNull())
    parts = F.least(F.ceil(F.count(F.lit(1)) / F.lit(SIDE)), F.lit(BLOCKS)).cast("int").alias("parts")
    sized = rows.crossJoin(F.broadcast(rows.agg(parts))) if group is None else rows.join(rows.groupBy(group).agg(parts), group)  # one row
    sized = sized.withColumn("own", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = [*([group] if group else []), "bi", "bj"]
    sized = sized.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("parts", "other")
    return sized.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tiles(own: np.ndarray, bi: int, bj: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of runs of rows of block bi and of block bj that cover all pairs of rows, of one block in one order at least."""
    left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
    for x in range(0, len(left), AT_ONCE):
        for y in range(x if bi == bj else 0, len(right), AT_ONCE):
            yield left[x : x + AT_ONCE], right[y : y + AT_ONCE]


def kmer_distances(counts: DataFrame, id_col: str = "id") -> DataFrame:
    """a, b, shared, distance: 1 - shared k-mers (with repeats) over those of the shorter one, for pairs that share any.

    A row a sequence goes to pairs of blocks, where tiles are matrix products: a k-mer that occurs n times is n
    columns of ones, so a product of two rows is the sum of the smaller counts. Only pairs leave a task.
    """
    kind = counts.schema[id_col].dataType.simpleString()
    rows = counts.groupBy(id_col).agg(F.collect_list("kmer").alias("kmers"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        t = pa.Table.from_batches(list(batches))
        t = t.take(pc.sort_indices(t.column(id_col)))
        ids, lists = t.column(id_col).combine_chunks(), t.column("kmers").combine_chunks()
        code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = t.column("ns").combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        total = np.bincount(row, n, len(ids)).astype(np.int64)
        # (k-mer, its so many-th time) as a column
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row, code = np.repeat(row, n), np.unique(np.repeat(code, n) << 32 | turn, return_inverse=True)[1]
        first = np.searchsorted(row, np.arange(len(ids) + 1))

        def cells(some):
            at = np.concatenate([np.arange(first[k], first[k + 1]) for k in some.tolist()])
            return np.searchsorted(some, row[at]), code[at]

        def ones(r, c, size, columns):
            out, at = np.zeros((size, len(columns)), np.float32), np.minimum(np.searchsorted(columns, c), len(columns) - 1)
            here = columns[at] == c
            out[r[here], at[here]] = 1
            return out

        for x, y in tiles(t.column("own").to_numpy(), t.column("bi")[0].as_py(), t.column("bj")[0].as_py()):
            (rx, cx), (ry, cy) = cells(x), cells(y)
            both, shared = np.intersect1d(cx, cy), np.zeros((len(x), len(y)))
            for k in range(0, len(both), WIDE):
                shared += ones(rx, cx, len(x), both[k : k + WIDE]) @ ones(ry, cy, len(y), both[k : k + WIDE]).T
            if t.column("bi")[0] == t.column("bj")[0]:
                shared[x[:, None] >= y] = 0
            i, j = np.nonzero(shared)
            s, i, j = shared[i, j].astype(np.int64), x[i], y[j]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.minimum(i, j))), ids.take(pa.array(np.maximum(i, j))), pa.array(s), pa.array(1.0 - s / np.minimum(total[i], total[j]))], ["a", "b", "shared", "distance"])

    return block_pairs(rows, id_col).groupBy("bi", "bj").applyInArrow(run, f"a {kind}, b {kind}, shared long, distance double")


# Accepted point mutations of 100 letters for 75.0, 75.1, ..., 93.0 % of differing letters.
PAMS = (
    195, 196, 197, 198, 199, 200, 200, 201, 202, 203, 204, 205, 206, 207, 208, 209, 209, 210, 211, 212,
    213, 214, 215, 216, 217, 218, 219, 220, 221, 222, 223, 224, 226, 227, 228, 229, 230, 231, 232, 233,
    234, 236, 237, 238, 239, 240, 241, 243, 244, 245, 246, 248, 249, 250, 252, 253, 254, 255, 257, 258,
    260, 261, 262, 264, 265, 267, 268, 270, 271, 273, 274, 276, 277, 279, 281, 282, 284, 285, 287, 289,
    291, 292, 294, 296, 298, 299, 301, 303, 305, 307, 309, 311, 313, 315, 317, 319, 321, 323, 325, 328,
    330, 332, 335, 337, 339, 342, 344, 347, 349, 352, 354, 357, 360, 362, 365, 368, 371, 374, 377, 380,
    383, 386, 389, 393, 396, 399, 403, 407, 410, 414, 418, 422, 426, 430, 434, 438, 442, 447, 451, 456,
    461, 466, 471, 476, 482, 487, 493, 498, 504, 511, 517, 524, 531, 538, 545, 553, 560, 569, 577, 586,
    595, 605, 615, 626, 637, 649, 661, 675, 688, 703, 719, 736, 754, 775, 796, 819, 845, 874, 907, 945,
    988,
)


def kimura(p):
    """Distance of a share of differing letters: -ln(1 - p - p * p / 5) below 0.75, a table of mutations to 0.93, 10 above."""
    at = F.floor((p - F.lit(0.75)) * 1000 + F.lit(0.5)).cast("int") + 1
    table = F.element_at(F.array(*[F.lit(x) for x in PAMS]), F.greatest(at, F.lit(1))) / F.lit(100.0)
    return F.when(p.isNull(), F.lit(None)).when(p < F.lit(0.75), -F.ln(F.lit(1.0) - p - p * p / F.lit(5.0))).when(p > F.lit(0.93), F.lit(10.0)).otherwise(table)


def kimura_distances(cells: DataFrame, size: int) -> DataFrame:
    """ali, x, y, d of all rows x < y of an alignment; 10 where no column has a letter of both."""
    letter = (F.col("a") < size) & F.col("i").isNotNull()
    return kimura_row_distances(cells.groupBy("ali", "k").agg(F.collect_list(F.when(letter, F.col("i").cast("long"))).alias("i"), F.collect_list(F.when(letter, F.col("a").cast("int"))).alias("a")), size)


def kimura_row_distances(rows: DataFrame, size: int) -> DataFrame:
    """The same for rows (ali, k, a), where a is the array of letters, and i that of their columns (0, 1, ... without i)."""
    return aligned_differences(rows, size).select("ali", "x", "y", F.coalesce(kimura(F.col("p")), F.lit(10.0)).alias("d"))


def aligned_differences(rows: DataFrame, size: int) -> DataFrame:
    """ali, x, y, p: the share of differing letters over columns where both rows have one, null without such a column; rows x < y of an alignment.

    Rows go to pairs of blocks; the columns and the equal letters of two rows are products of their ones. Only pairs leave a task.
    """
    ali, k = (rows.schema[c].dataType.simpleString() for c in ("ali", "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        t = pa.Table.from_batches(list(batches))
        t = t.take(pc.sort_indices(t.column("k")))
        code = t.column("k").combine_chunks().dictionary_encode()
        ids, name, lists = code.dictionary, code.indices.to_numpy(zero_copy_only=False).astype(np.int64), t.column("a").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        at = t.column("i").combine_chunks().flatten().to_numpy() if "i" in t.column_names else np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, row = lists.flatten().fill_null(size).to_numpy(), np.repeat(name, n)
        columns, at = np.unique(at, return_inverse=True)
        row, at, a = row[a < size], at[a < size], a[a < size].astype(np.int64)
        order = np.argsort(row, kind="stable")
        row, at, a = row[order], at[order], a[order]
        own = np.zeros(len(ids), np.int64)
        own[name] = t.column("own").to_numpy()

        # Rows of one block are not next to each other; the cells of a run of rows are.
        block = {b: np.flatnonzero(own == b) for b in {t.column("bi")[0].as_py(), t.column("bj")[0].as_py()}}
        new = np.zeros(len(ids), np.int64)
        new[np.concatenate(list(block.values()))] = np.arange(len(ids))
        order = np.argsort(new[row], kind="stable")
        row, at, a = new[row][order], at[order], a[order]

        def matrices(some, start, stop):
            """Of a run of rows the ones of columns with a letter, and of letters of columns."""
            x, y = np.searchsorted(row, [new[some[0]], new[some[-1]] + 1])
            here = (at[x:y] >= start) & (at[x:y] < stop)
            r, c, v = row[x:y][here] - new[some[0]], at[x:y][here] - start, a[x:y][here]
            one, each = np.zeros((len(some), stop - start), np.float32), np.zeros((len(some), (stop - start) * size), np.float32)
            np.add.at(one, (r, c), 1)
            np.add.at(each, (r, c * size + v), 1)
            return one, each

        same, step = t.column("bi")[0] == t.column("bj")[0], max(1, WIDE // size)
        for x, y in tiles(own, t.column("bi")[0].as_py(), t.column("bj")[0].as_py()):
            both, equal = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
            for start in range(0, len(columns), step):
                (cx, lx), (cy, ly) = (matrices(z, start, min(start + step, len(columns))) for z in (x, y))
                both += cx @ cy.T
                equal += lx @ ly.T
            i, j = np.nonzero(x[:, None] < y) if same else (z.ravel() for z in np.indices(both.shape))
            both, equal, i, j = both[i, j], equal[i, j], x[i], y[j]
            p = pa.array((both - equal) / np.maximum(both, 1), mask=both == 0)
            yield pa.RecordBatch.from_arrays([pa.repeat(t.column("ali")[0], len(i)), ids.take(pa.array(np.minimum(i, j))), ids.take(pa.array(np.maximum(i, j))), p], ["ali", "x", "y", "p"])

    return block_pairs(rows, "k", "ali").groupBy("ali", "bi", "bj").applyInArrow(run, f"ali {ali}, x {k}, y {k}, p double")


def repeat_scores(pp: DataFrame, prior: DataFrame, reach: int = 100, least: float = 0.02, min_score: float = 0.0, id_col: str = "id") -> DataFrame:
    """id, i, j, s: log2 of the summed products of two positions' posteriors over priors, positions at most reach apart.

    Only posteriors of at least `least` take part, and pairs meet on the state, so few offsets arise.
    """
    own = pp.filter(F.col("pp") >= F.lit(least)).select(id_col, "pos", "k", "pp")
    left, right = own.toDF(id_col, "i", "k", "x"), own.toDF(id_col, "j", "k", "y")
    s = left.join(right, [id_col, "k"]).filter((F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= reach)).join(prior.select("k", "prior"), "k")
    return s.groupBy(id_col, "i", "j").agg(F.log2(F.sum(F.col("x") * F.col("y") / F.col("prior"))).alias("s")).filter(F.col("s") >= F.lit(float(min_score)))


def repeat_penalty(scores: DataFrame, alpha: float = 0.0, beta: float = 0.1, id_col: str = "id") -> DataFrame:
    """id, pos, scale: 2 ** -(alpha + beta * sqrt of the summed scores of a position)."""
    return repeat_scale(scores.groupBy(id_col, F.col("i").alias("pos")).agg(F.sum("s").alias("total")), alpha, beta, id_col)


def repeat_scale(sums: DataFrame, alpha: float = 0.0, beta: float = 0.1, id_col: str = "id") -> DataFrame:
    """id, pos, scale of the summed scores `total` of positions."""
    return sums.select(id_col, "pos", F.pow(F.lit(2.0), -(F.lit(float(alpha)) + F.lit(float(beta)) * F.sqrt("total"))).alias("scale"))


def repeat_sums(pp: DataFrame, prior: DataFrame, reach: int = 100, least: float = 0.02, min_score: float = 0.0, id_col: str = "id") -> DataFrame:
    """id, pos, total: the sums of repeat_scores over j for each i, for wide reaches: no row for a pair is made.

    Stretches of a sequence, with what is in reach of them, are sorted within a task; runs of positions meet their
    neighbours as products of posteriors. A stretch has a bound, however long its sequence.
    """
    kind = pp.schema[id_col].dataType.simpleString()
    own = pp.filter((F.col("pp") >= F.lit(least)) & F.col(id_col).isNotNull()).join(prior.select("k", "prior"), "k").select(id_col, F.col("pos").cast("long").alias("pos"), F.col("k").cast("long").alias("k"), "pp", (F.col("pp") / F.col("prior")).alias("odds"))
    at = lambda p: F.floor(p / F.lit(STRETCH))
    own = own.withColumn("stretch", F.explode(F.sequence(at(F.col("pos") - reach), at(F.col("pos") + reach)))).filter(F.col("stretch") >= at(F.lit(0)))
    own = own.withColumn("mine", F.col("stretch") == at(F.col("pos"))).repartition(id_col, "stretch").sortWithinPartitions(id_col, "stretch", "pos")

    def sums(t: pa.RecordBatch) -> pa.RecordBatch:
        """Of whole stretches: those one after the other are out of each other's reach."""
        name, stretch, pos, k = t.column(id_col).dictionary_encode(), *(t.column(c).to_numpy() for c in ("stretch", "pos", "k"))
        new = np.append(True, (np.diff(name.indices.to_numpy()) != 0) | (np.diff(stretch) != 0))
        line = pos - np.minimum.reduceat(pos, np.flatnonzero(new))[np.cumsum(new) - 1]
        end = np.maximum.reduceat(line, np.flatnonzero(new)) + reach + 1
        line = line + (np.cumsum(end) - end)[np.cumsum(new) - 1]
        where, first, r = np.unique(line, return_index=True, return_inverse=True)
        state, c = np.unique(k, return_inverse=True)
        total, hit = np.zeros(len(where)), np.zeros(len(where), bool)
        cell = np.append(first, len(line))

        def dense(lo, hi, value):
            out, at = np.zeros((hi - lo, len(state))), slice(cell[lo], cell[hi])
            np.add.at(out, (r[at] - lo, c[at]), value[at])
            return out

        x, y = t.column("pp").to_numpy(), t.column("odds").to_numpy()
        for lo in range(0, len(where), RUN):
            hi = min(lo + RUN, len(where))
            a, b = np.searchsorted(where, [where[lo] - reach, where[hi - 1] + reach + 1])
            s, gap = dense(lo, hi, x) @ dense(a, b, y).T, np.abs(where[lo:hi, None] - where[a:b])
            with np.errstate(divide="ignore"):
                s = np.log2(s)
            ok = (gap > 0) & (gap <= reach) & (s >= min_score) & (s > -np.inf)
            total[lo:hi], hit[lo:hi] = np.where(ok, s, 0.0).sum(1), ok.any(1)
        keep = np.flatnonzero(hit & t.column("mine").to_numpy(zero_copy_only=False)[first])
        return pa.RecordBatch.from_arrays([t.column(id_col).take(pa.array(first[keep])), pa.array(pos[first[keep]]), pa.array(total[keep])], [id_col, "pos", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 100_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            name, stretch = t.column(id_col).dictionary_encode().indices.to_numpy(), t.column("stretch").to_numpy()
            cut = int(np.flatnonzero((name != name[-1]) | (stretch != stretch[-1]))[-1]) + 1 if name[0] != name[-1] or stretch[0] != stretch[-1] else 0
            if cut:
                yield sums(t.slice(0, cut))
            held, rows = [t.slice(cut)], t.num_rows - cut
        if rows:
            yield sums(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return own.mapInArrow(run, f"{id_col} {kind}, pos long, total double").withColumn("pos", F.col("pos").cast(pp.schema["pos"].dataType))


def full_windows(cells: DataFrame, width: int, keys: list[str], pos: str = "pos", bad=None) -> DataFrame:
    """keys, start, letters: windows of exactly `width` consecutive positions, none of them bad.

    The frame is the next positions of the same sequence, so a window is complete if it spans width.
    """
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, width - 1)
    b = F.lit(False) if bad is None else bad
    out = cells.withColumns({"_l": F.collect_list("a").over(w), "_end": F.max(pos).over(w), "_bad": F.max(b.cast("int")).over(w)})
    return out.filter((F.size("_l") == width) & (F.col("_end") - F.col(pos) == width - 1) & (F.col("_bad") == 0)).select(*keys, F.col(pos).alias("start"), F.col("_l").alias("letters"))


def neff_pairs(x: DataFrame, y: DataFrame, dmin: float, dmax: float, id_col: str = "id") -> DataFrame:
    """Pairs of profiles of one id whose effective numbers differ by dmin to dmax."""
    return x.toDF(id_col, "rx", "nx").join(y.toDF(id_col, "ry", "ny"), id_col).filter((F.col("ny") - F.col("nx")).between(float(dmin), float(dmax)))


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).between(float(low), float(high)))


def first_round(df: DataFrame, id_col: str = "id", order: str = "round") -> DataFrame:
    """The first qualifying round of each id."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).filter("_n = 1").drop("_n")


def shuffled(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """Rows with `rank_key`, a hash of the key and a seed; ordering by it is a reproducible shuffle."""
    return df.withColumn("rank_key", F.xxhash64(F.lit(seed), *key))


def proportional_sample(windows: DataFrame, n: int, most: int, keys: list[str], item: str, seed: int = 0) -> DataFrame:
    """ceil(n * min(most, windows of the profile) / pool) windows of each profile, by hash rank."""
    per = windows.groupBy(*keys).agg(F.least(F.lit(most), F.count(F.lit(1))).alias("v"))
    pool = per.agg(F.sum("v").alias("pool"))
    quota = per.crossJoin(F.broadcast(pool)).select(*keys, F.ceil(F.lit(float(n)) * F.col("v") / F.col("pool")).alias("quota"))  # one row
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, item), item))
    return windows.join(quota, keys).withColumn("_r", r).filter("_r <= quota").drop("_r", "quota")


def neff_quota_sample(pairs: DataFrame, n: int, keys: list[str], neff: str, items: list[str], surplus: float = 1.1, seed: int = 0) -> DataFrame:
    """Valid (column, row) pairs of each alignment, as many as its share of all effective numbers of n, with a surplus."""
    share = pairs.select(*keys, neff).distinct()
    total = share.agg(F.sum(neff).alias("total"))
    quota = share.crossJoin(F.broadcast(total)).select(*keys, F.ceil(F.lit(float(n * surplus)) * F.col(neff) / F.col("total")).alias("quota"))  # one row
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, *items), *items))
    return pairs.join(quota, keys).withColumn("_r", r).filter("_r <= quota").drop("_r", "quota")


def used_share(columns: DataFrame, used: DataFrame, id_col: str = "id", pos: str = "i") -> DataFrame:
    """mean, sd (population), min and max of the share of each profile's columns that a sample uses."""
    n = columns.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    u = used.select(id_col, pos).distinct().groupBy(id_col).agg(F.count(F.lit(1)).alias("u"))
    s = n.join(u, id_col, "left").select((F.coalesce("u", F.lit(0)).cast("double") / F.col("n")).alias("s"))
    return s.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), F.min("s").alias("least"), F.max("s").alias("most"))


def one_hot_central(y: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, y: all mass on the largest entry (lowest code of equals)."""
    top = y.groupBy(*keys).agg((-F.max(F.struct("y", (-F.col("a")).alias("m")))["m"]).alias("m"))
    return y.join(top, keys).select(*keys, "a", F.when(F.col("a") == F.col("m"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("y"))


def state_substitutions(pairs: DataFrame, pp: DataFrame, targets: DataFrame, least: float = 0.0) -> DataFrame:
    """k, s, n: summed posteriors of query states k against target states s over aligned pairs that are no self-pairs.

    pairs (query, target, i, j, confidence), pp (id, pos, k, pp), targets (id, pos, s).
    """
    p = pairs.filter((F.col("query") != F.col("target")) & (F.col("confidence") >= F.lit(float(least))))
    q = pp.select(F.col("id").alias("query"), F.col("pos").alias("i"), "k", "pp")
    t = targets.select(F.col("id").alias("target"), F.col("pos").alias("j"), "s")
    return p.join(q, ["query", "i"]).join(t, ["target", "j"]).groupBy("k", "s").agg(F.sum("pp").alias("n"))


def sparse(column: DataFrame, keys: list[str], cutoff: float, most: int = 255) -> DataFrame:
    """Entries of at least the cutoff, the largest in any case, at most `most` by size."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("p").desc(), "a"))
    return column.withColumn("_r", r).filter((F.col("_r") == 1) | ((F.col("p") >= F.lit(cutoff)) & (F.col("_r") <= most))).drop("_r")
