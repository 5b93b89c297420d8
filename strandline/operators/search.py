"""Profile construction and iterated profile search.

The search kernel is an ungapped scan: tiles of profiles meet blocks of sequences, sums run along all
diagonals at once, and the best segment of each diagonal is a pair. Another kernel, such as an external
program, is any function (profiles, database) -> hits.
"""

from __future__ import annotations

import math
import shlex
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.alphabets import Alphabet
from . import alignments, contexts, ranking


@dataclass(frozen=True)
class SearchOptions:
    """Settings of a search with their defaults; options that are not known go to the kernel as they are."""

    admix: float = 0.9
    admix_b: float = 12.0
    iterations: int = 1
    inclusion: float = 0.002
    most_hits: int = 500
    shift: float = -0.005
    best_only: bool = False
    global_weights: bool = False
    lam: float = math.log(2)
    k: float = 0.1
    passed: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, options: dict[str, str]) -> "SearchOptions":
        own = {"x": ("admix", float), "c": ("admix_b", float), "j": ("iterations", int), "h": ("inclusion", float), "v": ("most_hits", int), "shift": ("shift", float), "best": ("best_only", lambda v: v != "false"), "global-weights": ("global_weights", lambda v: v != "false")}
        known = {own[k][0]: own[k][1](v) for k, v in options.items() if k in own}
        return cls(**known, passed={k: v for k, v in options.items() if k not in own})


#: Profiles, and letters of the database, that one call of the scan meets at a time.
TILE, BLOCK = 256, 100_000


def _diagonals(profile: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, first row, last row) of the best segment of each diagonal d, which reads text[d + i] in row i.

    All diagonals go together, row by row. Of equal gains the one that ends first and begins first is taken.
    """
    m = len(profile)
    n = len(text) - m + 1
    run, best = np.zeros(n), np.zeros(n)
    begin, first, last = (np.zeros(n, np.int32) for _ in range(3))
    for i in range(m):
        low = run < 0
        run[low], begin[low] = 0.0, i
        run += profile[i, text[i : i + n]]
        up = run > best
        best[up], first[up], last[up] = run[up], begin[up], i
    return best, first, last


def _scan_block(kinds: list):
    """The segments of a tile of profiles (query, i, a, s) on a block of the database (target, pos, a)."""

    def run(scores, block):
        import pyarrow as pa

        names = ["query", "target", "diagonal", "score", "m", "q_start", "q_end"]
        if not scores.num_rows or not block.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        who, whose = (t.column(c).combine_chunks().dictionary_encode() for t, c in ((scores, "query"), (block, "target")))
        q, t = who.indices.to_numpy(), whose.indices.to_numpy()
        i, a, s = (scores.column(c).to_numpy() for c in ("i", "a", "s"))
        pos, letter = block.column("pos").to_numpy(), block.column("a").to_numpy()
        known = np.unique(a)
        code = np.minimum(np.searchsorted(known, letter), len(known) - 1)
        code = np.where(known[code] == letter, code, len(known))
        size = np.zeros(len(whose.dictionary), np.int64)
        np.maximum.at(size, t, pos + 1)
        out = []
        for k in range(len(who.dictionary)):
            own = q == k
            m = int(i[own].max()) + 1
            profile = np.zeros((m, len(known) + 1))
            profile[i[own], np.searchsorted(known, a[own])] = s[own]
            start = np.cumsum(size + m - 1) - size  # m - 1 voids stand before, between and after the targets
            text = np.full(int(start[-1] + size[-1]) + m - 1, len(known))
            text[start[t] + pos] = code
            gain, first, last = _diagonals(profile, text)
            d = np.flatnonzero(gain > 0)
            of = np.searchsorted(start, d + last[d], "right") - 1
            first = np.maximum(first[d], start[of] - d)
            out.append((np.full(len(d), k), of, d - start[of], gain[d], np.full(len(d), m), first, last[d]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        ids = [who.dictionary.take(pa.array(cols[0])), whose.dictionary.take(pa.array(cols[1]))]
        return pa.table([x.cast(k) for x, k in zip([*ids, *map(pa.array, cols[2:])], kinds, strict=True)], names)

    return run


def scan(scores: DataFrame, database: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
    """query, target, diagonal, score, evalue, q_start, q_end, t_start: best segment of each diagonal with a positive score.

    scores (query, i, a, s) in bits, database (target, pos, a). Positions count from 0, ends included; what has no score
    counts as 0. Tiles of profiles meet blocks of whole sequences, so letters are sent once a tile and profiles once a block.
    """
    n = database.count()
    tiles, blocks = max(1, math.ceil(scores.select("query").distinct().count() / TILE)), max(1, math.ceil(n / BLOCK))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = scores.select(deal("query", tiles).alias("tile"), every(blocks).alias("block"), "query", F.col("i").cast("int").alias("i"), F.col("a").cast("int").alias("a"), F.col("s").cast("double").alias("s"))
    right = database.select(every(tiles).alias("tile"), deal("target", blocks).alias("block"), "target", F.col("pos").cast("int").alias("pos"), F.col("a").cast("int").alias("a"))
    schema = StructType([StructField("query", scores.schema["query"].dataType), StructField("target", database.schema["target"].dataType), *[StructField(c, DoubleType() if c == "score" else IntegerType()) for c in ("diagonal", "score", "m", "q_start", "q_end")]])
    kinds = to_arrow_schema(schema).types
    out = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(_scan_block(kinds), schema)
    e = F.lit(o.k) * F.col("m") * F.lit(float(n)) * F.exp(-F.lit(o.lam) * F.col("score"))
    return out.select("query", "target", "diagonal", "score", e.alias("evalue"), "q_start", "q_end", (F.col("q_start") + F.col("diagonal")).alias("t_start"))


def as_hits(found: DataFrame, queries: DataFrame, database: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
    """Nested hits (query_id, query_length, query_seq, oid, definition, evalue, bit_score, hsps) of scan rows; seq texts in both tables."""
    f = found.join(queries.select(F.col("id").alias("query"), F.col("seq").alias("query_seq")), "query").join(database.select(F.col("id").alias("target"), F.col("seq").alias("t_seq")), "target")
    n = F.col("q_end") - F.col("q_start") + 1
    hsp = F.struct(F.col("score").alias("bit_score"), "evalue", (F.col("q_start") + 1).alias("q_start"), (F.col("q_end") + 1).alias("q_end"), (F.col("t_start") + 1).alias("s_start"), (F.col("t_start") + n).alias("s_end"), F.expr("substring(query_seq, q_start + 1, q_end - q_start + 1)").alias("q_seq"), F.expr("substring(t_seq, t_start + 1, q_end - q_start + 1)").alias("s_seq"), n.alias("length"))
    h = f.groupBy("query", "query_seq", "target").agg(F.min("evalue").alias("evalue"), F.max("score").alias("bit_score"), F.sort_array(F.collect_list(F.struct("evalue", (-F.col("score")).alias("m"), "diagonal", hsp.alias("hsp")))).alias("x"))
    h = h.withColumn("oid", F.row_number().over(Window.partitionBy("query").orderBy("evalue", F.col("bit_score").desc(), "target"))).filter(F.col("oid") <= o.most_hits)
    return h.select(F.col("query").alias("query_id"), F.length("query_seq").alias("query_length"), "query_seq", "oid", F.col("target").cast("string").alias("definition"), "evalue", "bit_score", F.transform("x", lambda y: y["hsp"]).alias("hsps"))


def sequence_profile(cells: DataFrame, predict: Callable[[DataFrame], DataFrame], abc: Alphabet, o: SearchOptions) -> DataFrame:
    """id, pos, a, p of single sequences (id, pos, a), mixed with predicted columns at a constant rate."""
    return contexts.admixed_sequence(cells, predict(cells), contexts.constant(o.admix), abc.size)


def alignment_profile(cells: DataFrame, abc: Alphabet, o: SearchOptions, predict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, pos, a, p of alignments (ali, k, i, a): weights, counts, and predicted columns mixed by effective numbers."""
    c = alignments.mark_end_gaps(cells, abc)
    if o.global_weights:
        w = alignments.global_weights(c, abc)
        neff = alignments.diversity(c, w, abc)
        counts = alignments.count_profile(c, w, neff, abc)
        columns = counts.select("ali", "i").distinct().join(neff, "ali")
    else:
        w, columns = alignments.position_weights(c, abc)
        s = c.filter(F.col("a") < abc.any).join(w, ["ali", "i", "k"]).groupBy("ali", "i", "a").agg(F.sum("w").alias("s"))
        t = s.groupBy("ali", "i").agg(F.sum("s").alias("t"))
        counts = s.join(t, ["ali", "i"]).join(columns, ["ali", "i"]).select("ali", "i", "a", F.when(F.col("t") > 0, F.col("s") * F.col("neff") / F.col("t")).otherwise(F.lit(0.0)).alias("v"))
    counts, columns = counts.select(F.col("ali").alias("id"), F.col("i").alias("pos"), "a", "v"), columns.select(F.col("ali").alias("id"), F.col("i").alias("pos"), "neff")
    if predict is None:
        return counts.join(columns, ["id", "pos"]).select("id", "pos", "a", (F.col("v") / F.col("neff")).alias("p"))
    return contexts.admixed_profile(counts, columns, predict(counts), contexts.decreasing(o.admix, o.admix_b))


def log_odds_bits(profile: DataFrame, background: DataFrame, shift: float = 0.0) -> DataFrame:
    """query, i, a, s: log2 of shares over background, all raised by shift."""
    return profile.join(background.select("a", F.col("p").alias("bg")), "a").filter("p > 0").select(F.col("id").alias("query"), F.col("pos").alias("i"), "a", (F.log2(F.col("p") / F.col("bg")) + F.lit(float(shift))).alias("s"))


def iterate(queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], profile: Callable[[DataFrame], DataFrame], o: SearchOptions) -> tuple[DataFrame, list[int]]:
    """Search, cut the hit lists, merge into alignments, build profiles again, until all lists repeat or rounds are over.

    search(profiles, round) gives nested hits, profile(alignment cells or None) gives profiles. All queries go together;
    each round's hits are checkpointed. Returns the last hits and how many lists changed in each round.
    """
    now, changed, profiles = None, [], profile(None)
    for r in range(o.iterations):
        hits = ranking.prefix_filter(search(profiles, r), o.inclusion, ["query_id"], ["oid"]).checkpoint()
        if now is not None:
            n = ranking.converged(now, hits).filter("not same").count()
            changed.append(n)
            if not n:
                now = hits
                break
        now = hits
        if hits.isEmpty() or r + 1 == o.iterations:
            break
        profiles = profile(alignments.from_hits(hits, o.best_only)).checkpoint()
    return now, changed


def external(command: str, report: Callable[[str], list[dict]], o: SearchOptions) -> Callable[[str], list[dict]]:
    """A kernel that runs a program once for each text given to it, with the options passed through."""
    extra = [x for k, v in o.passed.items() for x in (f"-{k}", v)]

    def run(text: str) -> list[dict]:
        out = subprocess.run([*shlex.split(command), *extra], input=text, capture_output=True, text=True, check=True)
        return report(out.stdout)

    return run
