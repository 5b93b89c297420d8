"""Removal of repeated 50-byte strings with bucket-pointer suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.
Equal strings have equal smallest q-gram hashes (minimisers), so consecutive windows with one
minimiser form a run, and runs are dealt out by their minimiser: all equal strings meet. In steps,
each of which moves packed arrays, one row for a pair of chunk (of documents) and bucket (of hashes):

1. each chunk sends its distinct minimisers; a bucket answers which of them two documents have;
2. each chunk sends the texts of such runs, equal texts once (for the smallest id; the repeats of the
   chunk are decided there and then), so a passage in any number of documents is sent once a chunk;
3. a bucket sorts the suffixes of its texts by bucket-pointer refinement: initial q-gram buckets are
   refined by sorting on the bucket pointers of later offsets, and updated pointers are reused recursively,
   until buckets are known to `length` bytes; the smallest id of a bucket keeps it, all others give it up;
4. each chunk merges what it gets back and cuts its documents.

The text is exchanged once: all steps group the same exchange of documents by chunk. Nothing is broadcast or collected.

Nulls and texts shorter than `length` lose nothing. Rows with equal ids are not smaller than each
other; a null id counts as the largest. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, buckets_for, col, mix, packed8, ranges, table, text_buffers

LENGTH, GRAM, PIECE = 50, 20, 1 << 18
NO_ID = (1 << 63) - 1


def minimisers(b: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window start the smallest hash of the grams of its window."""
    x = packed8(b)
    last = gram - 8
    h = x[: len(x) - last] * U(0x9E3779B97F4A7C15)
    for k in range(8, last, 8):
        h = (h ^ x[k : k + len(h)]) * U(0xC2B2AE3D27D4EB4F)
        h ^= h >> U(29)
    h = mix(h ^ (x[last:] * U(0xD6E8FEB86659FD93)))
    wide, n = length - gram + 1, 1
    while 2 * n <= wide:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (wide - n)], h[wide - n :]) if wide > n else h


def runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
    """(text, first window start in the text, number of window starts, minimiser) of all runs of all texts."""
    out = []
    todo, held = [], 0

    def flush():
        texts = np.array([t for t, _, _ in todo])
        lo, hi = np.array([a for _, a, _ in todo]), np.array([z for _, _, z in todo])
        size = hi - lo
        b = np.concatenate([raw[a:z] for _, a, z in todo])
        at = np.cumsum(size) - size
        m = minimisers(b, length, gram)
        new = np.empty(len(m), bool)
        new[0], new[1:] = True, m[1:] != m[:-1]
        new[at] = True
        stop = at + size - length + 1  # first position that is no window start
        new[stop[stop < len(m)]] = True
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(m)))
        of = np.searchsorted(at, first, "right") - 1
        ok = first < stop[of]
        first, n, of = first[ok], n[ok], of[ok]
        out.append((texts[of], first - at[of] + lo[of] - start[texts[of]], n, m[first]))

    for t in np.flatnonzero(end - start >= length).tolist():
        for a in range(int(start[t]), int(end[t]) - length + 1, piece):
            z = min(int(end[t]), a + piece + length - 1)
            todo.append((t, a, z))
            held += z - a
            if held >= piece:
                flush()
                todo, held = [], 0
    if todo:
        flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sorted_triples(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, place) in ascending order of (a, b); all values are below most. One sort of packed words where they fit."""
    bits = max(1, int(most).bit_length())
    if 3 * bits <= 64:
        x = np.sort(a.astype(U) << U(2 * bits) | b.astype(U) << U(bits) | np.arange(len(a), dtype=U))
        mask = U((1 << bits) - 1)
        return (x >> U(2 * bits)).astype(np.int64), (x >> U(bits) & mask).astype(np.int64), (x & mask).astype(np.int64)
    order = np.lexsort((b, a))
    return a[order], b[order], order


#: Bytes of the initial buckets, and the parts in which buckets are refined, one part to the end before the next.
Q_BYTES, TURNS = 5, 6


def suffix_buckets(text: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the strings of `depth` bytes that start at the positions `at`, equal if the strings are.

    end: for each position of text the end of its string. Positions of `at` have depth bytes left.
    All suffixes fall into initial buckets by their first bytes; a suffix points at its bucket, the rank of the
    bucket's first suffix. A bucket whose suffixes share `known` bytes is refined by the pointers that are `known`
    bytes later, and its suffixes' pointers are updated at once; its parts are refined in the same way until they
    are single or known to `depth`. Buckets are refined in some turns, in their order: what a turn has
    updated, known to many bytes, is reused by itself and by the turns behind it, whose recursion ends sooner.
    """
    n = len(text)
    eight = packed8(np.concatenate([text, np.zeros(7, np.uint8)]))
    key = eight >> U(8 * (8 - Q_BYTES))
    high, low, order = _sorted_triples(key >> U(20), key & U((1 << 20) - 1), max(n, 1 << 20))
    head = np.empty(n, bool)
    head[:1], head[1:] = True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    # Behind the text there is a bucket of its own, smaller than all.
    pointer, known = np.zeros(n + 1, np.int64), np.full(n + 1, Q_BYTES, np.int64)
    pointer[order], known[n] = np.flatnonzero(head)[np.cumsum(head) - 1] + 1, 1 << 40
    wanted = np.minimum(end - np.arange(n), depth)
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, n))
    open_ = (size > 1) & (np.maximum.reduceat(wanted[order], first) > Q_BYTES) if n else np.zeros(0, bool)
    todo, upto = order[np.repeat(open_, size)], np.cumsum(size[open_])
    cuts = [0, *(int(upto[min(np.searchsorted(upto, len(todo) * k // TURNS), len(upto) - 1)]) for k in range(1, TURNS + 1))] if len(todo) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        live = todo[lo:hi]
        while len(live):
            later = np.minimum(live + known[live], n)
            p, q, place = _sorted_triples(pointer[live], pointer[later], n + 1)
            fresh = np.empty(len(live), bool)
            fresh[:1], fresh[1:] = True, p[1:] != p[:-1]
            head = fresh.copy()
            head[1:] |= q[1:] != q[:-1]
            first, begin = np.flatnonzero(head), np.flatnonzero(fresh)
            size = np.diff(np.append(first, len(live)))
            later = later[place]
            deep = known[live[place[first]]] + np.minimum.reduceat(known[later], first)
            live = live[place]
            pointer[live] = p + np.repeat(first, size) - begin[np.cumsum(fresh) - 1]
            known[live] = np.repeat(deep, size)
            live = live[np.repeat((size > 1) & (np.maximum.reduceat(wanted[live], first) > deep), size)]
    # Suffixes are in order now as far as `depth`, some farther: equal strings are neighbours, and are told by their bytes.
    order = np.argsort(pointer[at], kind="stable")
    a, same = at[order], np.ones(max(0, len(at) - 1), bool)
    for k in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        x = eight[a + k]
        same &= x[1:] == x[:-1]
    first = np.flatnonzero(np.append(True, ~same)) if len(a) else np.zeros(0, np.int64)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(first, np.diff(np.append(first, len(a))))
    return out


def _pack(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _join(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, number of values of each)."""
    parts = [np.frombuffer(x.as_py(), kind) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(x) for x in parts], np.int64)


def _documents(t) -> tuple:
    """A chunk's rows in a fixed order: (ids, bytes, start, end, the table's row of each)."""
    import pyarrow.compute as pc

    ids = pc.fill_null(t.column("d"), NO_ID).to_numpy()
    order = np.lexsort((t.column("h").to_numpy(), ids))
    raw, start, end = text_buffers(t.column("t"))
    return ids[order], raw, start[order], end[order], order


def _split(key: np.ndarray, count: int):
    """(value, positions) for each value of key, ascending."""
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    for v, a, z in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield v, order[a:z]


def _send_hashes(buckets: int, length: int, gram: int):
    def send(t):
        import pyarrow as pa

        _, raw, start, end, _ = _documents(t)
        of, _, _, m = runs(raw, start, end, length, gram)
        order = np.lexsort((of, m))
        of, m = of[order], m[order]
        other = np.ones(len(m), bool)
        other[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1])
        m, n = np.unique(m[other], return_counts=True)
        rows = [(b, _pack(m[at], U), _pack(n[at] > 1, np.uint8)) for b, at in _split((m % U(buckets)).astype(np.int64), buckets)]
        chunk = t.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "m": pa.array([r[1] for r in rows], pa.binary()), "two": pa.array([r[2] for r in rows], pa.binary())})

    return send


def _answer(t):
    import pyarrow as pa

    m, n = _join(t.column("m"), U)
    two, _ = _join(t.column("two"), np.uint8)
    values, of, count = np.unique(m, return_inverse=True, return_counts=True)
    hot = count > 1
    hot[of[two > 0]] = True
    keep, ends = hot[of], np.cumsum(n)
    found = [(c, _pack(m[a:z][keep[a:z]], U)) for c, a, z in zip(t.column("chunk").to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True)]
    found = [x for x in found if x[1]]
    return pa.table({"chunk": pa.array([x[0] for x in found], pa.int32()), "m": pa.array([x[1] for x in found], pa.binary())})


SENT = "bucket int, chunk int, texts binary, sizes binary, ids binary, part binary, own_text binary, own_doc binary, own_at binary, done binary"


def _send_texts(buckets: int, length: int, gram: int):
    def send(t, wanted):
        import pyarrow as pa
        import zstandard

        rows = []
        if t.num_rows and wanted.num_rows:
            ids, raw, start, end, _ = _documents(t)
            hot = np.sort(_join(wanted.column("m"), U)[0])
            of, first, n, m = runs(raw, start, end, length, gram)
            at = np.minimum(np.searchsorted(hot, m), len(hot) - 1)
            keep = hot[at] == m
            of, first, n, m = of[keep], first[keep], n[keep], m[keep]
            bucket, part = (m % U(buckets)).astype(np.int64), (m // U(buckets) & U(0xFFFF)).astype(np.int64)
            pack = zstandard.ZstdCompressor(level=1)
            for b, own in _split(bucket, buckets):
                own = own[np.argsort(ids[of[own]], kind="stable")]  # the first of equal texts has the smallest id
                texts: dict[bytes, int] = {}
                least, parts, mine, done = [], [], [], []
                a = start[of[own]] + first[own]
                for k, lo, size in zip(own.tolist(), a.tolist(), (n[own] + length - 1).tolist(), strict=True):
                    s = raw[lo : lo + size].tobytes()
                    x = texts.setdefault(s, len(texts))
                    if x == len(least):
                        least.append(int(ids[of[k]]))
                        parts.append(int(part[k]))
                    if ids[of[k]] == least[x]:
                        mine.append((x, int(of[k]), int(first[k])))
                    else:
                        done.append((int(of[k]), int(first[k]), int(first[k]) + size))
                mine = np.array(mine, np.int64).reshape(-1, 3)
                rows.append((b, pack.compress(b"".join(texts)), _pack(np.fromiter(map(len, texts), np.int64, len(texts)), np.int32), _pack(np.array(least, np.int64), np.int64), _pack(np.array(parts, np.int64), np.uint16), _pack(mine[:, 0], np.int32), _pack(mine[:, 1], np.int32), _pack(mine[:, 2], np.int32), _pack(np.array(done, np.int64).reshape(-1, 3), np.int32)))
        chunk = t.column("chunk")[0].as_py() if t.num_rows else -1
        cols = list(zip(*rows, strict=True)) or [()] * 9
        names = ("texts", "sizes", "ids", "part", "own_text", "own_doc", "own_at", "done")
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), **{k: pa.array(c, pa.binary()) for k, c in zip(names, cols[1:], strict=True)}})

    return send


#: Text that is sorted at a time.
PART_BYTES = 1 << 19


def _removed(text: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, name: np.ndarray, length: int):
    """(name of the text, first byte, end) of what is removed of texts that lie at begin in text."""
    text = text[ranges(begin, size)]
    stop, n = np.cumsum(size), size - length + 1
    at = ranges(stop - size, n)
    of = np.repeat(np.arange(len(size)), n)
    bucket = suffix_buckets(text, np.repeat(stop, size), at, length)
    least = np.full(len(text), NO_ID, np.int64)
    np.minimum.at(least, bucket, ids[of])
    goes = ids[of] > least[bucket]
    # Runs of removed window starts, none over two texts.
    edge = np.diff(np.concatenate([[0], goes.astype(np.int8), [0]]))
    both = np.zeros(len(goes) + 1, bool)
    both[np.cumsum(n) - n] = True
    both &= np.append(goes, False) & np.append(False, goes)
    a, z = np.flatnonzero((edge == 1) | both), np.flatnonzero((edge == -1) | both) - 1
    own = of[a]
    return name[own], at[a] - (stop - size)[own], at[z] - (stop - size)[own] + length


def _decide(length: int):
    def decide(t):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        text = np.frombuffer(b"".join(unpack.decompress(x.as_py()) for x in t.column("texts")), np.uint8)
        size, n_texts = _join(t.column("sizes"), np.int32)
        ids, part = _join(t.column("ids"), np.int64)[0], _join(t.column("part"), np.uint16)[0].astype(np.int64)
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        # Equal windows are of one minimiser and so of one part: a bucket is sorted part by part, in bounded memory.
        part = part * max(1, -(-len(text) // PART_BYTES)) >> 16
        found = [_removed(text, begin[own], size[own], ids[own], own, length) for _, own in _split(part, 0)]
        text_of, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(text_of, kind="stable")
        text_of, lo, hi = text_of[order], lo[order], hi[order]
        first, count = np.searchsorted(text_of, np.arange(len(size))), np.bincount(text_of, minlength=len(size))
        rows, base = [], 0
        for k, (chunk, texts) in enumerate(zip(t.column("chunk").to_pylist(), n_texts.tolist(), strict=True)):
            x = np.frombuffer(t.column("own_text")[k].as_py(), np.int32).astype(np.int64) + base
            doc, pos = np.frombuffer(t.column("own_doc")[k].as_py(), np.int32), np.frombuffer(t.column("own_at")[k].as_py(), np.int32)
            pick = ranges(first[x], count[x])
            who = np.repeat(np.arange(len(x)), count[x])
            cut = np.stack([doc[who], pos[who] + lo[pick], pos[who] + hi[pick]], 1).astype(np.int32)
            done = np.frombuffer(t.column("done")[k].as_py(), np.int32).reshape(-1, 3)
            rows.append((chunk, _pack(np.concatenate([cut, done]), np.int32)))
            base += texts
        rows = [r for r in rows if r[1]]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "cuts": pa.array([r[1] for r in rows], pa.binary())})

    return decide


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals as maximal ones."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
    return list(zip(lo[new].tolist(), reach[np.append(new[1:] - 1, len(lo) - 1)].tolist(), strict=True))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def _cut(t, cuts):
    import pyarrow as pa

    ids, raw, start, end, order = _documents(t)
    cut = _join(cuts.column("cuts"), np.int32)[0].reshape(-1, 3).astype(np.int64)
    cut = cut[np.argsort(cut[:, 0], kind="stable")]
    first = np.searchsorted(cut[:, 0], np.arange(len(ids) + 1))
    rows = []
    for k in range(len(ids)):
        s, e = int(start[k]), int(end[k])
        own = cut[first[k] : first[k + 1]]
        spans = merged(own[:, 1], own[:, 2]) if len(own) else []
        kept, at = hashlib.sha256(), s
        for lo, hi in spans:
            kept.update(raw[at : s + lo].tobytes())
            at = s + hi
        kept.update(raw[at:e].tobytes())
        rows.append((e - s, sum(hi - lo for lo, hi in spans), len(spans), kept.hexdigest(), [[lo, hi] for lo, hi in spans]))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
    return pa.table({"doc_id": t.column("d").combine_chunks().take(pa.array(order)), **{k: pa.array(c, kind) for k, c, kind in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), cols, kinds, strict=True)}})


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, chunks: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (start, end)."""
    if not 8 < gram <= length:
        raise ValueError("a gram has more than 8 bytes and fits the length")
    n = chunks or chunk_count(docs)
    own = docs.select(col(id_col).cast("long").alias("d"), col(text_col).alias("t")).withColumn("h", F.coalesce(F.xxhash64("t"), F.lit(0)))
    own = own.withColumn("chunk", F.pmod(F.xxhash64("d", "h"), F.lit(n)).cast("int"))
    by_chunk = own.groupBy("chunk")
    hashes = by_chunk.applyInArrow(_send_hashes(n, length, gram), "bucket int, chunk int, m binary, two binary")
    wanted = hashes.groupBy("bucket").applyInArrow(_answer, "chunk int, m binary")
    texts = by_chunk.cogroup(wanted.groupBy("chunk")).applyInArrow(_send_texts(n, length, gram), SENT)
    cuts = texts.groupBy("bucket").applyInArrow(_decide(length), "chunk int, cuts binary")
    return by_chunk.cogroup(cuts.groupBy("chunk")).applyInArrow(_cut, RESULT)


def chunk_count(docs: DataFrame, per: int = 6 << 20, even: int = 4096) -> int:
    """Chunks of about 6 MB of input; past 4096 of them they grow with the root of the input, for there is a row for each pair."""
    n = buckets_for(docs.sparkSession, docs, per, 12, 1 << 30)
    return n if n <= even else int(even * (n / even) ** 0.5)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")
