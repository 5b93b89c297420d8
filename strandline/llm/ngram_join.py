"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word n-grams, each a 64-bit hash. If two sets are similar, their
symmetric difference has at most D elements, and D follows from the sizes. Per size band, hashed
elements fall into D + 1 + e blocks, and each block is XORed to a 64-bit parity sketch: two sets that
differ in at most D elements agree in at least 1 + e blocks (pigeonhole), so joining equal sketches
of equal blocks finds every similar pair. e is the number of empty blocks allowed for, so that an
agreement in a block that is not empty is certain unless both sets have more empty blocks; such sets
are rare and join on their empty blocks too. A 512-bit parity sketch of the whole set then bounds the
symmetric difference from below by its Hamming distance, and for sets whose allowed difference is near
or beyond what 512 bits can show, so does a wide one, four bits and more for each element of that
difference; the texts of the pairs that pass are moved, once, and a link is what holds for the n-grams
of their words themselves, not for hashes.

Equal sets (by 128 bits of identity) are one class from the start. A task sends members that agree in
a key under one name, the list of them, so a key's list at its bucket has one entry for a batch of
input, however large the family. Groups are not expanded to all pairs: first all members are compared
with one hub (the member that shares most blocks with others); after that only pairs of a group whose
members are not yet connected are compared, all of them, in square tiles of bounded size.
So a family of near copies costs about as many comparisons as it has members, nothing is dropped,
and the components are those of all links.

Null texts, texts without words: an empty set, linked with nothing. Fewer words than n: one n-gram.
Repeated rows and equal texts are of one class. Rows with a null id are members like all others;
component_id is null for a component without any id. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, buckets_for, col, fresh, give_back, mix, packed8, slices, table, text_buffers, written
from .graph import components

WORDS, PERCENT, SKETCH_BITS, SLICE = 4, 85, 512, 1 << 20
NAMED_WORDS, NAMED_PERCENT = 5, 80
#: Keys that a task holds at a time, n-grams and pairs that are verified in one call, and members of a tile's side.
KEYS, DEAL_GRAMS, DEAL_PAIRS, TILE = 1_000_000, 150_000, 64, 1024
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
#: Bits of the map of row keys whose texts are asked for: 2 MB, however large the input.
SLOTS = 1 << 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of the words of a buffer, A-Z lower-cased: a mixed chain over 8 bytes at a time."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, U)
    word = np.concatenate([[False], ~_WHITE[b], [False]]).astype(np.int8)
    edge = np.diff(word)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low = _LOWER[b]
    eight, size = packed8(np.concatenate([low, np.zeros(7, np.uint8)])), stop - first
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    live, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = size[live] - k
        block = eight[first[live] + k] >> (U(8) * (8 - np.minimum(left, 8)).astype(U))
        h[live] = mix(h[live] * U(0xD6E8FEB86659FD93) ^ block)
        live, k = live[left > 8], k + 8
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        h[w] = int.from_bytes(hashlib.blake2b(low[first[w] : stop[w]].tobytes(), digest_size=8).digest(), "little")
    return first, h


def shingle_sets(raw: np.ndarray, start: np.ndarray, end: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text one after the other, number of each)."""
    size = end - start
    # A white byte between texts keeps their words apart.
    at = np.cumsum(size + 1) - (size + 1)
    b = np.full(int((size + 1).sum()), 0x20, np.uint8)
    for k in range(len(size)):
        b[at[k] : at[k] + size[k]] = raw[start[k] : end[k]]
    first, h = word_hashes(b)
    of = np.searchsorted(first, np.append(at, len(b)))
    n = len(h)
    gram = np.zeros(max(0, n - words + 1), U)
    for k in range(words):
        gram += h[k : k + len(gram)] * U((2 * k + 3) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        gram = mix(gram)
    out = []
    for lo, hi in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(gram[lo : hi - words + 1]))
        elif hi > lo:
            x = np.array([0xA5A5 + hi - lo], U)
            for v in h[lo:hi]:
                x = mix(x * U(0xC2B2AE3D27D4EB4F) + v)
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return np.concatenate(out) if out else np.zeros(0, U), np.array([len(x) for x in out], np.int64)


def segments(of_value, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A reduction (bitwise_xor, add) of each set; 0 for empty ones."""
    out, full = np.zeros(len(n), U), n > 0
    if full.any():
        out[full] = of_value.reduceat(h, (np.cumsum(n) - n)[full])
    return out


def set_ids(h: np.ndarray, n: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits of identity of each set; of the first 64 only `bits` are used."""
    a, b = segments(np.add, mix(h), n), segments(np.bitwise_xor, mix(h ^ U(0x5851F42D4C957F2D)), n)
    return mix(a + n.astype(U)) & U((1 << bits) - 1), mix(b ^ mix(a))


class Bands:
    """Size bands: pairs whose larger set falls into band j are found by scheme j."""

    def __init__(self, percent: int, most: int = 1 << 31):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= most:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.low = np.array(self.low, np.int64)

    def difference(self, total):
        """The largest symmetric difference of a similar pair with `total` elements in both sets together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def scheme(self, j: int) -> tuple[int, int]:
        """(blocks, empty blocks allowed for) of scheme j; no blocks if only equal sets are similar."""
        d = int(self.difference(2 * (self.low[j + 1] - 1)))
        if not d:
            return 0, 0
        least, e = self.low[j] * self.percent // 100, 0
        for _ in range(4):
            nb = d + 1 + e
            empty = nb * float(np.exp(-least / nb))
            e = min(d + 8, int(empty + 4 * empty**0.5 + 1))
        return d + 1 + e, e

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def block_keys(h: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key, set) of the block sketches by which sets are joined."""
    keys, sets = [], []
    begin, band = np.cumsum(n) - n, bands.of(n)
    for up in (0, 1):  # as the larger set of a pair, and as the smaller one
        scheme = band + up
        for j in np.unique(scheme[n > 0]).tolist():
            nb, allowed = bands.scheme(j)
            if not nb:
                continue
            own = np.flatnonzero((scheme == j) & (n > 0) & (n * 100 >= bands.low[j] * bands.percent))
            if not len(own):
                continue
            pick = np.concatenate([np.arange(begin[k], begin[k] + n[k]) for k in own])
            x = mix(h[pick] + U(j * 0x9E3779B9 + 1))
            slot = np.repeat(np.arange(len(own), dtype=np.int64), n[own]) * nb + ((x >> U(32)) * U(nb) >> U(32)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            s = slot[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            sketch, at = np.bitwise_xor.reduceat(mix(x)[order], first), s[first]
            keys.append(mix(sketch + mix((at % nb).astype(U) + U(j << 32))))
            sets.append(own[at // nb])
            full = np.bincount(at // nb, minlength=len(own))
            for k in np.flatnonzero(nb - full > allowed).tolist():
                bare = np.setdiff1d(np.arange(nb), at[at // nb == k] % nb)
                keys.append(mix(mix(bare.astype(U) + U(j << 32)) + U(0xE3)))
                sets.append(np.full(len(bare), own[k]))
    return (np.concatenate(keys), np.concatenate(sets)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def parity_sketches(h: np.ndarray, n: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(sets, bits / 8) bytes: each element flips one bit."""
    at = np.repeat(np.arange(len(n)), n) * bits + (mix(h ^ U(0x2545F4914F6CDD1D)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=len(n) * bits) & 1).astype(np.uint8).reshape(len(n), bits), axis=1)


def wide_bits(n: np.ndarray, percent: int) -> np.ndarray:
    """Bits of the wide sketch of sets of n elements: a power of 2, four times the difference allowed at least; 0 where SKETCH_BITS are enough."""
    allowed = 2 * np.asarray(n, np.int64) * (100 - percent) // (100 + percent)
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(4 * allowed, 1))).astype(np.int64)
    return np.where(bits > SKETCH_BITS, bits, 0)


def wide_sketches(h: np.ndarray, n: np.ndarray, percent: int) -> list[bytes | None]:
    """The wide sketch of each set, None where it needs none."""
    end = np.cumsum(n)
    return [parity_sketches(h[hi - k : hi], np.array([k]), m).tobytes() if m else None for hi, k, m in zip(end.tolist(), n.tolist(), wide_bits(n, percent).tolist(), strict=True)]


def folded(w: np.ndarray, words: int) -> np.ndarray:
    """Sketches as those of fewer bits, all powers of 2: the halves are XORed."""
    while w.shape[-1] > words:
        half = w.shape[-1] // 2
        w = w[..., :half] ^ w[..., half:]
    return w


class Wide:
    """A column of wide sketches, by their size."""

    def __init__(self, column):
        raw = column.to_pylist()
        self.words = np.array([len(x) // 8 if x else 0 for x in raw], np.int64)
        self.slot, self.of = np.zeros(len(raw), np.int64), {}
        for m in np.unique(self.words[self.words > 0]).tolist():
            own = np.flatnonzero(self.words == m)
            self.slot[own] = np.arange(len(own))
            self.of[m] = np.frombuffer(b"".join(raw[k] for k in own.tolist()), U).reshape(len(own), m)

    def distances(self, x: int, other: Wide, j: np.ndarray) -> np.ndarray:
        """Of x and the rows j of other: what their differences are at least; 0 where either has no wide sketch."""
        out, m = np.zeros(len(j), np.int64), int(self.words[x])
        if m:
            own, words = self.of[m][self.slot[x]], other.words[j]
            for w in np.unique(words[words > 0]).tolist():
                at, least = words == w, min(m, w)
                out[at] = np.bitwise_count(folded(other.of[w][other.slot[j[at]]], least) ^ folded(own, least)).sum(1)
        return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def _batches(batches, column: int, words: int):
    for batch in batches:
        raw, start, end = text_buffers(batch.column(column))
        for i, j in slices(start, end, SLICE):
            h, n = shingle_sets(raw, start[i:j], end[i:j], words)
            yield batch.slice(i, j - i), h, n


BASE = "doc_id long, tk long, th int, n long, sid long, check long, " + ", ".join(f"{x} long" for x in SKETCH) + ", wide binary"


def _base(words: int, percent: int, bits: int):
    def run(batches):
        import pyarrow as pa

        for batch, h, n in _batches(batches, 3, words):
            a, b = set_ids(h, n, bits)
            sketch = parity_sketches(h, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(_signed(a)), pa.array(_signed(b)), *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(len(SKETCH))], pa.array(wide_sketches(h, n, percent), pa.binary())], ["doc_id", "tk", "th", "n", "sid", "check", *SKETCH, "wide"])

    return run


#: Members from which lists of a batch that share a member are sent as one.
LONG_LIST = 8


def _name(s: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A name for each list of sets."""
    return mix(np.add.reduceat(mix(s), first) + size.astype(U) * U(0xC2B2AE3D27D4EB4F)) if len(first) else np.zeros(0, U)


def families(s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists one after the other: (family of each list, members of the families, number of each); lists that share a member are of one."""
    first = np.cumsum(size) - size
    member, of = np.unique(s, return_inverse=True)
    label = np.arange(len(member))
    while True:
        least = np.repeat(np.minimum.reduceat(label[of], first), size)
        new = label.copy()
        np.minimum.at(new, of, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    order = np.argsort(label, kind="stable")
    _, family, count = np.unique(label, return_inverse=True, return_counts=True)
    return family[of[first]], member[order], count


def gathered(k: np.ndarray, s: np.ndarray, buckets: int) -> list[tuple]:
    """Rows (bucket, keys, names, list name) of the keys k of the sets s.

    Sets that agree in a key are sent under one name, that of their list; a list is a row of its own. The keys of a large
    family have nearly equal lists, so long lists that share a member are one: a member is in one long list of a batch
    only, and a list that says too much only adds pairs to verify.
    """
    b = k % U(buckets)
    order = np.lexsort((s, k, b))
    k, s, b = k[order], s[order], b[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    k, s, b = k[new], s[new], b[new]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(first, len(k)))
    name, rows = s[first].copy(), []
    short, long = (size > 1) & (size < LONG_LIST), size >= LONG_LIST

    def add(names: np.ndarray, members: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        once, pick = np.unique(names, return_index=True)
        for x, g in zip(once.tolist(), pick.tolist(), strict=True):
            rows.append((x % buckets, None, members[at[g] : at[g] + n[g]].tobytes(), int(U(x).view(np.int64))))

    if short.any():
        name[short] = _name(s, first, size)[short]
        add(name[short], s, first[short], size[short])
    if long.any():
        of, members, n = families(s[np.repeat(long, size)], size[long])
        names = _name(members, np.cumsum(n) - n, n)
        name[long] = names[of]
        add(names, members, np.cumsum(n) - n, n)
    k, b = (k[first] >> U(32)).astype(np.uint32), b[first]
    at = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
    rows += [(int(b[x]), k[x:y].tobytes(), name[x:y].tobytes(), None) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return rows


def _keys(words: int, percent: int, buckets: int, bits: int):
    def run(batches):
        import pyarrow as pa

        bands, held_k, held_s, held = Bands(percent), [], [], 0

        def packed():
            rows = gathered(np.concatenate(held_k), np.concatenate(held_s), buckets)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "k", "s", "list"])

        for _, h, n in _batches(batches, 0, words):
            sid, check = set_ids(h, n, bits)
            once = np.zeros(len(n), bool)
            once[np.unique(sid + mix(check), return_index=True)[1]] = True  # a set once a slice
            keys, of = block_keys(h[np.repeat(once, n)], n[once], bands)
            if len(keys):
                held_k.append(keys)
                held_s.append(sid[once][of])
                held += len(keys)
            if held >= KEYS:
                yield packed()
                held_k, held_s, held = [], [], 0
        if held:
            yield packed()
        give_back()

    return run


def _groups(t):
    """Of a bucket: groups (names of equal keys), those that say the same once with how many keys say so, and lists."""
    import pyarrow as pa
    import pyarrow.compute as pc

    keyed, lists = t.filter(pc.is_valid(t.column("k"))), t.filter(pc.is_null(t.column("k")))
    found: dict[bytes, int] = {}
    if keyed.num_rows:
        k = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in keyed.column("k")])
        s = np.concatenate([np.frombuffer(x.as_py(), U) for x in keyed.column("s")])
        order = np.argsort(k, kind="stable")
        ks = k[order]
        first = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
        size = np.diff(np.append(first, len(ks)))
        keep = np.repeat(size > 1, size)
        k, s = ks[keep], s[order][keep]
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[new], s[new]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(k)))
        for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            x = s[a : a + n].tobytes()
            found[x] = found.get(x, 0) + 1
    own = set(zip(lists.column("list").to_pylist(), lists.column("s").to_pylist(), strict=True))
    names = [None] * len(found) + [x[0] for x in own]
    members = [np.frombuffer(x, np.int64) for x in [*found, *(x[1] for x in own)]]
    return pa.table({"list": pa.array(names, pa.int64()), "members": pa.array(members, pa.list_(pa.int64())), "said": pa.array([*found.values(), *[1] * len(own)], pa.int64())})


def exact_grams(words, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as numbers that are equal only if their words are; none for texts of fewer words."""
    g = np.asarray(words, np.int64)
    for k in range(1, n):
        g = np.unique(g[: len(g) - 1] << 32 | words[k : k + len(g) - 1], return_inverse=True)[1].astype(np.int64) if len(g) > 1 else g[:0]
    return [np.unique(g[lo : max(lo, hi - n + 1)]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _verify(words: int, percent: int):
    """From a hub's text (b is null) and those of others: the links among them."""

    def verify(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.ascii_lower(t.column("text").combine_chunks()))
        coded = pc.list_flatten(split).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        real = np.append(np.asarray(pc.not_equal(coded.dictionary, ""), bool), True)[code]
        upto = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        sets = exact_grams(code[real], upto, words)
        b = t.column("b").to_pylist()
        own = next((sets[k] for k, x in enumerate(b) if x is None), np.zeros(0, np.int64))
        out = []
        for x, g in zip(b, sets, strict=True):
            if x is not None and len(own) and len(g):
                both = int((own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g).sum())
                if 100 * both >= percent * (len(own) + len(g) - both):
                    out.append(x)
        return pa.table({"a": pa.array(t.column("a").to_pylist()[:1] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return verify


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that sizes and sketches allow, with the rows that hold their texts."""
    p = pairs
    for x in ("a", "b"):
        p = p.join(classes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "tk", "th", *SKETCH, "wide")]), x)
    far = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    p = p.filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent).filter(far <= F.floor((F.col("a_n") + F.col("b_n")) * (100 - percent) / (100 + percent)))
    p = p.select("a", "a_n", "a_tk", "a_th", "b", "b_n", "b_tk", "b_th", "a_wide", "b_wide")
    return p.mapInArrow(_near(percent), "a long, a_tk long, a_th int, b long, b_n long, b_tk long, b_th int")


def _near(percent: int):
    """The pairs whose wide sketches allow a link."""

    def near(batches):
        import pyarrow as pa

        for t in batches:
            left, right, n = Wide(t.column("a_wide")), Wide(t.column("b_wide")), t.column("a_n").to_numpy() + t.column("b_n").to_numpy()
            d = np.zeros(t.num_rows, np.int64)
            for k in np.flatnonzero((left.words > 0) & (right.words > 0)).tolist():
                d[k] = left.distances(k, right, np.array([k]))[0]
            yield t.filter(pa.array(d <= n * (100 - percent) // (100 + percent))).select(["a", "a_tk", "a_th", "b", "b_n", "b_tk", "b_th"])

    return near


def _asked(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of own that pairs ask for, and few others: those whose bit of SLOTS is set, by the row key."""
    word, bit = F.shiftright(F.col("tk").bitwiseAND(F.lit(SLOTS - 1)), 6), F.expr("shiftleft(1L, cast(tk & 63 as int))")
    keys = pairs.select(F.explode(F.array("a_tk", "b_tk")).alias("tk"))
    marks = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))  # SLOTS / 64 rows at most
    return own.withColumn("word", word).join(F.broadcast(marks), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def verified(pairs: DataFrame, classes: DataFrame, own: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Only texts of pairs that sketches allow are moved to each other, b's to a's.

    A hub with many partners is dealt out by their number and size. The rows that are asked for grow with
    the input, so they are never broadcast; they are the hashed side of the join, and texts are not sorted.
    What is broadcast is a map of bits of their keys, of a fixed size, so that most other texts are not moved.
    """
    p = written(_allowed(pairs, classes, percent), "pairs")
    tasks = F.greatest(F.ceil(F.count(F.lit(1)) / DEAL_PAIRS), F.ceil(F.sum("b_n") / DEAL_GRAMS))
    p = p.join(p.groupBy("a").agg(tasks.alias("tasks")), "a").withColumn("deal", F.pmod(F.xxhash64("b"), "tasks").cast("int"))
    hubs = p.select(F.col("a_tk").alias("tk"), F.col("a_th").alias("th"), "a", "deal", F.lit(None).cast("long").alias("b")).distinct()
    wanted = hubs.unionByName(p.select(F.col("b_tk").alias("tk"), F.col("b_th").alias("th"), "a", "deal", "b"))
    texts = _asked(own.select("tk", "th", "text"), p).join(wanted.hint("shuffle_hash"), ["tk", "th"]).dropDuplicates(["tk", "th", "a", "deal", "b"])
    return texts.select("a", "deal", "b", "text").groupBy("a", "deal").applyInArrow(_verify(words, percent), "a long, b long")


def _tile(rows, others, node, comp, n, bits, wide: Wide, percent: int, same: bool):
    """(a, b) of a tile: members of rows and of others, ascending in n, that are in different components and may be similar."""
    low, high = np.searchsorted(n[others] * 100, n[rows] * percent, "left"), np.searchsorted(n[others] * percent, n[rows] * 100, "right")
    a, b = [], []
    for x, lo, hi in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True):
        j = others[lo:hi]
        j = j[(comp[j] != comp[x]) & (node[j] > node[x])] if same else j[comp[j] != comp[x]]
        if len(j):
            d = np.bitwise_count(bits[j] ^ bits[x]).sum(1)
            j = j[d <= (n[j] + n[x]) * (100 - percent) // (100 + percent)]
        if len(j) and wide.words[x]:
            j = j[wide.distances(x, wide, j) <= (n[j] + n[x]) * (100 - percent) // (100 + percent)]
        if len(j):
            a.append(np.full(len(j), x))
            b.append(j)
    return a, b


def _cross(percent: int):
    """The possible pairs of the tiles that a task call holds, tile by tile."""

    def cross(t):
        import pyarrow as pa

        gid, left, right, tile, node, comp, n = (t.column(c).to_numpy() for c in ("gid", "i", "j", "tile", "node", "component", "n"))
        bits, wide = np.stack([t.column(c).to_numpy() for c in SKETCH], 1).view(U), Wide(t.column("wide"))
        order = np.lexsort((n, tile, right, left, gid))
        new = np.ones(len(order), bool)
        key = np.stack([gid[order], left[order], right[order]])
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        edge = np.append(np.flatnonzero(new), len(order))
        a, b = [], []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = order[lo:hi]
            cut = int(np.searchsorted(tile[own], left[own[0]], "right"))
            same = left[own[0]] == right[own[0]]
            x, y = _tile(own[:cut], own if same else own[cut:], node, comp, n, bits, wide, percent, same)
            a += x
            b += y
        a, b = (node[np.concatenate(x)] if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return cross


def _unconnected(member: DataFrame, label: DataFrame, classes: DataFrame, percent: int, calls: int) -> DataFrame:
    """Possible pairs of groups whose members are in several components; a member meets each tile of its group once.

    Groups are many and mostly small, so tiles are dealt out by hash over `calls` calls. Classes may come without wide sketches.
    """
    wide = F.col("wide") if "wide" in classes.columns else F.lit(None).cast("binary").alias("wide")
    known = member.join(label, "node")
    mixed = known.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("c"), F.max("component").alias("d")).filter("c != d")
    rows = known.join(mixed.select("gid", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "gid").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    rows = rows.join(classes.select("node", "n", *SKETCH, wide), "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("gid", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "node", "component", "n", *SKETCH, "wide")
    rows = rows.withColumn("call", F.pmod(F.xxhash64("gid", "i", "j"), F.lit(calls)).cast("int")).repartition(max(1, calls // 4), "call")
    return rows.groupBy("call").applyInArrow(_cross(percent), "a long, b long").distinct()


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _row_keys(id_col: str, text_col: str) -> list:
    """96 bits that rows share only if id and text are the same."""
    return [F.xxhash64(col(id_col).cast("long"), col(text_col)), F.hash(col(text_col), col(id_col).cast("long"))]


def _members(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bits: int) -> DataFrame:
    """One row per input row: doc_id, tk and th (its row keys), n, and component (a class of its component, null for empty sets)."""
    tk, th = _row_keys(id_col, text_col)
    own = docs.select(col(id_col).cast("long").alias("doc_id"), tk.alias("tk"), th.alias("th"), col(text_col).alias("text"))
    base = written(own.mapInArrow(_base(words, percent, bits), BASE).withColumn("row", F.monotonically_increasing_id()), "sets")
    some = base.filter("n > 0")
    classes = some.groupBy("sid", "check").agg(F.min("row").alias("node"), F.min_by(F.struct("tk", "th"), "row").alias("at"), *[F.first(c).alias(c) for c in ("n", *SKETCH, "wide")])
    classes = written(classes.select("sid", "check", "node", "at.*", "n", *SKETCH, "wide"), "classes")
    buckets = buckets_for(docs.sparkSession, docs, 8 << 20, 12)
    keys = own.select("text").mapInArrow(_keys(words, percent, buckets, bits), "bucket int, k binary, s binary, list long")
    found = written(keys.groupBy("bucket").applyInArrow(_groups, "list long, members array<long>, said long"), "groups")
    lists = found.filter("list is not null").select("list", F.explode("members").alias("sid")).distinct()
    groups = found.filter("list is null").groupBy(F.xxhash64("members").alias("gid"), "members").agg(F.sum("said").alias("said")).select("gid", "said", F.explode("members").alias("name"))
    # A name is a set's or a list's; what is both counts as both, which only adds pairs to verify.
    member = groups.select("gid", "said", F.col("name").alias("sid")).unionByName(groups.join(lists.withColumnRenamed("list", "name"), "name").select("gid", "said", "sid")).unionByName(lists.select(F.col("list").alias("gid"), F.lit(1).cast("long").alias("said"), "sid"))
    member = written(member.join(classes.select("sid", "node"), "sid").groupBy("gid", "node").agg(F.max("said").alias("said")), "members")
    sizes = member.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    weight = member.join(sizes, "gid").groupBy("node").agg(F.sum(F.col("said") * F.col("size")).alias("weight"))
    hub = member.join(weight, "node").groupBy("gid").agg(F.max_by("node", F.struct("weight", F.xxhash64("node"))).alias("hub"))
    stars = written(member.join(hub, "gid").filter("hub != node").select("hub", *_pair("hub", "node")).groupBy("x", "y").agg(F.min("hub").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b")), "stars")
    links = written(verified(stars, classes, own, words, percent), "links")
    label = written(_labels(links, classes), "labels")
    rest = _unconnected(member, label, classes, percent, 4 * buckets).join(stars.select(*_pair("a", "b")).toDF("a", "b"), ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    if not rest.isEmpty():
        more = written(verified(rest, classes, own, words, percent), "links")
        if not more.isEmpty():
            label = written(_labels(links.unionByName(more), classes), "labels")
    named = classes.select("sid", "check", "node").join(label, "node").select("sid", "check", "component")
    full = some.join(named, ["sid", "check"]).select("doc_id", "tk", "th", "n", "component")
    return full.unionByName(base.filter("n = 0").select("doc_id", "tk", "th", "n", F.lit(None).cast("long").alias("component")))


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of every class."""
    return classes.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NAMED_WORDS, percent: int = NAMED_PERCENT, id_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two documents link if 100 * intersection >= percent * union of their sets of word n-grams.
    id_bits: bits of a set's short name, of the 128 of its identity; fewer only make more candidates.
    """
    rows = _members(docs, id_col, text_col, words, percent, id_bits)
    some = rows.filter("n > 0")
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    full = some.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NAMED_WORDS, percent: int = NAMED_PERCENT) -> DataFrame:
    """The rows of docs that stay: all rows with empty sets, and of each component one row.

    That is the row with the smallest id (a null is the largest); of several, the one whose row keys, then whose
    other columns' hash, is the smallest. Rows are told apart by id and text, so different texts under one id are not confused.
    """
    tk, th, turn, one, other = fresh(docs.columns, "tk", "th", "turn", "one", "other")
    rows = written(_members(docs, id_col, text_col, words, percent, 64), "near")
    best = rows.filter("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "tk", "th")).alias("x")).select("x.tk", "x.th", F.lit(True).alias("one"))
    stay = rows.filter("n = 0").select("tk", "th", F.lit(False).alias("one")).distinct().unionByName(best).toDF(tk, th, one)
    own = docs.withColumns(dict(zip([tk, th, other], [*_row_keys(id_col, text_col), F.xxhash64(*map(col, docs.columns))], strict=True)))
    got = own.join(stay.hint("shuffle_hash"), [tk, th])
    first = Window.partitionBy(tk, th).orderBy(other)
    return got.withColumn(turn, F.row_number().over(first)).filter(~F.col(one) | (F.col(turn) == 1)).select(*map(col, docs.columns))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), words=WORDS, percent=PERCENT)
