from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, graph, line_dedup, ngram_join, suffix_dedup

from ..oracle import differences
from .fixtures import documents, empty, pairs


def key(i):
    return (1, 0) if i is None else (0, i)


# --- exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        top = max(n for _, n in members)
        keep = min((i for i, n in members if n == top), key=lambda i: (i is not None, i or 0))
        first = next(k for k, (i, n) in enumerate(members) if i == keep and n == top)
        out += [(i, keep, len(members), k == first, hashlib.sha256(norm.encode()).hexdigest()) for k, (i, _) in enumerate(members)]
    return sorted(out, key=str)


def test_exact_dedup_equals_brute_force(spark):
    df = documents(spark)
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=str) == brute_exact(pairs(df))
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_chunks_are_content_defined(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8000))
    df = spark.createDataFrame([(0, text), (1, "zz" + text)], "i int, t string").select("i", exact_dedup.chunk_texts(F.col("t")).alias("c"))
    a, b = (r.c for r in df.orderBy("i").collect())
    assert "".join(a) == text and "".join(b) == "zz" + text
    assert len(set(a) & set(b)) >= len(a) - 3 and all(len(x) <= exact_dedup.MAX_CHARS for x in a)


def test_chunk_collisions_are_found_and_separated(spark):
    df = spark.createDataFrame([(0, "same"), (1, "other"), (2, "same")], "doc_id long, text string")
    assert exact_dedup.chunk_collisions(df).count() == 0
    assert exact_dedup.chunk_collisions(df, hashed=lambda c: F.lit(1)).count() == 1


# --- n-gram join


def shingles(t, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_join(rows, words, percent):
    comp, least = brute_components(rows, words, percent), defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]].append(d)
    return sorted([(d, len(shingles(t, words)), d if comp[i] is None else min(least[comp[i]], default=None)) for i, (d, t) in enumerate(rows)], key=str)


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, words, percent):
    df = documents(spark)
    got = sorted(map(tuple, ngram_join.ngram_join(df, words=words, percent=percent).collect()), key=str)
    assert got == brute_join(pairs(df), words, percent)


def test_ngram_join_of_a_family_without_a_common_center(spark):
    """A chain of near copies, each near to its neighbours only, and a large family of copies."""
    base = [f"w{i}" for i in range(200)]
    rows, now = [], list(base)
    for k in range(30):
        rows.append((k, " ".join(now)))
        now = list(now)
        now[(k * 13) % 200] = f"n{k}"
    rows += [(100 + k, " ".join(["A", *base[::-1], "B"])) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.ngram_join(df, words=4, percent=85).collect()), key=str)
    assert got == brute_join(rows, 4, 85)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(empty(spark)).count() == 0
    assert ngram_join.keep_one(empty(spark)).count() == 0


def kept_rows(rows, words=5, percent=80):
    """Rows without words, and of each component the row with the smallest id, as a multiset of (id, text) without what ties leave open."""
    comp = brute_components(rows, words, percent)
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[comp[k]].append((i, t))
    out = []
    for c, members in groups.items():
        out += members if c is None else [(min(members, key=lambda r: key(r[0]))[0], None)]
    return out


def brute_components(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) if sets[i] else None for i in range(len(rows))]


def test_keep_one_keeps_clean_rows(spark):
    df = documents(spark)
    want = kept_rows(pairs(df))
    got = pairs(ngram_join.keep_one(df))
    assert sorted((r[0] for r in got), key=key) == sorted((r[0] for r in want), key=key)
    assert {r for r in want if r[1] is not None} <= set(got) and ngram_join.keep_one(df).columns == df.columns


def test_keep_one_tells_rows_apart_by_text(spark):
    """Different texts under one id stay both; copies under null ids go; repeated rows leave one; columns may have any name."""
    a, b, c = "alpha beta gamma delta eps zeta", "one two three four five six", "red green blue white black grey"
    rows = [(1, a, 1, 1, 1), (1, b, 2, 2, 2), (2, c, 3, 3, 3), (2, c, 3, 3, 3), (None, c, 4, 4, 4), (None, "x y z v w u", 5, 5, 5), (None, "x y z v w u", 6, 6, 6), (3, None, 7, 7, 7), (3, "", 8, 8, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tk int, `th` int, `one.two` int")
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    assert sorted([(r[0], r[1]) for r in got.collect()], key=str) == sorted([(1, a), (1, b), (2, c), (None, "x y z v w u"), (3, None), (3, "")], key=str)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_unlike_long_words_do_not_link(spark):
    """Words that any polynomial modulo 2**64 confuses: the sequence of Thue and Morse and its complement."""
    w = thue_morse(2048)
    rows = [(0, w), (1, w.translate(str.maketrans("ab", "ba"))), (2, w.upper()), (3, w[:100]), (4, w[:100].translate(str.maketrans("ab", "ba")))]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_ngram_join_with_colliding_names(spark):
    """With two bits of a name nearly all sets share theirs with others."""
    df = documents(spark, n=30)
    got = sorted(map(tuple, ngram_join.ngram_join(df, words=4, percent=85, id_bits=2).collect()), key=str)
    assert got == brute_join(pairs(df), 4, 85)


def test_members_of_a_key_are_sent_under_one_name():
    rng = np.random.default_rng(4)
    k, s = rng.integers(0, 1 << 62, 500).astype(np.uint64), rng.integers(0, 1 << 62, 500).astype(np.uint64)
    k[:300] = k[0]
    s[300:310] = s[0]
    rows = ngram_join.gathered(np.concatenate([k, k[:50]]), np.concatenate([s, s[:50]]), 7)
    lists = {r[3]: set(np.frombuffer(r[2], np.uint64).tolist()) for r in rows if r[1] is None}
    assert list(lists.values()) == [set(s[:300].tolist())]
    names = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows if r[1] is not None])
    assert len(names) == 201 and next(iter(lists)) in names.tolist()


def test_long_lists_that_share_members_are_one():
    """A family of 200 near copies: 500 keys, each of most of them; its members are sent once, and every key's sets are together."""
    rng = np.random.default_rng(6)
    sets = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    pairs_ = [(key, x) for key in range(500) for x in sets[rng.random(200) < 0.8].tolist()] + [(1000 + k, 7 + k // 3) for k in range(30)]
    k, s = (np.array(x, np.uint64) for x in zip(*pairs_, strict=True))
    rows = ngram_join.gathered(k << np.uint64(33), s, 7)
    lists = {r[3]: set(np.frombuffer(r[2], np.uint64).tolist()) for r in rows if r[1] is None}
    assert sum(map(len, lists.values())) <= 200 + 30 and any(len(x) == 200 for x in lists.values())


def test_exact_grams_are_the_grams_of_words():
    r = random.Random(3)
    texts = [[r.randint(0, 3) for _ in range(r.randint(0, 12))] for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = ngram_join.exact_grams(np.array(sum(texts, []), np.int64), bounds, 3)
    want = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    for i in range(40):
        for j in range(40):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_groups_of_several_tiles(spark, monkeypatch):
    """All pairs of a group come from its tiles, each once."""
    monkeypatch.setattr(ngram_join, "TILE", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 20).astype(np.uint64)) for _ in range(40)]
    bits = ngram_join.parity_sketches(np.concatenate(sets), np.full(40, 20)).view(np.int64)
    schema = "node long, n long, " + ", ".join(f"{c} long" for c in ngram_join.SKETCH)
    classes = spark.createDataFrame([(k, 20, *bits[k // 2].tolist()) for k in range(40)], schema)
    member = spark.createDataFrame([(9, k, 1) for k in range(40)], "gid long, node long, said long")
    label = spark.createDataFrame([(k, k) for k in range(40)], "node long, component long")
    got = ngram_join._unconnected(member, label, classes, 85, 5).collect()
    assert {(k, k + 1) for k in range(0, 40, 2)} <= {tuple(r) for r in got} and all(r.a < r.b for r in got)


def test_similar_sets_share_a_block():
    """Pigeonhole: any two sets within the bound agree in a block key."""
    rng = np.random.default_rng(0)
    bands = ngram_join.Bands(85)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        n = len(a)
        d = int(bands.difference(2 * n))
        gone = int(rng.integers(0, d + 1))
        b = np.sort(np.concatenate([a[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, d + 1 - gone))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        keys, of = ngram_join.block_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
        assert np.intersect1d(keys[of == 0], keys[of == 1]).size


def test_parity_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(2))
        s = ngram_join.parity_sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_long_unlike_sets_are_no_candidates(spark, monkeypatch):
    """512 bits are full of some 600 elements; sets of thousands are told apart by sketches of their size, and like ones still pass."""
    r = random.Random(3)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(3000)) for _ in range(8)]
    texts += [t + " and more" for t in texts]
    kept = {}
    monkeypatch.setattr(ngram_join, "written", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ngram_join._members(docs, "doc_id", "text", 5, 80, 64)
    node = {r.n * 100 + k: r.node for k, r in enumerate(kept["classes"].collect())}
    pairs = spark.createDataFrame([(a, b) for a in node.values() for b in node.values() if a < b], "a long, b long")
    assert ngram_join._allowed(pairs, kept["classes"], 80).count() == 8


def test_wide_sketches_are_lower_bounds_at_any_size():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for n in (600, 1100, 1200, 2500, 9000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 20 :], rng.integers(0, 1 << 62, n // 8).astype(np.uint64)]))
        sizes = np.array([len(a), len(b)])
        wide = ngram_join.Wide(pa.array(ngram_join.wide_sketches(np.concatenate([a, b]), sizes, 80)))
        d = len(np.setxor1d(a, b))
        assert (wide.words > 0).all() and 0.6 * d < wide.distances(0, wide, np.array([1]))[0] <= d
    assert ngram_join.wide_bits(np.array([1, 500, 4000]), 80).tolist() == [0, 0, 4096]


def test_texts_that_no_pair_asks_for_are_not_moved(spark, monkeypatch):
    own = spark.range(2000).select(F.xxhash64("id").alias("tk"), F.lit(0).alias("th"), F.col("id").cast("string").alias("text"))
    pairs = own.filter("text < '11'").select(F.col("tk").alias("a_tk"), F.col("tk").alias("b_tk"))
    want = {r.text for r in own.filter("text < '11'").collect()}
    got = {r.text for r in ngram_join._asked(own, pairs).collect()}
    assert want <= got and len(got) < len(want) + 5
    monkeypatch.setattr(ngram_join, "SLOTS", 64)  # a full map only lets more through
    assert want <= {r.text for r in ngram_join._asked(own, pairs).collect()}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 4), (7, 7), (3, 2)], "a long, b long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}


# --- suffix dedup


def brute_suffix(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, (2, 0)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(d):
                gone[p : p + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "gram", "chunks"), [(50, 20, 5), (50, 20, 1), (30, 12, 3)])
def test_suffix_dedup_equals_brute_force(spark, length, gram, chunks):
    df = documents(spark)
    got = suffix_dedup.suffix_dedup(df, length=length, gram=gram, chunks=chunks)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute_suffix(pairs(df), length)


def test_suffix_dedup_of_texts_of_one_letter_and_of_some_mb(spark):
    """What sorting by repetition likes least: one letter, a short period, and a text of 3 MB with a copy of its middle."""
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, "a" * 30_000), (2, "ab" * 9_000), (3, "a" * 400), (4, long), (5, "start " + long[1_000_000:1_002_000] + " stop")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {1: (30_000, 0, 0), 2: (18_000, 0, 0), 3: (400, 400, 1), 4: (3_000_000, 0, 0), 5: (2_011, 2_000, 1)}


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


def test_bucket_pointers_are_a_bounded_suffix_array():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    text[200:300] = text[0:100]
    end = np.full(600, 600)
    at = np.arange(600 - 50 + 1)
    p = suffix_dedup.suffix_buckets(text, end, at, 50)
    windows = [text[i : i + 50].tobytes() for i in at]
    for i in range(0, len(at), 7):
        for j in range(0, len(at), 11):
            assert (p[i] == p[j]) == (windows[i] == windows[j]) and ((p[i] < p[j]) == (windows[i] < windows[j]))


def test_long_texts_are_cut_into_pieces_without_loss():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 5000).astype(np.uint8)
    whole = suffix_dedup.runs(raw, np.array([0]), np.array([5000]), piece=1 << 20)
    parts = suffix_dedup.runs(raw, np.array([0]), np.array([5000]), piece=700)
    spread = lambda r: [x for f, n, m in zip(r[1], r[2], r[3], strict=True) for x in [(f + k, m) for k in range(n)]]
    assert spread(whole) == spread(parts) and len(spread(whole)) == 4951


# --- line dedup


def test_line_dedup_by_host(spark):
    rows = [(k, "h1", f"menu\nown {k}\nmenu\n") for k in range(10)] + [(20, "h2", "menu\nrare"), (21, None, "menu"), (22, "h1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_extra", F.lit(1))
    got = {r.doc_id: r.text for r in line_dedup.dedup_documents(df, ratio=0.5, least_pages=3, distinct_pages=False).collect()}
    assert got == {k: f"own {k}\n" for k in range(10)} | {20: "menu\nrare", 21: "menu", 22: None}


def test_line_dedup_counts_equal_texts_once(spark):
    rows = [(k, "h", "a\nb") for k in range(20)] + [(30 + k, "h", f"only {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = line_dedup.dedup_documents(df, ratio=0.3, least_pages=2, distinct_pages=True)
    assert {r.text for r in kept.filter("doc_id < 20").collect()} == {"a\nb"}
    gone = line_dedup.dedup_documents(df, ratio=0.3, least_pages=2, distinct_pages=False)
    assert {r.text for r in gone.filter("doc_id < 20").collect()} == {""}


def test_line_dedup_keeps_columns_and_rows(spark):
    df = documents(spark)
    out = line_dedup.dedup_documents(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert line_dedup.dedup_documents(empty(spark)).count() == 0


def test_line_dedup_takes_any_column_names(spark):
    names = ["doc_id", "source", "text", "_host", "host", "lines", "salt", "kept", "n", "Drop", "a.b"]
    rows = [(k, "h", f"menu\nown {k}", *(f"mine {c}" for c in names[3:])) for k in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = line_dedup.dedup_documents(df, ratio=0.5)
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == sorted((k, "h", f"own {k}", *r[3:]) for k, r in enumerate(rows))


def test_lines_at_the_ratio_stay(spark):
    rows = [(k, "h", ("half\n" if k % 2 else "") + ("more\n" if k < 6 else "") + f"own {k}") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = line_dedup.dedup_documents(df, ratio=0.5, least_pages=1, distinct_pages=False)
    assert out.filter("text like '%half%'").count() == 5 and out.filter("text like '%more%'").count() == 0


def test_lines_of_pages_without_a_host(spark, tmp_path):
    """Null urls are one host, in the query and in its SQL."""
    rows = [(k, None, f"<p>common</p><p>own {k}</p>") for k in range(5)] + [(9, "http://x/", "<p>common</p>"), (10, "no url", None), (11, "http://x/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert differences(line_dedup.op9_line_dedup(spark, str(tmp_path)), line_dedup.SQL, str(tmp_path)) == []
    assert line_dedup.op9_line_dedup(spark, str(tmp_path)).filter("n_dropped > 0").count() == 5


def test_line_dedup_with_a_hot_host(spark):
    rows = [(k, f"h{k % 3 if k % 2 else 0}", f"menu\nown {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = line_dedup.dedup_documents(df)
    assert out.count() == 3000 and out.filter("text like '%menu%'").count() == 0
