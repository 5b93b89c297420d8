from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language_id, registry, source_mix

from ..oracle import differences
from .fixtures import documents, empty


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir) == []


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by the stated rounds: share out, cut, reshare the excess by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: most * sizes[s] for s in over}


def test_mix_targets_and_fit(spark):
    df = documents(spark, n=200)
    rows = source_mix.pareto_mix(df).collect()
    assert len(rows) == df.count()
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect()}
    assert all(words[r.doc_id] == r["size"] for r in rows)
    again = sorted(map(tuple, source_mix.pareto_mix(df.repartition(5)).collect()), key=str)
    assert again == sorted(map(tuple, rows), key=str)


def test_mix_takes_documents_by_their_inclusion_odds(spark):
    """The share of documents of a size class that the sample takes is what the class is wanted, its copies beside."""
    import random

    r = random.Random(8)
    sizes = [r.choice((1, 3, 7, 15, 40)) for _ in range(6000)]
    df = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(9000 + i, "w " * 10, "b") for i in range(2000)], "doc_id long, text string, source string")
    rows = [x for x in source_mix.pareto_mix(df, weights=(1, 1), share=0.7).collect() if x.source == "a"]
    by = defaultdict(list)
    for x in rows:
        by[x["size"]].append((x.copies, x.want))
    want = [by[n][0][1] for n in sorted(by)]
    assert want == sorted(want) and want[-1] > 4 * want[0] and any(0 < w % 1 < 1 for w in want)
    for n, own in by.items():
        assert len({w for _, w in own}) == 1 and {c for c, _ in own} <= {int(own[0][1]), int(own[0][1]) + 1}
        assert sum(c for c, _ in own) / len(own) == pytest.approx(own[0][1], abs=0.06)
    assert abs(sum(x.taken for x in rows) - rows[0].target) <= 20
    other = source_mix.pareto_mix(df, weights=(1, 1), share=0.7, seed=99).collect()
    assert {x.doc_id for x in other if x.copies} != {x.doc_id for x in rows if x.copies}


def test_mix_keeps_rows_and_any_column(spark):
    """Copies are a row's own: null and repeated ids, and columns with the names that the operator would take."""
    rows = [(None, "w " * n, "a", n, n, n) for n in range(1, 60)] + [(7, "x " * n, None, n, n, n) for n in range(1, 60)] + [(8, "same", "b", 1, 1, 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, copies int, `u` int")
    got = source_mix.pareto_mix(df, keep=True)
    assert got.columns[:-1] == df.columns and got.columns[-1].lower() not in {c.lower() for c in df.columns}
    n = {(r[0], r[1], r[2]): r[6] for r in got.collect()}
    want = {(r.doc_id, r["size"], r.source): r.copies for r in source_mix.pareto_mix(df).collect()}
    assert {(d, len((t or "").split()), s): c for (d, t, s), c in n.items()} == want and got.count() == df.count()


def test_mix_of_nothing_and_of_no_words(spark):
    assert source_mix.pareto_mix(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.taken, r.target) for r in source_mix.pareto_mix(df).collect()] == [(0, 0, 0.0)] * 2


def test_network_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    net = language_id.ByteConvNet(["a", "b"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, g = net.loss_gradient(x, y)
    for name in ("W2", "W4", "V", "c", "b3"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-6
        up = net.loss_gradient(x, y)[0]
        net.p[name][at] = old - 1e-6
        down = net.loss_gradient(x, y)[0]
        net.p[name][at] = old
        assert (up - down) / 2e-6 == pytest.approx(g[name][at], rel=1e-3)


def test_tables_equal_the_network():
    rng = np.random.default_rng(1)
    net = language_id.ByteConvNet(["a", "b", "c"], 4)
    x = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    p = language_id.probabilities(net, net.tables(), x)
    loss, _ = net.loss_gradient(x, np.array([0, 1, 2, 0, 1]))
    assert -np.log(p[np.arange(5), [0, 1, 2, 0, 1]] + 1e-9).mean() == pytest.approx(loss, rel=1e-4)


def brute_language(net, text):
    """(label, score) by the network's own layers, window after window, position after position."""
    import unicodedata

    if text is None or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    raw, total = text.encode(), np.zeros(len(net.labels))
    for at in range(0, len(raw), language_id.WINDOW):
        part = raw[at : at + language_id.WINDOW]
        emb = net.p["E"][np.frombuffer(part.ljust(language_id.WINDOW, b"\0"), np.uint8)]
        pooled = [np.max([emb[i : i + w].reshape(-1) @ net.p[f"W{w}"] + net.p[f"b{w}"] for i in range(language_id.WINDOW - w + 1)], 0) for w in language_id.WIDTHS]
        z = np.maximum(np.concatenate(pooled), 0) @ net.p["V"] + net.p["c"]
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(part)
    mean = total / len(raw)
    own = [k for k, x in enumerate(net.labels) if x != language_id.NONE]
    best = max(own, key=lambda k: (mean[k], -k))
    return net.labels[best], float(mean[best])


def test_prediction_equals_brute_force(spark, sf_dir):
    """Whole texts, window by window; equal probabilities go to the first label."""
    df = documents(spark, n=20)
    nets = [language_id.ByteConvNet(["a", "b", "c", language_id.NONE], 5), language_id.ByteConvNet(["x", "y"], 6)]
    nets[1].p["V"][:], nets[1].p["c"][:] = 0, 0
    for net in nets:
        got = sorted(((r.lang_pred, round(r.score, 3)) for r in language_id.predict(df, net).collect()))
        want = sorted((x, round(s, 3)) for x, s in (brute_language(net, r.text) for r in df.collect()))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-3)


def test_texts_in_no_learned_language_have_small_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.train(docs)
    odd = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 6, "人人生而自由，在尊严和权利上一律平等。" * 9, "QmFzZTY0IGVuY29kZWQgZGF0YSBnb2VzIGhlcmU" * 8]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert all(r.score < 0.3 for r in language_id.predict(df, net).collect())
    known = language_id.predict(docs.filter("lang is not null"), net).filter("lang_pred <> 'und'")
    assert known.filter("score >= 0.3").count() >= 0.98 * known.count()


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = registry.queries()["op7_language_id"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    j = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in j if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in j) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in j)


def test_language_of_odd_texts(spark):
    df = documents(spark)
    net = language_id.train(df)
    by = {}
    for r in language_id.predict(df, net).collect():
        by.setdefault(r.doc_id, r)
    assert {by[i].lang_pred for i in (0, 1, 2, 4)} == {"und"} and by[0].score == 0 and by[3].lang_pred == "en"
    assert language_id.train(df.withColumn("lang", F.lit(None).cast("string"))) is None
    none = language_id.predict(df, None)
    assert none.count() == df.count() and none.select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.predict(empty(spark), net).count() == 0
    kept = language_id.predict(df, net, keep=True)
    assert kept.columns == [*df.columns, "lang_pred", "_score"] and kept.count() == df.count()
    a = {r.doc_id: r.score for r in language_id.predict(df, net, slice_bytes=300).collect()}
    assert all(a[i] == pytest.approx(by[i].score, abs=1e-3) for i in by if len(str(i)))
