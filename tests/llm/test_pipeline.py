"""The pipeline, stage by stage, against what each stage means."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import ngram_join, piece_sampling, source_mix

from .fixtures import documents, empty


def log_sum(pieces, word):
    """The log of the sum of the probabilities of all segmentations of a word, character by character."""
    back = [0.0] * (len(word) + 1)
    for i in range(len(word) - 1, -1, -1):
        ways = []
        for j in range(i + 1, min(len(word), i + pieces.longest) + 1):
            state = 0
            for c in word[i:j]:
                k = np.searchsorted(pieces.keys, state << 21 | ord(c))
                state = int(pieces.to[k]) if k < len(pieces.keys) and pieces.keys[k] == state << 21 | ord(c) else -1
                if state < 0:
                    break
            if state < 0:
                break
            if pieces.end[state] >= 0:
                ways.append(float(pieces.logp[pieces.end[state]]) + back[j])
        if not _covered(pieces, word[i]):
            ways.append(len(word[i].encode()) * float(pieces.logp.min()) + back[i + 1])
        back[i] = float(np.logaddexp.reduce(ways))
    return back[0]


def _covered(pieces, c):
    k = np.searchsorted(pieces.keys, ord(c))
    return k < len(pieces.keys) and pieces.keys[k] == ord(c) and pieces.end[pieces.to[k]] >= 0


def check_samples(mixed, last):
    """Counts, distinct segmentations, decoded texts and probabilities against sums over all segmentations."""
    pieces = piece_sampling.Pieces(piece_sampling.model_path())
    texts = {r.doc_id: r.text or "" for r in mixed.collect()}
    few = sorted(texts, key=lambda d: len(texts[d]))[:25]
    rows = piece_sampling.sample_pieces(mixed.filter(mixed.doc_id.isin(few)), piece_sampling.model_path(), with_ids=True).collect()
    sums = {}
    for r in rows:
        ids = np.array(r.ids, np.int64)
        assert pieces.decode(ids) == texts[r.doc_id] or not texts[r.doc_id]
        units = pieces.units(texts[r.doc_id])
        z = sum(sums.setdefault(u, log_sum(pieces, u)) for u in units)
        assert abs(float(pieces.logp[ids].sum()) - z - r.log_prob) < 1e-6 * max(1.0, abs(z))
    copies = Counter(r.doc_id for r in mixed.collect())
    found = Counter((r.doc_id, r["sample"]) for r in last.select("doc_id", "sample").collect())
    assert all(found[d, 1] == n for d, n in copies.items())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r["sample"]] = tuple(r.ids)
    assert all(len(set(x.values())) == len(x) for x in by.values())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir)
        assert out.columns == columns
        seen.append(out.cache())
    known, lines, unique, mixed = seen[1:]
    letters = {r.doc_id for r in docs.filter("text rlike '\\\\p{L}'").collect()}
    assert {r.doc_id for r in known.collect()} <= letters and known.count() >= 0.97 * len(letters)
    assert {r.doc_id for r in lines.collect()} == {r.doc_id for r in known.collect()}
    near = {r.doc_id: r.component_id for r in ngram_join.ngram_join(lines).collect()}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(d for d, c in near.items() if d == c)
    check_samples(mixed, corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir))
    taken = {r.doc_id: r.copies for r in source_mix.pareto_mix(unique).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(taken)
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(taken) and last.filter("not round_trip").count() == 0


def test_stages_take_odd_and_empty_tables(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "bucket", "h"]
    for df in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, "").cache()
            assert df.columns == columns
            df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= 0


def test_stages_keep_rows_of_odd_columns_and_ids(spark, sf_dir):
    """Names that the stages would like to use, null and repeated ids of different texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = ["_host", "_n", "_id", "_score", "_copy", "lang_pred", "score", "key", "copies", "tk", "a.b"]
    for c in extra:
        docs = docs.withColumn(c, docs.doc_id)
    ids = F.when(docs.doc_id % 3 == 0, None).when(docs.doc_id % 3 == 1, 1).otherwise(docs.doc_id)
    df = docs.withColumn("doc_id", ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "").cache()
        assert out.columns == df.columns
        assert {tuple(r[c] for c in extra) for r in out.collect()} <= {tuple(r[c] for c in extra) for r in df.collect()}
        assert all(len({r[c] for c in extra}) == 1 for r in out.collect())
        df = out
    # A third of the rows has id 1, a third none: their different texts are not thrown together.
    assert df.filter("doc_id is null").select("text").distinct().count() > 3 and df.filter("doc_id = 1").select("text").distinct().count() > 3


def test_registered():
    assert list(corpus_pipeline.queries()) == ["pipeline"] and 4 <= len(corpus_pipeline.STAGES) <= 5
