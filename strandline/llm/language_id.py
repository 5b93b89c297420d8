"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into fixed windows of 256 (the last padded with 0). Bytes are embedded,
filters of widths 2, 3 and 4 slide over each window, their largest values feed a softmax layer, and
the probabilities of a text's windows are averaged by how full the windows are. For prediction each
filter is unrolled into tables over byte pairs, so a window costs five table look-ups a byte.

Training takes some per_lang documents of each of the most_langs commonest languages (each document
with the chance per_lang / their number, by a hash of id and text), and a stretch of at most piece_chars
characters of each. Never more than 2 * per_lang * languages: beyond, those with the largest hashes are left out.
That is the documented bound; prediction reads every text whole, in slices of bounded memory.

Beside the languages the network learns one class of none of them: windows of the sample whose letters are
exchanged at random, and random letters of other scripts. It is never predicted; it takes probability, so the
score of a text that is in no learned language is small.

A null text and one without letters are `und` with score 0; so is every text if no label was given.
Ties go to the label that sorts first. Repeated rows get equal results. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, give_back, slices, table, text_buffers

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
PER_LANG, MOST_LANGS, PIECE_CHARS, EPOCHS, BATCH, SEED = 1200, 1000, 1024, 6, 64, 11
UNKNOWN = "und"
#: The network's last class: no learned language.
NONE = ""


class ByteConvNet:
    """Weights and training; `tables` unrolls it for prediction."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED)), "V": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "c": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"W{w}"], self.p[f"b{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)), np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n = self.p, len(x)
        emb = p["E"][x]
        parts, tops = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
            a = cols @ p[f"W{w}"] + p[f"b{w}"]
            at = a.argmax(1)
            tops.append(at)
            parts.append(np.take_along_axis(a, at[:, None, :], 1)[:, 0])
        pooled = np.concatenate(parts, 1)
        h = np.maximum(pooled, 0)
        z = h @ p["V"] + p["c"]
        z -= z.max(1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(1, keepdims=True)
        loss = -np.log(prob[np.arange(n), y] + 1e-9).mean()
        dz = prob
        dz[np.arange(n), y] -= 1
        dz /= n
        g = {"V": h.T @ dz, "c": dz.sum(0), "E": np.zeros_like(p["E"])}
        dh = (dz @ p["V"].T) * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            d, at = dh[:, k * FILTERS : (k + 1) * FILTERS], tops[k]
            bytes_at = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]  # n, filter, offset
            here = p["E"][bytes_at].reshape(n, FILTERS, w * EMBED)
            g[f"W{w}"] = np.einsum("nf,nfk->kf", d, here)
            g[f"b{w}"] = d.sum(0)
            back = d[:, :, None] * p[f"W{w}"].T[None]
            np.add.at(g["E"], bytes_at.reshape(-1), back.reshape(-1, EMBED))
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = SEED) -> "ByteConvNet":
        rng, step = np.random.default_rng(seed), 0
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                _, g = self.loss_gradient(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
                for k, v in self.p.items():
                    a, b = m[k]
                    a += 0.1 * (g[k] - a)
                    b += 0.001 * (g[k] ** 2 - b)
                    v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
        return self

    def tables(self) -> tuple:
        p = self.p
        one = {(w, j): p["E"] @ p[f"W{w}"][j * EMBED : (j + 1) * EMBED] for w in WIDTHS for j in range(w)}
        pair = lambda w, j: (one[w, j][:, None, :] + one[w, j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32)
        return pair(2, 0) + p["b2"], pair(3, 0) + p["b3"], one[3, 2].astype(np.float32), pair(4, 0) + p["b4"], pair(4, 2)


def probabilities(net: ByteConvNet, tables: tuple, x: np.ndarray, step: int = 128) -> np.ndarray:
    """Class probabilities of windows (n, WINDOW)."""
    t2, t3, s3, t4, u4 = tables
    out = np.empty((len(x), len(net.labels)), np.float32)
    for i in range(0, len(x), step):
        b = x[i : i + step]
        pairs = (b[:, :-1].astype(np.int64) << 8) | b[:, 1:]
        h = np.concatenate([t2[pairs].max(1), (t3[pairs[:, :-1]] + s3[b[:, 2:]]).max(1), (t4[pairs[:, :-2]] + u4[pairs[:, 2:]]).max(1)], 1)
        z = np.maximum(h, 0) @ net.p["V"] + net.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        out[i : i + step] = z / z.sum(1, keepdims=True)
    return out


def windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each window, bytes in each window); every text has one at least."""
    size = end - start
    n = np.maximum(1, -(-size // WINDOW))
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    fill = np.clip(size[of] - k * WINDOW, 0, WINDOW)
    at = (start[of] + k * WINDOW)[:, None] + np.arange(WINDOW)
    ok = np.arange(WINDOW) < fill[:, None]
    x = np.where(ok, raw[np.minimum(at, max(len(raw) - 1, 0))], 0) if len(raw) else np.zeros(at.shape, np.uint8)
    return x.astype(np.uint8), of, fill


def none_windows(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n windows of no language: letters of windows of x exchanged, other scripts, and letters and digits without order."""
    out = x[rng.integers(0, len(x), n)].copy()
    for k in range(n):
        kind, space = k % 4, rng.random(WINDOW) < 0.15
        if kind < 2:
            to = np.arange(256, dtype=np.uint8)
            to[97:123] = rng.permutation(26) + 97
            to[65:91] = to[97:123] - 32
            out[k] = to[out[k]]
        elif kind == 2:
            wide, lead = int(rng.integers(2, 4)), int(rng.integers(0xC4, 0xE0))
            row = rng.integers(0x80, 0xC0, WINDOW)
            row[::wide] = lead + rng.integers(0, 2, len(row[::wide])) if wide == 2 else rng.integers(0xE1, 0xEE)
            out[k] = np.where(np.repeat(space[::wide], wide)[:WINDOW], 0x20, row)
        else:
            letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=;(){}", np.uint8)
            out[k] = np.where(space & (k % 8 == 3), 0x20, letters[rng.integers(0, (26, 62, len(letters))[k % 3], WINDOW)])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, piece_chars: int = PIECE_CHARS, seed: int = SEED, most_langs: int = MOST_LANGS) -> ByteConvNet | None:
    """A network from the labelled rows of docs; None if there are none. The counts of at most most_langs languages go to the driver."""
    own = docs.select(col(id_col).alias("k"), col(text_col).alias("t"), col(lang_col).alias("l")).filter("t is not null and l is not null")
    counts = {r["l"]: r["count"] for r in own.groupBy("l").count().orderBy(F.desc("count"), "l").limit(most_langs).collect()}
    if not counts:
        return None
    part = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_lang / n))])
    unit = (F.xxhash64(F.col("k"), F.lit(seed), F.col("t")).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    begin = F.pmod(F.xxhash64(F.col("k"), F.lit(seed + 1), F.col("t")), F.greatest(F.lit(1), F.char_length("t") - piece_chars + 1)) + 1
    rows = own.filter(unit < F.element_at(part, F.col("l"))).select("k", "l", F.substring(F.col("t"), begin.cast("int"), F.lit(piece_chars)).alias("t"), (unit / F.element_at(part, F.col("l"))).alias("turn"))
    rows = sorted(rows.orderBy("turn", "k", "t").limit(2 * per_lang * len(counts)).collect(), key=lambda r: (r["l"], str(r["k"]), r["t"]))
    labels = sorted(counts)
    text = [r["t"].encode() for r in rows]
    end = np.cumsum([len(t) for t in text]).astype(np.int64)
    x, of, fill = windows(np.frombuffer(b"".join(text), np.uint8), end - np.array([len(t) for t in text], np.int64), end)
    y = np.array([labels.index(r["l"]) for r in rows])[of]
    rng = np.random.default_rng(seed)
    short = rng.random(len(x)) < 0.2  # short windows too, as short texts have
    cut = rng.integers(12, WINDOW, len(x))
    x[short[:, None] & (np.arange(WINDOW) >= cut[:, None])] = 0
    keep = fill > 8
    weigh = np.bincount(y[keep], minlength=len(labels))
    most = max(1, int(np.median(weigh[weigh > 0]) * 1.5))  # no language drowns the others
    order = rng.permutation(np.flatnonzero(keep))
    nth = np.zeros(len(order), np.int64)
    for c in range(len(labels)):
        of_c = y[order] == c
        nth[of_c] = np.arange(of_c.sum())
    order = order[nth < most]
    if not len(order):
        return None
    x, y = x[order], y[order]
    none = none_windows(x, most, rng)
    return ByteConvNet([*labels, NONE], seed).fit(np.concatenate([x, none]), np.concatenate([y, np.full(len(none), len(labels))]), seed=seed)


def predict(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1 << 20, keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; with keep, every column of docs, and these two last, under names that no other column has."""
    if keep:
        return _predict_beside(docs, net, text_col, slice_bytes)
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return own.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        import pyarrow as pa

        for batch, pred, score in _scored(batches, net, 1, 2, slice_bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0), pred, score], ["doc_id", "lang_pred", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _scored(batches, net: ByteConvNet, text: int, letters: int, slice_bytes: int):
    """Slices of the batches with the label and score of each row; text and letters are column numbers."""
    import pyarrow as pa

    slice_bytes = max(WINDOW, slice_bytes // WINDOW * WINDOW)  # windows start where they do in a whole text
    tables, names = net.tables(), [x for x in net.labels if x != NONE]
    labels = np.array([*names, UNKNOWN], object)
    for batch in batches:
        raw, start, end = text_buffers(batch.column(text))
        for i, j in slices(start, end, slice_bytes):
            total, weight = np.zeros((j - i, len(net.labels))), np.zeros(j - i)
            for lo in range(0, int((end[i:j] - start[i:j]).max()) + 1 if j == i + 1 else 1, slice_bytes):  # a text longer than a slice, piece by piece
                s = start[i:j] + lo
                x, of, fill = windows(raw, s, np.minimum(end[i:j], s + slice_bytes) if j == i + 1 else end[i:j])
                prob = probabilities(net, tables, x)
                w = np.maximum(fill, 1e-3)
                total += np.stack([np.bincount(of, prob[:, c] * w, j - i) for c in range(len(net.labels))], 1)
                weight += np.bincount(of, w, j - i)
            mean = total / weight[:, None]
            best, ok = mean[:, : len(names)].argmax(1), np.asarray(batch.column(letters).slice(i, j - i))
            score = np.where(ok, np.clip(mean[np.arange(j - i), best], 0, 1), 0.0)
            yield batch.slice(i, j - i), pa.array(labels[np.where(ok, best, len(names))], pa.string()), pa.array(score)


def _predict_beside(docs: DataFrame, net: ByteConvNet | None, text_col: str, slice_bytes: int) -> DataFrame:
    pred_name, score_name, letters_name = fresh(docs.columns, "lang_pred", "score", "letters")
    if net is None:
        return docs.withColumns({pred_name: F.lit(UNKNOWN), score_name: F.lit(0.0)})
    own = docs.withColumn(letters_name, F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False)))
    text, letters, docs_columns = own.columns.index(text_col), len(own.columns) - 1, docs.columns

    def run(batches):
        import pyarrow as pa

        for batch, pred, score in _scored(batches, net, text, letters, slice_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pred, score], [*docs_columns, pred_name, score_name])
        give_back()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(pred_name, StringType()), StructField(score_name, DoubleType())])
    # Names with dots cannot be arguments of a function over batches: columns go by number there.
    return own.toDF(*[f"c{k}" for k in range(len(own.columns))]).mapInArrow(run, schema)


def held_out(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
