"""Streams: block-wise EM over arriving windows, and window counts by event position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.learning import blended, em_step


class BlockEm:
    """EM that takes each micro-batch as a block and blends its estimate with rate 1 / (t + 1) ** decay.

    Use `writeStream.foreachBatch(block_em)`; a batch that Spark repeats is recognised by its number.
    """

    def __init__(self, model: DataFrame, prior: DataFrame, background: DataFrame, weights: DataFrame, pca: float = 0.01, decay: float = 0.6):
        self.model, self.prior, self.background, self.weights, self.pca, self.decay = model, prior, background, weights, pca, decay
        self.seen, self.lls = -1, []

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.seen or batch.isEmpty():
            return
        model, prior, ll = em_step(batch, self.model, self.prior, self.background, self.weights, self.pca)
        eta = 1.0 / (len(self.lls) + 1) ** self.decay
        self.model = blended(self.model, model, eta, ["k", "j", "a"]).checkpoint()
        self.prior = blended(self.prior, prior, eta, ["k"], "prior").checkpoint()
        self.lls.append(ll.first()[0])
        self.seen = number


def letter_rates(events: DataFrame, ts: str = "ts", letter: str = "a", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window, letter, n over event time, with late events dropped behind the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), letter).agg(F.count(F.lit(1)).alias("n"))


def appended(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A stream written as Parquet once; available input is processed and the query ends."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
