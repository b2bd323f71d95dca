"""A factorisation machine that scores quality (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import crc_mod, discard, small_batches, stored, table
from panelspark.llm.quality_rules import _SYMBOL, duplicate_lines, repeated_words, sums
from panelspark.llm.words import Chunk, chunks

#: Labelled documents that the model learns from, about (chosen by a hash of id and text).
SAMPLE = 5_000
#: Buckets of hashed words; factors of each feature; passes over the sample, documents of a step, learning rate.
BUCKETS, FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 1 << 15, 8, 8, 128, 0.02, 1e-4, 11
GOOD = 0.7
#: Structure statistics and metadata, each a feature of its own behind the words' buckets.
STATISTICS = ["log_words", "word_length", "symbols", "upper", "digits", "marks", "duplicate_lines", "repeated_words", "distinct_words", "words_a_line", "log_n_chars"]
_U = np.uint64
_UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"))


def features(c: Chunk, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: offsets of each text, feature numbers and values. A word's value is its share of the text's words,
    times the root of their number over 2; a statistic's is about 0 to 1."""
    n = np.diff(c.offsets)
    some, size = np.maximum(n, 1), np.maximum(np.diff(c.text_offsets), 1)
    of = np.repeat(np.arange(len(c)), n)
    keys, counts = np.unique((of.astype(_U) << _U(32)) | (c.hashes >> _U(64 - BUCKETS.bit_length() + 1)), return_counts=True)
    row, bucket = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
    share = counts / np.sqrt(some[row]) / 2
    rate = lambda flags: sums(flags[c.data], c.text_offsets) / size
    words_bytes = np.diff(np.concatenate(([0], np.cumsum(c.ends - c.starts)))[c.offsets])
    lines = sums(c.data == 10, c.text_offsets) + 1
    stats = np.stack([
        np.log1p(n) / 10, np.minimum(words_bytes / some / 20, 2), rate(_SYMBOL) * 5, rate(_UPPER) * 2, rate(_DIGIT) * 2, rate(_MARK) * 5,
        duplicate_lines(c) / lines, repeated_words(c) / some, np.bincount(row, minlength=len(c)) / some, np.log1p(n / lines) / 5, np.log1p(np.maximum(n_chars, 0)) / 12,
    ], 1)
    row = np.concatenate((row, np.repeat(np.arange(len(c)), len(STATISTICS))))
    order = np.argsort(row, kind="stable")
    number = np.concatenate((bucket, np.tile(BUCKETS + np.arange(len(STATISTICS)), len(c))))[order]
    return np.searchsorted(row[order], np.arange(len(c) + 1)), number, np.concatenate((share, stats.ravel()))[order]


@dataclass
class Machine:
    """w0, w of each feature and V, its factors. y = w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum (v x)^2)."""

    w0: float
    w: np.ndarray
    V: np.ndarray

    def margin(self, offsets: np.ndarray, number: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the rows and their sums of factors; linear in the number of values. Every row has a value."""
        vx = self.V[number] * value[:, None]
        total = np.add.reduceat(vx, offsets[:-1])
        pairs = 0.5 * (total * total - np.add.reduceat(vx * vx, offsets[:-1])).sum(1)
        return self.w0 + np.add.reduceat(self.w[number] * value, offsets[:-1]) + pairs, total

    def score(self, *row) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*row)[0], -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Logistic loss, steps of BATCH rows scaled by each parameter's past gradients (AdaGrad). Labels 0 and 1 weigh alike in sum,
    up to a factor of 3 for the rarer one."""
    rng, size = np.random.default_rng(seed), BUCKETS + len(STATISTICS)
    model = Machine(0.0, np.zeros(size), rng.standard_normal((size, FACTORS)) * 0.02)
    past_w, past_V, past_0 = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    ones = max(labels.sum(), 1)
    weight = np.where(labels == 1, min(3.0, max(1.0, (len(labels) - ones) / ones)), min(3.0, max(1.0, ones / max(len(labels) - ones, 1))))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            offsets = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in pick])))
            number, value = (np.concatenate([rows[i][k] for i in pick]) for k in (0, 1))
            margin, total = model.margin(offsets, number, value)
            d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            of = np.repeat(np.arange(len(pick)), np.diff(offsets))
            dx = d[of] * value
            used, back = np.unique(number, return_inverse=True)
            gw = np.bincount(back, dx, len(used)) + DECAY * model.w[used]
            v = model.V[number]
            gv = dx[:, None] * (total[of] - v * value[:, None])
            gV = np.stack([np.bincount(back, gv[:, f], len(used)) for f in range(FACTORS)], 1) + DECAY * model.V[used]
            past_w[used] += gw * gw
            past_V[used] += gV * gV
            past_0 += d.sum() ** 2
            model.w[used] -= 5 * RATE * gw / np.sqrt(past_w[used])
            model.V[used] -= RATE * gV / np.sqrt(past_V[used])
            model.w0 -= 5 * RATE * d.sum() / np.sqrt(past_0)
    model.w, model.V = model.w.astype(np.float32), model.V.astype(np.float32)
    return model


def _rows(batch: pa.RecordBatch):
    """The batch's chunks with their features."""
    n_chars = batch.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False)
    for c in chunks(batch, lower=True):
        yield c, features(c, n_chars[c.first : c.last])


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars; n_chars is 0 where docs has no such column, or one of something else than whole numbers."""
    kind = dict(docs.dtypes).get("n_chars")
    n_chars = F.lit(0) if kind is None else F.col("n_chars") if kind in ("tinyint", "smallint", "int", "bigint") else F.col("n_chars").cast("string").try_cast("long")
    return docs.select("doc_id", "text", F.coalesce(n_chars.cast("long"), F.lit(0)).alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 4, fold: int = 2) -> Machine | None:
    """A machine fitted to about `sample` labelled documents among those whose crc32(doc_id) mod folds isn't fold.

    One pass meets labels with the documents' hashes, of which the sample is chosen; then one over docs makes its features.
    None without labels. Rows alike in id and text count once, so what comes to the driver is bounded whatever repeats. A
    document with several labels counts as good if any says so.
    """
    able = labels.where((crc_mod("doc_id", folds) != fold) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    met = stored(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark")).distinct().join(able, "doc_id"), "labelled")
    n = met.count()
    picked = met.where(F.pmod("mark", F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(n, 1))))
    label = {r.mark: r.quality for r in picked.collect()}
    discard(met)
    if not label:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(list(label), np.int64)))

    def draw(batches):
        for batch in small_batches(batches):
            batch = batch.filter(pa.array(np.isin(batch.column("mark").to_numpy(zero_copy_only=False), shared.value)))
            for c, (offsets, number, value) in _rows(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("mark").slice(c.first, len(c)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(number, pa.int32())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value, pa.float32()))],
                    ["mark", "number", "value"],
                )

    marked = inputs(docs).withColumn("mark", F.xxhash64("doc_id", "text"))
    found = marked.mapInArrow(draw, "mark long, number array<int>, value array<float>").dropDuplicates(["mark"]).toArrow().sort_by("mark")
    rows = [(np.array(a, np.int64), np.array(b, np.float64)) for a, b in zip(found["number"].to_numpy(), found["value"].to_numpy())]
    return train(rows, np.array([label[i] for i in found["mark"].to_pylist()], float)) if rows else None


def classify(docs: DataFrame, model: Machine | None) -> DataFrame:
    """doc_id and score of every document: the machine's probability of label 1.

    Null and empty texts have no words, only statistics, and are scored like any other; very long ones whole; without a
    model the score is 0.5.
    Repeated rows give repeated rows, an empty table none. Columns other than doc_id, text and n_chars aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in small_batches(batches):
            scores = np.full(len(batch), 0.5)
            for c, row in _rows(batch) if model else ():
                scores[c.first : c.last] = model.score(*row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    return inputs(docs).mapInArrow(run, "doc_id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
