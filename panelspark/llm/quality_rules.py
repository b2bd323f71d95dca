"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio between trusted text and the corpus (operator 5)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import carried, small_batches, table
from panelspark.llm.words import CHUNK, Chunk, chunks, grams, hashes, mix

#: Buckets into which words and pairs of words are hashed; each model is so many numbers, at any size of the corpus.
BUCKETS = 1 << 16
#: Labelled good documents of which the trusted multinomial is made, about (chosen by a hash of the id).
TRUSTED = 20_000
#: Mean log-likelihood ratio for each n-gram below which a document is rejected.
THRESHOLD = -0.09
#: Added to every bucket's count.
PRIOR = 1.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def distinct(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    first = np.unique(mix(keys + of.astype(_U) * _U(0xD6E8FEB86659FD93)), return_index=True)[1]
    return np.bincount(of[first], minlength=n)


def duplicate_lines(c: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    if len(c.data) > 2 * CHUNK:
        lines = Counter(x for x in c.data.tobytes().split(b"\n") if x.split())
        return np.array([lines.total() - len(lines)])
    breaks = np.flatnonzero(c.data == 10)
    begin, end = c.text_offsets[:-1], c.text_offsets[1:]
    starts = np.sort(np.concatenate((begin, breaks + 1)))  # a break at a text's end opens an empty line there
    of = np.searchsorted(begin, starts, "right") - 1
    after = np.searchsorted(breaks, starts)
    stops = np.minimum(np.append(breaks, len(c.data))[after], end[of])
    some = np.searchsorted(c.starts, starts) < np.searchsorted(c.starts, stops)
    starts, stops, of = starts[some], stops[some], of[some]
    return np.bincount(of, minlength=len(c)) - distinct(hashes(c.data, starts, stops, False), of, len(c))


def repeated_words(c: Chunk, window: int = WINDOW) -> np.ndarray:
    """Words inside a run of `window` words that their text has twice or more."""
    g, offsets = grams(c.hashes, c.offsets, window)
    if not len(g):
        return np.zeros(len(c), np.int64)
    of = np.repeat(np.arange(len(c)), np.diff(offsets))
    key = mix(g + of.astype(_U) * _U(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = (np.arange(len(key)) - offsets[of] + c.offsets[of])[twice]
    change = np.zeros(len(c.hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return sums(np.cumsum(change[:-1]) > 0, c.offsets)


def buckets(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a chunk's words and pairs of words, and the text each is of."""
    pairs, offsets = grams(c.hashes, c.offsets, 2)
    of = np.concatenate((np.repeat(np.arange(len(c)), np.diff(c.offsets)), np.repeat(np.arange(len(c)), np.diff(offsets))))
    return (np.concatenate((c.hashes, pairs)) >> _U(64 - n.bit_length() + 1)).astype(np.int64), of


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> np.ndarray:
    """Ids of about `bound` documents labelled good: all, or those whose hash is low. Rows without an id or label count nothing."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n = good.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, bound / max(n, 1)))
    return np.sort(np.array([r[0] for r in good.where(share).collect()], np.int64))


def log_ratios(docs: DataFrame, trusted: np.ndarray, n_buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket the log of its share in the trusted documents over its share in all documents.

    Every document counts; each task adds up its own rows, and what is shuffled is a number for each bucket and task.
    """
    ids = docs.sparkSession.sparkContext.broadcast(trusted)

    def count(batches):
        raw, good = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in small_batches(batches):
            known = np.isin(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), ids.value) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for c in chunks(batch, lower=True):
                b, of = buckets(c, n_buckets)
                raw += np.bincount(b, minlength=n_buckets)
                good += np.bincount(b[known[c.first : c.last][of]], minlength=n_buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    found = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in found.collect():  # BUCKETS rows at most
        raw[r[0]], good[r[0]] = r[1], r[2]
    if not good.any():
        return np.zeros(n_buckets)
    return np.log((good + PRIOR) / (good.sum() + PRIOR * n_buckets)) - np.log((raw + PRIOR) / (raw.sum() + PRIOR * n_buckets))


def quality_rules(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts, base_failed, llr (mean log ratio of a text's words and pairs of words) and kept of every document.

    A null, empty or blank text has no words: its counts and llr are 0 and it fails the base rules. Very
    long texts are counted whole. Repeated rows give
    repeated rows, an empty table none. kept is llr >= threshold where the base rules pass. Columns named by carry
    are handed through; others aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        table = shared.value
        for batch in small_batches(batches):
            out = []
            for c in chunks(batch, lower=True):
                n = np.diff(c.offsets)
                b, of = buckets(c, len(table))
                total = np.bincount(of, table[b], len(c))
                llr = total / np.maximum(np.bincount(of, minlength=len(c)), 1)
                inside = np.zeros(len(c.data) + 1, np.int8)
                np.add.at(inside, c.starts, 1)
                np.add.at(inside, c.ends, -1)
                points = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((c.data & 0xC0) != 0x80)
                out.append((n, sums(points, c.text_offsets), sums(_SYMBOL[c.data], c.text_offsets), duplicate_lines(c), repeated_words(c), llr))
            cols = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]
            failed = (cols[0] < MIN_WORDS) | (100 * cols[4] > MAX_REPEAT_PERCENT * cols[0])
            kept = ~failed & (cols[5] >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols[:5]), pa.array(failed), pa.array(cols[5]), pa.array(kept), *map(batch.column, carry)], ["doc_id", *names, "base_failed", "llr", "kept", *carry])

    df, schema = carried(docs, carry, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, llr double, kept boolean")
    return df.mapInArrow(run, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, log_ratios(docs, trusted_ids(table(spark, sf_dir, "labels"))))
