"""Token counts without token ids (operator 10)."""

from __future__ import annotations

import re

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.bpe import SPLIT, SPLIT_ASCII, heap_merge, vocabulary
from panelspark.llm.common import small_batches, table, texts

#: Words whose counts a Python worker remembers; beyond it the memory is emptied and begun anew.
CACHE_WORDS = 700_000


class Counts(dict):
    """Counts by word: initial symbols minus the merges that the heap loop makes."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)

    def __missing__(self, word: str) -> int:
        parts = self.vocabulary.symbols(word)
        n = len(parts)
        count = n - heap_merge(parts, self.vocabulary.ranks)[2] if n > 1 else n
        if len(word) < 64:
            self[word] = count
        return count


_counts: dict[str, Counts] = {}


def count_tokens(text: str, counts: Counts) -> int:
    """Tokens of a whole text; a special token's string counts as that one token."""
    if len(counts) > CACHE_WORDS:
        counts.clear()
    total = 0
    special = counts.vocabulary.special
    pieces = counts.vocabulary.special_split.split(text) if special and any(s in text for s in special) else [text]
    for piece in pieces:
        if piece in special:
            total += 1
        elif piece:
            words = _ascii(piece) if piece.isascii() else _any(piece)
            total += sum(map(counts.__getitem__, words))
    return total


_ascii = re.compile(SPLIT_ASCII, re.ASCII).findall
_any = regex.compile(SPLIT).findall


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text.

    tokenizer: path of a byte-level BPE file of the tokenizers library, on every machine. A null or empty text has 0 bytes
    and 0 tokens. Repeated doc_ids give repeated rows, an empty table an empty result; other columns aren't read. Each
    task streams its rows; what a worker remembers is bounded by CACHE_WORDS, and long words are never remembered.
    """

    def run(batches):
        counts = _counts.setdefault(tokenizer, Counts(tokenizer))
        for batch in small_batches(batches):
            found = texts(batch)
            n = [count_tokens(t, counts) for t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
