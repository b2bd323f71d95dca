"""Encoding to token ids and decoding back (operator 6)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from panelspark.llm.bpe import WORD_SPLIT, WORD_SPLIT_ASCII, heap_merge, rank_array_merge, vocabulary
from panelspark.llm.common import small_batches, table, texts

#: Words whose ids a Python worker remembers; beyond it the memory is emptied and begun anew.
CACHE_WORDS = 500_000
#: Symbols up to which the rank array is used; its rounds scan the whole word, so longer words go to the heap.
SHORT = 100


class WordIds(dict):
    """By word the tuple of its ids."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)

    def __missing__(self, word: str) -> tuple[int, ...]:
        v = self.vocabulary
        parts = v.symbols(word)
        if len(parts) <= SHORT:
            parts = rank_array_merge(parts, v.ranks)
        else:
            parts = [p for p in heap_merge(parts, v.ranks)[0] if p is not None]
        ids = tuple(map(v.ids.__getitem__, parts))
        if len(word) < 64:
            self[word] = ids
        return ids


class Written(dict):
    """By a word's ids how they are written: their number, the decimal ids and the decoded tokens, each joined by a space."""

    def __init__(self, tokens: dict[int, str]):
        self.tokens = tokens

    def __missing__(self, ids: tuple[int, ...]) -> tuple[int, str, str]:
        out = len(ids), " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids))
        if len(ids) < 64:
            self[ids] = out
        return out


@lru_cache(1)
def later_unicode() -> tuple[str, dict[int, str]]:
    """Where the Unicode tables at hand differ, asked of the library itself: as ranges of a character class the letters and
    numbers that `regex` knows but the library does not; and lower-case forms that only the library knows. All are among the
    code points that unicodedata, the oldest of the three, does not know."""
    unknown = "".join(ch for ch in map(chr, range(0x80, 0x110000)) if unicodedata.category(ch) == "Cn")
    ranges: list[list[int]] = []
    newer = "".join(regex.findall(r"[\p{L}\p{N}]", unknown))
    other = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]+"), "removed").pre_tokenize_str(newer)
    for at in map(ord, "".join(piece for piece, _ in other)):
        if ranges and ranges[-1][1] == at - 1:
            ranges[-1][1] = at
        else:
            ranges.append([at, at])
    lower = normalizers.Lowercase()
    forms = {ord(ch): low for ch in regex.findall(r"[^\P{Lu}]|\p{Lt}", unknown) if (low := lower.normalize_str(ch)) != ch}
    if lower.normalize_str(unknown) != unknown.translate(forms):  # another form than a capital letter has one
        forms = {ord(ch): low for ch in unknown if (low := lower.normalize_str(ch)) != ch}
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges), forms


class Codec:
    """Encodes and decodes as a vocabulary file of word BPE says: canonical composition, white space to one space, lower
    case, words by pattern, end-of-word suffix; no decoder, so decoding joins tokens by a space. later: see later_unicode."""

    def __init__(self, path: str, later: tuple[str, dict[int, str]] | None = None):
        self.words, self.vocabulary = WordIds(path), vocabulary(path)
        self.written = Written(self.vocabulary.tokens)
        self.ascii, self.any = re.compile(WORD_SPLIT_ASCII, re.ASCII).findall, regex.compile(WORD_SPLIT).findall
        ranges, self.forms = later or later_unicode()
        self.odd = regex.compile("[" + ranges + "".join(f"\\U{k:08x}" for k in self.forms) + "]") if ranges or self.forms else None
        known = WORD_SPLIT.replace(r"[^\s\p{L}\p{N}]+", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{ranges}])+").replace(r"\p{L}+", rf"[\p{{L}}--[{ranges}]]+").replace(r"|\p{N}|", rf"|[\p{{N}}--[{ranges}]]|")
        self.exact = regex.compile(known, regex.V1).findall if ranges else self.any

    def encode_words(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a whole text, a tuple for each word."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.written.clear()
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return list(map(self.words.__getitem__, self.split(text)))
        out = []
        for piece in self.vocabulary.special_split.split(text):
            out += [(special[piece],)] if piece in special else map(self.words.__getitem__, self.split(piece))
        return out

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text.lower())
        text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
        split = self.any
        if self.odd and self.odd.search(text):
            split, text = self.exact, text.translate(self.forms)
        # letter by letter: str.lower() of a whole word writes a final sigma in another way
        return split("".join(map(str.lower, text)) if "Σ" in text else text.lower())

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded text of every text; see `digests` for the narrow form.

    A null or empty text has no ids and decodes to the empty string; very long ones are read whole. Repeated rows give repeated rows, an empty table none.
    Other columns aren't read.
    """
    later = later_unicode()

    def run(batches):
        codec = _codecs.setdefault(tokenizer, Codec(tokenizer, later))
        for batch in small_batches(batches):
            ids = [codec.encode(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode_decode with both sequences hashed where they are made.

    A null or empty text has 0 tokens and the hash of the empty string twice; very long ones are read whole. Repeated rows give repeated rows, an empty
    table none. Other columns aren't read.
    """
    later = later_unicode()

    def run(batches):
        codec = _codecs.setdefault(tokenizer, Codec(tokenizer, later))
        for batch in small_batches(batches):
            out = []
            for text in texts(batch):
                n, ids, tokens = zip(*x) if (x := list(map(codec.written.__getitem__, codec.encode_words(text)))) else ((), (), ())
                out.append((sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(tokens).encode()).hexdigest()))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
