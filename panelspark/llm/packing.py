"""Packing of token streams into fixed windows by order-preserving dynamic programming (operator 9)."""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.bpe import SPLIT, heap_merge, vocabulary
from panelspark.llm.common import small_batches, table, texts

#: Costs in tokens of padding: of each window, of a cut at a sentence's end inside a document, of a cut elsewhere in it.
WINDOW_COST, SENTENCE_COST, BROKEN_COST = 8, 4, 48
#: Inside a stretch of over GAP tokens without a sentence's end, every STEP-th token is a place to cut.
GAP, STEP = 256, 128
#: Tokens of the stream that are planned together; the last two windows of a block are planned again with the next.
BLOCK = 1 << 18
#: Shortest power of two that counts as a full window.
LEAST_POWER = 64
#: Runs of white space from which the own splitter is used: the library's recursion grows with them.
LONG_SPACE = re.compile(r"\s{2000}")


class Encoder:
    """Ids as numpy arrays, equal to the tokenizers library's on the same vocabulary; and which ids end a sentence."""

    def __init__(self, tokenizer: str, ranks: str):
        self.vocabulary = v = vocabulary(tokenizer)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=table, special_tokens=v.special)
        self.ends = np.zeros(max(v.tokens) + 1, bool)
        for token, i in table.items():
            bare = token.rstrip(b" \"')]}*")
            self.ends[i] = bare[-1:] in (b".", b"!", b"?") or token[-1:] == b"\n"

    def encode(self, text: str) -> np.ndarray:
        if LONG_SPACE.search(text):
            return np.array(self.slowly(text), np.uint32)
        return self.library.encode_to_numpy(text, allowed_special="all")

    def slowly(self, text: str) -> list[int]:
        v, out = self.vocabulary, []
        for piece in v.special_split.split(text):
            if piece in v.special:
                out.append(v.special[piece])
            else:
                for word in regex.findall(SPLIT, piece):
                    out += [v.ids[p] for p in heap_merge(v.symbols(word), v.ranks)[0] if p is not None]
        return out


@lru_cache(2)
def encoder_of(tokenizer: str, ranks: str) -> Encoder:
    return Encoder(tokenizer, ranks)


def plan(ends: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Indices into `ends` (increasing token positions, the last is the stream's end, gaps of `size` at most) at which
    windows end, of least total cost: padding to `size` (none if the length is a power of two from LEAST_POWER on), plus
    WINDOW_COST for each, plus the cost of each cut.

    f[j] = cost[j] + size - end[j] + min(f[i] + end[i]) over the i within reach: a minimum over a sliding window, which a
    monotone queue gives in constant time; lengths that are a power of two are tried besides.
    """
    at = np.concatenate(([0], ends))
    exact: dict[int, list[int]] = {}
    power = LEAST_POWER
    while power <= size:
        i = np.searchsorted(at, at - power)
        for j in np.flatnonzero(at[np.minimum(i, len(at) - 1)] == at - power).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        power *= 2
    at_, own = at.tolist(), [0, *costs.tolist()]
    f, back = [0] * len(at_), [0] * len(at_)
    queue: deque[tuple[int, int]] = deque()
    for j in range(1, len(at_)):
        here = at_[j]
        key = f[j - 1] + at_[j - 1]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j - 1))
        while here - at_[queue[0][1]] > size:
            queue.popleft()
        best, i = queue[0]
        best += size - here
        for k in exact.get(j, ()):
            if f[k] < best:
                best, i = f[k], k
        f[j], back[j] = best + own[j] + WINDOW_COST, i
    cuts, j = [], len(at_) - 1
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


class Stream:
    """Documents in order, of which pieces of full windows come out."""

    def __init__(self, encoder: Encoder, size: int, end_id: int):
        self.encoder, self.size, self.end_id = encoder, size, end_id
        self.parts: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, its tokens, start in it, ids
        self.held = self.windows = 0

    def add(self, doc_id: int, text: str) -> None:
        ids = np.append(self.encoder.encode(text), np.uint32(self.end_id)).astype("<u4")
        self.parts.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where windows may end, and what a cut there costs."""
        ids = np.concatenate([p[3] for p in self.parts])
        doc_ends = np.cumsum([len(p[3]) for p in self.parts])
        cost = np.full(len(ids) + 1, -1, np.int64)
        cost[1:][self.encoder.ends[ids]] = SENTENCE_COST
        cost[doc_ends] = 0
        found = np.flatnonzero(cost >= 0)
        before = np.concatenate(([0], found[:-1]))
        for a, b in zip(before[wide := found - before > GAP].tolist(), found[wide].tolist()):
            cost[a + STEP : b : STEP] = BROKEN_COST
        ends = np.flatnonzero(cost >= 0)
        return ends, cost[ends]

    def take(self, last: bool = False) -> list[tuple]:
        """Pieces (doc_id, start, ids, doc_tokens, window, offset); what isn't planned for good stays."""
        if not self.held:
            return []
        ends, costs = self.places()
        cuts = plan(ends, costs, self.size)
        if not last:
            cuts = cuts[:-2]
        out, rest, parts, start = [], self.parts, iter(self.parts), 0
        doc, i = next(parts, None), 0
        for cut in ends[cuts].tolist():
            offset = 0
            while start + offset < cut:
                doc_id, n, first, ids = doc
                m = min(len(ids) - i, cut - start - offset)
                out.append((doc_id, first + i, ids[i : i + m], n, self.windows, offset))
                offset, i = offset + m, i + m
                if i == len(ids):
                    doc, i = next(parts, None), 0
            start = cut
            self.windows += 1
        if doc is None:
            rest = []
        else:
            doc_id, n, first, ids = doc
            rest = [(doc_id, n, first + i, ids[i:]), *parts]
        self.parts, self.held = rest, sum(len(p[3]) for p in rest)
        return out


def pack(docs: DataFrame, tokenizer: str, ranks: str, size: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Packs documents, in the order of each input partition, into sequences of `size` tokens at most: one row for each
    piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids the ids themselves.

    tokenizer, ranks: the same vocabulary as a file of the tokenizers and of the tiktoken library. A null or empty text
    is the end id alone. Repeated rows are packed as often as they come. An empty table gives no rows. Partitions are
    packed apart, so nothing passes through one task; each leaves at most one sequence that is short. A stretch of BLOCK
    tokens is planned by itself but for its last two windows, which are planned again with what follows: the plan is the best
    of each stretch, not of the whole partition. Memory follows BLOCK and the longest document. Other columns aren't read. A sequence_id is the partition's number and the window's in it.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    types = [pa.int64()] * 7

    def rows(found: list[tuple], at: int) -> pa.RecordBatch:
        columns = [
            [x[0] for x in found], [x[1] for x in found], [len(x[2]) for x in found], [zlib.crc32(x[2]) for x in found],
            [x[3] for x in found], [at << 33 | x[4] for x in found], [x[5] for x in found],
        ]
        names, kinds = schema.replace(" long", "").split(", "), types
        if keep_ids:
            columns, names, kinds = [*columns, [x[2].astype(np.int32) for x in found]], [*names, "ids"], [*types, pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches):
        encoder = encoder_of(tokenizer, ranks)
        at, stream = TaskContext.get().partitionId(), Stream(encoder, size, end_id)
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                stream.add(doc_id, text)
                if stream.held > BLOCK:
                    yield rows(stream.take(), at)
        yield rows(stream.take(last=True), at)

    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
