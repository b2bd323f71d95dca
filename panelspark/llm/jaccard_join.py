"""Documents linked by the Jaccard similarity of their word shingles, found by prefixes under several orders (operator 7).

If two sets have a similarity of t or more, then under any one order of all tokens the first n - ceil(t n) + 1 tokens of
both share a token. The first order is an index: equal prefix tokens bring documents together. Two more orders are filters:
a pair goes on only if its prefixes share enough tokens under each of them too. What is left is compared exactly.

Sets are known by a hash, so equal ones are one class from the start. A token's group isn't expanded into all pairs.
First its members are compared with a leader, which joins most groups into one component, then the components that are
left in a group with each other's leader; last, exactly, all members of a group that are still in different components.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import discard, small_batches, stored, table
from panelspark.llm.components import components
from panelspark.llm.words import Chunk, chunks, grams, mix

SHINGLE, PERCENT = 5, 75
#: Most frequent tokens that every order puts last. More or fewer change the work, never the result.
HEAVY = 500_000
#: Members of a heavy token's group that share a leader, about; leaders share one in turn.
FANOUT = 1024
#: Most bits of the table that says which sets take part in a comparison; beyond it more sets than needed are sent.
MASK_BITS = 1 << 25
#: Tokens of sets that are counted at a time when frequent ones are looked for.
COUNTED = 3_000_000
#: Counters of tokens that every task fills: for each of DEPTH slices of 16 bits of a token one for each value, sent in blocks.
DEPTH, WIDTH, BLOCK = 3, 1 << 16, 1 << 10
#: Sets of a token that are compared in one place by the exact rest; larger groups are cut, and each two parts meet in a place.
TOGETHER = 4096
#: Tokens before a place that are looked at so that a pair isn't made again at each token that it shares.
BEFORE = 8
#: Bridges are followed where their candidates are more than one for so many rows; the exact rest finds their links anyway.
LEAST_BRIDGES = 1000
#: Each gives an order of all tokens by their mixed bits; the index has an order of its own.
ORDERS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))

_U = np.uint64


def shingle_sets(c: Chunk, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted: runs of `size` words, or all words as one where there are fewer."""
    g, offsets = grams(c.hashes, c.offsets, size)
    out = []
    for i in range(len(c)):
        x = np.sort(g[offsets[i] : offsets[i + 1]])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif not len(x) and (short := c.hashes[c.offsets[i] : c.offsets[i + 1]]).size:
            x = mix((short * (np.arange(len(short), dtype=_U) * _U(2) + _U(0x632BE59BD9B4E019))).sum(keepdims=True) + _U(len(short)))
        out.append(x)
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set, 0 for the empty one."""
    n = np.array([len(x) for x in sets], np.int64)
    keys = np.zeros(len(sets), _U)
    if n.any():
        some = np.flatnonzero(n)
        keys[some] = mix(np.add.reduceat(mix(np.concatenate(sets) ^ _U(0x8EBC6AF09C88C6E3)), np.concatenate(([0], np.cumsum(n[some])[:-1]))) + n[some].astype(_U))
    return keys


def prefix_length(n: int) -> int:
    return n + (-PERCENT * n // 100) + 1


class Heavy:
    """The heavy tokens, sorted, and by frequency their ranks."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.ranks = np.argsort(np.lexsort((self.tokens, self.counts)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.tokens >> _U(44)] = True

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Index of each token among the heavy ones, or -1."""
        out = np.full(len(tokens), -1, np.int64)
        some = np.flatnonzero(self.maybe[tokens >> _U(44)])
        if len(some):
            at = np.minimum(np.searchsorted(self.tokens, tokens[some]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[some]
            out[some[hit]] = at[hit]
        return out

    def prefix(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens under the index's order: light ones by their bits, then heavy ones, rarest first. Also their places
        among the heavy ones."""
        p, at = prefix_length(len(tokens)), self.places(tokens)
        light = tokens[at < 0]
        if len(light) >= p:
            return light[:p], np.full(p, -1)
        heavy = np.flatnonzero(at >= 0)
        heavy = heavy[np.argsort(self.ranks[at[heavy]])[: p - len(light)]]
        return np.concatenate((light, tokens[heavy])), np.concatenate((np.full(len(light), -1), at[heavy]))


def slices(tokens: np.ndarray) -> list[np.ndarray]:
    """The token's counter in each row of counters."""
    return [((tokens >> _U(16 * r)) & _U(WIDTH - 1)).astype(np.int64) for r in range(DEPTH)]


def profiles(docs: DataFrame) -> DataFrame:
    """A row (doc_id, mark, key, n) for each document, mark being the hash of its text, and rows (block, counters) of each
    task's counters, in which every token of its different sets is counted."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("counters", pa.binary())])

    def run(batches):
        seen, counters = set(), np.zeros((DEPTH, WIDTH), np.int64)
        for batch in small_batches(batches):
            for c in chunks(batch, lower=True):
                sets = shingle_sets(c)
                keys = set_keys(sets)
                none = [pa.nulls(len(c), t) for t in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, len(c)), batch.column("mark").slice(c.first, len(c)), pa.array(keys.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), *none], schema=schema)
                fresh = []
                for k, x in zip(keys.tolist(), sets):
                    if len(x) and k not in seen:
                        seen.add(k)
                        fresh.append(x)
                if fresh:
                    for row, at in zip(counters, slices(np.concatenate(fresh))):
                        row += np.bincount(at, minlength=WIDTH)
        parts = counters.reshape(-1, BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, key long, n long, block int, counters binary")


def large_counters(profiles: DataFrame) -> np.ndarray:
    """Which counters stand out, summed over all tasks: those above the middle one of their row by FANOUT, or by six times
    the usual spread where that is more. A token that more sets hold raises all of its counters, in however many tasks it stands."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counters in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = sums.get(block, 0) + np.frombuffer(counters.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counters"])

    found = profiles.where("block IS NOT NULL").select("block", "counters").repartition("block").mapInArrow(add, "block int, counters binary")
    out = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK), np.int64)
    for block, counters in found.collect():  # DEPTH * WIDTH counters at any size of the table
        out[block] = np.frombuffer(counters, np.int64)
    out = out.reshape(DEPTH, WIDTH)
    middle = np.median(out, axis=1, keepdims=True)
    spread = 1.4826 * np.median(np.abs(out - middle), axis=1, keepdims=True)
    return out >= middle + np.maximum(FANOUT, 6 * spread)


def token_counts(docs: DataFrame, large: np.ndarray) -> DataFrame:
    """(token, df) of the tokens whose counters all stand out, counted in the different sets of every task, and of those that
    a task finds again among COUNTED tokens."""
    flags = docs.sparkSession.sparkContext.broadcast(large)

    def frequent(held: list[np.ndarray]):
        tokens, df = np.unique(np.concatenate(held), return_counts=True)
        some = np.logical_and.reduce([row[at] for row, at in zip(flags.value, slices(tokens))]) | (df > 1)
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(df[some])], ["token", "df"])

    def run(batches):
        held, total, seen = [], 0, set()
        for batch in small_batches(batches):
            for c in chunks(batch, lower=True):
                sets = shingle_sets(c)
                for k, x in zip(set_keys(sets).tolist(), sets):
                    if len(x) and k not in seen:
                        seen.add(k)
                        held.append(x)
                        total += len(x)
                if total > COUNTED:
                    yield from frequent(held)
                    held, total = [], 0
        if held:
            yield from frequent(held)

    return docs.select("doc_id", "text").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def heavy_tokens(counts: DataFrame, bound: int = HEAVY) -> Heavy:
    """About the `bound` most frequent tokens: all above a level of frequency, which a histogram tells, and of that level as
    many as there is room for, chosen by their bits."""
    counts = counts.withColumn("level", F.floor(8 * F.log2("df")).cast("int"))
    cut, room, share = -1, bound, 0.0
    for level, n in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # 8 levels for each bit of a count
        if n > room:
            cut, share = level, room / n
            break
        room -= n
    chosen = (F.col("level") > cut) | ((F.col("level") == cut) & (F.pmod(F.shiftright("token", 12), F.lit(1 << 20)) < int(share * (1 << 20))))
    found = counts.where(chosen).select("token", "df").toArrow()
    return Heavy(found["token"].to_numpy().view(_U), found["df"].to_numpy())


def postings(docs: DataFrame, heavy) -> DataFrame:
    """(token, salt, n, key, pos): each set's prefix under the first order, once for each task. Heavy tokens' rows are dealt
    over groups of about FANOUT by a salt from 1 on; its values nest from token to token. Rows that aren't dealt have salt 0.
    pos is the token's place in its set."""

    def run(batches):
        order, seen = heavy.value, set()
        salts = (1 << np.ceil(np.log2(np.maximum(order.counts / FANOUT, 1))).astype(np.int64)) - 1
        for batch in small_batches(batches):
            for c in chunks(batch, lower=True):
                tokens, sizes, places, at = [], [], [], []
                sets = shingle_sets(c)
                keys = set_keys(sets)
                for i, x in enumerate(sets):
                    if len(x) and (k := int(keys[i])) not in seen:
                        seen.add(k)
                        prefix, place = order.prefix(x)
                        tokens.append(prefix)
                        places.append(place)
                        sizes.append(len(x))
                        at.append(i)
                if tokens:
                    n = [len(x) for x in tokens]
                    key, place = np.repeat(keys[at].view(np.int64), n), np.concatenate(places)
                    most = np.where(place < 0, 0, salts[place] if len(salts) else 0)
                    salt = np.where(most > 0, 1 + ((key >> 20) & most), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(key), pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in n]))], ["token", "salt", "n", "key", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, salt int, n int, key long, pos int")


def shared(rows: DataFrame) -> DataFrame:
    """Of rows (token, salt, n, key, pos), each once, those that could match another of their token: a row's size fits the
    size of one of its neighbours by size. lead is the set that a row's set is to be compared with first: the first of its
    size class, or for that one the last of the class below, if their places allow a link. Where only two rows of a token
    fit each other, lead says all, and the other columns are null. A dealt token's rows all stay, as the other set may be
    under any of its salts; head marks the first of a size class there. Streams its partition in order, and holds a row
    between batches."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("pos", pa.int32()), ("lead", pa.int64()), ("head", pa.bool_())])

    def run(batches):
        held = near_before = last_lead = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                if held is None:
                    return
                cols = held
            else:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols)]
            t, s, n, k, _ = cols
            once = np.ones(len(t), bool)
            once[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])
            t, s, n, k, pos = cols = [c[once] for c in cols]
            size = n.astype(np.int64)
            near, same, at = np.zeros(len(t), bool), np.zeros(len(t), bool), np.arange(len(t))
            kind = np.floor(np.log(size) / math.log(100 / PERCENT))
            both = (t[1:] == t[:-1]) & (s[1:] == s[:-1])
            near[1:] = both & (100 * size[:-1] >= PERCENT * size[1:])
            same[1:] = both & (kind[1:] == kind[:-1])
            first = np.maximum.accumulate(np.where(same, 0, at))
            lead = np.where(same, first, at - 1)
            lead_k, lead_n, lead_pos = k[lead], size[lead], pos[lead]
            if last_lead is not None:  # the first row was held; what leads it, and with it its class, came before
                of_held = first == 0 if last_lead[3] else at == 0
                lead_k, lead_n, lead_pos = (np.where(of_held, x, y) for x, y in zip(last_lead, (lead_k, lead_n, lead_pos)))
                near[0], same[0] = near_before, last_lead[3]
            tried = (same | near) & (np.minimum(size - pos, lead_n - lead_pos) * (100 + PERCENT) >= (size + lead_n) * PERCENT)
            runs = np.cumsum(~near)
            of_two = np.bincount(runs)[runs] == 2
            of_two &= (runs != runs[-1]) & ((runs != runs[0]) | (held is None)) & (s == 0)
            some = near | (s > 0)
            some[:-1] |= near[1:]
            some &= ~of_two | tried
            end = len(t) - (batch is not None)
            out = np.flatnonzero(some[:end])
            if len(out):
                alone, none = of_two[out], ~tried[out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(t[out], mask=alone), pa.array(n[out], pa.int32(), mask=alone), pa.array(k[out]), pa.array(pos[out], pa.int32(), mask=alone),
                    pa.array(lead_k[out], mask=none), pa.array((s[out] > 0) & ~same[out], mask=alone),
                ], schema=schema)
            held, near_before = [c[-1:] for c in cols], bool(near[-1])
            last_lead = lead_k[-1], lead_n[-1], lead_pos[-1], bool(same[-1])

    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key").mapInArrow(run, "token long, n int, key long, pos int, lead long, head boolean")


def fits(a: str, b: str):
    """Whether two sizes could match."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def enough(n, pos):
    """Whether a row's set and another, of n tokens with the row's token at pos, can link if that is the first token they
    share: they share what follows in either at most. A pair that links passes for one of its tokens."""
    return F.least(F.col("n") - F.col("pos"), n - pos) * (100 + PERCENT) >= (F.col("n") + n) * PERCENT


def stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys, linear in rows: each row's with what leads it, and the leaders of a salted token's class with one."""
    heads = rows.where("head").withColumn("class", F.floor(F.log("n") / math.log(100 / PERCENT)))
    top = heads.groupBy("token", "class").agg(F.min_by("key", F.struct("pos", "key")).alias("a"), F.count("*").alias("groups")).where("groups > 1")
    pairs = rows.where("lead IS NOT NULL").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    pairs = pairs.union(heads.join(top, ["token", "class"]).where("key <> a").select("a", "key"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mask(keys: DataFrame) -> np.ndarray:
    """Bits of which those of all keys are set: a table of bounded size, 32 bits a key where the bound allows."""
    words = max(1, min(MASK_BITS, 1 << math.ceil(math.log2(32 * max(keys.count(), 2)))) >> 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.groupBy(F.shiftright("key", 6).bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(_U)


def sketch(x: np.ndarray) -> bytes:
    """A set's size and 16 bits of each of its first tokens under the second order (half of the set) and the third (the
    shortest prefix that serves)."""
    n = len(x)
    parts = [np.array([n], np.uint32).view(np.uint16)]
    for factor, p in zip(ORDERS, (max(prefix_length(n), n // 2), prefix_length(n))):
        h = mix(x ^ factor)
        parts.append((np.sort(np.partition(h, p - 1)[:p]) & _U(0xFFFF)).astype(np.uint16))
    return np.concatenate(parts).tobytes()


def sets_of(docs: DataFrame, keys: DataFrame, column: str, kind: str, make) -> DataFrame:
    """(key, column) of the sets with these keys, once each, and of a few more; make gives what is kept of a set."""
    wanted = docs.sparkSession.sparkContext.broadcast(mask(keys))
    arrow = pa.binary() if kind == "binary" else pa.list_(pa.int64())

    def run(batches):
        bits, seen = wanted.value, set()
        for batch in small_batches(batches):
            for c in chunks(batch, lower=True):
                sets = shingle_sets(c)
                hashed = set_keys(sets)
                hit = (bits[(hashed >> _U(6)) & _U(len(bits) - 1)] >> (hashed & _U(63))) & _U(1)
                got = {int(hashed[i]): sets[i] for i in np.flatnonzero(hit).tolist() if len(sets[i]) and int(hashed[i]) not in seen}
                if got:
                    seen |= got.keys()
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(got), _U).view(np.int64)), pa.array(map(make, got.values()), arrow)], ["key", column])

    return docs.select("doc_id", "text").mapInArrow(run, f"key long, {column} {kind}").dropDuplicates(["key"])


def compared(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose sets' columns pass the test."""

    def run(batches):
        for batch in batches:
            keep = [test(x, y) for x, y in zip(values(batch.column(2)), values(batch.column(3)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("key").alias(x), F.col(column).alias(column + x)) for x in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", column + "a", column + "b").mapInArrow(run, "a long, b long")


def values(column: pa.Array):
    """Each row's set or sketch as an array."""
    if pa.types.is_list(column.type):
        return (v.values.to_numpy(zero_copy_only=False).view(_U) for v in column)
    return (np.frombuffer(v.as_py(), np.uint16) for v in column)


def may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sketches share as many tokens under both orders as those of linked sets must: sets of a and b tokens, of
    which m are common, have the first k of these among their first a - m + k and b - m + k. Equal bits of different tokens
    only add."""
    a, b = (int(v[:2].copy().view(np.uint32)[0]) for v in (x, y))
    m = -(-PERCENT * (a + b) // (100 + PERCENT))
    at = [(2, 2 + max(prefix_length(n), n // 2)) for n in (a, b)]
    for _ in ORDERS:
        (start_a, end_a), (start_b, end_b) = at
        k = min(end_a - start_a - (a - m), end_b - start_b - (b - m))
        if np.isin(x[start_a : start_a + a - m + k], y[start_b : start_b + b - m + k]).sum() < k:
            return False
        at = [(end, end + prefix_length(n)) for (_, end), n in zip(at, (a, b))]
    return True


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirmed(docs: DataFrame, passed: DataFrame) -> DataFrame:
    """The pairs whose similarity is large enough."""
    sets = sets_of(docs, passed.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "tokens", "array<long>", lambda x: x.view(np.int64))
    return stored(compared(passed, sets, "tokens", alike), "links")


def mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (token, size, n, pos, key, root, before) of the tokens whose sets, so many as size tells, are in different
    components; before holds the BEFORE such tokens that come before in the set. Of tokens that have the same
    sets only the first is kept: all orders agree on it, so it stands before the others in every set."""
    rows = rows.join(found.withColumnsRenamed({"node": "key"}), "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = rows.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("pos").alias("pos"), F.min("key").alias("least"), F.max("key").alias("most"),
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("key")).alias("hash"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum"),
    )
    first = groups.where("low <> high").groupBy("least", "most", "size", "hash", "sum").agg(F.min_by("token", F.struct("pos", "token")).alias("token"))
    rows = rows.join(first.select("token", "size"), "token")
    before = F.collect_list("token").over(Window.partitionBy("key").orderBy("pos").rowsBetween(-BEFORE, -1))
    return rows.select("token", "size", "n", "pos", "key", "root", before.alias("before"))


def bridges(rows: DataFrame) -> DataFrame:
    """Of mixed rows the pairs (a, b): for each token and component the set with the fewest tokens before, with the first
    of these in its size class."""
    rows = rows.groupBy("token", "root").agg(F.min(F.struct("pos", "key", "n")).alias("own")).select("token", "own.*")
    rows = rows.withColumn("class", F.floor(F.log("n") / math.log(100 / PERCENT)))
    rows = rows.withColumn("lead", F.min(F.struct("pos", "key", "n")).over(Window.partitionBy("token", "class")))
    rows = rows.where((F.col("key") != F.col("lead.key")) & enough(F.col("lead.n"), F.col("lead.pos")))
    return rows.select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")).distinct()


def apart(rows: DataFrame) -> DataFrame:
    """All pairs of keys of mixed rows that could match by size and place, and are in different components. A pair whose
    sets have a token in common among those just before meets there too, and fits there by place if it does here. A group
    is cut into parts of about TOGETHER rows, each two of which meet in a place of their own, as does each with itself."""
    parts = F.ceil(F.col("size") / TOGETHER).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("token", F.least("part", "met").alias("low"), F.greatest("part", "met").alias("high"), "part", "n", "pos", "key", "root", "before")
    other = rows.toDF("token", "low", "high", "part_b", "n_b", "pos_b", "b", "root_b", "before_b")
    pairs = rows.join(other, ["token", "low", "high"]).where((F.col("low") == F.col("high")) | (F.col("part") != F.col("part_b")))
    pairs = pairs.where((F.col("key") < F.col("b")) & (F.col("root") != F.col("root_b")) & fits("n", "n_b") & enough(F.col("n_b"), F.col("pos_b")) & ~F.arrays_overlap("before", "before_b"))
    return pairs.select(F.col("key").alias("a"), "b").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) and mark (xxhash64 of the text) of every document.

    Two documents link when 100 * |intersection| >= 75 * |union| of their shingle sets. A null, empty or blank text has no
    shingles and its own id; very long texts are read whole. Repeated rows give repeated rows; a row without an id keeps a null component unless it links
    with others. An empty table gives no rows. Other columns aren't read.
    """
    context = docs.sparkSession.sparkContext
    made = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    known = stored(profiles(docs), "profiles")
    counts = stored(token_counts(docs, large_counters(known)), "tokens")
    heavy = context.broadcast(heavy_tokens(counts))
    discard(counts)
    rows = stored(shared(postings(docs, heavy)), "postings")
    tried = kept(stars(rows), "pairs")
    keys = rows.where("token IS NOT NULL").select("key").union(tried.select(F.explode(F.array("a", "b")))).distinct()
    sketches = kept(sets_of(docs, keys, "sketch", "binary", sketch), "sketches")
    passed = stored(compared(tried, sketches, "sketch", may_link), "candidates")
    linked = confirmed(docs, passed)
    found = components(linked)
    made += linked, found
    left = stored(mixed(rows.where("token IS NOT NULL").select("token", "n", "pos", "key"), found), "mixed")
    discard(rows, passed)
    pairs = kept(bridges(left).join(tried, ["a", "b"], "left_anti"), "pairs")
    passed = kept(compared(pairs, sketches, "sketch", may_link), "candidates")
    if passed.count() * LEAST_BRIDGES > left.count():
        more = confirmed(docs, passed)
        tried, linked = tried.union(pairs), linked.union(more)
        found, rows = components(linked), left
        made += more, found
        left = stored(mixed(rows.select("token", "n", "pos", "key"), found), "mixed")
        discard(rows)
    pairs = stored(apart(left).join(tried, ["a", "b"], "left_anti"), "pairs")
    passed = kept(compared(pairs, sketches, "sketch", may_link), "candidates")
    discard(left, pairs)
    if passed.take(1):
        more = confirmed(docs, passed)
        found = components(linked.union(more))
        made += more, found
    ids = known.where("n IS NOT NULL")
    sets = ids.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    sets = kept(sets.join(found.withColumnsRenamed({"node": "key"}), "key", "left").withColumn("root", F.coalesce("root", "key")), "sets")
    roots = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(sets.join(roots, "root").select("key", "component_id"), "components")
    discard(*made)
    return ids.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "mark")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("mark")
