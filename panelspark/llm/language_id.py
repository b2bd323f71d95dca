"""Language identification by a bidirectional gated recurrent network over bytes (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import carried, crc_mod, discard, small_batches, stored, table, texts
from panelspark.llm.words import Chunk, chunks

#: Documents of each language that the network learns from, about (chosen by a hash of id and text), and words of each.
SAMPLE_DOCS, SAMPLE_WORDS = 600, 60
#: The share of all labelled documents that a language needs to be learned. Rarer values of a dirty column never reach the driver.
LEAST_SHARE = 1e-4
#: The network: letters of its byte embedding, units of each direction; training steps, words of a step, learning rate.
EMBED, UNITS, STEPS, BATCH, RATE, SEED = 12, 16, 700, 256, 0.01, 7
#: A word's bytes are one sequence; longer words are cut into sequences of so many bytes.
LONGEST = 32
#: Words whose sums a worker remembers, fewer where their languages make more numbers than these; beyond it the memory is begun anew.
CACHE_WORDS, CACHE_NUMBERS = 400_000, 20_000_000
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters: E embeds bytes; for each direction W (input), U (state), b of the gates z, r and the candidate n; O, o
    label a position from both directions' states there."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"E": draw(256, EMBED) * 8, "O": draw(2 * UNITS, len(languages)), "o": np.zeros(len(languages), np.float32)}
        for d in "fb":
            p |= {"W" + d: draw(EMBED, 3 * UNITS), "U" + d: draw(UNITS, 3 * UNITS), "b" + d: np.zeros(3 * UNITS, np.float32)}
        return cls(languages, p)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> list[np.ndarray]:
        """One direction's states after each position of the byte sequences x (rows of equal length)."""
        H, U, p = UNITS, self.p["U" + d], self.p
        given = p["E"] @ p["W" + d] + p["b" + d]
        h, out = np.zeros((len(x), H), np.float32), [None] * x.shape[1]
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, g = given[x[:, t]], h @ U
            zr = sigmoid(a[:, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, zr, n, g[:, 2 * H :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def label(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities of the languages at every position: sequences x positions x languages."""
        both = [self.states(x, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"]
        h = np.concatenate([np.stack(s, 1) for s in both], 2)
        y = h @ self.p["O"] + self.p["o"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        if keep is not None:
            keep["h"] = h
        return y

    def gradients(self, x: np.ndarray, language: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
        H, p, keep = UNITS, self.p, {}
        y = self.label(x, keep)
        B, T, _ = y.shape
        loss = float(-np.log(y[np.arange(B), :, language] + 1e-9).mean())
        dy = y
        dy[np.arange(B), :, language] -= 1
        dy /= B * T
        g = {"O": np.tensordot(keep["h"], dy, ((0, 1), (0, 1))), "o": dy.sum((0, 1)), "E": np.zeros_like(p["E"])}
        dh_all = dy @ p["O"].T
        for k, d in enumerate("fb"):
            dgiven, dU, dh = np.zeros((256, 3 * H), np.float32), np.zeros_like(p["U" + d]), np.zeros((B, H), np.float32)
            for t, h, zr, n, gn in reversed(keep[d]):
                dh = dh + dh_all[:, t, k * H : (k + 1) * H]
                z, r = zr[:, :H], zr[:, H:]
                dn = dh * (1 - z) * (1 - n * n)
                da = np.concatenate((dh * (h - n) * z * (1 - z), dn * gn * r * (1 - r), dn), 1)
                dg = np.concatenate((da[:, : 2 * H], dn * r), 1)
                np.add.at(dgiven, x[:, t], da)
                dU += h.T @ dg
                dh = dh * z + dg @ p["U" + d].T
            g |= {"U" + d: dU, "W" + d: p["E"].T @ dgiven, "b" + d: dgiven.sum(0)}
            g["E"] += dgiven @ p["W" + d].T
        return loss, g


def train(words: list[bytes], labels: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fits a network to words and the languages of their documents; each step takes words of one length, by Adam."""
    languages = sorted(set(labels))
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    of = {name: i for i, name in enumerate(languages)}
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for word, label in zip(words, labels):
        for at in range(0, len(word), LONGEST):
            part = word[at : at + LONGEST]
            by_length.setdefault(len(part), []).append((part, of[label]))
    lengths = sorted(by_length)
    weight = np.array([n * len(by_length[n]) for n in lengths], float)
    data = {n: (np.frombuffer(b"".join(w for w, _ in x), np.uint8).reshape(-1, n), np.array([i for _, i in x])) for n, x in by_length.items()}
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = data[lengths[rng.choice(len(lengths), p=weight / weight.sum())]]
        pick = rng.integers(0, len(x), BATCH)
        _, g = net.gradients(x[pick], y[pick])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class WordSums:
    """For each distinct word of a chunk the sums over its positions of the languages' probabilities. A word is a sequence
    of its own, so what the network says of it is the same wherever it stands; it is computed once and remembered."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.size = min(CACHE_WORDS, CACHE_NUMBERS // len(net.languages))
        self.sums = np.zeros((self.size, len(net.languages)), np.float32)

    def of(self, c: Chunk) -> np.ndarray:
        """For every word of the chunk its sums."""
        keys, first, back = np.unique(c.hashes, return_index=True, return_inverse=True)
        if len(keys) > self.size - len(self.rows):
            self.rows.clear()
        if len(keys) > self.size:  # a chunk with more words than the memory holds
            return self.compute(c, first)[back]
        rows = np.array(list(map(self.rows.get, keys.tolist(), [-1] * len(keys))), np.int64)
        if len(new := np.flatnonzero(rows < 0)):
            rows[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.sums[rows[new]] = self.compute(c, first[new])
            self.rows.update(zip(keys[new].tolist(), rows[new].tolist()))
        return self.sums[rows[back]]

    def compute(self, c: Chunk, words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(self.net.languages)), np.float32)
        starts, sizes = c.starts[words], c.ends[words] - c.starts[words]
        while (sizes > 0).any():  # a round for each LONGEST bytes of the longest word
            part = np.minimum(sizes, LONGEST)
            for n in np.unique(part[part > 0]).tolist():
                which = np.flatnonzero(part == n)
                for at in range(0, len(which), 4096):
                    some = which[at : at + 4096]
                    out[some] += self.net.label(c.data[starts[some][:, None] + np.arange(n)]).sum(1)
            starts, sizes = starts + part, sizes - part
        return out


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, folds: int = 5, least_share: float = LEAST_SHARE) -> Network | None:
    """A network fitted to about sample_docs documents of each language among those whose crc32(doc_id) mod folds isn't 0.

    A language is learned if it has least_share of the labelled documents. Two passes: distinct documents by language, then
    words of the sampled texts, drawn over the whole text. None if no row is labelled, as in an empty table. Rows alike in id,
    language and text count once, so what comes to the driver is bounded whatever repeats; very long texts give as many words
    as others. Columns other than doc_id, text and lang aren't read.
    """
    able = docs.where((crc_mod("doc_id", folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("mark"))
    by = stored(able.select("lang", "mark").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total = by.agg(F.sum("n")).first()[0] or 0
    counts = {r[0]: r[1] for r in by.where(F.col("n") >= least_share * total).collect()}  # at most 1 / least_share
    discard(by)
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample_docs / n))])
    picked = able.where(F.pmod("mark", F.lit(1_000_003)) < 1_000_003 * share[F.col("lang")])

    def draw(batches):
        for batch in small_batches(batches):
            for mark, lang, text in zip(batch.column("mark").to_pylist(), batch.column("lang").to_pylist(), texts(batch)):
                words = text.encode().split()
                if len(words) > SAMPLE_WORDS:
                    words = [words[i] for i in np.random.default_rng(abs(mark)).choice(len(words), SAMPLE_WORDS, replace=False)]
                yield pa.RecordBatch.from_pylist([{"mark": mark, "lang": lang, "words": words}], pa.schema([("mark", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary()))]))

    found = picked.mapInArrow(draw, "mark long, lang string, words array<binary>").dropDuplicates(["mark", "lang"]).collect()
    pairs = sorted((r[0], r[1], bytes(w)) for r in found for w in r[2])
    return train([p[2] for p in pairs], [p[1] for p in pairs]) if pairs else None


def identify(docs: DataFrame, net: Network | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and n_positions of every document.

    Every byte of every word is a position with a probability for each language; a document's probabilities are their
    mean, lang_pred the likeliest language (the first by name among equals), score its probability. A text that is null
    or has no letter is `und` with score 0, as is every text without a network. Very long texts are read whole, in pieces. Repeated rows give repeated rows, an empty
    table none. Columns named by carry are handed through; others aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    sums: list[WordSums] = []

    def run(batches):
        net = shared.value
        if net and not sums:
            sums.append(WordSums(net))
        for batch in small_batches(batches):
            found = texts(batch)
            letters = [any(map(str.isalpha, t)) for t in found]
            lang, score, n = [UNKNOWN] * len(found), [0.0] * len(found), [0] * len(found)
            for c in chunks(batch) if net else ():
                total = np.concatenate((np.zeros((1, len(net.languages))), np.cumsum(sums[0].of(c), 0, dtype=np.float64)))
                size = np.concatenate(([0], np.cumsum(c.ends - c.starts)))
                total, size = np.diff(total[c.offsets], axis=0), np.diff(size[c.offsets])
                best = total.argmax(1)
                for i, (k, s) in enumerate(zip(best.tolist(), size.tolist())):
                    n[c.first + i] = s
                    if letters[c.first + i]:
                        lang[c.first + i], score[c.first + i] = net.languages[k], min(1.0, float(total[i, k]) / s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), *map(batch.column, carry)], ["doc_id", "lang_pred", "score", "n_positions", *carry])

    df, schema = carried(docs, carry, "doc_id long, lang_pred string, score double, n_positions long")
    return df.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "n_positions")
