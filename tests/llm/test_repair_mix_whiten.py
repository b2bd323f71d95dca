"""Operators 11 to 13 against brute force and SQL, and on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversation_repair, language_id, mixing, quality_classifier, whitening
from panelspark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, n long, block int, again boolean, rows string"


def plain_repair(rows):
    """Every sequence of edits of rows (sorted role, text pairs), the best first: cost, audit and the repaired lines."""
    seen, flags = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        flags.append("gone" if not body or (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    added = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    acts = [[("D", 3, ())] + ([] if f == "gone" else [(a, c + (f == "cut"), ((to, text),)) for a, c, to in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant"))]) for (role, text), f in zip(rows, flags)]
    for chosen in itertools.product(*acts):
        for more in itertools.product(added, repeat=len(rows) + 1):
            cost = sum(a[1] for a in chosen) + 2 * sum(map(len, more))
            if best and cost > best[0]:
                continue
            turns = [t for m, a in itertools.zip_longest(more, chosen) for t in [*((r, "") for r in m), *(a[2] if a else ())]]
            if all(r for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)):
                audit = "".join("I" * len(m) + (a[0] if a else "") for m, a in itertools.zip_longest(more, chosen))
                best = min(best or (1 << 30, "", ""), (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)))
    return best


def by_conversation(df):
    return {r.conv_id: r for r in df.collect()}


def test_repair_equals_all_edits_tried(spark):
    rng = random.Random(4)
    rows = []
    for c in range(16):
        for t in range(rng.randint(1, 3)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool", "user"]), rng.choice(["Yes.", "and then", "  \n", "Why?", "Yes.", "é!  "]), 1, 1, True, "x"))
    df = spark.createDataFrame(rows, TURNS)
    found = conversation_repair.repair(df)
    digest = by_conversation(conversation_repair.digests(found))
    for r in found.collect():
        cost, audit, text = plain_repair([(x[2], x[3]) for x in rows if x[0] == r.conv_id])
        assert (r.cost, r.audit, "\n".join(f"{t.role}:{t.text}" for t in r.turns)) == (cost, audit, text), [x for x in rows if x[0] == r.conv_id]
        assert digest[r.conv_id].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert digest == by_conversation(conversation_repair.digests(conversation_repair.repair(df, block_turns=1)))


def test_repair_in_blocks_equals_repair_whole(spark):
    """A conversation of thousands of turns, copies among them, cut into blocks and not."""
    rng, roles = random.Random(9), ["user", "assistant", "user", "assistant", "system", "tool"]
    long = [(7, rng.choice([None, *range(900)]), rng.choice(roles), rng.choice([f"text {rng.randint(0, 400)}", f"Say {rng.randint(0, 900)}.", "", "same."]), 1, 1, True, "x") for _ in range(700)]
    rows = [*long, *[(8, 5, "user", "copy.", 1, 1, True, "x")] * 300, (9, 0, "user", "Hi.", 1, 1, True, "x"), (9, 1, "assistant", "Ho.", 1, 1, True, "x"), (None, 1, "user", "No id.", 1, 1, True, "x")]
    df = spark.createDataFrame(rows, TURNS)
    whole = by_conversation(conversation_repair.digests(conversation_repair.repair(df)))
    parts = conversation_repair.repair(df, block_turns=100)
    assert by_conversation(conversation_repair.digests(parts)) == whole
    assert parts.where("conv_id = 7").count() > 1 and parts.agg(F.max(F.size("turns"))).first()[0] < 700
    assert whole[8].audit == "K" + "D" * 299 + "I" and whole[8].duplicate == 299 and whole[8].illegal == 299
    assert by_conversation(conversation_repair.digests(conversation_repair.repair(df, block_bytes=1000)))[7] == whole[7]


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, None, None), (2, 0, "", "A."), (3, 0, "user", ""), (4, 3, "user", "very " * 200_000), (5, 2, "user", "Q?"), (5, 9, "assistant", "A."),
        (6, 0, "user", "Q?"), (6, 0, "user", "Q?"), (6, 1, "assistant", "A!"), (None, 1, "assistant", "A."), (10, -(1 << 63), "user", "a."), (10, (1 << 63) - 1, "assistant", "b."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = by_conversation(conversation_repair.digests(conversation_repair.repair(df)))
    assert (got[1].blank, got[1].audit, got[1].cost, got[1].gaps, got[1].repaired_sha256) == (1, "D", 3, 0, hashlib.sha256(b"").hexdigest())
    assert (got[2].audit, got[2].cost) == ("D", 3) and got[3].blank == 1
    assert (got[4].truncated, got[4].audit, got[4].cost) == (1, "D", 3)
    assert (got[5].gaps, got[5].audit, got[5].cost, got[5].illegal) == (6, "KK", 0, 0)
    assert (got[6].duplicate, got[6].audit, got[6].illegal) == (1, "KDK", 1)
    assert (got[None].audit, got[None].cost) == ("IK", 2) and got[10].gaps == 0
    empty = df.limit(0)
    assert conversation_repair.digests(conversation_repair.repair(empty)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repair_sql(spark, sf):
    name = "op11_conversation_repair"
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], f"/root/testdata/{sf}") == ""


def test_repair_query_keeps_every_conversation(spark, tmp_path):
    rows = [(c, t, r, x) for c in range(60) for t, r, x in ((0, "user", "Q?"), (1, "assistant", "A."))] + [(c, None, None, None) for c in range(60, 200)] + [(None, 2, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    name = "op11_conversation_repair"
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], str(tmp_path)) == ""
    got = by_conversation(QUERIES[name](spark, str(tmp_path)))
    assert len(got) == 201 and any(r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())


def plain_targets(sizes):
    """sizes: source to words. Shares of 150 % by weight, and the excess of those above twice reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or '']))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        if not (over := {s for s in rest if share[s] > 2 * sizes[s]}):
            return {s: 2.0 * sizes[s] for s in capped} | share
        capped |= over


def plain_slope(sizes, target):
    rate = lambda z: (2 / (1 + np.exp(-z * sizes)) * sizes).sum()
    low, high = -50.0, 50.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if rate((low + high) / 2) > target else ((low + high) / 2, high)
    return low


def check_mix(rows, texts):
    """rows of mix against texts, a list of (doc_id, source, text)."""
    size = [(i, s, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, s, t in texts]
    assert sorted([(r.doc_id, r.source, r.size) for r in rows], key=repr) == sorted(size, key=repr)
    sizes = {s: sum(n for _, x, n in size if x == s) for _, s, _ in size}
    target = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target[s], rel=1e-9) and 0 <= r.copies <= 2 for r in mine)
        # what is missed is less than the smaller documents can mend
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= max(1, sorted(r.size for r in mine)[len(mine) // 4]) + 1
        z = plain_slope(np.array([r.size for r in mine], float), target[s]) if target[s] < 2 * sizes[s] else None
        for r in mine:
            assert r.rate == pytest.approx(2 if z is None else 2 / (1 + np.exp(-z * r.size)), abs=1e-4)


def test_mix_equals_plain_balancing(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    got = mixing.mix(rows).collect()
    check_mix(got, [tuple(r) for r in rows.collect()])
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(rows.repartition(7)).collect()))


def test_mix_of_odd_rows(spark):
    long = "very " * 300_000 + "end"
    texts = [(1, "b", "a b c"), (1, "b", "a b c"), (2, None, "x"), (3, "b", None), (None, "b", ""), (4, "", long), (5, "Ä", "one\x1ctwo three"), (6, "\U0001f600", "q w e r t y"), (7, "￿", "one two")]
    texts += [(100 + i, "hot", "same text here") for i in range(500)] + [(9, "hot", "all the same row")] * 900
    df = spark.createDataFrame([(*t, 1, 2, "x") for t in texts], "doc_id long, source string, text string, size long, m int, part string")
    got = mixing.mix(df).collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=repr) == sorted(((i, s) for i, s, _ in texts), key=repr)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = plain_targets(sizes)
    assert all(r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2 for r in got)
    hot = [r for r in got if r.source == "hot"]
    assert abs(sum(r.copies * r.size for r in hot) - target["hot"]) <= 4
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.copies for r in mixing.mix(df.where("text IS NULL")).collect()} <= {0, 1, 2}


def test_mix_splits_runs_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 64)
    df = spark.createDataFrame([(9, "a", "w w")] * 1000 + [(1, "b", "w")] * 4000, "doc_id long, source string, text string")
    got = mixing.mix(df).groupBy("source").agg(F.count("*").alias("n"), F.sum("copies").alias("k"), F.first("target").alias("t"), F.max("size").alias("z")).collect()
    assert {r.source: r.n for r in got} == {"a": 1000, "b": 4000} and all(abs(r.k * r.z - r.t) <= r.z for r in got)


def plain_whitened(vectors, k=4):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    once = np.unique(x, axis=0)
    c = once - once.mean(0)
    values, basis = np.linalg.eigh(c.T @ c / len(once))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return x, once, values, (x - once.mean(0)) @ basis / np.sqrt(values), np.trace(c.T @ c / len(once))


def check_whitened(rows, ids, vectors, k):
    x, once, values, want, trace = plain_whitened(vectors, k)
    by = {}
    for r in rows:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for j in by:
        mine = [by[j][i][0] for i in ids]
        got = np.array([r.whitened for r in mine])
        sign = np.sign(got @ want[:, j - 1])
        assert np.allclose(sign * got, want[:, j - 1], rtol=0, atol=1e-8)
        deviation = ((len(once) * x - once.sum(0)) ** 2).sum(1)
        assert [r.deviation for r in mine] == deviation.tolist() and {r.n for r in rows} == {len(once)}
        assert mine[0].explained == pytest.approx(values[j - 1] / trace, rel=1e-9) and mine[0].identity_error < 1e-9


def test_whitening_equals_a_full_decomposition(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    check_whitened(whitening.whiten(df).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 4)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.normal(size=3) * (3, 1, 0.2)]) for i in range(80)]
    rows = [*good, *[(100 + i, good[0][1]) for i in range(50)], good[1], (None, good[2][1])]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("-inf"), 0.0, 0.0]), (204, []), (205, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, x int, component string"
    df = spark.createDataFrame([(*r, 1, "c") for r in [*rows, *bad]], schema)
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * len(rows) and not {200, 201, 202, 203, 204, 205} & {r.vec_id for r in got}
    check_whitened(got, [i for i, _ in good], [v for _, v in rows][:80], 3)
    assert len({r.whitened for r in got if r.component == 1 and r.vec_id in (0, *range(100, 150))}) == 1
    assert whitening.whiten(df.limit(0)).count() == 0 == whitening.whiten(df.where("vec_id = 1 AND false")).count()
    assert whitening.whiten(df.where("vec_id = 100")).count() == 0  # one distinct vector has no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    assert whitening.whiten(flat).count() == 20  # one component has variance
    large = spark.createDataFrame([(i, [1e15 * i, 3e14 * i * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large).collect()} == {None}


def test_lobpcg_of_close_and_equal_values():
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for spectrum in (np.linspace(2, 1, 90), np.ones(90), np.r_[np.full(30, 5.0), np.linspace(1, 0, 60)], np.r_[1e6, np.linspace(1, 0.5, 89)]):
        a = basis * spectrum @ basis.T
        values, vectors, residual, _ = whitening.lobpcg(lambda b: a @ b, 90, 4)  # noqa: B023
        assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-12) and residual < 1e-10
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12) and np.allclose(a @ vectors, vectors * values, atol=1e-9 * spectrum.max())


def test_classifier_of_a_clashing_n_chars(spark):
    rows = [(i, f"good words number {i} here", t) for i, t in enumerate(["12", "no number", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    model = quality_classifier.learn(docs, labels)
    assert quality_classifier.classify(docs, model).count() == 4
    assert [r.n_chars for r in quality_classifier.inputs(docs).orderBy("doc_id").collect()] == [12, 0, 0, 0]
    assert quality_classifier.classify(docs.withColumn("n_chars", F.array("text")), model).count() == 4


def test_samples_of_one_id_repeated_are_bounded(spark, monkeypatch):
    rows = [(1, f"words of text number {i % 1500} go here", "en", "x") for i in range(3000)] + [(i, f"mots du texte {i} vont là", "fr", None) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mark string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sizes = {}
    monkeypatch.setattr(language_id, "train", lambda words, langs: sizes.setdefault("words", len(words)))
    monkeypatch.setattr(quality_classifier, "train", lambda rows, labels: sizes.setdefault("rows", len(rows)))
    language_id.learn(docs, sample_docs=50)
    quality_classifier.learn(docs, labels, sample=60)
    assert 0 < sizes["words"] < 7 * 150 and 0 < sizes["rows"] < 150


def test_languages_need_support(spark, monkeypatch):
    rows = [(i, "some words", f"l{i % 3}" if i else "rare") for i in range(400)]
    seen = set()
    monkeypatch.setattr(language_id, "train", lambda words, langs: seen.update(langs))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language_id.learn(docs, folds=401, least_share=0.05)
    assert seen == {"l0", "l1", "l2"}
    language_id.learn(docs, folds=401)
    assert "rare" in seen


def test_deduplicate_keeps_clashing_columns(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 77, "a", "m", "w"), (2, text + " more", 88, "b", "n", "v"), (3, "other words " * 20, 99, "c", "o", "u")], "doc_id long, text string, row_id long, row_null string, row_mark string, whole_row string")
    got = sorted(map(tuple, corpus_pipeline.deduplicate(spark, docs, SF).collect()))
    assert got == sorted(tuple(r) for r in docs.where("doc_id <> 2").collect())
