"""Each operator against brute force, a library or held-out labels, and on nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns."""

import hashlib
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import bpe_codec, components, jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, token_counts, url_filter, vector_search
from panelspark.llm.bpe import heap_merge, rank_array_merge, vocabulary
from panelspark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
LONG = "very " * 400_000 + "end"
TEXTS = [None, "", "   \n\t ", "Hello world, it's <|endoftext|> fine.\n\nYes!", "x" * 5000, LONG, "a b c", "a b c", "Ünïcödé ΣΑΣ 中文 123 ½ ", "!!! ??? ###"]
SCHEMA = "doc_id long, text string, lang string, n_chars long, token long, score double, key string"
BYTE, RANKS, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, len(t) if t else None, 1, 0.5, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, 1, 0.5, "k")], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, none, real):
    library = Tokenizer.from_file(BYTE)
    for df in (docs, real):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for i, r in collected(token_counts.token_counts(df, BYTE)).items():
            n = len(library.encode(text[i], add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[i].encode()), n > 512)
    assert token_counts.token_counts(docs, BYTE).count() == docs.count() and none.count() == token_counts.token_counts(none, BYTE).count()


def test_codec(docs, none, real):
    library = Tokenizer.from_file(WORD)
    for df in (docs, real):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for i, r in collected(bpe_codec.digests(df, WORD)).items():
            ids = library.encode(text[i], add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    general = collected(bpe_codec.encode_decode(docs, WORD))
    assert general[6].ids == library.encode("a b c", add_special_tokens=False).ids and general[0].ids == []
    assert bpe_codec.digests(none, WORD).count() == 0


def test_both_merge_loops_agree():
    v, rng = vocabulary(BYTE), np.random.default_rng(1)
    for _ in range(300):
        word = "".join(rng.choice(list("abetinosr "), rng.integers(1, 90)))
        assert [p for p in heap_merge(v.symbols(word), v.ranks)[0] if p is not None] == rank_array_merge(v.symbols(word), v.ranks)


def check_packing(df, size):
    library, text = Tokenizer.from_file(BYTE), {}
    for r in df.dropDuplicates(["doc_id"]).collect():
        text[r.doc_id] = library.encode(r.text or "", add_special_tokens=False).ids + [1]
    pieces = packing.pack(df, BYTE, RANKS, size).collect()
    sequences, docs = defaultdict(list), Counter()
    for p in pieces:
        ids = text[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id] += p.length
    n = Counter(r.doc_id for r in df.select("doc_id").collect())
    assert docs == {i: len(x) * n[i] for i, x in text.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert 0 < at <= size
    lengths = [sum(x[1] for x in s) for s in sequences.values()]
    return sum(0 if x & (x - 1) == 0 else size - x for x in lengths) / sum(lengths)


def test_packing(docs, none, real):
    check_packing(docs.coalesce(1), 2048)
    assert check_packing(real.coalesce(1), 2048) < 0.03
    assert packing.pack(none, BYTE, RANKS).count() == 0


def test_plan_is_optimal():
    rng, size = np.random.default_rng(2), 256
    for _ in range(40):
        ends = np.cumsum(rng.integers(1, 120, 12))
        costs = rng.choice([0, 4, 48], 12)
        at, best = [0, *ends.tolist()], [0] + [10**9] * 12
        for j in range(1, 13):
            for i in range(j):
                n = at[j] - at[i]
                if n <= size:
                    full = n >= packing.LEAST_POWER and n & (n - 1) == 0
                    best[j] = min(best[j], best[i] + (0 if full else size - n) + packing.WINDOW_COST + int(costs[j - 1]))
        total, last = 0, 0
        for k in packing.plan(ends, costs, size):
            n = int(ends[k]) - last
            total += (0 if n >= packing.LEAST_POWER and n & (n - 1) == 0 else size - n) + packing.WINDOW_COST + int(costs[k])
            last = int(ends[k])
        assert total == best[12] and last == ends[-1]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, cover, seen, double = Counter(runs), set(), set(), 0
    for i, x in enumerate(runs):
        if n[x] > 1:
            cover.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            double += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), double, len(cover)


def test_quality_rules(spark, docs, none, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ratios = quality_rules.log_ratios(real, quality_rules.trusted_ids(labels))
    for df in (docs, real, spark.createDataFrame([(1, "a b\nc\n \na b\n\nc\r\nc\n")], "doc_id long, text string")):
        text = {r.doc_id: r.text for r in df.collect()}
        for i, r in collected(quality_rules.quality_rules(df, ratios)).items():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text[i])
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(none, ratios).count() == 0 and not quality_rules.log_ratios(none, np.array([1])).any()


def test_language_id(docs, none, real):
    net = language_id.learn(real)
    out = language_id.op1_language_id(real.sparkSession, SF).join(real.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert out > 0.9
    odd = collected(language_id.identify(docs, net))
    assert [odd[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and odd[3].lang_pred == "en" and 0 <= odd[5].score <= 1
    assert language_id.learn(none) is None and language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, net).count() == 0


def test_network_gradients():
    net = language_id.Network.fresh(["a", "b", "c"])
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    x, y = np.random.default_rng(1).integers(0, 256, (5, 4)), np.array([0, 1, 2, 1, 0])
    g = net.gradients(x, y)[1]
    for k, p in net.p.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        p[i] += 1e-3
        a = net.gradients(x, y)[0]
        p[i] -= 2e-3
        b = net.gradients(x, y)[0]
        p[i] += 1e-3
        assert (a - b) / 2e-3 == pytest.approx(g[k][i], rel=1e-3)


def test_quality_classifier(spark, docs, none, real):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    out = quality_classifier.op8_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert out > 0.93
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, model).collect())
    assert quality_classifier.classify(none, model).count() == 0
    offsets, number, value = np.array([0, 3]), np.array([1, 5, 9]), np.array([0.5, 2.0, 1.0])
    pairs = sum(float(model.V[a] @ model.V[b]) * x * y for i, (a, x) in enumerate(zip(number, value)) for b, y in list(zip(number, value))[i + 1 :])
    assert model.margin(offsets, number, value)[0][0] == pytest.approx(model.w0 + model.w[number] @ value + pairs, abs=1e-5)


def brute_components(rows):
    lower, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), []
    for _, text in rows:
        w = [x.translate(lower) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(zip([r[0] for r in rows], sets))), key=repr)


def test_jaccard_join(spark, docs, none, real):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    made, passage = [], list(rng.choice(words, 60))
    for i in range(60):
        text = list(rng.choice(words, int(rng.integers(4, 120))))
        made.append((i, " ".join(text)))
        for k in range(int(rng.integers(0, 4))):
            near = list(text)
            for _ in range(int(rng.integers(0, 3))):
                near[int(rng.integers(len(near)))] = "Zz"
            made.append((1000 + 10 * i + k, " ".join(near).upper() if k == 1 else " ".join(near)))
        made.append((5000 + i, " ".join(passage + list(rng.choice(words, int(rng.integers(1, 30)))))))
    cases = [made, [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]]
    for rows in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, jaccard_join.jaccard_components(df).drop("mark").collect()), key=repr) == brute_components(rows)
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("fanout", [1, 2])
def test_jaccard_join_of_dealt_tokens(spark, monkeypatch, fanout):
    """Near variants, some in many copies, of which every token is dealt over salts."""
    rng, words = np.random.default_rng(5), [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        text = list(rng.choice(words, 80))
        for k in range(int(rng.integers(2, 9))):
            near = list(text)
            near[8 * k + 3] = f"Zz{k}"
            rows += [(100_000 * c + 100 * g + k, " ".join(near)) for c in range(6)]
    monkeypatch.setattr(jaccard_join, "FANOUT", fanout)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, F.expr("doc_id div 100000"))
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).drop("mark").collect()), key=repr) == brute_components(rows)


def test_jaccard_join_finds_a_pair_whose_shingles_are_frequent(spark):
    """Two sets that are alike, of shingles that more sets of another size hold than share a leader; extra columns clash."""
    rng, words = np.random.default_rng(6), [f"w{i}" for i in range(44)]
    a, b = words, [*words[:43], "other"]
    rows = [(i, " ".join([*words[at : at + 24], f"own{i}"])) for i, at in enumerate([0] * 1100 + [20] * 1100)]
    rows += [(100_000, " ".join(a)), (100_001, " ".join(b))]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(8)
    found = jaccard_join.jaccard_components(df.withColumns({k: F.lit(1) for k in ("token", "key", "n", "mark", "pos")}))
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got[100_000] == got[100_001] == 100_000 and {got[i] for i in range(1100)} == {0} and {got[i] for i in range(1100, 2200)} == {1100}


@pytest.mark.parametrize("parts", [1, 200])
def test_jaccard_join_sees_tokens_that_are_frequent_over_tasks_only(spark, monkeypatch, parts):
    """The same opening in 200 texts, also where each task holds one of them."""
    monkeypatch.setattr(jaccard_join, "FANOUT", 64)
    words = [f"w{i}" for i in range(7)]
    rows = [(i, " ".join([*words, *(f"own{i}x{k}" for k in range(12))])) for i in range(200)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    counts = jaccard_join.token_counts(df, jaccard_join.large_counters(jaccard_join.profiles(df)))
    assert sorted(jaccard_join.heavy_tokens(counts).counts) == [200] * 3
    assert len(jaccard_join.heavy_tokens(counts, 0).counts) == 0


def test_heavy_tokens_are_the_most_frequent_within_the_bound(spark):
    rng = np.random.default_rng(8)
    tokens = rng.integers(-(1 << 63), 1 << 63, 6000)
    counts = spark.createDataFrame([(int(t), 1000 if i < 100 else 500 if i < 4100 else 3) for i, t in enumerate(tokens)], "token long, df long")
    found = jaccard_join.heavy_tokens(counts, 2100)
    assert (found.counts == 1000).sum() == 100 and 1800 < (found.counts == 500).sum() < 2200 and (found.counts == 3).sum() == 0
    assert len(jaccard_join.heavy_tokens(counts, 6000).counts) == 6000


@pytest.mark.parametrize("together", [1, 3])
def test_jaccard_join_cuts_groups_of_the_exact_rest(spark, monkeypatch, together):
    """Each pair of a group in different components is met once, in however many parts the group is cut."""
    monkeypatch.setattr(jaccard_join, "TOGETHER", together)
    rng = np.random.default_rng(9)
    rows = [(t, 10, k, int(rng.integers(90, 110)), int(rng.integers(0, 3)), int(rng.integers(0, 5))) for t in range(6) for k in rng.choice(40, 10, False).tolist()]
    df = spark.createDataFrame(rows, "token long, size long, key long, n int, pos int, root long").withColumn("before", F.array().cast("array<long>"))
    fit = lambda a, b: min(a[3], b[3]) * 100 >= 75 * max(a[3], b[3]) and min(a[3] - a[4], b[3] - b[4]) * 175 >= (a[3] + b[3]) * 75
    want = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and a[5] != b[5] and fit(a, b)}
    assert want and sorted(map(tuple, jaccard_join.apart(df).collect())) == sorted(want)


def test_jaccard_join_leaves_two_tables(spark, real):
    """Of what a run writes into the shared folder only what its result reads stays."""
    from panelspark.llm.common import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "panelspark"
    before = {p.name for p in folder.glob("*")}
    found = jaccard_join.jaccard_components(real)
    assert sorted(p.name.split("-")[0] for p in folder.glob("*") if p.name not in before) == ["components", "profiles"]
    assert found.count() == real.count()


def test_sketches_lose_no_link():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        kept = x[rng.random(n) > rng.random() * 0.3]
        y = np.sort(np.concatenate((kept, rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 6) + 1)), dtype=np.uint64))))
        if len(y) and jaccard_join.alike(x, y):
            a, b = (np.frombuffer(jaccard_join.sketch(v), np.uint16) for v in (x, y))
            assert jaccard_join.may_link(a, b) and jaccard_join.may_link(b, a)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_nearest(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = [(100_000, None), (100_100, [0.0] * 64), (100_200, [float("nan")] * 64), (100_300, [None] * 64), (100_400, [1.0] * 3), (100_500, [0.5] * 64), *[(100_501 + i, [0.5] * 64) for i in range(15)]]
    both = vectors.union(spark.createDataFrame(odd, vectors.schema)).withColumn("leaf", F.lit("x"))
    twice = spark.createDataFrame([(7, [9.0] * 64), (7, [0.25] * 64)], vectors.schema)
    one = {tuple(map(float, r.embedding)) for r in vectors.where("vec_id = 7").collect()} | {(9.0,) * 64, (0.25,) * 64}
    met = vector_search.nearest(vectors.union(twice), every=7).where("query_id = 7 AND rank = 1").first()
    least, other = min(one), {r.vec_id: np.array(r.embedding, float) for r in vectors.where("vec_id <> 7").collect()}
    assert met.score == float(np.sqrt(((other[met.vec_id] - np.array(least)) ** 2).sum()))
    rows = {r.vec_id: np.array(r.embedding, float) for r in both.collect() if r.vec_id < 100_000 or r.vec_id >= 100_500}
    got = defaultdict(list)
    for r in vector_search.nearest(both).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    assert set(got) == {i for i in rows if i % 100 == 0}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((x - rows[q]) ** 2).sum())), i) for i, x in rows.items() if i != q)[:10]
        assert [f[0] for f in found] == list(range(1, 11)) and all(s == pytest.approx(float(np.sqrt(((rows[v] - rows[q]) ** 2).sum())), abs=0) for _, v, s in found)
        hit += len({v for _, v, _ in found} & {i for _, i in want})
    assert hit >= 9 * len(got) and [v for _, v, _ in got[100_500]] == list(range(100_501, 100_511))
    assert vector_search.nearest(both.limit(0)).count() == 0


def test_url_filter(spark):
    entries = spark.createDataFrame([("a.com", 10, "add"), ("a.com", 20, "remove"), ("a.com", 20, "add"), ("a.com", 30, "add"), ("b.a.com/x", 5, "add"), (None, 1, "add"), ("c.com", 1, "other")], "pattern string, day int, action string")
    captures = spark.createDataFrame([(1, "http://b.a.com/x/1", 12), (2, "HTTP://A.com/", 20), (3, "https://a.com", 9), (4, None, 12), (5, "junk", 12), (6, "http://a.com:80/", None), (7, "http://u@a.com/q", 31), (7, "http://u@a.com/q", 31), (8, "http://c.com/", 5)], "page_id long, url string, day int")
    got = sorted((r.page_id, r.n_rules, r.listed_days) for r in url_filter.evaluate(captures.withColumn("pattern", F.lit(1)), entries).collect())
    assert got == [(1, 2, 7), (2, 0, None), (3, 0, None), (4, 0, None), (5, 0, None), (6, 0, None), (7, 1, 1), (7, 1, 1), (8, 0, None)]
    none = url_filter.evaluate(captures.limit(0), entries)
    assert none.count() == 0 and url_filter.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
    clashing = url_filter.evaluate(captures.withColumns({k: F.lit(1) for k in ("n", "oldest", "patterns", "since", "held", "side")}), entries)
    assert sorted((r.page_id, r.n_rules, r.listed_days) for r in clashing.collect()) == got
    more = spark.createDataFrame([("1.2.3.4", 1, "add"), ("3.4", 1, "add"), ("z.org", 1, "add")], "pattern string, day int, action string")
    asked = spark.createDataFrame([(1, "http://1.2.3.4/x", 5), (2, "http://A.z.org./", 5)], "page_id long, url string, day int")
    assert sorted((r.page_id, r.n_rules) for r in url_filter.evaluate(asked, more).collect()) == [(1, 1), (2, 1)]
    assert compare(spark, "op3_url_filter", QUERIES["op3_url_filter"], ORACLE_SQL["op3_url_filter"], SF) == ""


def test_license_scan(spark, docs, none):
    df = spark.createDataFrame([(1, "intro\nReleased under the MIT License.\nend"), (2, "Licensed under the Apache Licence Version 2.0"), (3, "my license to drive a car"), (4, "x " * 3000 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 3000)], "doc_id long, text string")
    got = collected(license_scan.scan(df))
    assert [got[i].best for i in (1, 2, 3, 4)] == ["MIT", "Apache-2.0", None, "GPL-3.0"]
    assert got[1].differences == "" and got[3].n_blocks == 1
    assert license_scan.scan(none).count() == 0 and license_scan.scan(docs).where("n_found > 0").count() == 0
    assert all(name in licenses_in(t) for name, t in license_scan.TEMPLATES.items())


def licenses_in(text):
    return {x[0] for x in license_scan.matcher().found(text)[1]}


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
def test_license_in_any_layout(name):
    import textwrap

    notice, other = license_scan.TEMPLATES[name], "some prose of the kind that stands around it; and more of it. " * 20
    assert name in licenses_in("\n".join("# " + x for x in textwrap.wrap(notice, 40)))
    assert name in licenses_in(other + notice + " " + other) and name in licenses_in(other.replace(". ", ".\n") + textwrap.fill(notice, 30) + "\n" + other)


def test_license_winners_are_those_of_every_template_without_rank():
    """Random notices with words left out and put in: what compression ranks is all that the wording confirms."""
    rng, filler = np.random.default_rng(8), "the work may be used by all who like it and share some of its parts with others".split()
    of = license_scan.matcher()
    for name, text in list(license_scan.TEMPLATES.items()) * 3:
        w = text.split()
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(w)))
            w[at : at + int(rng.integers(0, 2))] = [str(rng.choice(filler))] * int(rng.integers(0, 2))
        around = [str(x) for x in rng.choice(filler, int(rng.integers(0, 120)))]
        block = " ".join([*around, *w, *around[::-1]])
        have = tuple(license_scan.words(block))
        assert {x[0] for x in of.found(block)[1]} == {k for k in of.templates if of.confirmed(k, have)}, (name, block)


def test_license_identifiers():
    assert licenses_in("# SPDX-License-Identifier: MIT\nimport x") == {"SPDX-MIT"}
    assert licenses_in(" * SPDX-License-Identifier: GPL-2.0-or-later") == {"SPDX-GPL-2.0-or-later"}


def test_license_variants():
    by = "This work is licensed under a Creative Commons Attribution"
    assert licenses_in("This work is licensed under the GNU General Public License, version 2.") == {"GPL-2.0"}
    assert licenses_in(f"{by}-NonCommercial 4.0 International License.") == {"CC-BY-NC-4.0-long"}
    assert licenses_in(f"{by}-NonCommercial-NoDerivatives 4.0 International License.") == {"CC-BY-NC-ND-4.0"}
    assert licenses_in(f"{by}-ShareAlike 3.0 International License.") == {"CC-BY-SA-3.0"}
    assert licenses_in("Licensed under CC BY 4.0") == {"CC-BY-4.0-short"} and licenses_in("Licensed under CC BY-SA 4.0") == {"CC-BY-SA-4.0-short"}
    assert licenses_in("Licensed under the Apache License, Version 2.0 or the MIT license") == {"Apache-2.0", "MIT-or-Apache-2.0"}
    assert licenses_in("Released under the MIT License. All rights reserved.") == {"MIT", "All-rights-reserved"}


def test_license_denied_is_none():
    assert licenses_in("This is not licensed under the MIT License.") == set()
    assert licenses_in("No part is released under the MIT License any more") == set()
    assert licenses_in("It isn't released under the MIT License.") == set()
    assert licenses_in("It comes with no warranty. Released under the MIT License.") == {"MIT"}
    assert licenses_in("If not stated otherwise, licensed under the MIT License.") == {"MIT-licensed"}


def test_license_common_forms():
    assert licenses_in("This project is licensed under the terms of the MIT license.") == {"MIT-terms"}
    assert licenses_in("MIT License\n\nCopyright (c) 2020 Some One") == {"MIT-title"}
    assert licenses_in("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n") == {"GPL-3.0-title"}
    assert licenses_in("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n") == {"AGPL-3.0-title"}
    assert licenses_in("Released under the GPLv2 license.") == {"GPL-2.0-short"}
    assert licenses_in(license_scan.TEMPLATES["LGPL-2.1-or-later"]) == {"LGPL-2.1-or-later"} and licenses_in(license_scan.TEMPLATES["AGPL-3.0-or-later"]) == {"AGPL-3.0-or-later"}
    assert licenses_in("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which") == {"EPL-1.0"}


def test_license_expressions():
    assert licenses_in("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;") == {"SPDX-MIT", "SPDX-Apache-2.0"}
    assert licenses_in("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note AND CC-BY-4.0 and more MIT") == {"SPDX-GPL-2.0-only", "SPDX-CC-BY-4.0"}
    assert licenses_in("SPDX-License-Identifier: CC-BY-4.0.") == {"SPDX-CC-BY-4.0"} and licenses_in("SPDX-License-Identifier: Nothing-1.0") == set()


def test_license_of_very_many_notices():
    import time

    of, began = license_scan.matcher(), time.process_time()
    places = [(0, 5 * i, 5 * i + 5, 1, 5, 0, "") for i in range(100_000)]
    assert len(license_scan.apart(places)) == 100_000 and time.process_time() - began < 5
    rng = np.random.default_rng(5)
    for _ in range(50):
        some = [(int(d), int(a), int(a + n)) for d, a, n in zip(rng.integers(0, 4, 30), rng.integers(0, 60, 30), rng.integers(1, 9, 30))]
        chosen = []
        for y in sorted(some):
            if all(y[2] <= z[1] or y[1] >= z[2] for z in chosen):
                chosen.append(y)
        assert license_scan.apart(some) == sorted(chosen, key=lambda x: x[1])
    n, found = of.found("Released under the MIT License. And so on and so forth it goes. " * 3000)
    assert len(found) == 3000


def test_codec_equals_the_library_on_all_code_points():
    import public_tokenizers
    from tokenizers import Tokenizer

    from panelspark.llm.bpe_codec import Codec

    path = public_tokenizers.path("word_bpe_49k.json")
    codec, library = Codec(path), Tokenizer.from_file(path)
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    parts = [every[i : i + 400] for i in range(0, len(every), 400)]
    texts = [" ".join(f"a{x}b" for x in p) for p in parts]
    for p, text, want in zip(parts, texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(text) == want.ids, [hex(ord(x)) for x in p if codec.encode(f"a{x}b") != library.encode(f"a{x}b", add_special_tokens=False).ids][:5]


def test_likelihood_ratio_equals_a_plain_one(spark):
    from collections import Counter
    from math import log

    rows = [(1, "a b a b c"), (2, "A b x"), (3, None), (4, "x y z"), (4, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n, good = 1 << 16, {1, 3}

    def of(text):
        from panelspark.llm.quality_rules import buckets
        from panelspark.llm.words import chunks

        return [int(b) for c in chunks(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"]), lower=True) for b in buckets(c, n)[0]]

    raw, trusted = Counter(b for _, t in rows for b in of(t)), Counter(b for i, t in rows if i in good for b in of(t))
    ratio = lambda b: log((trusted[b] + 1) / (trusted.total() + n)) - log((raw[b] + 1) / (raw.total() + n))
    got = {r.doc_id: r.llr for r in quality_rules.quality_rules(docs, quality_rules.log_ratios(docs, np.array(sorted(good)))).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(np.mean([ratio(b) for b in of(t)]) if t else 0.0, abs=1e-12)


def test_language_of_cached_words_equals_a_plain_pass(spark):
    net = language_id.train([b"alpha", b"beta", b"gamma", "größe".encode()] * 20, ["en", "en", "fr", "de"] * 20, steps=20)
    texts = ["alpha beta größe alpha", "gamma " + "x" * 70 + " beta", "beta"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.identify(docs, net).collect():
        total, n = np.zeros(len(net.languages)), 0
        for w in texts[r.doc_id].encode().split():
            for at in range(0, len(w), language_id.LONGEST):
                y = net.label(np.frombuffer(w[at : at + language_id.LONGEST], np.uint8)[None])[0]
                total, n = total + y.sum(0), n + len(y)
        assert r.lang_pred == net.languages[int(total.argmax())] and r.score == pytest.approx(total.max() / n, rel=1e-5) and r.n_positions == n


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, word string, score double, kept boolean, component_id long"
    prose = [" ".join(f"{w}{(i * 7 + k * k) % 211}" for k, w in enumerate(["alpha", "beta", "gamma", "delta", "omega"] * 12)) for i in range(4)]
    texts = [*TEXTS, *prose, prose[0], prose[0] + " and more"]
    rows = [(i, t, "en" if i % 2 else None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[len(TEXTS)], (None, prose[1], "en", "s", 1, "w", 0.5, True, 7)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert got.columns == docs.columns
        if name != "deduplicate":  # a row without an id is judged as its text is
            assert got.where("doc_id IS NULL").count() == got.where((F.col("text") == prose[1]) & F.col("doc_id").isNotNull()).count(), name
        assert got.exceptAll(docs).count() == 0, name
    kept = {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()}
    first = len(TEXTS)
    assert {first, first + 1, first + 2, first + 3} <= kept and not {first + 4, first + 5} & kept
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
