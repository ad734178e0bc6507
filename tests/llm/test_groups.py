"""Operators that compare rows, gather counts, or chain."""

from collections import Counter
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import pytest
import xxhash

import corpus_pipeline
import memory_trie
from panelkit.llm import components, decontaminate, ppm, simhash, vectors
from panelkit.llm.decontaminate import contaminated
from panelkit.llm.queries import QUERIES
from panelkit.session import settle


# ---------------------------------------------------------------- components

def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_local_roots_find_the_smallest_node():
    draw = np.random.default_rng(0)
    for _ in range(200):
        n = int(draw.integers(1, 30))
        i, j = draw.integers(0, n, (2, int(draw.integers(0, 30))))
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j):
                want[want == max(want[a], want[b])] = min(want[a], want[b])
        assert (components.local_roots(n, i, j) == want).all()


# ---------------------------------------------------------------- simhash

def test_fingerprint_by_definition():
    words = "A  b\tC d".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(2)]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) > 1)
    assert simhash.fingerprint(simhash.shingle_hashes(b"A  b\tC d", 3)) & (2 ** 64 - 1) == want
    assert simhash.shingle_hashes(b"one two", 3) == [xxhash.xxh64_intdigest("one two", 42)]
    assert simhash.fingerprint(simhash.shingle_hashes(b" \n", 3)) == 0


def test_forest_finds_all_within_the_radius():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2 ** 63, (40, 1), dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 64, (40, 1), dtype=np.uint64)) for _ in range(6)]), axis=0)
    group = np.arange(len(values)) % 2
    i, j = simhash.Forest(values, group).within(values, group, 3)
    near = simhash.distance(np.repeat(values, len(values), 0), np.tile(values, (len(values), 1))).reshape(len(values), -1) <= 3
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(near)) if group[a] == group[b]}


def test_near_duplicates_equal_all_pairs(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 5)     # so that shards are split
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(15):
        text = draw.choices(words, k=200)
        for _ in range(draw.randint(1, 8)):
            changed = list(text)
            changed[draw.randrange(200)] = "changed"
            texts.append(" ".join(changed))
    rows = [(i, t) for i, t in enumerate(texts + texts[:3] + ["", None, " "])]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    value = {i: simhash.fingerprint(simhash.shingle_hashes((t or "").encode(), 3)) for i, t in rows}
    a, b = zip(*[(i, j) for i in value for j in value if bin((value[i] ^ value[j]) & (2 ** 64 - 1)).count("1") <= 3])
    root = components.local_roots(len(rows), np.array(a), np.array(b))
    assert got == {i: (value[i], int(root[i])) for i in value}
    odd = simhash.simhash_report(odd_docs).collect()
    assert len(odd) == 9 and {r["component_id"] for r in odd if r["doc_id"] in (2, 3, 4)} == {2}
    assert simhash.simhash_report(no_docs).collect() == []


def test_links_of_one_shard_are_no_more_than_its_nodes(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50_000)     # many steps
    draw = np.random.default_rng(6)
    for n in (500, 2000, 4000):
        # a chain of near copies: each differs from the one before in one bit
        value = np.bitwise_xor.accumulate(np.append(np.uint64(12345), np.uint64(1) << draw.integers(0, 64, n - 1).astype(np.uint64)))
        value = np.unique(value)
        m = len(value)
        a, b = simhash._shard_links(np.zeros(m, np.int64), np.arange(m), value[:, None], np.full(m, 3), 3)
        assert len(a) < m and len(set(a.tolist())) == len(a)
        root = components.local_roots(m, a, b)
        near = np.bitwise_count(value[:, None] ^ value[None]) <= 3
        assert (root == components.local_roots(m, *np.nonzero(near))).all()


# ---------------------------------------------------------------- vectors

def test_range_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOME", 7)
    monkeypatch.setattr(vectors, "ALL", 9)
    draw = np.random.default_rng(1)
    base = draw.normal(size=(12, 8))
    x = np.concatenate([base + draw.normal(size=base.shape) * s for s in (0, 0.05, 0.1, 0.2, 0.3)] + [base[:3], base[:2] * 7])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 8), (902, [None] + [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (904, []), (905, [1.0, 2.0]),
           (906, [float("inf")] + [1.0] * 7)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
           vectors.range_links(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    root = components.local_roots(len(x), *np.nonzero(near))
    want = {i: (int(near[i].sum() - 1), int(root[i]), bool(root[i] == i)) for i in range(len(x))}
    assert got == want | {i: (0, i, True) for i, _ in odd}


def test_range_links_without_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.range_links(none).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in vectors.range_links(nulls).collect()} == {(1, 0, 1, True), (None, 0, None, True)}


# ---------------------------------------------------------------- language model

def test_chances_of_all_next_symbols_add_up_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra"), (2, "abba"), (3, None)], "doc_id long, text string")
    model = memory_trie.learn(docs, order=3, keep=1000)
    for begin in ("", "a", "ab", "abr", "zz"):
        # the chance of a text is the chance of its bytes times that of the end
        ends = memory_trie.log_chance(model, pa.array([begin]))[0]
        longer = [memory_trie.log_chance(model, pa.array([begin + chr(c)]))[0] for c in range(128)]
        assert 10 ** ends + sum(10 ** v for v in longer) < 1
    table = 10 ** model.log10.astype(float)
    used = table.shape[1] - 1
    assert np.allclose(table[:, :used].sum(axis=1) + table[:, -1] * (ppm.SYMBOLS - used), 1, atol=1e-4)


def test_exclusion_by_hand(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "ac")], "doc_id long, text string")
    model = memory_trie.learn(docs, order=1, keep=1000)
    # behind "a": b and c once each of n = 2, d = 2; the end lies in the escape 2/4, from which b and c are excluded
    root = {s: n / (6 + 4) for s, n in {"a": 2, "b": 1, "c": 1, "end": 2}.items()}
    rest = 1 - root["b"] - root["c"]
    behind_begin = 2 / (2 + 1)
    want = math.log10(behind_begin) + math.log10(0.5 * root["end"] / rest)
    assert memory_trie.log_chance(model, pa.array(["a"]))[0] == pytest.approx(want, abs=1e-5)


def test_scores_use_every_context_of_the_training_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    extra = spark.createDataFrame([(-1, "zqxjk vwpfz once"), (-2, "Ωmega zqxjk"), (-3, ""), (-4, None)], "doc_id long, text string")
    docs = settle(docs.unionByName(extra))
    learnt = docs.filter("doc_id % 3 != 0")
    whole = memory_trie.learn(learnt, keep=1 << 60)
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], memory_trie.log_chance(whole, pa.array([r["text"] for r in rows], pa.string()))))
    # all asked, most asked, all broadcast; branches cut down to whole contexts, their questions dealt in parts
    for fast, size in ((5000, 2000), (0, 200), (1 << 21, 1 << 21)):
        monkeypatch.setattr(ppm, "FAST", fast)
        monkeypatch.setattr(ppm, "BRANCH", size)
        monkeypatch.setattr(ppm, "HELD", size // 2)
        got = {r["doc_id"]: r["score"] for r in ppm.scored(docs, learnt).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-5) for i in want)


def test_scores_equal_plain_counting(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 20)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in docs.collect()}
    got = {r["doc_id"]: r for r in QUERIES["op3_ppm"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r["doc_id"]: r["text"].encode().lower().split() for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n = sum(not h for h in held.values())
    tokens = sum(counts.values()) + n
    under = tokens + 0.1 * (len(counts) + 2)
    for i, t in texts.items():
        base = sum(math.log10((counts[w] + 0.1) / under) for w in t) + math.log10((n + 0.1) / under)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t) + 1, 1 + sum(counts[w] > 0 for w in t), tokens, held[i])
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0 and r["code_bits"] == pytest.approx(-r["score"] * math.log2(10))
    odd = ppm.scored(odd_docs, odd_docs).collect()
    assert len(odd) == 9 and {r["n_tokens"] for r in odd if r["doc_id"] in (2, 3, 4)} == {1}
    assert ppm.scored(no_docs, no_docs).collect() == []
    blank = ppm.scored(odd_docs, no_docs).filter("doc_id = 3").first()
    assert blank["base_score"] == 0 and blank["score"] == pytest.approx(-math.log10(257), abs=1e-5) and blank["n_known"] == 0


def test_run_counts_come_packed_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(ppm, "COUNTED", 40)
    draw = random.Random(2)
    texts = [None, "", "", "Ab", "aB é Ω"] + ["".join(draw.choices("aBc \n", k=draw.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter()
    for t in texts:
        whole = b"\xfe" * 3 + (t or "").encode().lower() + b"\xff"
        want.update(int.from_bytes(whole[i:i + 4], "big") for i in range(len(whole) - 3))
    places, kinds = Counter(), Counter(g >> 8 for g in want)
    for g, n in want.items():
        places[g >> 8] += n
    counts = ppm.gram_counts(docs, order=3)
    rows = [tuple(r) for r in counts.select("gram", "n", "under").collect()]
    assert sorted(rows) == sorted((g, n, places[g >> 8] + kinds[g >> 8]) for g, n in want.items())
    # runs are no rows of the shuffle
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
    assert ppm.gram_counts(docs.limit(0), order=3).collect() == []


def test_words_meet_their_counts_by_bucket(spark, monkeypatch):
    for name, value in {"WORDS": 7, "ASKED": 50, "FREQUENT": 20, "STEP": 60}.items():
        monkeypatch.setattr(ppm, name, value)
    draw = random.Random(3)
    texts = [None, "", " \n"] + [" ".join(f"W{int(draw.paretovariate(0.5)) % 300}" for _ in range(draw.randrange(25))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string").repartition(2)
    learnt = docs.filter("doc_id % 4 != 0")
    split = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    counts = Counter(w for r in learnt.collect() for w in split[r["doc_id"]])
    texts_learnt = learnt.count()
    under = sum(counts.values()) + texts_learnt + 0.1 * (len(counts) + 2)
    result = ppm.scored(docs, learnt)
    rows = result.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted([*split, 5]) and any(counts[w] == 0 for t in split.values() for w in t)
    for r in rows:
        words = split[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (len(words) + 1, 1 + sum(counts[w] > 0 for w in words))
        base = sum(math.log10((counts[w] + 0.1) / under) for w in words) + math.log10((texts_learnt + 0.1) / under)
        assert r["base_score"] == pytest.approx(base, rel=1e-12)
    # words are no rows of a join; the one left brings the sums back to their rows
    assert result._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


# ---------------------------------------------------------------- decontamination

def test_contaminated_finds_passages_and_leaves_others(spark, odd_docs, no_docs):
    item = " ".join(f"i{k}" for k in range(40))
    short, repeated = "just three words", "again and again " * 6
    changed = item.replace("i39", "x").replace("i0 ", "y ")
    rows = [(1, "before it " + item.upper() + " after it"), (2, f"p q {changed} r"), (3, " ".join(f"i{k}" for k in range(20)) + " z" * 40),
            (4, f"so {short} here"), (5, "x " + repeated), (6, "clean text " * 50), (7, item + " " + item), (8, None), (9, ""), (1, "same id " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, short), (12, repeated), (13, None), (14, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (4, 11), (5, 12), (7, 10)}
    assert got[1, 10]["similarity"] == 1 and got[1, 10]["first_word"] == 2
    assert got[2, 10]["similarity"] == pytest.approx(34 / 38)
    assert contaminated(odd_docs, bench).count() == 0
    assert contaminated(no_docs, bench).collect() == contaminated(docs, bench.limit(0)).collect() == []


def test_many_short_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 60)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(5))) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some text {i} then " + " ".join(f"w{7 * i}x{k}" for k in range(5)) + " end") for i in range(50)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert got == {(i, 7 * i) for i in range(43)}


def test_long_items_are_compared_whole(spark, monkeypatch):
    item = [f"i{k}" for k in range(4101)]
    rows = [(1, "so " + " ".join(item[4096:]) + " it ends"), (2, "a " + " ".join(item[:4096])), (3, "x y " + " ".join(item) + " z"),
            (4, " ".join(item[:3000])), (5, "p " + " ".join(item[:3900] + ["q"] * 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in contaminated(docs, bench).collect()}
    assert set(got) == {2, 3, 5} and got[3]["similarity"] == 1 and got[3]["first_word"] == 2
    assert got[2]["similarity"] == pytest.approx(4092 / 4097) and got[5]["first_word"] == 1
    # counting by running sums equals the windows written out, repeated shingles and cut windows included
    draw = random.Random(4)
    passages = [draw.choices("abcd", k=60) for _ in range(6)] + [["r"] * 50 + list("stuvwxyz") * 4]
    texts = [draw.choices("abcd", k=draw.randrange(30)) + p[:draw.randrange(45, 70)] + draw.choices("abc", k=draw.randrange(30))
             for p in passages for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PART", 10)
    counted = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["first_word"], r["n_windows"]) for r in contaminated(docs, bench).collect()}
    numbered = lambda s: {(g, s[:k].count(g)) for k, g in enumerate(s)}
    fives = lambda t: [tuple(t[k:k + 5]) for k in range(len(t) - 4)]
    want = {}
    for d, t in enumerate(texts):
        for b, p in enumerate(passages):
            all_, own = fives(t), fives(p)
            hits = []
            for k in (k for k, g in enumerate(all_) if g in own):
                window, marks = numbered(all_[k:k + len(own)]), numbered(own)
                hits.append((len(window & marks) / len(window | marks), -k))
            hits = [h for h in hits if h[0] >= 0.8]
            if hits:
                want[d, b] = (round(max(hits)[0], 9), -max(hits)[1], len(hits))
    assert counted == want and len(want) > 20


def test_items_with_repeated_shingles_are_found(spark):
    distinct = {k: [f"d{k}x{i}" for i in range(44)] for k in range(40)}
    # 45 shingles shared of 54: the item has nine more copies of one
    docs = spark.createDataFrame([(k, " ".join(d + ["r"] * 5)) for k, d in distinct.items()], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(d + ["r"] * 14)) for k, d in distinct.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminated(docs, items).collect()}
    assert got.keys() == {(k, k) for k in distinct} and all(v == pytest.approx(45 / 54) for v in got.values())


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_return_documents_and_survive_odd_rows(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.dtypes == docs.dtypes, name
            assert out.columns == docs.columns, name
            kept = {r["doc_id"] for r in out.collect()}
            assert kept <= {r["doc_id"] for r in docs.collect()}, name
        assert "token_ids" in corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns


def test_pipeline_decisions_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    more = [(90_001, "!!! 123", "en", "s", 7), (90_002, leak, "en", "s", len(leak)), (90_003, "key is password=abcdefgh1 ok then", "en", "s", 33)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    kept = corpus_pipeline.language(spark, docs, folder)
    assert kept.filter("doc_id = 90001").count() == 0 and kept.count() == docs.count() - 1
    single = corpus_pipeline.near_duplicate(spark, kept, folder)
    assert single.groupBy("text").count().filter("count > 1").count() == 0
    free = corpus_pipeline.benchmark_free(spark, single, folder)
    assert free.filter("doc_id = 90002").count() == 0
    masked = corpus_pipeline.secret_free(spark, free, folder).filter("doc_id = 90003").first()
    assert masked["text"] == "key is [SECRET] ok then" and masked["n_chars"] == 23
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_judges_rows_without_an_id_or_with_a_shared_one(spark):
    folder = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(None, leak, "en", "s", 1), (None, "some clean words of a text without an id", "en", "s", 1), (5, leak, "en", "s", 1),
            (5, "another clean text that shares an id with a leak", "en", "s", 1), (5, "another clean text that shares an id with a leak", "en", "s", 2),
            (4, "some clean words of a text without an id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_number long")
    free = corpus_pipeline.benchmark_free(spark, docs, folder)
    assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in free.collect()) == [(0, "some"), (4, "some"), (5, "anot"), (5, "anot")]
    single = corpus_pipeline.near_duplicate(spark, docs, folder)
    assert sorted((r["doc_id"], r["text"][:4]) for r in single.collect()) == sorted([(4, "some"), (5, "anot"), (5, leak[:4])])


def test_language_stage_rejects_what_no_label_teaches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(4)
    other = ["".join(draw.choices("абвгдежзиклмнопрстуфхцчшщ", k=6)) for _ in range(300)]
    foreign = [(10 ** 6 + i, " ".join(draw.choices(other, k=80)), None, "s", 1) for i in range(40)]
    kept = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(foreign, docs.schema)), "/root/testdata/sf0.01")
    assert kept.filter("doc_id < 1000000").count() >= 0.99 * docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert kept.filter("doc_id >= 1000000").count() <= 20
