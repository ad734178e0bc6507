"""The prefix trie, whitening and quality; and plain loops beside the networks and the pseudonyms."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from panelkit.llm import langid, prefixes, pseudonyms, quality, toxicity, whitening

TURNS = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- prefix trie

def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(made) + 1):
            node = nodes.setdefault(tuple(made[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(made):
                node["ends"].append(c)
    inner = {p[:-1] for p in nodes if p}
    out = set()
    for p, node in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        out.add((min(node["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(node["members"]),
                 sum(len(q) == len(p) + 1 for q in below), sum(q not in inner for q in below),
                 sum((len(nodes[q]["members"]) - 1) * len(q[-1][1]) for q in below if q),
                 hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()))
    return out


def test_trie_equals_plain_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 3)         # lists of ids in many pieces
    draw = random.Random(1)
    rows = []
    for c in [*range(0, 40), *range(100, 160), *range(-130, -95), 301, 302]:
        for t in range(draw.choice([1, 2, 3, 5, 8, 20])):
            rows.append((c, draw.choice([t, t, None, 7]), draw.choice(["user", "assistant", None]), draw.choice(["", "a", "é ü", None, "abc"])))
    rows += [(100, t, "user", "same") for t in range(70)] + [(None, 1, "user", "no id")] + [(7, 3, "user", "twice")] * 2
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "'x' AS name")
    got = prefixes.trie_report(table).collect()
    assert {tuple(r) for r in got} == plain_trie(rows) and len(got) == len({tuple(r) for r in got})
    assert prefixes.trie_report(spark.createDataFrame([], TURNS)).collect() == []
    single = prefixes.trie_report(spark.createDataFrame([(5, None, None, None)], TURNS)).collect()
    assert {tuple(r) for r in single} == plain_trie([(5, None, None, None)])


def test_a_hot_conversation_and_hot_copies_are_spread(spark):
    rows = [(0, t, "user", f"t{t % 3}") for t in range(3000)] + [(100 * k, t, "user", f"t{t}") for k in range(1, 600) for t in range(2)]
    nodes = prefixes.prefix_trie(*prefixes.rebuilt(prefixes.numbered(spark.createDataFrame(rows, TURNS)))).collect()
    depth = {r["depth"]: r for r in nodes if r["low"] == 0}
    assert len(nodes) == 3001 and depth[0]["members"] == 600 and depth[2]["members"] == 600 and depth[3]["members"] == 1
    assert depth[2]["digest"] == hashlib.sha256(",".join(str(100 * k) for k in range(1, 600)).encode()).hexdigest()
    assert depth[0]["leaves"] == 1 and depth[0]["saved"] == 2 * 2 * 599


# ---------------------------------------------------------------- whitening

def test_inertia_counts_eigenvalues_above_a_shift():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        a = draw.normal(size=(n, n))
        a = a + a.T
        for shift in (-1.0, 0.0, 0.7):
            assert whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]]), 0) == 1 and whitening.inertia(np.zeros((3, 3)), 0) == 0


@pytest.mark.parametrize("values", [[9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5], [4] * 10, [5, 5, 5, 1, 1, 1, 1, 0, 0, 0], [1e6, 1, 1e-3, 0, 0, 0, 0, 0, 0, 0],
                                    [1 + 1e-9 * k for k in range(10)]])
def test_leading_components_equal_a_full_solve(spark, values):
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(10, 10)))[0]
    v = q * np.array(values, float) @ q.T
    v = (v + v.T) / 2
    value, vector = whitening.leading(spark, v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:len(value)]
    assert len(value) == min(4, (np.array(values) > 1e-11 * sum(values)).sum())
    assert np.allclose(value, want, rtol=1e-9, atol=1e-12 * want.max())
    assert np.allclose(vector.T @ vector, np.eye(len(value)), atol=1e-10)
    assert np.allclose(v @ vector, vector * value, atol=1e-10 * want.max())


def test_whitened_equals_numpy(spark):
    draw = np.random.default_rng(4)
    data = draw.normal(size=(300, 20)) * np.linspace(1, 3, 20)
    rows = [(i, x.tolist(), "c") for i, x in enumerate(data)] + [(0, data[0].tolist(), "again"), (None, data[1].tolist(), "no id")]
    odd = [(900, None, "x"), (901, [], "x"), (902, [float("nan")] * 20, "x"), (903, [None] + [1.0] * 19, "x"), (904, [float("inf")] * 20, "x"), (905, [1.0, 2.0], "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component string")
    got = whitening.whitened(table).toPandas()
    x = np.floor(64 * data) + 1_000_000
    centred = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / 300)
    value, vector = value[::-1][:16], vector[:, ::-1][:, :16]
    want = centred @ vector / np.sqrt(value)
    mine = got[got.vec_id.between(1, 299)].sort_values(["vec_id", "component"])
    table_ = mine.whitened.to_numpy().reshape(299, 16)
    assert np.allclose(np.abs(table_), np.abs(want[1:]), atol=1e-8) and len(got) == 302 * 16
    assert (mine.n == 300).all() and np.allclose(mine.explained.to_numpy()[:16], value / (centred ** 2).sum() * 300) and mine.identity_error.max() < 1e-9
    whole = [sum((300 * int(c) - int(s)) ** 2 for c, s in zip(row, x.sum(axis=0))) for row in x]
    assert mine.deviation.tolist()[::16] == whole[1:]
    assert whitening.whitened(table.limit(0)).collect() == [] and whitening.whitened(table.filter("vec_id = 3")).collect() == []


def test_whitening_survives_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert got and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


# ---------------------------------------------------------------- quality

EN = "the of and with that this have from they which thing would there".split()


def prose(draw):
    return " ".join(draw.choices(EN, k=draw.randint(20, 200))).capitalize() + "."


def junk(draw):
    kind = draw.randrange(3)
    if kind == 0:
        return " ".join([draw.choice(EN)] * draw.randint(30, 200))
    return " ".join(w + "$$$" if kind == 1 else w.upper() + "!!" for w in draw.choices(EN, k=draw.randint(20, 200)))


def test_quality_learns_from_positives_and_unlabelled_texts(spark, odd_docs, no_docs):
    draw = random.Random(7)
    texts = [junk(draw) if i % 5 == 0 else prose(draw) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # only good texts are labelled; a label 0 beside a label 1 is no trusted one
    labels = spark.createDataFrame([(i, 1) for i in range(0, 1000) if i % 5 and i % 2] + [(1, 0), (None, 1)], "doc_id long, quality int")
    settings = quality.Settings(positive=300, unlabelled=800, buckets=256, steps=400)
    net = quality.learn(docs.filter("doc_id < 1000"), labels, settings)
    assert abs(net.prior - 0.8) < 0.08
    found = {r["doc_id"]: r for r in quality.with_quality(docs.filter("doc_id >= 1000"), net, ["doc_id"]).collect()}
    right = [(r["predicted"] == 1) == (i % 5 != 0) for i, r in found.items()]
    assert np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in found.values())
    odd = quality.with_quality(odd_docs, net, ["doc_id"]).collect()
    assert len(odd) == 9 and {r["doc_id"] for r in odd if r["score"] == 0} >= {2, 3, 4}
    assert quality.with_quality(no_docs, net, ["doc_id"]).collect() == []
    assert quality.learn(no_docs, labels) is None and quality.learn(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.with_quality(odd_docs, None, ["doc_id"]).collect()} == {0.0}


def test_non_negative_risk_by_hand_and_by_differences():
    p, u = np.array([2.0, -1.0, 0.5]), np.array([1.0, -2.0, 3.0, 0.0])
    first, second = quality.risk(p, u, 0.3)
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    assert first == pytest.approx(0.3 * loss(p)) and second == pytest.approx(loss(-u) - 0.3 * loss(-p))
    for prior in (0.3, 0.95):
        some = u if prior == 0.3 else u - 4           # the second part is negative there
        sign = -1 if quality.risk(p, some, prior)[1] < 0 else 1
        value = lambda a, b: (quality.risk(a, b, prior)[0] if sign > 0 else 0) + sign * quality.risk(a, b, prior)[1]
        by_p, by_u = quality.slopes(p, some, prior)
        for i in range(3):
            step = np.eye(3)[i] * 1e-6
            assert by_p[i] == pytest.approx((value(p + step, some) - value(p - step, some)) / 2e-6, abs=1e-6)
        for i in range(4):
            step = np.eye(4)[i] * 1e-6
            assert by_u[i] == pytest.approx((value(p, some + step) - value(p, some - step)) / 2e-6, abs=1e-6)
    assert quality.risk(p, u - 4, 0.95)[1] < 0


def test_features_equal_a_plain_loop():
    texts = ["The cat, the CAT sat!! on 12 | mats\nand\tthe the the end.", "", None, "é$$$ $", "x" * 700, "a b a b a", " \n "]
    rows = quality.features(pa.array(texts), 64)
    for text, row in zip(texts, rows):
        data = (text or "").encode()
        words = data.split()
        many, total = max(len(words), 1), max(len(data), 1)
        letters = max(sum(chr(b).isalpha() and b < 128 for b in data), 1)
        marks = lambda w: w[-1] < 128 and not chr(w[-1]).isalnum()
        sizes = [len(w) for w in words]
        want = [sum(65 <= b < 91 for b in data) / letters, sum(48 <= b < 58 for b in data) / total, sum(b in b"\t\x0b\x0c\r " for b in data) / total,
                data.count(b"\n") / total, sum(b < 128 and not chr(b).isalnum() and b not in b"\t\n\x0b\x0c\r " for b in data) / total,
                sum(b >= 128 for b in data) / total, math.log1p(sum(sizes) / many), math.log1p(np.std(sizes) if words else 0),
                sum(a == b for a, b in zip(words, words[1:])) / many, len(set(words)) / many, max([words.count(w) for w in words], default=0) / many,
                sum(marks(w) and w[-1:] not in (b".", b",", b";", b":", b"?") for w in words) / many, sum(len(w) == 1 and marks(w) for w in words) / many,
                math.log1p(len(words)) / 10, math.log1p(len(set(words))) / 10, not words]
        assert np.allclose(row[:quality.SHAPES] if data else np.append(row[:15], 1.0), want, atol=1e-5), text
        assert (row[quality.SHAPES:] ** 2).sum() == pytest.approx(1 if len(data) > 2 else 0, abs=1e-4)


# ---------------------------------------------------------------- plain loops beside the networks

def test_language_scores_equal_a_plain_loop():
    settings = langid.Settings(texts=40, windows=2, steps=60, batch=16)
    draw = random.Random(3)
    texts = [" ".join(draw.choices(EN if i % 2 else "der und nicht eine straße größe".split(), k=60)) for i in range(60)]
    net = langid.fit([t.encode() for t in texts], ["en" if i % 2 else "de" for i in range(60)], settings)
    some = [texts[0], "", "x", "größe " * 120, "ab"]
    best, chance = langid.identify(net, pa.array(some))
    e = len(net.embed)
    wide = net.conv.shape[1] // e
    for k, text in enumerate(some):
        data = text.encode()
        total = np.zeros(len(net.languages))
        for first in range(0, len(data), net.window):
            window = list(data[first:first + net.window])
            seen = list(data[first:first + net.window + wide - 1])
            seen += [langid.PAD] * (net.window + wide - 1 - len(seen))
            top = np.full(len(net.conv), -np.inf)
            for place in range(net.window):
                part = np.concatenate([net.embed[:, seen[place + j]] for j in range(wide)])
                top = np.maximum(top, net.conv @ part)
            score = np.tanh(top + net.bias) @ net.dense + net.last
            total += (score - np.log(np.exp(score - score.max()).sum()) - score.max()) * len(window)
        if data:
            odds = np.exp(total / len(data))
            assert best[k] == odds.argmax() and chance[k] == pytest.approx(odds.max() / odds.sum(), rel=1e-4)
        else:
            assert chance[k] == 0


def test_toxicity_scores_equal_a_plain_loop():
    settings = toxicity.Settings(hidden=3, width=4, window=6, words=64, trigrams=64)
    net = toxicity.fresh(settings)
    v, h = net.values, settings.hidden
    texts = ["one two", "", None, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def word_input(word):
        data = word.encode()
        codes = []
        marked = [2, *data, 3]
        for a, b, c in zip(marked, marked[1:], marked[2:]):
            code = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
            codes.append((a * 0x9E3779B1 & 0xFFFFFFFF ^ b * 0x85EBCA6B & 0xFFFFFFFF ^ c * 0xC2B2AE35 & 0xFFFFFFFF, code)[1])
        rows = [(c ^ c >> 15) % settings.trigrams for c in codes]
        return np.concatenate([v["word"][xxhash.xxh32_intdigest(data) % settings.words], v["trigram"][rows].mean(axis=0)]) @ v["input"] + v["bias"]

    def window_score(words):
        gates = [word_input(w) for w in words] + [v["bias"]] * (settings.window - len(words))
        states = np.zeros((settings.window, 2, h))
        for d in (0, 1):
            state = np.zeros(h)
            for t in range(settings.window) if d == 0 else reversed(range(settings.window)):
                given, own = gates[t][d * 3 * h:(d + 1) * 3 * h], state @ v["back"][d]
                update, reset = sig(given[:h] + own[:h]), sig(given[h:2 * h] + own[h:2 * h])
                state = update * state + (1 - update) * np.tanh(given[2 * h:] + reset * own[2 * h:])
                states[t, d] = state
        energy = np.array([(states[t] * v["attend"]).sum() for t in range(len(words))])
        weight = np.exp(energy - energy.max())
        pooled = np.einsum("t,tdh->dh", weight / weight.sum(), states[:len(words)])
        return (pooled * v["last"]).sum() + v["final"][0]

    got = toxicity.score_texts(net, texts)
    for text, score in zip(texts, got):
        words = (text or "").lower().split()
        step = settings.window // 2
        starts = range(0, max(1, -(-(len(words) - step) // step)) * step, step) if words else []
        odds = [window_score(words[a:a + settings.window]) for a in starts]
        assert score == pytest.approx(sig(np.log(np.exp(odds).sum())) if odds else 0, abs=1e-4)


def test_only_long_toxic_texts_still_teach(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(EN + ["scoundrel"] * (i % 2) * 4, k=2500)), i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.learn(docs, docs.select("doc_id", "toxic"), toxicity.Settings(toxic=30, clean=30, steps=60, words=1 << 10, trigrams=1 << 10))
    found = toxicity.with_toxicity(docs, net, ["toxic"]).collect()
    assert np.mean([r["toxic"] == r["predicted"] for r in found]) > 0.9


# ---------------------------------------------------------------- a plain Feistel network

def plain_feistel(left, right, a, b, key, label, undo=False):
    digest = lambda turn, half, size: int(hashlib.sha256((key + hashlib.sha256(f"{key}|{label}|{turn}|{half}".encode()).hexdigest()).encode()).hexdigest()[:15], 16) % size
    for turn in reversed(range(8)) if undo else range(8):
        if turn % 2 == 0:
            left = (left + (-1 if undo else 1) * digest(turn, right, a)) % a
        else:
            right = (right + (-1 if undo else 1) * digest(turn, left, b)) % b
    return left, right


def luhn(digits):
    odd = [int(d) for d in reversed(digits)]
    return sum(odd[::2] + [sum(divmod(2 * d, 10)) for d in odd[1::2]]) % 10 == 0


def plain_card(value, key):
    digits = re.sub("[^0-9]", "", value)
    payload = digits[:-1]
    cut = len(payload) // 2
    left, right = plain_feistel(int(payload[:cut]), int(payload[cut:]), 10 ** cut, 10 ** (len(payload) - cut), key, f"card{len(payload)}")
    made = f"{left:0{cut}d}{right:0{len(payload) - cut}d}"
    made += next(d for d in "0123456789" if luhn(made + d))
    turn = iter(made)
    return re.sub("[0-9]", lambda _: next(turn), value)


def plain_ip(value, key):
    o = list(map(int, value.split(".")))
    left, right = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    return ".".join(map(str, (left // 256, left % 256, right // 256, right % 256)))


def plain_ssn(value, key):
    area, group, serial = map(int, value.split("-"))
    left, right = plain_feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    area = left // 99 + 1
    return f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def test_pseudonyms_equal_a_plain_scanner(spark):
    draw = random.Random(9)

    def card():
        digits = "".join(draw.choices("0123456789", k=15))
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return draw.choice([digits, "-".join(digits[i:i + 4] for i in range(0, 16, 4)), " ".join(digits[i:i + 4] for i in range(0, 16, 4))])

    makers = {"card": (card, plain_card), "ip": (lambda: ".".join(str(draw.randrange(256)) for _ in range(4)), plain_ip),
              "ssn": (lambda: f"{draw.choice([1, 123, 665, 667, 899]):03d}-{draw.randint(1, 99):02d}-{draw.randint(1, 9999):04d}", plain_ssn)}
    rows, want = [], []
    for i in range(60):
        parts, changed, found = [], [], []
        for _ in range(draw.randint(0, 6)):
            kind = draw.choice(list(makers))
            value = makers[kind][0]()
            name = makers[kind][1](value, "key")
            gap = " " + draw.choice(["and", "then,", "(see)", "x"]) + " "
            parts += [gap, value]
            changed += [gap, name]
            found.append((kind, name))
        rows.append((i, "".join([*parts, " end"])))
        want.append(("".join([*changed, " end"]), found))
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    for i, (text, found) in enumerate(want):
        assert got[i]["text"] == text and [tuple(p) for p in got[i]["pii"]] == found, rows[i]
