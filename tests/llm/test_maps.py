"""Operators that rewrite or label each text on its own."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import pytest

from panelkit.llm import chat, langid, pieces, pseudonyms, secrets, toxicity
from panelkit.llm.automaton import compile_rules, cut, scan, spans
from panelkit.llm.common import flat, remainder, steps
from panelkit.llm.queries import PIECES, QUERIES, SQL

SMALL = langid.Settings(texts=40, windows=2, steps=200, batch=16)


def texts_of(words, n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choices(words, k=draw.randint(5, 60))) for _ in range(n)]


EN = "the of and with that this have from they which thing would there".split()
DE = "der und nicht eine sich mit auf für über können straße größe".split()


# ---------------------------------------------------------------- common

def test_flat_and_steps_keep_every_byte():
    texts = pa.array(["ab", None, "", "é", "x" * 100])
    data, offsets = flat(texts.slice(1))
    assert data.tobytes() == ("é" + "x" * 100).encode() and offsets.tolist() == [0, 0, 0, 2, 102]
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    assert [b.num_rows for b in steps(iter([batch]), "t", 10)] == [4, 1]


# ---------------------------------------------------------------- language

def test_language_network_learns_and_names_only_learnt_labels(spark, odd_docs, no_docs):
    labelled = spark.createDataFrame(
        [(i, t, lang) for lang, words in (("en", EN), ("de", DE)) for i, t in enumerate(texts_of(words, 60, lang))],
        "doc_id long, text string, lang string")
    net = langid.learn(labelled, settings=SMALL)
    fresh = spark.createDataFrame([(i, t, lang) for lang, words in (("en", EN), ("de", DE))
                                   for i, t in enumerate(texts_of(words, 20, lang + "2"))], "doc_id long, text string, want string")
    found = langid.with_language(fresh, net, ["want"]).collect()
    assert np.mean([r["want"] == r["lang_pred"] for r in found]) > 0.95
    odd = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in langid.with_language(odd_docs, net, ["doc_id"]).collect()}
    assert {d for d, und, zero in odd if und and zero} == {2, 3, 4, 5}
    assert {d for d, und, _ in odd if not und} == {1, 6, 7, None}
    assert langid.with_language(no_docs, net, ["doc_id"]).collect() == []
    assert langid.learn(no_docs) is None
    assert {r["lang_pred"] for r in langid.with_language(odd_docs, None, ["doc_id"]).collect()} == {"und"}


def test_language_windows_cover_whole_texts():
    data, offsets = flat(pa.array(["a" * 600, "", "b"]))
    rows, owner, size = langid.windows(data, offsets, 256, 3)
    assert owner.tolist() == [0, 0, 0, 2] and size.tolist() == [256, 256, 88, 1] and rows.shape == (4, 259)
    assert (rows[2, 88:] == langid.PAD).all() and (rows[0] == ord("a")).all()


# ---------------------------------------------------------------- toxicity

def test_toxicity_learns_a_word_in_long_texts(spark, odd_docs, no_docs):
    draw = random.Random(2)
    settings = toxicity.Settings(toxic=60, clean=60, epochs=8, words=1 << 10, trigrams=1 << 10)
    def made(i):
        words = draw.choices(EN, k=draw.randint(3, 150))
        if i % 2:
            words[draw.randrange(len(words))] = "scoundrel" + draw.choice(["", "s", "ly"])
        return i, " ".join(words), i % 2
    rows = [made(i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.learn(docs.filter("doc_id < 120"), docs.select("doc_id", "toxic"), settings)
    found = toxicity.with_toxicity(docs.filter("doc_id >= 120"), net, ["toxic"]).collect()
    assert np.mean([r["toxic"] == r["predicted"] for r in found]) > 0.9
    odd = toxicity.with_toxicity(odd_docs, net, ["doc_id"]).collect()
    assert len(odd) == 9 and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["doc_id"] for r in odd if r["score"] == 0} >= {2, 3, 4}
    assert toxicity.with_toxicity(no_docs, net, ["doc_id"]).collect() == []
    assert toxicity.learn(no_docs, docs.limit(0).select("doc_id", "toxic")) is None


def test_toxicity_gradients_match_differences():
    settings = toxicity.Settings(hidden=3, width=3, window=6, words=16, trigrams=16)
    net = toxicity.fresh(settings)
    net.values = {k: v.astype(np.float64) for k, v in net.values.items()}
    texts, y = ["a bad day for all of us here today ok", "fine words", "x"], np.array([1.0, 0, 1])
    words, ids, borders = toxicity.split(texts)
    at, owner = toxicity.windows(ids, borders, 6, len(words))

    def loss():
        score = toxicity.forward(net, toxicity.inputs(net, words)[0], at)
        text_score = toxicity.joined(score, owner, 3)
        return (np.log1p(np.exp(text_score)) - y * text_score).sum()

    run = toxicity.forward(net, toxicity.inputs(net, words)[0], at, keep=True)
    text_score = toxicity.joined(run[0], owner, 3)
    error = 1 / (1 + np.exp(-text_score)) - y
    grad, _ = toxicity.backward(net, at, len(words) + 1, error[owner] * np.exp(run[0] - text_score[owner]), run)
    for name, g in grad.items():
        place = tuple(np.array(g.shape) // 2)
        value, step = net.values[name], 1e-3
        kept = value[place]
        value[place] = kept + step
        above = loss()
        value[place] = kept - step
        below = loss()
        value[place] = kept
        assert g[place] == pytest.approx((above - below) / (2 * step), rel=1e-2, abs=1e-5), name


# ---------------------------------------------------------------- pieces

def best_score(machine, vocabulary, text):
    """The best score by plain dynamic programming over all pieces."""
    marked = b"\xff" + text.encode().replace(b" ", b"\xff")
    scores = {}
    for i in vocabulary.normal:
        scores[vocabulary.pieces[i]] = max(scores.get(vocabulary.pieces[i], -1e18), vocabulary.scores[i])
    best = [0.0]
    for end in range(1, len(marked) + 1):
        best.append(max([best[end - 1] + machine.byte_score]
                        + [best[end - n] + scores[marked[end - n:end]] for n in range(1, min(end, 64) + 1) if marked[end - n:end] in scores]))
    return best[-1]


def test_pieces_round_trip_and_are_best():
    vocabulary = pieces.read_vocabulary(PIECES)
    machine = pieces.build(vocabulary)
    encoder = pieces.Encoder(vocabulary, machine)
    texts = ["hello world", " ", "  two  spaces ", "▁ mark ▁", "tab\tline\n\n", "naïve 漢字 😀 \x00\x7f", "a" * 400 + " tail", " " * 300, "", None]
    found = encoder.encode(texts)
    by_id = {**{int(i): vocabulary.scores[i] for i in vocabulary.normal}, **{int(i): machine.byte_score for i in vocabulary.byte_ids}}
    for text, ids in zip(texts, found):
        assert pieces.decode(vocabulary, ids.tolist()) == (text or "")
        if text:
            assert sum(by_id[int(i)] for i in ids) == pytest.approx(best_score(machine, vocabulary, text))
    assert len(found[-1]) == len(found[-2]) == 0


def test_pieces_operator_on_odd_rows(spark, odd_docs, no_docs):
    rows = pieces.encoded(odd_docs, PIECES, check=True).collect()
    assert len(rows) == 9 and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    back = pieces.decoded(pieces.encoded(odd_docs, PIECES), PIECES).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert pieces.encoded(no_docs, PIECES).collect() == []


# ---------------------------------------------------------------- secrets

PLAIN = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
         "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def plain_spans(text):
    long = {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: m.end() - m.start() >= 20, "hex": lambda m: m.end() - m.start() >= 24}
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in p.finditer(text) if long[kind](m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_secret_spans_equal_plain_regexes():
    draw = random.Random(1)
    parts = ["token", "secret", "PassWord", "api_key", "apikey", ":", "=", " ", "'", '"', "AKIA", "ABCDEFGHIJ012345", "deadbeef01",
             "0123456789abcdef", "é", "\n", "xyz.-_/+", "a", "b,", "|", "passwd", "ghp_", "AKIAAKIA"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(1500)]
    texts += ["", None, "x" * 5000 + " token = " + " " * 3000 + "abcdef12" * 200, "token: secret: abcdef", "secret=token=abcdefgh"]
    for text, found in zip(texts, secrets.find(pa.array(texts))):
        assert [f for f in found if f[0] in PLAIN] == plain_spans(text or ""), text


def test_added_kinds_and_redaction(spark, odd_docs, no_docs):
    key = "ghp_" + "a1B2" * 9
    docs = spark.createDataFrame([(1, f"é {key} and password: hunter2hunter"), (2, "nothing"), (3, None), (4, "")], "doc_id long, text string")
    spans_ = secrets.secret_spans(docs, keep=["doc_id", "text"])
    rows = {r["doc_id"]: r["out"] for r in spans_.select("doc_id", secrets.redacted(F.col("text"), F.col("secret_spans")).alias("out")).collect()}
    assert rows == {1: "é [SECRET] and [SECRET]", 2: "nothing", 3: None, 4: ""}
    report = {r["doc_id"]: r for r in secrets.secret_report(docs).collect()}
    assert report[1]["n_assign"] == 1 and report[1]["spans"].startswith("github:2:42") and report[2]["spans"] == ""
    assert secrets.secret_report(odd_docs).count() == 9 and secrets.secret_report(no_docs).collect() == []


def test_overlapping_spans_are_masked_once(spark):
    text = "token=" + "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = secrets.secret_spans(docs, keep=["text"]).select(secrets.redacted(F.col("text"), F.col("secret_spans")).alias("t")).first()["t"]
    assert out == "[SECRET]"


def test_minimal_automaton_tells_rules_apart():
    rules = [(b"ab+", False), (b"a[bc]", True)]
    assert sorted(spans(compile_rules(rules), compile_rules(rules, back=True), b"xabbaC", 2)) == [(0, 1, 4), (1, 1, 3), (1, 4, 6)]
    anywhere = compile_rules([(b"ab+", False)], anywhere=True)
    data, offsets = flat(pa.array(["xx", "xab", ""]))
    assert scan(anywhere, data, cut(data, offsets, anywhere.safe, 512)).tolist() == [False, True]


@pytest.mark.parametrize("part", ["0", "AKIA", "token=", "token ", " ", "eyJ", "eyJa.", "-----BEGIN A ", "sk_live_", "0123456789abcdef token: "])
def test_long_runs_take_time_in_proportion(part):
    text = part * (1_000_000 // len(part))
    begun = time.time()
    found = secrets.find(pa.array([text]))[0]
    assert time.time() - begun < 20
    if part in ("0", "AKIA", "token="):
        assert [f for f in found if f[0] in PLAIN] == plain_spans(text)


def test_masking_goes_through_a_text_once():
    text = "token=abcdef1 " * 50_000
    begun = time.time()
    assert secrets.masked([text, None, ""], [*secrets.find(pa.array([text])), [], []]) == ["[SECRET] " * 50_000, None, ""]
    assert time.time() - begun < 20


# ---------------------------------------------------------------- pseudonyms

@pytest.mark.parametrize("part", [".c", "a@b", "4111 1111 1111 1111 ", "1.", "12-", "a.", "(555) ", "9"])
def test_long_texts_do_not_overflow_a_pattern(spark, part):
    text = ("a@b" if part == ".c" else "") + part * (1_000_000 // len(part) if part in (".c", "a.", "9") else 300)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pseudonyms.pseudonymized(docs, "key").first()
    assert len(got["text"]) > 0 and (part != ".c" or got["pii"][0]["kind"] == "email")


def test_pseudonyms_keep_format_link_and_can_be_undone(spark, odd_docs, no_docs):
    rows = [(1, "card 4111 1111 1111 1111, bad 4111111111111112, ssn 123-45-6789, not 000-12-3456"),
            (2, "2024-02-29 but 2023-02-29; 31.12.1999 12/31/1999 192.168.0.1 +1 (017) 555-7713"), (3, "4111111111111111"),
            (4, "4111111111111111 again"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = pseudonyms.pseudonymized(docs, "key")
    got = {r["doc_id"]: r for r in made.collect()}
    assert [p["kind"] for p in got[1]["pii"]] == ["card", "ssn"] and [p["kind"] for p in got[2]["pii"]] == ["date", "date", "date", "ip", "phone"]
    assert got[1]["text"].replace(" ", "")[4:20] == got[3]["text"] == got[4]["text"][:16] != "4111111111111111"
    assert "4111111111111112" in got[1]["text"] and "000-12-3456" in got[1]["text"] and "2023-02-29" in got[2]["text"]
    assert [re.sub("[0-9]", "9", got[i]["text"]) == re.sub("[0-9]", "9", t) for i, t in rows[:1]] == [True]
    back = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymized(made.select("doc_id", "text"), "key", undo=True).collect()}
    assert back == dict(rows)
    assert pseudonyms.pseudonymized(docs, "other").filter("doc_id = 3").first()["text"] != got[3]["text"]
    assert pseudonyms.pseudonym_report(odd_docs, "key").count() == 9 and pseudonyms.pseudonym_report(no_docs, "key").collect() == []
    with pytest.raises(ValueError):
        pseudonyms.pseudonymized(odd_docs, "key")          # it has a column pii


def test_cards_beside_other_digits_are_found(spark):
    card, other = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [f"{card} 12/26", f"qty 2 {card}", f"{card} {card}", f"{card}-{other} 7", f"10.0.0.1 {card}", f"a {card}  55 b",
             "4111111111111111 4111-1111-1111-1111 99 99", "1234 5678 9012 3456 78 90", "7 " * 300 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = pseudonyms.pseudonymized(docs, "key")
    got = {r["doc_id"]: r for r in made.collect()}
    assert [sum(p["kind"] == "card" for p in got[i]["pii"]) for i in range(7)] == [1, 1, 2, 2, 1, 1, 2]
    name = [p["pseudonym"] for p in got[0]["pii"]][0]
    assert got[0]["text"] == f"{name} 12/26" and got[1]["text"] == f"qty 2 {name}" and got[2]["text"] == f"{name} {name}"
    assert got[3]["text"].startswith(f"{name}-") and got[3]["text"].endswith(" 7") and got[5]["text"] == f"a {name}  55 b"
    assert name != card and not any(card in got[i]["text"] or other in got[i]["text"] for i in range(7))
    assert all(re.sub("[0-9]", "9", got[i]["text"]) == re.sub("[0-9]", "9", t) for i, t in enumerate(texts) if i != 4)
    back = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymized(made.select("doc_id", "text"), "key", undo=True).collect()}
    assert all(back[i] == texts[i] for i in range(7))


def test_feistel_permutes_a_small_domain(spark):
    pairs = spark.range(35).select((F.col("id") / 7).cast("int").alias("l"), (F.col("id") % 7).alias("r"))
    moved = pairs.select(pseudonyms.feistel(F.col("l"), F.col("r"), F.lit(5), F.lit(7), "k", F.lit("t")).alias("s")).distinct()
    assert moved.count() == 35 and moved.filter("s.l >= 0 AND s.l < 5 AND s.r >= 0 AND s.r < 7").count() == 35


# ---------------------------------------------------------------- chat

def test_template_is_reversible():
    draw = random.Random(3)
    parts = [*chat.CONTROLS, "<", "\\", "|", "[", "a", "\n", "%", "%0A", "\\\\", "im_start|>", "/s>", "user"]
    for _ in range(1500):
        turns = [("".join(draw.choices(parts, k=draw.randint(0, 4))), "".join(draw.choices(parts, k=draw.randint(0, 9))))
                 for _ in range(draw.randint(0, 4))]
        text, mask = chat.write(turns)
        assert chat.read(text) == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")


def test_layouts_are_recognized_by_fingerprint(spark):
    rows = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
            '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","response":"a"}',
            '{"instruction":"q","input":null,"output":"a"}', '{"question":"q","answer":"a"}', '{"other":1}', "[1]", "no json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "layout_no long, record string")
    got = {r["layout_no"]: r for r in chat.with_turns(df).collect()}
    for i in range(5):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [("user", "q"), ("assistant", "a")], i
    assert got[5]["layout"] and got[5]["turns"] is None
    assert all(got[i]["layout"] is None and got[i]["turns"] is None for i in (6, 7, 8))
    assert chat.fingerprint(["a", "b"]) == chat.fingerprint(["b", "a"]) != chat.fingerprint(["a.b"])


def test_chat_report_on_odd_turns(spark):
    rows = [(1, 0, None, "x"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, 0, "user", ""), (None, 3, "assistant", "z"), (2, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.chat_report(df).collect()}
    assert got == {1: (3, 1), 2: (2, 0), None: (1, 1)}
    assert chat.chat_report(df.limit(0)).collect() == []


# ---------------------------------------------------------------- registered queries with SQL twins

@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.sql(SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    order = [c for c in want.columns if c.endswith("_id") and not c.startswith("parent")] + [c for c in want.columns if c == "depth"]
    want, got = (d.sort_values(order).reset_index(drop=True) for d in (want, got))
    assert len(want) == len(got)
    for c in want.columns:
        assert (np.allclose(want[c], got[c]) if want[c].dtype.kind == "f" else want[c].astype(object).where(want[c].notna(), None).tolist() == got[c].astype(object).where(got[c].notna(), None).tolist()), c


def test_remainder_of_null_id(spark):
    assert spark.createDataFrame([(None,), (5,)], "doc_id long").select(remainder("doc_id", 3).alias("r")).count() == 2
