"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a word embedding (by hash) and the mean embedding of its character trigrams (by hash). Overlapping
windows of ``window`` words, half a window apart, cover the whole text; two gated recurrent networks read each window in
both directions, attention pools their states, and the windows' scores are joined by log-sum-exp, so one bad window is
enough. Windows run side by side in batches.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from panelkit.llm.common import map_texts


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample (rows of each label, and the pieces of ``piece`` letters, spread over the whole text, by
    which a text longer than all of them teaches) and the shape of the network."""

    toxic: int = 900
    clean: int = 1800
    pieces: int = 20
    piece: int = 400
    window: int = 32
    hidden: int = 8
    words: int = 1 << 14
    trigrams: int = 1 << 13
    width: int = 8
    epochs: int = 5
    #: steps at least, so that a small sample is gone through more often
    steps: int = 600
    batch: int = 12
    #: share of the different words whose own embedding is left out of a training step, so that their letters must tell
    dropped: float = 0.4
    rate: float = 0.01
    seed: int = 5


@dataclass
class Network:
    """Embeddings, and for both directions the input weights (of the two inputs side by side), the recurrent weights (update,
    reset, candidate) and the bias; then attention and the last layer."""

    settings: Settings
    values: dict[str, np.ndarray] = field(default_factory=dict)


def fresh(settings: Settings) -> Network:
    rng = np.random.default_rng(settings.seed)
    h, e = settings.hidden, settings.width
    normal = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
    return Network(settings, {
        "word": normal(0.1, settings.words, e), "trigram": normal(0.3, settings.trigrams, e),
        "input": normal(1 / np.sqrt(2 * e), 2 * e, 6 * h), "bias": np.zeros(6 * h, np.float32),
        "back": normal(1 / np.sqrt(h), 2, h, 3 * h), "attend": normal(0.5, 2, h),
        "last": normal(1 / np.sqrt(2 * h), 2, h), "final": np.full(1, -3.0, np.float32)})


class Numbers(dict):
    """A number for each new key, in order of arrival."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def split(texts: Sequence[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words, and for all texts one after another the numbers of their words and the texts' borders."""
    numbers = Numbers()
    found = [list(map(numbers.__getitem__, (t or "").lower().split())) for t in texts]
    borders = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    flat = np.fromiter((n for f in found for n in f), np.int64, int(borders[-1]))
    return [w.encode("utf-8", "surrogatepass") for w in numbers], flat, borders


def features(words: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the word table, rows of the trigram table for all words one after another, and where each word's begin."""
    rows = np.array([xxhash.xxh32_intdigest(w) % settings.words for w in words], np.int64)
    joined = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]).astype(np.int64)
    codes = joined[:-2] * np.uint32(0x9E3779B1) ^ joined[1:-1] * np.uint32(0x85EBCA6B) ^ joined[2:] * np.uint32(0xC2B2AE35)
    codes = (codes ^ codes >> np.uint32(15)) % np.uint32(settings.trigrams)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    inside = np.repeat(begin - starts, sizes) + np.arange(int(sizes.sum()))
    return rows, codes[inside].astype(np.int64), starts


def inputs(net: Network, words: list[bytes]) -> tuple[np.ndarray, tuple]:
    """Each word's input to both directions' gates; the last row, all bias, stands for the place behind a text's end."""
    v, s = net.values, net.settings
    rows, codes, starts = features(words, s)
    count = np.diff(np.append(starts, len(codes)))[:, None].astype(np.float32)
    x = np.concatenate([v["word"][rows], np.add.reduceat(v["trigram"][codes], starts) / count], axis=1)
    x = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
    return x @ v["input"] + v["bias"], (rows, codes, starts, count, x)


def windows(flat: np.ndarray, borders: np.ndarray, size: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (columns) of ``size`` words, half of it apart, to the end of each text, and the text of each; a text without
    words has none."""
    sizes = np.diff(borders)
    step = size // 2
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - step) // step)), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
    at = place[None] + np.arange(size)[:, None]
    inside = at < sizes[owner][None]
    at = np.minimum(at + borders[:-1][owner][None], max(len(flat) - 1, 0))
    return np.where(inside, flat[at] if len(flat) else pad, pad), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(net: Network, gate: np.ndarray, at: np.ndarray, keep: bool = False):
    """Scores (log odds) of windows; with ``keep`` all that the way back needs."""
    v, h = net.values, net.settings.hidden
    size, n = at.shape
    ahead, behind = np.ascontiguousarray(gate[:, :3 * h]), np.ascontiguousarray(gate[:, 3 * h:])
    state = np.zeros((2, n, h), np.float32)
    states = np.empty((size, 2, n, h), np.float32)       # by place in the window, for both directions
    kept = []
    given = np.empty((2, n, 3 * h), np.float32)
    for t in range(size):
        ahead.take(at[t], axis=0, out=given[0], mode="clip")
        behind.take(at[size - 1 - t], axis=0, out=given[1], mode="clip")
        own = np.matmul(state, v["back"])
        open_ = _sigmoid(given[..., :2 * h] + own[..., :2 * h])
        update, reset = open_[..., :h], open_[..., h:]
        new = 2 * _sigmoid(2 * (given[..., 2 * h:] + reset * own[..., 2 * h:])) - 1
        if keep:
            kept.append((state, update, reset, new, own[..., 2 * h:]))
        state = new + update * (state - new)
        states[t, 0], states[size - 1 - t, 1] = state[0], state[1]
    energy = np.einsum("tdnh,dh->tn", states, v["attend"])
    energy[at == len(gate) - 1] = -1e9
    energy -= energy.max(axis=0)
    weight = np.exp(energy)
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tdnh->dnh", weight, states)
    score = np.einsum("dnh,dh->n", pooled, v["last"]) + v["final"]
    return (score, kept, states, weight, pooled) if keep else score


def backward(net: Network, at: np.ndarray, words: int, d_score: np.ndarray, run: tuple) -> tuple[dict, np.ndarray]:
    """Gradients of the recurrent part, and of each word's gate input."""
    v, h = net.values, net.settings.hidden
    _, kept, states, weight, pooled = run
    size, n = at.shape
    grad = {"last": np.einsum("dnh,n->dh", pooled, d_score), "final": d_score.sum(keepdims=True)}
    d_pooled = d_score[None, :, None] * v["last"][:, None]
    d_weight = np.einsum("dnh,tdnh->tn", d_pooled, states)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["attend"] = np.einsum("tn,tdnh->dh", d_energy, states)
    d_states = weight[:, None, :, None] * d_pooled[None] + d_energy[:, None, :, None] * v["attend"][None, :, None]
    d_gate = np.zeros((words, 6 * h), np.float32)
    grad["back"] = np.zeros_like(v["back"])
    d_state = np.zeros((2, n, h), np.float32)
    d_given = np.empty((2, n, 3 * h), np.float32)
    all_given = np.empty((size, n, 6 * h), np.float32)
    for t in reversed(range(size)):
        before, update, reset, new, own = kept[t]
        d_state[0] += d_states[t, 0]
        d_state[1] += d_states[size - 1 - t, 1]
        d_new = d_state * (1 - update) * (1 - new * new)
        d_given[..., 2 * h:] = d_new
        d_given[..., :h] = d_state * (before - new) * update * (1 - update)
        d_given[..., h:2 * h] = d_new * own * reset * (1 - reset)
        d_own = d_given.copy()
        d_own[..., 2 * h:] *= reset
        grad["back"] += np.matmul(before.transpose(0, 2, 1), d_own)
        d_state = d_state * update + np.matmul(d_own, v["back"].transpose(0, 2, 1))
        all_given[t, :, :3 * h] = d_given[0]
        all_given[size - 1 - t, :, 3 * h:] = d_given[1]
    places = at.ravel()
    order = np.argsort(places, kind="stable")
    names, first = np.unique(places[order], return_index=True)
    d_gate[names] = np.add.reduceat(all_given.reshape(-1, 6 * h)[order], first)
    return grad, d_gate


def fit(texts: Sequence[str], toxic: Sequence[int], settings: Settings = Settings()) -> Network | None:
    """Train on whole texts; without texts of both kinds there is nothing to learn. The same rows in the same order give the
    same network."""
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net = fresh(settings)
    moved = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.values.items()}
    rng = np.random.default_rng(settings.seed + 1)
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean()).astype(np.float32)
    turn = 0
    epochs = max(settings.epochs, -(-settings.steps * settings.batch // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), settings.batch):
            pick = order[first:first + settings.batch]
            words, flat, borders = split([texts[i] for i in pick])
            at, owner = windows(flat, borders, settings.window, len(words))
            if not len(owner):
                continue
            gate, (rows, codes, starts, count, x) = inputs(net, words)
            left_out = np.flatnonzero(rng.random(len(words)) < settings.dropped)
            x[left_out, :settings.width] = 0
            gate[left_out] = x[left_out] @ net.values["input"] + net.values["bias"]
            run = forward(net, gate, at, keep=True)
            text_score = joined(run[0], owner, len(pick))
            error = (1 / (1 + np.exp(-text_score.clip(-30, 30))) - y[pick]) * weight[pick] / len(pick)
            share = np.exp(run[0] - text_score[owner])
            d_score = (error[owner] * share).astype(np.float32)
            grad, d_gate = backward(net, at, len(words) + 1, d_score, run)
            grad["input"], grad["bias"] = x.T @ d_gate, d_gate.sum(axis=0)
            d_x = (d_gate @ net.values["input"].T)[:-1]
            d_x[left_out, :settings.width] = 0
            e = settings.width
            turn += 1
            rate = settings.rate * (1 - 0.8 * epoch / epochs)
            _sparse_step(net.values["word"], moved["word"], rows, d_x[:, :e], rate, turn)
            spread = np.repeat(d_x[:, e:] / count, count[:, 0].astype(np.int64), axis=0)
            _sparse_step(net.values["trigram"], moved["trigram"], codes, spread, rate, turn)
            for k, g in grad.items():
                _step(net.values[k], *moved[k], g, rate, turn)
    return net


def _step(value, m, s, g, rate, turn):
    m += 0.1 * (g - m)
    s += 0.001 * (g * g - s)
    value -= (rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.999 ** turn)) + 1e-8)).astype(np.float32)


def _sparse_step(value, moved, rows, g, rate, turn):
    """A step of the rows that occur."""
    names, back = np.unique(rows, return_inverse=True)
    total = np.zeros((len(names), g.shape[1]), np.float32)
    np.add.at(total, back.reshape(-1), g)
    m, s = moved[0][names], moved[1][names]
    part = value[names]
    _step(part, m, s, total, rate, turn)
    value[names], moved[0][names], moved[1][names] = part, m, s


def joined(score: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Log-sum-exp of each text's windows; minus infinity for a text without any."""
    top = np.full(texts, -np.inf, np.float64)
    np.maximum.at(top, owner, score)
    total = np.zeros(texts)
    np.add.at(total, owner, np.exp(score - top[owner]))
    with np.errstate(divide="ignore"):
        return np.where(total > 0, top + np.log(total), -np.inf)


def score_texts(net: Network, texts: Sequence[str | None]) -> np.ndarray:
    """The chance that each text is toxic; 0 for a text without words."""
    words, flat, borders = split(texts)
    if not words:
        return np.zeros(len(texts))
    gate, _ = inputs(net, words)
    at, owner = windows(flat, borders, net.settings.window, len(words))
    scores = np.concatenate([forward(net, gate, at[:, i:i + 2048]) for i in range(0, at.shape[1], 2048)])
    text_score = joined(scores, owner, len(texts))
    return 1 / (1 + np.exp(-np.clip(text_score, -700, 700))) * (text_score > -np.inf)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Fit on a bounded sample: for either label the rows of ``labels (doc_id, toxic)`` with the smallest hashes. A text of more
    than ``pieces`` times ``piece`` letters teaches by pieces at even distances from its beginning to its end. Of several labels
    of one document the worst counts; of several texts of one document one teaches, any of them."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    wanted = {0: settings.clean, 1: settings.toxic}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, 1.6 * wanted[1] / counts.get(1, 1))).otherwise(min(1.0, 1.6 * wanted[0] / counts.get(0, 1)))
    # about 1.6 times as many rows as wanted: a bounded table
    some = known.filter(draw < share).withColumn("draw", draw)
    many, size = settings.pieces, settings.piece
    step = (F.length("text") - size) / max(1, many - 1)
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.substring(
        F.col("text"), (i * step).cast("int") + 1, F.lit(size))), " ")
    teaching = F.when(F.length("text") > many * size, spread).otherwise(F.col("text")).alias("text")
    drawn = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(some), "doc_id")
    rows = drawn.select("doc_id", "draw", "toxic", teaching).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (r["draw"], r["doc_id"], r["text"]))
    kept = [r for label in (0, 1) for r in [x for x in rows if x["toxic"] == label][:wanted[label]]]
    return fit([r["text"] for r in kept], [r["toxic"] for r in kept], settings)


def with_toxicity(docs: DataFrame, net: Network | None, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` beside ``score`` and ``predicted`` (1 from 0.5 on) for whole texts.

    Null, empty and blank texts have score 0, as has every text if ``net`` is None. Repeated rows are scored alike.
    """
    if net is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # as large as the settings make it

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        score = score_texts(shared.value, batch.column(text).to_pylist())
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return map_texts(docs, text, list(keep), "score double, predicted int", work)
