"""Quality: positive-unlabelled learning with the non-negative risk, trained in numpy.

Trusted positives are the texts labelled good; the other side is unlabelled text, a mixture of good and bad. With p the share
of good text in it, the risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): unlabelled text counts as bad, less
what the positives say of the good part, and where that difference would fall below zero (the network has begun to learn the
sample by heart) the step goes back up. Labels of bad texts are not used. The share p is estimated from the same two samples:
U(A) >= p P(A) for every region A, so it is at most the least ratio over the regions above a threshold of a first network.

A text is one row of shape measures and hashed byte trigrams, over the whole text, so texts of any length fit one network.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelkit.llm.common import flat, map_texts

SHAPES = 16


@dataclass(frozen=True)
class Settings:
    """Bounds of the two training samples (rows) and the shape of the network."""

    positive: int = 3000
    unlabelled: int = 5000
    buckets: int = 1 << 11
    hidden: int = 12
    epochs: int = 30
    #: steps at least, so that small samples are gone through more often
    steps: int = 1000
    #: how much all trigrams together weigh beside the measures
    trigrams: float = 0.1
    batch: int = 250
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Network:
    settings: Settings
    prior: float
    centre: np.ndarray
    scale: np.ndarray
    values: dict[str, np.ndarray]


LOWER, UPPER, DIGIT, SPACE, LINE, MARK, HIGH = range(7)
KIND = np.full(256, MARK, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = LOWER, UPPER, DIGIT, HIGH
KIND[[9, 11, 12, 13, 32]], KIND[10] = SPACE, LINE


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the words (runs without white space) of all texts: the text, the first byte, the size and a 64-bit hash."""
    kind = KIND[data]
    inside = (kind != SPACE) & (kind != LINE)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    place = np.flatnonzero(inside)
    first = np.searchsorted(place, start)
    size = np.diff(np.append(first, len(place)))
    turn = np.arange(len(place)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        mixed = (data[place].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= (turn.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        code = np.add.reduceat(mixed, first)
    return np.searchsorted(offsets, start, "right") - 1, start, size, code


def features(texts: pa.Array, buckets: int) -> np.ndarray:
    """One row a text: ``SHAPES`` measures, then the roots of the shares of its byte trigrams by hash."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    out = np.zeros((n, SHAPES + buckets), np.float32)
    if not len(data):
        return out
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * 7 + KIND[data], minlength=7 * n).reshape(n, 7).astype(np.float64)
    total = np.maximum(sizes, 1)
    letters = np.maximum(kinds[:, LOWER] + kinds[:, UPPER], 1)
    text, start, size, code = words_of(data, offsets)
    many = np.maximum(np.bincount(text, minlength=n), 1).astype(np.float64)
    pair = np.lexsort((code, text))
    new = np.append(True, (text[pair][1:] != text[pair][:-1]) | (code[pair][1:] != code[pair][:-1])) if len(pair) else np.zeros(0, bool)
    different = np.bincount(text[pair][new], minlength=n) if len(pair) else np.zeros(n)
    top = np.zeros(n)
    if len(pair):
        np.maximum.at(top, text[pair][new], np.diff(np.append(np.flatnonzero(new), len(pair))))
    same = (text[1:] == text[:-1]) & (code[1:] == code[:-1])
    repeated = np.bincount(text[1:][same], minlength=n)
    last = KIND[data[start + size - 1]] if len(start) else np.zeros(0, np.uint8)
    plain = np.isin(data[start + size - 1], np.frombuffer(b".,;:?", np.uint8)) if len(start) else np.zeros(0, bool)
    odd_end = np.bincount(text[(last == MARK) & ~plain], minlength=n)
    lone = np.bincount(text[(size == 1) & (last == MARK)], minlength=n)
    letter_count = np.bincount(text, minlength=n)
    mean = np.bincount(text, size, minlength=n) / many
    spread = np.sqrt(np.maximum(np.bincount(text, size.astype(np.float64) ** 2, minlength=n) / many - mean ** 2, 0))
    shapes = [kinds[:, UPPER] / letters, kinds[:, DIGIT] / total, kinds[:, SPACE] / total, kinds[:, LINE] / total, kinds[:, MARK] / total,
              kinds[:, HIGH] / total, np.log1p(mean), np.log1p(spread), repeated / many, different / many, top / many, odd_end / many,
              lone / many, np.log1p(letter_count) / 10, np.log1p(different) / 10, letter_count == 0]
    out[:, :SHAPES] = np.stack(shapes, axis=1)
    if len(data) > 2:
        d = data.astype(np.uint32)
        codes = d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA6B) ^ d[2:] * np.uint32(0xC2B2AE35)
        codes = (codes ^ codes >> np.uint32(15)) % np.uint32(buckets)
        whole = owner[:-2] == owner[2:]
        found = np.bincount(owner[:-2][whole] * buckets + codes[whole], minlength=n * buckets).reshape(n, buckets)
        out[:, SHAPES:] = np.sqrt(found / np.maximum(sizes - 2, 1)[:, None])
    return out


# ---------------------------------------------------------------- the network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fresh(width: int, settings: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(settings.seed)
    values = {"in": rng.normal(size=(width, settings.hidden)) / np.sqrt(width), "bias": np.zeros(settings.hidden),
              "out": rng.normal(size=settings.hidden) / np.sqrt(settings.hidden), "last": np.zeros(1)}
    return {k: x.astype(np.float32) for k, x in values.items()}


def odds(values: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of scaled rows, and the hidden layer."""
    hidden = np.tanh(x @ values["in"] + values["bias"])
    return hidden @ values["out"] + values["last"][0], hidden


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the logistic loss, of log odds: p R+(positives), and R-(unlabelled) - p R-(positives)."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)


def slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """How the non-negative risk, or where its second part is negative minus that part, changes with each log odds."""
    wrong_up, wrong_down = (_sigmoid(positive) - 1) / len(positive), _sigmoid(positive) / len(positive)
    spread = _sigmoid(unlabelled) / len(unlabelled)
    if risk(positive, unlabelled, prior)[1] >= 0:
        return prior * (wrong_up - wrong_down), spread
    return prior * wrong_down, -spread


def plain_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for telling the two samples apart, both with half the weight."""
    return (_sigmoid(positive) - 1) / len(positive) / 2, _sigmoid(unlabelled) / len(unlabelled) / 2


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, settings: Settings, slope=slopes) -> dict[str, np.ndarray]:
    """Adam steps over batches in which the two samples have their shares; the same rows give the same network."""
    values = _fresh(positive.shape[1], settings)
    moved = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in values.items()}
    rng = np.random.default_rng(settings.seed + 1)
    turn = 0
    batches = max(1, -(-(len(positive) + len(unlabelled)) // settings.batch))
    epochs = max(settings.epochs, -(-settings.steps // batches))
    for epoch in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)):
            if not len(p) or not len(u):
                continue
            x = np.vstack([positive[p], unlabelled[u]])
            z, hidden = odds(values, x)
            d = np.concatenate(slope(z[:len(p)], z[len(p):], prior)).astype(np.float32)
            back = (d[:, None] * values["out"]) * (1 - hidden * hidden)
            grads = {"in": x.T @ back + settings.decay * values["in"], "bias": back.sum(axis=0), "out": hidden.T @ d + settings.decay * values["out"], "last": d.sum(keepdims=True)}
            turn += 1
            rate = settings.rate * (1 - 0.9 * epoch / epochs)
            for k, g in grads.items():
                m, s = moved[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                values[k] -= (rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.999 ** turn)) + 1e-8)).astype(np.float32)
    return values


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, settings: Settings) -> float:
    """The share of positives among the unlabelled: the least ratio U(A) / P(A) over the regions A above the thresholds
    that keep from half to all positives. A network trained on one half of both samples sets the
    regions of the other half; the two halves' ratios are averaged."""
    found = []
    for side in (0, 1):
        values = train(positive[side::2], unlabelled[side::2], 0.5, settings, plain_slopes)
        p, u = odds(values, positive[1 - side::2])[0], odds(values, unlabelled[1 - side::2])[0]
        if not len(p) or not len(u):
            continue
        found.append(min((u >= t).mean() / (p >= t).mean() for t in np.quantile(p, np.linspace(0, 0.5, 51))))
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, settings: Settings = Settings()) -> Network | None:
    """From the ``features`` of both samples; without positives or without unlabelled texts there is nothing to learn."""
    if not len(positive) or not len(unlabelled):
        return None
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    scale[SHAPES:] *= np.sqrt(settings.buckets / SHAPES) / settings.trigrams
    p, u = ((x - centre) / scale for x in (positive, unlabelled))
    prior = estimated_prior(p, u, settings)
    return Network(settings, prior, centre, scale, train(p, u, prior, settings))


def scores(net: Network, rows: np.ndarray) -> np.ndarray:
    """The chance that each text is good; 0 for a text without words."""
    z, _ = odds(net.values, (rows - net.centre) / net.scale)
    return np.where(rows[:, SHAPES - 1] > 0, 0.0, _sigmoid(z)) * (rows[:, :SHAPES].any(axis=1))


# ---------------------------------------------------------------- over tables

def _drawn(rows: DataFrame, wanted: int) -> DataFrame:
    """About 1.6 times ``wanted`` of the ids with a text, one row each, by a hash of the id: a bounded table."""
    many = rows.agg(F.approx_count_distinct("doc_id").alias("n")).first()["n"]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(97)), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("draw", draw).filter(F.col("draw") < min(1.0, 1.6 * wanted / max(many, 1))).dropDuplicates(["doc_id"])


def _sample(rows: DataFrame, wanted: int, settings: Settings) -> np.ndarray:
    """``features`` of ``wanted`` of the ``rows (doc_id, text)``, whole texts; only the features reach the driver."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        made = features(batch.column("text"), settings.buckets)
        return {"row": pa.array([x.tobytes() for x in made], pa.binary())}

    found = map_texts(_drawn(rows, wanted), "text", ["doc_id", "draw"], "row binary", work).collect()
    found.sort(key=lambda r: (r["draw"], r["doc_id"]))
    return np.frombuffer(b"".join(bytes(r["row"]) for r in found[:wanted]), np.float32).reshape(-1, SHAPES + settings.buckets)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Fit on bounded samples: texts whose ``labels (doc_id, quality)`` say 1 and never 0, and texts of all ``docs`` alike.

    Rows without an id or a text teach nothing; of rows with one id one teaches, any of them.
    """
    known = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    trusted = known.join(good.filter("least = 1 AND most = 1").select("doc_id"), "doc_id", "left_semi")
    return fit(_sample(trusted, settings.positive, settings), _sample(known, settings.unlabelled, settings), settings)


def with_quality(docs: DataFrame, net: Network | None, keep: Sequence[str], text: str = "text", least: float = 0.7) -> DataFrame:
    """``keep`` beside ``score`` (the chance that the whole text is good) and ``predicted``, 1 from ``least`` on.

    Null, empty and blank texts have score 0, as has every text if ``net`` is None. Repeated rows are scored alike.
    """
    if net is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # as large as the settings make it

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        column = batch.column(text)
        score = np.concatenate([scores(shared.value, features(column.slice(i, 512), shared.value.settings.buckets)) for i in range(0, len(column), 512)])
        return {"score": score, "predicted": (score >= least).astype(np.int32)}

    return map_texts(docs, text, list(keep), "score double, predicted int", work)
