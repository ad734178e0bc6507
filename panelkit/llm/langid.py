"""Language ID: a byte convolutional network trained in numpy, applied to batches of fixed-length windows.

Bytes are embedded; filters of several widths run over them; the maximum of each filter over a window feeds a softmax.
A text is cut into windows of ``window`` bytes that cover all of it; its language is the one with the largest sum of the
windows' log probabilities, each weighted by its length.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelkit.llm.common import flat, map_texts

UNKNOWN = "und"
#: The answer for windows of no language, where a network has learnt that class.
NO_LANGUAGE = ""
PAD = 256


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample (texts per language, windows per text, languages) and the shape of the network."""

    texts: int = 400
    windows: int = 4
    languages: int = 256
    window: int = 256
    #: windows of no language for each of a language; their class, ``NO_LANGUAGE``, is then among the answers
    background: float = 0.0
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 10
    embedding: int = 4
    epochs: int = 6
    #: steps at least, so that a small sample is gone through more often
    steps: int = 800
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass(frozen=True)
class Network:
    """``embed`` e x 257, ``conv`` filters x (widest * e) with zeros behind a narrow filter's end, and the last layer."""

    languages: tuple[str, ...]
    window: int
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    last: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray, size: int, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` bytes (and ``more`` behind them, for filters that begin at the last byte) that cover all texts;
    the text each belongs to, and its bytes. Positions behind a text's end hold ``PAD``; an empty text has no window."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), count)
    place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * size
    at = place[:, None] + np.arange(size + more)
    inside = at < lengths[owner][:, None]
    at += offsets[:-1][owner][:, None]
    np.minimum(at, max(len(data) - 1, 0), out=at)
    if not len(data):
        return np.zeros((0, size + more), np.int16), owner, owner
    rows = np.where(inside, data[at].astype(np.int16), np.int16(PAD))
    return rows, owner, np.minimum(size, lengths[owner] - place)


def _spread(embed: np.ndarray, rows: np.ndarray, wide: int) -> np.ndarray:
    """Column i holds the embedded bytes below the widest filter at place i of the windows, one behind the other."""
    flat_rows = np.append(rows.ravel(), np.full(wide - 1, PAD, rows.dtype))
    seen = embed.take(flat_rows, axis=1)
    return np.concatenate([seen[:, j:j + rows.size] for j in range(wide)])


def log_probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    filters, wide = len(net.conv), net.conv.shape[1] // len(net.embed)
    best = np.empty((filters, len(rows)), np.float32)
    for i in range(0, len(rows), 64):
        part = rows[i:i + 64]
        sums = net.conv @ _spread(net.embed, part, wide)
        best[:, i:i + 64] = sums.reshape(filters, len(part), -1)[:, :, :net.window].max(axis=2)
    scores = np.tanh(best.T + net.bias) @ net.dense + net.last
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def fit(texts: Sequence[bytes], labels: Sequence[str], settings: Settings = Settings()) -> Network | None:
    """Train on all windows of the texts. The same rows in the same order give the same network; without rows there is none."""
    if not len(texts):
        return None
    rng = np.random.default_rng(settings.seed)
    languages = tuple(sorted(set(labels)))
    wide, e = max(settings.widths), settings.embedding
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows, owner, _ = windows(joined, ends, settings.window, wide - 1)
    y = np.array([languages.index(lang) for lang in labels])[owner]
    if settings.background:
        rows, y, languages = _with_background(rows, y, languages, settings, rng)
    fan = np.repeat(settings.widths, settings.filters)
    shape = np.arange(wide * e) < fan[:, None] * e
    net = Network(languages, settings.window,
                  (rng.normal(size=(e, 257)) * 0.3).astype(np.float32),
                  (rng.normal(size=(len(fan), wide * e)) / np.sqrt(fan * e)[:, None] * shape).astype(np.float32),
                  np.zeros(len(fan), np.float32),
                  (rng.normal(size=(len(fan), len(languages))) / np.sqrt(len(fan))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    values = [net.embed, net.conv, net.bias, net.dense, net.last]
    moved = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    weight = (1 / np.bincount(y, minlength=len(languages)).clip(1))[y]
    weight *= len(y) / weight.sum()
    turn = 0
    epochs = max(settings.epochs, -(-settings.steps * settings.batch // len(rows)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), settings.batch):
            pick = order[first:first + settings.batch]
            spread = _spread(net.embed, rows[pick], wide)
            n, length = rows[pick].shape
            sums = (net.conv @ spread).reshape(len(fan), n, length)[:, :, :settings.window]
            at = sums.argmax(axis=2)                                      # filters x n
            hidden = np.tanh(np.take_along_axis(sums, at[:, :, None], 2)[:, :, 0].T + net.bias)
            scores = hidden @ net.dense + net.last
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = scores / scores.sum(axis=1, keepdims=True)
            error[np.arange(n), y[pick]] -= 1
            error *= (weight[pick] / n)[:, None]
            back = (error @ net.dense.T) * (1 - hidden ** 2)              # n x filters
            d_conv = np.einsum("nf,kfn->fk", back, spread[:, at + np.arange(n) * length]) * shape
            d_under = back.T[:, :, None] * net.conv[:, None]              # filters x n x (wide * e)
            d_embed = np.zeros((257, e), np.float32)
            under = rows[pick][np.arange(n)[:, None], at[:, :, None] + np.arange(wide)]
            np.add.at(d_embed, under.ravel(), d_under.reshape(-1, e))
            d_embed = d_embed.T
            turn += 1
            rate = settings.rate * (1 - 0.8 * epoch / epochs)
            for v, (m, s), g in zip(values, moved, (d_embed, d_conv, back.sum(0), hidden.T @ error, error.sum(0))):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.999 ** turn)) + 1e-8)).astype(np.float32)
    return net


def _with_background(rows: np.ndarray, y: np.ndarray, languages: tuple[str, ...], settings: Settings, rng) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """The windows and ``background`` times as many of no language: windows whose bytes, or only letters and bytes above 127, were
    exchanged for others, one exchange a window, so that scripts and letter sequences never seen have a class of their own."""
    letters = np.array([b for b in range(128, 256)] + [*range(97, 123), *range(65, 91)])
    made = rows[rng.choice(len(rows), int(np.ceil(settings.background * len(rows))))].copy()
    for i, row in enumerate(made):
        to = np.arange(PAD + 1)
        own = np.arange(256) if i % 2 else letters
        to[own] = rng.permutation(own)
        made[i] = to[row]
    return np.vstack([rows, made]), np.append(y, np.full(len(made), len(languages))), (*languages, NO_LANGUAGE)


def training_windows(df: DataFrame, text: str, label: str, settings: Settings, order: Column) -> DataFrame:
    """``(label, order, piece)``: up to ``texts`` texts of each label, picked by a hash of the row, and of each up to
    ``windows`` pieces spread over its whole length. Rows without label or text teach nothing."""
    known = df.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").alias("text"), order.alias("o"))
    known = known.filter(F.col("label").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("label").count().limit(settings.languages + 1).collect()
    if len(counts) > settings.languages:
        raise ValueError(f"more than {settings.languages} labels; Settings.languages bounds the network's last layer")
    if not counts:
        return known.select("label", "o", F.col("text").alias("piece")).limit(0)
    # a hash below this share of its range keeps about 1.5 times as many rows as wanted; the exact cut follows
    shares = F.create_map(*[x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, 1.5 * settings.texts / r["count"])))])
    draw = F.pmod(F.xxhash64("label", "o"), F.lit(1 << 30)) / float(1 << 30)
    some = known.filter(draw < shares[F.col("label")])
    step = F.greatest(F.lit(0.0), (F.length("text") - settings.window) / max(1, settings.windows - 1))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(settings.windows - 1)), lambda i: F.substring(
        F.col("text"), (i * step).cast("int") + 1, F.lit(settings.window))))
    # copies of a text teach once, so those of a hot one are one row
    return some.select("label", "o", draw.alias("d"), pieces.alias("pieces")).dropDuplicates(["label", "o"])


def learn(df: DataFrame, text: str = "text", label: str = "lang", settings: Settings = Settings()) -> Network | None:
    """Fit on a bounded sample of the labelled rows of ``df``; None where no row has a label and a text."""
    rows = training_windows(df, text, label, settings, F.xxhash64(F.col(f"`{text}`"))).collect()
    kept: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["label"], r["d"], r["o"])):
        kept.setdefault(row["label"], [])
        if len(kept[row["label"]]) < settings.texts:
            kept[row["label"]].append(row["pieces"])
    pairs = [(piece.encode(), lang) for lang, texts in kept.items() for pieces in texts for piece in pieces]
    return fit([p for p, _ in pairs], [lang for _, lang in pairs], settings)


def identify(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of the likeliest language and its probability; an empty text gets the first, and 0."""
    data, offsets = flat(texts)
    rows, owner, size = windows(data, offsets, net.window, net.conv.shape[1] // len(net.embed) - 1)
    total = np.zeros((len(texts), len(net.languages)))
    if len(rows):
        weighted = log_probabilities(net, rows).astype(np.float64) * size[:, None]
        np.add.at(total, owner, weighted)
    mean = total / np.maximum(np.diff(offsets), 1)[:, None]
    chance = np.exp(mean)
    chance /= chance.sum(axis=1, keepdims=True)
    best = chance.argmax(axis=1)
    return best, np.where(np.diff(offsets) > 0, chance[np.arange(len(best)), best], 0.0)


def with_language(df: DataFrame, net: Network | None, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` beside ``lang_pred`` and ``score`` for whole texts.

    A text that is null or has no letter is ``und`` with score 0, as is every text if ``net`` is None. Repeated rows get
    the same answer. Ties go to the first language in order.
    """
    letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return df.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = pa.array(net.languages)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        best, chance = identify(net, batch.column(text))
        known = pa.array(~np.asarray(batch.column("_letters").to_numpy(zero_copy_only=False), bool))
        lang = names.take(pa.array(best))
        return {"lang_pred": pa.compute.if_else(known, UNKNOWN, lang),
                "score": pa.compute.if_else(known, 0.0, pa.array(chance))}

    marked = df.select(*dict.fromkeys([*keep, text]), letters.alias("_letters"))
    out = map_texts(marked, text, [*keep, "_letters"], "lang_pred string, score double", work)
    return out.drop("_letters")
