"""Prediction by partial matching with one trie in memory, node by node: what the branches must add up to."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelkit.llm.ppm import ORDER, SYMBOLS, gram_counts, stream
from panelkit.session import settle


@dataclass(frozen=True)
class Trie:
    """``child[node, older]`` is the node with one more byte in front (-1: none), ``log10[node, symbol]`` the chance of a symbol
    behind a node; ``older`` and ``symbol`` number the bytes, the last column of ``log10`` is any symbol never seen."""

    order: int
    older: np.ndarray
    symbol: np.ndarray
    child: np.ndarray
    log10: np.ndarray


def trie(length: np.ndarray, context: np.ndarray, symbols: list[np.ndarray], counts: list[np.ndarray], order: int) -> Trie:
    """From the contexts' lengths and bytes (as numbers), and the symbols seen behind each with their counts; the context of
    length 0 is among them if anything was counted."""
    rank = np.lexsort((context, length))
    length, context = length[rank], context[rank]
    used = np.sort(symbols[rank[0]]) if len(rank) else np.zeros(0, np.int64)
    symbol = np.full(256, len(used), np.int32)
    symbol[used] = np.arange(len(used))
    front = np.where(length > 0, context >> 8 * np.maximum(length - 1, 0) & 0xFF, 0)
    first = np.unique(front[length > 0])
    older = np.full(256, len(first), np.int32)
    older[first] = np.arange(len(first))
    unseen = SYMBOLS - len(used)
    number = {pair: i for i, pair in enumerate(zip(length.tolist(), context.tolist()))}
    chance = np.zeros((max(len(rank), 1), len(used) + 1))
    child = np.full((max(len(rank), 1), len(first) + 1), -1, np.int32)
    chance[0, -1] = 1 / SYMBOLS
    for i, ((size, c), r) in enumerate(zip(number, rank.tolist())):
        at, count = symbol[symbols[r]], counts[r].astype(np.float64)
        total = count.sum() + len(count)
        if size:
            below = number[size - 1, c & ((1 << 8 * (size - 1)) - 1)]
            child[below, older[front[i]]] = i
            rest = chance[below].copy()
            rest[at] = 0
            mass = rest[:-1].sum() + rest[-1] * unseen
        else:
            rest = np.append(np.zeros(len(used)), 1.0)
            mass = float(unseen)
        chance[i] = rest * (len(count) / total / mass) if mass > 0 else 0
        chance[i, at] = count / (total if mass > 0 else count.sum())
    return Trie(order, older, symbol, child, np.log10(np.maximum(chance, 1e-300)).astype(np.float32))


def learn(df: DataFrame, text: str = "text", order: int = ORDER, keep: int = 200_000) -> Trie:
    """Count all texts of ``df`` and build the trie of the contexts with at least 1/``keep`` of all places; an empty table
    gives a trie that finds all symbols equally likely."""
    counted = settle(gram_counts(df, text, order))
    places = counted.agg(F.sum("n")).first()[0] or 0
    context, sym = F.shiftright("gram", 8), F.col("gram").bitwiseAND(F.lit(255).cast("long")).cast("int")
    lengths = F.explode(F.array(*[F.struct(F.lit(k).alias("length"), context.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")).alias("context"))
                                  for k in range(order + 1)]))
    each = counted.select(lengths.alias("c"), sym.alias("symbol"), "n").groupBy("c.length", "c.context", "symbol").agg(F.sum("n").alias("n"))
    kept = (each.groupBy("length", "context").agg(F.sum("n").alias("places"), F.collect_list("symbol").alias("symbols"), F.collect_list("n").alias("counts"))
            .filter((F.col("length") == 0) | (F.col("places") >= places / keep)))
    rows = kept.select("length", "context", "symbols", "counts").toArrow()  # at most ``keep`` contexts of a length
    arrays = [c.combine_chunks() for c in rows.columns]
    parts = [np.split(a.flatten().to_numpy(), np.asarray(a.offsets)[1:-1] - a.offsets[0].as_py()) if len(a) else [] for a in arrays[2:]]
    return trie(arrays[0].to_numpy().astype(np.int64), arrays[1].to_numpy(), *parts, order)


def log_chance(model: Trie, texts: pa.Array) -> np.ndarray:
    """log10 of each whole text's chance, its end included; a null text is empty."""
    if not len(texts):
        return np.zeros(0)
    out, place, begin = stream(texts, model.order)
    older = model.older[out]
    wide, tall = model.child.shape[1], model.log10.shape[1]
    child, table = model.child.ravel(), model.log10.ravel()
    result = np.empty(len(place), np.float32)
    for first in range(0, len(place), 1 << 16):
        at = place[first:first + (1 << 16)]
        node = np.zeros(len(at), np.int32)
        live = np.ones(len(at), bool)
        for back in range(1, model.order + 1):
            longer = child.take(node * wide + older.take(at - back))
            live &= longer >= 0
            node = np.where(live, longer, node)
        result[first:first + (1 << 16)] = table.take(node * tall + model.symbol.take(out.take(at)))
    return np.add.reduceat(result.astype(np.float64), begin)
