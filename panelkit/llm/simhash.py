"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius through BK-trees.

Two fingerprints within radius 3 agree on two of five blocks of bits at least, so every pair of blocks is a shard key and a
pair of fingerprints meets in some shard. Each shard's fingerprints form BK-trees (children keyed by their Hamming distance
to the parent); a search follows only the edges within the radius of the distance at hand. A large shard is split into
several trees, and every tree is sent to all the search parts of its shard, so no task holds an unbounded one.
"""

from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from panelkit.llm.common import flat_bytes, map_texts, ship
from panelkit.llm.components import components, local_roots
from panelkit.session import settle

RADIUS = 3
SEED = 42
#: Bits of each of the radius + 2 blocks.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints in one tree, and pairs a search step holds.
TREE, PAIRS = 2048, 4_000_000


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words, A-Z lowered, joined by one space; of all words if there are fewer."""
    parts = text.lower().split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    line = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b - 1], SEED) for a, b in zip(starts, starts[words:])]


def fingerprint(hashes: Sequence[int]) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero. As a signed 64-bit number."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, keep: Sequence[str], text: str = "text", words: int = 3,
                     out: str = "fingerprint") -> DataFrame:
    """``keep`` beside the SimHash of the whole text; null and empty texts have fingerprint 0."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        column = batch.column(text).cast(pa.large_binary())
        return {out: np.array([fingerprint(shingle_hashes(t or b"", words)) for t in column.to_pylist()], np.int64)}

    return map_texts(df, text, list(keep), f"`{out}` long", work)


def shard_keys(c: Column) -> Column:
    """The ten keys of a fingerprint: which two blocks, and their bits."""
    begin = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    part = [F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in zip(begin, BLOCKS)]
    return F.array(*[F.shiftleft(F.shiftleft(F.lit(k).cast("long"), 13).bitwiseOR(part[i]), 13).bitwiseOR(part[j])
                     for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


class Forest:
    """BK-trees of several groups at once, as arrays: node ``k`` holds row ``k`` of ``values`` (64-bit words); ``edges`` are
    the sorted numbers ``parent * span + distance`` and ``children`` the node at the end of each."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """``group`` numbers the trees from 0 without gaps."""
        self.values = values
        self.span = 64 * values.shape[1] + 1
        self.root = np.full(int(group.max()) + 1 if len(group) else 0, -1)
        edges, children = [], []
        left, slot = np.arange(len(values)), group
        top = True
        while len(left):
            names, first, back = np.unique(slot, return_index=True, return_inverse=True)
            nodes = left[first]
            if top:
                self.root[names] = nodes
            else:
                edges.append(names)
                children.append(nodes)
            parent = nodes[back.reshape(-1)]
            rest = parent != left
            left, parent = left[rest], parent[rest]
            slot = parent * self.span + distance(values[left], values[parent])
            top = False
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def within(self, values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``values``, node) at most ``radius`` apart, each value searched in the tree of its group."""
        ask, node = np.arange(len(values)), self.root[group]
        ask, node = ask[node >= 0], node[node >= 0]
        found = [(ask[:0], node[:0])]
        while len(ask):
            apart = distance(values[ask], self.values[node])
            near = apart <= radius
            found.append((ask[near], node[near]))
            low = np.searchsorted(self.edges, node * self.span + np.maximum(apart - radius, 0), "left")
            high = np.searchsorted(self.edges, node * self.span + np.minimum(apart + radius, self.span - 1), "right")
            count = high - low
            ask = np.repeat(ask, count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node = self.children[np.repeat(low, count) + step]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _shard_links(shard: np.ndarray, node: np.ndarray, value: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within sorted shards; role bit 1: a member of the tree, bit 2: searched. Each node of a group of linked ones comes
    out once, linked to the group's first, so copies of any number give as many links as there are nodes."""
    group = np.cumsum(np.concatenate([[0], (shard[1:] != shard[:-1]).astype(np.int64)]))
    live = np.bincount(group)[group] > 1
    node, value, group, role = node[live], value[live], group[live], role[live]
    if not len(node):
        return node, node
    group = np.unique(group, return_inverse=True)[1].reshape(-1)
    tree, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    forest = Forest(value[tree], group[tree])
    load = np.cumsum(np.bincount(group[tree], minlength=group.max() + 1)[group[asked]])
    own = np.arange(len(node))
    root, first = own, 0
    while first < len(asked):
        before = load[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(load, before + PAIRS // value.shape[1], "right")))
        part = asked[first:last]
        i, j = forest.within(value[part], group[part], radius)
        moved = np.flatnonzero(root != own)  # what earlier searches have linked
        root = local_roots(len(node), np.concatenate([moved, part[i]]), np.concatenate([root[moved], tree[j]]))
        first = last
    moved = np.flatnonzero(node != node[root])
    return node[moved], node[root[moved]]


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """``(a, b)`` from ``(shard, node, v)``, ``v`` being the fingerprint as bytes: links whose closure joins all nodes that meet in
    a shard within ``radius``."""
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = sizes.select("shard", F.ceil(F.col("n") / TREE).cast("int").alias("trees"))
    placed = keyed.join(shared, "shard")
    own = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int")
    spread = placed.select("shard", "node", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # in the part (low, high) the trees of low are searched for the fingerprints of high
    role = (F.col("own") == low).cast("int") + 2 * (F.col("own") == high).cast("int")
    parts = spread.select("node", "v", F.xxhash64("shard", low, high).alias("shard"), role.alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        load = 0

        def links(*columns):
            a, b = _shard_links(*columns, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = flat_bytes(batch.column("v")).view(np.uint64).reshape(batch.num_rows, -1)
            shard, node, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "node", "role"))
            held.append((shard, node, values, role))
            load += values.size
            if load >= 400_000:
                whole = [np.concatenate(c) for c in zip(*held)]
                last = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1 if (whole[0] != whole[0][-1]).any() else 0
                if last:
                    yield links(*[c[:last] for c in whole])
                held = [tuple(c[last:] for c in whole)]
                load = held[0][2].size
        if held:
            yield links(*[np.concatenate(c) for c in zip(*held)])

    ship(keyed.sparkSession)
    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, value: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links whose closure joins all distinct fingerprints of ``prints`` within ``radius`` of each other."""
    if radius != RADIUS:
        raise ValueError(f"the blocks are laid out for radius {RADIUS}")
    return _links(prints.select(F.col(value).alias("node"), F.unhex(F.lpad(F.hex(value), 16, "0")).alias("v"),
                                F.explode(shard_keys(F.col(value))).alias("shard")), radius)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row: fingerprints link within three bits, and the component is the
    smallest key reachable, the row's own included.

    Rows with equal fingerprints (null, empty and word-less texts have 0) are one node, so copies of any number cost one
    fingerprint. Repeated keys are kept as rows; a null key takes part but is never the smallest unless it is alone.
    """
    rows = settle(with_fingerprint(df, [key], text, words))
    return with_components(rows, key)


def with_components(rows: DataFrame, key: str) -> DataFrame:
    nodes = rows.groupBy("fingerprint").agg(F.min(key).alias("low"))
    roots = components(near_links(nodes)).withColumnsRenamed({"node": "fingerprint"})
    rooted = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def simhash_report(df: DataFrame) -> DataFrame:
    return near_duplicates(df).withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
