"""LM scoring: prediction by partial matching over bytes, pretrained on the corpus, beside a smoothed unigram base.

Spark counts every run of ``ORDER`` bytes and the symbol behind it (a byte, or the text's end) over all training texts, and
of every shorter context likewise; none is left out. A context gives a symbol it has seen c / (n + d), with n places and d
different symbols, and leaves d / (n + d) to the next shorter context, from which the symbols seen are excluded. The
shortest one leaves the rest to all symbols alike. So the chances of all texts add up to one.

The trie is laid out by reversed context: a context, all its longer ones and their symbols lie side by side, so a range of
reversed contexts is a branch. Runs are dealt to tasks by branch, the texts' questions (a run and how often) behind them; each
task builds its branch in arrays and answers. A branch with too many runs or questions is cut one byte deeper; the few
contexts above the cuts are broadcast. ``FAST`` of the most frequent runs are broadcast with their chances and answered on
the spot; how many those are changes no result.

Counts, questions and words cross the network packed, many to a row, so that their number costs little but arithmetic in arrays.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelkit.llm.common import flat, map_texts, ship, steps
from panelkit.llm.toxicity import Numbers
from panelkit.session import settle

ORDER = 6
#: Runs whose chances are broadcast, at most; all others are joined.
FAST = 1 << 21
#: Runs and questions of a branch before it is cut deeper, those that a task answers at once, and bytes of text scored at once.
BRANCH, HELD, STEP = 1 << 20, 1 << 19, 1 << 20
#: Bytes of training text whose runs, at most as many, make one bucket: a task merges a bucket's counts at a time.
COUNTED = 1 << 22
#: Bytes UTF-8 never uses, for the place before a text and the end behind it; all symbols are 256 bytes and the end.
BEGIN, END, SYMBOLS = 0xFE, 0xFF, 257
#: A word with at least this share of all tokens is broadcast; there are at most that many. The others are joined.
FREQUENT = 65_536
#: Words of a bucket, whose counts a task holds at a time, and training tokens for each bucket, about.
WORDS, ASKED = 1 << 17, 1 << 22
SMOOTH = 0.1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stream(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts one after another, each behind ``order`` begin marks and before an end mark; the places of all
    symbols, and for each text the number of symbols before it."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    inside = np.ones(len(data) + n * (order + 1), bool)
    inside[((offsets[:-1] + np.arange(n) * (order + 1))[:, None] + np.arange(order)).ravel()] = False
    out = np.full(len(inside), BEGIN, np.uint8)
    out[inside] = np.insert(LOWER[data], offsets[1:], END)
    return out, np.flatnonzero(inside), offsets[:-1] + np.arange(n)


def codes(out: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """The run of ``order`` bytes and the symbol at each place, as a number with the symbol lowest."""
    code, length = out.astype(np.int64), 1
    while length <= order:  # two neighbours make one of up to twice their length
        more = min(length, order + 1 - length)
        code = code[:max(len(code) - more, 0)] << 8 * more | code[more:] & (1 << 8 * more) - 1
        length += more
    return code[place - order]


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of ``order`` bytes and a symbol, as numbers with the symbol lowest, and their counts."""
    out, place, _ = stream(texts, order)
    return np.unique(codes(out, place, order), return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([c for c, _ in parts])
    order = np.argsort(code, kind="stable")
    code, count = code[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(code) else count


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _by_byte(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on."""
    return np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.dtype.itemsize).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.array(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T, order="C").view(kind).ravel()


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, the first column ascending, as the bytes of its steps and of the others, compressed byte by byte."""
    first = np.diff(columns[0], prepend=np.int64(0))
    return _squeezed(_by_byte(np.stack([first, *columns[1:]]).astype(np.int64)))


def unpacked(data: bytes, many: int) -> np.ndarray:
    """The columns of ``packed``, one row each."""
    out = _numbers(_whole(data), np.int64).reshape(many, -1)
    out[0] = np.cumsum(out[0])
    return out


def _runs_of(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of a sorted array, where it begins and where it ends."""
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    yield from zip(sorted_[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_)])


def gram_counts(df: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """``(gram, n, under)`` over all texts of ``df``: ``under`` is the places of the run's context and its different symbols, 256 at
    most. Partial counts of a task are merged and packed by buckets of contexts before they are shuffled."""
    buckets = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // COUNTED + 1

    def as_pieces(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = (((gram >> 8).astype(np.uint64) * Frequent.TURNS[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
        at = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        gram, n = gram[at], n[at]
        pieces = [(b, packed(gram[first:last], n[first:last])) for b, first, last in _runs_of(bucket[at])]
        return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in pieces], pa.int64()), "data": pa.array([d for _, d in pieces], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in steps(batches, text, 1 << 21):
            held.append(grams(batch.column(text), order))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield as_pieces(*held[0])
                    held, size = [], 0
        if held:
            yield as_pieces(*_merged(held))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, size, least = [], None, 0, 1 << 20

        def whole() -> Iterator[pa.RecordBatch]:
            if held:
                gram, n = _merged(held)
                begin = np.flatnonzero(np.append(True, gram[1:] >> 8 != gram[:-1] >> 8))
                kinds = np.diff(np.append(begin, len(gram)))
                under = np.repeat(np.add.reduceat(n, begin) + kinds, kinds)
                for first in range(0, len(gram), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[first:first + (1 << 16)]) for c in (gram, n, under)], ["gram", "n", "under"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if bucket != last:
                    yield from whole()
                    held, last, size, least = [], bucket, 0, 1 << 20
                held.append(tuple(unpacked(data, 2)))
                size += len(held[-1][0])
                if size > least:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    least = 2 * size + (1 << 20)
        yield from whole()

    ship(df.sparkSession)
    pieces = df.select(text).mapInArrow(count, "bucket long, data binary")
    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "gram long, n long, under long")


# ---------------------------------------------------------------- branches

def reverse(gram: np.ndarray, order: int) -> np.ndarray:
    """The context's bytes in reverse, the nearest one highest, and the symbol lowest."""
    out = np.zeros(len(gram), np.int64)
    rest = gram >> 8
    for _ in range(order):
        out = out << 8 | rest & 0xFF
        rest >>= 8
    return out << 8 | gram & 0xFF


@dataclass(frozen=True)
class Level:
    """The runs of one context length, by reversed context: sorted runs with counts, and sorted contexts with the places they
    were seen at, their different symbols, and log10 of what they leave to a symbol the next shorter one is asked for."""

    run: np.ndarray
    n: np.ndarray
    context: np.ndarray
    places: np.ndarray
    kinds: np.ndarray
    escape: np.ndarray

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each context is, and whether it is there at all."""
        at = np.minimum(np.searchsorted(self.context, context), max(len(self.context) - 1, 0))
        return at, (self.context[at] == context) if len(self.context) else np.zeros(len(context), bool)


def _level(run: np.ndarray, n: np.ndarray, below: Level | None) -> Level:
    """From runs in any order; ``below`` is the level of contexts one byte shorter, which has them all."""
    run, n = _merged([(run, n)])
    begin = np.flatnonzero(np.append(True, run[1:] >> 8 != run[:-1] >> 8)) if len(run) else np.zeros(0, np.int64)
    context, places = run[begin] >> 8, np.add.reduceat(n, begin) if len(run) else n
    kinds = np.diff(np.append(begin, len(run)))
    escape = np.zeros(len(context))
    if below is not None and len(run):
        at, _ = below.find(context >> 8)
        under = (below.places + below.kinds)[at]
        known = below.n[np.searchsorted(below.run, (run >> 16) << 8 | run & 0xFF)]
        # the symbols seen here are excluded below
        escape = np.log10(kinds / (places + kinds) * under / (under - np.add.reduceat(known, begin)))
    return Level(run, n, context, places, kinds, escape)


def branch(gram: np.ndarray, n: np.ndarray, cut: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray]], order: int) -> list[Level]:
    """The levels from context length 0 to ``order`` of some branches, from their runs of the longest; ``cut`` is the length of
    context each run's branch was cut at. ``upper`` holds, by length, the runs of the contexts above the cuts."""
    whole = reverse(gram, order)
    levels: list[Level] = []
    for k in range(order + 1):
        mine = cut <= k
        run = (whole[mine] >> 8 * (order - k + 1)) << 8 | whole[mine] & 0xFF
        parts = [(run, n[mine]), *upper[k:k + 1]]
        levels.append(_level(np.concatenate([r for r, _ in parts]), np.concatenate([m for _, m in parts]), levels[-1] if k else None))
    return levels


def answers(levels: list[Level], gram: np.ndarray, order: int) -> np.ndarray:
    """log10 of the chance of each run: escapes from the longest context down to the one that has seen its symbol."""
    whole = reverse(gram, order)
    out = np.zeros(len(gram))
    left = np.arange(len(gram))
    for k in range(order, -1, -1):
        level = levels[k]
        context = whole[left] >> 8 * (order - k + 1)
        at, there = level.find(context)
        run = context << 8 | whole[left] & 0xFF
        place = np.minimum(np.searchsorted(level.run, run), max(len(level.run) - 1, 0))
        met = there & (level.run[place] == run) if len(level.run) else there
        out[left[met]] += np.log10(level.n[place[met]] / (level.places + level.kinds)[at[met]])
        gone = there & ~met
        if k:
            out[left[gone]] += level.escape[at[gone]]
        left = left[~met]
    root = levels[0]
    rest = 1 / SYMBOLS if not len(root.run) else root.kinds[0] / (root.places[0] + root.kinds[0]) / (SYMBOLS - root.kinds[0])
    out[left] += math.log10(rest)
    return out


def _nearest(k: int, gram: Column | str = "gram") -> Column:
    """The ``k`` bytes nearest to the symbol, as a number."""
    return F.shiftright(gram, 8).bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))


@dataclass(frozen=True)
class Cuts:
    """Where branches are cut: for each length from 2 on the nearest bytes whose branch goes on one byte deeper, and in how many
    parts the questions of a whole context are dealt (its few runs go to all of them)."""

    deeper: dict[int, list[int]]
    parts: dict[int, int]

    def deal(self, gram: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run the length of context at which its branch is cut, and the branch's number."""
        context = gram >> 8
        cut = np.full(len(gram), min(2, order), np.int64)
        for k, found in sorted(self.deeper.items()):
            cut[np.isin(context & ((1 << 8 * k) - 1), found)] = k + 1
        return cut, (context & ((np.int64(1) << 8 * cut) - 1)) * 8 + cut  # never the same for two lengths


def _pieces(branch: np.ndarray, part: np.ndarray, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of one kind packed by branch and part; each piece in the order of its first column."""
    order = np.lexsort((columns[0], part, branch))
    branch, part, columns = branch[order], part[order], [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, (branch[1:] != branch[:-1]) | (part[1:] != part[:-1]))) if len(branch) else np.zeros(0, np.int64)
    data = [packed(*[c[a:b] for c in columns]) for a, b in zip(first, [*first[1:], len(branch)])]
    return pa.RecordBatch.from_pydict({"branch": pa.array(branch[first], pa.int64()), "part": pa.array(part[first], pa.int32()),
                                       "kind": pa.array(np.full(len(first), kind), pa.int32()), "data": pa.array(data, pa.binary())})


def cuts(counts: DataFrame, asked: DataFrame, order: int) -> Cuts:
    """Branches of at most ``BRANCH`` runs and questions, from tables with a column ``gram``."""
    both = counts.select("gram").unionByName(asked.select("gram"))
    deeper, found = {}, None
    for k in range(min(2, order), order + 1):
        rows = both if found is None else both.filter(_nearest(k - 1).isin(found))
        sizes = rows.groupBy(_nearest(k).alias("context")).count().filter(F.col("count") > BRANCH).collect()  # few: BRANCH rows behind each
        if not sizes:
            break
        if k == order:
            return Cuts(deeper, {r["context"]: -(-r["count"] // BRANCH) for r in sizes})
        found = sorted(r["context"] for r in sizes)
        deeper[k] = found
    return Cuts(deeper, {})


def upper_runs(counts: DataFrame, where: Cuts, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length of context the runs above the cuts, by reversed context: at most 65,536 of one byte, and 256 of each context
    that was cut deeper."""
    out = []
    for k in range(min(2, order)) if not where.deeper else range(max(where.deeper) + 1):
        rows = counts if k < 2 else counts.filter(_nearest(k).isin(where.deeper[k]))
        code = F.shiftleft(_nearest(k), 8).bitwiseOR(F.col("gram").bitwiseAND(F.lit(255).cast("long")))
        found = rows.groupBy(code.alias("run")).agg(F.sum("n").alias("n")).toArrow()
        run, n = found["run"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)
        out.append((reverse(run, k), n))
    return out


PIECES = "branch long, part int, kind int, data binary"


def asked_chances(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """``(row, log)``, partial sums: log10 of the chances of the questions ``(row, runs)`` under the runs ``(gram, n)``; ``runs`` are
    arrays of ``(gram, n)``, n being how often it is asked.

    Runs and questions meet in one shuffle, packed by branch. A task holds about ``HELD`` of them at a time, or a branch's
    runs; of a branch with more questions it keeps the runs.
    """
    spark = counts.sparkSession
    where = cuts(counts, asked.select(F.explode("runs.gram").alias("gram")), order)
    top = spark.sparkContext.broadcast(upper_runs(counts, where, order))
    shares = np.array(sorted(where.parts.items()), np.int64).reshape(-1, 2)

    def share(gram: np.ndarray) -> np.ndarray:
        """In how many parts the questions of each run's context are dealt."""
        at = np.minimum(np.searchsorted(shares[:, 0], gram >> 8), max(len(shares) - 1, 0))
        return np.where(shares[at, 0] == gram >> 8, shares[at, 1], 1) if len(shares) else np.ones(len(gram), np.int64)

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _large(batches, HELD):
            gram, n = (batch.column(c).to_numpy() for c in ("gram", "n"))
            again = share(gram)
            part = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
            gram, n = np.repeat(gram, again), np.repeat(n, again)
            cut, branch_ = where.deal(gram, order)
            yield _pieces(branch_, part, 0, [gram, n, cut])

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _large(batches, 4096):
            runs = batch.column("runs").combine_chunks() if isinstance(batch.column("runs"), pa.ChunkedArray) else batch.column("runs")
            each = runs.flatten()
            row = np.repeat(batch.column("row").to_numpy(), np.diff(runs.offsets.to_numpy()))
            gram, n = each.field("gram").to_numpy(zero_copy_only=False), each.field("n").to_numpy(zero_copy_only=False)
            _, branch_ = where.deal(gram, order)
            yield _pieces(branch_, row % share(gram), 1, [gram, n, row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[np.ndarray] = []
        asks: list[np.ndarray] = []
        last, mine, size, waiting = None, 0, 0, 0

        def answered() -> Iterator[pa.RecordBatch]:
            if asks:
                gram, n, cut = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
                gram, own = np.unique(gram, return_index=True)  # a context whose questions are dealt in parts may be here twice
                levels = branch(gram, n[own], cut[own], top.value, order)
                asked_, times, row = np.concatenate(asks, axis=1)
                rows, back = np.unique(row, return_inverse=True)
                log = answers(levels, asked_, order) * times
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(back.reshape(-1), log))], ["row", "log"])

        for batch in batches:
            for name, kind, data in zip(*[batch.column(c).to_pylist() for c in ("branch", "kind", "data")]):
                if waiting > HELD or name != last and size > HELD:
                    yield from answered()
                    # the runs of a branch that goes on stay
                    runs, mine, asks, waiting = runs[mine:] if name == last else [], 0, [], 0
                    size = sum(r.shape[1] for r in runs)
                if name != last:
                    last, mine = name, len(runs)
                found = unpacked(data, 3)
                (asks if kind else runs).append(found)
                size, waiting = size + found.shape[1], waiting + kind * found.shape[1]
        yield from answered()

    ship(spark)
    dealt = counts.select("gram", "n").mapInArrow(model, PIECES).unionByName(asked.select("row", "runs").mapInArrow(questions, PIECES))
    return dealt.repartition("branch", "part").sortWithinPartitions("branch", "part", "kind").mapInArrow(run, "row long, log double")


def _large(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to at least so many rows."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Frequent:
    """Chances by run, in two hash tables without chains; a run that finds both its places taken is not held."""

    TURNS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, gram: np.ndarray, log: np.ndarray):
        self.gram, self.log = np.append(gram, -1), np.append(log, np.nan)
        self.bits = max(4, len(gram).bit_length() + 1)
        self.slots = []
        left = np.arange(len(gram), dtype=np.int32)
        for turn in self.TURNS:
            slot = np.full(1 << self.bits, len(gram), np.int32)
            at = self._place(gram[left], turn)
            slot[at] = left
            left = left[slot[at] != left]
            self.slots.append(slot)

    def _place(self, gram: np.ndarray, turn: np.uint64) -> np.ndarray:
        return (gram.astype(np.uint64) * turn >> np.uint64(64 - self.bits)).astype(np.int64)

    def chances(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the chance of each run, not a number if it is not held."""
        out = np.empty(len(gram))
        for first in range(0, len(gram), 1 << 16):
            part = gram[first:first + (1 << 16)]
            at = self.slots[0].take(self._place(part, self.TURNS[0]))
            missed = np.flatnonzero(self.gram.take(at) != part)
            if len(missed):
                other = self.slots[1].take(self._place(part[missed], self.TURNS[1]))
                at[missed] = np.where(self.gram.take(other) == part[missed], other, len(self.gram) - 1)
            out[first:first + len(part)] = self.log.take(at)
        return out


def frequent_runs(counts: DataFrame) -> Frequent:
    """The most frequent runs of ``(gram, n, under)``, at most ``FAST``: from the smallest eighth of a power of two on that leaves no
    more."""
    eighth = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in sorted(counts.groupBy(eighth.alias("e")).count().collect(), key=lambda r: -r["e"]):
        held += r["count"]
        if held > FAST:
            break
        least = r["e"]
    if least is None:
        return Frequent(np.zeros(0, np.int64), np.zeros(0))
    rows = counts.filter(eighth >= least).select("gram", F.log10(F.col("n") / F.col("under")).alias("log")).toArrow()  # at most FAST rows
    return Frequent(rows["gram"].to_numpy(), rows["log"].to_numpy())


def _by_text(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different runs of 56 bits and their counts; ``owner`` is sorted. 256 texts at a time share 64 bits."""
    texts, grams, counts = [owner[:0]], [code[:0]], [code[:0]]
    for first in range(int(owner[0]) if len(owner) else 0, int(owner[-1]) + 1 if len(owner) else 0, 256):
        a, b = np.searchsorted(owner, [first, first + 256])
        pair, times = np.unique((owner[a:b] - first).astype(np.uint64) << np.uint64(56) | code[a:b].astype(np.uint64), return_counts=True)
        texts.append((pair >> np.uint64(56)).astype(np.int64) + first)
        grams.append((pair & np.uint64((1 << 56) - 1)).astype(np.int64))
        counts.append(times.astype(np.int64))
    return np.concatenate(texts), np.concatenate(grams), np.concatenate(counts)


def _lists(row: np.ndarray, rows: int, **columns: pa.Array) -> pa.ListArray:
    """Structs of ``columns`` as a list for each of ``rows`` rows; ``row`` is sorted."""
    borders = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts: A-Z lowered, cut at white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        as_rows = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in steps(batches, text):
            for t in batch.column(text).cast(pa.large_binary()).to_pylist():
                if t:
                    held.update(t.lower().split())
            if len(held) > 400_000:
                yield as_rows()
                held = Counter()
        if held:
            yield as_rows()

    ship(df.sparkSession)
    return df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_words(words: list[bytes], numbers: np.ndarray) -> bytes:
    """Words, which hold no white space, and whole numbers, compressed."""
    return _squeezed(b" ".join(words) + b"\n" + _by_byte(numbers))


def _words_of(data: bytes, kind: type) -> tuple[list[bytes], np.ndarray]:
    words, numbers = _whole(data).split(b"\n", 1)
    return words.split(b" "), _numbers(numbers, kind)


def _buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def word_questions(words: list[bytes], word: np.ndarray, row: np.ndarray, rows: int, buckets: int) -> tuple[list[tuple[int, bytes]], bytes]:
    """Of tokens, each with the number of its word and its row: the words as one piece for each bucket, and for all words in that
    order in how many rows each one is, those rows, and how often it is there."""
    bucket = _buckets(words, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    pair, times = np.unique(place[word] * rows + row, return_counts=True)
    many = np.bincount(pair // max(rows, 1), minlength=len(words))
    pieces = [(b, _squeezed(b" ".join([words[i] for i in order[first:last]]))) for b, first, last in _runs_of(bucket[order])]
    return pieces, _squeezed(_by_byte(np.concatenate([many, pair % max(rows, 1), times]).astype(np.int32)))


def asked_words(counts: DataFrame, asked: DataFrame, under: float, buckets: int) -> DataFrame:
    """``(row, more, seen)``: for each row log10 of the chances of its words under the counts ``(word, n)``, summed, and how many of
    them were counted. ``asked`` is ``(row, words, places)``: at the first row of some that follow one another, the pieces
    ``(bucket, data)`` and the places of ``word_questions``.

    Counts and words meet in one shuffle, packed by bucket, a task holding a bucket's counts and one piece of words; the words'
    counts meet their places in another.
    """
    piece = "row long, bucket int, kind int, data binary"

    def as_rows(row: list[int], bucket: list[int], kind: int, data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "bucket": pa.array(bucket, pa.int32()),
                                           "kind": pa.array([kind] * len(row), pa.int32()), "data": pa.array(data, pa.binary())})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _large(batches, WORDS):
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            bucket = _buckets(words, buckets)
            order = np.argsort(bucket, kind="stable")
            pieces = [(b, _with_words([words[i] for i in order[first:last]], n[order[first:last]])) for b, first, last in _runs_of(bucket[order])]
            yield as_rows([0] * len(pieces), [b for b, _ in pieces], 0, [d for _, d in pieces])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        last = None
        for batch in batches:
            rows, at, answers_ = [], [], []
            for row, bucket, kind, data in zip(*[batch.column(c).to_pylist() for c in ("row", "bucket", "kind", "data")]):
                if bucket != last:
                    last, held = bucket, {}
                if kind:
                    words = _whole(data).split(b" ")
                    rows.append(row)
                    at.append(bucket)
                    answers_.append(_squeezed(_by_byte(np.fromiter((held.get(w, 0) for w in words), np.int64, len(words)))))
                else:
                    words, n = _words_of(data, np.int64)
                    held.update(zip(words, n.tolist()))
            yield as_rows(rows, at, 1, answers_)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, places, found = None, b"", []

        def sums() -> pa.RecordBatch:
            n = np.concatenate(found)
            numbers = _numbers(_whole(places), np.int32)
            many, (row, times) = numbers[:len(n)], numbers[len(n):].reshape(2, -1)
            worth, met = (np.repeat(x, many) for x in (np.log10((n + SMOOTH) / under), n > 0))
            there = np.unique(row)
            more, seen = (np.bincount(row, times * x)[there] for x in (worth, met))
            return pa.RecordBatch.from_arrays([pa.array(first + there.astype(np.int64)), pa.array(more), pa.array(seen.astype(np.int64))], ["row", "more", "seen"])

        for batch in batches:
            for row, kind, data in zip(*[batch.column(c).to_pylist() for c in ("row", "kind", "data")]):
                if kind:
                    found.append(_numbers(_whole(data), np.int64))
                    continue
                if found:
                    yield sums()
                first, places, found = row, data, []
        if found:
            yield sums()

    ship(counts.sparkSession)
    words = asked.select("row", F.explode("words").alias("w")).select("row", "w.bucket", F.lit(1).alias("kind"), "w.data")
    dealt = counts.select("word", "n").mapInArrow(known, piece).unionByName(words)
    answered = dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, piece)
    zero = F.lit(0)
    whole = asked.select("row", zero.alias("bucket"), zero.alias("kind"), F.col("places").alias("data")).unionByName(answered)
    return whole.repartition("row").sortWithinPartitions("row", "kind", "bucket").mapInArrow(total, "row long, more double, seen long")


def scored(df: DataFrame, learnt: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``key`` and ``keep`` beside ``n_tokens, n_known, train_tokens, base_score, score, code_bits`` for every row of ``df``.

    ``learnt`` holds the training texts. ``score`` is the model's log10 chance of the lower-cased text, ``code_bits`` its code
    length; ``base_score`` the smoothed unigram's over words and an end. Null texts are empty: one token, the end. Repeated
    rows are scored alike, each on its own.
    """
    spark = df.sparkSession
    model = settle(gram_counts(learnt, text))
    runs = spark.sparkContext.broadcast(frequent_runs(model))
    counts = settle(word_counts(learnt, text))
    texts = learnt.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, different = sums["n"] + texts, sums["v"] + (texts > 0)
    under = tokens + SMOOTH * (different + 1)
    value = lambda c: math.log10((c + SMOOTH) / under)
    often = F.col("n") >= max(1, tokens / FREQUENT)
    frequent = {bytes(r["word"]): value(r["n"]) for r in counts.filter(often).collect()}
    common = spark.sparkContext.broadcast(frequent)            # at most ``FREQUENT`` words
    end = value(texts)
    buckets = max(1, -(-different // WORDS), -(-tokens // ASKED))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        column = batch.column(text)
        numbers = Numbers()
        found = [list(map(numbers.__getitem__, (t or b"").lower().split())) for t in column.cast(pa.large_binary()).to_pylist()]
        sizes = np.array([len(f) for f in found], np.int64)
        ids = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(found)), sizes)
        words = list(numbers)
        worth = np.array([common.value.get(w, 1.0) for w in words])
        known = worth[ids] <= 0 if len(words) else np.zeros(0, bool)
        base = np.bincount(row[known], worth[ids[known]], len(found)) if len(words) else np.zeros(len(found))
        unusual = np.flatnonzero(worth > 0)
        number = np.zeros(len(words), np.int64)
        number[unusual] = np.arange(len(unusual))
        pieces, places = word_questions([words[i] for i in unusual], number[ids[~known]], row[~known], len(found), buckets)
        # those of all rows stand with the first one
        rare = _lists(np.zeros(len(pieces), np.int64), len(found), bucket=pa.array([b for b, _ in pieces], pa.int32()),
                      data=pa.array([d for _, d in pieces], pa.binary()))
        places = pa.array([places if pieces else None] + [None] * (len(found) - 1), pa.binary())
        out, place, begin = stream(column, ORDER)
        code = codes(out, place, ORDER)
        log = runs.value.chances(code)
        met = ~np.isnan(log)
        score = np.add.reduceat(np.where(met, log, 0), begin) if len(begin) else np.zeros(0)
        missed = np.flatnonzero(~met)
        of_text, gram, times = _by_text(np.searchsorted(begin, missed, "right") - 1, code[missed])
        others = _lists(of_text, len(found), gram=pa.array(gram), n=pa.array(times))
        return {"_tokens": sizes + 1, "_known": np.bincount(row[known], minlength=len(found)), "_base": base + end,
                "_score": score, "_rare": rare, "_places": places, "_runs": others}

    added = ("_tokens long, _known long, _base double, _score double, _rare array<struct<bucket:int,data:binary>>, _places binary, "
             "_runs array<struct<gram:long,n:long>>")
    kept = list(dict.fromkeys([key, *keep]))
    # rows get a number of their own for the way back, one after another in a partition; written, it stays the same
    rows = settle(map_texts(df, text, kept, added, work, STEP).withColumn("_row", F.monotonically_increasing_id()))
    zero = F.lit(0).cast("long")
    # the rows of one step of ``work`` are numbered one after another
    rare = rows.filter(F.col("_places").isNotNull()).select(F.col("_row").alias("row"), F.col("_rare").alias("words"), F.col("_places").alias("places"))
    of_words = asked_words(counts.filter(~often), rare, under, buckets).select(F.col("row").alias("_row"), "more", "seen", F.lit(0.0).alias("log"))
    asked = rows.select(F.col("_row").alias("row"), F.col("_runs").alias("runs")).filter(F.size("_runs") > 0)
    of_runs = asked_chances(model, asked).select(F.col("row").alias("_row"), F.lit(0.0).alias("more"), zero.alias("seen"), "log")
    back = of_words.unionByName(of_runs).groupBy("_row").agg(
        F.sum("more").alias("_more"), F.sum("seen").alias("_seen"), F.sum("log").alias("_log"))
    score = F.col("_score") + F.coalesce("_log", F.lit(0.0))
    return rows.drop("_rare", "_places", "_runs").join(back, "_row", "left").select(
        *kept, F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_seen", zero) + int(texts > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), score.alias("score"),
        (score * -math.log2(10)).alias("code_bits"))
