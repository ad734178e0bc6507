"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The vocabulary (pieces with scores) is read from a model file whose path is a parameter; nothing is trained. A space is
the piece mark; inside this module it is the byte 0xFF, which UTF-8 never uses, so a mark written in a text stays apart
from a space. At each byte the automaton's output links give all pieces that end there, longest first; each relaxes the
best score of its end. Bytes that no piece covers cost ``PENALTY`` below the worst score and become byte pieces, so every
text can be encoded and decodes to itself.
"""

from collections.abc import Sequence
from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelkit.llm.common import map_texts, ship

SPACE = b"\xff"
PENALTY = 10.0
#: Chunks kept between batches, and the length from which a chunk is run on its own instead of in step with others.
CACHE, LONG = 300_000, 192
WORDS = re.compile(rb"\xff*[^\xff]+|\xff+")


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[bytes, ...]
    scores: np.ndarray
    byte_ids: np.ndarray
    #: ids of pieces that spell text (not control, unknown or byte pieces)
    normal: np.ndarray

    @property
    def by_word(self) -> bool:
        """Whether no piece crosses from a word into the next space: then texts can be encoded word by word."""
        return not any(re.search(rb"[^\xff]\xff", self.pieces[i]) for i in self.normal)


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file with byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    if any(model.is_unknown(int(i)) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    pieces = [name.replace("▁", " ").encode().replace(b" ", SPACE) for name in names]
    for b, i in enumerate(byte_ids):
        pieces[i] = bytes([b])
    normal = np.array([i for i in range(size) if i not in special], np.int32)
    return Vocabulary(tuple(pieces), np.array([model.get_score(i) for i in range(size)], np.float64), byte_ids, normal)


@dataclass(frozen=True)
class Automaton:
    """``step[state * width + klass[byte]]``: the next state, failure links resolved. ``piece``, ``size``, ``score``: the longest piece
    that ends in a state (-1: none); ``link``: the state of the next shorter one (0: none)."""

    klass: np.ndarray
    width: int
    step: np.ndarray
    piece: np.ndarray
    size: np.ndarray
    score: np.ndarray
    link: np.ndarray
    byte_score: float


def build(vocabulary: Vocabulary) -> Automaton:
    children: list[dict[int, int]] = [{}]
    piece = [-1]
    for i in vocabulary.normal.tolist():
        at = 0
        for byte in vocabulary.pieces[i]:
            to = children[at].get(byte)
            if to is None:
                to = len(children)
                children.append({})
                piece.append(-1)
                children[at][byte] = to
            at = to
        if piece[at] < 0 or vocabulary.scores[i] > vocabulary.scores[piece[at]]:
            piece[at] = i
    used = sorted({byte for node in children for byte in node})
    klass = np.full(256, len(used), np.int32)
    klass[used] = np.arange(len(used))
    width = len(used) + 1
    step = np.zeros((len(children), width), np.int32)
    link = np.zeros(len(children), np.int32)
    order, fail = [0], [0] * len(children)
    for at in order:                        # breadth first: a failure link leads to a shallower state, which is done
        if at:
            step[at] = step[fail[at]]
        for byte, to in children[at].items():
            fail[to] = int(step[fail[at], klass[byte]]) if at else 0
            back = fail[to]
            link[to] = back if piece[back] >= 0 else link[back]
            order.append(to)
        for byte, to in children[at].items():
            step[at, klass[byte]] = to
    piece = np.array(piece, np.int32)
    # a state in which no piece ends stands for the next one that has one
    heads = np.where(piece >= 0, np.arange(len(piece)), link)
    size = np.array([len(vocabulary.pieces[p]) if p >= 0 else 0 for p in piece], np.int32)
    score = np.where(piece >= 0, vocabulary.scores[piece], -np.inf)
    low = float(vocabulary.scores[vocabulary.normal].min()) - PENALTY
    return Automaton(klass, width, step.ravel(), piece[heads], size[heads], score[heads],
                     np.where(piece >= 0, link, link[heads]).astype(np.int32), low)


def _together(machine: Automaton, chunks: list[bytes], byte_ids: np.ndarray) -> list[bytes]:
    """Best pieces of many short chunks, each as int32 bytes: all chunks move one byte at a time, in step."""
    lengths = np.array([len(c) for c in chunks])
    order = np.argsort(-lengths, kind="stable")
    lengths, rows = lengths[order], [chunks[i] for i in order]
    longest = int(lengths[0])
    text = np.frombuffer(b"".join(c.ljust(longest, b"\0") for c in rows), np.uint8).reshape(len(rows), longest).T
    classes = machine.klass[text]
    best = np.full((longest + 1, len(rows)), -np.inf)
    best[0] = 0
    taken = np.zeros((longest + 1, len(rows)), np.int32)      # the piece that ends here on the best way
    back = np.ones((longest + 1, len(rows)), np.int32)
    state = np.zeros(len(rows), np.int32)
    live = np.searchsorted(-lengths, -np.arange(longest), "left")
    column = np.arange(len(rows))
    for t, n in enumerate(live):
        now = machine.step.take(state[:n] * machine.width + classes[t, :n])
        state[:n] = now
        high = best[t, :n] + machine.byte_score
        piece, size = byte_ids[text[t, :n]], back[t + 1, :n]
        ask, at = column[:n], now
        while True:
            some = machine.size.take(at) > 0
            if not some.all():
                ask, at = ask[some], at[some]
            if not len(ask):
                break
            long = machine.size.take(at)
            score = best[t + 1 - long, ask] + machine.score.take(at)
            better = score > high[ask]
            where = ask[better]
            high[where], piece[where], size[where] = score[better], machine.piece.take(at[better]), long[better]
            at = machine.link.take(at)
        best[t + 1, :n], taken[t + 1, :n] = high, piece
    # walk back from each chunk's end
    at, steps = lengths.copy(), []
    while (at > 0).any():
        steps.append(np.where(at > 0, taken[at, column], -1))
        at = np.where(at > 0, at - back[at, column], 0)
    found = np.array(steps[::-1], np.int32).T
    out: list[bytes] = [b""] * len(rows)
    for i, row in zip(order.tolist(), found):
        out[i] = row[row >= 0].tobytes()
    return out


def _alone(machine: Automaton, chunk: bytes, byte_ids: np.ndarray) -> bytes:
    """Best pieces of one long chunk."""
    step, klass, width = machine.step, machine.klass.tolist(), machine.width
    best, taken, back, state = [0.0], [0], [0], 0
    for t, byte in enumerate(chunk):
        state = int(step[state * width + klass[byte]])
        high, piece, size, at = best[t] + machine.byte_score, int(byte_ids[byte]), 1, state
        while machine.size[at]:
            score = best[t + 1 - machine.size[at]] + machine.score[at]
            if score > high:
                high, piece, size = score, int(machine.piece[at]), int(machine.size[at])
            at = machine.link[at]
        best.append(high)
        taken.append(piece)
        back.append(size)
    out, at = [], len(chunk)
    while at:
        out.append(taken[at])
        at -= back[at]
    return np.array(out[::-1], np.int32).tobytes()


class Encoder:
    """Texts to piece ids. Words are encoded once per batch, and frequent ones are remembered up to ``CACHE`` words."""

    def __init__(self, vocabulary: Vocabulary, machine: Automaton | None = None):
        self.vocabulary = vocabulary
        self.machine = machine or build(vocabulary)
        self.by_word = vocabulary.by_word
        self.known: dict[bytes, bytes] = {}

    def chunks(self, text: str | None) -> list[bytes]:
        """The marked text in parts that can be encoded on their own; a null or empty text has none."""
        if not text:
            return []
        marked = SPACE + text.encode().replace(b" ", SPACE)
        return WORDS.findall(marked) if self.by_word else [marked]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        parts = [self.chunks(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = set()
        for p in parts:
            new.update(p)
        new = sorted(new.difference(self.known), key=len)
        ids = self.vocabulary.byte_ids
        short = [c for c in new if len(c) <= LONG]
        for first in range(0, len(short), 8192):
            some = short[first:first + 8192]
            self.known.update(zip(some, _together(self.machine, some, ids)))
        self.known.update((c, _alone(self.machine, c, ids)) for c in new if len(c) > LONG)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32) for p in parts]


def decode(vocabulary: Vocabulary, ids: Sequence[int]) -> str:
    """The text that was encoded: byte pieces are bytes, marks are spaces, and the one in front is dropped."""
    spelled = b"".join(map(vocabulary.pieces.__getitem__, ids))
    return spelled.replace(SPACE, b" ")[1:].decode("utf-8", "replace")


def encoded(df: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text",
            check: bool = False) -> DataFrame:
    """``keep`` beside ``token_ids`` and ``n_tokens`` of whole texts; with ``check`` also ``round_trip``, whether decoding
    the ids gives the text back.

    Null and empty texts have no tokens. Of equally good ways the one with the longer last piece wins. Repeated rows are
    encoded alike.
    """
    vocabulary = read_vocabulary(path)
    machine = build(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, machine))  # as large as the given model file
    cell: list[Encoder] = []
    added = "token_ids array<int>, n_tokens int" + (", round_trip boolean" if check else "")

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        if not cell:
            cell.append(Encoder(*shared.value))
        texts = batch.column(text).to_pylist()
        found = cell[0].encode(texts)
        sizes = np.array([len(f) for f in found], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        out: dict[str, object] = {
            "token_ids": pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
            "n_tokens": sizes.astype(np.int32)}
        if check:
            out["round_trip"] = [decode(shared.value[0], f.tolist()) == (t or "") for f, t in zip(found, texts)]
        return out

    return map_texts(df, text, list(keep), added, work)


def decoded(df: DataFrame, path: str, ids: str = "token_ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` beside the ``text`` that the ids spell; null ids give a null text."""
    from pyspark.sql import functions as F

    ship(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("string")
    def spell(column):
        return column.map(lambda row: None if row is None else decode(pieces.value, row.tolist()))

    return df.select(*keep, spell(ids).alias("text"))
