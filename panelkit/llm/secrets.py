"""Secret scans: all rules as one deterministic automaton, run over every text in a single byte pass."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelkit.llm.automaton import Automaton, compile_rules, cut, scan, spans
from panelkit.llm.common import code_points, flat, map_texts


@dataclass(frozen=True)
class Rule:
    """A byte regex; ``least`` bytes are needed in the match, or behind ``head`` (a regex for its beginning) if set.

    Matches that are too short are dropped after the leftmost non-overlapping ones are found. ``every`` is a stricter
    pattern for the pass that only looks for texts worth a closer look; it must match inside every kept match.
    """

    kind: str
    pattern: bytes
    least: int = 1
    ignore_case: bool = False
    head: bytes | None = None
    every: bytes | None = None


ASSIGN_HEAD = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The three base kinds in report order, then the added ones by published key formats.
RULES = (
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True, ASSIGN_HEAD),
    Rule("access", rb"AKIA[A-Z0-9]+", 20),
    Rule("hex", rb"[0-9a-f]+", 24, every=rb"[0-9a-f]{24}"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", rb"AIza[0-9A-Za-z_-]+", 39),
    Rule("stripe", rb"[sr]k_(live|test)_[0-9A-Za-z]+", 24),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", rb"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", 20),
)
SEGMENT = 512


@lru_cache(maxsize=4)
def machines(rules: tuple[Rule, ...]) -> tuple[Automaton, Automaton, Automaton]:
    """The automaton that finds segments with a match, the anchored one that finds their spans, and the one that reads
    backwards to mark where these begin."""
    first = compile_rules([(r.every or r.pattern, r.ignore_case) for r in rules], anywhere=True)
    plain = [(r.pattern, r.ignore_case) for r in rules]
    return first, compile_rules(plain), compile_rules(plain, back=True)


def find(texts: pa.Array, rules: tuple[Rule, ...] = RULES,
         compiled: tuple[Automaton, Automaton, Automaton] | None = None) -> list[list[tuple[str, int, int]]]:
    """For each text its ``(kind, start, end)`` in code points, by start and then in the order of the rules.

    A null text is read as an empty one and holds nothing. Texts are cut only behind bytes that no match can hold, so
    segments run side by side without losing a match; those with one are gone through by the anchored automaton.
    """
    first, exact, behind = compiled or machines(rules)
    data, offsets = flat(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    if len(data):
        borders = cut(data, offsets, exact.safe, SEGMENT)
        hits = np.flatnonzero(scan(first, data, borders))
        owners = np.searchsorted(offsets, borders[hits], "right") - 1
        before, points = -1, None
        for hit, owner in zip(hits.tolist(), owners.tolist()):
            begin, end, base = int(borders[hit]), int(borders[hit + 1]), int(offsets[owner])
            if owner != before:
                before, points = owner, code_points(data[base:int(offsets[owner + 1])])
            segment = data[begin:end].tobytes()
            for rule, a, b in spans(exact, behind, segment, len(rules)):
                if long_enough(rules[rule], segment[a:b]):
                    found[owner].append((rule, int(points[begin - base + a]), int(points[begin - base + b])))
    return [[(rules[k].kind, a, b) for k, a, b in sorted(one, key=lambda s: (s[1], s[0]))] for one in found]


def long_enough(rule: Rule, match: bytes) -> bool:
    if rule.head is None:
        return len(match) >= rule.least
    head = re.match(rule.head, match)
    return head is not None and len(match) - head.end() >= rule.least


SPANS = "secret_spans array<struct<kind:string,start:int,end:int>>"


def secret_spans(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` beside ``secret_spans``: every kind's matches in whole texts.

    Null and empty texts have no spans. Repeated rows each get their own. Columns not in ``keep`` are left out.
    """

    compiled = machines(rules)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in one] for one in find(batch.column(text), rules, compiled)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return {"secret_spans": pa.array(rows, kind)}

    return map_texts(df, text, list(keep), SPANS, work)


def merged(found: Column) -> Column:
    """Overlapping or touching spans joined; ``(start, end)`` from left to right."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    pairs = F.array_sort(F.transform(found, lambda s: span(s["start"], s["end"])))

    def add(seen: Column, s: Column) -> Column:
        last = F.element_at(seen, -1)
        joined = F.concat(F.slice(seen, 1, F.size(seen) - 1),
                          F.array(span(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((F.size(seen) > 0) & (F.try_element_at(seen, F.lit(-1))["end"] >= s["start"]), joined).otherwise(
            F.concat(seen, F.array(s)))

    return F.aggregate(pairs, F.expr("cast(array() as array<struct<start:int,end:int>>)"), add)


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(merged(found), start, lambda s, x: F.struct(
        F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out"),
        x["end"].alias("at")))
    return F.when(F.size(found) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def masked(texts: Sequence[str | None], found: list[list[tuple[str, int, int]]], mark: str = "[SECRET]") -> list[str | None]:
    """Texts with every span, overlapping or touching ones as one, replaced by ``mark``; each text is gone through once."""
    out = []
    for text, spans_ in zip(texts, found):
        parts, at = [], 0
        for a, b in sorted((a, b) for _, a, b in spans_):
            if a > at or not parts:
                parts += [text[at:a], mark]
            at = max(at, b)
        out.append("".join([*parts, text[at:]]) if parts else text)
    return out


def spelled(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                s["end"].cast("string"))), ",")


def secret_report(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans spelled out, per row of ``df``."""
    found = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(found, lambda s: s["kind"].isin("assign", "access", "hex"))
    return secret_spans(df, text, [key]).select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(found).alias("spans"))
