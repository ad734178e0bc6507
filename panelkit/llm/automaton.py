"""Regexes of many rules compiled into one deterministic automaton over bytes.

The rules' patterns (byte regexes without anchors, look-around or back references) become one nondeterministic automaton;
subset construction and minimisation turn it into a transition array. Each state knows which rules end there.
"""

from dataclasses import dataclass
from re import IGNORECASE, _constants as sre, _parser

import numpy as np


class _Nfa:
    """States with byte-set edges and empty edges, built from parsed patterns."""

    def __init__(self):
        self.edges: list[list[tuple[np.ndarray, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def on(self, at: int, allowed: np.ndarray) -> int:
        to = self.state()
        self.edges[at].append((allowed, to))
        return to

    def add(self, at: int, items, fold: bool, back: bool = False) -> int:
        """Append the parsed ``items`` behind state ``at``, from the last to the first if ``back``; the state where they end."""
        for op, arg in reversed(list(items)) if back else items:
            if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
                at = self.on(at, _allowed(op, arg, fold))
            elif op is sre.SUBPATTERN:
                at = self.add(at, arg[3], fold, back)
            elif op is sre.BRANCH:
                ends = [self.add(at, option, fold, back) for option in arg[1]]
                at = self.state()
                for end in ends:
                    self.empty[end].append(at)
            elif op is sre.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self.add(at, body, fold, back)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(loop, body, fold, back)].append(loop)
                    at = loop
                else:
                    done = self.state()
                    self.empty[at].append(done)
                    for _ in range(most - least):
                        at = self.add(at, body, fold, back)
                        self.empty[at].append(done)
                    at = done
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def _allowed(op, arg, fold: bool) -> np.ndarray:
    """The bytes an atom accepts."""
    allowed = np.zeros(256, bool)
    if op is sre.ANY:
        allowed[:] = True
        allowed[10] = False
        return allowed
    negate = op is sre.NOT_LITERAL
    for kind, value in arg if op is sre.IN else [(sre.LITERAL, arg)]:
        if kind is sre.NEGATE:
            negate = True
        elif kind is sre.LITERAL:
            allowed[value] = True
        elif kind is sre.RANGE:
            allowed[value[0]:value[1] + 1] = True
        else:
            raise ValueError(f"not supported in a class: {kind}")
    if fold:
        upper, lower = allowed[65:91].copy(), allowed[97:123].copy()
        allowed[65:91] |= lower
        allowed[97:123] |= upper
    return ~allowed if negate else allowed


@dataclass(frozen=True)
class Automaton:
    """``step[state, klass[byte]]`` is the next state, ``ends[state]`` the bit set of rules that end there, state 0 the
    start. ``dead`` is the state without a way on (-1: none), ``safe`` marks the bytes that no match holds: a text may be
    cut behind them."""

    klass: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    dead: int
    safe: np.ndarray


def compile_rules(patterns: list[tuple[bytes, bool]], anywhere: bool = False, back: bool = False) -> Automaton:
    """One automaton for ``(pattern, ignore case)`` rules.

    Anchored, it follows the matches that begin at the first byte. With ``anywhere`` a match may begin at every byte, and
    all states in which some rule has ended are one that is never left: it tells whether a text holds a match at all. With
    ``back`` it reads a text from its end: its state at a byte tells the rules that some match of begins there.
    """
    nfa = _Nfa()
    start = nfa.state()
    final = {}
    for rule, (pattern, fold) in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        end = nfa.add(begin, _parser.parse(pattern, IGNORECASE if fold else 0), fold, back)
        final.setdefault(end, 0)
        final[end] |= 1 << rule
    safe = ~np.array([allowed for edges in nfa.edges for allowed, _ in edges]).any(axis=0)
    if anywhere or back:
        nfa.edges[start].append((np.ones(256, bool), start))
    used = np.array([allowed for edges in nfa.edges for allowed, _ in edges])
    groups, klass = np.unique(used, axis=1, return_inverse=True)
    klass = klass.reshape(-1)
    byte_of = [int(np.flatnonzero(klass == k)[0]) for k in range(groups.shape[1])]

    # subset construction
    first, over = nfa.closure([start]), frozenset([-1])
    number, order, rows = {first: 0}, [first], []
    final[-1] = 1
    for states in order:
        row = []
        for byte in byte_of:
            to = states if states is over else nfa.closure([t for s in states for allowed, t in nfa.edges[s] if allowed[byte]])
            if anywhere and any(s in final for s in to):
                to = over
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    step = np.array(rows, np.int32)
    ends = np.array([_union(final.get(s, 0) for s in states) for states in order], np.int64)

    # minimisation: split classes of states until each class agrees on where its bytes lead
    block = np.unique(ends, return_inverse=True)[1].reshape(-1)
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    keep = np.unique(block, return_index=True)[1]
    names = np.full(block.max() + 1, -1)
    names[block[0]] = 0
    rest = [b for b in range(len(keep)) if b != block[0]]
    names[rest] = np.arange(1, len(keep))
    picked = keep[np.argsort(names)]
    step, ends = names[block[step[picked]]].astype(np.int32), ends[picked]
    dead = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (ends == 0))
    return Automaton(klass.astype(np.uint8), step, ends, int(dead[0]) if len(dead) else -1, safe)


def _union(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out


def cut(data: np.ndarray, offsets: np.ndarray, safe: np.ndarray, size: int) -> np.ndarray:
    """Borders of segments: every text's borders, and in long texts the place behind the next ``safe`` byte after each
    ``size`` bytes. A stretch without such a byte stays whole."""
    borders = offsets[:-1][np.diff(offsets) > 0]
    if len(data) > size:
        places = np.flatnonzero(safe[data]) + 1
        inner = np.searchsorted(places, np.arange(size, len(data), size))
        borders = np.union1d(borders, places[np.unique(inner[inner < len(places)])])
    return np.append(borders[borders < len(data)], len(data))


def scan(machine: Automaton, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Whether each segment holds a match: one pass of an ``anywhere`` automaton, all segments in step."""
    lengths = np.diff(borders)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = borders[:-1][order], lengths[order]
    wide = machine.step.shape[1]
    step = (machine.step * wide).ravel()
    classes = machine.klass[data]
    state = np.zeros(len(starts), np.int32)
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
    for t, n in enumerate(live):
        state[:n] = step.take(state[:n] + classes.take(starts[:n] + t), mode="clip")
    found = np.zeros(len(starts), bool)
    found[order] = machine.ends[state // wide] != 0
    return found


def open_rules(machine: Automaton) -> np.ndarray:
    """For each state of an anchored automaton the bit set of rules that can still end, here or further on."""
    bits = machine.ends.copy()
    while True:
        more = bits | np.bitwise_or.reduce(bits[machine.step], axis=1)
        if (more == bits).all():
            return bits
        bits = more


def spans(machine: Automaton, behind: Automaton, text: bytes, rules: int) -> list[tuple[int, int, int]]:
    """``(rule, start, end)`` of the leftmost, longest, non-overlapping matches of each rule.

    ``behind``, the rules compiled with ``back``, marks in one pass from the end where matches of which rules begin; the
    anchored ``machine`` then goes forward from marked places only, for the rules whose last match ends before, and only as
    long as one of them can still end. So bytes inside a match are not gone through again for each of its suffixes.
    """
    step, klass = behind.step.tolist(), text.translate(bytes(behind.klass.tolist()))
    ends = behind.ends.tolist()
    marks = [0] * len(text)
    state = 0
    for at in range(len(text) - 1, -1, -1):
        state = step[state][klass[at]]
        marks[at] = ends[state]
    step, klass, ends, open_ = machine.step.tolist(), text.translate(bytes(machine.klass.tolist())), machine.ends.tolist(), open_rules(machine).tolist()
    free = [0] * rules
    found = []
    for begin, mark in enumerate(marks):
        if not mark:
            continue
        wanted = [rule for rule in range(rules) if mark >> rule & 1 and begin >= free[rule]]
        if not wanted:
            continue
        bits = sum(1 << rule for rule in wanted)
        state, at, last = 0, begin, {}
        while at < len(text):
            state = step[state][klass[at]]
            at += 1
            if ends[state] & bits:
                for rule in wanted:
                    if ends[state] >> rule & 1:
                        last[rule] = at
            if not open_[state] & bits:
                break
        for rule, end in last.items():
            free[rule] = end
            found.append((rule, begin, end))
    return found
