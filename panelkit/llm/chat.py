"""Chat formatting: records of many layouts recognized by their fingerprint, brought to turns, and written in one template.

A record's fingerprint is a hash of its nested field paths (fields that are null left out, list items as one). A table of
declarative mappings, by fingerprint, says where the turns lie; records without a mapping are reported, not guessed at.
The template marks each turn; control strings inside roles and texts are escaped by a backslash behind their first
character, reversibly, so a text can never open or close a turn.
"""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelkit.llm.common import ship

TURNS = "array<struct<role:string,text:string>>"
#: The template's marks, and control strings of public chat templates that texts must not hold either.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"
_ESCAPE = re.compile("(?:" + "|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROLS) + ")")
_UNESCAPE = re.compile("(?:" + "|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROLS) + ")")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + MIDDLE + r"(.*?)" + re.escape(CLOSE), re.DOTALL)


# ---------------------------------------------------------------- layouts

@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: ``each`` names a list whose items hold ``role`` and ``text`` fields, or ``turns`` lists
    ``(role, path)`` pairs in order; several paths of one turn are joined by a blank line. ``roles`` renames roles."""

    paths: tuple[str, ...]
    each: str | None = None
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: Public layouts of prompts, instructions and messages.
MAPPINGS = (
    Mapping(("messages[].content", "messages[].role"), each="messages"),
    Mapping(("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value",
            roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping(("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "response", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def field_paths(record: object, at: str = "") -> set[str]:
    """Paths of all leaves; a null field is as good as absent, and an empty list or object has only its own path."""
    if isinstance(record, dict):
        parts = [field_paths(v, f"{at}.{k}" if at else k) for k, v in record.items() if v is not None]
        return set().union(*parts) if parts else {at}
    if isinstance(record, list):
        parts = [field_paths(v, f"{at}[]") for v in record if v is not None]
        return set().union(*parts) if parts else {f"{at}[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _at(record: dict, path: str) -> str:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return "" if record is None else record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    names = dict(mapping.roles)
    if mapping.each:
        items = record.get(mapping.each) or []
        found = [(_at(i, mapping.role), _at(i, mapping.text)) for i in items if i is not None]
    else:
        found = [(role, "\n\n".join(x for x in (_at(record, p) for p in paths) if x)) for role, paths in mapping.turns]
    return [(names.get(role, role), text) for role, text in found]


def with_turns(df: DataFrame, record: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``df`` with ``layout``, the fingerprint of the JSON text in ``record``, and ``turns``.

    Text that is null or no JSON object has neither; a layout without a mapping has no turns (null). Null roles and texts
    are empty. Repeated rows are mapped alike; other columns pass through.
    """
    table = {fingerprint(m.paths): m for m in mappings}

    @F.pandas_udf(f"layout string, turns {TURNS}")
    def mapped(records: pd.Series) -> pd.DataFrame:
        rows = []
        for text in records:
            try:
                value = json.loads(text) if text is not None else None
            except ValueError:
                value = None
            if not isinstance(value, dict):
                rows.append((None, None))
                continue
            name = fingerprint(field_paths(value))
            found = table.get(name)
            rows.append((name, None if found is None else [{"role": r, "text": t} for r, t in turns_of(value, found)]))
        return pd.DataFrame(rows, columns=["layout", "turns"])

    ship(df.sparkSession)
    return df.withColumn("_mapped", mapped(F.col(f"`{record}`"))).withColumns(
        {"layout": F.col("_mapped.layout"), "turns": F.col("_mapped.turns")}).drop("_mapped")


# ---------------------------------------------------------------- template

def _join(match: re.Match, more: str) -> str:
    first, slashes, rest = [g for g in match.groups() if g is not None]
    return first + more + slashes + rest


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _join(m, "\\"), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _join(m, ""), text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def write(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points) under the loss mask: the assistant's texts."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = OPEN + _escape_role(role) + MIDDLE, escape(text)
        if role == TRAINED:
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), mask


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(_unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_mask``, an array of spans; null turns give null, no turns an empty text."""

    @F.pandas_udf("formatted string, loss_mask array<struct<start:int,end:int>>")
    def make(column: pd.Series) -> pd.DataFrame:
        rows = []
        for row in column:
            if row is None:
                rows.append((None, None))
                continue
            text, mask = write((t["role"] or "", t["text"] or "") for t in row)
            rows.append((text, [{"start": a, "end": b} for a, b in mask]))
        return pd.DataFrame(rows, columns=["formatted", "loss_mask"])

    ship(df.sparkSession)
    return df.withColumn("_made", make(F.col(turns))).withColumns(
        {"formatted": F.col("_made.formatted"), "loss_mask": F.col("_made.loss_mask")}).drop("_made")


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with ``turns_read``, parsed from ``formatted``, and ``loss_text``: the unescaped text under the mask."""

    @F.pandas_udf(f"turns_read {TURNS}, loss_text string")
    def parse(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, mask in zip(texts, masks):
            if text is None:
                rows.append((None, None))
                continue
            rows.append(([{"role": r, "text": t} for r, t in read(text)],
                         "".join(unescape(text[s["start"]:s["end"]]) for s in mask)))
        return pd.DataFrame(rows, columns=["turns_read", "loss_text"])

    ship(df.sparkSession)
    return df.withColumn("_read", parse("formatted", "loss_mask")).withColumns(
        {"turns_read": F.col("_read.turns_read"), "loss_text": F.col("_read.loss_text")}).drop("_read")


# ---------------------------------------------------------------- rows of turns as records

def records(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, record)``: the conversations of a table of turns as JSON in the layouts they would be published in: two
    turns, user and assistant, as prompt and response; with a system turn in front as that and both; others as messages.

    Turns are in order of their number, rows with one number in order of role and text. A null role or text is empty.
    """
    part = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    whole = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(part)).alias("t"))
    roles, at = F.transform("t", lambda x: x["role"]), lambda i: F.get("t", F.lit(i))["content"]
    layout = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response")))).when(
        roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
        F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response")))).otherwise(
        F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"], x["content"])).alias("messages"))))
    return whole.select("conv_id", layout.alias("record"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, all read back from the formatted text."""
    made = read_back(formatted(with_turns(records(turns))))
    return made.select("conv_id", F.size("turns_read").cast("long").alias("n_turns"),
                       F.sha2(_joined(F.col("turns_read")), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


#: The digests straight from the turns (roles there hold no control strings).
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text,
  '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(safe) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
