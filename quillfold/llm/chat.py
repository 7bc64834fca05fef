"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn ``### role: text </turn>`` and a line end. Backslashes, ``#`` and ``<``
inside texts and roles (and ``:`` and line ends inside roles) get a backslash before them, so control strings cannot be
forged and texts come back exactly. The rendered conversation is encoded once, with offsets; tokens tile it, each
reaching to where the next begins. Turn spans and token spans are both sorted, so their intersections are found by binary
search. A token that straddles the edge of a turn is in the mask with the part that belongs to the turn.

Defined cases: a null text or role is empty; rows of a conversation are ordered by turn, then role, then text; rows
without conv_id are one conversation; an empty table gives an empty result; other columns are ignored. A conversation is
encoded as one text, so it must fit in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder, tokenizer_path
from .work import prepare

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLES = ("assistant",)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"([\\#<{also}])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the spans in it of the (escaped) texts that count for the loss."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape(role, ":\n") + AFTER_ROLE, escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a rendered conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def intersect(starts: np.ndarray, total: int, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, start, end) of each overlap of a token with a span; tokens begin at ``starts`` and tile the text."""
    ends = np.append(starts[1:], total)
    rows = []
    for a, b in spans:
        if a == b:
            continue
        first = int(np.searchsorted(ends, a, side="right"))
        last = int(np.searchsorted(starts, b, side="left"))
        token = np.arange(first, last)
        lo, hi = np.maximum(starts[first:last], a), np.minimum(ends[first:last], b)
        rows.append((token, lo, hi))
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*rows))


def format_conversations(rows: DataFrame, path: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, n_turns, formatted, ids, loss_mask (a byte for each token), loss_tokens, loss_starts, loss_ends.

    ``loss_starts`` and ``loss_ends`` are the code points of ``formatted`` that each token of ``loss_tokens`` answers for.
    """
    prepare(rows.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    key = whole.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, True, special_as_text=True).tokenizer
        for full in batches:
            for lo in range(0, full.num_rows, 64):
                batch = full.slice(lo, 64)
                lists = batch.column(1).to_pylist()
                rendered = [render([(t["role"], t["text"]) for t in turns], loss_roles) for turns in lists]
                out = [[] for _ in range(6)]
                for (formatted, spans), e in zip(rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                    starts = np.maximum.accumulate(np.array([0, *(a for a, _ in e.offsets[1:])], dtype=np.int64)) if e.ids else np.zeros(0, dtype=np.int64)
                    token, a, b = intersect(starts, len(formatted), spans)
                    mask = np.zeros(len(e.ids), dtype=np.int8)
                    mask[token[b > a]] = 1
                    for col, x in zip(out, (formatted, e.ids, mask, token[b > a], a[b > a], b[b > a])):
                        col.append(x)
                ints = pa.list_(pa.int32())
                kinds = (pa.string(), ints, pa.list_(pa.int8()), ints, ints, ints)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in lists], pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    names = ["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_tokens", "loss_starts", "loss_ends"]
    return whole.mapInArrow(run, f"conv_id {key}, n_turns long, formatted string, ids array<int>, loss_mask array<tinyint>, loss_tokens array<int>, loss_starts array<int>, loss_ends array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) parsed from the rendering, and loss_text: what the mask's tokens answer for, unescaped."""
    prepare(formatted.sparkSession)
    key = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, loss = [], []
            for f, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                turns.append([{"role": r, "text": t} for r, t in parse(f)])
                loss.append(unescape("".join(f[a:b] for a, b in zip(starts, ends))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())], names=["conv_id", "turns", "loss_text", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, f"conv_id {key}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")


def digest(back: DataFrame) -> DataFrame:
    """The contract's columns."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(regexp_replace(text, '[\\#<]', '\\\0', 'g')) + 9
    + length(regexp_replace(role, '[\\#<:\n]', '\\\0', 'g')) - length(role)) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
