"""Chat formatting with an offset-aligned loss mask.

A turn becomes ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks shown). A
conversation is rendered whole and encoded once, with character offsets; the sorted
spans of the turns to be learned are then intersected with the sorted token spans by
binary search. Nothing is encoded turn by turn, so tokens are those a model would see.

Control strings inside a role or text gain one backslash (``<|`` becomes ``<\\|``, and
``<\\|`` becomes ``<\\\\|``), so the rendered string has no ``<|`` but the template's own,
and reading back removes exactly one.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import AddedToken, Tokenizer

from fieldloom.llm.common import asset

START, END = "<|im_start|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LEARNED_ROLES = ("assistant",)

_OPEN = re.compile(r"<(\\*)\|")
_CLOSE = re.compile(r"<\\(\\*)\|")

RESULT = StructType(
    [
        StructField("formatted", StringType()),
        StructField("input_ids", ArrayType(IntegerType())),
        StructField("token_start", ArrayType(IntegerType())),
        StructField("token_end", ArrayType(IntegerType())),
        StructField("loss_mask", ArrayType(BooleanType())),
        StructField("span_start", ArrayType(IntegerType())),
        StructField("span_end", ArrayType(IntegerType())),
        StructField("n_turns", LongType()),
    ]
)


def escape(s: str) -> str:
    return _OPEN.sub(r"<\\\1|", s)


def unescape(s: str) -> str:
    return _CLOSE.sub(r"<\1|", s)


def escape_role(s: str) -> str:
    """A role stands on one line: backslashes and line ends are written out."""
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def render(turns: list[tuple[str, str]], learned=LEARNED_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the ascending spans of the texts to be learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        begin = at + len(head)
        if role in learned:
            spans.append((begin, begin + len(body)))
        parts += (head, body, END, "\n")
        at = begin + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for piece in formatted.split(START)[1:]:
        head, _, rest = piece.partition("\n")
        turns.append((unescape_role(head), unescape(rest[: rest.rindex(END)])))
    return turns


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token [start, end) shares a character with a span; spans are ascending
    and disjoint. The first span that ends after the token's start decides."""
    filled = [(a, b) for a, b in spans if b > a]
    if not filled:
        return np.zeros(len(starts), bool)
    begin, close = np.array(filled).T
    first = np.searchsorted(close, starts, side="right")
    known = first < len(close)
    return known & (begin[np.minimum(first, len(begin) - 1)] < ends) & (ends > starts)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans) -> list[str]:
    """What the masked tokens cover of each span, unescaped. Tokens that touch or overlap
    (those of one character in several bytes share its offsets) are one run, so a character
    is taken once."""
    s, e = starts[mask], ends[mask]
    reach = np.maximum.accumulate(e) if len(e) else e
    opens = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]])) if len(s) else np.zeros(0, np.int64)
    begin = s[opens].tolist()
    close = reach[np.append(opens[1:], len(s)) - 1].tolist() if len(s) else []
    out, r = [], 0
    for a, b in spans:
        parts = []
        while r < len(begin) and close[r] <= a:
            r += 1
        i = r
        while i < len(begin) and begin[i] < b:
            parts.append(formatted[max(a, begin[i]) : min(b, close[i])])
            i += 1
        out.append(unescape("".join(parts)))
    return out


@lru_cache(2)
def load(model: bytes) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the rows
    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (START, END)])
    return tokenizer


SCHEMA = pa.schema(
    [("formatted", pa.string())]
    + [(c, pa.list_(pa.int32())) for c in ("input_ids", "token_start", "token_end")]
    + [("loss_mask", pa.list_(pa.bool_()))]
    + [(c, pa.list_(pa.int32())) for c in ("span_start", "span_end")]
    + [("n_turns", pa.int64())]
)
"""Columns that formatting gives behind the conversation's id."""
BATCH_CHARS = 1 << 20
"""Rendered characters per batch handed on, unless a single conversation is longer."""


def encode(tokenizer: Tokenizer, turns: list[dict], learned) -> dict:
    """One conversation rendered, encoded and masked."""
    formatted, spans = render([(t["role"], t["text"]) for t in turns], learned)
    got = tokenizer.encode(formatted, add_special_tokens=False)
    at = np.fromiter(itertools.chain.from_iterable(got.offsets), np.int32, 2 * len(got)).reshape(-1, 2)
    return {
        "formatted": formatted,
        "input_ids": np.array(got.ids, np.int32),
        "token_start": at[:, 0],
        "token_end": at[:, 1],
        "loss_mask": token_mask(at[:, 0], at[:, 1], spans),
        "span_start": [a for a, _ in spans],
        "span_end": [b for _, b in spans],
        "n_turns": len(turns),
    }


def encoded(batches: Iterator[pa.RecordBatch], model, learned) -> Iterator[tuple[pa.Array, list[dict]]]:
    """(ids, rows) of conversations (id, turns), in small batches."""
    tokenizer = load(model.value)
    for batch in batches:
        rows, lo, size = [], 0, 0
        for i, turns in enumerate(batch.column(1)):
            rows.append(encode(tokenizer, turns.as_py(), learned))
            size += len(rows[-1]["formatted"])
            if size > BATCH_CHARS:
                yield batch.column(0)[lo : i + 1], rows
                rows, lo, size = [], i + 1, 0
        if rows:
            yield batch.column(0)[lo:], rows


def conversations(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns): the rows of a conversation in the order of turn, role and text."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return turns.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: tuple[str, ...] = LEARNED_ROLES,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(conv_col, formatted, input_ids, token_start, token_end, loss_mask, span_start, span_end, n_turns).

    One row per conversation, null included; its rows in the order of turn, role and text,
    nulls first, repeated rows kept. A null role or text is empty. Rows of one conversation
    meet in one task, since a rendered conversation is one string. Other columns are ignored.
    """
    model = asset(turns.sparkSession, tokenizer)
    whole = conversations(turns, conv_col, turn_col, role_col, text_col)

    def run(batches):
        for ids, rows in encoded(batches, model, learned):
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in SCHEMA]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["conv", *SCHEMA.names])

    done = whole.mapInArrow(run, StructType([whole.schema["conv"], *RESULT]))
    return done.withColumnRenamed("conv", conv_col)


def digest(row: dict) -> dict:
    """Figures of a conversation read back from its rendered string and token mask."""
    spans = list(zip(row["span_start"], row["span_end"]))
    learned = "".join(masked_text(row["formatted"], row["token_start"], row["token_end"], row["loss_mask"], spans))
    turns = parse(row["formatted"])
    whole = "".join(f"{role}\n{said}\n" for role, said in turns)
    return {
        "n_turns": len(turns),
        "turns_sha256": sha256(whole.encode()).hexdigest(),
        "loss_chars": len(learned),
        "loss_sha256": sha256(learned.encode()).hexdigest(),
        "formatted_chars": len(row["formatted"]),
        "n_tokens": len(row["input_ids"]),
    }


def digest_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: tuple[str, ...] = LEARNED_ROLES,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens):
    what ``format_conversations`` gives, read back in the task that made it."""
    model = asset(turns.sparkSession, tokenizer)
    whole = conversations(turns, conv_col, turn_col, role_col, text_col)
    fields = [StructField(c, StringType() if "sha" in c else LongType()) for c in DIGESTS]

    def run(batches):
        for ids, rows in encoded(batches, model, learned):
            got = [digest(r) for r in rows]
            columns = [pa.array([g[c] for g in got], pa.string() if "sha" in c else pa.int64()) for c in DIGESTS]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["conv", *DIGESTS])

    done = whole.mapInArrow(run, StructType([whole.schema["conv"], *fields]))
    return done.withColumnRenamed("conv", conv_col)


DIGESTS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")
