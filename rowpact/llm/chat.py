"""Chat formatting with loss masks that are aligned by offsets.

A turn is rendered as <|im_start|>ROLE<|im_sep|>TEXT<|im_end|> and a line feed. Inside roles and texts every "<|" gets a backslash
between its characters (one more where there are some), so no control string is left; unescape() takes it away again.

Conversations are rendered whole and encoded once, with the three control strings as tokens of their own. Turn spans (characters of
the texts of the trained roles) and token spans are both sorted, so a binary search gives each span's tokens, and what of
each token lies inside. No token crosses a control token, which also lets a conversation of any length pass in runs of whole
turns of about RUN_CHARS: the tokens are those of the whole. So a conversation that holds a third of all rows is never in
memory at once; runs carry their number, and offsets count from the conversation's start.

Defined cases: null texts and roles are empty; a null conversation id is a conversation; rows are ordered by turn (null first), then role,
then text; rows that repeat are turns each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER = "byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = ("assistant",)
RUN_CHARS = 1 << 18


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, np.ndarray]:
    """The text of the turns (role, text), and the spans of it that are trained on, as rows of start and end."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition(SEP)
        turns.append((unescape(role), unescape(rest.rpartition(END)[0])))
    return turns


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token (sorted offsets: start, end) has characters of a span (sorted, apart)."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    change = np.zeros(len(offsets) + 1, np.int64)
    full = spans[:, 0] < spans[:, 1]
    np.add.at(change, first[full], 1)
    np.add.at(change, last[full], -1)
    return np.cumsum(change[:-1]) > 0


def masked(text: str, offsets: np.ndarray, on: np.ndarray) -> list[str]:
    """What stands under the mask, in runs of tokens that touch or overlap (bytes of a character share its offsets)."""
    out, begun, end = [], None, None
    for a, b in offsets[on].tolist():
        if begun is not None and a <= end:
            end = max(end, b)
            continue
        if begun is not None:
            out.append(text[begun:end])
        begun, end = a, b
    if begun is not None:
        out.append(text[begun:end])
    return out


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer with the control strings as tokens; one for each worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].add_special_tokens([START, SEP, END])
    return _tokenizers[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def format_chats(rows: DataFrame, path: str | None = None, trained: tuple[str, ...] = TRAINED, conversation: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", run_chars: int = RUN_CHARS) -> DataFrame:
    """conv_id, run (from 0), at (characters in the runs before), text, ids, starts, ends (tokens' characters in text), loss (a flag
    for each token)."""
    path = path or tokenizer_path()
    turns = rows.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                        F.coalesce(text, F.lit("")).alias("text"))

    def encoded(conv, run, at, held):
        whole, spans = render(held, trained)
        got = tokenizer(path).encode(whole, add_special_tokens=False)
        offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
        return (conv, run, at, whole, np.array(got.ids, np.int32), offsets[:, 0].astype(np.int32), offsets[:, 1].astype(np.int32), mask(offsets, spans))

    def batch_of(out):
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                          ["conv_id", "run", "at", "text", "ids", "starts", "ends", "loss"])

    def go(batches):
        conv, run, at, held, chars, out, ready = None, 0, 0, [], 0, [], 0  # a null id is None too, and comes first
        for batch in batches:
            for c, r, t in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if held and (c != conv or chars >= run_chars):
                    out.append(encoded(conv, run, at, held))
                    ready += chars
                    run, at, held, chars = run + 1, at + len(out[-1][3]), [], 0
                    if ready >= run_chars:
                        yield batch_of(out)
                        out, ready = [], 0
                if c != conv:
                    conv, run, at = c, 0, 0
                held.append((r, t))
                chars += len(r) + len(t)
        if held:
            out.append(encoded(conv, run, at, held))
        if out:
            yield batch_of(out)

    # Sorted by Spark, which spills; the task streams over the turns.
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(go, "conv_id long, run long, at long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def digests(runs: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the runs of conversations."""
    def go(batches):
        conv, begun, state = None, False, None

        def row():
            return (conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["at"])

        for batch in batches:
            out = []
            lists = {n: batch.column(n) for n in ("starts", "ends", "loss")}
            heads = zip(*(batch.column(n).to_pylist() for n in ("conv_id", "at", "text")), strict=True)
            for k, x in enumerate({"conv_id": c, "at": a, "text": t} for c, a, t in heads):
                if not begun or x["conv_id"] != conv:
                    if begun:
                        out.append(row())
                    conv, begun = x["conv_id"], True
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "at": 0}
                if x["at"] != state["at"]:
                    raise ValueError(f"a run of conversation {conv} is missing")
                state["at"] += len(x["text"])
                for role, text in parse(x["text"]):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                starts, ends, loss = (lists[n][k].values.to_numpy(zero_copy_only=False) for n in ("starts", "ends", "loss"))
                for part in masked(x["text"], np.stack([starts, ends], 1), loss.astype(bool)):
                    part = unescape(part)
                    state["chars"] += len(part)
                    state["loss"].update(part.encode())
            if out:
                yield _digest_batch(out)
        if begun:
            yield _digest_batch([row()])

    ordered = runs.repartition("conv_id").sortWithinPartitions("conv_id", "run")
    return ordered.mapInArrow(go, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                      ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
