"""Chat formatting with loss masks that are aligned to token offsets.

A conversation is rendered whole; each part of it is encoded once, with
offsets, and the sorted spans of the turns are intersected with the sorted
token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import frame, has_long_blank, map_frames
from weftgraph.llm.packing import PATTERN, byte_ranks

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SCHEMA = (
    "conv_id long, part long, whole boolean, text string, input_ids array<int>, loss_mask array<boolean>, "
    "token_start array<int>, token_end array<int>, turn_start array<int>, turn_end array<int>, turn_role array<string>"
)
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\+)\|")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


@dataclass(frozen=True)
class ChatParams:
    """``tokenizer`` is a file of the tokenizers library. A part ends at the first turn end past ``part_chars``."""

    tokenizer: str
    loss_roles: tuple[str, ...] = ("assistant",)
    part_chars: int = 1 << 17


def escape(text: str) -> str:
    """One more backslash into every ``<\\...|``, so that no marker occurs in a text."""
    return _PLAIN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1][1:] + "|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the span of each turn's escaped text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        out += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURNS.finditer(text)]


def load_tokenizer(path: str):
    """The tokenizer with the three markers as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return tok


class OffsetEncoder:
    """Ids and character spans of a text's tokens, markers included.

    Where the vocabulary allows it, ids come from the faster library, and
    spans from the tokens' lengths in bytes: a token spans all characters of
    which it holds a byte. Else both come from the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.tok, self.fast, ranks = load_tokenizer(path), None, byte_ranks(path)
        if ranks is not None:
            import tiktoken

            whole = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("marked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=whole)
            self.width = np.zeros(max([*ranks.values(), *whole.values()]) + 1, dtype=np.int64)
            for token, i in [*ranks.items(), *((t.encode(), i) for t, i in whole.items())]:
                self.width[i] = len(token)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n) ids and (n, 2) spans."""
        if self.fast is None or has_long_blank(text):
            enc = self.tok.encode(text, add_special_tokens=False)
            return np.array(enc.ids, dtype="int32"), np.array(enc.offsets, dtype="int32").reshape(-1, 2)
        ids = self.fast.encode_to_numpy(text, allowed_special="all").astype("int32")
        ends = np.cumsum(self.width[ids])
        starts = ends - self.width[ids]
        if not text.isascii():
            begun = np.cumsum(np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80)  # characters begun up to each byte
            starts, ends = begun[starts] - 1, begun[ends - 1]
        return ids, np.column_stack([starts, ends]).astype("int32")


_ENCODERS: dict[str, OffsetEncoder] = {}


def encoder(path: str) -> OffsetEncoder:
    """One a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = OffsetEncoder(path)
    return _ENCODERS[path]


def mask_tokens(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the sorted token spans (n, 2) overlap one of the sorted, disjoint spans (m, 2)."""
    if not len(tokens) or not len(spans):
        return np.zeros(len(tokens), bool)
    first = np.searchsorted(spans[:, 1], tokens[:, 0], side="right")  # the first span that ends after the token begins
    ok = first < len(spans)
    return ok & (spans[np.minimum(first, len(spans) - 1), 0] < tokens[:, 1])


def masked_pieces(text: str, tokens: np.ndarray, mask: np.ndarray) -> list[str]:
    """The runs of text that the masked tokens cover, unescaped."""
    kept = tokens[mask]
    if not len(kept):
        return []
    # a character of several tokens gives each of them its whole span
    upto = np.maximum.accumulate(kept[:, 1])
    new = np.r_[True, kept[1:, 0] > upto[:-1]]
    starts, ends = kept[new, 0], upto[np.r_[np.flatnonzero(new)[1:] - 1, len(kept) - 1]]
    return [unescape(text[a:b]) for a, b in zip(starts, ends)]


def format_conversations(rows: DataFrame, params: ChatParams, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a part of a conversation (see ``SCHEMA``); its parts by ascending ``part`` are its text.

    Turns are taken by (turn, role, text), nulls first; a null role or text is
    empty; a null conversation id is a conversation. Repeated rows are turns of
    their own; an empty table gives an empty one. Columns other than the four
    are ignored, whatever their names. Rows are dealt into
    ranges of (conversation, turn), so a conversation of any length is spread
    over tasks; it is cut where a range ends and at the first turn end past
    ``part_chars``. Markers are tokens of their own, so cuts at turn ends
    change no token. ``whole`` says that a part is all of its conversation (a
    conversation at the edge of a range says false, cut or not).
    """
    picked = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the beginning of the text is enough for the ranges and keeps their sample small
    ordered = picked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(params.tokenizer)
        out: list[tuple] = []
        held: list[tuple[str, str]] = []
        key, part, chars, ready, first = None, 0, 0, 0, True
        base = TaskContext.get().partitionId() << 32  # ranges are numbered in order

        def flush(closed: bool) -> None:
            nonlocal part, chars, ready
            formatted, spans = render(held)
            ids, offsets = encode(formatted)
            of_loss = np.array([s for s, t in zip(spans, held) if t[0] in params.loss_roles and s[1] > s[0]], dtype="int32").reshape(-1, 2)
            mask = mask_tokens(offsets, of_loss)
            whole = closed and part == 0 and not first
            out.append((key, base + part, whole, formatted, ids, mask, offsets[:, 0], offsets[:, 1], [s[0] for s in spans], [s[1] for s in spans], [t[0] for t in held]))
            held.clear()
            part, chars, ready = part + 1, 0, ready + len(formatted)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        begun = False
        for pdf in batches:
            for k, r, t in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                k = None if pd.isna(k) else int(k)
                if not begun:
                    key, begun = k, True
                elif key != k:
                    if held:
                        flush(closed=True)
                    key, part, chars, first = k, 0, 0, False
                held.append((r, t))
                chars += len(t)
                if chars >= params.part_chars:
                    flush(closed=False)
                if len(out) >= 512 or ready >= 1 << 22:
                    yield frame(out, names)
                    out, ready = [], 0
        if held:
            flush(closed=False)
        if out:
            yield frame(out, names)

    return map_frames(ordered, run, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
PIECE = "conv_id long, part long, whole boolean, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(parts: DataFrame) -> DataFrame:
    """What each part says (``PIECE``): its turns, and all text under its loss mask, unescaped; of whole conversations only their SHA-256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                said = parse(row.text)
                mask = np.asarray(row.loss_mask, dtype=bool)
                spans = np.column_stack([np.asarray(row.token_start, "int64"), np.asarray(row.token_end, "int64")]).reshape(-1, 2)
                loss = "".join(masked_pieces(row.text, spans, mask))
                held = ["".join(f"{r}\n{t}\n" for r, t in said).encode(), loss.encode()]
                if row.whole:
                    held = [hashlib.sha256(x).digest() for x in held]
                key = None if pd.isna(row.conv_id) else int(row.conv_id)
                out.append((key, row.part, row.whole, len(said), held[0], len(loss), held[1], len(row.text), len(mask), int(mask.sum())))
            yield frame(out, names)

    return map_frames(parts, run, PIECE)


def digests(parts: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted parts in any order (``DIGEST``).

    Whole conversations are finished where they are read. The pieces of the
    others meet in order of ``part``; SHA-256 takes its input in sequence, so
    one task streams a cut conversation through the hash, a piece at a time.
    """
    # the row itself is small unless a conversation was cut
    dealt = read_back(parts).repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, names = None, [x.split()[0] for x in DIGEST.split(", ")]
        close = lambda c: (c["id"], c["sums"][0], c["turns"].hexdigest(), c["sums"][1], c["loss"].hexdigest(), *c["sums"][2:])
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key = None if pd.isna(row.conv_id) else int(row.conv_id)
                if row.whole:
                    out.append((key, row.n_turns, row.turns.hex(), row.loss_chars, row.loss.hex(), row.formatted_chars, row.n_tokens, row.loss_tokens))
                    continue
                if cur is None or cur["id"] != key:
                    if cur:
                        out.append(close(cur))
                    cur = {"id": key, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "sums": [0] * 5}
                cur["turns"].update(row.turns)
                cur["loss"].update(row.loss)
                cur["sums"] = [a + b for a, b in zip(cur["sums"], (row.n_turns, row.loss_chars, row.formatted_chars, row.n_tokens, row.loss_tokens))]
            if out:
                yield frame(out, names)
        if cur:
            yield frame([close(cur)], names)

    return map_frames(dealt, run, DIGEST)
