"""Best-fit packing of documents into fixed-length sequences, with swap-based local search."""

from __future__ import annotations

import bisect
import heapq
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import apply_frames, has_long_blank, map_frames
from weftgraph.plans.stage import materialize

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackParams:
    """About ``group_pieces`` pieces are packed together in one task; more fill better but take longer."""

    tokenizer: str
    length: int = 1024
    end_id: int = 2
    group_pieces: int = 40_000


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file by its bytes, if an encoder that knows it alone gives the same ids; else None.

    That is so if texts are split by ``PATTERN`` and in no other way (no
    normalizer, no prefix space, no token that texts are searched for but
    special ones), and if ids rise in the order of the merges: then merging
    the pair of smallest id is merging the first rule.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return None
    if file.get("post_processor") or file.get("truncation") or file.get("padding") or not all(t.get("special") for t in file.get("added_tokens") or ()):
        return None
    odd = ("byte_fallback", "end_of_word_suffix", "continuing_subword_prefix", "dropout", "ignore_merges", "fuse_unk")
    if model.get("type", "BPE") != "BPE" or any(model.get(x) for x in odd):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    vocab, last = model["vocab"], -1
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        if (at := vocab.get(left + right, -1)) <= last:
            return None
        last = at
    out = {bytes(stands[c] for c in t): i for t, i in vocab.items() if all(c in stands for c in t)}
    return {t: i for t, i in out.items() if i <= last}


class Encoder:
    """The ids of a tokenizer file, by the faster of two libraries that gives the same ones."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        self.slow = lambda text: tok.encode(text, add_special_tokens=False).ids
        self.fast, ranks = self.slow, byte_ranks(path)
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        return (self.slow if has_long_blank(text) else self.fast)(text)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return np.array(self.ids(text), dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, params: PackParams, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: whole documents, or pieces of which only the first is short.

    A null text is empty; every document ends with the end id, so none is
    empty. Null ids stay null; repeated rows are packed each; an empty table
    gives no pieces. Texts may be of any length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(params.tokenizer), np.uint32(params.end_id).tobytes()
        n = params.length
        for pdf in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for k, t in zip(pdf["doc_id"], pdf["text"]):
                raw = enc.encode(t or "") + end
                total = len(raw) // 4
                at, first = 0, total % n or n
                for p in range(-(-total // n)):
                    size = first if p == 0 else n
                    ids.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at += size
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_frames(picked, run, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of piece numbers by best-fit decreasing; among equal bins the earliest made."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = _Rooms(size)
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        room = rooms.at_least(need)
        if room is None:
            bins.append([int(i)])
            b, left = len(bins) - 1, size - need
        else:
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.off(room)
            bins[b].append(int(i))
            left = room - need
        if left:
            if not by_room[left]:
                rooms.on(left)
            by_room[left].append(b)
    return bins


class _Rooms:
    """The smallest room that occurs and is at least so large: one big integer of bits."""

    def __init__(self, size: int) -> None:
        self.bits = 0

    def on(self, room: int) -> None:
        self.bits |= 1 << room

    def off(self, room: int) -> None:
        self.bits &= ~(1 << room)

    def at_least(self, need: int) -> int | None:
        rest = self.bits >> need
        return need + (rest & -rest).bit_length() - 1 if rest else None


class _Tops:
    """For each key the roomiest bin that has it: heaps whose stale entries are dropped when they come up."""

    def __init__(self, keys: int, live: dict[int, int]) -> None:
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(keys)]
        self.room = np.zeros(keys, dtype=np.int64)
        self.live = live  # the version of each bin that is in the index

    def add(self, keys: list[int], bin: int, room: int) -> None:
        entry = (-room, bin, self.live[bin])
        for k in keys:
            heapq.heappush(self.heaps[k], entry)
            if room > self.room[k]:
                self.room[k] = room

    def clean(self, keys: list[int]) -> None:
        for k in keys:
            heap = self.heaps[k]
            while heap and self.live.get(heap[0][1]) != heap[0][2]:
                heapq.heappop(heap)
            self.room[k] = -heap[0][0] if heap else 0

    def bin(self, key: int) -> int:
        return self.heaps[key][0][1]


class _Underfull:
    """The bins with room, indexed by the lengths and by the sums of two lengths that they hold."""

    def __init__(self, size: int, lengths: np.ndarray) -> None:
        self.size, self.lengths = size, lengths
        self.items: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.keys: dict[int, tuple[list[int], list[int]]] = {}
        self.live: dict[int, int] = {}
        self.stamp = 0
        self.one, self.two = _Tops(size + 1, self.live), _Tops(size + 1, self.live)
        self.by_room: list[tuple[int, int, int]] = []  # heap: emptiest first
        self.tight: list[tuple[int, int]] = []  # sorted (room, bin)

    def put(self, bin: int, items: list[int], room: int) -> None:
        """Into the index; full bins stay out, as nothing can be gained with them."""
        self.items[bin], self.room[bin] = items, room
        if not room:
            return
        self.stamp += 1
        self.live[bin] = self.stamp
        held, count = np.unique(self.lengths[items], return_counts=True)
        sums = np.unique(np.concatenate([(held[:, None] + held[None, :])[np.triu_indices(len(held), 1)], 2 * held[count > 1]]))
        self.keys[bin] = (held.tolist(), sums.tolist())
        self.one.add(self.keys[bin][0], bin, room)
        self.two.add(self.keys[bin][1], bin, room)
        heapq.heappush(self.by_room, (-room, bin, self.stamp))
        bisect.insort(self.tight, (room, bin))

    def out(self, bin: int) -> tuple[list[int], int]:
        """Out of the index."""
        if self.live.pop(bin, None) is not None:
            singles, sums = self.keys.pop(bin)
            self.one.clean(singles)
            self.two.clean(sums)
            del self.tight[bisect.bisect_left(self.tight, (self.room[bin], bin))]
        return self.items.pop(bin), self.room.pop(bin)

    def emptiest(self) -> int | None:
        heap = self.by_room
        while heap and self.live.get(heap[0][1]) != heap[0][2]:
            heapq.heappop(heap)
        return heap[0][1] if heap else None

    def exchange(self, held: list[int]) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The (bin, lengths into it, lengths out of it) that carries most tokens from ``held`` into a bin; None if there is none."""
        if not self.tight:
            return None
        most = self.tight[-1][0]
        sizes, count = np.unique(self.lengths[held], return_counts=True)
        for need in sizes[::-1].tolist():  # a whole piece, into the tightest room
            if need <= most:
                return self.tight[bisect.bisect_left(self.tight, (need, -1))][1], (need,), ()
        best: tuple | None = None  # (tokens, into, index, sum of lengths out)

        def seek(total: int, into: tuple[int, ...], tops: _Tops) -> None:
            nonlocal best
            low = max(1, total - most)
            rooms = tops.room[low:total]
            fits = rooms >= total - np.arange(low, low + len(rooms))
            if fits.any():
                out = low + int(fits.argmax())
                if best is None or total - out > best[0]:
                    best = (total - out, into, tops, out)

        listed = sizes.tolist()
        for i, x in enumerate(listed):
            seek(x, (x,), self.one)
            seek(x, (x,), self.two)
            for j in range(i if count[i] > 1 else i + 1, len(listed)):
                seek(x + listed[j], (x, listed[j]), self.one)
        if best is None:
            return None
        _, into, tops, out = best
        bin = tops.bin(out)
        if tops is self.one:
            return bin, into, (out,)
        inside = sorted(self.lengths[self.items[bin]].tolist())
        a, b = 0, len(inside) - 1
        while inside[a] + inside[b] != out:
            a, b = (a + 1, b) if inside[a] + inside[b] < out else (a, b - 1)
        return bin, into, (inside[a], inside[b])


def improve(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Local search between underfull bins until none can be emptied further.

    The emptiest bin is the source. It gives a piece to another bin, or
    exchanges one piece for a shorter one, two for one that is shorter than
    both, or one for two, always with a bin at least as full as itself, so each step raises
    the sum of squared fills; the one that carries most tokens is taken. A
    source that is empty is dropped, one that can give nothing more is set
    aside for this pass. All underfull bins are partners (they are indexed by
    the lengths, and by the sums of two lengths, that they hold). Passes are
    repeated until one changes nothing, a local optimum, or until the lower
    bound is reached.
    """
    content = {b: list(items) for b, items in enumerate(bins) if items}
    bound = -(-int(lengths.sum()) // size)
    changed = True
    while changed and len(content) > bound:
        changed, index = False, _Underfull(size, lengths)
        for b, items in content.items():
            index.put(b, items, size - int(lengths[items].sum()))
        while len(content) > bound and (source := index.emptiest()) is not None:
            held, room = index.out(source)
            while held and (found := index.exchange(held)) is not None:
                bin, into, out = found
                items, left = index.out(bin)
                for n, frm, to in [(n, held, items) for n in into] + [(n, items, held) for n in out]:
                    piece = next(i for i in frm if lengths[i] == n)
                    frm.remove(piece)
                    to.append(piece)
                moved = sum(into) - sum(out)
                index.put(bin, items, left - moved)
                content[bin], changed, room = items, True, room + moved
            content[source] = held
            if not held:
                del content[source]
    return [content[b] for b in sorted(content)]


def pack(pieces: DataFrame, params: PackParams) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``length`` tokens.

    Pieces are dealt by row number into groups of about ``group_pieces``, so
    no repeated piece, null id or empty text makes a large group; a group is
    packed in one task, so memory is bounded and groups pack side by side.
    Full pieces need no search and take a sequence each. Sequence ids are
    unique: group number times 2**32 plus the bin's place. No pieces give no
    sequences.
    """
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // params.group_pieces))
    # written numbers, so a lost task deals its rows as before
    grouped = pieces.withColumn("__g", F.pmod(F.xxhash64("__row"), F.lit(groups))).repartitionByRange(groups, "__g")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["__g"].iloc[0]) << 32
        pdf = pdf.sort_values(["length", "__row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy("int64")
        full = int((lengths >= params.length).sum())
        bins = improve(best_fit(lengths[full:], params.length), lengths[full:], params.length)
        seq, off = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64")
        seq[:full] = base + np.arange(full)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                seq[full + i], off[full + i] = base + full + b, at
                at += int(lengths[full + i])
        out = pdf.drop(columns=["__g", "__row"])
        out["sequence_id"], out["offset"] = seq, off
        return out

    return apply_frames(grouped.groupBy("__g"), run, schema)


def pack_documents(docs: DataFrame, params: PackParams, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole documents to sequences: ``pieces_of``, then ``pack``. Columns other than the two take no part, whatever their names."""
    return pack(pieces_of(docs, params, id, text), params)
