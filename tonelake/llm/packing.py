"""Best-fit packing of documents into sequences, merged up a tree.

Each task tokenizes its documents, cuts those over the capacity and packs the
pieces best-fit, longest first. Bins that are nearly full are final; a bin that
is not is opened again, so that its pieces go up as items of their own. Groups
of items, drawn from all tasks, are packed best-fit again. Every round keeps its
nearly full bins, or more of the fullest until half of its items are placed,
and opens the others for the next one; the last round has a single group and
keeps all. A group has a bounded number of items, each two numbers, however
large the corpus is.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, mix, slices, utf8

CAPACITY = 2048
#: A task's bin with at most so much room is nearly full, and final.
NEARLY = 2
#: Items packed at once in a task, and in a group of a merge round.
BLOCK, GROUP = 1 << 16, 1 << 15
#: Units of text that a task remembers, ids that it holds for them, and units looked up at once.
REMEMBERED, HELD, AT_ONCE = 200_000, 1 << 21, 1 << 17

PIECES = "doc_id {key}, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin (from 0), its place there, and the bin's fill.

    Open bins are kept by the room they have; the bits of one integer say which
    rooms occur, so the tightest that fits is found in one step.
    """
    n = len(lengths)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, made = 0, 0
    fills: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fitting = present >> need
        if fitting:
            r = need + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                present &= ~(1 << r)
        else:
            b, r = made, capacity
            made += 1
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += need
        if left := r - need:
            room[left].append(b)
            present |= 1 << left
    return bins, places, np.array(fills, np.int64)[bins] if n else np.zeros(0, np.int64)


# What a byte is to the splitting of words: a space, a letter, a digit, a sign, an apostrophe, or part of another character.
_SPACE, _LETTER, _DIGIT, _SIGN, _QUOTE, _WIDE = range(6)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _SIGN, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = _SPACE
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
    kinds[0x30:0x3A], kinds[0x27], kinds[0x80:] = _DIGIT, _QUOTE, _WIDE
    return kinds


def _breaks() -> np.ndarray:
    """Whether a unit ends between two kinds of bytes; not next to a wide one, which may join what stands before it."""
    table = np.zeros((8, 8), bool)
    table[_SPACE, :] = table[:, _SPACE] = True
    table[_DIGIT, 1:_WIDE] = table[1:_WIDE, _DIGIT] = True
    table[_LETTER, [_SIGN, _QUOTE]] = table[_SIGN, _LETTER] = True  # but no letter is parted from an apostrophe before it
    return table.ravel()


KINDS, BREAKS = _byte_kinds(), _breaks()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Words of these are NFC, in small letters, and one word to the pattern.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _as_bytes() -> dict[int, str]:
    """The characters beyond ASCII of such words as the characters that stand for their bytes in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    sign = dict(zip(shown, shown, strict=True)) | {b: 256 + k for k, b in enumerate(others)}
    return {c: "".join(chr(sign[b]) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


_AS_BYTES = _as_bytes()
_U = np.uint64
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Bytes of the longest unit that is told by whole 64-bit words; of longer ones strings are made.
WORDS_OF = 32


class WordIds:
    """Ids of whole texts, joined from those of units: parts that the tokenizer never joins with what stands beside them.

    The tokenizer drops white space and splits words by a pattern, both read
    from its file and checked here. Units of a batch are found in its bytes and
    looked up by their bytes, A-Z as a-z, in a table of those encoded before,
    so only units that are new become strings.
    """

    #: Stands between units that are encoded together: a character that is one word and one token.
    BETWEEN = "\x01"
    #: Fixed values of the tokenizer's file on which the units rest.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
    SLOTS = 1 << 20

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        normal = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (said["normalizer"] or {}).get("normalizers", [])]
        split = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        special = [x["content"] for x in said["added_tokens"]]
        if (
            normal != self.NORMAL or [x["type"] for x in split] != ["Split", "ByteLevel"] or split[1]["use_regex"] or split[1]["add_prefix_space"]
            or (split[0]["pattern"].get("Regex"), split[0]["behavior"], split[0]["invert"]) != (self.SPLIT, "Removed", True)
            or any(not x.startswith("<|") or x.split() != [x] for x in special) or any(x["normalized"] for x in said["added_tokens"])
        ):
            raise ValueError(f"{path}: its normalizer, pattern or special tokens are others than units rest on")
        self.model = Tokenizer.from_file(path)
        (self.between,) = self.model.encode(self.BETWEEN, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.table = np.full(self.SLOTS, -1, np.int32)
        self.keys = np.zeros((5, 1 << 12), np.uint64)  # the unit's length and up to four 64-bit words of its bytes
        self.at, self.many = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)  # its ids
        self.ids = np.zeros(1 << 14, "<u4")
        self.n = self.n_ids = 0
        self.long: dict[bytes, int] = {}

    def encoded(self, units: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all units in a row, and how many each has."""
        tokenize = self.model.model.tokenize
        own: list[list[int]] = [[]] * len(units)
        rest = []
        for k, unit in enumerate(units):
            if _PLAIN(unit):  # one word already as the tokenizer normalizes it, so only its merges are left to do
                own[k] = [x.id for x in tokenize(unit if unit.isascii() else unit.translate(_AS_BYTES))]
            elif self.BETWEEN in unit:
                own[k] = self.model.encode(unit, add_special_tokens=False).ids
            else:
                rest.append(k)
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            ids = self.model.encode_batch_fast([f" {self.BETWEEN} ".join([units[k] for k in some])], add_special_tokens=False)[0].ids
            cuts = [-1, *[k for k, x in enumerate(ids) if x == self.between], len(ids)]
            for k, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                own[k] = ids[a + 1 : b]
        return [x for ids in own for x in ids], [len(ids) for ids in own]

    def add(self, units: list[bytes], keys: np.ndarray) -> int:
        """Encodes units and holds them from the number it returns on."""
        ids, counts = self.encoded([u.decode() for u in units])
        first, many = self.n, np.array(counts, np.int64)
        while first + len(units) > len(self.at):
            self.keys, self.at, self.many = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.keys, self.at, self.many))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        here = slice(first, first + len(units))
        self.keys[:, here], self.many[here] = keys, many
        self.at[here] = self.n_ids + np.cumsum(many) - many
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = first + len(units), self.n_ids + len(ids)
        return first

    # ------------------------------------------------------- whole texts

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by id 0, and where each text's begin."""
        data, ends = utf8(column)
        ids, counts = [], np.ones(len(ends) - 1, np.int64)
        for lo, hi in self.stretches(data, ends):
            own, many, part = self.part(data, ends, lo, hi)
            ids.append(part)
            counts += np.bincount(own, many, len(counts)).astype(np.int64)
        first = np.append(0, np.cumsum(counts))
        out = np.zeros(first[-1], "<u4")
        inside = np.ones(len(out), bool)
        inside[first[1:] - 1] = False
        out[inside] = np.concatenate([*ids, np.zeros(0, "<u4")])
        return out, first

    @staticmethod
    def stretches(data: np.ndarray, ends: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of about ``limit`` bytes that end at a space or with a text, so that long texts need no more memory."""
        at = 0
        while at < len(data):
            to = at + limit
            while to < len(data):
                near = np.flatnonzero(KINDS[data[to : to + limit]] == _SPACE)
                to += int(near[0]) if len(near) else limit
                if len(near):
                    break
            to = min(to, len(data))
            k = int(np.searchsorted(ends, at + limit))
            if k < len(ends) and ends[k] < to:
                to = int(ends[k])
            yield at, to
            at = to

    def part(self, data: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text and the number of ids of each unit of a stretch, and all these ids."""
        start, end, low = self.units(data[lo:hi], ends[(ends > lo) & (ends < hi)] - lo)
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for k in range(0, len(start), AT_ONCE):
            if self.n > REMEMBERED or self.n_ids > HELD:
                self.forget()
            unit = self.known(low, start[k : k + AT_ONCE], end[k : k + AT_ONCE])
            many = self.many[unit]
            ids.append(self.ids[np.repeat(self.at[unit] - (np.cumsum(many) - many), many) + np.arange(many.sum())])
            counts.append(many)
        return np.searchsorted(ends, start + lo, "right") - 1, np.concatenate(counts), np.concatenate(ids)

    @staticmethod
    def units(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each unit, and the bytes with A-Z as a-z where that changes no id."""
        kinds = KINDS[data]
        word = kinds != _SPACE
        apart = np.ones(len(data) + 1, bool)
        apart[1:-1] = BREAKS[(kinds[:-1] << 3) | kinds[1:]]
        low = _LOWER[data]
        wide = np.flatnonzero(kinds[1:] == _WIDE)  # what follows may be composed with a capital, and not with its small letter
        low[wide] = data[wide]
        raw = data.tobytes()
        bar = raw.find(b"<|")
        while bar >= 0:  # special tokens: no unit inside the word, no change of case
            a, b = bar, bar
            while a > 0 and word[a - 1]:
                a -= 1
            while b < len(data) and word[b]:
                b += 1
            apart[a + 1 : b] = False
            low[a:b] = data[a:b]
            bar = raw.find(b"<|", b)
        apart[edges] = True
        return np.flatnonzero(word & apart[:-1]), np.flatnonzero(word & apart[1:]) + 1, low

    def known(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each unit; those not seen before are encoded."""
        size = end - start
        padded = np.zeros(len(low) + 16, np.uint8)
        padded[8 : 8 + len(low)] = low
        words = np.ndarray(len(low) + 9, "<u8", padded, strides=(1,))  # from every byte on
        keys = np.zeros((5, len(start)), np.uint64)
        keys[0] = size
        keys[1] = words[start + 8] & _LOW[np.minimum(size, 8)]
        more = np.flatnonzero(size > 8)
        keys[2, more] = words[end[more]]
        more = more[size[more] > 16]
        keys[3, more] = words[np.minimum(start[more] + 16, end[more])]
        keys[4, more] = words[np.minimum(start[more] + 24, end[more])]
        mixed = mix(keys[1] + mix(keys[2] + keys[0]))
        if len(more):
            mixed[more] = mix(mixed[more] + mix(keys[3, more] + mix(keys[4, more])))
        unit = self.find(mixed, keys)
        lost = np.flatnonzero((unit < 0) & (size <= WORDS_OF))
        if len(lost):
            _, pick = np.unique(mixed[lost], return_index=True)
            new = lost[np.sort(pick)]
            first = self.add([low[a:b].tobytes() for a, b in zip(start[new], end[new], strict=True)], keys[:, new])
            self.enter(mixed[new], first)
            unit[lost] = self.find(mixed[lost], keys[:, lost])
        lost = np.flatnonzero(unit < 0)  # long units, and short ones that share a hash with another
        if len(lost):
            said = [low[a:b].tobytes() for a, b in zip(start[lost], end[lost], strict=True)]
            if len(self.long) > REMEMBERED // 16:
                self.long.clear()
            new = sorted({u for u in said if u not in self.long})
            first = self.add(new, np.zeros((5, len(new)), np.uint64))
            number = dict(zip(new, range(first, self.n), strict=True))
            short = [u for u in new if len(u) <= 256]
            self.long.update((u, number[u]) for u in short)
            unit[lost] = [number[u] if u in number else self.long[u] for u in said]
        return unit

    def find(self, mixed: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of units held, -1 of others."""
        slot = (mixed & _U(self.SLOTS - 1)).astype(np.int64)
        unit = self.table[slot]
        other = (self.keys[1, unit] != keys[1]) | (self.keys[2, unit] != keys[2]) | (self.keys[0, unit] != keys[0])
        more = np.flatnonzero(keys[0] > 16)
        other[more] |= (self.keys[3:, unit[more]] != keys[3:, more]).any(axis=0)
        other = np.flatnonzero(other & (unit >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & (self.SLOTS - 1)
            unit[other] = self.table[slot[other]]
            other = other[unit[other] >= 0]
            other = other[(self.keys[:, unit[other]] != keys[:, other]).any(axis=0)]
        return unit.astype(np.int64)

    def enter(self, mixed: np.ndarray, first: int) -> None:
        for k, slot in enumerate((mixed & _U(self.SLOTS - 1)).tolist()):
            while self.table[slot] >= 0:
                slot = (slot + 1) & (self.SLOTS - 1)
            self.table[slot] = first + k


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _local(path: str, capacity: int, nearly: int):
    """Rows of (doc_id, text) to packed pieces, a block of items at a time."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids = TaskContext.get().partitionId() << 36, word_ids(path)
        kind = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"]
        rows: list[np.ndarray] = []
        keys: list[pa.Array] = []
        made = held = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, rows, keys, held, size
            table = np.concatenate(rows)
            bins, places, fills = best_fit(table[:, 3], capacity)
            left = np.flatnonzero(fills < capacity - nearly)  # each of these is an item of its own
            bins[left], places[left], fills[left] = bins.max() + 1 + np.arange(len(left)), 0, table[left, 3]
            out = [
                pa.concat_arrays(keys).take(pa.array(table[:, 0])),
                pa.array(table[:, 1].astype(np.int32)),
                *(pa.array(table[:, k]) for k in (2, 3, 4)),
                *(pa.array(x) for x in (bins + base + made, places, fills)),
            ]
            made += int(bins.max()) + 1
            rows, keys, held, size = [], [], 0, 0
            return pa.RecordBatch.from_arrays(out, names=kind)

        ids.forget()  # an idle worker holds none of them
        for batch in slices(batches, "text"):
            found, first = ids.of(batch.column("text"))
            counts = np.diff(first)
            many = -(-counts // capacity)
            own = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, counts[own] - start)
            raw, at = memoryview(found).cast("B"), (first[own] + start) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            rows.append(np.stack([own + held, piece, start, length, np.array(sums, np.int64)], axis=1))
            keys.append(batch.column("doc_id"))
            held, size = held + batch.num_rows, size + len(own)
            if size >= BLOCK:
                yield flush()
        ids.forget()
        if size:
            yield flush()

    return packed


def _merge(capacity: int):
    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")  # the same result whatever order the rows come in
        bins, places, fills = best_fit(group["size"].to_numpy(), capacity)
        first = np.full(bins.max() + 1, -1, np.int64)
        lead = places == 0
        first[bins[lead]] = group["bin"].to_numpy()[lead]
        return pd.DataFrame({"bin": group["bin"], "size": group["size"], "into": first[bins], "shift": places, "fill": fills})

    return merged


def _least_kept(joined: DataFrame, n: int, full: int) -> int:
    """The least fill of a bin that a round keeps: ``full``, or less so that half of its n items are placed."""
    fills = sorted(((r["fill"], r["count"]) for r in joined.groupBy("fill").count().collect()), reverse=True)  # a row for each fill
    placed = 0
    for fill, items in fills:
        placed += items
        if 2 * placed >= n:
            return min(fill, full)
    return full


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, nearly: int = NEARLY) -> DataFrame:
    """Sequences of at most ``capacity`` tokens over all ``docs`` (doc_id, text).

    A document is the ids of its text and then id 0, so null and empty texts
    are one token. Longer documents are cut every ``capacity`` tokens. One row
    per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows are packed each; null ids stay null; other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    pieces = cut(docs.select("doc_id", "text").mapInArrow(_local(path, capacity, nearly), PIECES.format(key=key)))
    # each bin that is opened again has one piece, so this is a row for each
    items = pieces.where(F.col("fill") < capacity - nearly).select("bin", F.col("length").alias("size"))
    kept, n, turn = [], items.count(), 0
    while n:
        groups = -(-n // GROUP)
        joined = cut(
            items.groupBy(F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)).alias("g"))
            .applyInPandas(_merge(capacity), "bin long, size long, into long, shift long, fill long")
        )
        least = 0 if groups == 1 else _least_kept(joined, n, capacity - nearly)
        kept.append(joined.where(F.col("fill") >= least).select("bin", "into", "shift"))
        items = joined.where(F.col("fill") < least).select("bin", "size")
        n, turn = 0 if groups == 1 else items.count(), turn + 1
    if kept:
        pieces = pieces.join(reduce(DataFrame.unionByName, kept), "bin", "left")
    else:
        pieces = pieces.withColumns({"into": F.col("bin"), "shift": F.lit(0)})
    return pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
