"""Harmonic packing of token sequences.

The lengths up to the capacity C fall into reciprocal-capacity classes: class k has those of
more than C/(k+1) and not more than C/k. A document's whole sequences come first; the rest,
uncut, goes by its length into the open bin of its class, which takes k of them, a
fixed count, so each worker fills its bins on its own, in one pass over its own part of the
scan. What a bin of k pieces has left is filled with the head of the next document: at most one
document is cut for each sequence, and none has padding. What waits in a worker's
bins at its end is laid out together, whole sequences first and the last one
split at powers of two, so that these too have no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wavelane.llm.exchange import Remembered
from wavelane.llm.textnum import BYTE_KEYS, FOLDED_KEYS, find_words, hash_spans, returned, row_ranges, text_bytes

#: Chunks of text whose ids a worker remembers, in about 35 bytes each; the memo starts again when it is full.
MEMO_ENTRIES = 3_000_000
#: Bytes of text whose chunks are looked up together.
SLICE = 1 << 20
#: Bits of a sequence_id that number the sequences of one partition.
SEQUENCE_BITS = 40

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x0A]] = True

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Fixed values of the tokenizer's file that allow its texts to be cut at spaces.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer's file says what cutting relies on: it composes characters, turns white space into one space, lowers case,
    drops white space between pre-tokens of letters, single digits or other signs, and takes only strings in <| |> out first."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    same = own["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS} and own["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, BYTE_LEVEL]}
    plain = own["post_processor"] is None and own["model"]["type"] == "BPE" and not own["model"].get("dropout")
    return same and plain and all(t["content"].startswith("<|") and " " not in t["content"] and "\n" not in t["content"] for t in own["added_tokens"])


class ChunkIds:
    """Token ids of texts by their chunks between spaces and line feeds.

    No token depends on anything beyond a space, by what the tokenizer's file says; another tokenizer is refused. Case makes no
    difference outside of strings in <| |>. Chunks are told by 64-bit hashes of their bytes, A-Z folded; those met for the first time are
    encoded, and their ids remembered in sorted levels that merge when they are of about equal size, until there are MEMO_ENTRIES.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not cuts_at_spaces(tokenizer_path):
            raise ValueError("this tokenizer's texts can't be cut at spaces")
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self._forget()

    def _forget(self) -> None:
        #: By chunk the first place in the ids, and the number of ids.
        self.known = Remembered()
        self.ids, self.n_ids = np.zeros(1 << 16, "<u4"), 0

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Encodes chunks, a few hundred to a call, and cuts their ids apart by where each token starts."""
        raw, counts = [], []
        for at in range(0, len(chunks), 500):
            part = chunks[at : at + 500]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((x for x, _ in e.offsets), np.int64, len(e.ids))
            cuts = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1))
            raw.append(np.array(e.ids, "<u4"))
            counts.append(np.diff(cuts, prepend=0))
        ids, size = np.concatenate(raw), np.concatenate(counts)
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(len(ids), self.n_ids), "<u4")])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        at = self.n_ids + np.cumsum(size) - size
        self.n_ids += len(ids)
        self.known.add(keys, at, size.astype(np.int32))

    def _slice(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, ``end_id`` after each, and the texts' n + 1 offsets in them."""
        starts, ends, chunk_at = find_words(data, offsets, _SPACES)
        keys = hash_spans(data, starts, ends, FOLDED_KEYS)
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <|
        if len(marks):
            own = np.unique(np.searchsorted(starts, marks, "right") - 1)
            own = own[own >= 0]
            keys[own] = ~hash_spans(data, starts[own], ends[own], BYTE_KEYS)
        code, distinct = pd.factorize(keys)
        if len(self.known) + len(distinct) > MEMO_ENTRIES:
            self._forget()
        place, size = self.known.find(distinct, 2)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place[new], size[new] = self.known.find(distinct[new], 2)
        n = size[code]
        sums = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(place[code] - sums[:-1], n) + np.arange(sums[-1])
        texts = len(offsets) - 1
        out_at = sums[chunk_at] + np.arange(texts + 1)
        out = np.full(out_at[-1], end_id, "<u4")
        out[np.arange(sums[-1]) + np.repeat(np.arange(texts), np.diff(sums[chunk_at]))] = self.ids[at]
        return out, out_at

    def encode(self, column, end_id: int) -> Iterator[bytes]:
        """Each text's ids, as little-endian 32-bit bytes, and then ``end_id``."""
        data, offsets = text_bytes(column)
        for low, high in row_ranges(offsets, SLICE):
            ids, at = self._slice(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], end_id)
            raw, cuts = ids.tobytes(), (4 * at).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield raw[a:b]


_memos: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    if path not in _memos:
        _memos[path] = ChunkIds(path)
    return _memos[path]


class HarmonicBins:
    """One worker's bins. A piece is (doc_id, start, ids, doc_tokens), its ids as bytes; a row adds its length, checksum and place."""

    def __init__(self, capacity: int, first_id: int):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        #: Bins that have their count of pieces and some room left, with that room.
        self.short: list[tuple[list[tuple], int]] = []

    def add(self, doc_id: int | None, raw: bytes) -> list[tuple]:
        """Puts a document's ids; returns the rows of the sequences that are full now."""
        n, at, rows = len(raw) // 4, 0, []
        while self.short and at < n:
            pieces, room = self.short.pop()
            length = min(room, n - at)
            pieces.append((doc_id, at, raw[4 * at : 4 * (at + length)], n))
            at += length
            if length < room:
                self.short.append((pieces, room - length))
            else:
                rows += self._close(pieces)
        while n - at >= self.capacity:
            rows += self._close([(doc_id, at, raw[4 * at : 4 * (at + self.capacity)], n)])
            at += self.capacity
        if at < n:
            k = self.capacity // (n - at)
            waiting = self.open.setdefault(k, [])
            waiting.append((doc_id, at, raw[4 * at :], n))
            if len(waiting) == k:
                del self.open[k]
                room = self.capacity - sum(len(p[2]) for p in waiting) // 4
                if room:
                    self.short.append((waiting, room))
                else:
                    rows += self._close(waiting)
        return rows

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for doc_id, start, ids, n in pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1
        return rows

    def finish(self) -> list[tuple]:
        """Rows of what still waits: pieces by falling length, in whole sequences and at last in falling powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]] + [p for pieces, _ in self.short for p in pieces]
        left.sort(key=lambda p: -len(p[2]))
        total = sum(len(p[2]) for p in left) // 4
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 2, -1, -1) if total % self.capacity >> b & 1]
        rows, own, room = [], [], 0
        sizes.reverse()
        for doc_id, start, ids, n in left:
            while ids:
                room = room or sizes.pop()
                own.append((doc_id, start, ids[: 4 * room], n))
                start += len(own[-1][2]) // 4
                room -= len(own[-1][2]) // 4
                ids = ids[len(own[-1][2]) :]
                if not room:
                    rows += self._close(own)
                    own = []
        self.open, self.short = {}, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece: its document, place there, checksum of its ids, sequence and place there.

    Null and empty texts hold the end id only; a null doc_id stays null; repeated rows are packed each; other
    columns are ignored; an empty table gives no rows. No shuffle: sequence ids carry the number of the scan
    partition, so a recomputed partition gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = chunk_ids(tokenizer_path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << SEQUENCE_BITS)
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), memo.encode(batch.column(1), end_id), strict=True):
                rows += bins.add(doc_id, raw)
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        if rows := rows + bins.finish():
            yield out(rows)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(returned(run), PACKED)
