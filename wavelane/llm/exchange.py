"""Exchanges of packed arrays between tasks, and a logarithmic family of sorted levels.

Rows that cross the network are blobs: compressed numpy arrays, or documents, that one
task has for one bucket. Keys are dealt by their hash after each task has put equal keys
together, so a key sends one entry a task however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.textnum import U64, mix, returned

BLOBS = "kind int, bucket int, blob binary"
#: Kinds of blobs. They sort so that a task meets marks and requests before documents.
KEYS, MARKS, REQUESTS, PARTS, WINDOWS, TEXTS = range(6)
#: Bytes of text that a task gathers before it puts equal keys together and sends them.
FLUSH_BYTES = 16 << 20
#: Entries of blobs that make a batch of their own for a family of levels.
BATCH_ENTRIES = 1 << 16


def pack_arrays(arrays: list[np.ndarray], widths: dict[int, int] | None = None) -> bytes:
    """Arrays of one length as bytes. Integers are stored as differences, byte by byte; of unsigned ones, which are
    hashes, the ``widths`` lowest bytes are."""
    kinds, parts = [], []
    for k, a in enumerate(arrays):
        if a.dtype.kind == "i":
            kinds.append(a.dtype.str[1:])
            parts.append(np.diff(a, prepend=a.dtype.type(0)).astype(a.dtype).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        else:
            width = (widths or {}).get(k, 8)
            kinds.append(f"u{width}")
            parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8)[:, :width].tobytes())
    head = " ".join(kinds).encode()
    return len(head).to_bytes(2, "little") + head + len(arrays[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    size = int.from_bytes(blob[:2], "little")
    n = int.from_bytes(blob[2 + size : 6 + size], "little")
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob[6 + size :]), [], 0
    for kind in blob[2 : 2 + size].decode().split():
        width = int(kind[1:])
        own = np.frombuffer(raw, np.uint8, n * width, at)
        at += n * width
        if kind[0] == "i":
            out.append(np.cumsum(np.ascontiguousarray(own.reshape(width, n).T).view(f"<i{width}")[:, 0], dtype=f"<i{width}"))
        else:
            full = np.zeros((n, 8), np.uint8)
            full[:, :width] = own.reshape(n, width)
            out.append(full.view(U64)[:, 0])
    return out


def pack_rows(batch: pa.RecordBatch) -> bytes:
    """Rows as bytes, with their schema."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(blob) as reader:
        yield from reader


def by_place(arrays: list[np.ndarray], doc: int = 1, start: int = 2) -> list[np.ndarray]:
    """Entries in order of their places, in which these take least room."""
    order = np.lexsort((arrays[start], arrays[doc]))
    return [a[order] for a in arrays]


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64) + U64(0x51ED2701)) % U64(n)).astype(np.int32)


def key_bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key) % U64(n)).astype(np.int32)


class Blobs:
    """Gathers blobs and gives them out as record batches of a few megabytes."""

    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def __init__(self):
        self.rows: list[tuple[int, int, bytes]] = []
        self.size = 0

    def put(self, kind: int, bucket: int, blob: bytes) -> None:
        self.rows.append((kind, bucket, blob))
        self.size += len(blob)

    def deal(self, kind: int, bucket: np.ndarray, arrays: list[np.ndarray], widths: dict[int, int] | None = None) -> None:
        """Puts each bucket's part of the arrays."""
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        edges = np.flatnonzero(np.diff(sorted_)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(order)], strict=True):
            if high > low:
                own = order[low:high]
                self.put(kind, int(sorted_[low]), pack_arrays([a[own] for a in arrays], widths))

    def take(self, least: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            kinds, buckets, blobs = zip(*self.rows, strict=True)
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], schema=self.schema)


def deal_texts(out: Blobs, batch: pa.RecordBatch, n: int) -> None:
    """Puts rows whose first column is the document's id by that id's bucket; rows with a null id in turn over the buckets."""
    ids = batch.column(0)
    bucket = doc_bucket(ids.fill_null(0).to_numpy(zero_copy_only=False), n)
    if ids.null_count:
        none = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        bucket[none] = none % n
    for b in np.unique(bucket):
        out.put(TEXTS, int(b), pack_rows(batch.take(pa.array(np.flatnonzero(bucket == b)))))


def text_blobs(rows: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id first) as compressed blobs by bucket of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs()
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                deal_texts(out, batch.slice(low, 8192), n)
                yield from out.take()
        yield from out.take(0)

    return rows.mapInArrow(returned(run), BLOBS)


def by_bucket(blobs: DataFrame, n: int, sort: bool = False) -> DataFrame:
    """Blobs dealt to n partitions by bucket; sorted: by kind, so that marks precede documents."""
    dealt = blobs.repartitionById(n, F.col("bucket"))
    return dealt.sortWithinPartitions("kind") if sort else dealt


def blob_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        kinds, buckets, blobs = batch.columns
        for k in range(batch.num_rows):
            yield kinds[k].as_py(), buckets[k].as_py(), blobs[k].as_py()


class Spans:
    """Spans by document: marks or requests of one task's documents, looked up as its texts come."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []
        self.table: list[np.ndarray] | None = None

    def add(self, arrays: list[np.ndarray]) -> None:
        self.parts.append(arrays)

    def of(self, doc: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of a document's spans, by rising start."""
        if self.table is None:
            parts = self.parts or [[np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]]
            doc_, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, doc_))
            self.table, self.parts = [doc_[order], start[order], end[order]], []
        if doc is None:
            return self.table[1][:0], self.table[2][:0]
        low, high = np.searchsorted(self.table[0], doc, "left"), np.searchsorted(self.table[0], doc, "right")
        return self.table[1][low:high], self.table[2][low:high]


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(starts, n), 1)
    np.add.at(steps, np.minimum(ends, n), -1)
    return np.cumsum(steps[:-1]) > 0


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents with those that touch or overlap put together."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order].astype(np.int64)
    rank = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (1 << 33)
    reach = np.maximum.accumulate(end + rank)
    new = np.ones(len(doc), bool)
    new[1:] = (start[1:] + rank[1:]) > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach[last] - rank[last]).astype(np.int32)


def earlier(doc_a: np.ndarray, at_a: np.ndarray, doc_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Where place a lies before place b."""
    return (doc_a < doc_b) | ((doc_a == doc_b) & (at_a < at_b))


def not_again(doc: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of sorted entries with the first of each group marked: those that are neither first nor at the first one's own place.

    The same place comes twice where a table repeats a document.
    """
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return ~first & ((doc != doc[lead]) | (start != start[lead]))


def sorted_by(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by key and then by the other arrays, which only entries with equal keys are sorted by."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    tied = np.zeros(len(order), bool)
    tied[1:] = same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    if len(at):
        own = order[at]
        order[at] = own[np.lexsort((*(a[own] for a in reversed(then)), key[own]))]
    return order


def first_of_each(arrays: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries (key, doc, start, end, and what else must be equal): by rising key the first place of each, and the other places."""
    order = sorted_by(arrays[0], *arrays[4:], arrays[1], arrays[2])
    arrays = [a[order] for a in arrays]
    first = np.ones(len(order), bool)
    first[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in (arrays[0], *arrays[4:])])
    others = not_again(arrays[1], arrays[2], first)
    return [a[first] for a in arrays], [a[others] for a in arrays]


class Batches:
    """Puts the arrays of small blobs together until they make a batch."""

    def __init__(self, least: int = BATCH_ENTRIES):
        self.least, self.parts, self.size = least, [], 0

    def add(self, arrays: list[np.ndarray]) -> list[list[np.ndarray]]:
        """The batch, once there are entries enough for one."""
        self.parts.append(arrays)
        self.size += len(arrays[0])
        return self.rest() if self.size >= self.least else []

    def rest(self) -> list[list[np.ndarray]]:
        parts, self.parts, self.size = self.parts, [], 0
        return [[np.concatenate(x) for x in zip(*parts, strict=True)]] if parts else []


def merged_levels(levels: list[list[np.ndarray]], order: Callable[[list[np.ndarray]], np.ndarray]) -> None:
    """Merges levels of about equal size, from the last on, so that n entries keep about log n of them."""
    while len(levels) > 1 and len(levels[-2][0]) < 2 * len(levels[-1][0]):
        b, a, both = list(levels.pop()), list(levels.pop()), []
        while a:  # column by column, so that the old ones go as the new ones come
            both.append(np.concatenate([a.pop(0), b.pop(0)]))
        own = order(both)
        for k, x in enumerate(both):
            both[k] = x[own]
        levels.append(both)


class Remembered:
    """Numbers by 64-bit hash, in sorted levels that merge when they are of about equal size."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.levels.append([keys[order], *(v[order] for v in values)])
        merged_levels(self.levels, lambda both: np.argsort(both[0], kind="stable"))

    def find(self, keys: np.ndarray, n: int) -> list[np.ndarray]:
        """The n numbers of each key; -1 where there is none."""
        out, open_ = [np.full(len(keys), -1) for _ in range(n)], np.arange(len(keys))
        for own, *values in self.levels:
            k = np.minimum(np.searchsorted(own, keys[open_]), len(own) - 1)
            hit = own[k] == keys[open_]
            for o, v in zip(out, values, strict=True):
                o[open_[hit]] = v[k[hit]]
            open_ = open_[~hit]
        return out


class Levels:
    """A logarithmic index family over entries (key, doc, start, end, and what else must be equal) with distinct keys.

    Each batch, sorted by key, is scanned against every level; what the levels lack becomes a level of its own,
    and levels of about equal size merge. Of two entries that are equal the earlier stays in its level; the later one
    is put out as a mark, unless they are the same place.
    """

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.out: list[list[np.ndarray]] = []

    def add(self, batch: list[np.ndarray]) -> None:
        """A batch in any order."""
        batch, late = first_of_each(batch)
        self.out.append(late[1:4])
        for level in self.levels:
            at = np.searchsorted(level[0], batch[0])
            hit = at < len(level[0])
            hit[hit] = level[0][at[hit]] == batch[0][hit]
            if hit.any():
                j = np.flatnonzero(hit)
                self._meet(level, at[j], batch, j)
                batch = [a[~hit] for a in batch]
        if len(batch[0]):
            self.levels.append(batch)
            merged_levels(self.levels, lambda both: np.argsort(both[0], kind="stable"))

    def _meet(self, level: list[np.ndarray], i: np.ndarray, batch: list[np.ndarray], j: np.ndarray) -> None:
        equal = np.logical_and.reduce([np.ones(len(i), bool), *(a[i] == b[j] for a, b in zip(level[4:], batch[4:], strict=True))])
        i, j = i[equal], j[equal]
        sooner = earlier(batch[1][j], batch[2][j], level[1][i], level[2][i])
        same = (batch[1][j] == level[1][i]) & (batch[2][j] == level[2][i])
        self.out.append([np.where(sooner, a[i], b[j])[~same] for a, b in zip(level[1:4], batch[1:4], strict=True)])
        for a, b in zip(level[1:4], batch[1:4], strict=True):
            a[i[sooner]] = b[j[sooner]]

    def take(self) -> list[list[np.ndarray]]:
        """Marks (doc, start, end) that have come up since the last call."""
        out, self.out = self.out, []
        return [m for m in out if len(m[0])]
