"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays, sparse and of two stages.

Sampling. A window is ``LENGTH`` bytes. Its anchor is the least hash among its strings of
``SEED`` bytes; equal windows have equal anchors at equal distances. Neighbouring windows
with one anchor form a run (of 64 at most), so only about one suffix in 30 is indexed, and
yet each window belongs to exactly one indexed suffix.

First stage: whole runs. A task's runs are sorted by anchor, which puts equal anchors
together. Buckets of the anchor's hash hold a family of levels: each new batch is scanned
against them, and levels of about equal size merge. Where an anchor has runs of one
content only (told by 64 bits of its own beside the anchor's), all but the earliest are
repeated. Where contents differ, matches end inside of the runs, and their bytes are asked for.

Second stage: suffixes with bytes. Such a run is cut at equal distances from the anchor into
parts of up to ``PART`` windows. What a part's windows share, its core of ``CORE`` bytes, is
the head of the suffix, kept as a hash; what follows it and what precedes it are kept as they are,
eight bytes each. A batch gets its suffix array, the order by core and following bytes, and is
merge-scanned against the arrays of the levels: for suffixes that meet, the lengths of their
matches to either side give the windows that they have in common. Arrays of about equal
size merge. A core that has many contents is not compared pair by pair: its windows, again with
their bytes, go on to buckets of their own, so that no core makes one task long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.exchange import BATCH_ENTRIES, BLOBS, FLUSH_BYTES, KEYS, MARKS, PARTS, REQUESTS, WINDOWS, Batches, Blobs, Levels, Spans, blob_rows, by_bucket, by_place, cover, doc_bucket, earlier, first_of_each, joined, key_bucket, merged_levels, not_again, sorted_by, text_blobs, unpack_arrays, unpack_rows
from wavelane.llm.shared import discard, partitions, stored
from wavelane.llm.textnum import U64, mix, row_ranges, text_bytes

LENGTH, SEED = 100, 36
_RUN = LENGTH - SEED
#: Windows of a part, and bytes that all of them share; to either side of these are eight more at most.
PART = 9
CORE = LENGTH - PART + 1
_FLANK = PART - 1
#: Contents of one core that are compared in pairs; beyond, the windows of all of them are sorted.
PAIRED = 32
#: Bits of a core's hash that are sent.
CORE_KEY = U64(2**48 - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * U64(0x9E3779B97F4A7C15)
    out += b * U64(0xC2B2AE3D27D4EB4F)
    out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(32)
    return out


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the strings of SEED bytes, of the windows of LENGTH, of strings of 64 and 32, and the next 8 bytes, from each byte on.

    Built by doubling: 8 bytes as a number, then 16, 32, 64, and 36 and 100 from these and 4.
    """
    n = len(data)
    b = np.concatenate([data, np.zeros(LENGTH, np.uint8)]).astype(U64)
    two = b[:-1] | b[1:] << U64(8)
    four = two[:-2] | two[2:] << U64(16)
    eight = four[:-4] | four[4:] << U64(32)
    sixteen = _pair(eight[:-8], eight[8:])
    thirty_two = _pair(sixteen[:-16], sixteen[16:])
    seed = _pair(thirty_two[: n + 64], four[32 : n + 96])
    sixty_four = _pair(thirty_two[:n], thirty_two[32 : n + 32])
    return seed, _pair(sixty_four, seed[64 : n + 64]), sixty_four, thirty_two, eight


def anchored_runs(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Runs of windows with one anchor as (anchor, fingerprint, row, first, last window, tied).

    Tied: the anchor is there more than once, so the run's own windows may repeat. Windows are numbered by their first
    byte in ``data``; rows shorter than a window have none.
    """
    seed, window, _, _, _ = window_hashes(data)
    least, width = seed, 1
    while 2 * width <= _RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(data)], seed[_RUN : _RUN + len(data)])  # width is 64
    inside = np.zeros(len(data) + 1, np.int8)
    long_ = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    last = np.flatnonzero(stop)
    parts = (last - first) // _RUN + 1
    if len(first) and parts.max() > 1:  # the same bytes again and again: one anchor for long
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, end = np.repeat(first, parts) + _RUN * step, np.repeat(last, parts)
        last = np.minimum(first + _RUN - 1, end)
    row = np.searchsorted(offsets, first, "right") - 1
    _, tied = _anchor_places(seed, least[first], first, last)
    return [mix(least[first]), mix(_pair(window[first], window[last]) + (last - first).astype(U64)), row, first, last, tied]


def _anchor_places(seed: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each run's anchor in the run's bytes, and whether it has more."""
    at, tied = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([seed, np.zeros(2 * _RUN, U64)]), 2 * _RUN + 1)
    place = np.arange(2 * _RUN + 1)
    for low in range(0, len(first), 2048):
        own = slice(low, low + 2048)
        found = around[first[own]] == anchor[own, None]
        found &= place <= (last[own] - first[own] + _RUN)[:, None]
        at[own] = first[own] + found.argmax(axis=1)
        tied[own] = found.sum(axis=1) > 1
    return at, tied


def part_entries(data: np.ndarray, doc: np.ndarray, base: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """(core, doc, head, reach, left, right) of the parts of runs; ``base``: where the run's document starts in ``data``.

    ``head`` is the last window's start for a part that is not cut short; ``reach`` has the fewest and the most bytes before it
    that a window of the part takes in; ``left`` ends at the head, ``right`` starts after the core, without bytes that no window has.
    """
    seed, _, sixty_four, thirty_two, eight = window_hashes(data)
    near = np.lib.stride_tricks.sliding_window_view(seed, _RUN + 1)
    anchor = np.concatenate([np.zeros(0, U64), *(near[first[k : k + 4096]].min(axis=1) for k in range(0, len(first), 4096))])
    at, tied = _anchor_places(seed, anchor, first, last)
    # Of a run whose anchor is tied, each window has the first place inside itself; it is cut where that changes.
    run = np.flatnonzero(tied)
    n = (last - first + 1)[run]
    own, p = np.repeat(run, n), np.repeat(first[run] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = np.concatenate([np.zeros(0, np.int64), *(p[k : k + 4096] + (near[p[k : k + 4096]] == anchor[own[k : k + 4096], None]).argmax(axis=1) for k in range(0, len(p), 4096))])
    new = np.ones(len(p), bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1])
    cut = np.flatnonzero(new)
    whole = np.flatnonzero(~tied)
    run = np.concatenate([whole, own[cut]])
    at = np.concatenate([at[whole], place[cut]])
    low = np.concatenate([first[whole], p[cut]])
    high = np.concatenate([last[whole], p[np.append(cut[1:], len(p)) - 1] if len(cut) else p])
    # Parts by the distance from window to anchor.
    nearest, farthest = (at - high) // PART, (at - low) // PART
    n = farthest - nearest + 1
    i = np.repeat(np.arange(len(at)), n)
    k = np.repeat(nearest - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    head = at[i] - PART * k
    low, high, run = np.maximum(low[i], head - PART + 1), np.minimum(high[i], head), run[i]
    core = mix(_pair(_pair(sixty_four[head], thirty_two[head + CORE - 32]), k.astype(U64)))
    least, most = head - high, head - low
    before = np.where(head >= 8, eight[np.maximum(head - 8, 0)], _up(eight[np.zeros_like(head)], 8 - np.minimum(head, 8)))
    left = _up(_down(before, 8 - most), 8 - most)
    right = _down(_up(eight[head + CORE], least), least)
    return [core, doc[run], (head - base[run]).astype(np.int32), (least * PART + most).astype(np.int8), left, right]


def _up(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Little-endian bytes moved by n places to the end; 8 leaves none."""
    return np.where(n < 8, x << (U64(8) * np.minimum(n, 7).astype(U64)), U64(0))


def _down(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n < 8, x >> (U64(8) * np.minimum(n, 7).astype(U64)), U64(0))


def settle(entries: list[np.ndarray], mixed: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Puts runs (anchor, doc, start, end, fingerprint) together; ``mixed``: its anchor is known to have runs that differ.

    Returns, sorted by anchor, for an anchor with one fingerprint its first place and for another one a note that its
    runs differ; spans that came earlier with the same fingerprint; and the indices of the runs that differ, the
    first of each fingerprint.
    """
    order = sorted_by(entries[0], entries[4], entries[1], entries[2])
    key, doc, start, end, print_ = (x[order] for x in entries)
    new_key, new_print = np.ones(len(key), bool), np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_print[1:] = new_key[1:] | (print_[1:] != print_[:-1])
    group = np.cumsum(new_key) - 1
    differ = (np.bincount(group, new_print.astype(float) + mixed[order]) > 1)[group]
    send = (new_print & ~differ) | (new_key & differ)
    note = differ[send]
    sent = [key[send], np.where(note, -1, doc[send]), np.where(note, 0, start[send]).astype(np.int32), np.where(note, 0, end[send]).astype(np.int32), np.where(note, U64(0), print_[send]), note.astype(np.int8)]
    late = not_again(doc, start, new_print)
    return sent, [doc[late], start[late], end[late]], order[new_print & differ]


class RunLevels:
    """The family of whole runs. Entries: (anchor, doc, start, end, fingerprint, note), the note where runs of this anchor are known
    to differ: a task that has found so sends it in place of its runs, whose bytes it has itself."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.marks: list[list[np.ndarray]] = []
        self.requests: list[list[np.ndarray]] = []

    def add(self, batch: list[np.ndarray]) -> None:
        noted = batch[5] > 0
        sent, late, differ = settle(batch[:5], noted)
        self.marks.append(late)
        self.requests.append([a[differ[~noted[differ]]] for a in batch[1:4]])
        batch = sent
        for level in self.levels:
            at = np.searchsorted(level[0], batch[0])
            hit = at < len(level[0])
            hit[hit] = level[0][at[hit]] == batch[0][hit]
            if hit.any():
                self._meet(level, at[hit], [a[hit] for a in batch])
                batch = [a[~hit] for a in batch]
        if len(batch[0]):
            self.levels.append(batch)
            merged_levels(self.levels, lambda both: np.argsort(both[0], kind="stable"))

    def _meet(self, level: list[np.ndarray], i: np.ndarray, b: list[np.ndarray]) -> None:
        a = [x[i] for x in level]
        alike = (a[5] == 0) & (b[5] == 0) & (a[4] == b[4])
        sooner = earlier(b[1], b[2], a[1], a[2])
        same = (a[1] == b[1]) & (a[2] == b[2])
        self.marks.append([np.where(sooner, x, y)[alike & ~same] for x, y in zip(a[1:4], b[1:4], strict=True)])
        take = alike & sooner
        for x, y in zip(level[1:4], b[1:4], strict=True):
            x[i[take]] = y[take]
        # Runs that differ: the level's own is asked for once, the batch's in any case.
        ask = ~alike & (a[5] == 0)
        self.requests.append([x[ask] for x in a[1:4]])
        level[5][i[ask]] = 1
        ask = ~alike & (b[5] == 0)
        self.requests.append([x[ask] for x in b[1:4]])

    def take(self) -> tuple[list[list[np.ndarray]], list[list[np.ndarray]]]:
        """Marks and requests that have come up since the last call."""
        out = self.marks, self.requests
        self.marks, self.requests = [], []
        return out


def suffix_array(parts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Parts (core, doc, head, reach, left, right) in the order of their suffixes, by core and following bytes, of equal contents
    the first place only; and the spans (doc, start, end) of the others."""
    order = sorted_by(parts[0], parts[5].byteswap(), parts[4], parts[3], parts[1], parts[2])
    parts = [x[order] for x in parts]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([parts[k][1:] != parts[k][:-1] for k in (0, 3, 4, 5)])
    late = not_again(parts[1], parts[2], new)
    doc, head, reach = (x[late] for x in parts[1:4])
    return [x[new] for x in parts], [doc, head - reach % PART, head - reach // PART + np.int32(LENGTH)]


def part_windows(parts: list[np.ndarray]) -> list[np.ndarray]:
    """(key, doc, start, end, bytes) of all windows of parts: the key is a hash of the core, the window's place beside it and the
    eight bytes of the window that are not the core's."""
    reach, out = parts[3].astype(np.int64), []
    for n in range(PART):
        own = (reach // PART <= n) & (n <= reach % PART)
        core, doc, head, _, left, right = (x[own] for x in parts)
        n_ = np.full(len(core), n)
        bytes_ = _down(left, 8 - n_) | _up(right, n_)
        start = head - np.int32(n)
        out.append([mix(_pair((core & CORE_KEY) + U64(n), bytes_)), doc, start, start + np.int32(LENGTH), bytes_])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def many_of_a_core(parts: list[np.ndarray], paired: int) -> np.ndarray:
    """Which parts, in the order of their suffixes, belong to a core of which there are over ``paired``."""
    new = np.ones(len(parts[0]), bool)
    new[1:] = parts[0][1:] != parts[0][:-1]
    group = np.cumsum(new) - 1
    return (np.bincount(group) > paired)[group] if len(group) else new


class SuffixLevels:
    """The family of suffix arrays. Entries are parts; those of a core with over ``paired`` contents leave as windows."""

    def __init__(self, paired: int = PAIRED):
        self.paired = paired
        self.levels: list[list[np.ndarray]] = []
        self.crowded = np.zeros(0, U64)
        self.marks: list[list[np.ndarray]] = []
        self.windows: list[list[np.ndarray]] = []

    def add(self, batch: list[np.ndarray]) -> None:
        noted = batch[3] < 0  # a task has sent the windows of this core already
        notes = np.unique(batch[0][noted])
        batch, late = suffix_array([x[~noted] for x in batch])
        self.marks.append(late)
        self._crowd(np.setdiff1d(notes, self.crowded, assume_unique=True))
        if len(self.crowded):
            at = np.minimum(np.searchsorted(self.crowded, batch[0]), len(self.crowded) - 1)
            out = self.crowded[at] == batch[0]
            self.windows.append([x[out] for x in batch])
            batch = [x[~out] for x in batch]
        cores, sizes = np.unique(batch[0], return_counts=True)
        for level in self.levels:
            sizes = sizes + np.searchsorted(level[0], cores, "right") - np.searchsorted(level[0], cores, "left")
        if (sizes > self.paired).any():
            new = cores[sizes > self.paired]
            self._crowd(new)
            out = np.isin(batch[0], new)
            self.windows.append([x[out] for x in batch])
            batch = [x[~out] for x in batch]
        n, apart = len(batch[0]), 1
        while len(a := np.flatnonzero(batch[0][apart:] == batch[0][: n - apart])):
            self._match(batch, a, batch, a + apart)
            apart += 1
        known = np.zeros(n, bool)
        for level in self.levels:
            low, high = np.searchsorted(level[0], batch[0], "left"), np.searchsorted(level[0], batch[0], "right")
            j = np.repeat(np.arange(n), high - low)
            i = np.arange(len(j)) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
            self._match(level, i, batch, j)
            equal = np.logical_and.reduce([level[k][i] == batch[k][j] for k in (3, 4, 5)])
            i, j = i[equal], j[equal]
            known[j] = True
            sooner = earlier(batch[1][j], batch[2][j], level[1][i], level[2][i])
            for k in (1, 2):
                level[k][i[sooner]] = batch[k][j[sooner]]
        if not known.all():
            self.levels.append([x[~known] for x in batch])
            merged_levels(self.levels, lambda both: sorted_by(both[0], both[5].byteswap(), both[4], both[3]))

    def _crowd(self, cores: np.ndarray) -> None:
        """From now on these cores' parts leave as windows, those of the levels now."""
        if len(cores):
            self.crowded = np.union1d(self.crowded, cores)
            for k, level in enumerate(self.levels):
                out = np.isin(level[0], cores)
                self.windows.append([x[out] for x in level])
                self.levels[k] = [x[~out] for x in level]

    def _match(self, a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray) -> None:
        """Marks the later one's windows that two suffixes have in common, by the lengths of their matches before and after the core."""
        for low in range(0, len(i), 1 << 20):
            self._match_some([x[i[low : low + (1 << 20)]] for x in a], [x[j[low : low + (1 << 20)]] for x in b])

    def _match_some(self, a: list[np.ndarray], b: list[np.ndarray]) -> None:
        left, right = a[4] ^ b[4], a[5] ^ b[5]
        before = sum(((left >> U64(8 * k)) == 0).astype(np.int64) for k in range(8))
        after = sum(((right << U64(8 * k)) == 0).astype(np.int64) for k in range(8))
        least = np.maximum.reduce([a[3] // PART, b[3] // PART, _FLANK - after])
        most = np.minimum.reduce([a[3] % PART, b[3] % PART, before])
        found = (least <= most) & ((a[1] != b[1]) | (a[2] != b[2]))
        second = earlier(a[1], a[2], b[1], b[2])
        doc, head = (np.where(second, y, x)[found] for x, y in zip(a[1:3], b[1:3], strict=True))
        self.marks.append([doc, (head - most[found]).astype(np.int32), (head - least[found] + LENGTH).astype(np.int32)])

    def take(self) -> tuple[list[list[np.ndarray]], list[list[np.ndarray]]]:
        """Marks, and parts whose windows are to be sent, that have come up since the last call."""
        out = self.marks, [w for w in self.windows if len(w[0])]
        self.marks, self.windows = [], []
        return out


class Marks:
    """Gathers spans to remove and sends them, joined, by document."""

    def __init__(self, out: Blobs, n: int):
        self.out, self.n, self.parts, self.size = out, n, [], 0

    def add(self, arrays: list[np.ndarray]) -> None:
        if len(arrays[0]):
            self.parts.append(arrays)
            self.size += len(arrays[0])
            if self.size > 1 << 20:
                self.send()

    def send(self) -> None:
        if self.parts:
            doc, start, end = joined(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.out.deal(MARKS, doc_bucket(doc, self.n), [doc, start, end])
            self.parts, self.size = [], 0


def _index_text(rows: DataFrame, n: int) -> DataFrame:
    """Each task's runs by bucket of their anchor; those that it finds to differ are asked for at once, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs()
        marks = Marks(out, n)
        runs: list[list[np.ndarray]] = []
        size = 0

        def send() -> None:
            nonlocal runs, size
            if runs:
                *entries, tied = (np.concatenate(x) for x in zip(*runs, strict=True))
                sent, late, differ = settle(entries, tied)
                send_runs(out, sent, n)
                marks.add(late)
                asked = by_place([a[differ] for a in entries[1:4]], 0, 1)
                out.deal(REQUESTS, doc_bucket(asked[0], n), asked)
                marks.send()
                runs, size = [], 0

        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_bytes(batch.column(1))
            for low, high in row_ranges(offsets):
                own = offsets[low : high + 1] - offsets[low]
                anchor, print_, row, first, last, tied = anchored_runs(data[offsets[low] : offsets[high]], own)
                start = (first - own[row]).astype(np.int32)
                runs.append([anchor, ids[low:high][row], start, start + (last - first).astype(np.int32) + np.int32(LENGTH), print_, tied])
                size += int(own[-1])
                if size >= FLUSH_BYTES:
                    send()
            yield from out.take()
        send()
        yield from out.take(0)

    return rows.mapInArrow(run, BLOBS)


def send_runs(out: Blobs, sent: list[np.ndarray], n: int) -> None:
    """Sends runs by bucket of the anchor, with 40 bits of it beside those that the bucket tells; anchors that only seem equal cost a request."""
    sent = by_place(sent)
    out.deal(KEYS, key_bucket(sent[0], n), [sent[0] & U64(2**40 - 1), *sent[1:]], {0: 5})


def send_windows(out: Blobs, marks: Marks, parts: list[list[np.ndarray]], n: int) -> None:
    """Settles windows of parts within the task and sends the first of each by its hash; their ends follow from their starts."""
    if parts:
        firsts, others = first_of_each(part_windows([np.concatenate(x) for x in zip(*parts, strict=True)]))
        marks.add(others[1:4])
        key, doc, start, _, bytes_ = by_place(firsts)
        out.deal(WINDOWS, key_bucket(key, n), [key, doc, start, bytes_])


def send_parts(out: Blobs, marks: Marks, entries: list[list[np.ndarray]], n: int, paired: int) -> None:
    """Settles parts within the task and sends them by core; of a core with many contents the windows, and a note to its bucket."""
    if entries:
        parts, late = suffix_array([np.concatenate(x) for x in zip(*entries, strict=True)])
        marks.add(late)
        many = many_of_a_core(parts, paired)
        if many.any():
            send_windows(out, marks, [[x[many] for x in parts]], n)
            cores = np.unique(parts[0][many])
            zero = np.zeros(len(cores), np.int32)
            parts = [np.concatenate([x[~many], y]) for x, y in zip(parts, [cores, zero.astype(np.int64), zero, np.full(len(cores), -1, np.int8), zero.astype(U64), zero.astype(U64)], strict=True)]
        parts = by_place(parts)
        out.deal(PARTS, key_bucket(parts[0], n), [parts[0] & CORE_KEY, *parts[1:]], {0: 6})


def _scan_levels(blobs: DataFrame, n: int, kind_: int, paired: int, batch: int) -> DataFrame:
    """Blobs of one kind met by a family of levels: its marks by document and what goes on; other blobs pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, gathered = Blobs(), Batches(batch)
        levels = {KEYS: RunLevels, PARTS: lambda: SuffixLevels(paired), WINDOWS: Levels}[kind_]()
        marks = Marks(out, n)

        def scan(entries: list[list[np.ndarray]]) -> None:
            for own in entries:
                levels.add(own)
                if kind_ == WINDOWS:
                    found = levels.take()
                else:
                    found, more = levels.take()
                    if kind_ == PARTS:
                        send_windows(out, marks, more, n)
                    elif more:
                        asked = by_place([np.concatenate(x) for x in zip(*more, strict=True)], 0, 1)
                        out.deal(REQUESTS, doc_bucket(asked[0], n), asked)
                for m in found:
                    marks.add(m)

        for kind, bucket, blob in blob_rows(batches):
            if kind != kind_:
                out.put(kind, bucket, blob)
            elif kind == WINDOWS:
                key, doc, start, bytes_ = unpack_arrays(blob)
                scan(gathered.add([key, doc, start, start + np.int32(LENGTH), bytes_]))
            else:
                scan(gathered.add(unpack_arrays(blob)))
            yield from out.take()
        scan(gathered.rest())
        marks.send()
        yield from out.take(0)

    return by_bucket(blobs, n).mapInArrow(run, BLOBS)


def _answer(requests: DataFrame, texts: DataFrame, n: int, paired: int) -> DataFrame:
    """The runs asked for, from their documents' texts, as parts by bucket of their core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, asked = Blobs(), Spans()
        marks, found, size = Marks(out, n), [], 0
        for kind, _, blob in blob_rows(batches):
            if kind == REQUESTS:
                asked.add(unpack_arrays(blob))
                continue
            for batch in unpack_rows(blob):
                data, offsets = text_bytes(batch.column(1))
                ids = batch.column(0).to_pylist()
                for low, high in row_ranges(offsets):
                    wanted = [asked.of(d) for d in ids[low:high]]
                    sizes = [len(s) for s, _ in wanted]
                    if not any(sizes):
                        continue
                    own = data[offsets[low] : offsets[high]]
                    base = np.repeat(offsets[low:high] - offsets[low], sizes)
                    doc = np.repeat(np.array([d if d is not None else 0 for d in ids[low:high]], np.int64), sizes)
                    first, end = np.concatenate([s for s, _ in wanted]), np.concatenate([e for _, e in wanted])
                    # A second row with the same id may be shorter than the one that was indexed.
                    ok = base + end <= np.repeat(offsets[low + 1 : high + 1] - offsets[low], sizes)
                    found.append(part_entries(own, doc[ok], base[ok], (base + first)[ok], (base + end)[ok] - LENGTH))
                    size += len(found[-1][0])
                if size > 1 << 20:
                    send_parts(out, marks, found, n, paired)
                    found, size = [], 0
            yield from out.take()
        send_parts(out, marks, found, n, paired)
        marks.send()
        yield from out.take(0)

    return by_bucket(requests.unionByName(texts), n, sort=True).mapInArrow(run, BLOBS)


def remove_repeated_bytes(docs: DataFrame, with_text: bool = False, paired: int = PAIRED, batch: int = BATCH_ENTRIES) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed), and ``kept`` (binary) if asked for.

    Removed is each byte that lies in a string of 100 bytes which also starts earlier: in a smaller doc_id, or earlier
    in the same document. Null texts count as empty. Rows with a null doc_id have no place in the order: they stay whole
    and repeat nothing. Rows that share a doc_id and text are one document. An empty table gives none; other columns are
    ignored. Every exchange has at most one entry a task for a string, whatever its count. Runs are taken for equal by 64 bits of
    hash beside 40 of the anchor's, windows by 48 of the core's beside eight bytes as they are, each with those that name the bucket.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    kind = F.col("kind")
    runs = stored(_scan_levels(_index_text(rows, n), n, KEYS, paired, batch), "suffix-runs", by="kind")
    answered = _answer(runs.where(kind == REQUESTS), text_blobs(rows, n), n, paired)
    parts = stored(_scan_levels(answered, n, PARTS, paired, batch), "suffix-parts", by="kind")
    discard(runs, f"kind={REQUESTS}")
    windows = stored(_scan_levels(parts.where(kind == WINDOWS), n, WINDOWS, paired, batch), "suffix-windows")
    discard(parts, f"kind={WINDOWS}")
    marks = runs.unionByName(parts).unionByName(windows).where(kind == MARKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Spans()
        ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for kind, _, blob in blob_rows(batches):
            if kind == MARKS:
                marked.add(unpack_arrays(blob))
                continue
            for batch in unpack_rows(blob):
                data, offsets = text_bytes(batch.column(1))
                n_removed, hashes, ranges, kept = [], [], [], []
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    own = data[offsets[k] : offsets[k + 1]]
                    low, high = marked.of(doc)
                    spans = []
                    if len(low):
                        gone = cover(low, high, len(own))
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                        spans = [{"start": a, "end": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
                        own = own[~gone]
                    n_removed.append(int(offsets[k + 1] - offsets[k]) - len(own))
                    raw = own.tobytes()
                    hashes.append(hashlib.sha256(raw).hexdigest())
                    ranges.append(spans)
                    kept.append(raw)
                columns = [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(r) for r in ranges], pa.int64()), pa.array(hashes, pa.string()), pa.array(ranges, ranges_type)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>" + ", kept binary" * with_text
    return by_bucket(marks.unionByName(text_blobs(rows, n)), n, sort=True).mapInArrow(cut, schema)
