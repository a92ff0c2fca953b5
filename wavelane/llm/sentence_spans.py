"""Substring dedup by sliding sentence spans, and by word runs as an option.

A sentence ends with a word that ends in a full stop, question or exclamation mark, or that
a line feed or the text's end follows. From each sentence runs the shortest span of at least
two sentences and twelve words that starts there, and to each the shortest that ends there;
every span is hashed by its words. Spans are joined over all documents, and the sentences that one covers which
also occurs earlier (smaller doc_id, or same document and earlier start) are removed.

A passage that begins or ends inside of a host's sentence shares no such span with its edges. With
``run_words`` every run of so many words is hashed as well, from each word on, and the words of a run that occurs
earlier are removed, also from within a sentence: no run of that many words is then left that occurs earlier, wherever
sentences end. Sentences removed whole and sentences that only lose words are counted apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavelane.llm.exchange import BLOBS, FLUSH_BYTES, KEYS, MARKS, TEXTS, Batches, Blobs, Levels, Spans, blob_rows, by_bucket, by_place, cover, doc_bucket, first_of_each, joined, key_bucket, text_blobs, unpack_arrays, unpack_rows
from wavelane.llm.shared import partitions
from wavelane.llm.textnum import BYTE_KEYS, U64, Sums, find_words, hash_spans, mix, returned, row_ranges, text_bytes

LEAST_SENTENCES, LEAST_WORDS = 2, 12
#: Words that repeat count from here on whatever sentences they stand in.
RUN_WORDS = 51
#: Bytes of text whose spans and runs, one a word, a task gathers before it sends them.
GATHER_BYTES = FLUSH_BYTES // 16
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, each sentence's first word (and the number of words at the end), rows' n + 1 sentence offsets."""
    starts, ends, word_at = find_words(data, offsets)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    closes = _STOP[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    closes[:-1] |= feeds[starts[1:]] > feeds[ends[:-1]]
    last = word_at[1:][np.diff(word_at) > 0] - 1
    closes[last] = True
    begins = np.ones(len(starts), bool)
    begins[1:] = closes[:-1]
    first = np.append(np.flatnonzero(begins), len(starts))
    return starts, ends, first, np.searchsorted(first[:-1], word_at)


def spans(first: np.ndarray, sentence_at: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first sentences and ends of the shortest long-enough spans from and to each sentence."""
    n = len(first) - 1
    row = np.repeat(np.arange(len(sentence_at) - 1), np.diff(sentence_at))
    k = np.arange(n)
    stop = np.maximum(np.searchsorted(first, first[:-1] + least_words), k + least_sentences)
    ok = stop <= sentence_at[1:][row]
    from_, to = k[ok], stop[ok]
    start = np.minimum(np.searchsorted(first, first[1:] - least_words, "right") - 1, k + 1 - least_sentences)
    ok = start >= sentence_at[:-1][row]
    pair = np.unique(np.concatenate([from_ << 32 | to, start[ok] << 32 | (k[ok] + 1)]))
    low = pair >> 32
    return row[low] if len(low) else low, low, pair & 0xFFFFFFFF


def span_entries(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, least_sentences: int, least_words: int, run_words: int | None = None) -> list[np.ndarray]:
    """(key, doc, start, end) of all spans and runs of the rows, places counted in words of the document."""
    starts, ends, first, at = sentences(data, offsets)
    row, low, high = spans(first, at, least_sentences, least_words)
    word_at = first[at]
    low, high = first[low], first[high]
    if run_words:
        runs = np.maximum(np.diff(word_at) - run_words + 1, 0)
        run_row = np.repeat(np.arange(len(runs)), runs)
        run = np.arange(len(run_row)) + (word_at[:-1] - np.cumsum(runs) + runs)[run_row]
        row, low, high = np.concatenate([row, run_row]), np.concatenate([low, run]), np.concatenate([high, run + run_words])
    words = hash_spans(data, starts, ends, BYTE_KEYS)
    key = mix(Sums(words >> U64(3)).of(low, high) + (high - low).astype(U64))
    base = word_at[row]
    return [key, ids[row], (low - base).astype(np.int32), (high - base).astype(np.int32)]


def repeated_spans(docs: DataFrame, least_sentences: int, least_words: int, run_words: int | None, n: int) -> DataFrame:
    """Blobs of marks, by document, of all spans and runs that also occur earlier."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, size = Blobs(), [], 0

        def send() -> None:
            nonlocal parts, size
            if parts:
                firsts, others = first_of_each([np.concatenate(x) for x in zip(*parts, strict=True)])
                firsts = by_place(firsts)
                out.deal(KEYS, key_bucket(firsts[0], n), firsts)
                doc, start, end = joined(*others[1:])
                out.deal(MARKS, doc_bucket(doc, n), [doc, start, end])
                parts, size = [], 0

        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_bytes(batch.column(1))
            for low, high in row_ranges(offsets):
                parts.append(span_entries(ids[low:high], data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], least_sentences, least_words, run_words))
                size += int(offsets[high] - offsets[low])
                if size >= GATHER_BYTES:
                    send()
            yield from out.take()
        send()
        yield from out.take(0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, levels, gathered = Blobs(), Levels(), Batches()
        late, size = [], 0

        def scan(entries: list[list[np.ndarray]], most: int) -> None:
            nonlocal late, size
            for batch in entries:
                levels.add(batch)
                late += levels.take()
                size = sum(len(a[0]) for a in late)
            if size > most:
                doc, start, end = joined(*(np.concatenate(x) for x in zip(*late, strict=True)))
                out.deal(MARKS, doc_bucket(doc, n), [doc, start, end])
                late, size = [], 0

        for kind, bucket, blob in blob_rows(batches):
            if kind == MARKS:
                out.put(MARKS, bucket, blob)
            else:
                scan(gathered.add(unpack_arrays(blob)), 1 << 18)
            yield from out.take()
        scan(gathered.rest(), 0)
        yield from out.take(0)

    return by_bucket(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(returned(gather), BLOBS), n).mapInArrow(returned(meet), BLOBS)


def remove_repeats(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, run_words: int | None = None, names: tuple[str, str, str, str] = ("n_sentences", "n_removed", "n_cut", "removed")) -> DataFrame:
    """``docs`` with repeated spans and runs cut out of ``text``, and n_sentences, n_removed (those removed whole), n_cut (those that lose
    words and keep some: none without ``run_words``), removed (byte ranges of the old text), under other ``names`` if asked for.

    All columns are kept; the new ones replace columns of their names. Rows with a null doc_id have no place in the order: they stay
    whole and repeat nothing. Rows that share a doc_id and text are one document; a null text stays null, with no sentences; an
    empty table gives none. Spans are dealt by their hash, one entry a task at most; marks and compressed texts by document.
    """
    n = partitions(docs.sparkSession)
    new = list(names)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", *new)]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *rest)
    marks = repeated_spans(docs, least_sentences, least_words, run_words, n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Spans()
        for kind, _, blob in blob_rows(batches):
            if kind == MARKS:
                marked.add(unpack_arrays(blob))
                continue
            assert kind == TEXTS
            for batch in unpack_rows(blob):
                data, offsets = text_bytes(batch.column(1))
                starts, _, first, at = sentences(data, offsets)
                texts, counts, removed, cut_, ranges = batch.column(1).to_pylist(), np.diff(at), [], [], []
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    low, high = marked.of(doc)
                    own = first[at[k] : at[k + 1] + 1] - first[at[k]]
                    gone = cover(low, high, int(own[-1])) if len(low) else np.zeros(own[-1], bool)
                    removed.append(int(np.logical_and.reduceat(gone, own[:-1]).sum()) if len(low) else 0)
                    cut_.append(int(np.logical_or.reduceat(gone, own[:-1]).sum()) - removed[-1] if len(low) else 0)
                    ranges.append([])
                    if removed[-1] or cut_[-1]:
                        # A word reaches to the next one; the first from the text's start.
                        edge = np.append(starts[first[at[k]] : first[at[k + 1]]], offsets[k + 1]) - offsets[k]
                        edge[0] = 0
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                        ranges[-1] = [{"start": int(edge[a]), "end": int(edge[b])} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                        raw, left, stay = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
                        for r in ranges[-1]:
                            stay.append(raw[left : r["start"]])
                            left = r["end"]
                        texts[k] = (b"".join(stay) + raw[left:]).decode()
                kind_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut_, pa.int64()), pa.array(ranges, kind_)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", *rest, *new])

    schema = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in rows.dtypes) + f", `{names[0]}` long, `{names[1]}` long, `{names[2]}` long, `{names[3]}` array<struct<start: long, end: long>>"
    return by_bucket(marks.unionByName(text_blobs(rows, n)), n, sort=True).mapInArrow(returned(cut), schema)
