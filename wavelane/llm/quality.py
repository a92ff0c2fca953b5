"""Quality rules with a linear-chain conditional random field over a document's lines.

Base rules are counted over the whole text. Each line that has a word is then one position
of the field: its features are shares of kinds of characters and of repetition, its label is
content or boilerplate, and the best labelling of the whole sequence is found by Viterbi
decoding. A document that passes the base rules is kept if lines labelled content hold
enough of its words.

The field is trained by gradient ascent on a bounded sample of labelled documents; all lines
of a document of quality 1 count as content, all of one of quality 0 as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.shared import bounded_sample, sampled_texts
from wavelane.llm.textnum import IS_SPACE, find_words, hash_spans, returned, row_ranges, shingles, sum_by_row, text_bytes

#: Labelled documents sampled of each quality at most: the bound of the fit.
SAMPLE_PER_QUALITY = 600
#: Share of words on content lines that a kept document has at least.
CONTENT_SHARE = 0.5
WINDOW = 8
FEATURES = ("bias", "symbols", "upper case", "exclamations", "digits", "bars", "same word again", "repeated line", "repeated windows", "few words", "no final stop", "characters a word")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _UPPER = _table(b"#*$%&|<>"), _table(bytes(range(65, 91)))
_DIGITS, _STOPS = _table(b"0123456789"), _table(b".!?:;\"')")
_LETTERS = _table(bytes(range(65, 91)) + bytes(range(97, 123)))


def _again(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a value is also elsewhere in its row, and whether it is also earlier there."""
    order = np.lexsort((values, rows))
    same = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    any_, earlier = np.zeros(len(values), bool), np.zeros(len(values), bool)
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    earlier[order[1:]] = same
    return any_, earlier


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts by row; and of lines with a word their features, words and n + 1 row offsets."""
    rows = len(offsets) - 1
    starts, ends, word_at = find_words(data, offsets)
    n_words = np.diff(word_at)
    in_word, begins = ~IS_SPACE[data], (data & 0xC0) != 0x80
    word_hash = hash_spans(data, starts, ends)
    word_row = np.repeat(np.arange(rows), n_words)

    # Words in windows of eight that occur again in the text.
    windows, window_at = shingles(word_hash, word_at, WINDOW)
    window_row = np.repeat(np.arange(rows), np.diff(window_at))
    twice, _ = _again(windows, window_row)
    first = word_at[:-1][window_row] + np.arange(len(windows)) - window_at[:-1][window_row]
    steps = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(steps, first[twice], 1)
    np.add.at(steps, first[twice] + WINDOW, -1)
    repeats = np.cumsum(steps)[: len(starts)] > 0

    # Lines: cut at line feeds and rows' ends; those without a word are left out.
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 10) if len(line_end) else line_end
    low, high = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    has = high > low
    line_start, line_end, low, high = line_start[has], line_end[has], low[has], high[has]
    line_row = word_row[low] if len(low) else np.zeros(0, np.int64)
    line_at = np.searchsorted(line_row, np.arange(rows + 1))
    _, dup_line = _again(hash_spans(data, line_start, line_end), line_row)

    base = {
        "n_words": n_words,
        "word_chars": sum_by_row(in_word & begins, offsets),
        "n_symbols": sum_by_row(_SYMBOLS[data], offsets),
        "n_dup_lines": sum_by_row(dup_line, line_at),
        "n_repeat_words": sum_by_row(repeats, word_at),
    }

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[line_end] - sums[line_start]

    words = (high - low).astype(float)
    chars = np.maximum(share(begins & in_word), 1)
    same = np.zeros(len(starts), bool)
    same[1:] = word_hash[1:] == word_hash[:-1]
    count = lambda mask: (s := np.concatenate([[0], np.cumsum(mask)]))[high] - s[low]
    last = data[ends[high - 1] - 1] if len(high) else np.zeros(0, np.uint8)
    x = np.stack(
        [
            np.ones(len(words)),
            np.minimum(8 * share(_SYMBOLS[data]) / chars, 1),
            share(_UPPER[data]) / np.maximum(share(_LETTERS[data]), 1),
            np.minimum(share(data == 33) / words, 1),
            share(_DIGITS[data]) / chars,
            np.minimum(share(data == 124) / words, 1),
            count(same) / words,
            dup_line.astype(float),
            count(repeats) / words,
            (words < 3).astype(float),
            (~_STOPS[last]).astype(float),
            np.minimum(chars / words / 10, 2) - 0.5,
        ],
        axis=1,
    )
    return base, x, high - low, line_at


@dataclass
class LineField:
    """A linear-chain field of two labels: 1 content, 0 boilerplate."""

    weights: np.ndarray  # of the features, for label 1 against label 0
    moves: np.ndarray  # 2 x 2, score of a label after a label

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def decode(self, x: np.ndarray, line_at: np.ndarray) -> np.ndarray:
        """The best labelling of each row's lines (Viterbi), a tie going to content."""
        score, n = self.scores(x), np.diff(line_at)
        labels = np.zeros(len(score), np.int64)
        order = np.argsort(-n, kind="stable")
        n, first = n[order], line_at[:-1][order]
        if not len(n) or n[0] == 0:
            return labels
        longest = int(n[0])
        live = np.searchsorted(-n, -np.arange(longest), "left")  # rows that have a t-th line
        best = np.zeros((live[0], 2))
        best[:, 1] = score[first[: live[0]]]
        came = []
        for t in range(1, longest):
            k = live[t]
            reach = best[:k, :, None] + self.moves[None]
            came.append((reach[:, 1] >= reach[:, 0]).astype(np.int8))
            new = reach.max(axis=1)
            new[:, 1] += score[first[:k] + t]
            best[:k] = new
        now = (best[:, 1] >= best[:, 0]).astype(np.int64)
        for t in range(longest - 1, -1, -1):
            k = live[t]
            labels[first[:k] + t] = now[:k]
            if t:
                now[:k] = came[t - 1][np.arange(k), now[:k]]
        return labels

    @staticmethod
    def fit(x: np.ndarray, line_at: np.ndarray, quality: np.ndarray, steps: int = 80, decay: float = 1.0) -> LineField:
        """Maximises the mean log-likelihood of the rows' labels, less ``decay`` times the squared weights over the number of lines."""
        field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)))
        n = np.diff(line_at)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        if not len(order) or len(set(quality[order])) < 2:
            field.weights[0] = 1.0  # nothing to tell apart: all lines are content
            return field
        n, first, y = n[order], line_at[:-1][order], quality[order]
        longest, lines = int(n[0]), int(n.sum())
        live = np.searchsorted(-n, -np.arange(longest), "left")
        class_weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        grads = [np.zeros(x.shape[1]), np.zeros((2, 2))]
        first_moment = [g.copy() for g in grads]
        second_moment = [g.copy() for g in grads]
        for step in range(1, steps + 1):
            score = field.scores(x)
            emit = lambda t: np.stack([np.zeros(live[t]), score[first[: live[t]] + t]], axis=1)  # noqa: E731, B023
            forward = [emit(0)]
            for t in range(1, longest):
                forward.append(np.logaddexp.reduce(forward[-1][: live[t], :, None] + field.moves[None], axis=1) + emit(t))
            total = np.zeros(len(n))
            for t in range(longest):
                last = slice(live[t + 1] if t + 1 < longest else 0, live[t])
                total[last] = np.logaddexp.reduce(forward[t][last], axis=1)
            expected, moves = np.zeros(len(score)), np.zeros((2, 2))
            back = np.zeros((live[-1], 2))
            for t in range(longest - 1, -1, -1):
                k = live[t]
                expected[first[:k] + t] = np.exp(forward[t][:, 1] + back[:, 1] - total[:k])
                if t:
                    after = back + emit(t)
                    pair = np.exp(forward[t - 1][:k, :, None] + field.moves[None] + after[:, None] - total[:k, None, None])
                    moves -= (pair * class_weight[:k, None, None]).sum(axis=0)
                    same = np.bincount(y[:k], class_weight[:k], 2)
                    moves[0, 0] += same[0]
                    moves[1, 1] += same[1]
                    shorter = np.zeros((live[t - 1], 2))
                    shorter[:k] = np.logaddexp.reduce(field.moves[None] + after[:, None], axis=2)
                    back = shorter
            wanted, weight = np.zeros(len(score)), np.zeros(len(score))
            line = np.concatenate([np.arange(a, a + m) for a, m in zip(first, n, strict=True)])
            wanted[line], weight[line] = np.repeat(y, n), np.repeat(class_weight, n)
            grads = [(x.T @ ((wanted - expected) * weight) - decay * field.weights) / lines, (moves - decay * field.moves) / lines]
            for k, own in enumerate((field.weights, field.moves)):
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * grads[k]
                second_moment[k] = 0.99 * second_moment[k] + 0.01 * grads[k] ** 2
                own += 0.15 * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-8)
        return field


def fit_field(docs: DataFrame, labels: DataFrame, per_quality: int = SAMPLE_PER_QUALITY) -> LineField:
    """Fits the field on the labelled documents with the smallest id hashes, ``per_quality`` of each quality at most.

    Labels other than 0 and 1, labels without a text and repeated rows don't count; a document with both labels counts as 0, of a repeated
    id the least text counts. Without both qualities all lines are content.
    """
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null")
    picked = bounded_sample(marked, "quality", per_quality)
    quality: dict[int, int] = {}
    for r in picked.collect():
        quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    rows = sorted(sampled_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), picked), key=lambda r: r.doc_id)
    if not rows:
        return LineField.fit(np.zeros((0, len(FEATURES))), np.zeros(1, np.int64), np.zeros(0, np.int64))
    data, offsets = text_bytes(pa.array([r.text for r in rows], pa.large_string()))
    parts = [measure(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in row_ranges(offsets)]
    line_at = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.diff(p[3]) for p in parts)]))
    return LineField.fit(np.concatenate([p[1] for p in parts]), line_at, np.array([quality[r.doc_id] for r in rows]))


def verdicts(column, field: LineField, content_share: float) -> list[np.ndarray]:
    """Base counts, base_failed, kept, content_share, n_lines and n_content_lines of a text column."""
    data, offsets = text_bytes(column)
    parts: list[list[np.ndarray]] = []
    for low, high in row_ranges(offsets):
        base, x, words, line_at = measure(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        content = field.decode(x, line_at)
        share = sum_by_row(words * content, line_at) / np.maximum(base["n_words"], 1)
        failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
        parts.append([*(base[k] for k in BASE), failed, ~failed & (share >= content_share), share, np.diff(line_at), sum_by_row(content, line_at)])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def assess(docs: DataFrame, field: LineField, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Rows (doc_id, base counts, base_failed, kept, content_share, n_lines, n_content_lines), one for each row of ``docs``.

    Null and empty texts have counts of 0 and fail the base rules; repeated rows give repeated rows; other
    columns are ignored; an empty table gives none. One pass over the scan, without a shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)  # a few numbers
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
    names = ["doc_id", *BASE, "base_failed", "kept", "content_share", "n_lines", "n_content_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = verdicts(batch.column(1), held.value, content_share)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def keep_content(docs: DataFrame, field: LineField, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; the text is cast to a string.

    Null and empty texts fail the base rules and go; repeated rows stay or go together; a null doc_id makes no difference; columns
    of any name are carried along; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.withColumn("text", docs["text"].cast("string"))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdicts(batch.column(at), held.value, content_share)[6]))

    return rows.mapInArrow(returned(run), rows.schema)
