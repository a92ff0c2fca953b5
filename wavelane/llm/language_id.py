"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``order`` is counted on a bounded
sample of labelled texts and then frozen. A text's code length under a tree is exact: in
its longest known context a byte costs -log2(c / (n + q)), with c its count there, n all
counts and q the distinct bytes; a byte new to the context costs the escape
-log2(q / (n + q)) and is coded in the next shorter one; below order 0 a byte costs
8 bits. A text starts in the context of line feeds. The shortest code names the language.

With frozen statistics a byte's cost follows from it and the ``order`` bytes before it, so
whole texts are scored by factorizing their (order + 1)-grams and pricing distinct grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from wavelane.llm.shared import bounded_sample, sampled_texts
from wavelane.llm.textnum import returned, row_ranges, sum_by_row, text_bytes

#: Labelled texts sampled for each language at most: the bound of the fit.
SAMPLE_PER_LANGUAGE = 400
ORDER = 4
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MEMO_GRAMS = 1 << 19


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` bytes before it, as one integer; each row starts after line feeds."""
    n, rows = len(data), np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    at = np.arange(n) + order * rows
    padded = np.full(n + order * (len(offsets) - 1), 10, np.int64)
    padded[at] = data
    code = padded[order:].copy()
    for k in range(1, order + 1):
        code |= padded[order - k : len(padded) - k] << (8 * k)
    return code[at - order]


@dataclass
class ContextTrees:
    """Frozen counts of one language: for each order, its contexts with totals and their grams with counts."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    grams: list[np.ndarray]
    counts: list[np.ndarray]

    @staticmethod
    def fit(texts: list[bytes], order: int) -> ContextTrees:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        full = grams(data, offsets, order)
        trees = ContextTrees([], [], [], [], [])
        for k in range(order + 1):
            gram, count = np.unique(full & ((1 << 8 * (k + 1)) - 1), return_counts=True)
            context, at = np.unique(gram >> 8, return_inverse=True)
            trees.grams.append(gram)
            trees.counts.append(count)
            trees.contexts.append(context)
            trees.totals.append(np.bincount(at, count, len(context)).astype(np.int64))
            trees.kinds.append(np.bincount(at, minlength=len(context)))
        return trees

    def cost(self, full: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the bytes before it."""
        bits, open_ = np.zeros(len(full)), np.arange(len(full))
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(self.contexts[k]) or not len(open_):
                continue
            gram = full[open_] & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], gram >> 8), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == gram >> 8
            n, q = self.totals[k][at], self.kinds[k][at]
            i = np.minimum(np.searchsorted(self.grams[k], gram), len(self.grams[k]) - 1)
            seen = self.grams[k][i] == gram
            share = np.where(seen, self.counts[k][i], q) / (n + q)
            bits[open_] -= np.where(known, np.log2(share), 0)
            open_ = open_[~seen]
        bits[open_] += 8
        return bits


def labelled_texts(docs: DataFrame, learns: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, language) of the rows to learn from: of each language those with the smallest id hashes, ``per_language`` at most.

    Rows without a doc_id, text or language don't count; of a repeated id the least text and language count.
    """
    own = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return sorted((r.text, r.lang) for r in sampled_texts(own, bounded_sample(own, "lang", per_language), "lang"))


@dataclass
class LanguageModel:
    languages: list[str]
    trees: list[ContextTrees]
    order: int

    @staticmethod
    def fit(rows: list[tuple[str, str]], order: int = ORDER) -> LanguageModel:
        """``rows``: (text, language)."""
        languages = sorted({lang for _, lang in rows})
        return LanguageModel(languages, [ContextTrees.fit([t.encode() for t, lang in rows if lang == own], order) for own in languages], order)


class Scorer:
    """Code lengths of rows of text, with a bounded memo of priced grams."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known = np.zeros(0, np.int64)
        self.bits = np.zeros((len(model.languages), 0))

    def prices(self, full: np.ndarray) -> np.ndarray:
        """Bits of distinct grams by language."""
        at = np.searchsorted(self.known, full)
        new = np.ones(len(full), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != full[inside]
        out = np.empty((len(self.model.languages), len(full)))
        out[:, ~new] = self.bits[:, at[~new]]
        if new.any():
            out[:, new] = np.array([t.cost(full[new]) for t in self.model.trees])
            if len(self.known) + new.sum() > _MEMO_GRAMS:
                self.known, self.bits = full, out
            else:
                known = np.concatenate([self.known, full[new]])
                order = np.argsort(known, kind="stable")
                self.known, self.bits = known[order], np.concatenate([self.bits, out[:, new]], axis=1)[:, order]
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row by language."""
        out = np.zeros((len(self.model.languages), len(offsets) - 1))
        for low, high in row_ranges(offsets):
            own = offsets[low : high + 1] - offsets[low]
            part = data[offsets[low] : offsets[high]]
            if not len(part):
                continue
            at, distinct = pd.factorize(grams(part, own, self.model.order))
            price = self.prices(distinct)
            for k in range(len(out)):
                out[k, low:high] = sum_by_row(price[k][at], own)
        return out


def predictions(column, scorer: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and code length of each text of a column."""
    languages = scorer.model.languages
    data, offsets = text_bytes(column)
    letters = np.fromiter((t is not None and _LETTER.search(t) is not None for t in (x.as_py() for x in column)), bool, len(column))
    names = np.array([*languages, UNKNOWN], object)
    if not languages:
        return np.full(len(column), UNKNOWN, object), np.zeros(len(column)), np.zeros(len(column))
    bits = scorer.code_lengths(data, offsets)
    best = np.argmin(bits, axis=0)
    least = bits[best, np.arange(len(column))]
    score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=0)
    return names[np.where(letters, best, len(languages))], np.where(letters, score, 0.0), least


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows (doc_id, lang_pred, score, n_bytes, bits), one for each row of ``docs``.

    ``score`` is the best language's share when each is weighted by 2 to the power of minus its code
    length; ``bits`` is the best code length. Null texts and texts without a letter are ``und`` with score 0.
    A tie goes to the first language in order of name. Without a learned language all rows are ``und``.
    Repeated rows give repeated rows; an empty table gives none; other columns are ignored. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: it is fitted on a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            lang, score, bits = predictions(batch.column(1), scorer)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), size, pa.array(bits)], ["doc_id", "lang_pred", "score", "n_bytes", "bits"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_bytes long, bits double")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns; the text is cast to a string.

    A model that has learned no language tells nothing and keeps every row with a letter. Null texts and texts without a letter go; repeated rows
    stay or go together; a null doc_id makes no difference; columns of any name are carried along; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("text", docs["text"].cast("string"))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            column = batch.column(at)
            if held.value.languages:
                keep = predictions(column, scorer)[0] != UNKNOWN
            else:
                keep = [t is not None and _LETTER.search(t) is not None for t in column.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(returned(run), rows.schema)
