"""Token counts by the whole-token shortcut.

The vocabulary is a merge-type piece model: text is cut before each run of spaces
that follows something else, and no piece reaches over such a cut (checked once from
the vocabulary, on the driver). So a text's tokens are the sum of its pre-tokens'.
Every vocabulary string that encodes, alone as a pre-token, to exactly one token is
proved by encoding it once; those pre-tokens count as 1 without any merging. Only the
rest are merged, by the model's own library, and remembered up to a bound. Pre-tokens are
found and looked up in arrays, by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wavelane.llm.exchange import Remembered
from wavelane.llm.textnum import hash_spans, row_ranges, text_bytes

#: Pre-tokens remembered by a worker; the memo starts again from the proved ones when it is full.
MEMO_ENTRIES = 3_000_000
#: Bytes of text whose pre-tokens are looked up together.
SLICE = 1 << 20
_MARK = "▁"
_PIECES = re.compile(r"\n[^ \n]*| +[^ \n]*")


class PieceCounter:
    """Token counts by pre-token.

    Keys: the text after a pre-token's first space, or a line feed and what follows it
    up to the next space.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        # The two facts that allow cutting: no piece has a space after something else, and none has a line feed.
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in plain):
            raise ValueError("pieces of this vocabulary reach over spaces; its texts can't be cut at them")
        if self.model.decode(self.model.encode("  a \n b ")) != "  a \n b ":
            raise ValueError("this model rewrites spaces; its texts can't be cut at them")
        keys = [p[1:].replace(_MARK, " ") for p in plain if p[0] == _MARK]
        self.whole = {k for k, ids in zip(keys, self.model.encode(keys, num_threads=1), strict=True) if len(ids) == 1 and k}
        data, offsets = text_bytes(pa.array(sorted(self.whole), pa.large_string()))
        self.proved = hash_spans(data, offsets[:-1], offsets[1:])
        self.whole.add("")  # a lone space; encoding an empty text would give nothing
        self.refill()

    def refill(self) -> None:
        self.known = Remembered()
        self.known.add(self.proved, np.ones(len(self.proved), np.int64))

    def merged(self, keys: list[str]) -> np.ndarray:
        """Counts of pre-tokens that are no whole token, by the library. It puts a space first, which can't merge with a line feed."""
        sizes = np.fromiter(map(len, self.model.encode(keys, num_threads=1)), np.int64, len(keys))
        return sizes - np.fromiter((k[0] == "\n" for k in keys), np.int64, len(keys))

    def count_one(self, text: str) -> int:
        """Tokens of a text with runs of spaces, spaces at its ends or beside line feeds, or marks of its own."""
        keys = [m[1:] if m[0] == " " else m for m in _PIECES.findall(" " + text.replace(_MARK, " "))]
        rest = [k for k in keys if k not in self.whole]
        return len(keys) - len(rest) + (int(self.merged(rest).sum()) if rest else 0)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        counts = np.zeros(n, np.int64)
        if not len(data):
            return counts
        space, feed = data == 32, data == 10
        edge = space | feed
        full = np.flatnonzero(np.diff(offsets))
        # Texts that are not simply words parted by single spaces and line feeds are counted one by one.
        odd = np.zeros(n, bool)
        odd[full] = edge[offsets[full]] | edge[offsets[full + 1] - 1]
        beside = np.flatnonzero(space[:-1] & edge[1:] | feed[:-1] & space[1:])
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        odd[np.searchsorted(offsets, np.concatenate([beside, mark]), "right") - 1] = True
        for k in np.flatnonzero(odd).tolist():
            counts[k] = self.count_one(data[offsets[k] : offsets[k + 1]].tobytes().decode())
        begins = feed.copy()
        begins[1:] |= space[:-1]
        begins[offsets[full]] = True
        begins &= ~space
        starts = np.flatnonzero(begins)
        starts = starts[~odd[np.searchsorted(offsets, starts, "right") - 1]]
        stops = edge.copy()
        stops[offsets[full]] = True
        stops = np.append(np.flatnonzero(stops), len(data))
        ends = stops[np.searchsorted(stops, starts, "right")]
        code, distinct = pd.factorize(hash_spans(data, starts, ends))
        if len(self.known) + len(distinct) > MEMO_ENTRIES:
            self.refill()
        (own,) = self.known.find(distinct, 1)
        new = np.flatnonzero(own < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            own[new] = self.merged([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.known.add(distinct[new], own[new])
        sums = np.concatenate([[0], np.cumsum(own[code])])
        at = np.searchsorted(starts, offsets)
        return counts + sums[at[1:]] - sums[at[:-1]]

    def counts(self, column) -> np.ndarray:
        """Tokens of each text of a column; 0 for a null."""
        data, offsets = text_bytes(column)
        parts = [self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_ranges(offsets, SLICE)]
        return np.concatenate([np.zeros(0, np.int64), *parts])


_counters: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    if model_path not in _counters:
        _counters[model_path] = PieceCounter(model_path)
    return _counters[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of ``docs``.

    Null texts count as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows
    give repeated rows; other columns are ignored; an empty table gives none. One pass
    over the scan, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            texts = batch.column(1)
            n = own.counts(texts)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
