"""Scores of texts by online logistic context mixing.

A text is a row of tokens: its words with A-Z folded, then an end. Each token is coded in binary decisions. The first says whether it is in the
lexicon, a bounded table of the most frequent tokens. A token of the lexicon has its class spelled out bit by bit, and its share of the class's
count; any other word is spelled out byte by byte, bit by bit, up to a closing space. For each bit several predictors look up what followed
their hashed contexts in the training texts; their log odds are added with weights that a gate picks, and the sum is refined by what came true where it stood before.

Classes: the contexts are none, the token before, and the text so far; weights and refinement start alike in each text and learn
from each block of its tokens before the next is scored. They start from the mean of where the training texts' own end. Spelling: the contexts are the last 1, 2, 3 and 5 bytes of the word; weights and refinement learn online over
the training vocabulary, in streams dealt by hash, and are then the mean of the streams. Counts come from all training texts. What a text, or a word's own
type, has put into them is taken out again before it is scored, so that nothing predicts itself (but for the counts without a context).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wavelane.llm.exchange import BLOBS, KEYS, Blobs, blob_rows, by_bucket, pack_arrays, unpack_arrays
from wavelane.llm.shared import partitions, stored
from wavelane.llm.textnum import IS_SPACE, U64, find_words, hash_spans, mix, row_ranges, text_bytes

#: Tokens in the lexicon at most, and bytes of one at most.
LEXICON, LONGEST = 1 << 17, 64
#: Fewest occurrences of a token in the lexicon: those with fewer would be told from unseen ones only in the texts that they come from.
LEAST = 3
#: Half of a class's bits come from how a token begins, half from how it ends.
CLASS_BITS = 8
#: Places of each predictor's table. They bound the model's size; contexts that share one blur.
SLOTS = 1 << 20
#: Places in a part of a table, which is what tasks send.
PART = 1 << 14
#: Streams of words that spelling weights learn from, each in order of the words' hashes.
STREAMS = 16
ORDERS = (1, 2, 3, 5)
#: Tokens of a text that are scored before its weights learn from them; words of a stream likewise.
BLOCK, WORD_BLOCK = 32, 128
#: Bytes of texts, and of words to spell, that are worked on at once; and tokens whose decisions are counted at once.
COUNTED = 1 << 15
SLICE = 1 << 22
#: Bytes of coded texts, four a token, that are worked on at once.
CODED_SLICE = 5 * SLICE // 8
SPELL_SLICE = 1 << 15
#: Bytes of words, and texts' blocks, whose decisions are scored at once: so few that their arrays stay in a core's cache.
SPELLED, BLOCKS = 1 << 12, 64
PRIOR, CELLS, PATIENCE = 0.4, 24, 32.0
#: Step of a weight for one decision, and how many decisions' steps a block adds up at most.
CLASS_RATE, SPELL_RATE = (0.02, 16), (0.02, 128)
#: Numbers of occurrences at which a context counts as seen a little, more and often.
SEEN = (1, 4, 32)
#: Occurrences that the global chances of a class's bits stand for beside those in the text so far.
OWN = 8.0
#: Log odds beyond which no mixed chance goes.
_SURE = np.float32(np.log((1 - 1e-5) / 1e-5))
_FOLD, _SPACES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), np.flatnonzero(IS_SPACE).astype(np.uint8).tobytes()
_CLASSES = np.arange(1 << CLASS_BITS)
#: Node and bit of each decision on the way to each class; node 0 is that of the lexicon.
_NODES = np.stack([(1 << k) | (_CLASSES >> (CLASS_BITS - k)) for k in range(CLASS_BITS)], 1)
_BITS = np.stack([(_CLASSES >> (CLASS_BITS - 1 - k)) & 1 for k in range(CLASS_BITS)], 1)
_HALF = CLASS_BITS // 2
#: Which of the sixteen neighbouring places that half a class's, or half a byte's, bits share is that of each decision.
_NEAR = np.where(np.arange(CLASS_BITS) < _HALF, _NODES, (1 << np.arange(CLASS_BITS) % _HALF) | ((_NODES & ((1 << np.arange(CLASS_BITS)) - 1)) & ((1 << np.arange(CLASS_BITS) % _HALF) - 1)))
#: The decisions of a token of each class one after the other, that of the lexicon first, and last the only one of a token outside: node, bit, neighbour, half.
_STEPS = CLASS_BITS + 1
_PATH_NODE, _PATH_BIT, _PATH_NEAR, _PATH_HALF = (
    np.append(np.column_stack([np.full(len(_CLASSES), first), own]).ravel(), last)
    for first, own, last in ((0, _NODES, 0), (1, _BITS, 0), (0, _NEAR, 0), (0, np.tile(np.arange(CLASS_BITS) >= _HALF, (len(_CLASSES), 1)).astype(np.int64), 0))
)
#: By decision and class: twice the node and the bit, the bit, what a place is to be combined with for its neighbour, and that for a text or word
#: that is among the counts (classes from 256 on), which sees the odds less its own occurrence.
_NODE_BIT, _BIT, _NEXT = (np.ascontiguousarray(own.T) for own in (2 * _NODES + _BITS, _BITS.astype(np.float32), np.concatenate([_NEAR, _NEAR | (1 + _BITS) * SLOTS])))
#: The first of the refinement's cells of each decision of a class.
_CELLS = CELLS * np.arange(1, CLASS_BITS + 1)[:, None]
#: The same by class, then decision.
_BIT_OF, _NEXT_OF = np.ascontiguousarray(_BIT.T), np.ascontiguousarray(_NEXT.T)


def _halves(context: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each context a place for the first half of the value's bits and one for the second, which depends on the first. Decisions of a half are
    at places that differ in the last four bits, so that they are near in memory; the places of different contexts spread evenly."""
    # Contexts are mixed already, so the high bits of a product are enough.
    node = np.column_stack([np.zeros(len(value), U64), (16 | value >> _HALF).astype(U64)])
    return (((context[:, None] + node * U64(0x9E3779B97F4A7C15)) * U64(0xBF58476D1CE4E5B9)) >> U64(44)).astype(np.int64)


def typed_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the number among these of each token in order, and how many tokens each text has; the empty token is the end."""
    starts, ends, at = find_words(data, offsets)
    n = np.diff(at) + 1
    size = np.zeros(int(n.sum()), np.int64)
    is_word = np.ones(len(size), bool)
    is_word[np.cumsum(n) - 1] = False
    size[is_word] = ends - starts
    edges = np.concatenate([[0], np.cumsum(size)])
    letters = data.tobytes().translate(_FOLD, _SPACES)
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(edges), pa.py_buffer(letters)).dictionary_encode()
    return words.dictionary.cast(pa.string()), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), n


def token_counts(docs: DataFrame, learned: Column) -> DataFrame:
    """(word, c) of the tokens of all texts to be learned from; the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, data, offsets in text_slices(batches, 2 * SLICE):
            types, type_, _ = typed_tokens(data, offsets)
            yield pa.RecordBatch.from_arrays([types, pa.array(np.bincount(type_, minlength=len(types)))], ["word", "n"])

    tokens = docs.where(learned).select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return tokens.groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon:
    """The most frequent tokens, at most LEXICON, with their counts, and what the corpus has in all."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int):
        order = np.argsort(np.array(words, object)) if words else np.zeros(0, np.int64)
        self.words = pa.array([words[k] for k in order], pa.string())
        self.counts = np.array(counts, np.int64)[order]
        self.total, self.distinct = total, distinct
        self.classes = word_classes(self.words)
        own, edges = text_bytes(self.words)
        self.hash = hash_spans(own, edges[:-1], edges[1:])
        self.by_hash = np.argsort(self.hash)
        self.sorted = self.hash[self.by_hash]
        of_class = np.bincount(self.classes, self.counts, 1 << CLASS_BITS)
        self.share = np.log10(self.counts / of_class[self.classes]) if words else np.zeros(0)
        self.base = base_log(self.counts, total, distinct)

    @classmethod
    def of(cls, words: DataFrame, most: int = LEXICON) -> Lexicon:
        """From (word, c). The least count is found from the numbers of words by sixteenths of a doubling, so no table of words is ranked."""
        total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        step = F.floor(F.log2("c") * 16).cast("int")
        short = words.where((F.octet_length("word") <= LONGEST) & (F.col("c") >= LEAST))
        least, held = None, 0
        for r in sorted(short.groupBy(step.alias("s")).count().collect(), reverse=True):
            held += r["count"]
            if held > most:
                break
            least = r["s"]
        rows = short.where(step >= least).select("word", "c").collect() if least is not None else []
        return cls([r.word for r in rows], [r.c for r in rows], total, distinct)

    def numbers(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, found by its hash and confirmed by its letters; -1 for words outside."""
        if not len(self.sorted) or (self.sorted[1:] == self.sorted[:-1]).any():
            return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = self.by_hash[np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)]
        return np.where(pc.equal(self.words.take(pa.array(number)), words).to_numpy(zero_copy_only=False), number, -1)


def base_log(counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))


def word_classes(words: pa.Array) -> np.ndarray:
    """A class for each token by hashes of its first two and of its last two bytes, which words of one language share more often."""
    data, offsets = text_bytes(words)
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
    size, half = np.diff(offsets), CLASS_BITS // 2
    first = padded[offsets[:-1]] * (size > 0) + 256 * padded[offsets[:-1] + 1] * (size > 1)
    last = padded[offsets[1:] - 1] * (size > 0) + 256 * padded[offsets[1:] - 2] * (size > 1)
    high, low = ((mix(x.astype(U64) + U64(salt)) >> U64(64 - half)).astype(np.int64) for x, salt in ((first, 1), (last, 2)))
    return high << half | low


class Tokens:
    """The tokens of some texts: for each its text, place there, hash, class, and number in the lexicon or -1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon):
        self.types, self.type, n = typed_tokens(data, offsets)
        self.row = np.repeat(np.arange(len(n)), n)
        self.first = np.cumsum(n) - n
        self.place = np.arange(len(self.type)) - np.repeat(self.first, n)
        self.count = n
        own, edges = text_bytes(self.types)
        self.type_hash = hash_spans(own, edges[:-1], edges[1:])
        self.hash = self.type_hash[self.type]
        self.known = lexicon.numbers(self.types, self.type_hash)[self.type]
        self.class_ = word_classes(self.types)[self.type]
        self._contexts()

    @classmethod
    def coded(cls, ids: pa.Array, hashes: pa.Array, lexicon: Lexicon) -> Tokens:
        """The same from texts as ``coded`` has them. What the words outside are isn't told, and their class, which nothing depends on, is 0."""
        out = object.__new__(cls)
        (id_, at), (own, outside) = (_numbers(column, kind) for column, kind in ((ids, np.int32), (hashes, U64)))
        n = np.diff(at)
        out.row, out.first, out.count = np.repeat(np.arange(len(n)), n), at[:-1], n
        out.place = np.arange(len(id_)) - np.repeat(out.first, n)
        inside, rare = np.flatnonzero(id_ >= 0), np.flatnonzero(id_ < 0)
        number = id_[inside].astype(np.int64)
        out.known, out.class_, out.hash = np.full(len(id_), -1), np.zeros(len(id_), np.int64), np.zeros(len(id_), U64)
        out.known[inside], out.class_[inside], out.hash[inside] = number, lexicon.classes[number], lexicon.hash[number]
        out.hash[rare] = own[outside[out.row[rare]] - 1 - id_[rare]]
        out._contexts()
        return out

    def _contexts(self) -> None:
        # The token before, as a hash; at a text's start there is none.
        before = np.concatenate([np.zeros(1, U64), self.hash[:-1]])
        before[self.first] = 0
        self.before = mix(before + U64(1))

    def decisions(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Token, node, bit and each predictor's places of all decisions of some tokens, in order."""
        inside = self.known[own] >= 0
        n = 1 + CLASS_BITS * inside
        ends = np.cumsum(n)
        at = np.repeat(np.arange(len(n)), n)
        path = np.repeat(np.where(inside, self.class_[own] * _STEPS, len(_PATH_NODE) - 1) - (ends - n), n) + np.arange(len(at))
        node = _PATH_NODE[path]
        places = _halves(self.before[own], self.class_[own]).ravel()
        return own[at], node, _PATH_BIT[path], [node, places[2 * at + _PATH_HALF[path]] ^ _PATH_NEAR[path]]

    def slots(self, low: int, high: int) -> list[np.ndarray]:
        """By predictor twice the place and the bit of all decisions of a range of tokens, in any order."""
        known, class_ = self.known[low:high] >= 0, self.class_[low:high]
        places = _halves(self.before[low:high], class_)
        inside = np.flatnonzero(known)
        halves, class_ = places[inside], class_[inside]
        steps = 2 * (halves[:, :, None] ^ _NEXT_OF.take(class_, axis=0).reshape(-1, 2, _HALF)) + _BITS.take(class_, axis=0).reshape(-1, 2, _HALF)
        return [np.concatenate([known, _NODE_BIT.take(class_, axis=1).ravel()]), np.concatenate([2 * places[:, 0] + known, steps.ravel()])]


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch whose first column is a text, a few megabytes at a time."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for low, high in row_ranges(offsets, limit):
            yield batch, low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes, and where each row's begin and end."""
    data, offsets = text_bytes(column)
    return np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize


def _bytes_column(numbers: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A column of bytes, from the numbers of all rows and where each row's begin and end."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * numbers.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])


_CODED = "row long, doc_id long, held_out boolean, learned boolean, n_tokens long, n_bytes long, known long, base double, ids binary, hashes binary, rare array<struct<word: string, n: long>>"


def coded(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (text, doc_id, held_out, learned) with the texts as numbers, so that they are cut into tokens once for all that is fitted and scored.

    ids: for each token its number in the lexicon, or -1 - k for the text's k-th word outside; rare and hashes: these words with their numbers of
    occurrences, and their hashes. known and base: how many tokens are in the lexicon, and their part of the base's score.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch, low, high, data, offsets in text_slices(batches):
            tokens, n = Tokens(data, offsets, own), high - low
            inside, rare = np.flatnonzero(tokens.known >= 0), np.flatnonzero(tokens.known < 0)
            known = np.bincount(tokens.row[inside], minlength=n)
            base = np.bincount(tokens.row[inside], own.base[tokens.known[inside]], n)
            # The end is short and in most lexicons; where it is not, it is told from words by being empty.
            key, which, times = np.unique(tokens.row[rare] << 32 | tokens.type[rare], return_inverse=True, return_counts=True)
            edges, types = np.searchsorted(key >> 32, np.arange(n + 1)), key & 0xFFFFFFFF
            ids = tokens.known.astype(np.int32)
            ids[rare] = edges[tokens.row[rare]] - 1 - which
            entries = pa.StructArray.from_arrays([tokens.types.take(pa.array(types)), pa.array(times)], ["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entries)
            kept = [batch.column(k).slice(low, n) for k in (1, 2, 3)]
            columns = [pa.array(number + np.arange(n)), *kept, pa.array(tokens.count), pa.array(np.diff(offsets)), pa.array(known), pa.array(base, pa.float64())]
            columns += [_bytes_column(ids, np.append(tokens.first, len(ids))), _bytes_column(tokens.type_hash[types], edges), lists]
            number += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "learned", "n_tokens", "n_bytes", "known", "base", "ids", "hashes", "rare"])

    return rows.select("text", "doc_id", "held_out", "learned").mapInArrow(run, _CODED)


def _coded_of(docs: DataFrame, learned: Column, lexicon: Lexicon) -> DataFrame:
    """(ids, hashes) of the texts to be learned from, of documents or of what ``coded`` has made of them."""
    own = docs.where(learned)
    if not {"ids", "hashes"} <= set(docs.columns):
        own = coded(own.select(F.col("text").cast("string"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.lit(True).alias("learned")), lexicon)
    return own.select("ids", "hashes")


def token_slices(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[tuple[pa.RecordBatch, int, int, Tokens]]:
    """Rows of a batch whose first columns are ids and hashes, a few hundred thousand tokens at a time."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(0))
        for low, high in row_ranges(offsets, CODED_SLICE):
            yield batch, low, high, Tokens.coded(*(batch.column(k).slice(low, high - low) for k in (0, 1)), lexicon)


def _tables(kept: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts by predictor, place and bit, as blobs of parts of the tables."""
    out = Blobs()
    for predictor, counts in kept.items():
        for low in range(0, len(counts), 2 * PART):
            own = counts[low : low + 2 * PART]
            if own.any():
                out.put(KEYS, predictor * (SLOTS // PART) + low // (2 * PART), pack_arrays([own]))
        yield from out.take()
    yield from out.take(0)


def summed(blobs: DataFrame, predictors: int) -> list[np.ndarray]:
    """The whole tables (predictor, place, bit): parts of all tasks are added where they are dealt to, and only the sums come to the driver, bounded by SLOTS."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, bucket, blob in blob_rows(batches):
            own = unpack_arrays(blob)[0]
            sums[bucket] = sums[bucket] + own if bucket in sums else own.astype(np.int64)
        out = Blobs()
        for bucket, own in sums.items():
            out.put(KEYS, bucket, pack_arrays([np.minimum(own, 1 << 30).astype(np.int32)]))
            yield from out.take()
        yield from out.take(0)

    tables = [np.zeros(2 * SLOTS, np.int32) for _ in range(predictors)]
    n = partitions(blobs.sparkSession)
    dealt = by_bucket(blobs.select("kind", "bucket", "blob"), min(n, predictors * (SLOTS // PART)))
    for r in dealt.mapInArrow(add, BLOBS).toLocalIterator():
        predictor, part = divmod(r.bucket, SLOTS // PART)
        tables[predictor][part * 2 * PART : (part + 1) * 2 * PART] = unpack_arrays(r.blob)[0]
    return [t.reshape(SLOTS, 2) for t in tables]


class Packed:
    """Tables that travel compressed and are opened once in each process that uses them."""

    def __init__(self, tables: list[np.ndarray]):
        self.blobs, self.opened, self.views = [pack_arrays([t.ravel()]) for t in tables], None, None

    def __getstate__(self) -> dict:
        return {"blobs": self.blobs, "opened": None, "views": None}

    @property
    def plain(self) -> list[np.ndarray]:
        """The first table alone."""
        if self.opened is None:
            self.opened = [unpack_arrays(self.blobs[0])[0].reshape(SLOTS, 2)]
        return self.opened

    def odds(self, first: int = 0) -> list[Odds]:
        """The odds of all predictors from ``first`` on; their counts are not held beside them."""
        if self.views is None:
            self.views = [Odds(unpack_arrays(b)[0].reshape(SLOTS, 2)) for b in self.blobs[first:]]
        return self.views


def _count_into(kept: dict[int, np.ndarray], slots: list[np.ndarray]) -> None:
    """``slots``: by predictor twice the place and the bit of each decision."""
    for k, own in enumerate(slots):
        if k not in kept:
            kept[k] = np.zeros(2 * SLOTS, np.int32)
        np.add.at(kept[k], own, np.int32(1))


def class_tables(docs: DataFrame, learned: Column, lexicon: Lexicon) -> list[np.ndarray]:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for *_, tokens in token_slices(batches, shared.value):
            for a in range(0, len(tokens.row), COUNTED):
                _count_into(kept, tokens.slots(a, min(a + COUNTED, len(tokens.row))))
        yield from _tables(kept)

    out = summed(_coded_of(docs, learned, lexicon).mapInArrow(run, BLOBS), 2)
    shared.destroy()
    return out


class Odds:
    """A table's log odds of a one at each place, and how often the place was seen in steps (never, a little, more, often), all worked out once:
    as the counts are, less a zero, and less a one, which is how a text sees them that has put one of them there. The step is in the
    last two bits of the odds, which are beyond their precision, so that one look-up finds both."""

    def __init__(self, table: np.ndarray):
        self.x = np.empty((3, len(table)), np.float32)
        for own, (zero, one) in zip(self.x, ((0, 0), (1, 0), (0, 1)), strict=True):
            n0, n1 = np.maximum(table[:, 0] - zero, 0), np.maximum(table[:, 1] - one, 0)
            own[:] = np.log((n1.astype(np.float32) + np.float32(PRIOR)) / (n0.astype(np.float32) + np.float32(PRIOR)))
            seen = sum((n0 + n1 >= edge).astype(np.int32) for edge in SEEN)
            own.view(np.int32)[:] = own.view(np.int32) & ~3 | seen
        self.x = self.x.ravel()

    @staticmethod
    def seen(x: np.ndarray) -> np.ndarray:
        return x.view(np.int32) & 3


class Mixer:
    """Weights by learner and gate, and the refinement of their predictions by learner and place; each learner has its own."""

    def __init__(self, learners: int, start: np.ndarray, places: int, rate: float, most: int, refined: tuple[np.ndarray, np.ndarray] | None = None):
        self.gates, self.places, self.predictors = len(start), places, start.shape[1]
        # By learner and gate, then predictor; four of them, so that a row is looked up at once.
        self.rows = np.zeros((learners * self.gates, 4), np.float32)
        self.rows[:, : self.predictors] = np.tile(start, (learners, 1))
        self.rate, self.most = np.float32(rate), most
        # Decisions by learner and gate.
        self.times = np.zeros(learners * self.gates, np.int64)
        # What came true in each cell: zeros and ones.
        self.came = np.zeros((learners * places * CELLS, 2))
        if refined:
            self.refine(*(np.tile(r, learners) for r in refined))

    def refine(self, hits: np.ndarray, tries: np.ndarray) -> None:
        self.came[:, 0], self.came[:, 1] = tries - hits, hits

    @property
    def weights(self) -> np.ndarray:
        """By predictor, then learner and gate."""
        return self.rows[:, : self.predictors].T

    @property
    def hits(self) -> np.ndarray:
        return self.came[:, 1]

    @property
    def tries(self) -> np.ndarray:
        return self.came.sum(axis=1)

    def part(self, low: int, high: int) -> Mixer:
        """Some of the learners, which go on in this mixer's memory."""
        out = object.__new__(Mixer)
        out.__dict__.update(self.__dict__)
        out.rows, out.times = (a[low * self.gates : high * self.gates] for a in (self.rows, self.times))
        out.came = self.came[low * self.places * CELLS : high * self.places * CELLS]
        return out

    def mixed(self, x: list[np.ndarray], at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed chances of a one, and the refinement's cells, of which ``first`` are the first at their places; x is by predictor."""
        rows = self.rows.take(at, axis=0)
        z = rows[:, 0] * x[0]
        for k in range(1, len(x)):
            z += rows[:, k] * x[k]
        p = np.clip(z, -_SURE, _SURE)
        np.negative(p, out=p)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        z += 8
        z *= CELLS / 16
        np.clip(z, 0, CELLS - 1, out=z)
        return p, z.astype(np.int64) + first

    def logs(self, p: np.ndarray, cell: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Natural logarithms of the refined chances of what came true."""
        came = self.came.take(cell, axis=0)
        ones = came[:, 1] + PATIENCE * p
        ones /= came[:, 0] + came[:, 1] + PATIENCE
        # The chance of a zero is one less that of a one.
        ones += bit
        ones -= 1
        return np.log(np.abs(ones).astype(np.float32))

    def learn(self, x: list[np.ndarray], at: np.ndarray, p: np.ndarray, bit: np.ndarray, cell: np.ndarray) -> None:
        """Steps of all decisions of a block, each as if it were alone, by the mean where a weight has many."""
        times = np.bincount(at, minlength=len(self.times))
        self.times += times
        rate = self.rate * np.minimum(1, self.most / np.maximum(times, 1))
        miss = bit - p
        for k, own in enumerate(x):
            self.rows[:, k] += rate * np.bincount(at, miss * own, len(times))
        self.came += np.bincount(2 * cell + bit.astype(np.int64), minlength=self.came.size).reshape(-1, 2)

    def sums(self) -> np.ndarray:
        """Of all learners: decisions by gate, weights times these by gate and predictor, hits and tries."""
        times = self.times.reshape(-1, self.gates)
        weights = np.einsum("lgp,lg->gp", self.rows.reshape(-1, self.gates, 4)[:, :, : self.predictors], times, dtype=np.float64)
        return np.concatenate([times.sum(axis=0), weights.ravel(), *(x.reshape(-1, self.places * CELLS).sum(axis=0) for x in (self.hits, self.tries))])


#: Weights of the class predictors that fitting starts from, by how often the token before, as a context, was seen: never, a little, often; and by the decision's kind.
_CLASS_START = np.array([[0.1, 0.0, 0.9], [0.1, 0.1, 0.8], [0.0, 0.3, 0.7], [0.0, 0.5, 0.5]] * 2)


class Start:
    """Weights and refinement that each text starts from."""

    def __init__(self):
        self.weights, self.refined = _CLASS_START, None

    @classmethod
    def fit(cls, rows: DataFrame, learned: Column, lexicon: Lexicon, tables: list[np.ndarray]) -> Start:
        """From all texts to be learned from: each has a learner of its own, from _CLASS_START and without refinement, and what all have in the end is
        added up, weights by the decisions that they were used in. No text's learner depends on others', so the sums don't on how texts are dealt."""
        shared = rows.sparkSession.sparkContext.broadcast((lexicon, Packed(tables)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, packed = shared.value
            total = 0
            for _, low, high, tokens in token_slices(batches, own):
                mixer = class_scores(tokens, own, packed.plain, np.ones(high - low, bool), cls(), fits=True, views=packed.odds(1))[1]
                total = total + mixer.sums()
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        sums = _coded_of(rows, learned, lexicon).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect()
        shared.destroy()
        out = cls()
        if sums:
            total = np.array([v for _, v in sorted(sums)])
            times, weights, hits, tries = np.split(total, np.cumsum([len(_CLASS_START), _CLASS_START.size, (CLASS_BITS + 1) * CELLS]))
            out.weights = np.where(times[:, None] > 0, weights.reshape(_CLASS_START.shape) / np.maximum(times, 1)[:, None], _CLASS_START)
            scale = np.minimum(1, PATIENCE / np.maximum(tries, 1))
            out.refined = hits * scale, tries * scale
        return out


def class_scores(tokens: Tokens, lexicon: Lexicon, tables: list[np.ndarray], learned: np.ndarray, start: Start, fits: bool = False, views: list[Odds] | None = None) -> tuple[np.ndarray, Mixer]:
    """Log10 of the chance of all decisions of each text that are not spelling, block by block over all texts at once.

    ``fits``: learners take the longer steps of spelling, which are to start others off, and no chances are added up. ``views``: the odds of the tables with a context, where they are at hand.
    """
    before = (views or [Odds(tables[1])])[0]
    count, nodes, places = tokens.count, 1 << CLASS_BITS, CLASS_BITS + 1
    # Longest first, so that those with a block left are the first ones.
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(rank))
    mixer = Mixer(len(rank), start.weights, places, *(SPELL_RATE if fits else CLASS_RATE), start.refined)
    out = np.zeros(len(rank))
    # What came true at each node in the text so far: a predictor of its own, which starts from the global one.
    so_far = np.zeros((len(rank) * nodes, 2), np.float32)
    # Without a context one text's share of the counts is next to nothing, and they are looked up by node alone.
    plain = np.log((tables[0][:nodes, 1] + np.float32(PRIOR)) / (tables[0][:nodes, 0] + np.float32(PRIOR))).astype(np.float32)
    chance = (OWN / (1 + np.exp(-plain))).astype(np.float32)
    plains, chances = (np.ascontiguousarray(own[_NODES].T) for own in (plain, chance))

    # BLOCKS texts at a time, of ranks one after the other: their tokens of one block by place and then by rank, so that neighbours are of different
    # texts, whose sums don't wait for each other. All learners are texts' own, so this changes no result.
    blocks = -(-count // BLOCK)
    active = np.cumsum(np.bincount(blocks)[::-1])[::-1][1:]
    groups = -(-active // BLOCKS)
    base = np.cumsum(groups) - groups
    text = np.repeat(np.arange(len(count)), blocks)
    block = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size, group = np.minimum(count[text] - block * BLOCK, BLOCK), base[block] + rank[text] // BLOCKS
    shape = (int(groups.sum()), BLOCK + 1)
    # Tokens at each place of each group, and where they begin.
    at_place = np.cumsum(np.bincount(group * shape[1] + size, minlength=shape[0] * shape[1]).reshape(shape)[:, ::-1], axis=1)[:, ::-1][:, 1:]
    begin = np.cumsum(at_place) - at_place.ravel()
    in_group = np.repeat(rank[text] % BLOCKS, size)
    to = begin[np.repeat(group * BLOCK, size) + tokens.place % BLOCK] + in_group
    order = np.empty_like(to)
    order[to] = np.arange(len(to))
    counted = learned.astype(np.int64)[tokens.row[order]]
    learner, known, class_ = in_group[order], tokens.known[order] >= 0, tokens.class_[order]
    halves = _halves(tokens.before[order], class_)
    flags = halves[:, 0] + SLOTS * counted * (1 + known)
    # Tokens of the lexicon have their classes' decisions besides.
    inside = np.flatnonzero(known)
    halves, class_, learner_in = np.ascontiguousarray(halves[inside].T), class_[inside], learner[inside]
    view = class_ + nodes * counted[inside]
    edges = np.append(begin[::BLOCK], len(order))
    edges_in = np.searchsorted(inside, edges)
    most = BLOCKS * BLOCK * places
    numbers, floats = np.empty((4, most), np.int64), np.empty((3, most), np.float32)
    for active_, base_ in zip(active.tolist(), base.tolist(), strict=True):
        for first in range(0, active_, BLOCKS):
            last, g = min(first + BLOCKS, active_), base_ + first // BLOCKS
            own, own_in = slice(edges[g], edges[g + 1]), slice(edges_in[g], edges_in[g + 1])
            c, mine_in = class_[own_in], learner_in[own_in]
            # First all decisions of the lexicon, then those of classes, bit by bit.
            n, all_ = own.stop - own.start, own.stop - own.start + CLASS_BITS * len(c)
            (key, gate, place, cell), (bit, overall, alone) = numbers[:, :all_], floats[:, :all_]
            key[:n], gate[:n], place[:n], cell[:n] = flags[own], learner[own] * mixer.gates + 4, learner[own] * (2 * nodes) + known[own], learner[own] * (places * CELLS)
            bit[:n], overall[:n], alone[:n] = known[own], chance[0], plain[0]
            np.bitwise_xor(_NEXT.take(view[own_in], axis=1).reshape(2, _HALF, -1), halves[:, None, own_in], out=key[n:].reshape(2, _HALF, -1))
            gate[n:].reshape(CLASS_BITS, -1)[:] = mine_in * mixer.gates
            np.add(_NODE_BIT.take(c, axis=1), mine_in * (2 * nodes), out=place[n:].reshape(CLASS_BITS, -1))
            np.add(mine_in * (places * CELLS), _CELLS, out=cell[n:].reshape(CLASS_BITS, -1))
            for into, of in ((bit, _BIT), (overall, chances), (alone, plains)):
                of.take(c, axis=1, out=into[n:].reshape(CLASS_BITS, -1), mode="clip")

            x = [alone]
            x.append(before.x.take(key))
            gate += Odds.seen(x[1])
            here = so_far[first * nodes : last * nodes]
            came = here.take(place >> 1, axis=0)
            zeros = came[:, 0] - overall
            zeros += np.float32(OWN)
            ones = came[:, 1] + overall
            ones /= zeros
            x.append(np.log(ones, out=ones))
            part = mixer.part(first, last)
            p, cell = part.mixed(x, gate, cell)
            if not fits:
                logs = part.logs(p, cell, bit)
                out[first:last] += np.bincount(learner[own], logs[:n], last - first) + np.bincount(mine_in, logs[n:].reshape(CLASS_BITS, -1).sum(axis=0), last - first)
            part.learn(x, gate, p, bit, cell)
            np.add.at(here.ravel(), place, np.float32(1))
    inside = np.flatnonzero(tokens.known >= 0)
    return out[rank] / np.log(10) + np.bincount(tokens.row[inside], lexicon.share[tokens.known[inside]], len(rank)), mixer


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word, byte and for each predictor the places of both halves of all bytes that spell words and a space after each."""
    data, offsets = text_bytes(words)
    n = np.diff(offsets) + 1
    code = np.full(int(n.sum()), 32, np.uint8)
    stop = np.cumsum(n) - 1
    letter = np.ones(len(code), bool)
    letter[stop] = False
    code[letter] = data
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(code)) - np.repeat(stop + 1 - n, n)
    contexts, value = [], np.zeros(len(code), U64)
    for back in range(1, max(ORDERS) + 1):
        last = np.zeros(len(code), U64)
        last[back:] = code[:-back]
        last[place < back] = 256 * back
        value = mix(value * U64(0xD6E8FEB86659FD93) + last + U64(back))
        if back in ORDERS:
            contexts.append(value)
    code = code.astype(np.int64)
    return row, code, [_halves(c, code) for c in contexts]


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Word, node, bit, each predictor's places and the bit's place in its byte for all decisions that spell words and a space after each."""
    row, code, halves = letters_of(words)
    near = _NEXT_OF.take(code, axis=0).reshape(-1, 2, _HALF)
    return np.repeat(row, 8), _NODES.take(code, axis=0).ravel(), _BITS.take(code, axis=0).ravel(), [(own[:, :, None] ^ near).ravel() for own in halves], np.tile(np.arange(8), len(code))


def word_slices(words: pa.Array, most: int | None = None, limit: int = SPELL_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``limit`` bytes, or of ``most`` words at most."""
    _, offsets = text_bytes(words)
    for low, high in row_ranges(offsets, limit):
        step = most or high - low
        for a in range(low, high, step):
            yield a, min(high, a + step)


def spelling_tables(words: DataFrame) -> list[np.ndarray]:
    """What follows each context in the words of the vocabulary, each of which counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for low, high in word_slices(batch.column(0)):
                _, code, halves = letters_of(batch.column(0).slice(low, high - low))
                near, bit = (own.take(code, axis=0).reshape(-1, 2, _HALF) for own in (_NEXT_OF, _BITS))
                _count_into(kept, [(2 * (own[:, :, None] ^ near) + bit).ravel() for own in halves])
        yield from _tables(kept)

    return summed(words.where("word <> ''").select("word").mapInArrow(run, BLOBS), len(ORDERS))


class Speller:
    """Spelling's tables, weights and refinement."""

    def __init__(self, packed: Packed):
        self.packed = packed
        self.mixer = Mixer(1, np.full((len(ORDERS) + 1, len(ORDERS)), 1.5 / len(ORDERS)), 8, *SPELL_RATE)

    def decisions(self, words: pa.Array, own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The word of each byte, and of all decisions the odds by predictor, the gate, the bit and the first of the refinement's cells."""
        row, code, halves = letters_of(words)
        next_ = _NEXT_OF.take(code + 256 * own.astype(np.int64)[row], axis=0).reshape(-1, 2, _HALF)
        x, seen = [], np.zeros(8 * len(code), np.uint8)
        for odds, at in zip(self.packed.odds(), halves, strict=True):
            x.append(odds.x.take((at[:, :, None] ^ next_).ravel()))
            seen += Odds.seen(x[-1]) > 0
        return row, x, seen.astype(np.int64), _BIT_OF.take(code, axis=0).ravel(), np.tile(CELLS * np.arange(8), len(code))

    def run(self, words: pa.Array, own: np.ndarray, learns: bool) -> np.ndarray:
        """Log10 of the chance of each word; ``own``: whether its type is in the tables."""
        row, x, gate, bit, first = self.decisions(words, own)
        p, cell = self.mixer.mixed(x, gate, first)
        logs = self.mixer.logs(p, cell, bit)
        if learns:
            self.mixer.learn(x, gate, p, bit, cell)
        return np.bincount(row, logs.reshape(-1, 8).sum(axis=1), len(words)) / np.log(10)

    def learn(self, words: pa.Array) -> None:
        """Learns from words of the tables, a block of them after the other; what doesn't change with the weights is looked up for four blocks at once."""
        for start, stop in word_slices(words):
            for low in range(start, stop, 4 * WORD_BLOCK):
                n = min(stop - low, 4 * WORD_BLOCK)
                row, x, *more = self.decisions(words.slice(low, n), np.ones(n, bool))
                edges = (8 * np.searchsorted(row, np.arange(0, n + WORD_BLOCK, WORD_BLOCK))).tolist()
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own, (gate, bit, first) = [k[a:b] for k in x], (k[a:b] for k in more)
                    p, cell = self.mixer.mixed(own, gate, first)
                    self.mixer.learn(own, gate, p, bit, cell)

    @classmethod
    def fit(cls, words: DataFrame) -> Speller:
        """From all words of the vocabulary: each stream learns online on its own; weights are the streams' mean by their words, and what refines is their sum."""
        spark = words.sparkSession
        model = cls(Packed(spelling_tables(words)))
        shared = spark.sparkContext.broadcast(model.packed)
        rows = words.where("word <> ''").select("word", F.xxhash64("word").alias("h")).withColumn("stream", F.pmod("h", F.lit(STREAMS)).cast("int"))
        rows = rows.repartition(min(STREAMS, partitions(spark)), "stream").sortWithinPartitions("stream", "h", "word")

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, speller, n = None, None, 0

            def state() -> pa.RecordBatch:
                m = speller.mixer
                return pa.RecordBatch.from_pydict({"n": [n], "weights": [m.rows.ravel().tolist()], "hits": [m.hits.tolist()], "tries": [m.tries.tolist()]}, pa.schema([("n", pa.int64()), ("weights", pa.list_(pa.float64())), ("hits", pa.list_(pa.float64())), ("tries", pa.list_(pa.float64()))]))

            for batch in batches:
                stream = batch.column(2).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(stream)) + 1).tolist(), len(stream)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b > a and stream[a] != now:
                        if speller:
                            yield state()
                        now, speller, n = stream[a], cls(shared.value), 0
                    speller.learn(batch.column(0).slice(a, b - a))
                    n += b - a
            if speller:
                yield state()

        states = sorted(rows.mapInArrow(learn, "n long, weights array<double>, hits array<double>, tries array<double>").collect())
        shared.destroy()
        if states:
            total = sum(s.n for s in states)
            model.mixer.rows = (sum(s.n / total * np.array(s.weights) for s in states)).reshape(model.mixer.rows.shape).astype(np.float32)
            model.mixer.refine(*(sum(np.array(own) for own in part) for part in zip(*((s.hits, s.tries) for s in states), strict=True)))
        return model


def score_texts(docs: DataFrame, learned: Column, held_out: Column, most: int = LEXICON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row of ``docs``.

    The base is a unigram model with a half added to each count. Words outside of the lexicon are counted and spelled by word, and joined back by the
    row's number; they are rare by the lexicon's make. ``learned``: rows to learn from. A null text is empty and has an end alone; a null doc_id
    is neither learned from nor held out; repeated rows are scored, and learned from, each; an empty table gives no rows; nothing to learn
    from leaves even chances. bits_per_byte is null for an empty text. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    learned, held_out = F.coalesce(learned, F.lit(False)), F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = stored(token_counts(rows, learned), "lm-words")
    lexicon = Lexicon.of(words, most)
    total, distinct = lexicon.total, lexicon.distinct
    texts = stored(coded(rows.select("text", "doc_id", held_out.alias("held_out"), learned.alias("learned")), lexicon), "lm-tokens")
    tables = class_tables(texts, F.col("learned"), lexicon)
    classes = spark.sparkContext.broadcast((lexicon, Packed(tables), Start.fit(texts, F.col("learned"), lexicon, tables)))
    speller = spark.sparkContext.broadcast(Speller.fit(words))
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packed, start = classes.value
        for batch, low, high, tokens in token_slices(batches, own):
            marks = batch.column(2).slice(low, high - low).to_numpy(zero_copy_only=False)
            chances = class_scores(tokens, own, packed.plain, marks, start, views=packed.odds(1))[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(3 + k).slice(low, high - low) for k in range(len(kept))), pa.array(chances, pa.float64())], [*kept, "score"])

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double"
    scored = stored(texts.select("ids", "hashes", "learned", *kept).mapInArrow(score, kind), "lm-texts")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The join leaves equal words side by side, so each is spelled once or, where batches meet, twice.
            encoded = batch.column(0).dictionary_encode()
            types, type_ = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
            row, n, of_row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            c = np.zeros(len(types), np.int64)
            c[type_] = of_row
            bits = np.zeros(len(types))
            for low, high in word_slices(types, limit=SPELLED):
                bits[low:high] = speller.value.run(types.slice(low, high - low), c[low:high] > 0, False)
            bits[pc.equal(pc.binary_length(types), 0).to_numpy(zero_copy_only=False)] = 0
            columns = [row, n * (of_row > 0), n * base_log(c, total, distinct)[type_], n * bits[type_]]
            yield pa.RecordBatch.from_arrays([pa.array(own) for own in columns], ["row", "_known", "_base", "_bits"])

    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    met = rare.join(words.hint("merge"), "word", "left").select("word", "row", "n", F.coalesce("c", F.lit(0).cast("long")).alias("c"))
    more = met.mapInArrow(spell, "row long, _known long, _base double, _bits double").groupBy("row").agg(*(F.sum(own).alias(own) for own in ("_known", "_base", "_bits")))
    out = scored.join(more, "row", "left")
    whole = F.col("score") + F.coalesce("_bits", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0).cast("long"))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        whole.alias("score"), "n_bytes", F.when(F.col("n_bytes") > 0, -whole / np.log10(2.0) / F.col("n_bytes")).alias("bits_per_byte"),
    )
