"""Toxicity by a convolutional text classifier trained in numpy, on all labelled texts.

Words (runs of letters, A-Z folded) are hashed into 2^20 buckets; buckets seen in enough
training texts have an embedding, all others the zero vector. Filters of several widths
slide over the words, each filter's largest output over the text is kept, and a logistic
layer weighs them. Each language has a threshold of its own, found on texts held back from
training; a text's language is told from its words alone. The score is the logistic of the
distance to that threshold, so that 0.5 is the threshold in every language.

Texts are dealt to shards by hashes of their ids. In each round every shard goes on from the same
model through its own texts, and the model moves by the mean of what the shards changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from wavelane.llm.exchange import BLOBS, KEYS, Blobs, blob_rows, by_bucket, pack_arrays, pack_rows, unpack_arrays, unpack_rows
from wavelane.llm.shared import discard, partitions, stored
from wavelane.llm.textnum import FOLDED_KEYS, U64, find_words, hash_spans, row_ranges, text_bytes

#: Labelled texts in a shard, about, and rounds over all of them.
SHARD, ROUNDS = 2_000, 8
#: Words of a step's texts at most, but for a longer text.
STEP_WORDS = 1 << 17
#: Rows of a table in a blob; and logits to one, where they are counted for thresholds, and the logit beyond which all count alike.
PART, FINE, FARTHEST = 1 << 16, 256, 64
BUCKET_BITS = 20
WIDTHS = (1, 2, 3)
FILTERS, DIMENSIONS = 12, 12
#: Training texts that a bucket must occur in to have an embedding.
LEAST_TEXTS = 2
#: What the squares of an embedding's steps start from.
LEAST_SQUARE = 1e-4
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashed words, and the rows' n + 1 offsets."""
    words, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for low, high in row_ranges(offsets):
        part = data[offsets[low] : offsets[high]]
        starts, ends, at = find_words(part, offsets[low : high + 1] - offsets[low], _NOT_LETTER)
        words.append((hash_spans(part, starts, ends, FOLDED_KEYS) >> U64(64 - BUCKET_BITS)).astype(np.int32))
        counts.append(np.diff(at))
    return np.concatenate(words), np.cumsum(np.concatenate(counts))


@dataclass
class TextConvolution:
    place: np.ndarray  # bucket -> row of the embeddings; 0: none
    embeddings: np.ndarray  # rows x dimensions; row 0 is zero
    filters: list[np.ndarray]  # for each width: width x dimensions x filters
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: list[str]
    word_scores: np.ndarray  # rows x languages: log-probabilities, to tell a text's language
    thresholds: np.ndarray  # by language; the last is for texts whose words tell nothing
    scale: float = 1.0

    def spread(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows with the zero row after each text, as often as the widest filter needs; and texts' starts."""
        gap = max(WIDTHS)
        n = np.diff(at)
        starts = at[:-1] + gap * np.arange(len(n))
        rows = np.zeros(len(words) + gap * (len(n) + 1), np.int32)
        rows[np.arange(len(words)) + gap * np.repeat(np.arange(len(n)), n)] = self.place[words]
        return rows, starts

    def outputs(self, x: np.ndarray, k: int) -> np.ndarray:
        """Outputs of the filters of the k-th width at every word."""
        n = len(x) - max(WIDTHS)
        out = x[:n] @ self.filters[k][0]
        for j in range(1, WIDTHS[k]):
            out += x[j : n + j] @ self.filters[k][j]
        return out + self.biases[k]

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = self.embeddings[rows]
        # Of the zero rows after a text only the first starts a window of it; those that start at the others reach into the next text.
        last = np.append(starts[1:], len(rows) - max(WIDTHS)) - max(WIDTHS)
        beyond = (last[:, None] + np.arange(1, max(WIDTHS))).ravel()
        pools = []
        for k in range(len(WIDTHS)):
            out = self.outputs(x, k)
            out[beyond] = -np.inf
            pools.append(np.maximum.reduceat(out, starts, axis=0))
        pooled = np.concatenate(pools, axis=1)
        return np.maximum(pooled, 0) @ self.weights + self.bias

    def tell_language(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each text's language, as an index; the number of languages where its words tell nothing."""
        if not self.languages:
            return np.zeros(len(starts), np.int64)
        known = np.add.reduceat((rows > 0).astype(np.int64), starts)
        return np.where(known > 0, np.add.reduceat(self.word_scores[rows], starts, axis=0).argmax(axis=1), len(self.languages))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 1:
            return np.zeros(0)
        rows, starts = self.spread(*buckets(data, offsets))
        away = self.logits(rows, starts) - self.thresholds[self.tell_language(rows, starts)]
        return 1 / (1 + np.exp(-np.clip(self.scale * away, -30, 30)))

    @staticmethod
    def start(names: list[str], texts_with: np.ndarray, words_of: np.ndarray, of_class: np.ndarray, seed: int = 5) -> TextConvolution:
        """What training starts from. By bucket: the training texts of each class that have it, and its words by language; and the training texts of each class."""
        rng = np.random.default_rng(seed)
        present, with_one = texts_with.sum(axis=1), texts_with[:, 1]
        own = np.flatnonzero(present >= LEAST_TEXTS)
        place = np.zeros(1 << BUCKET_BITS, np.int32)
        place[own] = np.arange(1, len(own) + 1)

        # The first dimension starts as the bucket's log-odds, the others at random.
        zeros, ones = np.maximum(of_class, 1)
        odds = np.log((with_one[own] + 0.5) / (ones + 1)) - np.log((present[own] - with_one[own] + 0.5) / (zeros + 1))
        embeddings = np.zeros((len(own) + 1, DIMENSIONS), np.float32)
        embeddings[1:] = rng.normal(0, 0.05, (len(own), DIMENSIONS))
        embeddings[1:, 0] = np.clip(odds, -4, 4) / 4
        filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] = np.abs(f[:, 0])
        scores = np.zeros((len(own) + 1, len(names)), np.float32)
        for k in range(len(names)):
            # Words without an embedding are counted together; they tell nothing but how many there are.
            counts = 0.1 + np.concatenate([[words_of[place == 0, k].sum()], words_of[own, k]])
            scores[1:, k] = np.log(counts / counts.sum())[1:]
        model = TextConvolution(place, embeddings, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.uniform(0.1, 0.5, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, names, scores, np.zeros(len(names) + 1))
        if min(of_class) == 0:
            model.bias = 0.0 if not sum(of_class) else (4.0 if of_class[1] else -4.0)
        return model

    @staticmethod
    def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], seed: int = 5, epochs: int = ROUNDS) -> TextConvolution:
        """One shard alone, of texts at hand: trains on three quarters of them and finds the thresholds on the rest."""
        words, at = buckets(*text_bytes(pa.array(texts, pa.large_string())))
        held = np.arange(len(texts)) % 4 == 3
        names = sorted({x for x in langs if x is not None})
        shard = Shard(words, at, np.asarray(toxic, np.int64), np.array([names.index(x) if x is not None else -1 for x in langs], np.int64), held)
        tables: dict[int, np.ndarray] = {}
        shard.count_into(tables)
        of_class = np.bincount(shard.toxic[~held], minlength=2)
        model = TextConvolution.start(names, *split_tables(tables, len(names)), of_class=of_class, seed=seed)
        if min(of_class) > 0:
            squares = np.full(len(model.embeddings), LEAST_SQUARE, np.float32)
            for epoch in range(epochs):
                model.train(shard, squares, of_class, np.random.default_rng((seed, epoch)))
            model.set_thresholds(*model.counted_logits(shard))
        return model

    def train(self, shard: Shard, squares: np.ndarray, of_class: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over a shard's training texts; ``squares``: of the steps of each embedding so far; ``of_class``: training texts of all shards."""
        words, at = shard.words, shard.at
        parts = self.dense()
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        order = rng.permutation(np.flatnonzero(~shard.held))
        edges = np.concatenate([[0], np.cumsum(np.diff(at)[order])])
        for batch in (order[low : min(low + 32, b)] for a, b in row_ranges(edges, STEP_WORDS) for low in range(a, b, 32)):
            lengths = at[batch + 1] - at[batch]
            mine = np.concatenate([words[at[i] : at[i + 1]] for i in batch])
            rows, starts = self.spread(mine, np.concatenate([[0], np.cumsum(lengths)]))
            x, y = self.embeddings[rows], shard.toxic[batch]
            ends = starts + lengths + 1
            pools, peaks = [], []
            for k in range(len(WIDTHS)):
                out = self.outputs(x, k)
                peak = np.array([a + out[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                peaks.append(peak)
                pools.append(out[peak, np.arange(FILTERS)])
            pooled = np.concatenate(pools, axis=1)
            hidden = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.bias, -30, 30)))
            weight = np.where(y == 1, *(0.5 * sum(of_class) / of_class[::-1]))
            g = ((p - y) * weight / len(batch)).astype(np.float32)
            back = g[:, None] * self.weights * (pooled > 0)
            grad_filters, grad_biases = [], []
            for k, w in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad_biases.append(own.sum(axis=0))
                grad = np.empty_like(self.filters[k])
                for j in range(w):
                    grad[j] = np.einsum("bf,bfd->df", own, x[peaks[k] + j])
                    where = rows[peaks[k] + j].ravel()
                    move = (own[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIMENSIONS)
                    live = where > 0
                    if live.any():
                        touched, i = np.unique(where[live], return_inverse=True)
                        total = np.zeros((len(touched), DIMENSIONS), np.float32)
                        np.add.at(total, i, move[live])
                        squares[touched] += (total**2).mean(axis=1)
                        self.embeddings[touched] -= 0.02 * total / np.sqrt(squares[touched])[:, None]
                grad_filters.append(grad + 1e-4 * self.filters[k])
            step += 1
            self.bias -= 0.05 * float(g.sum())
            for k, (own, grad) in enumerate(zip(parts, [*grad_filters, *grad_biases, hidden.T @ g + 1e-4 * self.weights], strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                own -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def dense(self) -> list[np.ndarray]:
        """What every text moves, but for the bias."""
        return [*self.filters, *self.biases, self.weights]

    def counted_logits(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts held back: language and logit, in steps, and how many of each class there are."""
        held = np.flatnonzero(shard.held)
        edges = np.concatenate([[0], np.cumsum(np.diff(shard.at)[held])])
        keys = [np.zeros((0, 2), np.int64)]
        for a, b in row_ranges(edges, STEP_WORDS):
            own = np.concatenate([shard.words[shard.at[i] : shard.at[i + 1]] for i in held[a:b]])
            rows, starts = self.spread(own, edges[a : b + 1] - edges[a])
            steps = np.floor(np.clip(self.logits(rows, starts), -FARTHEST, FARTHEST) * FINE).astype(np.int64)
            keys.append(np.column_stack([self.tell_language(rows, starts), steps]))
        key, which = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        counts = np.zeros((len(key), 2), np.int64)
        np.add.at(counts, (which.ravel(), shard.toxic[held]), 1)
        return key[:, 0], key[:, 1], counts

    def set_thresholds(self, lang: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> None:
        """Thresholds that part the held texts best: one for all, and by language where it has ten texts of each class."""

        def cut(own: np.ndarray, default: float) -> float:
            at, which = np.unique(steps[own], return_inverse=True)
            of_class = np.zeros((len(at), 2), np.int64)
            np.add.at(of_class, which, counts[own])
            return best_cut((at + 0.5) / FINE, of_class[:, 0], of_class[:, 1], default)

        self.thresholds[:] = cut(np.ones(len(lang), bool), 0.0)
        for k in range(len(self.languages)):
            if counts[lang == k].sum(axis=0).min() >= 10:
                self.thresholds[k] = cut(lang == k, self.thresholds[-1])


def best_threshold(logits: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the widest cut that has the highest balanced accuracy."""
    order = np.argsort(logits)
    one = y[order] == 1
    return best_cut(logits[order], ~one, one, default)


def best_cut(x: np.ndarray, zero: np.ndarray, one: np.ndarray, default: float) -> float:
    """The same from logits in order and how many texts of each class are at each."""
    if zero.sum() == 0 or one.sum() == 0:
        return default
    below_zero, below_one = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(one)])
    right = below_zero / zero.sum() + 1 - below_one / one.sum()
    gap = np.concatenate([[0], np.diff(x), [0]])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    k = best[gap[best].argmax()]
    if k in (0, len(x)):
        return float(x[0] - 1 if k == 0 else x[-1] + 1)
    return float((x[k - 1] + x[k]) / 2)


@dataclass
class Shard:
    """Labelled texts as hashed words."""

    words: np.ndarray
    at: np.ndarray  # the texts' n + 1 offsets
    toxic: np.ndarray
    lang: np.ndarray  # as an index; -1: none
    held: np.ndarray  # whether a text is held back for the thresholds

    @staticmethod
    def of(blob: bytes, names: list[str]) -> Shard:
        rows = pa.Table.from_batches(unpack_rows(blob)).combine_chunks()
        size = np.array(pc.binary_length(rows["words"]).to_numpy(), np.int64) // 4
        words = np.frombuffer(b"".join(rows["words"].to_pylist()), np.int32)
        lang = pc.fill_null(pc.index_in(rows["lang"], value_set=pa.array(names, pa.string())), -1).to_numpy().astype(np.int64)
        return Shard(words, np.concatenate([[0], np.cumsum(size)]), rows["toxic"].to_numpy().astype(np.int64), lang, rows["held"].to_numpy())

    def count_into(self, tables: dict[int, np.ndarray]) -> None:
        """By bucket, of the training texts: in table 0 how many of each class have it, in each further one its words in two languages."""
        text = np.repeat(np.arange(len(self.toxic)), np.diff(self.at))
        train = ~self.held[text]
        pair = np.unique(text[train].astype(np.int64) << BUCKET_BITS | self.words[train])
        told = train & (self.lang[text] >= 0)
        lang = self.lang[text[told]]
        bucket = np.concatenate([pair & ((1 << BUCKET_BITS) - 1), self.words[told]])
        column = np.concatenate([self.toxic[pair >> BUCKET_BITS], lang + 2])
        for k in np.unique(column // 2):
            own = column // 2 == k
            if k not in tables:
                tables[int(k)] = np.zeros((1 << BUCKET_BITS, 2), np.int32)
            np.add.at(tables[int(k)], (bucket[own], column[own] % 2), 1)


def split_tables(tables: dict[int, np.ndarray], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts by class and those by language."""
    none = np.zeros((1 << BUCKET_BITS, 2), np.int32)
    both = np.concatenate([tables.get(k, none) for k in range(1 + (languages + 1) // 2)], axis=1)
    return both[:, :2], both[:, 2 : 2 + languages]


def parts_of(table: int, values: np.ndarray, out: Blobs) -> None:
    for low in range(0, len(values), PART):
        if values[low : low + PART].any():
            out.put(KEYS, table << 8 | low // PART, pack_arrays([values[low : low + PART].ravel()]))


def labelled_shards(docs: DataFrame, labels: DataFrame, learns: Column) -> DataFrame:
    """(shard, blob, zeros, ones, langs) of all labelled texts to be learned from, stored: a row for each shard, with its training texts of each class."""
    marked = labels.where(learns & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    texts = docs.where(learns).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null")
    own = texts.join(marked.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("s"), F.first("toxic").alias("toxic"))
    own = own.select("doc_id", (F.floor(h / 4) % max(1, -(-n // SHARD))).alias("shard"), (h % 4 == 3).alias("held"), "toxic", "s.lang", "s.text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(5))
            for low, high in row_ranges(offsets, 1 << 22):
                words, at = buckets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                blobs = pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in range(5)), blobs], ["doc_id", "shard", "held", "toxic", "lang", "words"])

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id").combine_chunks()
        toxic = rows["toxic"].to_numpy()[~rows["held"].to_numpy()]
        return pa.table({"shard": [key[0].as_py()], "blob": [pack_rows(rows.to_batches()[0])], "zeros": [int((toxic == 0).sum())], "ones": [int((toxic == 1).sum())], "langs": pa.array([sorted(set(rows["lang"].drop_null().to_pylist()))], pa.list_(pa.string()))})

    words = own.mapInArrow(hashed, "doc_id long, shard long, held boolean, toxic int, lang string, words binary")
    return stored(words.groupBy("shard").applyInArrow(packed, "shard long, blob binary, zeros long, ones long, langs array<string>"), "toxicity-shards")


def shard_counts(shards: DataFrame, names: list[str]) -> dict[int, np.ndarray]:
    """The counts of all shards' training texts by bucket; parts of the tables are added where they are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for blob in batch.column(0):
                Shard.of(blob.as_py(), names).count_into(tables)
        out = Blobs()
        for k, table in tables.items():
            parts_of(k, table, out)
            yield from out.take()
        yield from out.take(0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, bucket, blob in blob_rows(batches):
            own = unpack_arrays(blob)[0].astype(np.int64)
            sums[bucket] = sums[bucket] + own if bucket in sums else own
        out = Blobs()
        for bucket, own in sums.items():
            out.put(KEYS, bucket, pack_arrays([np.minimum(own, 1 << 30).astype(np.int32)]))
            yield from out.take()
        yield from out.take(0)

    tables: dict[int, np.ndarray] = {}
    dealt = by_bucket(shards.select("blob").mapInArrow(run, BLOBS), partitions(shards.sparkSession))
    for r in dealt.mapInArrow(add, BLOBS).toLocalIterator():
        table = tables.setdefault(r.bucket >> 8, np.zeros((1 << BUCKET_BITS, 2), np.int32))
        low = (r.bucket & 255) * PART
        table[low : low + PART] = unpack_arrays(r.blob)[0].reshape(-1, 2)
    return tables


def moves_of(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel().astype(np.float32)), values.shape[1])


def train_round(shards: DataFrame, model: TextConvolution, squares: np.ndarray, of_class: np.ndarray, number: int) -> None:
    """Moves the model by the mean of what all shards change, weighted by their texts; an embedding by the mean of the shards that change it."""
    shared = shards.sparkSession.sparkContext.broadcast((model, squares))
    edge, sizes = len(squares), [p.size for p in model.dense()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, moves, dense = [], [], np.zeros(sum(sizes) + 2)
        old, before = shared.value
        for batch in batches:
            for number_, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard.of(blob.as_py(), old.languages)
                n = int((~shard.held).sum())
                if n == 0:
                    continue
                new, after = replace(old, embeddings=old.embeddings.copy(), filters=[f.copy() for f in old.filters], biases=[b.copy() for b in old.biases], weights=old.weights.copy()), before.copy()
                new.train(shard, after, of_class, np.random.default_rng((number_, number)))
                own = np.flatnonzero(after != before)
                at.append(own)
                moves.append(n * np.column_stack([np.ones(len(own)), after[own] - before[own], new.embeddings[own] - old.embeddings[own]]))
                dense += n * np.concatenate([[1, new.bias - old.bias], *((a - b).ravel() for a, b in zip(new.dense(), old.dense(), strict=True))])
        out = Blobs()
        if dense[0]:
            out.put(KEYS, 1 << 20, dense.tobytes())
            rows, which = np.unique(np.concatenate(at), return_inverse=True)
            total = np.zeros((len(rows), DIMENSIONS + 2))
            np.add.at(total, which, np.concatenate(moves))
            for part in np.unique(rows // PART):
                own = rows // PART == part
                out.put(KEYS, int(part), pack_rows(pa.record_batch({"row": rows[own], "move": moves_of(total[own])})))
                yield from out.take()
        yield from out.take(0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The mean move of each embedding of a bucket's."""
        sums: dict[int, np.ndarray] = {}
        dense = np.zeros(sum(sizes) + 2)
        for _, bucket, blob in blob_rows(batches):
            if bucket == 1 << 20:
                dense += np.frombuffer(blob)
                continue
            total = sums.setdefault(bucket, np.zeros((min(PART, edge - bucket * PART), DIMENSIONS + 2)))
            for rows in unpack_rows(blob):
                total[rows["row"].to_numpy() - bucket * PART] += rows["move"].flatten().to_numpy().reshape(-1, DIMENSIONS + 2)
        out = Blobs()
        for bucket, total in sums.items():
            own = np.flatnonzero(total[:, 0])
            out.put(KEYS, bucket, pack_rows(pa.record_batch({"row": own + bucket * PART, "move": moves_of(total[own, 1:] / total[own, :1])})))
            yield from out.take()
        if dense[0]:
            out.put(KEYS, 1 << 20, (dense[1:] / dense[0]).tobytes())
        yield from out.take(0)

    dealt = by_bucket(shards.select("shard", "blob").mapInArrow(run, BLOBS), min(partitions(shards.sparkSession), edge // PART + 2))
    moved = [(r.bucket, bytes(r.blob)) for r in dealt.mapInArrow(add, BLOBS).toLocalIterator()]
    for bucket, blob in moved:
        if bucket == 1 << 20:
            dense = np.frombuffer(blob)
            model.bias += float(dense[0])
            for own, move in zip(model.dense(), np.split(dense[1:], np.cumsum(sizes)[:-1]), strict=True):
                own += move.reshape(own.shape).astype(np.float32)
            continue
        for rows in unpack_rows(blob):
            move = rows["move"].flatten().to_numpy().reshape(-1, DIMENSIONS + 1)
            squares[rows["row"].to_numpy()] += move[:, 0]
            model.embeddings[rows["row"].to_numpy()] += move[:, 1:]
    shared.destroy()


def held_logits(shards: DataFrame, model: TextConvolution) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``counted_logits`` of all shards together: as many rows at most as there are languages and steps."""
    shared = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                lang, steps, counts = shared.value.counted_logits(Shard.of(blob.as_py(), shared.value.languages))
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(steps), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["lang", "step", "zeros", "ones"])

    rows = shards.select("blob").mapInArrow(run, "lang long, step long, zeros long, ones long").groupBy("lang", "step").agg(F.sum("zeros"), F.sum("ones")).collect()
    shared.destroy()
    all_ = np.array(rows, np.int64).reshape(-1, 4)
    return all_[:, 0], all_[:, 1], all_[:, 2:]


def fit_classifier(docs: DataFrame, labels: DataFrame, learns: Column, rounds: int = ROUNDS) -> TextConvolution:
    """Fits on all labelled documents: words, training, thresholds and languages.

    ``learns``: which labels may be seen, as a condition on doc_id. Labels other than 0 and 1, labels without a text and repeated rows don't
    count; a document with both labels counts as toxic, of a repeated id the least text counts. Only sums over buckets, which are bounded,
    leave the tasks; a task holds a shard of about SHARD texts at a time. The shards do not depend on the number of tasks.
    """
    shards = labelled_shards(docs, labels, learns)
    zeros, ones = shards.agg(F.coalesce(F.sum("zeros"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    names = sorted(r[0] for r in shards.select(F.explode("langs")).distinct().collect())
    of_class = np.array([zeros, ones])
    model = TextConvolution.start(names, *split_tables(shard_counts(shards, names), len(names)), of_class=of_class)
    if min(of_class) > 0:
        squares = np.full(len(model.embeddings), LEAST_SQUARE, np.float32)
        for number in range(rounds):
            train_round(shards, model, squares, of_class, number)
        model.set_thresholds(*held_logits(shards, model))
    discard(shards)
    return model


def score_texts(docs: DataFrame, model: TextConvolution, held_out: Column) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Null and empty texts are scored as texts without words; repeated rows give repeated rows; other
    columns are ignored; an empty table gives none. One pass over the scan, without a shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the buckets and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            parts = [held.value.scores(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in row_ranges(offsets)]
            score = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
