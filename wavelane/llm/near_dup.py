"""Near-duplicate documents by MinHash bands, odd sketches and full sets.

1. Each text becomes the set of its distinct word shingles (A-Z folded), 128 MinHash samples of it,
   15 band keys of 3 samples, and an odd sketch: the samples folded into a bitmap of 256
   parities. The population count of two sketches' XOR estimates a high similarity closely.
2. Documents with equal sets become one class with its smallest doc_id as representative.
3. Representatives that share a band key are candidates if their sketches come near the threshold
   at all (six standard deviations). The members of a key meet in a task, which gives out a spanning
   forest of the candidate pairs, not the pairs. A key with over ``block`` members is not gathered:
   each member is compared with the key's smallest id where it is. Sketches' differences obey the
   triangle inequality, so whatever is near a member that differs from that id in ``CORE`` bits at most
   differs from it in ``CORE`` more than the limit at most: all within that are its candidates, and
   only members beyond ``CORE`` are dealt again, by the key and each of 12 further keys of two samples.
   What is crowded even then are candidates of its smallest id.
4. The forests' components hold every candidate pair. Their texts are fetched, and inside of each
   component the full sets are compared through an inverted index; again a forest of the
   confirmed links leaves the task. Of a component that is too large for a task, by count or bytes, the forest's own
   edges are confirmed first, in units of one end and some of its partners. If these links hold it together,
   nothing else is needed; otherwise what they leave apart meets the rest in blocks.
5. Components of the confirmed links are found by alternating large-star and small-star steps.

A pair of similarity 0.85 shares no band key with a probability of 6e-7 (0.8: 2e-5), and under a crowded key no further one with
2e-7 (5e-6); one that does is missed by its sketch only if that is over six standard deviations off (below 2e-8 at
0.85 and at 0.8, by the exact distribution for ideal hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.exchange import BLOBS, REQUESTS, Blobs, blob_rows, by_bucket, doc_bucket, text_blobs, unpack_arrays, unpack_rows
from wavelane.llm.shared import discard, partitions, stored
from wavelane.llm.textnum import FOLDED_KEYS, U64, distinct_by_row, find_words, hash_spans, mix, returned, row_ranges, shingles, text_bytes

SHINGLE_WORDS, PERCENT = 5, 80
SAMPLES, BANDS, BAND_ROWS, SKETCH_BITS = 128, 15, 3, 256
#: Further keys, by which the members of a crowded band key are dealt, and their samples; and bits by which a member counts as the same.
FURTHER, FURTHER_ROWS, CORE = 12, 2, 24
#: Documents that meet in one task at most, of a band key or of a component of candidates, and bytes of their compressed texts.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Parts that the links of each document are dealt in where its neighbours get their minimum.
SALTS = 8
_RNG = np.random.default_rng(20240611)
_ADD, _TIMES = _RNG.integers(0, 2**63, (2, SAMPLES), dtype=np.int64).astype(U64)
_TIMES = _TIMES * U64(2) + U64(1)


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, rising, and the rows' n + 1 offsets."""
    data, offsets = text_bytes(column)
    values, counts = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for low, high in row_ranges(offsets):
        own = offsets[low : high + 1] - offsets[low]
        part = data[offsets[low] : offsets[high]]
        starts, ends, at = find_words(part, own)
        v, at = distinct_by_row(*shingles(hash_spans(part, starts, ends, FOLDED_KEYS), at, size))
        values.append(v)
        counts.append(np.diff(at))
    return np.concatenate(values), np.cumsum(np.concatenate(counts))


def samples_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples of each row's set; all ones for an empty set."""
    out = np.full((len(offsets) - 1, SAMPLES), ~U64(0))
    full = np.flatnonzero(np.diff(offsets))
    for low, high in row_ranges(offsets[np.append(full, len(offsets) - 1)] if len(full) else np.zeros(1, np.int64), 1 << 16):
        rows = full[low:high]
        own = values[offsets[rows[0]] : offsets[rows[-1] + 1]]
        starts = offsets[rows] - offsets[rows[0]]
        for k in range(SAMPLES):
            out[rows, k] = np.minimum.reduceat((own ^ _ADD[k]) * _TIMES[k], starts)
    return out


def band_keys(samples: np.ndarray, first: int = 0, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """Keys of bands of so many samples each, from the first one on."""
    keys = np.empty((len(samples), bands), U64)
    for b in range(bands):
        key = np.full(len(samples), first + b + 1, U64)
        for k in range(first + b * rows, first + (b + 1) * rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + samples[:, k])
        keys[:, b] = key
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Each row's parities of the bits that its samples hash to, as four 64-bit words."""
    n = len(samples)
    bit = (mix(samples + (np.arange(SAMPLES, dtype=U64) * U64(0xD6E8FEB86659FD93))) % U64(SKETCH_BITS)).astype(np.int64)
    counts = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(U64)


def most_different(similarity: float, deviations: float = 6) -> int:
    """Bits in which sketches of this similarity differ at most, so many standard deviations above expectation.

    Of the samples a binomial number differs, and each that does turns a bit of either sketch.
    """
    # The mean of (-1)^x over the bits x of the XOR, and of the product of two of them.
    one, two = ((1 - (1 - similarity) * (1 - (1 - c / SKETCH_BITS) ** 2)) ** SAMPLES for c in (2, 4))
    variance = (SKETCH_BITS + SKETCH_BITS * (SKETCH_BITS - 1) * two - (SKETCH_BITS * one) ** 2) / 4
    return int(np.ceil(SKETCH_BITS / 2 * (1 - one) + deviations * np.sqrt(variance)))


def sketch_documents(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n_shingles, set_key, bands, further, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                values, offsets = shingle_sets(part.column(1), size)
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(values + U64(c)))]) for c in (1, 2)]
                key = np.stack([mix(s[offsets[1:]] - s[offsets[:-1]] + np.diff(offsets).astype(U64)) for s in sums], axis=1)
                samples = samples_of(values, offsets)
                lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
                keys = [lists(band_keys(samples)), lists(band_keys(samples, BANDS * BAND_ROWS, FURTHER, FURTHER_ROWS)), lists(odd_sketches(samples))]
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array([k.tobytes() for k in key], pa.binary()), *keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "bands", "further", "sketch"])

    return docs.mapInArrow(returned(run), "doc_id long, n_shingles long, set_key binary, bands array<long>, further array<long>, sketch array<long>")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def forest_of_near(ids: np.ndarray, sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph whose edges are sketches that differ in ``most`` bits at most."""
    out, left, reached = [], np.arange(len(ids)), []
    while len(left):
        if not reached:
            reached, left = [left[0]], left[1:]
        node = reached.pop()
        near = _differing(sketches[left], sketches[node]) <= most
        out += [(int(ids[node]), int(i)) for i in ids[left[near]]]
        reached += left[near].tolist()
        left = left[~near]
    return out


class Forest:
    """Union-find over the places of one task's documents."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def forest_of_links(values: np.ndarray, at: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the sets that are similar enough. Of two blocks (sides 0 and 1) only pairs across count."""
    n, size = len(at) - 1, np.diff(at)
    forest, out = Forest(n), []
    across = len(set(side.tolist())) > 1
    if n == 2:
        both = len(np.intersect1d(values[at[0] : at[1]], values[at[1] :], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size[0] + size[1] - both) else []
    _, shingle = np.unique(values, return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    begin = np.searchsorted(shingle[order], np.arange(shingle.max() + 2)) if len(shingle) else np.zeros(1, np.int64)
    for i in range(n - 1):
        own = shingle[at[i] : at[i + 1]]
        own = own[begin[own + 1] - begin[own] > 1]
        if not len(own):
            continue
        both = np.bincount(np.concatenate([holder[begin[k] : begin[k + 1]] for k in own]), minlength=n)[i + 1 :]
        near = 100 * both >= percent * (size[i] + size[i + 1 :] - both)
        if across:
            near &= side[i + 1 :] != side[i]
        out += [(i, j) for j in (np.flatnonzero(near) + i + 1).tolist() if forest.join(i, j)]
    return out


def links_to_first(values: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (0, place) of the sets that are similar enough to the first one."""
    size = np.diff(at)
    both = np.concatenate([[0], np.cumsum(np.isin(values, values[: at[1]], assume_unique=False))])
    both = both[at[1:]] - both[at[:-1]]
    return [(0, k) for k in (np.flatnonzero(100 * both[1:] >= percent * (size[0] + size[1:] - both[1:])) + 1).tolist()]


def _by_group(rows: DataFrame, n: int, keys: list[str], order: str, links) -> DataFrame:
    """Rows (a, b): ``links`` applied to the rows of each group of keys, which come together in a task by rising ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last: tuple | None = None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held
            table, held = pa.concat_tables(held).combine_chunks(), []
            if table.num_rows > 1 and (pairs := links(table)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(keys))], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            table = pa.Table.from_batches([batch])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(key[low].tolist())
                if held and now != last:
                    yield from done()
                if high < len(key) and not held:  # a group that begins and ends here
                    if high - low > 1 and (pairs := links(table.slice(low, high - low))):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])
                    continue
                held.append(table.slice(low, high - low))
                last = now
                if high < len(key):
                    yield from done()
        if held:
            yield from done()

    return rows.repartition(n, *keys).sortWithinPartitions(*keys, order).mapInArrow(returned(run), "a long, b long")


def fetched(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, packed): the compressed texts of the ids; of a repeated id the first text met. Ids and texts are dealt by id."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs()
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            out.deal(REQUESTS, doc_bucket(doc, n), [doc, np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)])
            yield from out.take()
        yield from out.take(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, pack = [np.zeros(0, np.int64)], zstandard.ZstdCompressor(level=3)
        wanted: set[int] | None = None
        for kind, _, blob in blob_rows(batches):
            if kind == REQUESTS:
                asked.append(unpack_arrays(blob)[0])
                continue
            if wanted is None:
                wanted = set(np.concatenate(asked).tolist())
            for batch in unpack_rows(blob):
                got = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if d in wanted]
                got = list({d: (d, t) for d, t in reversed(got)}.values())
                wanted.difference_update(d for d, _ in got)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([pack.compress((t or "").encode()) for _, t in got], pa.binary())], ["doc_id", "packed"])

    return by_bucket(ids.select("doc_id").mapInArrow(returned(ask), BLOBS).unionByName(text_blobs(rows, n)), n, sort=True).mapInArrow(returned(run), "doc_id long, packed binary")


def components(links: DataFrame) -> DataFrame:
    """Rows (doc_id, component): for each linked id the smallest one that it reaches.

    Large-star and small-star steps until nothing changes; each step is joins and minima, its edges a table in the shared folder, which goes
    after the next step.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before, old = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # A hub's rows are spread over salts, its minimum is there in each of them. Links grow with the input, so neither side is broadcast.
        salted = both.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        least = least.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        large = salted.join(least.hint("merge"), ["u", "_salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "star")
        if old is not None:
            discard(old)
        old = edges
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        before = now


def candidate_pairs(classes: DataFrame, n: int, most: int, block: int) -> DataFrame:
    """Rows (a, b) that hold together, for each band key, its members whose sketches differ in ``most`` bits at most."""

    def near(table: pa.Table) -> list[tuple[int, int]]:
        sketches = table.column(2).combine_chunks().flatten().to_numpy().view(U64).reshape(table.num_rows, -1)
        return forest_of_near(table.column(1).to_numpy(), sketches, most)

    parts: list[DataFrame] = []
    member = classes.select(F.explode("bands").alias("key"), "doc_id", "sketch", "further")
    for last in (False, True):
        sizes = member.groupBy("key").agg(F.count("*").alias("_n"), F.min_by("sketch", "doc_id").alias("_sketch"), F.min("doc_id").alias("_least"))
        crowded = stored(sizes.where(F.col("_n") > block).select("key", "_least", "_sketch"), "crowded")
        if crowded.isEmpty():
            parts.append(_by_group(member.select("key", "doc_id", "sketch"), n, ["key"], "doc_id", near))
            break
        parts.append(_by_group(member.join(crowded, "key", "left_anti").select("key", "doc_id", "sketch"), n, ["key"], "doc_id", near))
        differing = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("_sketch")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
        met = stored(member.join(crowded, "key").withColumn("_bits", differing), "met")
        parts.append(met.where((F.col("doc_id") != F.col("_least")) & (F.lit(last) | (F.col("_bits") <= most + CORE))).select(F.col("_least").alias("a"), F.col("doc_id").alias("b")))
        if not last:
            again = met.where(F.col("_bits") > CORE).withColumn("_further", F.explode("further"))
            member = stored(again.select(F.xxhash64("key", "_further").alias("key"), "doc_id", "sketch", "further"), "members")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out.distinct(), "candidates")


def _sets(packed, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of compressed texts."""
    unpack = zstandard.ZstdDecompressor()
    return shingle_sets(pa.array([unpack.decompress(z).decode() for z in packed.to_pylist()], pa.large_string()), size)


def _blocks(n: str, size: str, block: int, bytes_: int):
    """How many blocks of half the bounds so many documents of so many bytes make."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / max(1, block // 2)), F.ceil(F.col(size) / max(1, bytes_ // 2))).cast("int")


def confirmed_links(candidates: DataFrame, texts: DataFrame, groups: DataFrame, n: int, size: int, percent: int, block: int, block_bytes: int) -> DataFrame:
    """Rows (a, b) that hold together whatever full sets link: of each component of candidates a spanning forest of its links."""

    def similar(table: pa.Table) -> list[tuple[int, int]]:
        ids = table.column("doc_id").to_pylist()
        values, at = _sets(table.column("packed"), size)
        return [(ids[i], ids[j]) for i, j in forest_of_links(values, at, table.column("side").to_numpy(), percent)]

    def similar_to_first(table: pa.Table) -> list[tuple[int, int]]:
        table = table.sort_by("side")
        ids = table.column("doc_id").to_pylist()
        return [(ids[i], ids[j]) for i, j in links_to_first(*_sets(table.column("packed"), size), percent)]

    own = groups.join(texts.select("doc_id", F.octet_length("packed").alias("_bytes")), "doc_id")
    sizes = own.groupBy("group").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_size"))
    large = stored(sizes.where((F.col("_n") > block) | (F.col("_size") > block_bytes)).select("group"), "large")
    zero = F.lit(0)
    if large.isEmpty():
        whole = groups.join(texts, "doc_id").select("group", zero.alias("low"), zero.alias("high"), "doc_id", zero.alias("side"), "packed")
        return stored(_by_group(whole, n, ["group", "low", "high"], "doc_id", similar), "links")
    whole = groups.join(large, "group", "left_anti").join(texts, "doc_id").select("group", zero.alias("low"), zero.alias("high"), "doc_id", zero.alias("side"), "packed")
    links = _by_group(whole, n, ["group", "low", "high"], "doc_id", similar)

    # The forest's edges of large components: units of an end and some of its partners.
    of_large = stored(own.join(large, "group"), "large-members")
    edges = candidates.join(of_large.select(F.col("doc_id").alias("b"), "_bytes"), "b")
    hubs = edges.groupBy("a").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_size")).select("a", _blocks("_n", "_size", block, block_bytes).alias("blocks"))
    partners = edges.join(hubs, "a").select(F.col("a").alias("group"), F.expr("cast(pmod(xxhash64(b, 7), blocks) AS int)").alias("low"), zero.alias("high"), F.col("b").alias("doc_id"), F.lit(1).alias("side"))
    ends = hubs.select(F.col("a").alias("group"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("low"), zero.alias("high"), F.col("a").alias("doc_id"), zero.alias("side"))
    units = partners.unionByName(ends).join(texts, "doc_id").select("group", "low", "high", "doc_id", "side", "packed")
    direct = stored(_by_group(units, n, ["group", "low", "high"], "side", similar_to_first), "direct")

    # Pieces that these links leave: the largest of a component is not compared within itself.
    found = components(direct)
    piece = of_large.join(found, "doc_id", "left").select("group", "doc_id", "_bytes", F.coalesce("component", "doc_id").alias("piece"))
    piece = stored(piece.join(found.select(F.col("component").alias("doc_id"), F.col("component").alias("_own")).distinct(), "doc_id", "left").select("group", "doc_id", "_bytes", F.coalesce("_own", "piece").alias("piece")), "pieces")
    count = piece.groupBy("group", "piece").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_size"))
    main = count.groupBy("group").agg(F.max_by("piece", "_n").alias("main"), F.count("*").alias("_pieces")).where("_pieces > 1").drop("_pieces")
    placed = piece.join(main, "group").withColumn("rest", (F.col("piece") != F.col("main")).cast("int"))
    blocks = placed.groupBy("group").agg(*(f(F.when(F.col("rest") == k, v)).alias(f"_{name}{k}") for k in (0, 1) for name, f, v in (("n", F.count, F.lit(1)), ("size", F.sum, F.col("_bytes")))))
    blocks = blocks.select("group", _blocks("_n0", "_size0", block, block_bytes).alias("mains"), _blocks("_n1", "_size1", block, block_bytes).alias("rests"))
    placed = placed.join(blocks, "group").withColumn("own", F.expr("cast(pmod(xxhash64(doc_id, 7), if(rest = 1, rests, mains)) AS int)"))
    # Blocks of the rest are numbered from 0, those of the largest piece follow; a unit is a block of the rest and another one.
    others = F.expr("if(rest = 1, sequence(0, rests + mains - 1), sequence(0, rests - 1))")
    met = placed.withColumn("own", F.expr("if(rest = 1, own, own + rests)")).withColumn("other", F.explode(others))
    met = met.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    apart = _by_group(met.join(texts, "doc_id").select("group", "low", "high", "doc_id", "side", "packed"), n, ["group", "low", "high"], "doc_id", similar)
    return stored(links.unionByName(direct).unionByName(apart), "links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Null texts count as empty; a text without words has no set and no links, a text with fewer words than a shingle has
    its whole sequence as one. Rows with a null doc_id are linked with nothing, have a null component and are kept.
    Repeated rows give repeated rows; an empty table gives none; other columns are ignored. ``block`` and ``block_bytes`` bound
    what meets in a task and do not change the result.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    own = stored(sketch_documents(rows, size), "sketches")
    has_set = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(own.where(has_set).groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("further").alias("further"), F.first("sketch").alias("sketch")), "classes")
    candidates = candidate_pairs(classes, n, most_different(percent / 100), block)
    groups = components(candidates)
    groups = stored(groups.unionByName(groups.select(F.col("component").alias("doc_id"), "component").distinct()).withColumnRenamed("component", "group"), "groups")
    texts = stored(fetched(rows, groups, n), "texts")
    found = components(confirmed_links(candidates, texts, groups, n, size, percent, block, block_bytes))
    by_set = classes.select("set_key", "doc_id").join(found, "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    linked = own.where(has_set).select("doc_id", "n_shingles", "set_key").join(by_set, "set_key").drop("set_key")
    lone = own.where(~F.coalesce(has_set, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(lone)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
