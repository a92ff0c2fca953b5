"""Spelling variants by a symmetric-delete join.

Words are counted over the whole corpus. Every word sends itself and each string that one deletion makes of it, as a hash, so that two words at
distance one share a key; pairs of one key are verified, each word's most frequent near word is its form if it is
frequent enough, and chains of forms are followed to their roots, a level of words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavelane.llm.shared import stored

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Two primes below 2^31 and a base for each: sums of their products stay within 64 bits.
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525069)
#: Code points of words whose deletions are hashed at once.
_SLICE = 1 << 20


def merged(side: DataFrame) -> DataFrame:
    """A side of a join by sorting. Stored tables are compressed, so a file below Spark's bound for broadcasts may hold many times more,
    which the driver would collect and hash; and all tables here grow with the vocabulary."""
    return side.hint("merge")


def word_counts(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the runs of letters, one code point of every ``every``-th (document, run) deleted, by the crc32 of both."""
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    n = F.char_length("run")
    # The deletion can only shorten, so shorter runs go before they are hashed.
    runs = runs.where(n >= least_length).withColumn("h", h)
    at = (F.col("h") % n).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, n))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def deletion_keys(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of each word itself and its distinct single deletions, from all words' code points one after the other.

    A word's hash is the sum of its code points times the powers of a base modulo a prime, for two primes; without point i it is the sum before i and
    the sum after i over the base. Deleting any of several equal neighbours gives one string, so only the first of them counts.
    """
    length = np.diff(offsets)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(codes)) - offsets[:-1][row]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    parts = []
    for prime, base in zip(_PRIMES, _BASES, strict=True):
        term = codes.astype(np.int64) * _powers(prime, base, int(length.max(initial=1)))[place] % prime
        sums = np.concatenate([[0], np.cumsum(term)])
        before, after = sums[:-1] - sums[offsets[:-1]][row], sums[offsets[1:]][row] - sums[1:]
        own = (sums[offsets[1:]] - sums[offsets[:-1]]) % prime
        less = (before + after % prime * pow(base, -1, prime)) % prime
        parts.append(np.concatenate([own, less[first]]))
    rows = np.concatenate([np.arange(len(length)), row[first]])
    return rows, parts[0] << 32 | parts[1]


def deletions(words: DataFrame) -> DataFrame:
    """(key, id): for each word, known by a hash, the hashes of itself and of what one deletion leaves. Numbers only, so that a word of a million letters sends a million numbers and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            low = 0
            while low < len(texts):
                high, size = low + 1, len(texts[low])
                while high < len(texts) and size + len(texts[high]) <= _SLICE:
                    size += len(texts[high])
                    high += 1
                codes = np.frombuffer("".join(texts[low:high]).encode("utf-32-le"), np.uint32)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[low:high]])])
                rows, keys = deletion_keys(codes, offsets)
                for a in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)]), pa.array(ids[low:high][rows[a : a + (1 << 16)]])], ["key", "id"])
                low = high

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def at_distance_one(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways round, of words (id, word, n) at distance one.

    Words that share a key have one string in common that a deletion leaves, so they are at most as many as the alphabet's letters at each of the
    word's places: a bound by language, not by data. Words of one id by chance come out as further candidates and are verified as all are.
    """
    keys = deletions(words)
    pairs = keys.alias("a").join(merged(keys).alias("b"), "key").where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    twins = words.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    left = words.select(F.col("id").alias("a"), F.col("word").alias("x"), F.col("n").alias("nx"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("y"), F.col("n").alias("ny"))
    found = pairs.unionByName(twins).join(merged(left), "a").join(merged(right), "b").where((F.col("x") != F.col("y")) & at_distance_one(F.col("x"), F.col("y")))
    twice = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("x").alias("word"), F.col("nx").alias("n"), F.col("y").alias("near"), F.col("ny").alias("near_n")))).otherwise(
        F.array(F.struct(F.col("x").alias("word"), F.col("nx").alias("n"), F.col("y").alias("near"), F.col("ny").alias("near_n")), F.struct(F.col("y").alias("word"), F.col("ny").alias("n"), F.col("x").alias("near"), F.col("nx").alias("near_n")))
    )
    return found.select(F.explode(twice).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, from (word, form): a form's count is twice its word's at least, so there are no circles and few levels.

    Level by level from the words that are a form and have none: those whose form is in the last level join it. The key of that join is the form,
    under which there are only its near words, never all words of one root.
    """
    found, links = None, forms
    level = forms.select(F.col("form").alias("word")).distinct().join(merged(forms.select("word")), "word", "left_anti").withColumn("root", F.col("word"))
    while True:
        next_ = stored(links.join(merged(level.select(F.col("word").alias("form"), "root")), "form").select("word", "root"), "spelling-level")
        if next_.isEmpty():
            return found if found is not None else next_
        found = next_ if found is None else found.unionByName(next_)
        level = next_


def spelling_variants(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``.

    A word's form is its near word of the largest count, the least in code-point order of equal ones, if that is ``times`` its own; its root is where forms
    end. Null and empty texts have no words; a null doc_id counts as an empty one in the crc32; repeated rows count each; an empty table
    gives no rows. Only doc_id and text are read.
    """
    words = stored(word_counts(docs, every, least_length, least_count).withColumn("id", F.xxhash64("word")), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    good = -F.col("b.less") >= times * F.col("n")
    best = stored(best.select("word", "n_near", F.when(good, F.col("b.form")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")), "spelling-near")
    ends = roots(best.where("form IS NOT NULL").select("word", "form"))
    out = words.select("word", "n").join(merged(best), "word", "left").join(merged(ends), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
