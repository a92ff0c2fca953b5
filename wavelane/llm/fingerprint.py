"""Threshold-scaled document fingerprints, with DataFrame functions only.

A text's shingles are its runs of five words (the whole sequence if it has fewer). Each is
hashed to 63 bits, and every hash below a fixed fraction of the range is retained; where none
is, the least hash stands alone, so that only a text without words has an empty sketch. A
sketch samples the shingles at the same rate whatever the text's length, so sketches of very
unequal texts can be compared, and the union of two sketches is the sketch of both texts.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

#: One of this many shingle hashes is retained.
SCALE = 4
SHINGLE_WORDS = 5
#: Documents of a range of ids, and ranges at most.
RANGE_DOCUMENTS, MOST_RANGES = 1_000, 10_000


def with_sketch(df: DataFrame, text: str, sketch: str, scale: int = SCALE, size: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the array column ``sketch``: the retained hashes of column ``text``, rising and distinct. Null counts as empty."""
    words, hashes, kept = f"_{sketch}_words", f"_{sketch}_hashes", f"_{sketch}_kept"
    run = ", ".join(f"{words}[i + {k}]" for k in range(size))
    mask, below = 2**63 - 1, 2**63 // scale
    out = df.withColumn(words, F.expr(f"transform(filter(split(coalesce({text}, ''), '[ \\\\x09-\\\\x0D]+'), w -> w != ''), w -> xxhash64(w))"))
    out = out.withColumn(hashes, F.expr(f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64({run}) & {mask}L) WHEN size({words}) > 0 THEN array(xxhash64({words}) & {mask}L) ELSE array() END"))
    out = out.withColumn(kept, F.expr(f"filter({hashes}, h -> h < {below}L)"))
    out = out.withColumn(sketch, F.expr(f"CASE WHEN size({kept}) > 0 THEN array_sort(array_distinct({kept})) WHEN size({hashes}) > 0 THEN array(array_min({hashes})) ELSE {kept} END"))
    return out.drop(words, hashes, kept)


def as_text(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, h -> lower(hex(h))), ' ')")


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance of two texts from their sketches: 1 for two empty sketches."""
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D ELSE cast(size(array_intersect({a}, {b})) AS double) / size(array_union({a}, {b})) END")


def containment(a: str, b: str) -> Column:
    """Estimated share of the first text's shingles that the second has: 1 for an empty sketch."""
    return F.expr(f"CASE WHEN size({a}) = 0 THEN 1D ELSE cast(size(array_intersect({a}, {b})) AS double) / size({a}) END")


def merged(a: str, b: str, scale: int = SCALE) -> Column:
    """The sketch of two texts together: the hashes below the fraction of either, or the least hash of both where there are none."""
    both = f"array_sort(array_union({a}, {b}))"
    below = f"filter({both}, h -> h < {2**63 // scale}L)"
    return F.expr(f"CASE WHEN size({below}) > 0 THEN {below} ELSE slice({both}, 1, 1) END")


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>``: the columns of the row that follows by falling ``key``; after the last row, the first's.

    Ties are in order of the columns; null keys come last. Rows are dealt to ranges of keys by quantiles found
    over all keys. Quantiles are keys of the table, so each is the largest key of its range; the rows that hold it
    are also dealt, as guests, to the range above, where they follow the last row. One shuffle, and no range
    depends on another.
    """
    found = df.agg(F.count("*").alias("n"), F.max(key).alias("most")).first()
    ranges = min(MOST_RANGES, max(1, ceil(found.n / RANGE_DOCUMENTS)))
    most = found.most
    steps = [(k + 1) / ranges for k in range(ranges)]
    bounds = sorted({*(df.agg(F.percentile_approx(key, steps, 10 * ranges + 1000).alias("q")).first().q or []), most}) if most is not None else []
    # Two steps of a search: groups of bounds, then the bounds of a group.
    wide = isqrt(len(bounds)) + 1
    groups = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    if bounds:
        heads = f"array({', '.join(f'{g[-1]}L' for g in groups)})"
        tails = f"array({', '.join('array(' + ', '.join(f'{b}L' for b in g) + ')' for g in groups)})"
        group = f"size(filter({heads}, b -> b < {key}))"
        place = F.expr(f"CASE WHEN {key} IS NULL THEN 0 ELSE {wide} * {group} + size(filter(get({tails}, {group}), b -> b < {key})) END")
        is_bound = F.expr(f"exists(get({tails}, {group}), b -> b = {key})")
    else:
        place, is_bound = F.lit(0), F.lit(True)
    first = F.col(key).eqNullSafe(F.lit(most))
    above = F.when(first, F.lit(0)).when(is_bound, F.col("_range") + 1)
    dealt = df.withColumn("_range", place).withColumn("_at", F.array_compact(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")), F.when(above.isNotNull(), F.struct(above.alias("range"), F.lit(1).alias("guest"))))))
    dealt = dealt.drop("_range").withColumn("_at", F.explode("_at")).withColumn("_range", F.col("_at.range")).withColumn("_guest", F.col("_at.guest")).drop("_at")
    order = Window.partitionBy("_range").orderBy(F.col("_guest"), F.col(key).desc_nulls_last(), *columns)
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where("_guest = 0").drop("_range", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. Null texts count as empty; texts with equal words have equal fingerprints; repeated ids follow each other
    in order of text; a null doc_id comes after all others; a lone document follows itself; an empty table gives no
    rows; other columns are ignored.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_sketch(own, "text", "sketch"), "doc_id", ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 AS int)), left(next_text, cast(n_chars div 2 AS int)))"))
    rows = with_sketch(rows.drop("text", "next_text"), "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("contained_edited"), containment("sketch", "next_sketch").alias("contained_next"),
    )
