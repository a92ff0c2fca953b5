"""How filters interact: what every order of them removes, and at which step.

Each document has a mask of the filters that it fails. Only counts of masks by part are gathered; the
subset-zeta transform turns them into the survivors of every set of filters, and each step of an order is
the difference between a set of filters and that set with one more. Counts of labelled documents go the same way.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
#: What is counted for each mask: all documents, those of good quality, toxic ones.
MEASURES = ("n", "good", "toxic")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (fewer than half of the words distinct), C (over 2 % capitals), D (a symbol)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, _UPPER, ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def _bits(flags: list[Column]) -> Column:
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters they fail, bit k for filter k.

    E, the last filter, fails a text that a smaller doc_id also has. Every document counts as failing it; then the one with
    the least id of each text is taken back, so no table of texts is joined to the rows and a text with many copies is one
    entry a task. Texts are equal if their SHA-256 is.
    """
    late = 1 << (len(FILTERS) - 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # One projection finds the words once; only an id, a part, a mask and a digest leave it.
    rows = rows.select("doc_id", "part", _bits(failures(F.col("text"))).cast("byte").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    own = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    # Dealt by id already: repeated rows of an id and text become one document here.
    own = own.groupBy("doc_id", "digest").agg(F.min(F.struct("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))).alias("d"))
    copies = own.select("d.part", F.col("d.mask").cast("int").bitwiseOR(late).alias("mask"), F.lit(1).cast("long").alias("n"), "d.good", "d.toxic")
    first = own.groupBy("digest").agg(F.min(F.struct("doc_id", "d.part", "d.mask", "d.good", "d.toxic")).alias("f"))

    def moved(mask: Column, sign: int) -> Column:
        return F.struct(F.col("f.part").alias("part"), mask.alias("mask"), F.lit(sign).cast("long").alias("n"), (sign * F.col("f.good")).alias("good"), (sign * F.col("f.toxic")).alias("toxic"))

    own_mask = F.col("f.mask").cast("int")
    back = first.select(F.explode(F.array(moved(own_mask.bitwiseOR(late), -1), moved(own_mask, 1))).alias("e")).select("e.*")
    # Rows without an id have no place in the order and no label.
    loose = rows.where("doc_id IS NULL").select("part", F.col("mask").cast("int").alias("mask"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return copies.unionByName(back).unionByName(loose).groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays whose element S (from 0) counts the part's documents that pass every filter of the set S."""
    size = 1 << len(FILTERS)
    out = counts.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0).cast("long")) for m in range(size))).alias(c) for c in MEASURES))
    for k in range(len(FILTERS)):  # sums over subsets, one filter at a time

        def step(of: str, bit: int = 1 << k) -> Column:
            return F.transform(F.col(of), lambda x, i: F.when(i.bitwiseAND(bit) != 0, x + F.get(of, i - bit)).otherwise(x))

        out = out.select("part", *(step(c).alias(c) for c in MEASURES))
    # What lies within the complement of S fails none of S.
    return out.select("part", *(F.reverse(c).alias(c) for c in MEASURES))


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, each order of the five filters and each step what is kept, removed, redundant, failed by one filter only and lost by label.

    A null text is empty and a null source the part ""; a document without a label, or with a null one, counts as neither good nor
    toxic; repeated rows of a doc_id and text are one document, of the least source; rows without a doc_id count each and are
    copies of nothing; an empty table has no parts and gives no rows. Of ``docs`` only doc_id, text and source are read.
    """
    full = (1 << len(FILTERS)) - 1
    table = survivors(mask_counts(docs, labels))

    def weight(filter_: int) -> Column:
        """Removals of one filter over all orders: a set goes before it in |S|! (4 - |S|)! of them."""
        bit = 1 << filter_
        sets = [s for s in range(full + 1) if not s & bit]
        orders = {s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in sets}
        return sum((orders[s] * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | bit))) for s in sets), F.lit(0))

    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    rows = table.withColumn("weights", F.array(*(weight(k) for k in range(len(FILTERS))))).withColumn("filter_order", F.explode(orders))
    # Each letter of an order adds its bit to the set of those before it.
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), k, F.lit(1))) - 1)
    rows = rows.withColumn("letters", letters).select("*", F.posexplode("letters").alias("place", "filter"))
    before = F.aggregate(F.slice("letters", F.lit(1), F.col("place")), F.lit(0), lambda acc, k: acc + F.pow(2, k).cast("int"))
    rows = rows.withColumns({"before": before, "bit": F.pow(2, F.col("filter")).cast("int")})

    def left(measure: str, with_: Column) -> Column:
        return F.get(measure, with_)

    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = {m: left(m, F.col("before")) - left(m, after) for m in MEASURES}
    failing = left("n", F.lit(0)) - left("n", F.col("bit"))
    return rows.select(
        "part", "filter_order", (F.col("place") + 1).alias("step"), left("n", after).alias("kept"), lost["n"].alias("removed"), (failing - lost["n"]).alias("redundant"),
        (left("n", F.lit(full) - F.col("bit")) - left("n", F.lit(full))).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.get("weights", F.col("filter")).alias("shapley"),
    )
