"""Spelling variants and the filter audit against brute force."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wavelane.llm import filter_audit as A, spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, every=97, length=5, count=3):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % every == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return out


def variants(docs, **more):
    return [tuple(r) for r in S.spelling_variants(docs, **more).collect()]


def test_variants_by_brute_force(spark, docs):
    some = docs.where("doc_id < 60").select("doc_id", "text")
    words = brute_words([(r.doc_id, r.text) for r in some.collect()])
    got = variants(some)
    assert len(got) == len(set(got)) > 300 and set(got) == brute_variants(words)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got) or len(words) < 1000


def test_made_up_variants(spark):
    """Chains of forms, equal neighbours, ties, letters above ASCII, and every run with a deletion."""
    counts = {"colour": 90, "color": 30, "colr": 9, "kolor": 4, "aaaaa": 3, "aaaaaa": 3, "aaaaaaa": 7, "été été": 3, "étéété": 6, "étéétè": 3, "abcde": 3, "abcdf": 6, "abcdg": 6, "bcdef": 5, "cdefg": 3, "xbcde": 3}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    rows = [(k, t) for k, t in enumerate([text, "colours " * 8, "colour's COLOUR×colour", "ÉTÉÉTÉ étéété"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (97, 3, 1):
        assert set(variants(frame, every=every)) == brute_variants(brute_words(rows, every))
    by = {r[0]: r for r in variants(frame, every=10**12)}
    assert by["kolor"][1:3] == ("color", "colour") and by["abcde"][1] == "abcdf" and by["étéétè"][1] == "étéété"


def test_deletion_keys():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé"), n)) for n in rng.integers(1, 9, 400)] + ["a" * 5000, "ab" * 3000]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    rows, keys = S.deletion_keys(codes, np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    strings = {}
    for k, w in enumerate(words[:400]):
        own = [w, *sorted({w[:i] + w[i + 1 :] for i in range(len(w))})]
        assert len(own) == (rows == k).sum()
        for s, key in zip(sorted(own), sorted(keys[rows == k]), strict=True):
            strings.setdefault(len(own), []).append((s, key))
        strings.setdefault(w, int(keys[rows == k][0]))
    assert (rows == 400).sum() == 2 and (rows == 401).sum() == 6001
    known = {int(k) for r, k in zip(rows, keys, strict=True) if r < 400}
    assert len(known) == len({s for w in words[:400] for s in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]})


def test_variants_at_the_edges(spark, odd, none):
    assert variants(none) == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert set(variants(odd)) == brute_variants(brute_words(rows))
    long_ = spark.createDataFrame([(k, "Z" * 200_000 + "y" * (k == 3) + " words") for k in range(8)], "doc_id long, text string").withColumn("word", F.lit(None).cast("int"))
    got = {r[0][:5]: r for r in variants(long_, every=10**12)}
    assert got["zzzzz"][3] == 7 and got["words"][3] == 8


def test_no_table_of_words_is_broadcast(spark, docs, monkeypatch):
    plans, keep = [], S.stored

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *more)

    monkeypatch.setattr(S, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plans.append(S.spelling_variants(docs)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 3 and "SortMergeJoin" in plans[-1]
    assert not any("Broadcast" in p for p in plans)


def brute_audit(rows, labels):
    texts = {}
    for id_, text, _ in rows:
        if id_ is not None:
            texts[text or ""] = min(id_, texts.get(text or "", id_))
    docs, seen = [], set()
    for id_, text, source in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] or "")):
        text = text or ""
        if id_ is not None and (id_, text) in seen:
            continue
        seen.add((id_, text))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": id_ is not None and id_ > texts[text]}
        good, toxic = labels.get(id_, (0, 0))
        docs.append((source or "", fails, good == 1, toxic == 1))
    out = set()
    for part in {d[0] for d in docs}:
        own, rows_, total = [d for d in docs if d[0] == part], [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in own)
                total[f] += len(gone)
                rows_.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out |= {(*r[:-1], total[r[-1]]) for r in rows_}
    return out


def test_audit_by_brute_force(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    long_ = "Word and " * 150
    more = spark.createDataFrame([(10**6 + k, t, s) for k, (t, s) in enumerate([(None, None), ("", ""), ("", "src0"), (long_, "src0"), (long_, "src1"), (long_.lower() + "$", None), ("A B", "src1")])], "doc_id long, text string, source string")
    table = docs.select("doc_id", "text", "source").unionByName(more)
    marks = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    got = A.interaction_audit(table, labels)
    assert dict(got.dtypes)["step"] == "int" and set(dict(got.dtypes).values()) == {"string", "int", "bigint"}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_audit([tuple(r) for r in table.collect()], marks)


def test_audit_at_the_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (1, None, 1), (5, None, None), (None, 1, 1), (99, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert A.interaction_audit(none, labels).count() == 0
    got = A.interaction_audit(odd.withColumnRenamed("bucket", "mask"), labels)
    assert {tuple(r) for r in got.collect()} == brute_audit([(r.doc_id, r.text, r.source) for r in odd.collect()], {1: (1, 1), 8: (0, 1)})
    assert got.groupBy("filter_order").count().count() == 120 and {r.part for r in got.collect()} == {""}
