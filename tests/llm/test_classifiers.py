from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelane.llm import language_id as L, quality as Q, toxicity as T
from wavelane.llm.shared import fold
from wavelane.llm.textnum import row_ranges, text_bytes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_learns_words(spark):
    """Held-out texts of a made-up language whose toxic words are known."""
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    bad = ["vile", "scum", "trash"]

    def text(toxic):
        own = [words[k] for k in rng.integers(0, len(words), rng.integers(20, 200))]
        for _ in range(2 * toxic):
            own.insert(int(rng.integers(len(own))), bad[int(rng.integers(3))])
        return " ".join(own)

    y = rng.integers(0, 2, 900)
    texts = [text(t) for t in y]
    model = T.TextConvolution.fit(texts[:600], y[:600], [None] * 600)
    data, offsets = text_bytes(pa.array(texts[600:]))
    score = np.concatenate([model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_ranges(offsets, 4000)])
    assert ((score >= 0.5) == y[600:]).mean() > 0.97
    assert model.scores(*text_bytes(pa.array(["", None, "wholly unseen words"]))).max() < 0.5


def test_toxicity_on_the_tables(spark, tables, odd, none):
    docs, labels = tables
    model = T.fit_classifier(docs, labels, fold("doc_id", 5) != 0)
    got = T.score_texts(docs, model, fold("doc_id", 5) == 0).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.toxic).mean() > 0.9
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert T.score_texts(odd, model, fold("doc_id", 5) == 0).count() == 13 and T.score_texts(none, model, fold("doc_id", 5) == 0).count() == 0
    nothing = T.fit_classifier(none, labels.limit(0), F.lit(True))
    assert T.score_texts(odd, nothing, F.lit(False)).where("score BETWEEN 0 AND 1").count() == 13


def test_score_ignores_other_columns(spark, tables):
    docs, labels = tables
    model = T.fit_classifier(docs, labels, fold("doc_id", 5) != 0)
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = {r.doc_id: r.score for r in T.score_texts(docs, model, F.lit(True)).collect()}
    assert a == {r.doc_id: r.score for r in T.score_texts(changed, model, F.lit(True)).collect()}


def test_toxicity_learns_from_all_labelled_texts(spark):
    """3,000 texts of each class; each of 600 toxic words is in five of them, and one is in long texts only."""
    rng = np.random.default_rng(2)
    letters = "abcdefghijklmnopqrst"
    words = [a + b for a in letters for b in letters]
    bad = ["x" + a + b for a in letters for b in letters + "uvwxyzABCD"]
    rows = [(2 * d + y, " ".join([*(words[k] for k in rng.integers(0, 400, 12)), *[bad[d % 600]] * y]), None, y) for d in range(3000) for y in (0, 1)]
    rows += [(7000 + d, "lengthy " * 10_000, "de", 1) for d in range(12)]
    rows += [rows[1], (8000, None, "xx", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = T.fit_classifier(table.drop("toxic"), table.select("doc_id", "toxic"), F.lit(True), rounds=2)
    known = [bool(model.place[w]) for w in T.buckets(*text_bytes(pa.array([" ".join(bad)])))[0]]
    assert np.mean(known) > 0.93 and model.place[T.buckets(*text_bytes(pa.array(["lengthy"])))[0][0]] and model.languages == ["de"]
    again = T.fit_classifier(table.drop("toxic").repartition(7), table.select("doc_id", "toxic"), F.lit(True), rounds=2)
    assert np.allclose(model.embeddings, again.embeddings, atol=1e-5) and np.allclose(model.thresholds, again.thresholds, atol=0.02)


def test_shards_count_as_loops_do(spark):
    texts = ["a b b c", "b é", "", "a a", "c d e"]
    words, at = T.buckets(*text_bytes(pa.array(texts)))
    shard = T.Shard(words, at, np.array([0, 1, 1, 0, 1]), np.array([0, 1, -1, 2, 0]), np.array([False, False, False, False, True]))
    tables = {}
    shard.count_into(tables)
    shard.count_into(tables)
    with_, of_language = T.split_tables(tables, 3)
    for word in "abcde":
        k = T.buckets(*text_bytes(pa.array([word])))[0][0]
        assert with_[k].tolist() == [2 * sum(word in texts[i].split() for i in own) for own in ((0, 3), (1, 2))]
        assert of_language[k].tolist() == [2 * texts[i].split().count(word) for i in (0, 1, 3)]


def test_threshold_is_the_widest_best_cut():
    assert T.best_threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1]), 9.0) == 3.0
    assert T.best_threshold(np.array([0.0, 1.0]), np.array([0, 0]), 9.0) == 9.0


def brute_bits(trees, order, text):
    out, h = 0.0, b"\n" * order + text
    for i in range(len(text)):
        for k in range(order, -1, -1):
            c = int.from_bytes(h[i + order - k : i + order], "big")
            j = np.searchsorted(trees.contexts[k], c)
            if j == len(trees.contexts[k]) or trees.contexts[k][j] != c:
                continue
            n, q, g = trees.totals[k][j], trees.kinds[k][j], c * 256 + h[i + order]
            z = np.searchsorted(trees.grams[k], g)
            if z < len(trees.grams[k]) and trees.grams[k][z] == g:
                out -= np.log2(trees.counts[k][z] / (n + q))
                break
            out -= np.log2(q / (n + q))
        else:
            out += 8
    return out


def test_code_lengths_are_exact():
    model = L.LanguageModel.fit([("banana bandana", "a"), ("abracadabra", "b"), ("", "b")])
    texts = ["banana", "", "abba\nzz", "日本", "ban" * 50]
    scorer = L.Scorer(model)
    for limit in (1 << 20, 3):
        bits = np.zeros((2, len(texts)))
        data, offsets = text_bytes(pa.array(texts))
        for a, b in row_ranges(offsets, limit):
            bits[:, a:b] = scorer.code_lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k, t in enumerate(texts):
            assert np.allclose(bits[:, k], [brute_bits(tree, L.ORDER, t.encode()) for tree in model.trees])


def test_languages_on_the_tables(spark, tables, odd, none):
    docs, _ = tables
    model = L.LanguageModel.fit(L.labelled_texts(docs, fold("doc_id", 4) != 2))
    got = L.identify(docs, model).withColumn("held", fold("doc_id", 4) == 2).join(docs.select("doc_id", "lang"), "doc_id").where("held").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.97
    und = {r.doc_id: r.lang_pred for r in L.identify(odd, model).collect()}
    assert und[2] == und[3] == und[4] == "und" and und[6] in model.languages and L.identify(none, model).count() == 0
    assert L.keep_identified(odd, model).count() == 9 and L.keep_identified(odd, model).columns == odd.columns
    empty = L.LanguageModel.fit([])
    assert {r.lang_pred for r in L.identify(odd, empty).collect()} == {"und"} and L.keep_identified(odd, empty).count() == 9


def test_sample_is_bounded(spark, tables):
    docs, _ = tables
    rows = L.labelled_texts(docs, F.lit(True), per_language=7)
    assert Counter(lang for _, lang in rows) == dict.fromkeys({"en", "fr", "de", "es"}, 7)
    assert rows == L.labelled_texts(docs.repartition(5), F.lit(True), per_language=7)


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_base_counts(docs, odd):
    texts = [r.text for r in docs.collect()] + [r.text for r in odd.collect()] + [None, "", "\n\n", "a\na\n\na b", " x " * 40, "é é\n\té é", "\n a\n", "a b c d e f g h " * 3, "x\x1cy z"]
    data, offsets = text_bytes(pa.array(texts))
    base, _, _, _ = Q.measure(data, offsets)
    assert np.stack([base[k] for k in Q.BASE], axis=1).tolist() == [brute_base(t) for t in texts]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    field = Q.LineField(rng.normal(size=3), rng.normal(size=(2, 2)))
    n = rng.integers(0, 9, 40)
    at = np.concatenate([[0], np.cumsum(n)])
    x = rng.normal(size=(at[-1], 3))
    got, score = field.decode(x, at), field.scores(x)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b > a:
            best = max(itertools.product((0, 1), repeat=b - a), key=lambda y: sum(k * s for k, s in zip(y, score[a:b], strict=True)) + sum(field.moves[p, q] for p, q in zip(y[:-1], y[1:], strict=True)))  # noqa: B023
            assert list(best) == got[a:b].tolist()


def test_field_gradient_raises_the_likelihood():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 6, 60)
    at = np.concatenate([[0], np.cumsum(n)])
    y = rng.integers(0, 2, 60)
    x = np.stack([np.ones(at[-1]), np.repeat(y, n) + rng.normal(0, 0.4, at[-1])], axis=1)

    def likelihood(field):
        total = 0.0
        for k in range(60):
            s = field.scores(x[at[k] : at[k + 1]])
            value = lambda lab: sum(a * b for a, b in zip(lab, s, strict=True)) + sum(field.moves[p, q] for p, q in zip(lab[:-1], lab[1:], strict=True))  # noqa: E731, B023
            total += value((y[k],) * n[k]) - np.logaddexp.reduce([value(lab) for lab in itertools.product((0, 1), repeat=n[k])])
        return total

    values = [likelihood(Q.LineField.fit(x, at, y, steps=s, decay=0.0)) for s in (1, 10, 60)]
    assert values[0] < values[1] < values[2] < 0


def test_quality_on_the_tables(spark, tables, odd, none):
    docs, labels = tables
    field = Q.fit_field(docs, labels.where("doc_id % 2 = 0"))
    got = Q.assess(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    long_enough = got[~got.base_failed]
    assert (long_enough.kept == (long_enough.quality == 1)).mean() > 0.95
    assert not got[got.base_failed].kept.any()
    rows = Q.assess(odd, field).collect()
    assert len(rows) == 13 and all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4, 6))
    assert Q.assess(none, field).count() == 0 and Q.keep_content(none, field).count() == 0
    assert Q.keep_content(docs, field).count() == Q.assess(docs, field).where("kept").count()
    assert Q.keep_content(odd, field).columns == odd.columns
    plain = Q.fit_field(docs, labels.limit(0))
    assert Q.assess(docs, plain).where("kept = base_failed").count() == 0


def test_convolution_by_loops():
    """Logits of the trained model, filter by filter and word by word."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], rng.integers(0, 12))) for _ in range(80)]
    y = np.array(["ab cd" in t for t in texts], int)
    model = T.TextConvolution.fit(texts, y, [None] * 80, epochs=3)
    words, at = T.buckets(*text_bytes(pa.array(texts)))
    got = model.logits(*model.spread(words, at))
    for k in range(len(texts)):
        x = np.concatenate([model.embeddings[model.place[words[at[k] : at[k + 1]]]], np.zeros((3, T.DIMENSIONS), np.float32)])
        hidden = []
        for f, b in zip(model.filters, model.biases, strict=True):
            outputs = [sum(x[i + j] @ f[j] for j in range(len(f))) + b for i in range(at[k + 1] - at[k] + 1)]
            hidden.append(np.maximum(np.max(outputs, axis=0), 0))
        assert abs(np.concatenate(hidden) @ model.weights + model.bias - got[k]) < 1e-3


def test_samples_are_the_least_hashes(spark):
    from wavelane.llm.shared import bounded_sample, sampled_texts

    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") < 30_000, "often").otherwise("some").alias("kind"))
    twice = rows.unionByName(rows.where("kind = 'rare'"))
    for most in (7, 300, 5000):
        got = bounded_sample(twice, "kind", most).collect()
        ranked = {}
        for r in rows.withColumn("h", F.xxhash64("doc_id")).collect():
            ranked.setdefault(r.kind, []).append((r.h, r.doc_id))
        assert {(r.kind, r.doc_id) for r in got} == {(k, d) for k, own in ranked.items() for _, d in sorted(own)[:most]} and len(got) == len(set(got))
    docs = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "x" * 70_000, 3), (3, None, 4), (4, "c", 5)], "doc_id long, text string, n int")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert [tuple(r)[:3] for r in sampled_texts(docs, ids, "n")] == [(1, "a", 2)]
    assert bounded_sample(rows.limit(0), "kind", 5).count() == 0
