"""The scoring model against brute force for its base, loops for its mixing, and held-out texts."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelane.llm import context_mixing as M
from wavelane.llm.shared import fold
from wavelane.llm.textnum import text_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held():
    return fold("doc_id", 5) == 1


def brute_base(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in rows if d is not None and not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, out(d), len(own := tokens(t)), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for d, t in rows]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(r[:5]) for r in got] == [tuple(r[:5]) for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def score(docs, **more):
    return M.score_texts(docs, ~held(), held(), **more)


def test_base_by_brute_force(spark, docs):
    rows = docs.where("doc_id < 120").select("doc_id", "text")
    want = brute_base([tuple(r) for r in rows.collect()])
    few = score(rows, most=200).collect()
    same([tuple(r)[:6] for r in few], want)
    assert all(r.score < 0 and math.isclose(r.bits_per_byte * r.n_bytes * math.log10(2), -r.score) for r in few)
    all_ = score(rows.repartition(7)).collect()
    same([tuple(r)[:6] for r in all_], want)
    again = {r.doc_id: r.score for r in score(rows.coalesce(1)).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-3) for r in all_)


def test_edges(spark, odd, none):
    assert score(none).count() == 0
    got = score(odd.withColumnsRenamed({"n_removed": "n_tokens_", "blob": "score", "sketch": "word"}))
    same([tuple(r)[:6] for r in got.collect()], brute_base([(r.doc_id, r.text) for r in odd.collect()]))
    assert got.where("score <= 0 AND NOT isnan(score)").count() == 13 and got.where("bits_per_byte IS NULL").count() == got.where("n_bytes = 0").count() == 3
    nothing = M.score_texts(odd, F.lit(False), F.lit(True)).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.n_known == 0 and r.score < 0 for r in nothing if r.n_bytes)


@pytest.fixture(scope="module")
def model(spark, docs):
    rows = docs.select("doc_id", "text")
    words = M.stored(M.token_counts(rows, ~held()), "words")
    lexicon = M.Lexicon.of(words, 3000)
    tables = M.class_tables(rows, ~held(), lexicon)
    return lexicon, tables, M.Start.fit(rows, ~held(), lexicon, tables), M.Speller.fit(words), words


def test_lexicon(model):
    lexicon, *_, words = model
    count = {r.word: r.c for r in words.collect()}
    assert 2000 < len(lexicon.words) <= 3000 and lexicon.total == sum(count.values()) and lexicon.distinct == len(count)
    inside = set(lexicon.words.to_pylist())
    assert [count[w] for w in lexicon.words.to_pylist()] == lexicon.counts.tolist()
    assert max(c for w, c in count.items() if w not in inside) <= min(lexicon.counts) * 2 ** (1 / 16)
    shares = np.bincount(lexicon.classes, 10**lexicon.share)
    assert np.allclose(shares[shares > 0], 1)


def test_tokens(model):
    lexicon = model[0]
    texts = ["The the  THE\tof été", None, "", " \n", "x" * 300 + " the"]
    t = M.Tokens(*text_bytes(pa.array(texts)), lexicon)
    words = t.types.to_pylist()
    got = [[words[k] for k, r in zip(t.type, t.row, strict=True) if r == row] for row in range(5)]
    assert got == [["the", "the", "the", "of", "été", ""], [""], [""], [""], ["x" * 300, "the", ""]]
    listed = lexicon.words.to_pylist()
    assert all((listed[k] if k >= 0 else None) == (words[y] if words[y] in listed else None) for k, y in zip(t.known, t.type, strict=True))


def test_spelling_is_a_distribution(model):
    """All one-letter words and what two letters begin: chances add up to one at every step."""
    speller = model[3]
    words = pa.array(["".join(w) for n in (1, 2) for w in itertools.product("abcdefghijklmnopqrstuvwxyzé", repeat=n)])
    total = (10.0 ** speller.run(words, np.zeros(len(words), bool), False)).sum()
    assert 0 < total < 1
    row, node, bit, slots, shift = M.spelled(pa.array(["ab", "é"]))
    letters = [int("".join(map(str, bit[a : a + 8])), 2) for a in range(0, len(bit), 8)]
    assert bytes(letters) == b"ab " + "é ".encode() and row.tolist() == [0] * 24 + [1] * 24
    assert all(n == int("1" + "".join(map(str, bit[k - s : k])), 2) for k, (n, s) in enumerate(zip(node, shift, strict=True)))


def test_start_is_the_mean_of_all_training_texts(model, docs):
    """Over 500 texts, and one of over 64 KiB; each is fitted alone here, and the result does not depend on partitions."""
    lexicon, tables, *_ = model
    rows = docs.select("doc_id", "text")
    many = rows.where(~held()).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).selectExpr("10 * doc_id + k AS doc_id", "text")
    start = M.Start.fit(many, F.lit(True), lexicon, tables)
    texts = [r.text for r in many.collect()]
    assert len(texts) > 600
    times, weights, tries = np.zeros(8), np.zeros((8, 3)), 0
    views = [M.Odds(tables[1])]
    for text in texts:
        mixer = M.class_scores(M.Tokens(*text_bytes(pa.array([text])), lexicon), lexicon, tables, np.ones(1, bool), M.Start(), fits=True, views=views)[1]
        times += mixer.times
        weights += mixer.times[:, None] * mixer.weights.T
        tries = tries + mixer.tries
    assert np.allclose(start.weights, weights / times[:, None], atol=1e-4)
    assert np.allclose(start.refined[1], np.minimum(tries, M.PATIENCE), atol=1e-3)
    long_ = rows.unionByName(rows.where("doc_id = 3").selectExpr("-1L AS doc_id", "repeat(concat(text, ' '), 200) AS text"))
    assert long_.where("octet_length(text) > 65536").count() > 0
    a, b = (M.Start.fit(r, F.lit(True), lexicon, tables) for r in (long_, long_.repartition(6)))
    assert np.allclose(a.weights, b.weights, atol=1e-6) and not np.allclose(a.weights, M.Start.fit(rows, F.lit(True), lexicon, tables).weights, atol=1e-6)


def test_mixing_by_loops(model, docs):
    """One decision after the other, with plain numbers, weights and counts taken at the start of each block."""
    lexicon, tables, start, *_ = model
    texts = [r.text for r in docs.where("doc_id IN (3, 8)").collect()] + ["", "the of and"]
    tokens = M.Tokens(*text_bytes(pa.array(texts)), lexicon)
    learned = np.array([True, False, False, True])
    got = M.class_scores(tokens, lexicon, tables, learned, start)[0]
    token, node, bit, slots = tokens.decisions(np.arange(len(tokens.row)))
    for text in range(4):
        weights, counts = start.weights.astype(float).copy(), {}
        hits, tries = start.refined[0].astype(float).copy(), start.refined[1].astype(float).copy()
        total = sum(lexicon.share[k] for k, r in zip(tokens.known, tokens.row, strict=True) if r == text and k >= 0)
        own = [i for i in range(len(token)) if tokens.row[token[i]] == text]
        for _, block in itertools.groupby(own, lambda i: tokens.place[token[i]] // M.BLOCK):
            learn = []
            for i in block:
                b, x, seen = int(bit[i]), [], []
                for k, (table, at) in enumerate(zip(tables, slots, strict=True)):
                    n = [int(table[at[i]][v]) - int(k > 0 and learned[text] and v == b) for v in (0, 1)]
                    n = [max(v, 0) for v in n]
                    x.append(math.log((n[1] + M.PRIOR) / (n[0] + M.PRIOR)))
                    seen.append(sum(n))
                overall = M.OWN / (1 + math.exp(-x[0]))
                n = counts.get(node[i], [0, 0])
                x.append(math.log((n[1] + overall) / (n[0] + M.OWN - overall)))
                gate = sum(seen[1] >= e for e in (1, 4, 32)) + 4 * (node[i] == 0)
                z = sum(a * w for a, w in zip(x, weights[gate], strict=True))
                p = min(max(1 / (1 + math.exp(-z)), 1e-5), 1 - 1e-5)
                depth = 0 if node[i] == 0 else int(node[i]).bit_length()
                cell = depth * M.CELLS + int(min(max((z + 8) * M.CELLS / 16, 0), M.CELLS - 1))
                fine = (hits[cell] + M.PATIENCE * p) / (tries[cell] + M.PATIENCE)
                total += math.log10(fine if b else 1 - fine)
                learn.append((x, gate, p, b, cell, node[i]))
            of_gate = Counter(g for _, g, *_ in learn)
            for x, gate, p, b, cell, at in learn:
                rate = M.CLASS_RATE[0] * min(1, M.CLASS_RATE[1] / of_gate[gate])
                weights[gate] += rate * (b - p) * np.array(x)
                hits[cell] += b
                tries[cell] += 1
                counts.setdefault(at, [0, 0])[b] += 1
        assert math.isclose(total, got[text], rel_tol=2e-3, abs_tol=1e-3)


def test_few_decisions_at_once(model, docs, monkeypatch):
    """However many texts come together, their decisions are met a few at a time, and each text is scored and fitted as if it were alone."""
    lexicon, tables, start, *_ = model
    texts = [r.text for r in docs.where("doc_id < 150").collect()] + ["", "the of and", None, " ".join(f"of w{k % 7} the" for k in range(3000))]
    learned, views, sizes = np.arange(len(texts)) % 3 > 0, [M.Odds(tables[1])], []
    run = lambda own, marks, **more: M.class_scores(M.Tokens(*text_bytes(pa.array(own, pa.string())), lexicon), lexicon, tables, marks, views=views, **more)
    plain = M.Mixer.learn
    monkeypatch.setattr(M.Mixer, "learn", lambda self, x, at, *more: (sizes.append(len(at)), plain(self, x, at, *more))[1])
    together, fitted = run(texts, learned, start=start)[0], run(texts, learned, start=M.Start(), fits=True)[1]
    assert len(texts) > 2 * 64 and max(sizes) <= 64 * M.BLOCK * 9 and len(sizes) > 100
    alone = [run([t], learned[k : k + 1], start=start)[0][0] for k, t in enumerate(texts)]
    assert np.allclose(together, alone, rtol=1e-4)
    assert np.allclose(fitted.sums(), sum(run([t], learned[k : k + 1], start=M.Start(), fits=True)[1].sums() for k, t in enumerate(texts)), rtol=1e-3, atol=2)
    assert len(run([], learned[:0], start=start)[0]) == 0


def test_odds_and_steps_in_one_number(model):
    table = model[1][1]
    at = np.append(np.flatnonzero(table.sum(axis=1))[:5000], [0, len(table) - 1])
    odds = M.Odds(table)
    for view, less in enumerate(([0, 0], [1, 0], [0, 1])):
        n = np.maximum(table[at] - less, 0)
        got = odds.x.take(at + view * len(table))
        assert np.allclose(got, np.log((n[:, 1] + M.PRIOR) / (n[:, 0] + M.PRIOR)), rtol=1e-5, atol=1e-6)
        assert odds.seen(got).tolist() == [sum(k >= edge for edge in M.SEEN) for k in n.sum(axis=1)]


def test_texts_are_cut_once(spark, odd, monkeypatch):
    """Texts go to Python once to be counted and once to be coded, whatever is fitted and scored; words outside of the lexicon are listed and joined once."""
    plain, read = type(odd).mapInArrow, []
    monkeypatch.setattr(type(odd), "mapInArrow", lambda self, *more: (read.append(self.columns), plain(self, *more))[1])
    out = score(odd)
    assert sum("text" in columns for columns in read) == 2
    kept, made = M.stored, []
    monkeypatch.setattr(M, "stored", lambda df, *more: (made.append(df), kept(df, *more))[1])
    out = score(odd)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [*made, out]]
    assert sum(plan.count("Generate explode") for plan in plans) == 1


def test_coded_texts(spark, model, docs):
    """Coded texts hold all that the texts' tokens do, and fit the same tables and starting weights."""
    lexicon, tables, start, *_ = model
    odd = ["The the  THE\tof été", None, "", " \n", "x" * 300 + " the " + "x" * 300, "qqzx1 of qqzx2 the qqzx1", "".join(map(chr, range(1, 400))), "of " * 5000]
    texts = odd + [r.text for r in docs.where("doc_id < 60").collect()]
    rows = spark.createDataFrame([(k, t, k % 2 == 0, k % 3 > 0) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean, learned boolean")
    coded = M.coded(rows.repartition(3), lexicon).toArrow().sort_by("doc_id").combine_chunks()
    column = lambda name: coded.column(name).combine_chunks()
    want = M.Tokens(*text_bytes(pa.array(texts)), lexicon)
    got = M.Tokens.coded(column("ids"), column("hashes"), lexicon)
    assert all(np.array_equal(getattr(got, name), getattr(want, name)) for name in ("row", "place", "first", "count", "known", "hash", "before"))
    assert np.array_equal(got.class_[got.known >= 0], want.class_[want.known >= 0])
    assert all(np.array_equal(a, b) for a, b in zip(got.slots(0, len(got.row)), want.slots(0, len(want.row)), strict=True))
    words = want.types.to_pylist()
    for r in coded.to_pylist():
        own = np.flatnonzero(want.row == r["doc_id"])
        outside = Counter(words[want.type[k]] for k in own if want.known[k] < 0)
        assert {e["word"]: e["n"] for e in r["rare"]} == outside and len(r["rare"]) == len(outside)
        assert (r["n_tokens"], r["known"], r["n_bytes"]) == (len(own), sum(want.known[own] >= 0), len((texts[r["doc_id"]] or "").encode()))
        assert (r["held_out"], r["learned"]) == (r["doc_id"] % 2 == 0, r["doc_id"] % 3 > 0)
    assert len(set(column("row").to_pylist())) == len(texts)
    learned = M.coded(docs.selectExpr("text", "doc_id").withColumns({"held_out": held(), "learned": ~held()}), lexicon)
    assert all(np.array_equal(a, b) for a, b in zip(M.class_tables(learned, F.col("learned"), lexicon), tables, strict=True))
    again = M.Start.fit(learned, F.col("learned"), lexicon, tables)
    assert np.allclose(again.weights, start.weights, atol=1e-9) and np.allclose(again.refined, start.refined)


def test_numbers_by_hash(model):
    lexicon = model[0]
    listed = lexicon.words.to_pylist()
    words = pa.array([*listed[::-1], "", "qqzx1", listed[0] + "q"])
    want = [listed.index(w) if w in set(listed) else -1 for w in words.to_pylist()]
    hashes = M.Tokens(*text_bytes(words), lexicon)
    own = dict(zip(hashes.types.to_pylist(), hashes.type_hash.tolist(), strict=True))
    hash_ = np.array([own[w] for w in words.to_pylist()], np.uint64)
    assert lexicon.numbers(words, hash_).tolist() == want
    # A word with another's hash is told from it by its letters.
    assert lexicon.numbers(pa.array(["qqzx1"]), lexicon.hash[:1]).tolist() == [-1]
    # Where words of the lexicon share a hash, all are found still.
    twice = M.Lexicon(["a", "b", "of"], [9, 8, 7], 24, 3)
    twice.sorted = twice.sorted[[0, 0, 1]]
    assert twice.numbers(pa.array(["of", "b", "c", "a"]), np.zeros(4, np.uint64)).tolist() == [2, 1, -1, 0]
    assert M.Lexicon([], [], 0, 0).numbers(pa.array(["a"]), np.zeros(1, np.uint64)).tolist() == [-1]


def test_spelling_learns_block_by_block(model):
    """Looked up several blocks at once, words teach what they do when each block is run alone."""
    speller, words = model[3], pa.array([w for w in (r.word for r in model[4].orderBy("word").limit(2500).collect()) if w] + ["z" * 40000, "é", "of"])
    one, other = M.Speller(speller.packed), M.Speller(speller.packed)
    one.learn(words)
    one.learn(words.slice(0, 0))
    for low, high in M.word_slices(words, M.WORD_BLOCK):
        other.run(words.slice(low, high - low), np.ones(high - low, bool), True)
    assert one.mixer.times.sum() > 0 and np.array_equal(one.mixer.rows, other.mixer.rows)
    assert np.array_equal(one.mixer.came, other.mixer.came) and np.array_equal(one.mixer.times, other.mixer.times)


def test_held_out_texts_of_a_made_up_language(spark):
    """Two languages with words of their own: texts code below the unigram base, and shuffled letters above it."""
    rng = random.Random(5)
    languages = [["".join(rng.choice(a) for _ in range(rng.randint(2, 4))) for _ in range(400)] for a in (["ba", "do", "ke", "li"], ["ʒur", "pø", "tsa", "vyn"])]
    rows = [(d, " ".join(rng.choice(languages[d % 2]) for _ in range(150))) for d in range(400)]
    rows += [(1000 + d, "".join(rng.sample(t, len(t)))) for d, t in rows[:50]]
    got = score(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    real, junk = got[(got.doc_id < 1000) & got.held_out], got[(got.doc_id >= 1000) & got.held_out]
    assert len(real) > 40 and (real.score > real.base_score).mean() > 0.95
    assert real.bits_per_byte.max() < junk.bits_per_byte.min()
