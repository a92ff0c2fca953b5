from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wavelane.llm import exchange, fingerprint, near_dup, sentence_spans, suffix_levels
from wavelane.llm.textnum import find_words, hash_spans, returned, shingles, text_bytes


# -- shared parts ----------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a b  c", "", None, "\nab\n", "a b", "é"]
    data, offsets = text_bytes(pa.array(texts))
    starts, ends, at = find_words(data, offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert words == [b"a", b"b", b"c", b"ab", b"a", b"b", "é".encode()] and at.tolist() == [0, 3, 3, 3, 4, 6, 7]
    h = hash_spans(data, starts, ends)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 5
    values, out = shingles(h, at, 3)
    assert np.diff(out).tolist() == [1, 0, 0, 1, 1, 1] and len(set(values.tolist())) == 4


def test_blobs_hold_arrays():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 2**63, 50).astype(np.uint64), np.sort(rng.integers(-(2**62), 2**62, 50)), rng.integers(0, 9, 50).astype(np.int32), rng.integers(0, 2, 50).astype(np.int8)]
    for n in (50, 1, 0):
        own = [a[:n] for a in arrays]
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(own, exchange.unpack_arrays(exchange.pack_arrays(own)), strict=True))
    short = exchange.unpack_arrays(exchange.pack_arrays(arrays, {0: 5}))
    assert (short[0] == arrays[0] % 2**40).all()


def test_levels_find_every_later_place():
    rng = np.random.default_rng(2)
    levels, marked, places = exchange.Levels(), set(), defaultdict(set)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        key, doc, start = rng.integers(0, 300, n).astype(np.uint64), rng.integers(0, 50, n), rng.integers(0, 9, n).astype(np.int32)
        for k, d, s in zip(key.tolist(), doc.tolist(), start.tolist(), strict=True):
            places[k].add((d, s))
        firsts, others = exchange.first_of_each([key, doc, start, start])
        levels.add(firsts)
        for a in [others[1:], *levels.take()]:
            marked |= set(zip(a[0].tolist(), a[1].tolist(), strict=True))
    expect = {p for own in places.values() for p in own if p != min(own)}
    assert expect <= marked and len(levels.levels) <= 9
    sizes = [len(x[0]) for x in levels.levels]
    assert all(a >= 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))


def test_levels_merge_in_little_memory():
    rng = np.random.default_rng(3)
    n = 200_000
    tracemalloc.start()
    try:
        levels = [[rng.integers(0, 2**63, n).astype(np.uint64), np.arange(n), np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)] for _ in range(2)]
        own, _ = tracemalloc.get_traced_memory()
        expect = {tuple(r) for x in levels for r in zip(*(a[::1000].tolist() for a in x), strict=True)}
        before, _ = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        exchange.merged_levels(levels, lambda both: np.argsort(both[0], kind="stable"))
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    (merged,) = levels
    assert (np.diff(merged[0].view(np.int64)) >= 0).all() and expect <= set(zip(*(a.tolist() for a in merged), strict=True))
    assert peak - before < 1.2 * own  # entries once more at most, not twice


def test_free_memory_is_returned_after_a_task():
    def resident() -> int:
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) >> 10

    def run(batches):
        for batch in batches:
            parts = [np.ones(8_000) for _ in range(3_000)]  # small enough for the heap
            pins.append(np.ones(8_000))  # keeps the heap from shrinking by itself
            del parts
            used.append(resident())
            yield batch

    list(returned(iter)([]))  # what other tests have left free
    batch, pins, used, before = pa.RecordBatch.from_pydict({"doc_id": [1]}), [], [], resident()
    assert list(returned(run)(iter([batch]))) == [batch] and used[0] - before > 150
    assert resident() - before < 50


def test_joined_spans():
    doc, s, e = exchange.joined(np.array([1, 1, 2, 1]), np.array([5, 0, 3, 9], np.int32), np.array([9, 6, 4, 12], np.int32))
    assert list(zip(doc.tolist(), s.tolist(), e.tolist(), strict=True)) == [(1, 0, 12), (2, 3, 4)]


# -- repeated bytes --------------------------------------------------------------------------------------------------


def brute_bytes(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def byte_rows(seed, n=150):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([90, 100, 101, 130, 300]))) for _ in range(6)] + ["x" * 300, "xy" * 150, "abc" * 40, "abcdefg" * 30]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(base)[rng.choice([0, 0, 5, 40]) : rng.choice([None, None, -3, -30])] + rng.choice(["", "", "q", str(k)]) for _ in range(rng.randint(0, 5)))
        rows.append((k * 3 - 60, text if k % 50 else None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,parts,paired,batch", [(1, 1, 32, 1 << 16), (2, 6, 32, 1 << 16), (3, 5, 2, 50), (4, 7, 1, 7)])
def test_bytes_by_brute_force(spark, seed, parts, paired, batch):
    rows = byte_rows(seed)
    got = suffix_levels.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), paired=paired, batch=batch).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows)


def test_bytes_in_small_batches(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_levels.remove_repeated_bytes(docs.repartition(9), with_text=True, batch=500).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_bytes_at_the_edges(spark, odd, none):
    got = suffix_levels.remove_repeated_bytes(odd).collect()
    assert len(got) == 13 and all(r.n_removed == 0 for r in got if r.doc_id in (None, 1, 2, 3, 4, 5, 6, 7))
    assert next(r for r in got if r.doc_id == 8).n_removed == next(r for r in got if r.doc_id == 8).n_bytes
    assert suffix_levels.remove_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_a_repeated_document_is_one(spark, parts):
    rows = byte_rows(5, 60)
    twice = spark.createDataFrame([*rows, *rows[::2]], "doc_id long, text string").repartition(parts)
    got = suffix_levels.remove_repeated_bytes(twice).collect()
    assert len(got) == 90
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows)


# -- sentence spans --------------------------------------------------------------------------------------------------


def brute_sentences(rows, least_sentences, least_words):
    docs = {}
    for d, t in rows:
        raw, found, own = (t or "").encode(), [], []
        places = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for k, (a, b) in enumerate(places):
            own.append(raw[a:b])
            if raw[b - 1 : b] in (b".", b"!", b"?") or k == len(places) - 1 or b"\n" in raw[b : places[k + 1][0]]:
                found.append(own)
                own = []
        n = len(found)
        words = lambda i, j: sum(map(len, found[i:j]))  # noqa: E731, B023
        spans = {(i, next(j for j in range(i + least_sentences, n + 1) if words(i, j) >= least_words)) for i in range(n) if words(i, n) >= least_words and n - i >= least_sentences}
        spans |= {(next(i for i in range(j - least_sentences, -1, -1) if words(i, j) >= least_words), j) for j in range(n + 1) if words(0, j) >= least_words and j >= least_sentences}
        docs[d] = found, spans
    first = {}
    for d in sorted(docs):
        for i, j in sorted(docs[d][1]):
            first.setdefault(tuple(w for s in docs[d][0][i:j] for w in s), (d, i))
    out = {}
    for d, (found, spans) in docs.items():
        gone = {k for i, j in spans if first[tuple(w for s in found[i:j] for w in s)] != (d, i) for k in range(i, j)}
        out[d] = len(found), len(gone)
    return out


@pytest.mark.parametrize("least", [(2, 4), (3, 6)])
def test_sentences_by_brute_force(spark, least):
    rng = random.Random(sum(least))
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) + rng.choice([".", "!", "?", "\n"]) for _ in range(12)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(120)]
    got = sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), *least).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in got} == brute_sentences(rows, *least)
    assert sum(r.n_removed for r in got) > 50


def test_sentences_on_the_table(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = sentence_spans.remove_repeats(docs.repartition(6)).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in got} == brute_sentences(rows.items(), 2, 12)
    for r in got:
        raw = rows[r.doc_id].encode()
        for span in reversed(r.removed):
            raw = raw[: span.start] + raw[span.end :]
        assert raw.decode() == r.text


def test_sentences_at_the_edges(spark, odd, none):
    got = sentence_spans.remove_repeats(odd)
    rows = got.collect()
    assert len(rows) == 13 and set(odd.columns) <= set(got.columns)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].text is None and by[7].text == "" and by[1].n_removed == 0 and by[8].text == ""
    assert sentence_spans.remove_repeats(none).count() == 0


def brute_runs(rows, run_words):
    """Word places that a run of so many words covers which occurs earlier."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first, gone = {}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - run_words + 1):
            if first.setdefault(tuple(words[d][i : i + run_words]), (d, i)) != (d, i):
                gone.setdefault(d, set()).update(range(i, i + run_words))
    return {d: [w for k, w in enumerate(words[d]) if k not in gone.get(d, ())] for d in words}


def test_passages_in_mid_sentence(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passages = [fresh(60), fresh(25) + ". " + fresh(30), fresh(20) + ".\n" + fresh(9) + "! " + fresh(22), fresh(51), fresh(50)]
    rows = [(k, f"{fresh(7)} {p} {fresh(5)}. {fresh(8)}.") for k, p in enumerate(passages)]
    rows += [(10 + k, f"{fresh(9)}. {fresh(4)} {p} {fresh(6)} {fresh(3)}. {fresh(3)}") for k, p in enumerate(passages)]
    rows += [(30, f"{passages[0]} {passages[3]}"), (31, f"{fresh(3)} {passages[1]}"), (32, " ".join(["ha"] * 80)), (None, passages[0])]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), run_words=51).collect()}
    expect = brute_runs([r for r in rows if r[0] is not None], 51)
    assert {d: r.text.split() for d, r in got.items() if d is not None} == expect
    assert got[None].text == passages[0] and got[30].text == "" and [len(expect[d]) for d in (10, 11, 12, 13, 14, 32)] == [25, 25, 25, 25, 75, 1]
    for d, t in rows:
        raw = t.encode()
        for span in reversed(got[d].removed):
            raw = raw[: span.start] + raw[span.end :]
        assert raw.decode() == got[d].text and (got[d].n_removed + got[d].n_cut > 0) == (got[d].text != t)


def test_sentences_cut_are_counted_apart(spark):
    """Sixty words inside of one sentence, then the same ones as two sentences: without runs nothing, with runs a cut or a removal."""
    run = " ".join(f"w{k}" for k in range(60))
    halves = " ".join(f"v{k}" for k in range(30)) + ". " + " ".join(f"u{k}" for k in range(30)) + "."
    rows = [(1, f"one two {run} three four."), (2, f"five {run} six."), (3, halves), (4, f"New here. {halves} And there.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_cut, r.text) for r in sentence_spans.remove_repeats(frame, run_words=51).collect()}
    assert got[2] == (0, 1, "five six.") and got[4] == (2, 0, "New here. And there.")
    got = {r.doc_id: (r.n_removed, r.n_cut, r.text) for r in sentence_spans.remove_repeats(frame).collect()}
    assert got[2] == (0, 0, rows[1][1]) and got[4] == (2, 0, "New here. And there.")


def thue_morse(n, pair):
    return "".join(pair[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_do_not_collide(spark, n):
    """Strings that collide under any polynomial modulo 2^64: words, lines and documents that hold them stay apart."""
    pairs = [(thue_morse(n, p), thue_morse(n, p[::-1])) for p in ("ab", "xy", "01")]
    for a, b in pairs:
        data = np.frombuffer((a + b).encode(), np.uint8)
        one, two = hash_spans(data, np.array([0, n]), np.array([n, 2 * n]))
        assert one != two
    rows = [(2 * k + j, w) for k, pair in enumerate(pairs) for j, w in enumerate(pair)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dup.near_duplicates(frame, size=3, percent=85).where("NOT kept").count() == 0
    common = " ".join(f"word{k}" for k in range(50))
    frame = spark.createDataFrame([(d, f"{common} {w}") for d, w in rows], "doc_id long, text string")
    assert sentence_spans.remove_repeats(frame, run_words=51).where("n_removed + n_cut > 0").count() == 0


def test_query_leaves_no_run_of_over_50_words(spark, docs):
    from wavelane.llm.queries import op9_sentence_spans

    got = {r.doc_id: r.text.split() for r in op9_sentence_spans(spark, "/root/testdata/sf0.001").collect()}
    runs = brute_runs([(r.doc_id, r.text) for r in docs.collect()], 51)
    for d, left in runs.items():
        rest = iter(left)
        assert all(w in rest for w in got[d])


# -- near-duplicates -------------------------------------------------------------------------------------------------


def brute_near(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def families(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]

    def family(n, base, edits, start):
        for k in range(n):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            yield start + k, " ".join(own)

    rows = [*family(80, rng.choices(words, k=120), 12, 0), *family(80, rng.choices(words, k=60), 4, 1000), *family(30, ["a", "b"], 1, 2000)]
    rows += [(5000 + k, None if k % 2 else " ") for k in range(6)] + [(6000, "A b"), (6001, "a B"), (6002, "É b"), (6003, "é b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent,block,bytes_", [(3, 85, 4096, 1 << 24), (3, 85, 20, 1 << 24), (5, 80, 4096, 1 << 24), (3, 85, 6, 1 << 24), (5, 80, 4096, 3000)])
def test_near_by_brute_force(spark, size, percent, block, bytes_):
    rows = families(size)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size, percent, block, bytes_).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows, size, percent)


def test_near_with_a_crowded_key(spark):
    """A family of over 5,000 near copies, chains that leave it, and unlike texts that share its keys' place in the table."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows, sets = [], {}
    for k in range(5200):
        own = list(base)
        own[rng.randrange(40)] = f"x{k}"
        rows.append((k + 10, " ".join(own)))
    chain = list(base)
    for k in range(12):
        chain[k * 3] = f"y{k}"
        rows.append((9000 + k, " ".join(chain)))
    rows += [(9500 + k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))) for k in range(50)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 3, 80, 1000).collect()}
    shingle = lambda t: {tuple(w[i : i + 3]) for w in [t.split()] for i in range(len(w) - 2)}
    sets = {d: shingle(t) for d, t in rows}
    # Any two of the family share at least 32 of 44 shingles: it is one component if it is connected at all, by texts with near places.
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, own in sets.items():
        for x in own:
            holders[x].append(d)
    near = sorted(d for d in sets if d < 9000)
    place = {d: next(i for i, w in enumerate(t.split()) if w[0] == "x") for d, t in rows if d < 9000}
    by_place = defaultdict(list)
    for d in near:
        by_place[place[d]].append(d)
    for own in by_place.values():
        for d in own[1:]:  # the same place: 35 of 41 shingles at least
            parent[find(d)] = find(own[0])
    heads = [own[0] for own in by_place.values()] + [d for d in sets if d >= 9000]
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for i, a in enumerate(heads):
        for b in heads[i + 1 :]:
            if linked(a, b):
                parent[find(b)] = find(a)
    expect = {}
    for d in sorted(sets):
        expect.setdefault(find(d), d)
    assert got == {d: expect[find(d)] for d in sets}


def test_crowded_keys_are_dealt_again(spark):
    """Of members that share a band key, every near pair is held together: chains whose ends are far apart, copies, and lone ones."""
    rng = np.random.default_rng(7)
    flip = lambda s, bits: [int(x) for x in np.packbits(np.unpackbits(np.array(s, np.int64).view(np.uint8)) ^ np.isin(np.arange(256), bits)).view(np.int64)]
    rows, chains = [], []
    for k in range(40):
        own = [int(x) for x in rng.integers(-(2**62), 2**62, 4)]
        further = [int(x) for x in rng.integers(10, 2**60, 12)]
        # Steps of 60 bits: each is near the one before and far from the others.
        for step in range(3):
            rows.append((k + 100 * step, [1, *(int(x) for x in rng.integers(10, 2**60, 14))], further, own))
            own = flip(own, range(60 * step, 60 * step + 60))
        chains.append({k, k + 100, k + 200})
    for k in range(50):
        rows.append((1000 + k, [1, *range(2, 16)], list(range(5, 17)), flip([0, 0, 0, 0], [k % 20])))
    chains.append(set(range(1000, 1050)))
    rows = [rows[k] for k in rng.permutation(len(rows))]
    classes = spark.createDataFrame(rows, "doc_id long, bands array<long>, further array<long>, sketch array<long>")
    for block in (1000, 60, 10):
        found = near_dup.components(near_dup.candidate_pairs(classes, 4, 73, block)).collect()
        at = {**{r.component: r.component for r in found}, **{r.doc_id: r.component for r in found}}
        assert all(len({at[d] for d in own}) == 1 for own in chains)
        # Nothing else, but for what the wider limit beside the least id lets in.
        assert len(set(at.values())) == len(chains)


def test_near_at_the_edges(spark, odd, none):
    got = near_dup.near_duplicates(odd, 3, 85).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == 13 and by[7].component_id == 1 and by[8].component_id == 5 and by[2].n_shingles == 0 and by[2].kept
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dup.near_duplicates(none, 3, 85).count() == 0


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(6)
    error = []
    for share in (0.9, 0.95, 0.85):
        for _ in range(30):
            n = 400
            common = int(2 * n * share / (1 + share))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 2**63, n - common).astype(np.uint64)])
            s = near_dup.odd_sketches(near_dup.samples_of(np.concatenate([a, b]), np.array([0, n, 2 * n])))
            bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
            estimate = 1 + near_dup.SKETCH_BITS / (4 * near_dup.SAMPLES) * np.log(1 - 2 * bits / near_dup.SKETCH_BITS)
            error.append(estimate - common / (2 * n - common))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_sketches_lose_hardly_a_pair(similarity):
    """The exact distribution of the bits that differ, for ideal hashes."""
    n, bits = near_dup.SAMPLES, near_dup.SKETCH_BITS
    odd, over, k = np.zeros(bits + 1), [], np.arange(bits + 1)
    odd[0] = 1
    for _ in range(n + 1):
        over.append(odd[near_dup.most_different(similarity) + 1 :].sum())
        for _ in range(2):
            odd = np.concatenate([[0], (odd * (bits - k) / bits)[:-1]]) + np.concatenate([(odd * k / bits)[1:], [0]])
    share = [math.comb(n, d) * (1 - similarity) ** d * similarity ** (n - d) for d in range(n + 1)]
    assert np.dot(share, over) < 2e-8


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, x) for x in range(201, 230)]
    rng.shuffle(edges)
    got = {r.doc_id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100, **dict.fromkeys(range(201, 230), 200)}


# -- fingerprints ----------------------------------------------------------------------------------------------------


def test_fingerprints_by_brute_force(spark, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)

    def runs(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    got, error = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}, []
    for k, (d, text) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        a, b = runs(text), runs(edited)
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        error.append(abs(got[d].near_edited - len(a & b) / max(1, len(a | b))))
    assert np.mean(error) < 0.08
    kept = sum(len(r.fingerprint.split()) for r in got.values()) / sum(len(runs(t)) for _, t in rows)
    assert abs(kept - 1 / fingerprint.SCALE) < 0.03


def test_fingerprints_run_without_python(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_next_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_DOCUMENTS", 5)
    rng = random.Random(3)
    ids = rng.sample(range(-(10**12), 10**12), 120) + [7, 7]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)] + [(None, "null")], "k long, t string")
    got = fingerprint.with_next(df.repartition(4), "k", ["t"]).collect()
    order = [t for _, t in sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (-x[0], x[1]))] + ["null"]
    assert {r.t: r.next_t for r in got} == dict(zip(order, order[1:] + order[:1], strict=True))


def test_fingerprints_at_the_edges(spark, odd, none):
    rows = fingerprint.fingerprints(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 13 and by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "" and by[1].fingerprint == by[7].fingerprint != ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.fingerprints(none).count() == 0
    lone = fingerprint.fingerprints(spark.createDataFrame([(4, "ab")], "doc_id long, text string")).first()
    assert (lone.edited_sha256, lone.near_next) == (hashlib.sha256(b"aa").hexdigest(), 1.0)


def test_sketches_merge(spark):
    df = spark.createDataFrame([(" ".join(f"a{k}" for k in range(200)), " ".join(f"b{k}" for k in range(2000)))], "x string, y string")
    for c in ("x", "y"):
        df = fingerprint.with_sketch(df, c, f"s{c}")
    df = df.withColumn("m", fingerprint.merged("sx", "sy"))
    r = df.select(fingerprint.containment("sx", "m").alias("c"), fingerprint.containment("m", "sx").alias("d"), fingerprint.likeness("sx", "sy").alias("n")).first()
    assert r.c == 1.0 and abs(r.d - 196 / (196 + 1996)) < 0.06 and r.n == 0.0


def test_merged_sketches_are_those_of_both_texts(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        sizes = rng.choice([(5, 5), (6, 300), (8, 7), (0, 5), (0, 0), (200, 200)])
        x, y = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in sizes)
        rows.append((k, x, y))
    df = spark.createDataFrame(rows, "k int, x string, y string")
    for c in ("x", "y"):
        df = fingerprint.with_sketch(df, c, f"s{c}")
    edge = 2**63 // fingerprint.SCALE
    for r in df.select("sx", "sy", fingerprint.merged("sx", "sy").alias("m"), fingerprint.merged("sy", "sx").alias("w")).collect():
        both = sorted({*r.sx, *r.sy})
        below = [h for h in both if h < edge]
        assert r.m == r.w == (below or both[:1])


def test_next_likeness_by_brute_force(spark, docs):
    """near_next of sketches that retain every hash is the resemblance of the shingle sets; of the query's, close to it."""
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got, error = {r.doc_id: r.near_next for r in fingerprint.fingerprints(docs).collect()}, []
    runs = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for i in range(len(w) - 4)} or {tuple(t.split())}
    for k, (d, text) in enumerate(rows):
        a, b = runs(text), runs(rows[(k + 1) % len(rows)][1])
        error.append(abs(got[d] - len(a & b) / len(a | b)))
    assert np.mean(error) < 0.03
