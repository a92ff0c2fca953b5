from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from wavelane.llm import piece_codec, token_counts
from wavelane.llm import packing
from wavelane.llm.packing import ChunkIds, HarmonicBins, pack

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "▁", "a", "the", "é", "日", "😀", "\t", "\r\n", "ing", "e", " ", "\x00", "<s>", "<0x0A>", "   ", "word", ".", ",", "'s", "S", "1", "Σ", "İ", "ﬁ", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "\x85", " "]


def strings(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_are_the_librarys(library):
    own = token_counts.PieceCounter(PIECES)
    texts = [*strings(1, 8000), "", " ", "\n", "a\n\nb", "a b\nc d", "é\nè ab", "x" * 5000]
    for s, n in zip(texts, own.counts(pa.array(texts)).tolist(), strict=True):
        assert n == len(library.encode(s)), repr(s)
    assert own.counts(pa.array([None, "a"])).tolist() == [0, 1] and len(own.counts(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_pre_tokens_are_told_apart(spark, library, n):
    """Strings of two symbols that collide under any polynomial modulo 2^64: counts and ids are the libraries' for each."""
    from tokenizers import Tokenizer

    texts = ["".join(pair[bin(k).count("1") % 2] for k in range(n)) for p in ("ab", "xy", "01", "zq", "AB") for pair in (p, p[::-1])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, PIECES).collect()} == {k: len(library.encode(t)) for k, t in enumerate(texts)}
    words, got = Tokenizer.from_file(WORDS), {}
    for r in pack(frame, WORDS).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for k, t in enumerate(texts):
        ids = np.array([*words.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[k]) == [(s, m, zlib.crc32(ids[s : s + m].tobytes())) for s, m, _ in sorted(got[k])]


def test_whole_tokens_are_proved(library):
    own = token_counts.PieceCounter(PIECES)
    assert len(own.whole) > 10_000
    assert all(len(library.encode(k)) == 1 for k in random.Random(2).sample(sorted(own.whole - {""}), 500))


def test_memo_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 20_000)
    monkeypatch.setattr(token_counts, "SLICE", 9_000)
    own = token_counts.PieceCounter(PIECES)
    texts = [" ".join(f"zq{k}x" for k in range(n, n + 900)) for n in range(0, 9000, 900)]
    assert own.counts(pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts] and len(own.known) <= 20_000


def test_count_query(spark, docs, odd, none, library):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, PIECES).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 4096)
    rows = token_counts.count_tokens(odd, PIECES).collect()
    assert len(rows) == 13 and [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_ids_are_the_librarys():
    own = ChunkIds(WORDS)
    texts = [*strings(3, 6000), "", "a" * 3000, "x y " * 900]
    for s, ids in zip(texts, own.encode(pa.array(texts), 1), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*own.tokenizer.encode(s, add_special_tokens=False).ids, 1], repr(s)
    assert [len(i) for i in own.encode(pa.array([None, "", "<|x"]), 1)][:2] == [4, 4] and list(own.encode(pa.array([], pa.string()), 1)) == []


def test_ids_with_a_small_memo(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 40)
    monkeypatch.setattr(packing, "SLICE", 60)
    own = ChunkIds(WORDS)
    texts = strings(6, 500)
    for s, ids in zip(texts, own.encode(pa.array(texts), 1), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*own.tokenizer.encode(s, add_special_tokens=False).ids, 1], repr(s)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        ChunkIds(P.path("byte_bpe_50k.json"))


def check_packing(rows, capacity):
    """Gapless sequences without padding, each id in one piece; returns the pieces by document."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    return by_doc


def test_pack_query(spark, docs, odd, none):
    tokenizer = ChunkIds(WORDS).tokenizer
    for table in (docs, docs.repartition(7)):
        by_doc = check_packing(pack(table, WORDS).collect(), 2048)
        for r in docs.collect():
            ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
            at = 0
            for piece in sorted(by_doc[r.doc_id], key=lambda p: p.start):
                assert piece.start == at and piece.doc_tokens == len(ids)
                assert piece.ids_crc32 == zlib.crc32(np.array(ids[at : at + piece.length], "<u4").tobytes())
                at += piece.length
            assert at == len(ids)
    full = [s for s in defaultdict(int, {r.sequence_id: 0 for r in pack(docs.coalesce(1), WORDS).collect()})]
    total = sum(r.length for r in pack(docs.coalesce(1), WORDS).collect())
    assert len(full) <= total // 2048 + 11
    rows = pack(odd.coalesce(1), WORDS).collect()
    check_packing(rows, 2048)
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3, 4)] == [(1, 1)] * 3
    assert pack(none, WORDS).count() == 0


def test_bins_of_one_worker():
    for capacity, longest in ((16, 40), (64, 64), (64, 9)):
        bins, rng, rows, docs = HarmonicBins(capacity, 5), random.Random(longest), [], {}
        for k in range(300):
            docs[k] = np.arange(rng.randint(1, longest), dtype="<u4").tobytes()
            rows += bins.add(k, docs[k])
        whole = len(rows)
        rows += bins.finish()
        fill, ids, count = defaultdict(int), defaultdict(int), Counter()
        for d, start, length, crc, n, s, at in sorted(rows, key=lambda r: (r[5], r[6])):
            assert fill[s] == at and crc == zlib.crc32(docs[d][4 * start : 4 * (start + length)]) and n == len(docs[d]) // 4
            fill[s] += length
        for d, start, length, *_ in sorted(rows):
            assert ids[d] == start
            ids[d] += length
            count[d] += 1
        assert all(ids[d] == len(raw) // 4 for d, raw in docs.items())
        assert set(fill) == set(range(5, 5 + len(fill))) and all(v & (v - 1) == 0 for v in fill.values())
        assert sum(v < capacity for v in fill.values()) <= capacity.bit_length() - 1
        # A sequence of class k has k pieces of that class, or one more that fills it; a document is cut once for each sequence at most.
        assert sum(count.values()) - len(docs) <= len(fill) and whole > 200
    with pytest.raises(ValueError):
        HarmonicBins(100, 0)


def test_codec_without_dropout_is_the_librarys(library):
    own = piece_codec.PieceCodec(PIECES, 0.0, 0)
    for s in strings(4, 5000):
        if "▁" not in s:
            assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode(s), repr(s)


def test_dropout_is_lossless_seeded_and_varied(docs, library):
    own, other = piece_codec.PieceCodec(PIECES, 0.1, 1), piece_codec.PieceCodec(PIECES, 0.1, 2)
    for k, s in enumerate(strings(5, 4000)):
        assert own.decode(own.encode(s, k % 4)) == s
    texts = [r.text for r in docs.collect()]
    a = [own.encode(t) for t in texts]
    assert a == [piece_codec.PieceCodec(PIECES, 0.1, 1).encode(t) for t in texts]
    assert sum(x != other.encode(t) for x, t in zip(a, texts, strict=True)) > 0.9 * len(texts)
    assert sum(own.encode(t, 1) != x for x, t in zip(a, texts, strict=True)) > 0.9 * len(texts)
    assert all(library.decode(np.frombuffer(x, "<u4").tolist()) == t for x, t in zip(a, texts, strict=True))
    assert set(np.frombuffer(piece_codec.PieceCodec(PIECES, 1.0, 1).encode("the word"), "<u4").tolist()) <= {library.piece_to_id(c) for c in "▁theword"}


def test_dropout_draws_for_each_occurrence():
    """Forms of a word over documents and within one, and their shares, are those of independent draws."""
    own, rng = piece_codec.PieceCodec(PIECES, 0.1, 17), random.Random(3)
    for word in ("information", "because", "different", "together"):
        pieces = lambda gaps: tuple(own.segment("▁" + word, gaps)[0])  # noqa: E731, B023
        geometric = lambda: (int(np.log(rng.random()) / np.log(0.9)) for _ in range(99))
        expect = Counter(pieces(geometric()) for _ in range(4000))
        over = Counter(tuple(np.frombuffer(own.encode(word, own.variant(d)), "<u4").tolist()) for d in range(4000))
        assert len(over) > 6 and abs(over.most_common(1)[0][1] - expect.most_common(1)[0][1]) < 200
        assert abs(len(over) - len(expect)) < 0.4 * len(expect)
        line = own.encode(" ".join([word] * 300), 5)
        assert len({own.encode(f"{word} {word}", d) for d in range(300)}) > len({own.encode(word, d) for d in range(300)}) > 4
        assert line != own.encode(word, 5) * 300 and own.decode(line) == " ".join([word] * 300)
        assert line == piece_codec.PieceCodec(PIECES, 0.1, 17).encode(" ".join([word] * 300), 5)


def test_dropout_does_not_depend_on_what_is_remembered(docs, monkeypatch):
    texts = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    a = piece_codec.PieceCodec(PIECES, 0.1, 1)
    expect = [a.encode(t, d) for d, t in texts]
    assert expect == [a.encode(t, d) for d, t in texts]
    monkeypatch.setattr(piece_codec, "MEMO_ENTRIES", 50)
    b = piece_codec.PieceCodec(PIECES, 0.1, 1)
    assert expect[::-1] == [b.encode(t, d) for d, t in reversed(texts)]


def brute_agenda(own, text, gaps):
    """Merges by a list of candidates that is searched anew at each step."""
    symbols, waiting, left = list(text), None, next(gaps)
    waiting = [own.ranks.get(a + b) for a, b in zip(symbols, symbols[1:])]
    while any(r is not None for r in waiting):
        i = min((r, k) for k, r in enumerate(waiting) if r is not None)[1]
        if left == 0:
            waiting[i], left = None, next(gaps)
            continue
        left -= 1
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del waiting[i]
        for k in (i - 1, i):
            if 0 <= k < len(waiting):
                waiting[k] = own.ranks.get(symbols[k] + symbols[k + 1])
    out = []
    for s in symbols:
        out += [own.ids[s]] if s in own.ids else [own.bytes[b] for b in s.encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6, 1.0])
def test_dropout_by_brute_force(rate):
    """Each pre-token by the draws of its place, over short, long and odd ones."""
    own, rng = piece_codec.PieceCodec(PIECES, rate, 23), random.Random(11)
    words = ["information", "x" * 40, "été", "日本語テキスト", "a", "counterrevolutionaries", "internationalization" * 3, "q\x01z"]
    for d in range(60):
        keys = [rng.choice(words) for _ in range(rng.randint(1, 20))]
        key = piece_codec.mix(piece_codec.mix(np.array([23], np.uint64)) + np.array([d], np.uint64))
        expect = []
        for k, word in enumerate(keys):
            endless = iter(lambda: 10**9, None)
            draws = endless if rate == 0 else iter([*own.gaps(key, piece_codec.DRAWS * k + np.arange(piece_codec.DRAWS)).tolist(), *(x for x, _ in zip(own._more_gaps(key, k), range(999)))])
            expect += brute_agenda(own, "▁" + word, draws)
        assert np.frombuffer(own.encode(" ".join(keys), d), "<u4").tolist() == expect


def test_variants_are_independent():
    """Pre-tokens that two documents both cut otherwise than without dropout are as many as chance has it."""
    own, whole = piece_codec.PieceCodec(PIECES, 0.1, 5), piece_codec.PieceCodec(PIECES, 0.0, 5)
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(7)) for _ in range(3000)]
    plain = [whole.encode(w) for w in words]
    cut = []
    for d in (4, 5, 6):
        ids = own._encode_some([" ".join(words)], [d])[0]
        numbers, at, own_cut = np.frombuffer(ids, "<u4"), 0, np.zeros(len(words), bool)
        for k, w in enumerate(words):
            size, n = 0, at
            while size < len(w) + 1:
                size += len(own.raw[numbers[n]].decode())
                n += 1
            own_cut[k] = numbers[at:n].tobytes() != plain[k]
            at = n
        cut.append(own_cut)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        expect = cut[a].mean() * cut[b].mean() * len(words)
        assert abs((cut[a] & cut[b]).sum() - expect) < 5 * expect**0.5


def test_codec_tables(spark, docs, odd, none):
    encoded = piece_codec.encode_texts(odd, PIECES, 0.1, 3)
    back = piece_codec.decode_texts(encoded, PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert piece_codec.round_trips(docs, PIECES).where("NOT lossless").count() == 0
    assert piece_codec.round_trips(odd, PIECES).where("NOT lossless").count() == 0
    assert piece_codec.round_trips(none, PIECES).count() == 0 and piece_codec.encode_texts(none, PIECES).count() == 0
