"""Piece encoding with seeded merge-dropout, and decoding.

A merge-type segmentation takes candidate merges from an agenda by rank, the leftmost first.
With dropout each candidate that comes up is skipped at the rate, independently of all others;
it may come up again after a neighbour has merged. What is drawn is how many candidates pass
before the next skip, by a hash of a seed, the document and the pre-token's place in it, so
that a run can be repeated exactly and another seed gives other segmentations. Only what a
pre-token gives without a skip is remembered; each occurrence has draws of its own. The agendas of
a few thousand pre-tokens are processed together, one candidate of each at a step, as rows of arrays.
At rate 0 the result is the library's own. Characters that are no piece become byte pieces, as does the
mark that stands for a space, so decoding gives back every text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wavelane.llm.textnum import U64, mix

#: Pre-tokens whose ids without a skip are remembered.
MEMO_ENTRIES = 800_000
#: Bytes of text whose pre-tokens are processed together.
TOGETHER_BYTES = 1 << 19
#: Draws that a pre-token has of its own by the document's key; more follow, by another one, where so many skips are not enough.
DRAWS = 4
#: Characters of a pre-token whose agenda is a row of an array; a longer one has a heap.
SHORT = 32
NO_RANK = 1 << 30
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_STEP = U64(0x9E3779B97F4A7C15)
_MARK = "▁"
_PIECES = re.compile(r"\n[^ \n]*| +[^ \n]*")
_BESIDE_MARKS = re.compile(r"\n|[^ \n]+| +[^ \n]*")
#: Starts the key of a pre-token without a space before it; and the key of a mark that the text has itself. No text holds these.
_BARE, _OWN_MARK = "\ud800", "\ud801"


class PieceCodec:
    def __init__(self, model_path: str, rate: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces of this vocabulary reach over spaces; its texts can't be cut at them")
        order = sorted(plain, key=lambda i: -model.get_score(i))
        self.ranks = {model.id_to_piece(i): k for k, i in enumerate(order) if len(model.id_to_piece(i)) > 1}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw: list[bytes] = [b""] * n
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(_MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.rate, self.seed = rate, seed
        self.scale = 1 / np.log1p(-rate) if 0 < rate < 1 else -0.0
        self._tabulate()
        self._forget()

    def _tabulate(self) -> None:
        """A hash table of the merges: by two symbols, which are pieces or lone characters, their rank and what they become."""
        n = self.n_pieces = len(self.raw)
        symbol = lambda p: self.ids[p] if p in self.ids else n + ord(p) if len(p) == 1 else -1
        rows = [(symbol(p[:k]) << 32 | symbol(p[k:]), r, self.ids[p]) for p, r in self.ranks.items() for k in range(1, len(p)) if symbol(p[:k]) >= 0 <= symbol(p[k:])]
        keys, ranks, become = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        bits = max(10, int(len(keys) - 1).bit_length() + 2)
        self.shift = U64(64 - bits)
        self.pairs = np.full((1 << bits) + 64, -1)
        # The last place stays free: it stands for no merge.
        self.pair_ranks, self.pair_symbols = np.full(len(self.pairs), NO_RANK, np.int32), np.zeros(len(self.pairs), np.int32)
        left, place = np.arange(len(keys)), self._place(keys)
        self.tries = 0
        while len(left):
            # Of the keys that want a free place one gets it; the others go on to the next.
            at = place[left]
            free = self.pairs[at] < 0
            self.pairs[at[free]] = keys[left[free]]
            got = self.pairs[at] == keys[left]
            self.pair_ranks[at[got]], self.pair_symbols[at[got]] = ranks[left[got]], become[left[got]]
            left = left[~got]
            place[left] += 1
            self.tries += 1
        single = np.arange(n, n + 0x110000)
        for p, i in self.ids.items():
            if len(p) == 1:
                single[ord(p)] = i
        self.single = single

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((mix(keys.view(U64)) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def _merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of merging two; NO_RANK for those that don't."""
        keys = a.astype(np.int64) << 32 | b
        at = self._place(keys)
        own = self.pairs[at]
        found = np.where(own == keys, at, -1)
        open_ = np.flatnonzero((own != keys) & (own >= 0))
        for k in range(1, self.tries):
            if not len(open_):
                break
            own = self.pairs[at[open_] + k]
            hit = own == keys[open_]
            found[open_[hit]] = at[open_[hit]] + k
            open_ = open_[~hit & (own >= 0)]
        return self.pair_ranks[found], self.pair_symbols[found]

    def _forget(self) -> None:
        #: By pre-token its number; by number the ids without a skip and the candidates that come up.
        self.memo: dict[str, int] = {_OWN_MARK: 0}
        self.whole = [np.array([self.bytes[b] for b in _MARK.encode()], "<u4").tobytes()]
        self.counts = np.zeros(1 << 12, np.int64)

    def gaps(self, key: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The draws of these numbers: how many candidates pass before one is skipped; ``key`` is one 64-bit number."""
        u = ((mix(key + (numbers.astype(U64) + U64(1)) * _STEP) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        return np.minimum(np.log(u) * self.scale, 1e9).astype(np.int64)

    def _more_gaps(self, key: np.ndarray, place: int) -> Iterator[int]:
        own = mix(mix(key ^ _STEP) + U64(place))
        while True:
            yield from self.gaps(own, np.arange(64)).tolist()
            own = mix(own + U64(1))

    def segment(self, text: str, gaps: Iterable[int] = ()) -> tuple[list[str], int, int]:
        """Pieces of a pre-token, whose spaces are marks; the candidates that came up, and how many were skipped."""
        ranks, gaps, seen, skips = self.ranks, iter(gaps), 0, 0
        left = next(gaps, -1)
        symbols, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has merged meanwhile
            seen += 1
            if not left:
                skips += 1
                left = next(gaps, -1)
                continue
            left -= 1
            piece = symbols[i] + symbols[j]
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (r, h, len(symbols[h]) + size))
        return [s for s in symbols if s], seen, skips

    def _ids(self, text: str, gaps: Iterable[int] = ()) -> tuple[bytes, int, int]:
        out: list[int] = []
        pieces, seen, skips = self.segment(text, gaps)
        for piece in pieces:
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in piece.encode()]
        return np.array(out, "<u4").tobytes(), seen, skips

    @staticmethod
    def _marked(key: str) -> str:
        return key[key[0] == _BARE :] if key and key[0] in ("\n", _BARE) else _MARK + key.replace(" ", _MARK)

    def _together(self, texts: list[str], draws: np.ndarray, more: Callable[[int], Iterator[int]] | None = None) -> tuple[list[bytes], np.ndarray]:
        """Ids of pre-tokens with spaces as marks, and the candidates that came up. ``draws``: a row of gaps for each, or no columns
        for no skips; ``more``: how to draw what comes after a row's."""
        ids: list[bytes] = [b""] * len(texts)
        counts = np.zeros(len(texts), np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            own = np.flatnonzero((size > low) & (size <= high))
            if len(own):
                self._rows(texts, own, size[own], draws[own], ids, counts)
        # Long ones, those with a character that is no piece, and those with more skips than a row of draws has.
        for k in np.flatnonzero((size > SHORT) | (counts < 0)).tolist():
            ids[k], counts[k], _ = self._ids(texts[k], chain(draws[k].tolist(), more(k)) if draws.shape[1] else ())
        return ids, counts

    def _rows(self, texts: list[str], own: np.ndarray, n: np.ndarray, draws: np.ndarray, ids: list[bytes], counts: np.ndarray) -> None:
        w, wide = len(own), int(n.max())
        code = np.frombuffer("".join([texts[k].ljust(wide, "\0") for k in own.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(w, wide)
        places = np.arange(wide)
        s = np.where(places < n[:, None], self.single[code], -1).astype(np.int32)
        ranks, become = np.full((w, wide), NO_RANK, np.int32), np.zeros((w, wide), np.int32)  # by place: the merge of the symbol there with the next one
        inside = np.zeros((w, wide), bool)
        inside[:, :-1] = places[:-1] < n[:, None] - 1
        ranks[inside], become[inside] = self._merges(s[inside], np.roll(s, -1, axis=1)[inside])
        seen, live, rows = np.zeros(w, np.int64), np.arange(w), np.arange(w)
        left = draws[:, 0].copy() if draws.shape[1] else np.full(w, 1 << 40)
        skips, more_needed = np.zeros(w, np.int64), np.zeros(w, bool)
        final: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            at = np.argmin(ranks, axis=1)
            go = ranks[rows, at] < NO_RANK
            if not go.all():
                final.append((live[~go], s[~go]))
                live, s, ranks, become, at = live[go], s[go], ranks[go], become[go], at[go]
                rows = rows[: len(live)]
            seen[live] += 1
            skip = left[live] == 0
            left[live] -= 1
            if skip.any():
                who = live[skip]
                skips[who] += 1
                out = who[skips[who] == draws.shape[1]]
                left[who] = draws[who, np.minimum(skips[who], draws.shape[1] - 1)]
                more_needed[out] = True
                left[out] = 1 << 40
                ranks[rows[skip], at[skip]] = NO_RANK
            j = rows[~skip]
            if len(j):
                i, r = at[j], rows[: len(j)]
                now = become[j, i]
                take = np.minimum(places + (places > i[:, None]), wide - 1) + (j * wide)[:, None]
                own_s, own_r, own_b = s.ravel()[take], ranks.ravel()[take], become.ravel()[take]
                own_s[:, -1], own_r[:, -1] = -1, NO_RANK
                own_s[r, i] = now
                own_r[r, i] = NO_RANK
                following = np.where(i + 1 < wide, own_s[r, np.minimum(i + 1, wide - 1)], -1)
                has = np.flatnonzero(following >= 0)
                own_r[has, i[has]], own_b[has, i[has]] = self._merges(now[has], following[has])
                has = np.flatnonzero(i > 0)
                own_r[has, i[has] - 1], own_b[has, i[has] - 1] = self._merges(own_s[has, i[has] - 1], now[has])
                s[j], ranks[j], become[j] = own_s, own_r, own_b
        for who, rows in final:
            known = (rows < self.n_pieces).all(axis=1) & ~more_needed[who]
            counts[own[who]] = np.where(known, seen[who], -1)
            rows, who = rows[known], own[who[known]]
            there = rows >= 0
            raw = rows[there].astype("<u4").tobytes()
            ends = (4 * np.cumsum(there.sum(axis=1))).tolist()
            for k, a, b in zip(who.tolist(), [0, *ends[:-1]] if ends else [], ends, strict=True):
                ids[k] = raw[a:b]

    def _learn(self, keys: list[str]) -> None:
        """Numbers new pre-tokens by what they give without a skip."""
        ids, counts = self._together([self._marked(k) for k in keys], np.zeros((len(keys), 0), np.int64))
        n = len(self.whole)
        self.memo.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.whole += ids
        if len(self.whole) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.whole), np.int64)])
        self.counts[n : n + len(keys)] = counts

    def encode(self, text: str, variant: int = 0) -> bytes:
        """Little-endian 32-bit ids of a text, by the draws of a document's variant."""
        return self.encode_all([text], [variant])[0]

    def encode_all(self, texts: list[str], variants: list[int]) -> list[bytes]:
        """Ids of each text, by its document's variant."""
        out, low = [], 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and size < TOGETHER_BYTES:
                size += len(texts[high])
                high += 1
            out += self._encode_some(texts[low:high], variants[low:high])
            low = high
        return out

    def _encode_some(self, texts: list[str], variants: list[int]) -> list[bytes]:
        if len(self.memo) >= MEMO_ENTRIES:
            self._forget()
        split = [self._pre_tokens(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = list(chain.from_iterable(split))
        numbers = np.fromiter(map(self.memo.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys([flat[k] for k in new])))
            numbers[new] = [self.memo[flat[k]] for k in new]
        out = list(map(self.whole.__getitem__, numbers.tolist()))
        if self.rate > 0 and flat:
            seeds = mix(mix(np.array([self.seed & (2**64 - 1)], U64)) + np.array([v & (2**64 - 1) for v in variants], U64))
            doc = np.repeat(np.arange(len(texts)), sizes)
            place = np.arange(len(flat)) - offsets[:-1][doc]
            # Few pre-tokens have a skip: a first draw below the candidates that come up; only for these are more draws made.
            skip = np.flatnonzero(self.gaps(seeds[doc], DRAWS * place) < self.counts[numbers])
            doc, place = doc[skip], place[skip]
            draws = self.gaps(seeds[doc, None], DRAWS * place[:, None] + np.arange(DRAWS))
            more = lambda k: self._more_gaps(seeds[doc[k] : doc[k] + 1], int(place[k]))
            for k, ids in zip(skip.tolist(), self._together([self._marked(flat[k]) for k in skip.tolist()], draws, more)[0], strict=True):
                out[k] = ids
        ends = offsets.tolist()
        return [b"".join(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _pre_tokens(self, text: str) -> list[str]:
        """Keys of a text's pre-tokens: each without its first space, which encoding adds before the first one, or from a line feed on."""
        if not text:
            return []
        if _MARK in text:
            # The text's parts between its own marks are encoded on their own, the marks as bytes.
            first, *others = text.split(_MARK)
            out = [m if m[0] == "\n" else m[1:] if m[0] == " " else _BARE + m for m in _BESIDE_MARKS.findall(" " + first)]
            for part in others:
                out += [_OWN_MARK, *(m if m[0] == "\n" else m[1:] if m[0] == " " else _BARE + m for m in _BESIDE_MARKS.findall(part))]
            return out
        if "  " in text or text[0] == " ":
            return [m[1:] if m[0] == " " else m for m in _PIECES.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def decode(self, ids: bytes) -> str:
        """The text that the ids encode; their first space is the one that encoding adds."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode()

    def variant(self, doc_id: int | None) -> int:
        """The document's own: its id, and a number that no id has for a null one."""
        return 1 << 63 if doc_id is None else doc_id


_codecs: dict[tuple, PieceCodec] = {}


def codec(model_path: str, rate: float, seed: int) -> PieceCodec:
    key = (model_path, rate, seed)
    if key not in _codecs:
        _codecs[key] = PieceCodec(*key)
    return _codecs[key]


def encode_texts(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """Rows (doc_id, ids). Null texts count as empty, without ids; null doc_ids share a variant of their own; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, rate, seed)
        for batch in batches:
            texts, variants = [t or "" for t in batch.column(1).to_pylist()], [own.variant(d) for d in batch.column(0).to_pylist()]
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in own.encode_all(texts, variants)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_texts(encoded: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null or no ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, 0.0, 0)
        for batch in batches:
            texts = [own.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long"), encoded["ids"].cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, ids_crc32, variant, lossless), one for each row of ``docs``. ``variant`` is a crc32 of the
    seed and the id, as a signed number; the draws are by the whole id.

    ``lossless``: decoding the ids gives the text. Null texts count as empty; repeated rows give repeated rows; an empty
    table gives none; other columns are ignored. One pass over the scan, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, rate, seed)
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            variant = [own.variant(d) for d in docs_]
            ids = own.encode_all(texts, variant)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            columns = [batch.column(0), size, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(np.array([zlib.crc32(b"%d:%d" % (seed, v)) for v in variant], np.uint32).view(np.int32)), pa.array([own.decode(i) == t for i, t in zip(ids, texts, strict=True)])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "variant", "lossless"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, variant int, lossless boolean")
