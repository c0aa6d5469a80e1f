"""SentencePiece merge vocabularies: seeded merge-dropout encoding and decoding.

Reads a merge-type model file. Spaces become the word mark, one mark goes in
front, and the symbols of a word are merged pair by pair from an agenda, the
best-scored piece first, then the leftmost. Each candidate merge taken from the
agenda is skipped if a 64-bit hash of the seed, the document key, the word's
number, the place in the word and the piece is in the lowest share ``dropout``;
a skipped pair may still be merged in another way. So every occurrence of a word
is cut on its own, always alike for the same seed; a dropout of 0 gives the
model's plain segmentation.

Characters without a piece become byte pieces; the word mark itself, where a
text holds it, is written as bytes, so it can't be taken for a space. Decoding
gives back the exact text. Null and empty texts have no ids and decode to the
empty text.

A worker keeps, for a word, the candidates of the merges without a skip and the
ids they lead to, up to two generations of ``KEEP`` words; this depends on no
key. An occurrence of which no candidate is skipped has those ids. All others of
an Arrow batch are merged anew together: one table of symbols, a row a word, in
which every step takes the best candidate of each row, hashes it and merges or
skips it; rows that have no candidate left leave. Words over ``SHORT`` symbols
are merged one by one.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
KEEP = 400_000
#: rows of a table of words that are merged together
ROWS = 1 << 14
_M64 = 2**64 - 1
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
#: words up to so many symbols keep their agenda in a plain list or a table's row, longer ones in a heap
SHORT = 24
NEVER = 1 << 40
GONE = -(1 << 40)
#: the rank of no pair in a table
LAST = np.int32(2**31 - 1)
_CODERS: dict[tuple, Coder] = {}


def _mix(x: int) -> int:
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


def _mix_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code(place: int, piece: int) -> int:
    return (place * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F) & _M64


class Word(NamedTuple):
    """The codes of a word's candidates if none is skipped, the ids they lead to,
    and its symbols (none if it is merged by itself)."""

    codes: bytes
    ids: bytes
    symbols: bytes | None


class Coder:
    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id, self.piece_id, score = [0] * 256, {}, {}
        self.raw = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.piece_id[piece] = i
                score[i] = model.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        # (left id, right id) -> the joint piece, and the rank of its score
        rank = {v: k for k, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.base = n + 1
        self.pairs, self.ranks = {}, {}
        for piece, i in self.piece_id.items():
            for cut in range(1, len(piece)):
                x, y = self.piece_id.get(piece[:cut]), self.piece_id.get(piece[cut:])
                if x is not None and y is not None:
                    self.pairs[x * self.base + y] = i
                    self.ranks[x * self.base + y] = rank[score[i]]
        # a piece with a mark behind another character would join words
        self.joins_words = any(MARK in p.lstrip(MARK) for p in self.piece_id)
        self.word = self._word_pattern()
        self.seed = seed
        #: hashes below this are skips
        self.limit = min(int(dropout * 2.0**64), _M64) if dropout > 0 else 0
        self.now: dict[str, Word] = {}
        self.before: dict[str, Word] = {}
        #: the symbol of every code point: an id, below -1 (see odd_bytes) without a piece, -1 if not met yet
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for piece, i in self.piece_id.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.odd_bytes: list[list[int]] = []
        # the pairs in order, to be searched for many at once
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_pieces = np.append(np.fromiter(self.pairs.values(), np.int32, len(keys))[order], np.int32(0))
        self.pair_ranks = np.append(np.fromiter((self.ranks[k] for k in keys.tolist()), np.int32, len(keys))[order], LAST)

    @classmethod
    def of(cls, path: str, dropout: float, seed: int) -> Coder:
        """The coder of this worker."""
        if (path, dropout, seed) not in _CODERS:
            _CODERS[path, dropout, seed] = cls(path, dropout, seed)
        return _CODERS[path, dropout, seed]

    def _word_pattern(self) -> re.Pattern:
        """Words with the spaces before them; a word of letters also ends before a
        mark of punctuation that no piece holds behind a letter: no merge crosses that."""
        behind = {p[k + 1] for p in self.piece_id for k in range(len(p) - 1) if _LETTER.match(p[k])}
        marks = "".join(map(re.escape, sorted(set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") - behind)))
        return re.compile((rf" *{_LETTER.pattern}+(?=[{marks}])|" if marks else "") + " *[^ ]+| +")

    def _merged_short(self, ids: list[int], first: int, skip) -> list[int]:
        pairs, ranks, base = self.pairs, self.ranks.get, self.base
        agenda = [ranks(x * base + y, NEVER) for x, y in pairwise(ids)]
        place = list(range(first, first + len(ids)))
        while agenda and (best := min(agenda)) < NEVER:
            k = agenda.index(best)
            piece = pairs[ids[k] * base + ids[k + 1]]
            if skip and skip(place[k], piece):
                agenda[k] = NEVER
                continue
            ids[k] = piece
            del ids[k + 1], place[k + 1], agenda[k]
            if k:
                agenda[k - 1] = ranks(ids[k - 1] * base + piece, NEVER)
            if k < len(agenda):
                agenda[k] = ranks(piece * base + ids[k + 1], NEVER)
        return ids

    def _merged_long(self, ids: list[int], first: int, skip) -> list[int]:
        pairs, ranks, base, n = self.pairs, self.ranks.get, self.base, len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int):
            j = right[i]
            if j < n and (r := ranks(ids[i] * base + ids[j])) is not None:
                heapq.heappush(agenda, (r, i, j, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, x, y = heapq.heappop(agenda)
            if ids[i] != x or right[i] != j or ids[j] != y:
                continue
            piece = pairs[x * base + y]
            if skip and skip(first + i, piece):
                continue
            ids[i], ids[j] = piece, GONE
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [x for x in ids if x != GONE]

    def segment(self, word: str, skip) -> list[int]:
        """Ids of one word (marks for spaces) by the agenda; skip(place, piece) is asked for each candidate."""
        ids = list(map(self.piece_id.get, word))
        if None not in ids:
            return self._merged_short(ids, 0, skip) if len(ids) <= SHORT else self._merged_long(ids, 0, skip)
        odd = {}
        for k, c in enumerate(word):
            if ids[k] is None:  # a number no pair has
                ids[k] = odd.setdefault(c, -1 - len(odd))
        return self._with_bytes(ids, {v: c for c, v in odd.items()}, skip)

    def _with_bytes(self, ids: list[int], odd: dict[int, str], skip) -> list[int]:
        """Merge between characters without a piece, which become bytes."""
        out, run = [], []
        for k, i in enumerate([*ids, None]):
            if i is None or i < 0:
                if run:
                    first = k - len(run)
                    out += self._merged_short(run, first, skip) if len(run) <= SHORT else self._merged_long(run, first, skip)
                    run = []
                if i is not None:
                    out += [self.byte_id[b] for b in odd[i].encode("utf-8", "surrogatepass")]
            else:
                run.append(i)
        return out

    def _symbols(self, words: list[str]) -> np.ndarray:
        """Symbols of the words end to end: ids, and a number below -1 for each character without a piece."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[points]
        if (symbols == -1).any():
            for point in np.unique(points[symbols == -1]).tolist():
                self.odd_bytes.append([self.byte_id[b] for b in chr(point).encode("utf-8", "surrogatepass")])
                self.symbol_of[point] = -1 - len(self.odd_bytes)
            symbols = self.symbol_of[points]
        return symbols

    def _spelled(self, ids: bytes) -> bytes:
        """Ids in which the bytes of characters without a piece stand for them."""
        out = array("I")
        for x in np.frombuffer(ids, np.int32).tolist():
            if x >= 0:
                out.append(x)
            else:
                out.extend(self.odd_bytes[-2 - x])
        return out.tobytes()

    def _made(self, words: list[str]) -> list[Word]:
        """Words without their occurrences' keys: short ones together, long ones one by one."""
        flat = self._symbols([w.replace(" ", MARK) for w in words]).tobytes()
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = (np.cumsum(size) * 4).tolist()
        symbols = [flat[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)] if words else []
        short = np.flatnonzero(size <= SHORT).tolist()
        out: list[Word | None] = [None] * len(words)
        for i, (ids, codes) in zip(short, self._merged_rows([symbols[i] for i in short], None), strict=True):
            out[i] = Word(codes, ids, symbols[i])
        for i in np.flatnonzero(size > SHORT).tolist():
            codes = array("Q")

            def note(place: int, piece: int) -> bool:
                codes.append(_code(place, piece))  # noqa: B023
                return False

            ids = array("I", self.segment(words[i].replace(" ", MARK), note)).tobytes()
            out[i] = Word(codes.tobytes(), ids, None)
        return out

    def _known(self, words: list[str]) -> list[Word]:
        missing = []
        for w in words:
            if w not in self.now:
                if w in self.before:
                    self.now[w] = self.before[w]
                else:
                    missing.append(w)
        self.now.update(zip(missing, self._made(missing), strict=True))
        known = [self.now[w] for w in words]
        if len(self.now) > KEEP:
            self.before, self.now = self.now, {}
        return known

    def _at_once(self, word: str, key: int) -> bytes:
        limit = self.limit
        skip = (lambda place, piece: _mix(key ^ _code(place, piece)) < limit) if limit else None
        return array("I", self.segment(word.replace(" ", MARK), skip)).tobytes()

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of ids; LAST where there is none or an id is missing (-1)."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        there = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.pair_ranks[at], LAST), self.pair_pieces[at]

    def _merged_table(self, ids: np.ndarray, keys: np.ndarray | None) -> list[tuple[bytes, bytes]]:
        """(ids, codes) of words given as rows of symbols (-1 behind the last one).

        A merged pair keeps the column of its left symbol, its place in the
        word; the right one's column is blank from then on, and each column
        knows its neighbours. With the keys of their occurrences candidates are
        skipped, and codes are empty; without, none is, and codes tell the
        candidates in order."""
        n, width = ids.shape
        stride = width + 1  # a blank column behind the last
        ids = np.hstack([ids, np.full((n, 1), -1, np.int32)])
        rank, piece = np.full((n, stride), LAST, np.int32), np.zeros((n, stride), np.int32)
        rank[:, :-1], piece[:, :-1] = self._offers(ids[:, :-1], ids[:, 1:])
        right = np.tile(np.minimum(np.arange(1, stride + 1), width).astype(np.int8), n)
        left = np.tile(np.concatenate([[width], np.arange(width)]).astype(np.int8), n)
        id_at, rank_at, piece_at = ids.reshape(-1), rank.reshape(-1), piece.reshape(-1)
        live, notes = np.arange(n), []
        while len(live):
            k = rank[live].argmin(1)
            at = live * stride + k
            going = rank_at[at] < LAST
            if not going.all():
                live, k, at = live[going], k[going], at[going]
            new = piece_at[at]
            code = k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + new.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            if keys is None:
                notes.append((live, code))
            else:
                skip = _mix_all(keys[live] ^ code) < np.uint64(self.limit)
                rank_at[at[skip]] = LAST
                at, k, new = at[~skip], k[~skip], new[~skip]
            row = at - k
            gone = row + right[at]
            after = right[gone]
            id_at[at], id_at[gone], rank_at[gone] = new, -1, LAST
            right[at], left[row + after] = after, k
            rank_at[at], piece_at[at] = self._offers(new, id_at[row + after])
            before = left[at]
            inner = before < width
            before, new = row[inner] + before[inner], new[inner]
            rank_at[before], piece_at[before] = self._offers(id_at[before], new)
        stays = ids != -1
        end = np.cumsum(stays.sum(1)) * 4
        flat = ids[stays].tobytes()
        found = [flat[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
        for i in np.flatnonzero((ids < -1).any(1)).tolist():
            found[i] = self._spelled(found[i])
        if not notes:
            return [(x, b"") for x in found]
        owner, codes = (np.concatenate(x) for x in zip(*notes, strict=True))
        order = np.argsort(owner, kind="stable")
        end = np.cumsum(np.bincount(owner, minlength=n)) * 8
        told = codes[order].tobytes()
        return [(x, told[a:b]) for x, a, b in zip(found, [0, *end[:-1].tolist()], end.tolist(), strict=True)]

    def _merged_rows(self, symbols: list[bytes], keys: np.ndarray | None) -> list[tuple[bytes, bytes]]:
        """The same for words given as bytes of their symbols, those of like length together."""
        size = np.array([len(s) >> 2 for s in symbols], np.int64)
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(symbols)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), ROWS):
            own = order[a:a + ROWS]
            flat = np.frombuffer(b"".join([symbols[i] for i in own.tolist()]), np.int32)
            table = np.full((len(own), int(size[own].max())), -1, np.int32)
            table[np.arange(table.shape[1]) < size[own][:, None]] = flat
            for i, got in zip(own.tolist(), self._merged_table(table, None if keys is None else keys[own]), strict=True):
                out[i] = got
        return out

    def _encode_words(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of words with the keys of their occurrences."""
        which = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(which.__getitem__, words), np.int64, len(words))
        known = self._known(list(which))
        codes_of, ids_of, symbols_of = zip(*known, strict=True) if known else ((), (), ())
        ids = list(map(ids_of.__getitem__, at.tolist()))
        if not self.limit or not words:
            return ids
        codes = np.frombuffer(b"".join(codes_of), np.uint64)
        many = np.fromiter(map(len, codes_of), np.int64, len(known)) >> 3
        first = np.cumsum(many) - many
        own = many[at]
        end = np.cumsum(own)
        asked = codes[np.arange(end[-1]) + np.repeat(first[at] - (end - own), own)]
        hits = np.flatnonzero(_mix_all(np.repeat(keys, own) ^ asked) < np.uint64(self.limit))
        again = np.unique(np.searchsorted(end, hits, "right"))
        plain = np.array([s is not None for s in symbols_of])[at[again]]
        rows = again[plain]
        merged = self._merged_rows(list(map(symbols_of.__getitem__, at[rows].tolist())), keys[rows])
        for i, (new, _) in zip(rows.tolist(), merged, strict=True):
            ids[i] = new
        for i in again[~plain].tolist():
            ids[i] = self._at_once(words[i], int(keys[i]))
        return ids

    def encode_all(self, texts: list[str | None], doc_keys: list[int]) -> list[np.ndarray]:
        """Ids of each text with the key of its document."""
        mark = np.array([self.byte_id[b] for b in MARK.encode()], "<u4").tobytes()
        words: list[str] = []
        keys, plan = [np.zeros(0, np.uint64)], []  # of each text: (first, end) of words, or None for a mark
        for text, doc_key in zip(texts, doc_keys, strict=True):
            own: list[tuple[int, int] | None] = []
            begin = len(words)
            for i, part in enumerate((" " + text).split(MARK) if text else []):
                if i:
                    own.append(None)
                if part:
                    a = len(words)
                    words += [part] if self.joins_words else self.word.findall(part)
                    own.append((a, len(words)))
            plan.append(own)
            key = _mix((self.seed ^ doc_key * 0xA0761D6478BD642F) & _M64)
            number = np.arange(len(words) - begin, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            keys.append(_mix_all(number ^ np.uint64(key)))
        ids = self._encode_words(words, np.concatenate(keys))
        return [np.frombuffer(b"".join([mark if run is None else b"".join(ids[run[0]:run[1]]) for run in own]), "<u4")
                for own in plan]

    def encode(self, text: str | None, doc_key: int = 0) -> np.ndarray:
        return self.encode_all([text], [doc_key])[0]

    def decode(self, ids) -> str:
        """The exact text of ids: without the mark in front."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def encode_decode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 17, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_equal) of every row.

    decoded_equal: the ids decode to the row's text (the empty one for null).
    A null id has the key 0.
    """
    def run(batches):
        for batch in batches:
            coder = Coder.of(model, dropout, seed)
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids = coder.encode_all(texts, [d or 0 for d in docs_])
            size = np.array([len(x) for x in ids], np.int64)
            same = [coder.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
            flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(size), pa.array(same, pa.bool_())],
                                             ["doc_id", "ids", "n_tokens", "decoded_equal"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long, decoded_equal boolean")
