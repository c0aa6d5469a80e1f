"""Token ids of whole texts with a public tokenizer file, many texts at a time.

A tokenizer splits a text into pieces and encodes each piece by itself, so the
ids of a piece that was met before can be used again. For texts of printable
ASCII without apostrophes, line feeds and Latin-1 letters, numpy finds the
pieces of a whole batch of texts on their bytes and hashes them; only pieces
new to this worker go to the tokenizers library's model. Any other text is
encoded whole by the library. Both ways give the ids of
``Tokenizer.encode(text, add_special_tokens=False)``.

A worker keeps the ids of up to two generations of ``KEEP`` pieces. Pieces over
``LONG_PIECE`` bytes are never kept.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd

from redactum.llm.repetition import word_hashes

KEEP = 250_000
LONG_PIECE = 64
_UNUSUAL = re.compile("[^ -&(-~\nÀ-ÖØ-öø-ÿ]|<\\|")
_ENCODERS: dict[str, Encoder] = {}

SPACE, LINE, LETTER, DIGIT, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[32], _KIND[10] = SPACE, LINE
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = LETTER


def byte_symbols() -> str:
    """The printable stand-in of every byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the rest for U+0100 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


def _lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and, behind byte C3, of Latin-1 capitals."""
    up = (raw >= 65) & (raw <= 90)
    up[1:] |= (raw[:-1] == 0xC3) & (raw[1:] <= 0x9E)
    return raw + (up * np.uint8(32))


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.drops_space = json.load(f)["model"]["end_of_word_suffix"] is not None
        self.symbols = byte_symbols()
        self.now: dict[int, bytes] = {}
        self.before: dict[int, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker for a tokenizer file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: bytes) -> bytes:
        word = piece.decode("latin-1").translate(self.symbols)
        return np.asarray([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def _pieces(self, raw: np.ndarray, first: np.ndarray):
        """Start and end of the pieces of texts laid end to end; first: their first bytes."""
        kind = _KIND[raw]
        space = kind <= LINE
        cut = np.ones(len(raw) + 1, bool)
        a, b = kind[:-1], kind[1:]
        if self.drops_space:
            cut[1:-1] = (a != b) | (b == DIGIT)
        else:
            last = np.ones(len(raw), bool)  # no visible character follows in this text
            last[:-1] = space[1:]
            last[first[1:] - 1] = True
            both = space[:-1] & space[1:]
            cut[1:-1] = np.where(both, ~last[1:], (a != b) & (a != SPACE))
        cut[first] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        if self.drops_space:
            seen = ~space[start]
            start, end = start[seen], end[seen]
        return start, end

    def _common(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that hold common characters only, none of them empty."""
        data = [t.encode() for t in texts]
        stop = np.cumsum([len(d) for d in data])
        first = np.concatenate([[0], stop[:-1]])
        raw = np.frombuffer(b"".join(data), np.uint8)
        if self.drops_space:
            raw = _lowered(raw)
        start, end = self._pieces(raw, first)
        if not len(start):
            return [np.zeros(0, "<u4")] * len(texts)
        which, keys = pd.factorize(word_hashes(raw, start, end))
        where = np.full(len(keys), -1)
        where[which[::-1]] = np.arange(len(which))[::-1]  # the first piece of each key
        now, before, memory, ids = self.now, self.before, raw.tobytes(), []
        for key, s, e in zip(keys.tolist(), start[where].tolist(), end[where].tolist(), strict=True):
            got = now.get(key)
            if got is None:
                got = before.get(key)
                if got is None:
                    got = self._piece(memory[s:e])
                if e - s <= LONG_PIECE:
                    now[key] = got
            ids.append(got)
        if len(now) > KEEP:
            self.before, self.now = now, {}
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(size) - size
        many = size[which]
        total = np.cumsum(many)
        out = flat[np.arange(total[-1]) + np.repeat(begin[which] - (total - many), many)]
        upto = np.concatenate([[0], total])[np.searchsorted(start, np.concatenate([[0], stop]))]
        return [out[upto[i]:upto[i + 1]] for i in range(len(texts))]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (little-endian unsigned 32-bit integers) of each text; none for null."""
        out = [np.zeros(0, "<u4")] * len(texts)
        common, rest = [], []
        for i, t in enumerate(texts):
            if t:
                (rest if _UNUSUAL.search(t) else common).append(i)
        for at, ids in ((common, self._common([texts[i] for i in common]) if common else []),
                        (rest, self.whole([texts[i] for i in rest]) if rest else [])):
            for i, x in zip(at, ids, strict=True):
                out[i] = x
        return out


def default_path(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
