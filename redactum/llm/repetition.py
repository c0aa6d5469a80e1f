"""Quality rules by repetition coverage.

Every text is read as UTF-8 bytes in numpy. Words are runs of bytes other than
space and ``\\x09-\\x0D``. Each word gets a 64-bit hash of its bytes, and a
polynomial prefix hash over the words gives the rolling hash of every window of
``n`` words for all lengths at once. Windows whose hash
occurs twice or more in the text are duplicated; the words under them, and the
characters of those words, are covered (the first occurrence included).

A document is rejected if it fails the base rule (fewer than ``MIN_WORDS``
words, or more than 30 % of its words in repeated 8-word windows), or if the
characters covered for one of ``LIMITS`` n-gram lengths, or those of repeated
lines, pass a share of its word characters.

Null and blank texts count as no words and fail the base rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30
#: words of an n-gram -> largest share of word characters inside duplicated n-grams
LIMITS = {5: 0.50, 13: 0.25}
#: largest share of word characters in lines equal to an earlier line
LINE_LIMIT = 0.30

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_chars long, "
          + ", ".join(f"dup_{n}gram_chars long" for n in LIMITS))

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: masks of the first 0 to 8 bytes of a little-endian number
_LOW_BYTES = np.array([2**(8 * n) - 1 for n in range(9)], np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 14)
            for name, base in (("up", _STEP), ("down", _BACK)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls.up, cls.down


def _prefix(values: np.ndarray) -> np.ndarray:
    up, _ = _Powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray):
    """First and end byte of every word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: its stretches of 8 bytes, each mixed with its
    number, added up and mixed with the length. (A polynomial of the bytes
    modulo 2**64 has equal values for whole families of long words.)"""
    size = end - start
    many = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(many) - many
    nth = np.arange(int(many.sum())) - np.repeat(first, many)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    left = np.minimum(np.repeat(size, many) - 8 * nth, 8)
    value = eight[np.repeat(start, many) + 8 * nth] & _LOW_BYTES[left]
    mixed = _mix(value + (nth + 1).astype(np.uint64) * np.uint64(_STEP))
    total = np.add.reduceat(mixed, first) if len(first) else mixed
    return _mix(total + size.astype(np.uint64))


def window_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every window of n words from the words' prefix hash."""
    many = len(prefix) - n
    _, down = _Powers.get(len(prefix))
    return _mix((prefix[n:] - prefix[:many]) * down[:many])


def covered_words(hashes: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in a window whose hash occurs at least twice."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.zeros(n_words, bool)
    twice = np.zeros(len(hashes), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    step = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(twice)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[:-1]) > 0


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines holding a word and equal to an earlier line, and their word characters."""
    seen, count, chars = set(), 0, 0
    for line in text.split("\n"):
        if line in seen:
            count += 1
            chars += sum(not c.isascii() or not _SPACE[ord(c)] for c in line)
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return count, chars


def measure(text: str | None) -> tuple:
    """The fields of one text, in the order of ``FIELDS``."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, end = word_spans(raw)
    n = len(start)
    letter = ((raw & 0xC0) != 0x80) & ~_SPACE[raw]
    up_to = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(letter, out=up_to[1:])
    word_chars = up_to[end] - up_to[start]
    total = int(up_to[-1])
    lines, line_chars = repeated_lines(text)
    prefix = _prefix(word_hashes(raw, start, end)) if n else np.zeros(1, np.uint64)
    cover = {k: covered_words(window_hashes(prefix, k), k, n) if n >= k else np.zeros(n, bool)
             for k in {BASE_WINDOW, *LIMITS}}
    repeat = int(cover[BASE_WINDOW].sum())
    inside = {k: int(word_chars[cover[k]].sum()) for k in LIMITS}
    failed = n < MIN_WORDS or 100 * repeat > BASE_PERCENT * n
    kept = not failed and line_chars <= LINE_LIMIT * total and all(inside[k] <= LIMITS[k] * total for k in LIMITS)
    return (n, total, int(_SYMBOL[raw].sum()), lines, repeat, failed, kept, line_chars, *inside.values())


_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _measure_all(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=_NAMES)


def repetition(text: Column | str) -> Column:
    """Struct column of ``FIELDS`` for a text column."""
    return F.pandas_udf(_measure_all, FIELDS)(text)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fields) of every row; repeated rows are measured each."""
    return (docs.select(F.col(id_col).alias("doc_id"), repetition(F.col(text_col)).alias("m"))
            .select("doc_id", "m.*"))
