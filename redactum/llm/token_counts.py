"""Token counts of whole texts with a public tokenizer file; no ids leave a task.

Every Arrow batch is encoded by the file's library (sentencepiece for .model,
tokenizers for .json) and only lengths come back. A sentencepiece text over
``PART_CHARS`` characters is split where no merge can cross: between two
characters that stand side by side in no piece of the vocabulary (a space counts
as the word mark). What follows a cut is encoded behind a character that no piece
holds, and the tokens of that character and of the mark in front are taken off
again, so the sum is the count of the whole text. A stretch without such a place
stays in one part, however long. The parts of all texts of a batch go to the
library in calls of about ``CALL_BYTES``, so neither one long text nor many short
ones decide how much it holds at a time.

Texts are split only if the model's normalizer leaves characters as they are;
other models and tokenizers get whole texts. Null and empty texts have no tokens
and no bytes; rows that repeat are counted each; null ids keep their rows.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PART_CHARS = 4096
CALL_BYTES = 1 << 20
LIMIT = 4096
#: what a normalizer that leaves characters alone gives back, with marks for spaces
_PROBE = " a  ﬁ½\t́É "
_COUNTERS: dict[str, PieceCounter | WordCounter] = {}


def balanced(parts: list[str], most: int) -> list[tuple[int, int]]:
    """(first, end) of runs of parts of at most ``most`` bytes, or one part."""
    size = np.cumsum([0, *(len(p.encode("utf-8", "surrogatepass")) for p in parts)])
    out, first = [], 0
    while first < len(parts):
        end = max(first + 1, int(np.searchsorted(size, size[first] + most, "right")) - 1)
        out.append((first, end))
        first = end
    return out


class PieceCounter:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str, part_chars: int = PART_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.part_chars = part_chars
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_byte(i)]
        known = set("".join(pieces))
        #: pairs of neighbours inside a piece: a merge may cross them
        self.inside = {p[k:k + 2].replace(MARK, " ") for p in pieces for k in range(len(p) - 1)}
        self.fence = next((c for c in "\n\x00\x01\x02" if c not in known), None)
        self.splits = self.fence is not None and self.model.normalize(_PROBE).lstrip(MARK) == _PROBE.replace(" ", MARK).lstrip(MARK)
        self.extra = len(self.model.encode(self.fence)) if self.splits else 0

    def cut(self, text: str) -> list[str]:
        """Parts of a text; all but the first begin with the fence."""
        parts, start = [], 0
        while len(text) - start > self.part_chars:
            at = start + self.part_chars
            while at < len(text) and text[at - 1:at + 1].replace(MARK, " ") in self.inside:
                at += 1
            if at >= len(text):
                break
            parts.append(text[start:at])
            start = at
        parts.append(text[start:])
        return [parts[0], *(self.fence + p for p in parts[1:])]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        parts, owner = [], []
        for i, text in enumerate(texts):
            if text:
                own = self.cut(text) if self.splits else [text]
                parts += own
                owner += [i] * len(own)
        lengths: list[int] = []
        for a, b in balanced(parts, CALL_BYTES):
            lengths += map(len, self.model.encode(parts[a:b], num_threads=1))
        owner = np.array(owner, np.int64)
        later = np.zeros(len(owner), bool)
        later[1:] = owner[1:] == owner[:-1]
        return np.bincount(owner, np.array(lengths) - self.extra * later, len(texts)).astype(np.int64)


class WordCounter:
    """Counts of a tokenizers file; texts are never cut."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str | None]) -> np.ndarray:
        whole, lengths = [t or "" for t in texts], []
        for a, b in balanced(whole, CALL_BYTES):
            lengths += (len(e.ids) for e in self.model.encode_batch_fast(whole[a:b], add_special_tokens=False))
        return np.array(lengths, np.int64)


def counter(path: str) -> PieceCounter | WordCounter:
    """The counter of this worker for a tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path) if re.search(r"\.model$", path) else WordCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    def run(batches):
        for batch in batches:
            many = counter(tokenizer).counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(many)],
                                             ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
