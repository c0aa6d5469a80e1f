"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW`` bytes, forwards and
backwards, and labels every position with a probability for each language; a
document's probabilities are the mean over all positions of its whole text. It
is trained in numpy by backpropagation through time (Adam) on windows drawn
from a bounded sample of labelled documents: ``DOCS`` of each language, those
with the smallest hash of the id, and ``DRAWS`` windows at hashed places of
each text. The sample, at most ``DOCS * DRAWS`` windows a language, is trained
on the driver; the network of some 100 kB goes to the tasks.

Text that is null or has no letter is ``und`` with score 0; so is every text if
there is nothing to learn from. Languages that are null are not learned. Equal
probabilities give the first language by name. Rows with a null id are neither
learned from nor held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WINDOW = 64
HIDDEN = 10
DOCS, DRAWS = 300, 4
#: slices in which the least DOCS rows of a language are found first
SLICES = 256
STEPS, BATCH, RATE = 240, 96, 0.015
#: windows that a task reads at a time
SLAB = 1536
UNKNOWN = "und"
PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the faster tanh."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Network:
    """Input tables (2, 257, 3h), recurrent weights (2, h, 3h), output (2h, k) and its bias.

    Direction 0 reads forwards, 1 backwards; the gates are update, reset, candidate.
    """

    langs: list[str]
    table: np.ndarray
    turn: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        return cls(langs, draw(2, 257, 3 * hidden), draw(2, hidden, 3 * hidden), draw(2 * hidden, len(langs)),
                   np.zeros(len(langs), np.float32))

    def read(self, x: np.ndarray, keep: bool = False, inside: np.ndarray | None = None):
        """States (t, 2, n, h) over windows x (n, t): [t, 1] is the backward state
        after the t-th byte from the end. inside: 1 where x is no padding."""
        n, t = x.shape
        h = self.turn.shape[1]
        states = np.empty((t, 2, n, h), np.float32)
        kept = [np.empty((t, 2, n, h), np.float32) for _ in range(4)] if keep else None
        state = np.zeros((2, n, h), np.float32)
        both = np.stack([x.T, x.T[::-1]], 1)  # (t, 2, n)
        mask = None if inside is None else np.stack([inside.T, inside.T[::-1]], 1)[..., None].astype(np.float32)
        gates = np.empty((2, n, 3 * h), np.float32)
        for i in range(t):
            np.matmul(state, self.turn, out=gates)
            seen = np.stack([self.table[0].take(both[i, 0], 0), self.table[1].take(both[i, 1], 0)])
            zr = _sigmoid(gates[..., :2 * h] + seen[..., :2 * h])
            z, r = zr[..., :h], zr[..., h:]
            hidden = gates[..., 2 * h:]
            c = np.tanh(seen[..., 2 * h:] + r * hidden)
            if keep:
                for a, v in zip(kept, (z, r, c, hidden), strict=True):
                    a[i] = v
            state = c + z * (state - c)
            if mask is not None:
                state *= mask[i]
            states[i] = state
        return states, kept

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (t, n, k) of every position."""
        h = self.turn.shape[1]
        logits = states[:, 0] @ self.out[:h] + states[::-1, 1] @ self.out[h:] + self.bias
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, inside: np.ndarray):
        """Loss (mean cross-entropy of the positions) and its gradients, backwards through time."""
        n, t = x.shape
        h = self.turn.shape[1]
        states, (z, r, c, hidden) = self.read(x, True, inside)
        p = self.positions(states)
        weight = (inside.T / max(inside.sum(), 1)).astype(np.float32)
        loss = -(np.log(p[:, np.arange(n), y] + 1e-9) * weight).sum()
        p[:, np.arange(n), y] -= 1
        p *= weight[..., None]
        d_out = np.concatenate([np.einsum("tnh,tnk->hk", states[:, 0], p),
                                np.einsum("tnh,tnk->hk", states[::-1, 1], p)])
        d_state = np.stack([p @ self.out[:h].T, (p @ self.out[h:].T)[::-1]], 1)
        d_table, d_turn = np.zeros_like(self.table), np.zeros_like(self.turn)
        both = np.stack([x.T, x.T[::-1]], 1)
        mask = np.stack([inside.T, inside.T[::-1]], 1)[..., None].astype(np.float32)
        back = np.zeros((2, n, h), np.float32)
        for i in range(t - 1, -1, -1):
            before = states[i - 1] if i else np.zeros((2, n, h), np.float32)
            d = (d_state[i] + back) * mask[i]
            dz = d * (before - c[i]) * z[i] * (1 - z[i])
            dc = d * (1 - z[i]) * (1 - c[i] ** 2)
            dr = dc * hidden[i] * r[i] * (1 - r[i])
            d_seen = np.concatenate([dz, dr, dc], -1)
            d_gate = np.concatenate([dz, dr, dc * r[i]], -1)
            d_turn += before.transpose(0, 2, 1) @ d_gate
            back = d * z[i] + d_gate @ self.turn.transpose(0, 2, 1)
            for way in (0, 1):
                np.add.at(d_table[way], both[i, way], d_seen[way])
        return loss, (d_table, d_turn, d_out.astype(np.float32), p.sum((0, 1)))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities (documents, k): the mean over all positions of each whole text."""
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        total = np.zeros((len(data), len(self.langs)))
        size = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        first = np.cumsum(size) - size
        windows = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(data)), windows)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = first[doc] + nth * WINDOW
        length = np.minimum(WINDOW, size[doc] - nth * WINDOW)
        whole = length == WINDOW
        for chosen, padded in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
            for at in range(0, len(chosen), SLAB):
                w = chosen[at:at + SLAB]
                index = start[w, None] + np.arange(WINDOW)
                inside = np.arange(WINDOW) < length[w, None] if padded else None
                x = raw[np.minimum(index, len(raw) - 1)].astype(np.intp)
                if padded:
                    x[~inside] = PAD
                p = self.positions(self.read(x, inside=inside)[0])
                if padded:
                    p *= inside.T[..., None]
                np.add.at(total, doc[w], p.sum(0))
        return total / np.maximum(size, 1)[:, None]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded to WINDOW, which of them are no padding)."""
    x = np.full((len(texts), WINDOW), PAD, np.intp)
    for i, t in enumerate(texts):
        b = np.frombuffer(t[:WINDOW], np.uint8)
        x[i, :len(b)] = b
    return x, x != PAD


def fit(texts: list[bytes], langs: list[str], seed: int = 5) -> Network | None:
    """Train on windows and their languages; None without any."""
    names = sorted(set(langs))
    if not names:
        return None
    net = Network.start(names, seed=seed)
    x, inside = windows_of(texts)
    y = np.array([names.index(v) for v in langs])
    rng = np.random.default_rng(seed)
    parts = [net.table, net.turn, net.out, net.bias]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    of = [np.flatnonzero(y == k) for k in range(len(names))]
    for step in range(1, STEPS + 1):
        at = of_each = rng.integers(0, len(names), BATCH)  # every language alike
        at = np.array([rng.choice(of[k]) for k in of_each])
        _, grads = net.gradients(x[at], y[at], inside[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / STEPS)
        for p, g, m, s in zip(parts, grads, mean, square, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, pieces): DRAWS pieces of text of DOCS documents a language, not held out."""
    text, key = F.col(text_col), F.col(id_col)
    room = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    pieces = F.array(*[F.substring(text, (F.pmod(F.xxhash64(key, F.lit(k)), room) + 1).cast("int"), F.lit(WINDOW))
                       for k in range(DRAWS)])
    rows = (docs.filter(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}") & (remainder(key) != 1))
            .select(F.col(lang_col).alias("lang"), F.xxhash64(key).alias("place"), pieces.alias("pieces"))
            .withColumn("slice", F.spark_partition_id() % SLICES))
    # the first DOCS of every slice hold the first DOCS of the language
    for by in (["lang", "slice"], ["lang"]):
        own = F.row_number().over(W.partitionBy(*by).orderBy("place", "pieces"))
        rows = rows.withColumn("own", own).filter(F.col("own") <= DOCS)
    return rows.select("lang", "place", "pieces")


def train(docs: DataFrame, **columns: str) -> Network | None:
    rows = sorted(((r.lang, r.place, p) for r in sample(docs, **columns).collect() for p in r.pieces))
    return fit([p.encode() for _, _, p in rows], [lang for lang, _, _ in rows])


FIELDS = "lang_pred string, score double"


def language(text: Column, net: Network | None) -> Column:
    """Struct column of ``FIELDS`` for a text column."""
    def run(texts: pd.Series) -> pd.DataFrame:
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if net is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
        p = net.predict([t if ok else "" for t, ok in zip(texts, lettered, strict=True)])
        best = p.argmax(1)
        return pd.DataFrame({
            "lang_pred": [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)],
            "score": np.clip(np.where(lettered, p.max(1), 0.0), 0, 1)})

    return F.pandas_udf(run, FIELDS)(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    net = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return (docs.select(F.col(id_col).alias("doc_id"),
                        F.coalesce(remainder(F.col(id_col)) == 1, F.lit(False)).alias("held_out"),
                        language(F.col(text_col), net).alias("r"))
            .select("doc_id", "held_out", "r.lang_pred", "r.score"))
