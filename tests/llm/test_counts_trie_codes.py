"""Token counts, conversation trie and vector codes against brute force, and on awkward rows."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from redactum.llm import prefix_trie, token_counts, vector_codes  # noqa: E402
from redactum.llm.common import prepare  # noqa: E402
from redactum.llm.queries import ORACLES, op12_prefix_trie, op13_vector_codes  # noqa: E402
from redactum.llm.tokens import default_path  # noqa: E402

MODEL = default_path("piece_bpe_32k.model")
CLASHES = {c: F.lit("x") for c in ("n", "k", "key", "part", "parent", "code", "v", "node", "depth", "slice")}


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- token counts ------------------------------------------------------------------

def test_counts_of_split_texts_equal_the_library():
    model = token_counts.counter(MODEL).model
    rng = random.Random(1)
    chars = list("aaabtheing  \n\t▁.,éß中ﬁ\x00😀1234<s>/")
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 200))) for _ in range(800)]
    texts += [None, "", " ", "  ", "\n", "the " * 300, "a" * 900, "▁" * 30, "x" + " " * 500 + "y"]
    want = [len(model.encode(t or "")) for t in texts]
    for part in (1, 2, 7, 50, 10_000):
        assert token_counts.PieceCounter(MODEL, part).counts(texts).tolist() == want
    assert token_counts.PieceCounter(MODEL).splits


def test_balanced_calls():
    assert token_counts.balanced(["aa", "b", "c", "ddddd", "é"], 3) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert token_counts.balanced([], 3) == []


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_count_query(spark, name):
    prepare(spark)
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30000), (5, "same"), (5, "same"), (None, "x"), (8, "é\x00 <|endoftext|> </s>")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns(CLASHES)
    if name.endswith(".model"):
        count = lambda t: len(token_counts.counter(MODEL).model.encode(t))
    else:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(default_path(name))
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = Counter((d, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for d, t in data)
    assert Counter(rows(token_counts.token_counts(df, default_path(name)))) == want
    assert token_counts.token_counts(df.limit(0), default_path(name)).count() == 0


# -- conversation trie ---------------------------------------------------------------

def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    members, children = defaultdict(list), Counter()
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if whole[c] == p)))
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def awkward_turns():
    rng = random.Random(3)
    turns = []
    for c in range(-12, 60):
        if c % 7 != 3:
            for t in range(rng.choice([1, 2, 5, 9, 12, 30])):
                turns.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "a", None]), rng.choice(["x", "y", "", "é", None])))
    copy = [(t, "user", f"long {t}") for t in range(10)]
    turns += [(c, *x) for c in range(100, 160) for x in copy]  # one very common conversation
    return turns + turns[:50] + [(None, 1, "u", "t")]


def test_trie_equals_brute_force(spark):
    turns = awkward_turns()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns(CLASHES)
    got = prefix_trie.conversation_trie(spark, df, block=4, chunk=64, final=40, slice_rows=16)
    assert Counter(rows(got)) == brute_trie(turns)
    assert prefix_trie.conversation_trie(spark, df.limit(0)).count() == 0


def test_trie_of_one_long_conversation_and_of_turnless_ones(spark):
    turns = [(0, t, "u", str(t % 3)) for t in range(700)]
    turns += [(c, 0, "u", "short") for c in range(7, 30) if c % 5]  # own turns all before h, no family head
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = prefix_trie.conversation_trie(spark, df, block=64, chunk=100, final=8, slice_rows=100)
    want = brute_trie(turns)
    assert Counter(rows(got)) == want and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)


def test_one_hash_over_many_pieces(spark):
    ids = [(b"k", c) for c in range(-40, 2000, 3)] + [(b"m", 5)]
    df = spark.createDataFrame(ids, "key binary, conv_id long")
    got = {bytes(r.key): r.ends_sha256 for r in prefix_trie.ends_digests(spark, df.repartition(7), most=50).collect()}
    want = ",".join(str(c) for k, c in ids if k == b"k")
    assert got == {b"k": hashlib.sha256(want.encode()).hexdigest(), b"m": hashlib.sha256(b"5").hexdigest()}


def test_runs_of_a_chunk():
    head, offset, end = prefix_trie.runs_of(np.array([5, 9, 2, 7]), np.array([2, 30, 9, -1]))
    assert head.tolist() == [5, 5, 5, 7] and offset.tolist() == [0, 2, 1, 0] and end.tolist() == [False, True, False, True]


# -- vector codes ----------------------------------------------------------------------

def brute_codes(data, parts, entries, rounds):
    """Lloyd with full scans in Python's whole numbers."""
    kept = [(i, lab, [math.floor(256 * x) if abs(x) < 2**50 else 256 * int(x) for x in v]) for i, lab, v in data
            if v is not None and all(x is not None and math.isfinite(x) for x in v) and v and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for turn in range(rounds + 1):
        found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    error = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, error, strict=True):
        by_label[r[1]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return Counter((r[0], "".join(f"{e:02x}" for _, e in f), err, by_label[r[1]], sha)
                   for r, f, err in zip(kept, found, error, strict=True))


@pytest.mark.parametrize("large", [1.0, 1e7])
def test_codes_equal_brute_force(spark, large):
    rng = np.random.default_rng(4)
    data = [(i, int(rng.integers(0, 3)) if i % 9 else None, [float(x) for x in rng.integers(-6, 7, 4) / 16 * large])
            for i in range(120)]
    data += [(500, 1, None), (501, 1, [None, 1.0, 1.0, 1.0]), (502, 1, [float("nan")] * 4), (503, 1, [float("inf")] * 4),
             (504, 1, []), (505, 1, [1.0] * 3), (506, 1, [1.0] * 8), (None, 1, [0.5] * 4), data[7], data[7]]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").withColumns(CLASHES)
    got = vector_codes.encode(spark, df, parts=2, entries=8)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(rows(got)) == brute_codes(data, 2, 8, 2)
    assert vector_codes.encode(spark, df.limit(0)).count() == 0


def test_too_few_and_too_large_vectors(spark):
    df = spark.createDataFrame([(3, "a", [0.5, 0.25]), (1, None, [-0.5, 0.1])], "vec_id long, label string, embedding array<double>")
    assert Counter(rows(vector_codes.encode(spark, df, parts=2))) == brute_codes(rows(df.select("vec_id", "label", "embedding")), 2, 64, 2)
    wide = spark.createDataFrame([(1, None, [1e300, 0.0])], "vec_id long, label string, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode(spark, wide, parts=2).collect()


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x, book = rng.integers(-3, 4, (40, 2)), rng.integers(-3, 4, (6, 2))
        code, distance = vector_codes.assign(x, book)
        new = np.where(rng.random((6, 1)) < 0.4, rng.integers(-3, 4, (6, 2)), book)
        got = vector_codes.assign(x, new, code, distance, (new != book).any(1))
        want = vector_codes.assign(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize("query", [op12_prefix_trie, op13_vector_codes])
def test_queries_equal_their_sql(spark, query):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    con.execute(ORACLES[query.__name__])
    names = [d[0] for d in con.description]
    assert Counter(rows(got.select(*names))) == Counter(con.fetchall())
