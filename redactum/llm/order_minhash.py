"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are runs of bytes other than space and ``\\x09-\\x0D`` of the lower-cased
text. Documents with the same words are one class from the start: all later
work is on classes, one row for each different text.

Sketch: every window of ``K`` words is a k-mer, labelled with its occurrence
number in the text. For each of ``SKETCHES`` seeds the ``PICKS`` labelled k-mers
with the least hash are taken and hashed together in the order of the text. Two
texts agree on a seed with a chance that follows their edit similarity, and
texts that agree on a seed share a bucket.

Links: in a bucket of up to ``SMALL`` texts every pair is a candidate. In a
larger one each text is paired with the bucket's first one. Candidates are verified by word edit distance in
a band: linked if at most ``1 - LEAST`` of the longer text's words are edits.
Large buckets whose texts are then not all linked are searched exactly: two of
their texts that are similar share some of each one's rarest words (a prefix
filter, see ``rare_words``), and those that do, share a bucket and are not
linked yet are verified too, the most alike first. So every two texts that share
a bucket are compared, linked already or can't be similar, however many others
share it.
Classes are the connected components of the links.

Texts shorter than ``K`` words have one k-mer. Null texts and texts without a
word are a class each. Rows that repeat are members of one class. A class is
named by its least doc_id (null if none has any).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm.common import prepare, stored, temp_name
from redactum.llm.repetition import _mix, _prefix, window_hashes, word_hashes, word_spans

K = 5
LEAST = 0.8
SKETCHES, PICKS = 24, 2
SMALL = 8
#: most shared rare words asked of a pair, buckets of a text that order its words, pairs a text that are aligned at once
NEEDED, CROWDS, WAVE = 8, 4, 4
#: cells of the seed-by-window table computed at once
CELLS = 1 << 21
_SEEDS = np.random.default_rng(11).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_MAX = np.uint64(2**64 - 1)
SKETCH_FIELDS = "key binary, n_words int, sketch array<long>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def labelled_kmers(raw: np.ndarray) -> np.ndarray:
    """Hash of every window of K words and its occurrence number, in text order."""
    start, end = word_spans(raw)
    prefix = _prefix(word_hashes(raw, start, end))
    return labelled(window_hashes(prefix, min(K, len(start))))


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes mixed with the number of their occurrence, in the same order."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return _mix(grams)
    at = np.flatnonzero(new)
    nth = np.empty(len(grams), np.uint64)
    nth[order] = (np.arange(len(grams)) - np.repeat(at, np.diff(np.append(at, len(grams))))).astype(np.uint64)
    return _mix(grams + nth * np.uint64(0xD6E8FEB86659FD93))


def order_sketch(kmers: np.ndarray) -> np.ndarray:
    """One value a seed: its PICKS least k-mers hashed in text order."""
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, CELLS // max(len(kmers), 1))
    for a in range(0, SKETCHES, step):
        table = kmers * _SEEDS[a:a + step, None]
        table ^= table >> np.uint64(32)
        row = np.arange(len(table))
        picks = []
        for _ in range(min(PICKS, len(kmers))):
            at = table.argmin(1)
            picks.append(at)
            table[row, at] = _MAX
        value = _mix(_SEEDS[a:a + step])
        for at in np.sort(np.stack(picks), 0):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + kmers[at])
        out[a:a + step] = value
    return out


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketch(text: str | None):
    """(digest of the words, word count, sketch), nulls without a word."""
    words = words_of(text)
    if not words:
        return None, 0, None
    data = b" ".join(words)
    kmers = labelled_kmers(np.frombuffer(data, np.uint8))
    return digest(words), len(words), order_sketch(kmers).view(np.int64)


def key_column(text: Column) -> Column:
    """The digest alone."""
    def run(texts: pd.Series) -> pd.Series:
        found = map(words_of, texts)
        return pd.Series([digest(w) if w else None for w in found], dtype=object)

    return F.pandas_udf(run, "binary")(text)


def sketch_column(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t) for t in texts], columns=["key", "n_words", "sketch"])

    return F.pandas_udf(run, SKETCH_FIELDS)(text)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences in a band of ``most`` diagonals to either
    side; any number above ``most`` if it is larger than that.

    The band's column is kept as bits (p for row j - most + p): vertical steps
    up and down, from which the next column follows by a few whole-number
    operations. The distance is followed down the band's lower edge and then
    along the last row.
    """
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head:n - tail], b[head:m - tail]
    n, m = len(a), len(b)
    if abs(n - m) > most or not n or not m:
        return max(n, m)
    most = min(most, max(n, m))
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | (1 << i)
    mask = (1 << (2 * most + 1)) - 1
    up = mask ^ ((1 << most) - 1)  # the first column rises by one a row
    down = 0
    dist, edge = min(most, n), 1 << (2 * most)
    for j in range(1, m + 1):
        shift = j - most - 1
        match = rows.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & mask
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right = (down | ~(diagonal | up)) & mask
        left = diagonal & up
        if j + most <= n:
            dist += not diagonal & edge
        else:
            last = n - j + most
            dist += (right >> last & 1) - (left >> last & 1)
            if dist - (m - j) > most:
                return most + 1
        up, down = (left | ~((diagonal >> 1) | right)) & mask, (diagonal >> 1) & right
    return dist


def similar(a: str, b: str, least: float = LEAST) -> bool:
    """Whether at most 1 - least of the longer text's words are edits."""
    return similar_words(words_of(a), words_of(b), least)


def similar_words(x: list[bytes], y: list[bytes], least: float = LEAST) -> bool:
    longest = max(len(x), len(y))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(x) - len(y)) > most or longest - sum((Counter(x) & Counter(y)).values()) > most:
        return False
    return banded_distance(x, y, most) <= most


def candidates(spark: SparkSession, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, from classes(c, n_words, sketch), and the
    members (bucket, c, n_words) of the large buckets."""
    members = classes.select("c", "n_words", F.posexplode("sketch").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "c", "n_words")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("many"), F.min("c").alias("first")).filter("many > 1")
    shared = stored(spark, members.join(sizes, "bucket"), "buckets")
    small = (shared.filter(F.col("many") <= SMALL).groupBy("bucket")
             .agg(F.sort_array(F.collect_list(F.struct("c", "n_words"))).alias("all")))
    each = small.select(F.posexplode("all").alias("i", "a"), "all")
    every = each.select("a", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("b"))
    fits = F.least("a.n_words", "b.n_words") >= F.lit(LEAST) * F.greatest("a.n_words", "b.n_words") - 1e-6
    large = shared.filter(F.col("many") > SMALL)
    pairs = every.filter(fits).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).unionByName(
        large.filter(F.col("c") != F.col("first")).select(F.col("first").alias("a"), F.col("c").alias("b")))
    return pairs.distinct(), large.select("bucket", "c", "n_words")


def word_marks(text: Column) -> Column:
    """64-bit hashes of every word of a text with its occurrence number."""
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            raw = np.frombuffer(b" ".join(words_of(text)), np.uint8)
            out.append(labelled(word_hashes(raw, *word_spans(raw))).view(np.int64))
        return pd.Series(out)

    return F.pandas_udf(run, "array<long>")(text)


def rare_words(spark: SparkSession, texts: DataFrame, least: float) -> DataFrame:
    """(c, rare): the rarest words of texts(c, n_words, crowd, text), ``needed_words`` of which any
    two similar texts share.

    Similar texts of n words share all but (1 - least) n of the longer one's
    labelled words, so in any order of all words the first k that they share are
    among each one's first (1 - least) n + k. The order only decides how many
    others share them: first come words with few meetings in the buckets of
    ``crowd``, so that a passage that makes a bucket comes last in it, however
    rare it is elsewhere. Words that only one text holds take their places but
    are not returned.
    """
    marks = stored(spark, texts.select("c", "n_words", "crowd", word_marks(F.col("text")).alias("words")), "marks")
    met = (marks.select("c", "crowd", F.explode("words").alias("word"))
           .select("c", "word", F.explode("crowd").alias("bucket")).groupBy("word", "bucket")
           .agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")))
    counts = stored(spark, met.groupBy("word").agg(F.sum(F.col("n") * F.col("n")).alias("meetings"), F.min("lo").alias("lo"),
                                                   F.max("hi").alias("hi"))
                    .filter("lo < hi").select("word", "meetings"), "mark-counts")
    ranked = (marks.select("c", "n_words", F.explode("words").alias("word")).join(counts, "word", "left")
              .groupBy("c", "n_words")
              .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("meetings", F.lit(0)).alias("meetings"), "word"))).alias("all")))
    first = F.floor((1 - least) * F.col("n_words") + 1e-9).cast("int") + needed_words(F.col("n_words"), least)
    rare = F.filter(F.slice("all", F.lit(1), first), lambda x: x["meetings"] > 0)
    return ranked.select("c", F.transform(rare, lambda x: x["word"]).alias("rare"))


def needed_words(n_words: Column, least: float) -> Column:
    """How many of its rarest words a text shares with any similar one at least as long."""
    return F.least(F.lit(NEEDED), F.floor(least * n_words / (2 * NEEDED)).cast("int") + 1)


def crowded_links(spark: SparkSession, crowded: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of the large buckets that join all similar texts whose labels(c, label) differ.

    Of the texts of buckets that hold several labels, pairs are met on their
    rare words: of each word's texts those outside its most frequent label meet
    all of another label, so copies that are linked already never meet. A pair
    that fits in length, shares such a bucket and enough rare words is aligned.
    Only ids, sizes and buckets (one a seed at most) travel until then.
    """
    members = crowded.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    mixed = stored(spark, members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
                   .filter("lo < hi").select("bucket", "size"), "mixed-buckets")
    place = F.sort_array(F.collect_set(F.struct("size", "bucket")), False)
    asked = stored(spark, members.join(mixed, "bucket").groupBy("c", "label", "n_words").agg(place.alias("p"))
                   .select("c", "label", "n_words", F.col("p.bucket").alias("buckets")), "mixed-texts")
    rare = rare_words(spark, asked.select("c", "n_words", F.slice("buckets", 1, CROWDS).alias("crowd")).join(texts, "c"), least)
    held = stored(spark, rare.join(asked, "c").select(F.explode("rare").alias("word"), "c", "label", "n_words", "buckets"), "rare-words")
    kinds = held.groupBy("word", "label").agg(F.count("*").alias("many")).groupBy("word").agg(
        F.max_by("label", "many").alias("most"), F.count("*").alias("kinds"))
    few = held.join(kinds.filter("kinds > 1"), "word").filter("label != most")
    side = lambda rows, k, *more: rows.select("word", *more, *[F.col(c).alias(f"{c}_{k}") for c in ("c", "label", "n_words", "buckets")])
    fits = F.least("n_words_a", "n_words_b") >= F.lit(least) * F.greatest("n_words_a", "n_words_b") - 1e-6
    once = (F.col("label_b") == F.col("most")) | (F.col("c_a") < F.col("c_b"))  # a word counts a pair once
    meets = (F.col("label_a") != F.col("label_b")) & once & fits & F.arrays_overlap("buckets_a", "buckets_b")
    one = lambda k: F.struct(*[F.col(f"{c}_{k}").alias(c) for c in ("c", "label", "n_words")])
    pairs = side(few, "a", "most").join(side(held, "b"), "word").filter(meets).select(
        F.least(one("a"), one("b")).alias("a"), F.greatest(one("a"), one("b")).alias("b")).groupBy("a", "b").agg(
        F.count("*").alias("shared"))
    enough = F.col("shared") >= needed_words(F.least("a.n_words", "b.n_words"), least)
    pairs = pairs.filter(enough).select(F.col("a.c").alias("a"), F.col("b.c").alias("b"), F.col("a.label").alias("label_a"),
                                        F.col("b.label").alias("label_b"),
                                        (F.col("shared") / F.greatest("a.n_words", "b.n_words")).alias("shared"))
    return joining_links(spark, stored(spark, pairs, "rare-pairs"), texts, least)


def joining_links(spark: SparkSession, pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of pairs(a, b, label_a, label_b, shared) that join every two similar ones.

    While there are many pairs for each text, only the one in which it shares
    most is aligned; pairs whose labels the links found join need no alignment.
    When this no longer halves the pairs, all that are left are aligned.
    """
    found, many = [], pairs.count()
    while many:
        ends = pairs.select("a", "b", "label_a", "label_b", "shared", F.explode(F.array("a", "b")).alias("c"))
        best = stored(spark, ends.groupBy("c").agg(F.max(F.struct("shared", "a", "b", "label_a", "label_b")).alias("x"))
                      .select("x.a", "x.b", "x.label_a", "x.label_b").distinct(), "best-pairs")
        if many <= WAVE * best.count():
            break
        links = stored(spark, verified(best.select("a", "b"), texts, least), "best-links")
        found.append(links)
        joined = components(spark, links.join(best, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        pairs = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti")
        for k in ("label_a", "label_b"):
            pairs = (pairs.join(joined.select(F.col("c").alias(k), F.col("label").alias("to")), k, "left")
                     .withColumn(k, F.coalesce("to", k)).drop("to"))
        pairs = stored(spark, pairs.filter("label_a != label_b"), "pairs-left")
        before, many = many, pairs.count()
        if 2 * many > before:
            break
    last = verified(pairs.select("a", "b"), texts, least)
    return reduce(DataFrame.unionByName, found, last)


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose texts(c, text) are similar."""
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, least) for x, y in zip(a, b, strict=True)], dtype=bool)

    near = F.pandas_udf(check, "boolean")
    of = lambda k: texts.select(F.col("c").alias(k), F.col("text").alias(f"text_{k}"))
    return (pairs.join(of("a"), "a").join(of("b"), "b")
            .filter(near("text_a", "text_b")).select("a", "b"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(c, label): one number for each linked set, for all numbers in links(a, b).

    Every round points each number to the least of its neighbours and itself,
    follows the pointers to their roots, and keeps the links between different
    roots; a large family is one root after the first round. Pointers and links
    are written tables.
    """
    rounds = []
    while True:
        ends = links.select(F.col("a").alias("c"), F.col("b").alias("to")).unionByName(
            links.select(F.col("b").alias("c"), F.col("a").alias("to")))
        to = stored(spark, ends.groupBy("c").agg(F.min("to").alias("to")).select("c", F.least("c", "to").alias("to"),
                                                                                 F.lit(True).alias("new")), "pointers")
        while to.filter("new").limit(1).count():
            far = to.select(F.col("c").alias("to"), F.col("to").alias("far"))
            to = stored(spark, to.drop("new").join(far, "to").select(
                "c", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("new")), "pointers")
        rounds.append(to.drop("new"))
        root = lambda k: to.select(F.col("c").alias(k), F.col("to").alias(f"{k}_root"))  # noqa: B023, E731
        ends = links.join(root("a"), "a").join(root("b"), "b").filter("a_root != b_root")
        links = stored(spark, ends.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
                       .distinct(), "links")
        if not links.limit(1).count():
            break
    labels = rounds[0].withColumnRenamed("to", "label")
    for later in rounds[1:]:
        later = later.select(F.col("c").alias("label"), "to")
        labels = labels.join(later, "label", "left").select("c", F.coalesce("to", "label").alias("label"))
    return labels


def classes_of(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, least: float):
    """(rows, texts): rows(doc_id, key) of docs; texts(key, least_id, many, label, class_id),
    one row for each different text; many rows hold its least_id."""
    prepare(spark)
    ids = F.col(id_col).cast("long")
    rows = stored(spark, docs.select(ids.alias("doc_id"), sketch_column(F.col(text_col)).alias("s"))
                  .select("doc_id", "s.*"), "sketches")
    same = (rows.filter("key IS NOT NULL").groupBy("key", "doc_id")
            .agg(F.count("*").alias("many"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
            .groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "many")).alias("l"),
                                F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch")))
    first = stored(spark, same.select("key", F.col("l.doc_id").alias("least_id"), F.col("l.many").alias("many"),
                                      "n_words", "sketch", F.monotonically_increasing_id().alias("c")), "texts")
    pairs, crowded = candidates(spark, first)
    pairs = stored(spark, pairs, "candidates")
    asked = (pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
             .join(first.select("c", "key", "least_id"), "c"))
    slim = docs.select(ids.alias("doc_id"), F.col(text_col).alias("text"))
    texts = with_key(slim, "doc_id", "text", asked).select("c", "text")
    texts = stored(spark, texts.groupBy("c").agg(F.first("text").alias("text")), "asked-texts")
    near = stored(spark, verified(pairs, texts, least), "near")
    labels = stored(spark, components(spark, near), "labels")
    more = stored(spark, crowded_links(spark, crowded, labels, texts, least), "crowded-links")
    if more.limit(1).count():
        labels = components(spark, near.unionByName(more))
    named = (first.select("c", "key", "least_id", "many").join(labels, "c", "left")
             .withColumn("label", F.coalesce("label", "c")))
    own = named.groupBy("label").agg(F.min("least_id").alias("class_id"))
    return rows.select("doc_id", "key"), named.join(own, "label").select("c", "key", "least_id", "many", "label", "class_id")


def with_key(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """The rows of docs that hold a wanted (key, least_id), joined to it.

    The id is part of the join, so copies of one text stay spread.
    """
    key, own = temp_name(*docs.columns, *wanted.columns), temp_name(*docs.columns, *wanted.columns)
    keyed = docs.withColumn(key, key_column(F.col(text_col))).withColumn(own, F.col(id_col).cast("long"))
    wanted = wanted.withColumnsRenamed({"key": f"{key}k", "least_id": f"{own}k"})
    on = (F.col(key) == F.col(f"{key}k")) & F.col(own).eqNullSafe(F.col(f"{own}k"))
    return keyed.join(wanted, on).drop(key, f"{key}k", own, f"{own}k")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least: float = LEAST) -> DataFrame:
    """(doc_id, class_id, kept) of every row; kept is the class's least doc_id."""
    rows, texts = classes_of(spark, docs, id_col, text_col, least)
    cls = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return (rows.join(texts.select("key", "class_id"), "key", "left")
            .select("doc_id", cls.alias("class_id"), F.col("doc_id").eqNullSafe(cls).alias("kept")))


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least: float = LEAST) -> DataFrame:
    """One row of docs for each class, with the columns of docs; wordless rows all stay."""
    _, texts = classes_of(spark, docs, id_col, text_col, least)
    place = F.struct(F.col("least_id").isNull(), "least_id", "c")
    one = stored(spark, texts.groupBy("label").agg(F.min(F.struct(place, "key", "least_id", "c", "many")).alias("x"))
                 .select("x.key", "x.least_id", "x.c", "x.many"), "kept")
    number = temp_name(*docs.columns)
    kept = with_key(docs, id_col, text_col, one.select("key", "least_id", F.col("c").alias(number)))
    if one.filter("many > 1").limit(1).count():  # rows that repeat id and text
        kept = kept.dropDuplicates([number])
    wordless = docs.filter(F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return kept.drop(number).unionByName(wordless)
