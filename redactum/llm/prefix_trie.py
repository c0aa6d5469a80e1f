"""Trie of conversation prefixes, measured along its Euler tour.

Turns of a conversation are ordered by turn (null first), then by their digest,
a SHA-256 of role and text (null: empty); repeated turns count each. A node is a
distinct sequence of first turns. Its key is its depth and, on two 64-bit hashes
of (depth, digest), the exclusive or over the sequence: a running aggregate, done
in blocks of ``BLOCK`` turns with the blocks before added, so one long conversation
is worked on by many tasks; taking the last turn's hashes off again names the
parent without a join. Two sequences with one key would differ in a last digest at
the least depth where that happens, so a node whose members have two of them ends
the job with an error rather than a wrong row.

Tour: each node has an enter and an exit arc. After enter comes the first child's
enter, or the node's own exit; after exit the next sibling's enter, or the
parent's exit. Siblings are numbered in slices of ranges of (parent, key), so the
children of one node are never ranked by one task.

List ranking: arcs are dealt by the conversation that names their node, where the
tour follows its turns; runs inside a chunk of ``CHUNK`` arcs shrink to one element.
Then rounds of independent removal: an element whose hash is less than both of
its neighbours' leaves and its neighbours are linked past it, a third of them a
round, until at most ``FINAL`` are left, which one task ranks. Backwards, each
element that left gets the place of the one before it plus its distance. Sums over
a subtree are differences of prefix sums at a node's two places, by slices of
``SLICE`` places.

Rows without a conversation id take no part. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redactum.llm.common import stored
from redactum.operators.persons import rank_slices

BLOCK, CHUNK, FINAL, SLICE = 4096, 1 << 18, 1 << 14, 1 << 16
#: bytes of joined ids that travel as one row
PIECE_BYTES = 1 << 16


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, k, digest, n_bytes): the k-th turn of each conversation, from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = (turns.filter(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"))
                    .alias("place"), F.octet_length(text).cast("long").alias("n_bytes")))
    return rank_slices(slim, ["conv_id"], "place").select(
        "conv_id", "k", F.col("place.digest").alias("digest"), "n_bytes")


def rebuilt(spark: SparkSession, turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows, convs): rows(conv_id, depth, digest, n_bytes) of conversations whose first
    h = crc32(id) % most turns are those of conversation id - id % family, and
    convs(conv_id, n) with their number of turns, 0 included."""
    turns = stored(spark, turns, "turns")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    head = F.col("conv_id") - F.col("conv_id") % family
    own = stored(spark, own.select("conv_id", "n_own", h.alias("h"), head.alias("head")), "conversations")
    source = own.select(F.col("conv_id").alias("head"), F.col("n_own").alias("n_head"))
    convs = own.join(source, "head", "left").select(
        "conv_id", "h", "head", F.least("h", F.coalesce("n_head", F.lit(0))).cast("int").alias("b"),
        F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).alias("rest"))
    convs = stored(spark, convs.withColumn("n", F.col("b") + F.col("rest")), "rebuilt-sizes")
    first = (turns.filter(F.col("k") < most).withColumnRenamed("conv_id", "head")
             .join(convs.select("head", "conv_id", "b"), "head").filter(F.col("k") <= F.col("b"))
             .select("conv_id", F.col("k").cast("long").alias("depth"), "digest", "n_bytes"))
    last = (turns.filter(F.col("k") > h).join(convs.select("conv_id", "h", "b"), "conv_id")
            .select("conv_id", (F.col("k") - F.col("h") + F.col("b")).cast("long").alias("depth"), "digest", "n_bytes"))
    return stored(spark, first.unionByName(last), "rebuilt"), convs.select("conv_id", "n")


def _key(depth: Column, a: Column, b: Column) -> Column:
    wide = lambda x: F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(wide(depth), wide(a), wide(b)))


ROOT = lambda: _key(F.lit(0), F.lit(0), F.lit(0))


def prefixes(spark: SparkSession, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(conv_id, depth, digest, n_bytes) with the key of the node and of its parent."""
    part = F.floor((F.col("depth") - 1) / block).cast("long")
    hashed = rows.withColumns({"a": F.xxhash64(F.lit(1), "depth", "digest"), "b": F.xxhash64(F.lit(2), "depth", "digest"),
                               "block": part})
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # nothing for the conversations of one block, so this table is small or empty as a rule
    offsets = stored(spark, hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
                     .select("conv_id", "block", F.bit_xor("ta").over(before).alias("ta"), F.bit_xor("tb").over(before).alias("tb"))
                     .filter("block > 0"), "prefix-offsets")
    w = W.partitionBy("conv_id", "block").orderBy("depth")
    x = hashed.withColumns({"xa": F.bit_xor("a").over(w), "xb": F.bit_xor("b").over(w)}).join(offsets, ["conv_id", "block"], "left")
    xa, xb = (F.col(f"x{c}").bitwiseXOR(F.coalesce(f"t{c}", F.lit(0))) for c in "ab")
    return x.select("conv_id", "depth", "digest", "n_bytes", _key(F.col("depth"), xa, xb).alias("key"),
                    _key(F.col("depth") - 1, xa.bitwiseXOR(F.col("a")), xb.bitwiseXOR(F.col("b"))).alias("parent"))


def trie_nodes(spark: SparkSession, paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, key, parent, depth, conv_id, n_convs, weight): one row for each distinct prefix."""
    one = F.when(F.min("digest") == F.max("digest"), F.first("n_bytes")).otherwise(
        F.raise_error(F.lit("two prefixes with one key")).cast("long"))
    nodes = (paths.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"),
                                      F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), one.alias("n_bytes")))
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
            .select(ROOT().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
                    "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes")))
    return stored(spark, nodes.unionByName(root).select(
        F.monotonically_increasing_id().alias("node"), "key", "parent", "depth", "conv_id", "n_convs",
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("weight")), "trie")


def with_siblings(spark: SparkSession, nodes: DataFrame, slices: int | None = None) -> DataFrame:
    """nodes with place (from 1) and number of siblings, parent_conv_id, n_children."""
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(spark, nodes.repartitionByRange(n, "parent", "key").withColumn("slice", F.spark_partition_id()), "siblings")
    every = W.partitionBy("parent")
    groups = (dealt.groupBy("parent", "slice").agg(F.count("*").alias("many"))  # at most a row a parent and slice
              .withColumns({"before": F.coalesce(F.sum("many").over(every.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                            "siblings": F.sum("many").over(every)}))
    groups = groups.join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    groups = stored(spark, groups.select("parent", "slice", "before", "siblings", "parent_conv_id"), "sibling-groups")
    own = F.row_number().over(W.partitionBy("parent", "slice").orderBy("key"))
    ranked = dealt.withColumn("own", own)
    same = ranked.parent.eqNullSafe(groups.parent) & (ranked.slice == groups.slice)
    ranked = ranked.join(groups, same).select(*[ranked[c] for c in nodes.columns], "siblings", "parent_conv_id",
                                              (F.col("own") + F.col("before")).alias("place"))
    children = groups.filter("parent IS NOT NULL").select(F.col("parent").alias("key"), F.col("siblings").alias("n_children")).distinct()
    return stored(spark, ranked.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")


def euler_arcs(tree: DataFrame) -> DataFrame:
    """(arc, succ, conv_id, depth): enter arcs 2 node, exit arcs 2 node + 1; the last one has no succ.

    Arcs are first named (enter: parent and place; exit: own key and place 0), as
    each knows the name of its successor; one join gives the numbers.
    """
    enter, exit_ = F.col("node") * 2, F.col("node") * 2 + 1
    zero = F.lit(0).cast("long")
    place = F.col("place").cast("long")
    names = tree.select("parent", place.alias("place"), enter.alias("succ")).unionByName(
        tree.select(F.col("key").alias("parent"), zero.alias("place"), exit_.alias("succ")))
    down = tree.select(enter.alias("arc"), "conv_id", "depth", F.col("key").alias("parent"),
                       F.when(F.col("n_children") > 0, F.lit(1)).otherwise(0).cast("long").alias("place"))
    up = tree.select(exit_.alias("arc"), "conv_id", "depth", "parent",
                     F.when(place < F.col("siblings"), place + 1).otherwise(zero).alias("place"))
    return down.unionByName(up).join(names, ["parent", "place"], "left").select("arc", "succ", "conv_id", "depth")


def runs_of(arc: np.ndarray, succ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, offset, end) of a chunk: the first arc of each one's run, its distance
    from it, and which arcs end a run; succ is -1 for none."""
    n = len(arc)
    order = np.argsort(arc)
    at = np.searchsorted(arc, succ, sorter=order).clip(max=n - 1)
    nxt = order[at]
    linked = arc[nxt] == succ
    back = np.arange(n)
    back[nxt[linked]] = np.flatnonzero(linked)
    offset = (back != np.arange(n)).astype(np.int64)
    while True:  # pointer jumping: each looks twice as far back
        far = back[back]
        if (far == back).all():
            return arc[back], offset, ~linked
        offset += offset[back]
        back = far


def _run_batches(chunk: int):
    def shrink(held):
        arc = np.concatenate([b.column("arc").to_numpy() for b in held])
        succ = np.concatenate([b.column("succ").fill_null(-1).to_numpy() for b in held])
        head, offset, end = runs_of(arc, succ)
        return pa.RecordBatch.from_arrays(
            [pa.array(arc), pa.array(head), pa.array(offset), pa.array(succ, mask=~end | (succ < 0)), pa.array(end)],
            ["arc", "head", "offset", "succ", "last"])

    def run(batches):
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= chunk:
                yield shrink(held)
                held, many = [], 0
        if many:
            yield shrink(held)
    return run


def shrunk(spark: SparkSession, arcs: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(arc, head, offset, succ, last) of all arcs; succ on the last of a run only."""
    part = F.floor(F.col("depth") / block)
    dealt = arcs.withColumn("part", part).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part")
    return stored(spark, dealt.select("arc", "succ").mapInArrow(
        _run_batches(chunk), "arc long, head long, offset long, succ long, last boolean"), "runs")


def rank_final(rows: pd.DataFrame) -> pd.DataFrame:
    """pos of at most FINAL elements (arc, succ, size) that are one list."""
    arc, size = rows.arc.to_numpy(), rows["size"].to_numpy()
    nxt = dict(zip(arc.tolist(), rows.succ.fillna(-1).astype(np.int64).tolist(), strict=True))
    width = dict(zip(arc.tolist(), size.tolist(), strict=True))
    at = next(iter(set(nxt) - set(nxt.values())))
    pos, out = 0, []
    while at in nxt:
        out.append((at, pos))
        pos += width[at]
        at = nxt[at]
    return pd.DataFrame(out, columns=["arc", "pos"], dtype=np.int64)


def list_positions(spark: SparkSession, runs: DataFrame, final: int = FINAL) -> DataFrame:
    """(arc, pos) of all arcs of shrunk(): pos from 0."""
    heads = runs.filter("last").select(F.col("head").alias("arc"), "succ", (F.col("offset") + 1).alias("size"))
    backward = heads.filter("succ IS NOT NULL").select(F.col("succ").alias("arc"), F.col("arc").alias("pred"),
                                                       F.col("size").alias("gap"))
    cur = stored(spark, heads.join(backward, "arc", "left"), "list")
    gone = []
    while cur.count() > final:
        turn = len(gone)
        hash_ = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        leaves = (F.col("pred").isNotNull() & (hash_("arc") < hash_("pred"))
                  & (F.col("succ").isNull() | (hash_("arc") < hash_("succ"))))
        marked = stored(spark, cur.withColumn("leaves", F.coalesce(leaves, F.lit(False))), "list-marked")
        out = marked.filter("leaves")
        long_ = lambda x: F.lit(x).cast("long")
        none = lambda *names: [long_(None).alias(c) for c in names]
        flag = lambda x: F.lit(x).alias("own")
        # what a leaving element tells its neighbours: a new successor and size, a new predecessor and gap
        to_pred = out.select(F.col("pred").alias("arc"), "succ", (F.col("gap") + F.col("size")).alias("size"), *none("pred", "gap"), F.lit(1).alias("kind"))
        to_succ = out.filter("succ IS NOT NULL").select(F.col("succ").alias("arc"), *none("succ", "size"), "pred",
                                                        (F.col("gap") + F.col("size")).alias("gap"), F.lit(2).alias("kind"))
        stay = marked.filter("NOT leaves").select("arc", "succ", "size", "pred", "gap", F.lit(0).alias("kind"))
        said = lambda k: F.max(F.when(F.col("kind") == k, F.struct("succ", "size", "pred", "gap")))
        mixed = stay.unionByName(to_pred).unionByName(to_succ).groupBy("arc").agg(
            said(0).alias("o"), said(1).alias("p"), said(2).alias("s"))
        gone.append(out.select("arc", "pred", "gap"))
        cur = stored(spark, mixed.select(
            "arc", F.when(F.col("p").isNull(), F.col("o.succ")).otherwise(F.col("p.succ")).alias("succ"),
            F.coalesce("p.size", "o.size").alias("size"),
            F.coalesce("s.pred", "o.pred").alias("pred"), F.coalesce("s.gap", "o.gap").alias("gap")), "list")
    known = cur.select("arc", "succ", "size", F.lit("all").alias("of")).groupBy("of").applyInPandas(rank_final, "arc long, pos long")
    known = stored(spark, known, "places")
    for out in reversed(gone):
        more = out.join(known.select(F.col("arc").alias("pred"), "pos"), "pred").select("arc", (F.col("pos") + F.col("gap")).alias("pos"))
        known = known.unionByName(stored(spark, more, "places"))
    return runs.join(known.select(F.col("arc").alias("head"), "pos"), "head").select("arc", (F.col("pos") + F.col("offset")).alias("pos"))


def subtree_sums(spark: SparkSession, places: DataFrame, values: DataFrame, names: list[str], slice_rows: int = SLICE) -> DataFrame:
    """(node, names) with the sums of values(node, names) over each node's subtree, from places(arc, pos)."""
    arcs = (places.withColumn("node", F.floor(F.col("arc") / 2).cast("long")).join(values, "node")
            .withColumns({c: F.when(F.col("arc") % 2 == 0, F.col(c)).otherwise(0).cast("long") for c in names})
            .withColumn("slice", F.floor(F.col("pos") / slice_rows).cast("long")))
    arcs = stored(spark, arcs, "tour")
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each slice of the tour
    offsets = (arcs.groupBy("slice").agg(*[F.sum(c).alias(c) for c in names])
               .select("slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names]))
    offsets = stored(spark, offsets, "tour-offsets")
    w = W.partitionBy("slice").orderBy("pos")
    running = arcs.withColumns({f"{c}_sum": F.sum(c).over(w) for c in names}).join(offsets, "slice")
    up_to = lambda c: F.col(f"{c}_sum") + F.col(f"{c}_before")
    enter = F.col("arc") % 2 == 0
    return running.groupBy("node").agg(*[
        F.sum(F.when(enter, F.col(c) - up_to(c)).otherwise(up_to(c))).alias(c) for c in names])


def _pieces(most: int):
    def run(batches):
        key, first, held, size = None, None, [], 0
        rows = []

        def close():
            nonlocal held, size
            if held:
                rows.append((key, first, ",".join(held)))
            held, size = [], 0

        def out():
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if k != key or size >= most:
                    close()
                    key, first = k, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if rows:
                yield out()
        close()
        if rows:
            yield out()
    return run


def _digests(batches):
    key, state, rows = None, None, []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()),
                                            pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])
        rows.clear()
        return batch

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield out()
    if key is not None:
        rows.append((key, state.hexdigest()))
        yield out()


def ends_digests(spark: SparkSession, ends: DataFrame, most: int = PIECE_BYTES) -> DataFrame:
    """(key, ends_sha256) from ends(key, conv_id): ids in ascending order, joined by commas.

    Ids are sorted by ranges and joined to rows of about ``most`` bytes there; the
    rows of a key then pass through one hash in order, none of them held.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = (ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
              .mapInArrow(_pieces(most), "key binary, first long, ids string"))
    return (pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
            .mapInArrow(_digests, "key binary, ends_sha256 string"))


def prefix_trie(spark: SparkSession, rows: DataFrame, convs: DataFrame, block: int = BLOCK, chunk: int = CHUNK,
                final: int = FINAL, slice_rows: int = SLICE) -> DataFrame:
    """One row a node of the trie of rows(conv_id, depth, digest, n_bytes), depths from 1 without gaps,
    for the conversations of convs(conv_id, n)."""
    paths = stored(spark, prefixes(spark, rows, block), "prefixes")
    nodes = trie_nodes(spark, paths, convs)
    tree = with_siblings(spark, nodes)
    arcs = euler_arcs(tree)
    places = list_positions(spark, shrunk(spark, arcs, block, chunk), final)
    values = tree.select("node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("weight").alias("saved_tokens"))
    sums = subtree_sums(spark, places, values, ["n_leaves", "saved_tokens"], slice_rows)
    last = paths.join(convs.filter("n > 0"), "conv_id").filter(F.col("depth") == F.col("n")).select("key", "conv_id")
    ends = last.unionByName(convs.filter("n = 0").select(ROOT().alias("key"), "conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (tree.join(sums, "node").join(ends_digests(spark, ends), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def conversation_trie(spark: SparkSession, turns: DataFrame, **sizes) -> DataFrame:
    """The trie of the conversations rebuilt with their family's first turns."""
    rows, convs = rebuilt(spark, ordered_turns(turns))
    if not convs.limit(1).count():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    return prefix_trie(spark, rows, convs, **sizes)
