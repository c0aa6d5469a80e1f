"""Recognizers (X1), prediction joins (J1, X3, S8) and the officials rule (P20).

A recognizer maps ``pieces`` to ``(label, confidence)`` per token:

* (a) rules as column expressions over a run's window, all JVM-side (the test
  tables' rules are in ``redactum.fixtures.rules``);
* ``gazetteer_labels`` - (b) an equi-join of tokens with a term list, and
  ``term_labels`` for terms of several words, found on the distinct words of runs;
* ``model_labels``     - (c) hosts a user's token-classification callable in
  ``mapInArrow``, loaded once per Python worker, fed Arrow batches of runs
  (``model_predictions`` also tells the runs it failed on, T9);
* ``join_predictions`` - (d) an external predictions table, missing -> O/1.0.

A ``Recognizer`` (``hosted_model``, ``term_list``) can also find its tokens in runs
that are one row each, so that tokens without a label never become rows.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from typing import Callable, Iterator, Optional

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from ..functions.arrays import BLOCK, bound
from ..functions.patterns import WHITESPACE_CHARS
from .model_host import answers, best_of, calls, hosted, token_slices, windows
from .spans import SPAN, decode_spans, run_spans, span_columns, span_tokens
from .tokens import FOUND, KEYED, RUN, Placed, as_batch, found_pieces, piece_runs, run_window

# --- fixed values ------------------------------------------------------------
# role words after which a person is an official and stays in clear (P20)
ROLE_WORDS = ["sędzia", "sędziego", "sędzią", "sędziemu", "prokurator", "prokuratora",
              "biegły", "biegłego", "protokolant", "protokolantka", "przewodniczący",
              "przewodnicząca", "ssr", "sso", "ssa", "ssn", "judge", "clerk", "prosecutor",
              "juge", "greffier", "procureur", "richter", "staatsanwalt", "juez", "fiscal"]
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Recognizer:
    """``labels``: pieces -> all of them with label and confidence. ``found``: segments
    whose (doc_id, seg_no) come once -> the pieces with labels other than ``O`` alone, the same.
    ``spans``, if there: the same segments and a threshold -> what ``spans.decode_spans`` makes of those."""
    labels: Callable[[DataFrame], DataFrame]
    found: Callable[[DataFrame], DataFrame]
    spans: Optional[Callable[[DataFrame, float], DataFrame]] = None

    def __call__(self, pcs: DataFrame) -> DataFrame:
        return self.labels(pcs)


def officials_rule(labelled: DataFrame, roles=None) -> DataFrame:
    """P20: a person mention right after a role word (one or two tokens
    back) is an official and becomes O (its I- tail then opens nothing)."""
    roles = [r.lower() for r in (roles or ROLE_WORDS)]
    p1 = F.lower(F.lag("token", 1).over(run_window()))
    p2 = F.lower(F.lag("token", 2).over(run_window()))
    lbl = F.col("label")
    official = (lbl == "B-PERSON") & (p1.isin(roles) | p2.isin(roles))
    x = labelled.withColumn("official", F.coalesce(official, F.lit(False)))
    # the I-PERSON tokens that continue an official's name are cleared too
    grp = F.sum(F.when(lbl != "I-PERSON", 1).otherwise(0)).over(
        run_window().rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("grp", grp)
    wg = Window.partitionBy("doc_id", "run_no", "grp")
    x = x.withColumn("official", F.max("official").over(wg))
    return x.withColumn("label", F.when(F.col("official"), F.lit("O")).otherwise(lbl)).drop("official", "grp")


def gazetteer_labels(pcs: DataFrame, terms: DataFrame) -> DataFrame:
    """X1(b): single-token term list terms(term, label, confidence).

    The term list is joined on the token; Catalyst/AQE broadcasts it only
    when its measured size is under the broadcast threshold.
    """
    t = terms.select(F.col("term").alias("token"), F.col("label").alias("g_label"),
                     F.col("confidence").alias("g_conf"))
    x = pcs.join(t, "token", "left")
    return (x.withColumn("label", F.when(F.col("is_tok"), F.coalesce("g_label", F.lit("O"))).otherwise("O"))
            .withColumn("confidence", F.coalesce("g_conf", F.lit(1.0))).drop("g_label", "g_conf"))


def _term_tables(terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms by their words, those of one word by it and longer ones by their first two words."""
    words = F.filter(F.split(F.trim("term"), r"\s+"), lambda w: w != "")
    t = (terms.select(words.alias("words"), "label", "confidence").where("size(words) > 0").groupBy("words")
         .agg(F.max_by(F.struct("confidence", "label"), F.struct("confidence", F.reverse("label"))).alias("x"))
         .select("words", "x.label", "x.confidence"))
    term = F.struct((-F.size("words")).alias("size"), "words", "label", "confidence")
    by = lambda *keys: t.groupBy(*keys).agg(F.sort_array(F.collect_list(term)).alias("terms"))
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    single = by(first.alias("w1"), (F.size("words") == 1).alias("one")).where("one").select("w1", F.col("terms").alias("t1"))
    several = by(first.alias("w1"), second.alias("w2")).where("w2 IS NOT NULL").select("w1", "w2", F.col("terms").alias("t2"))
    return t, single, several


def _longest_term(ahead: str):
    """Of the terms looked up (t1, t2), the longest that the words ``ahead`` begin with, alone in an array (empty without one)."""
    equal = lambda m: F.slice(ahead, 1, F.size(m["words"])) == m["words"]
    # the terms of a key are sorted by length, the longest first
    return F.slice(F.concat(F.coalesce(F.filter("t2", equal), F.array()), F.coalesce("t1", F.array())), 1, 1)


def _leftmost():
    """Of the matches ``ms`` of a run by ``start``, those that count: each begins behind the one before."""
    # what is kept is appended to an array, which is copied for it: that is done by blocks
    none = F.slice("ms", 1, 0)
    blocks = F.transform(F.sequence(F.lit(0), F.size("ms") - 1, F.lit(BLOCK)), lambda i: F.slice("ms", i + 1, BLOCK))
    of = lambda free, block: F.aggregate(block, F.struct(free.alias("free"), none.alias("kept")), lambda s, m: F.when(
        m["start"] >= s["free"], F.struct((m["start"] - m["size"]).alias("free"), F.concat(s["kept"], F.array(m)).alias("kept"))).otherwise(s))
    walked = F.aggregate(blocks, F.struct(F.lit(0).alias("free"), F.array(none).alias("kept")), lambda s, b: bound(
        of(s["free"], b), lambda x: F.struct(x["free"].alias("free"), F.concat(s["kept"], F.array(x["kept"])).alias("kept"))))
    return F.flatten(walked["kept"])


def term_labels(pcs: DataFrame, terms: DataFrame) -> DataFrame:
    """X1(b): terms(term, label, confidence) of one or more words.

    A match is a run of following tokens equal to the term's words (parted by
    white space); in a run of text the leftmost match counts, of those the
    longest, and the search goes on behind it. ``label`` is the entity type: the
    first token is ``B-``, the others ``I-``.

    A term is found by its first two words (one, if it has no more): each
    token asks for the terms that begin with it and for those that begin with it
    and its neighbour, one lookup each, and only what is found is compared with
    the words that follow (as many as the longest term has). At a place only
    the longest match can count, so a token gives one row at most. Of equal
    terms the one with the greatest confidence, then the least label counts."""
    t, single, several = _term_tables(terms)
    longest = t.agg(F.coalesce(F.max(F.size("words")), F.lit(0)).alias("longest"))
    runs = (pcs.where("is_tok").groupBy("doc_id", "run_no")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("toks"))
            .crossJoin(F.broadcast(longest)))
    # fields are taken of single tokens and short slices: those of the whole array would be taken anew at each place
    asks = F.transform("toks", lambda s, i: F.struct(
        i.alias("start"), s["token"].alias("w1"), F.get("toks", i + 1)["token"].alias("w2"),
        F.slice("toks", i + 1, F.col("longest")).getField("token").alias("ahead")))
    x = runs.select("doc_id", "run_no", F.get("toks", F.lit(0))["pos"].alias("first"), F.inline(asks)).join(single, "w1", "left").join(several, ["w1", "w2"], "left")
    x = x.where("t1 IS NOT NULL OR t2 IS NOT NULL").select("doc_id", "run_no", "first", "start", F.explode(_longest_term("ahead")).alias("b"))
    x = x.select("doc_id", "run_no", "first", F.struct("start", "b.size", "b.label", "b.confidence").alias("m"))
    # leftmost and longest: matches are few, so a run's are walked in one row
    ordered = x.groupBy("doc_id", "run_no", "first").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    spans = ordered.select("doc_id", "run_no", "first", F.explode(_leftmost()).alias("m"))
    tokens = spans.select("doc_id", "run_no", (F.col("first") + F.col("m.start")).alias("start"), F.col("m.label").alias("label"),
                          F.col("m.confidence").alias("confidence"), F.explode(F.sequence(F.lit(0), -F.col("m.size") - 1)).alias("nth"))
    preds = tokens.select("doc_id", "run_no", (F.col("start") + F.col("nth")).cast("int").alias("tok_no"),
                          F.concat(F.when(F.col("nth") == 0, F.lit("B-")).otherwise(F.lit("I-")), "label").alias("label"), "confidence")
    return join_predictions(pcs, preds)


def join_predictions(pcs: DataFrame, preds: DataFrame) -> DataFrame:
    """preds(doc_id, run_no, tok_no, label, confidence); missing -> O, 1.0.
    The predictions other than O are few: they are the hashed side, the tokens
    are not sorted for the join."""
    p = preds.select("doc_id", "run_no", F.col("tok_no").alias("pos"),
                     F.col("label").alias("p_label"), F.col("confidence").alias("p_conf")).hint("shuffle_hash")
    x = pcs.join(p, ["doc_id", "run_no", "pos"], "left")
    return (x.withColumn("label", F.coalesce("p_label", F.lit("O")))
            .withColumn("confidence", F.coalesce("p_conf", F.lit(1.0))).drop("p_label", "p_conf"))


def first_subtoken(sub_preds: DataFrame, whole: bool = False) -> DataFrame:
    """sub_preds(doc_id, run_no, tok_no, sub_no, label, confidence) ->
    one prediction per word, taken from its first sub-token.

    ``whole``: each word has all its sub-tokens, numbered from 0, and no two words
    share a key. Then the first is told by its number, and nothing is grouped."""
    if whole:
        return sub_preds.where("sub_no = 0").select("doc_id", "run_no", "tok_no", "label", "confidence")
    best = F.min_by(F.struct("label", "confidence"), F.col("sub_no"))
    return (sub_preds.groupBy("doc_id", "run_no", "tok_no").agg(best.alias("b"))
            .select("doc_id", "run_no", "tok_no", "b.label", "b.confidence"))


def apply_label_map(pred_ids: DataFrame, label_map_json: DataFrame) -> DataFrame:
    """label_map_json(json) holds ``{"id2label": {"0": "O", ...}}``;
    pred_ids(doc_id, run_no, tok_no, label_id, confidence) -> preds."""
    m = (label_map_json.select(F.explode(F.from_json("json", "struct<id2label: map<string,string>>")
                                         .getField("id2label")).alias("k", "label"))
         .select(F.col("k").cast("int").alias("label_id"), "label"))
    # the labels of a model, however many tokens have them
    return pred_ids.join(F.broadcast(m), "label_id", "left").withColumn(
        "label", F.coalesce("label", F.lit("O")))


def digest(model_factory: Callable) -> str:
    return hashlib.sha256(cloudpickle.dumps(model_factory)).hexdigest()


def model_predictions(pcs: DataFrame, model_factory: Callable[[], Callable], window=None,
                      model_id: str | None = None, isolate: bool = True) -> DataFrame:
    """X1(c), T9: a user's model over runs in Arrow batches ->
    (doc_id, run_no, tok_no, label, confidence, error).

    ``model_factory()`` returns ``predict(list[list[str]]) -> list[list[(label, conf)]]``
    and is called once per Python worker and ``model_id`` (by default a
    digest of the factory): later tasks of the worker use the model it holds.
    Only labels other than ``O`` come back. Runs are assembled on the
    executors (``collect_list`` per run, as large as the longest run; a window
    bounds it), never on the driver. ``window=(size, overlap)`` feeds a length-limited
    model overlapping token windows (X2); each token keeps the prediction of
    the window where it is furthest from an edge, so no token is left
    unlabelled.

    A run that the model raises on (or answers with the wrong number of labels)
    is a row of its own: tok_no is null, ``error`` holds the message, an empty
    line and the whole trace. A call gets runs of about ``CALL_TOKENS`` tokens, so
    the words a worker holds as Python objects do not grow with the Arrow
    batch (10,000 runs by default). When a call with many runs raises, its runs
    are asked one by one, so the others keep their labels. With ``isolate``
    off the exception ends the job."""
    toks = pcs.where("is_tok").select("doc_id", "run_no", F.col("pos").alias("tok_no"), "token")
    if window is None:
        toks = toks.withColumn("chunk", F.lit(0))
    else:
        from .tokens import chunk_windows
        toks = chunk_windows(toks, size=window[0], overlap=window[1]).drop("offset", "edge_dist", "best")
    runs = (toks.groupBy("doc_id", "run_no", "chunk")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("tok_no").alias("pos"), "token"))).alias("toks"))
            .select("doc_id", "run_no", "chunk", F.col("toks.pos").alias("pos"), F.col("toks.token").alias("words")))

    model_id = model_id or digest(model_factory)
    every = window is not None  # a window's O may outweigh another window's label

    schema = StructType([runs.schema["doc_id"], runs.schema["run_no"], runs.schema["chunk"]])
    schema = (schema.add("tok_no", IntegerType()).add("label", StringType()).add("confidence", DoubleType())
              .add("error", StringType()))
    arrow = to_arrow_schema(schema)

    def infer(batches: Iterator):
        import pyarrow as pa
        model = hosted(model_id, model_factory)
        for batch in batches:
            for part in token_slices(batch):
                rows = []
                keys = [part.column(c).to_pylist() for c in ("doc_id", "run_no", "chunk")]
                pos, words = part.column("pos").to_pylist(), part.column("words").to_pylist()
                for d, r, c, at, (preds, error) in zip(*keys, pos, answers(model, words, isolate)):
                    if error is not None:
                        rows.append((d, r, c, None, None, None, error))
                    else:
                        rows += [(d, r, c, i, lab, float(conf), None) for i, (lab, conf) in zip(at, preds) if every or lab != "O"]
                columns = zip(*rows) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, arrow)], schema=arrow)

    preds = runs.mapInArrow(infer, schema=schema)
    if window is None:
        return preds.drop("chunk")
    size, overlap = window
    step = size - overlap
    off = F.col("tok_no") - F.col("chunk") * F.lit(step)
    dist = F.least(off, F.lit(size - 1) - off)
    best = F.max_by(F.struct("label", "confidence"), F.struct(dist, -F.col("chunk")))
    # the rows of a run's raising windows share the null tok_no: the first window's error stands
    return (preds.groupBy("doc_id", "run_no", "tok_no").agg(best.alias("b"), F.min_by("error", "chunk").alias("error"))
            .select("doc_id", "run_no", "tok_no", "b.label", "b.confidence", "error"))


def model_labels(pcs: DataFrame, model_factory: Callable[[], Callable], window=None,
                 model_id: str | None = None) -> DataFrame:
    """X1(c) as a recognizer: ``model_predictions`` on every token; an exception of the model ends the job."""
    return join_predictions(pcs, model_predictions(pcs, model_factory, window, model_id, isolate=False).drop("error"))


def model_found(segs: DataFrame, model_factory: Callable[[], Callable], window=None, model_id: str | None = None,
                isolate: bool = True) -> DataFrame:
    """``model_predictions`` of segments whose (doc_id, seg_no) come once ->
    (doc_id, run_no, is_xml, base, lead, pos, p, start, label, confidence, error).

    The words of a run go to the model from the run's row, in calls of about
    ``CALL_TOKENS`` tokens; its labels come back with the places of their tokens
    (``found_pieces``), so the text is not cut again to join them. A run that the
    model raises on has one more row, without ``pos``."""
    runs = piece_runs(segs)
    model_id = model_id or digest(model_factory)
    schema = _run_schema(runs, f"{FOUND}, label string, confidence double, error string")
    arrow = to_arrow_schema(schema)

    def infer(batches: Iterator):
        import pyarrow as pa
        model = hosted(model_id, model_factory)
        for batch in batches:
            for part in token_slices(batch, column="ps"):
                x = Placed(part)
                words, answered, errors = x.words.to_numpy(zero_copy_only=False).tolist(), {}, {}
                ask = (w for i in range(len(x.sizes)) if x.sizes[i] for w in windows(i, words[x.first[i]:x.first[i + 1]], window))
                for call in calls(ask):
                    for (i, at, _), (preds, error) in zip(call, answers(model, [w for _, _, w in call], isolate)):
                        if error is None:
                            answered.setdefault(i, []).append((at, preds))
                        else:
                            errors.setdefault(i, error)
                rows = [(i, x.first[i] + at, label, float(conf), None)
                        for i, a in answered.items() for at, label, conf in best_of(a, window)]
                rows += [(i, None, None, None, error) for i, error in errors.items()]
                run, at, label, conf, error = zip(*rows) if rows else [()] * 5
                yield as_batch(x.rows(run, at, label=pa.array(label, pa.string()), confidence=pa.array(conf, pa.float64()),
                                      error=pa.array(error, pa.string())), arrow)

    return runs.mapInArrow(infer, schema=schema)


def labelled_pieces(found: DataFrame) -> DataFrame:
    """The labels of ``model_found`` as pieces(..., label, confidence)."""
    return found_pieces(found.where("error IS NULL AND label IS NOT NULL").drop("error"))


def hosted_model(model_factory: Callable[[], Callable], window=None, model_id: str | None = None) -> Recognizer:
    """X1(c): ``model_labels`` that also finds its labels in the runs' rows."""
    return Recognizer(lambda p: model_labels(p, model_factory, window, model_id),
                      lambda s: labelled_pieces(model_found(s, model_factory, window, model_id, isolate=False)))


#: characters of a term list up to which workers hold it
HELD = 4 << 20
#: tokens that are looked through at a time
TERM_TOKENS = 200_000
#: slots for the first words of a longer list
SLOTS = 1 << 16


def term_found(segs: DataFrame, terms: DataFrame, threshold: float | None = None, held: int = HELD) -> DataFrame:
    """``term_labels`` of segments whose (doc_id, seg_no) come once -> their labelled pieces alone
    or, with a threshold, the spans that ``decode_spans`` makes of them.

    A list of up to ``held`` characters is held by the workers, which match it in
    the runs' rows (the same match: leftmost, then longest). Of a longer one they
    know the slots (of a hash) that first words fall into: tokens that fall into
    one become rows and ask the list as in ``term_labels``. Either way what
    matches has its piece and place, so the text is not cut again to join the labels."""
    t, single, several = _term_tables(terms)
    t = t.withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)))
    first = F.get("words", F.lit(0))
    known = t.agg(F.max(F.size("words")).alias("longest"), F.collect_set(F.crc32(first) % F.lit(SLOTS)).alias("slots"),
                  F.sum(F.length(F.array_join("words", " "))).alias("size")).first()  # at most SLOTS
    runs = piece_runs(segs)
    if (known.size or 0) <= held:
        found = _held_matches(runs, t.collect(), threshold)  # at most HELD
        return found_pieces(found) if threshold is None else found.where(KEYED)
    found = _asked_matches(runs, single, several, known.longest, known.slots).where("label IS NOT NULL")
    found = found_pieces(found.withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(1.0))))
    return found if threshold is None else decode_spans(span_tokens(found, threshold), threshold)


def _run_schema(runs: DataFrame, more: str, keys=RUN) -> StructType:
    return StructType([runs.schema[c] for c in keys] + StructType.fromDDL(more).fields)


def _held_matches(runs: DataFrame, terms: list, threshold: float | None) -> DataFrame:
    """The tokens of the matches of terms(words, label, confidence), with label and confidence, or their spans."""
    table = {tuple(t.words): ("B-" + t.label, "I-" + t.label, t.confidence) if t.label is not None else None for t in terms}
    lengths: dict[str, list[int]] = {}
    for n, w in sorted({(len(w), w[0]) for w in table}, reverse=True):
        lengths.setdefault(w, []).append(n)
    if threshold is None:
        schema = _run_schema(runs, f"{FOUND}, label string, confidence double")
    else:
        schema = _run_schema(runs, SPAN, ("doc_id", "run_no", "base"))
    arrow = to_arrow_schema(schema)

    def matches(batches: Iterator):
        import pyarrow as pa
        for batch in batches:
            for part in token_slices(batch, TERM_TOKENS, "ps"):
                x = Placed(part)
                coded = x.words.dictionary_encode()
                words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                sizes = [lengths.get(w) for w in words]
                at = np.flatnonzero(np.array([s is not None for s in sizes], np.bool_)[codes])
                run = np.searchsorted(x.first, at, side="right") - 1
                codes, free, rows = codes.tolist(), 0, []
                for i, r, end in zip(at.tolist(), run.tolist(), x.first[run + 1].tolist()):
                    if i < free:
                        continue
                    for n in sizes[codes[i]]:
                        if i + n <= end and (key := tuple([words[c] for c in codes[i:i + n]])) in table:
                            free, m = i + n, table[key]
                            if m is not None:
                                rows.append((r, i, m[0], m[2]))
                                rows += [(r, k, m[1], m[2]) for k in range(i + 1, free)]
                            break
                if threshold is not None:
                    yield as_batch(span_columns(x, run_spans(rows, threshold)), arrow)
                    continue
                run, at, label, conf = zip(*rows) if rows else [()] * 4
                yield as_batch(x.rows(run, at, label=pa.array(label, pa.string()), confidence=pa.array(conf, pa.float64())), arrow)

    return runs.mapInArrow(matches, schema=schema)


def _asked_matches(runs: DataFrame, single: DataFrame, several: DataFrame, longest: int, known: list[int]) -> DataFrame:
    """``_held_matches`` of a list that is joined."""
    slots = np.zeros(SLOTS, np.bool_)
    slots[known] = True
    schema = _run_schema(runs, f"{FOUND}, ahead array<string>")
    arrow = to_arrow_schema(schema)

    def candidates(batches: Iterator):
        import pyarrow as pa
        for batch in batches:
            for part in token_slices(batch, TERM_TOKENS, "ps"):
                x = Placed(part)
                coded = x.words.dictionary_encode()
                hit = np.array([slots[zlib.crc32(w.encode()) % SLOTS] for w in coded.dictionary.to_pylist()], np.bool_)
                at = np.flatnonzero(hit[coded.indices.to_numpy(zero_copy_only=False)])
                run = np.searchsorted(x.first, at, side="right") - 1
                n = np.minimum(longest, x.first[run + 1] - at)
                ends = np.cumsum(n, dtype=np.int64)
                own = np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
                ahead = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), x.pieces.take(pa.array(own, pa.int64())))
                yield as_batch(x.rows(run, at, ahead=ahead), arrow)

    words = F.transform("ahead", lambda p: F.rtrim(p, F.lit(WHITESPACE_CHARS)))
    x = runs.mapInArrow(candidates, schema=schema).where(KEYED).withColumn("words", words)
    x = x.withColumns({"w1": F.get("words", F.lit(0)), "w2": F.get("words", F.lit(1))})
    x = x.join(single, "w1", "left").join(several, ["w1", "w2"], "left").where("t1 IS NOT NULL OR t2 IS NOT NULL")
    run = list(RUN)
    x = x.select(*run, "pos", "start", "ahead", F.explode(_longest_term("words")).alias("b"))
    m = F.struct(F.col("pos").alias("start"), "b.size", "b.label", "b.confidence", F.col("start").alias("place"),
                 F.slice("ahead", F.lit(1), -F.col("b.size")).alias("pieces"))
    ordered = x.select(*run, m.alias("m")).groupBy("doc_id", "run_no").agg(
        *[F.first(c).alias(c) for c in run[2:]], F.sort_array(F.collect_list("m")).alias("ms"))
    spans = ordered.select(*run, F.explode(_leftmost()).alias("m"))
    tokens = spans.select(*run, "m.*").select(*run, "start", "place", "label", "confidence", "pieces", F.posexplode("pieces").alias("nth", "p"))
    before = F.when(F.col("nth") == 0, F.lit(0)).otherwise(F.aggregate(F.slice("pieces", F.lit(1), F.col("nth")), F.lit(0), lambda s, p: s + F.length(p)))
    return tokens.select(
        *run, (F.col("start") + F.col("nth")).alias("pos"), "p", (F.col("place") + before).alias("start"),
        F.concat(F.when(F.col("nth") == 0, F.lit("B-")).otherwise(F.lit("I-")), "label").alias("label"), "confidence")


def term_list(terms: DataFrame) -> Recognizer:
    """X1(b): ``term_labels`` that also finds its terms in the runs' rows."""
    return Recognizer(lambda p: term_labels(p, terms), lambda s: term_found(s, terms), lambda s, threshold: term_found(s, terms, threshold))
