"""The redaction plan: documents -> runs -> tokens -> labels -> spans ->
person keys -> numbering -> substitutes -> rewritten documents.

Physical shape. The documents are hash-partitioned on ``doc_id`` once, at the
start; segments, tokens, recognition, span decoding, numbering windows and the
rebuild are all keyed by document, so they run in that partitioning without
another exchange of the text. Only the (small) mention table leaves it: to be
joined with the distinct-name keys, and back to the document partitioning for
the substitute join, which reuses the token side's partitioning
(``spark.sql.requireAllClusterKeysForCoPartition=false``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import markup, names, persons, recognize, rewrite, spans, tokens
from ..session import drop_scratch, scratch_path


@dataclass
class Config:
    threshold: float = 0.7
    shift: int = 0
    order: str = "reference"      # or "reading"
    tags: Optional[bool] = None   # None: tags for markup, plain for text
    skip_tagged: bool = True
    officials: bool | tuple = False  # True: the fixed role words (P20); or role words of one's own
    fold: str = "reference"       # or "letter" (Q4)
    partitions: Optional[int] = None
    # how the small intermediate tables (spans, name keys, substitutes) are
    # kept: "checkpoint" writes them under a folder of the run next to the
    # cluster's checkpoints, cuts the lineage and is dropped by ``discard``;
    # "none" keeps one long plan
    materialize: str = "checkpoint"
    # the input is already hash-partitioned on doc_id (a table bucketed by
    # doc_id, see sources.files.ingest_bucketed): no shuffle of the text
    clustered: bool = False


def kept_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(eq=False)
class Part:
    """Documents of a redaction whose ids come once (``alone``): each is worked in
    its own row. Rows that share an id (or a null one) are the other part: they
    are one run to the windows over it."""
    of: "Redaction"
    source: DataFrame
    alone: bool

    @cached_property
    def segments(self) -> DataFrame:
        r = self.of
        if r._seg_input is not None:
            return self.source.repartition(r.n, "doc_id")
        docs = self.source if r.cfg.clustered else self.source.repartition(r.n, "doc_id")
        return markup.segments(docs, r.cfg.skip_tagged, self.alone)

    @cached_property
    def pieces(self) -> DataFrame:
        return tokens.pieces(self.segments)

    @cached_property
    def labelled(self) -> DataFrame:
        return self.of._recognize(self.pieces, self.of._recognizer)

    @cached_property
    def token_labels(self) -> DataFrame:
        """(doc_id, run_no, tok_no, token, label, confidence) of every token, without offsets."""
        r = self.of
        own = tokens.pieces(self.segments, offsets=False, alone=True) if self.rowwise else self.pieces
        return r._recognize(own, r._recognizer).where("is_tok").select(
            "doc_id", "run_no", F.col("pos").alias("tok_no"), "token", "label", "confidence")

    @property
    def rowwise(self) -> bool:
        return self.alone and self.of.rowwise

    @cached_property
    def marked(self) -> DataFrame:
        return spans.mark_spans(self.labelled, self.of.cfg.threshold)

    @cached_property
    def span_segments(self) -> DataFrame:
        """Segments of which only those that the recognizer may find something in are runs."""
        r, segs = self.of, self.segments
        if r._prefilter is not None:
            if r._seg_input is None:
                # a run is part of its document's text: what no run can match is not shuffled
                docs = self.source.where(r._prefilter(F.col("text")))
                docs = docs if r.cfg.clustered else docs.repartition(r.n, "doc_id")
                segs = markup.segments(docs, r.cfg.skip_tagged, self.alone)
            segs = segs.withColumn(
                "is_run", F.col("is_run") & F.coalesce(r._prefilter(F.col("seg")), F.lit(False)))
        return segs

    @cached_property
    def span_tokens(self) -> DataFrame:
        r = self.of
        if self.alone and r._finder is not None:
            return spans.span_tokens(r._finder.found(self.span_segments), r.cfg.threshold)
        labelled = r._recognize(tokens.pieces(self.span_segments, alone=self.rowwise), r._recognizer)
        return spans.span_tokens(labelled.drop("before", "after"), r.cfg.threshold)

    @cached_property
    def spans(self) -> DataFrame:
        r = self.of
        if self.alone and r._finder is not None and r._finder.spans is not None:
            return r._finder.spans(self.span_segments, r.cfg.threshold)
        return spans.decode_spans(self.span_tokens, r.cfg.threshold)


class Redaction:
    """Lazily built DataFrames of one redaction plan (nothing is executed
    until an action runs on one of them)."""

    def __init__(self, docs: Optional[DataFrame], lemmas: DataFrame | Callable[[DataFrame], DataFrame],
                 recognizer: Callable[[DataFrame], DataFrame], config: Optional[Config] = None,
                 segments: Optional[DataFrame] = None, prefilter: Optional[Callable] = None,
                 folder: Optional[str] = None, rowwise: bool = False):
        """``lemmas`` is the inflection table (``sources.lexicon``), or a function
        from names(name) to the part of one that these names need;
        ``recognizer`` labels pieces (``operators.recognize``); if it is a
        ``Recognizer``, spans are made of what it finds in the runs' own rows.

        ``segments`` (doc_id, seg_no, seg, is_xml, is_run) may be given
        instead of documents, e.g. conversations whose turns are runs.

        ``rowwise``: the recognizer looks at no more than a token and its
        neighbours (``before``, ``after`` of ``tokens.pieces``), so runs that
        are one row need no window for it.

        ``prefilter(seg) -> bool column`` is a superset test of the
        recognizer that holds for a text if it holds for any part of it (rules
        may have one; a model has none): documents that fail it
        are not shuffled for recognition, runs that fail it skip its token
        pass. ``pieces`` and
        ``marked`` stay complete (lazy) for the queries that need every
        token."""
        self.cfg = config or Config()
        spark = (docs if docs is not None else segments).sparkSession
        self.folder = folder or scratch_path(spark, f"run-{uuid.uuid4().hex}")
        self._spark = spark
        n = self.cfg.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.n = n
        self._seg_input = None
        if segments is None:
            self.raw_docs = docs.select("doc_id", "text", F.coalesce(F.col("fmt"), F.lit("txt")).alias("fmt"))
            self.docs = self.raw_docs if self.cfg.clustered else self.raw_docs.repartition(n, "doc_id")
        else:
            self._seg_input = segments.repartition(n, "doc_id")
            self.docs = self._seg_input.select("doc_id").distinct()
        self._recognizer, self._prefilter, self._lemmas = recognizer, prefilter, lemmas
        self.rowwise = rowwise and not self.cfg.officials  # that rule has windows
        # the officials rule looks at the tokens before a label, whatever theirs are
        self._finder = recognizer if isinstance(recognizer, recognize.Recognizer) and not self.cfg.officials else None
        self._input = self.raw_docs if segments is None else segments
        self._keys = ["doc_id"] if segments is None else ["doc_id", "seg_no"]

    @cached_property
    def parts(self) -> list[Part]:
        """The documents (or given segments) whose keys come once and, if there
        are any, the others. Only keys are read for it."""
        repeated = self._keep("repeated", self._input.groupBy(*self._keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        if repeated.isEmpty():
            return [Part(self, self._input, True)]
        other = repeated.withColumnsRenamed({k: f"other_{k}" for k in self._keys})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in self._keys])
        return [Part(self, self._input.join(other, same, how), alone) for how, alone in (("left_anti", True), ("left_semi", False))]

    def over_parts(self, f: Callable[[Part], DataFrame]) -> DataFrame:
        """``f`` of each part, in one table."""
        return reduce(DataFrame.unionByName, map(f, self.parts))

    @cached_property
    def segments(self) -> DataFrame:
        return self.over_parts(lambda p: p.segments)

    @cached_property
    def pieces(self) -> DataFrame:
        return self.over_parts(lambda p: p.pieces)

    @cached_property
    def labelled(self) -> DataFrame:
        return self.over_parts(lambda p: p.labelled)

    @cached_property
    def marked(self) -> DataFrame:
        return self.over_parts(lambda p: p.marked)

    # The small tables are built (and checkpointed) on first use only, so a
    # query that needs tokens alone never runs recognition.
    @cached_property
    def span_tokens(self) -> DataFrame:
        """The tokens of ``marked`` that lie in spans (a tiny fraction), kept spans or not."""
        return self.over_parts(lambda p: p.span_tokens)

    @cached_property
    def spans(self) -> DataFrame:
        return self._keep("spans", self.over_parts(lambda p: p.spans))

    @cached_property
    def person_names(self) -> DataFrame:
        return self.spans.where(F.col("label") == "PERSON").select(F.col("text").alias("name")).distinct()

    @cached_property
    def lemmas(self) -> DataFrame:
        return self._lemmas(self.person_names) if callable(self._lemmas) else self._lemmas

    @cached_property
    def keys(self) -> DataFrame:
        return self._keep("keys", names.name_keys(self.person_names, self.lemmas))

    @cached_property
    def mentions(self) -> DataFrame:
        return self._keep("mentions", persons.mention_substitutes(
            self.spans, self.keys, self.cfg.shift, self.cfg.order, self.cfg.fold))

    @cached_property
    def persons(self) -> DataFrame:
        return persons.persons(self.mentions.where(F.col("label") == "PERSON"), self.cfg.shift, self.cfg.order,
                               fold=self.cfg.fold)

    def _recognize(self, pcs: DataFrame, recognizer) -> DataFrame:
        labelled = recognizer(pcs)
        if self.cfg.officials:
            labelled = recognize.officials_rule(labelled, None if self.cfg.officials is True else self.cfg.officials)
        return labelled

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a small intermediate table (mentions are a tiny fraction of
        the text) so later stages do not re-plan the token pass; its size is
        then known, so joins with it are broadcast only if it is small."""
        return kept_table(df, f"{self.folder}/{name}") if self.cfg.materialize == "checkpoint" else df

    def discard(self) -> None:
        """Drop the tables of the run (they hold names and substitutes); what
        was derived from them must have been written by then."""
        drop_scratch(self._spark, self.folder)

    @property
    def fmt_tags(self):
        if self.cfg.tags is None:
            return F.col("is_xml")
        return F.lit(bool(self.cfg.tags))

    def touched(self) -> DataFrame:
        """Ids of documents with at least one kept span (small)."""
        return self.spans.select("doc_id").distinct()

    def touched_pieces(self, part: Part) -> DataFrame:
        """The pieces of the part's documents that have mentions, cut without
        offsets. Documents without mentions are not touched at all (F3)."""
        docs = part.source.join(self.touched(), "doc_id", "left_semi")
        if self._seg_input is not None or not self.cfg.clustered:
            docs = docs.repartition(self.n, "doc_id")
        segs = docs if self._seg_input is not None else markup.segments(docs, self.cfg.skip_tagged, part.alone)
        return tokens.pieces(segs, offsets=False)

    def outputs(self, part: Optional[Part] = None) -> DataFrame:
        """Pass 2: piece outputs of the documents (of a part) that have mentions.

        Recognition is not run again: the kept spans are expanded to the
        token positions they cover and joined on (doc_id, run_no, pos)."""
        if part is None:
            return self.over_parts(self.outputs)
        positions = rewrite.span_positions(self.mentions).repartition(self.n, "doc_id")
        return rewrite.emit(self.touched_pieces(part), positions, self.fmt_tags)

    def redacted(self, docs: Optional[DataFrame] = None) -> DataFrame:
        """docs'(doc_id, text, n_mentions): each document spliced in its own
        row, after one left join with the arrays of its mentions. Recognition
        is not run again and no text is cut, exploded or collected; if the
        arrays are too many to broadcast, that join is the one exchange of the
        text (none for a table bucketed by doc_id). ``docs``: those of a part only."""
        if self._seg_input is not None:
            raise ValueError("segment input has no document text to pass through; use outputs()")
        tags = F.col("fmt") == "xml" if self.cfg.tags is None else F.lit(bool(self.cfg.tags))
        return rewrite.rewritten(self.raw_docs if docs is None else docs, rewrite.document_spans(self.mentions), tags)
