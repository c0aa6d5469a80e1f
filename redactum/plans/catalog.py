"""Queries over the test tables: Spark side.

Each entry takes (spark, sf_dir) and returns a DataFrame whose column names
match the DuckDB twin in ``oracle_sql.ORACLES``. Doubles are rounded to 6
places on both sides.
"""

from __future__ import annotations

import functools
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures.lexicon import rule_lemmas
from ..fixtures.model import fragile_model_factory, rule_model_factory
from ..fixtures.plan import fixture_redaction
from ..functions import patterns as PT
from ..functions.names import initials, name_parts
from ..operators import corpus as C
from ..operators import evaluate as EV
from ..operators import ledger as L
from ..operators import names as N
from ..operators import persons as PS
from ..operators import recognize, rewrite, tokens
from ..operators import roster as R
from ..operators import spans as SP
from ..operators.markup import segments as markup_segments
from ..operators.markup import text_runs
from ..session import checkpoint_dir
from ..sources import files as FS
from ..sources import golden as G
from ..sources import tables as T
from ..streaming import jobs as SJ
from ..streaming.lifecycle import Lifecycle
from .failures import redact_isolated
from .pipeline import Config, Redaction

_cache: dict = {}


def redaction(spark: SparkSession, sf_dir: str, kind: str = "text", **cfg) -> Redaction:
    key = (spark.sparkContext.applicationId, sf_dir, kind, tuple(sorted(cfg.items())))
    if key not in _cache:
        docs = T.text_docs(spark, sf_dir) if kind == "text" else T.markup_docs(spark, sf_dir)
        _cache[key] = fixture_redaction(docs, config=Config(**cfg))
    return _cache[key]


def _spans_out(s: DataFrame) -> DataFrame:
    return s.select("doc_id", "run_no", "start", "end", "label", F.round("confidence", 6).alias("confidence"),
                    F.col("n_tokens").cast("long").alias("n_tokens"), "text")


def q_tokens_with_offsets(spark, d):
    return redaction(spark, d).over_parts(lambda p: tokens.tokens(p.segments, p.alone))


def q_markup_runs(spark, d):
    return text_runs(T.markup_docs(spark, d))


def q_preds_joined(spark, d):
    r = redaction(spark, d)
    preds = r.over_parts(lambda p: p.token_labels).where("label <> 'O'").drop("token")
    j = recognize.join_predictions(r.over_parts(lambda p: tokens.pieces(p.segments, offsets=False)).where("is_tok"), preds)
    return j.select("doc_id", "run_no", F.col("pos").alias("tok_no"), "token", "label",
                    F.round("confidence", 6).alias("confidence"))


def q_first_subtoken(spark, d):
    def first(p):
        n_sub = F.greatest(F.ceil(F.length("token") / F.lit(3)), F.lit(1)).cast("int")
        sub = p.token_labels.select("doc_id", "run_no", "tok_no", "label", "confidence",
                                    F.explode(F.sequence(F.lit(0), n_sub - 1)).alias("sub_no"))
        sub = sub.select("doc_id", "run_no", "tok_no", "sub_no",
                         F.when(F.col("sub_no") == 0, F.col("label")).otherwise(F.lit("X")).alias("label"),
                         (F.col("confidence") - F.col("sub_no") * F.lit(0.015625)).alias("confidence"))
        return recognize.first_subtoken(sub, whole=p.alone)

    x = redaction(spark, d).over_parts(first)
    return x.select("doc_id", "run_no", "tok_no", "label", F.round("confidence", 6).alias("confidence"))


def q_spans_decoded(spark, d):
    return _spans_out(redaction(spark, d).spans)


#: words of the invented texts that stand for role words: persons follow them there
TEST_ROLES = ("gnu", "an.")


def q_officials_excluded(spark, d):
    return _spans_out(redaction(spark, d, officials=TEST_ROLES).spans)


def q_chunked_predictions(spark, d):
    def best(p):
        toks = tokens.tokens(p.segments, p.alone)
        return tokens.best_window(tokens.chunk_windows(toks, size=64, overlap=16), p.alone)

    return redaction(spark, d).over_parts(best)


def names_table(spark, d) -> DataFrame:
    ment = redaction(spark, d).spans.where("label = 'PERSON'").select(F.col("text").alias("name"))
    cust = T.table(spark, d, "customer").select(F.col("c_name").alias("name"))
    return ment.union(T.part_names(spark, d).select("name")).union(cust).distinct()


def _lemmas_for(nm: DataFrame) -> DataFrame:
    return rule_lemmas(nm)


def q_name_pair_key(spark, d):
    nm = names_table(spark, d)
    return N.name_keys(nm, _lemmas_for(nm))


def q_best_lemma(spark, d):
    nm = names_table(spark, d)
    words = N.words_of_names(nm)
    return N.best_lemmas(words, _lemmas_for(nm))


def q_titles_stripped(spark, d):
    return names_table(spark, d).select("name", N.clean_name(F.col("name")).alias("clean"))


def q_name_parts(spark, d):
    nm = names_table(spark, d)
    _, n, first, last = name_parts(N.clean_name(F.col("name")))
    return nm.select("name", n.cast("long").alias("n_parts"), first.alias("first"), last.alias("last"))


def q_initials_basic(spark, d):
    return names_table(spark, d).select("name", initials(F.col("name")).alias("initials"))


def q_initials_hyphen(spark, d):
    return (names_table(spark, d).where(F.col("name").contains("-"))
            .select("name", initials(F.col("name")).alias("initials")))


def q_initials_shifted(spark, d):
    return names_table(spark, d).select("name", initials(F.col("name"), 2).alias("ini2"),
                                        initials(F.col("name"), 7).alias("ini7"))


def q_same_person(spark, d):
    p = T.part_names(spark, d)
    pairs = p.select(F.col("p_name").alias("a"), F.col("name").alias("b"), "p_partkey")
    nm = p.select(F.col("p_name").alias("name")).union(p.select("name")).distinct()
    keys = N.name_keys(nm, _lemmas_for(nm))
    return N.same_person(pairs, keys).select("p_partkey", "a", "b", "key_a", "key_b", "same")


def q_persons_numbered(spark, d):
    return redaction(spark, d).persons.select("doc_id", "person_key", "initials", "k",
                                              F.col("n_same").cast("long").alias("n_same"),
                                              F.col("n_mentions").cast("long").alias("n_mentions"), "substitute")


def q_substitutes(spark, d):
    return redaction(spark, d).mentions.select("doc_id", "run_no", "start", "label", "substitute")


def q_redacted_text(spark, d):
    return redaction(spark, d).redacted()


def q_redacted_markup(spark, d):
    return redaction(spark, d, kind="markup").redacted()


def q_mentions_parsed(spark, d):
    return rewrite.parse_mentions(redaction(spark, d, kind="markup").redacted())


def q_tagged_to_plain(spark, d):
    r = redaction(spark, d, kind="markup").redacted()
    return r.select("doc_id", rewrite.tagged_to_plain(F.col("text")).alias("text"))


def q_clean_text(spark, d):
    r = redaction(spark, d, kind="markup").redacted()
    return r.select("doc_id", rewrite.clean_text(F.col("text")).alias("clean"))


def q_doc_counts(spark, d):
    r = redaction(spark, d)
    n_m = r.spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    n_p = r.persons.groupBy("doc_id").agg(F.count_distinct("person_key").alias("n_persons"))
    docs = r.docs.select("doc_id")
    return (docs.join(n_m, "doc_id", "left").join(n_p, "doc_id", "left")
            .select("doc_id", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"),
                    F.coalesce("n_persons", F.lit(0)).alias("n_persons")))


# ---- ledger, cases, rosters ------------------------------------------------

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _latest(spark, d):
    return L.latest(T.ledger(spark, d))


def q_ledger_latest(spark, d):
    x = _latest(spark, d)
    return x.select("doc_id", "status", F.date_format("ts", TS_FMT).alias("ts"), "n_events")


def q_ledger_subset(spark, d):
    return L.subsets(_latest(spark, d), L.resolve_requests(T.ledger(spark, d), _requests(spark, d)))


def _case_docs(spark, d):
    return T.text_docs(spark, d).select("doc_id", "case_id")


def q_todo_docs(spark, d):
    return L.todo(_case_docs(spark, d), _latest(spark, d))


def q_published_only(spark, d):
    lat = _latest(spark, d)
    docs = L.publish(T.text_docs(spark, d), lat)
    red = fixture_redaction(docs).redacted()
    return L.publish(red, lat).select("doc_id", "n_mentions", F.length("text").alias("n_chars"))


def q_erase_outcome(spark, d):
    sel = T.table(spark, d, "labels").select("doc_id")
    return L.erase(sel, _latest(spark, d))


def _requests(spark, d):
    e = T.table(spark, d, "events")
    req = F.when(F.col("value") > 45, F.lit("stop")).when(F.col("value") < 3, F.lit("retry"))
    return e.select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), req.alias("request")).where(
        F.col("request").isNotNull())


def q_ledger_resolved(spark, d):
    return L.resolve_requests(T.ledger(spark, d), _requests(spark, d))


def q_overdue_docs(spark, d):
    led = T.ledger(spark, d)
    asof = led.select(F.max("ts")).scalar()
    x = L.overdue(L.latest(led), asof)
    return x.select("doc_id", F.date_format("ts", TS_FMT).alias("ts"), F.col("age_s").cast("long").alias("age_s"))


def q_throughput_hourly(spark, d):
    x = L.throughput(T.ledger(spark, d))
    return x.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("w_start"), "n",
                    F.round("avg_s", 6).alias("avg_s"))


def q_case_sessions(spark, d):
    led = T.ledger(spark, d).join(_case_docs(spark, d), "doc_id", "left")
    x = L.sessions(led, "case_id")
    return x.select("case_id", F.date_format("s.start", TS_FMT).alias("s_start"),
                    F.date_format("s.end", TS_FMT).alias("s_end"), "n")


def q_docs_by_day_status(spark, d):
    return L.by_day_status(T.ledger(spark, d)).select("day", "status", "n", F.col("gid").cast("long").alias("gid"))


REMOVED_CASES = ["src3", "src7"]


def q_docs_with_case(spark, d):
    docs = _case_docs(spark, d)
    cases = docs.select("case_id").distinct().where(~F.col("case_id").isin(REMOVED_CASES))
    x = docs.withColumnRenamed("case_id", "c").join(cases, F.col("c") == F.col("case_id"), "left")
    return x.select("doc_id", "case_id")


def _doc_rosters(spark, d):
    r = redaction(spark, d)
    dr = R.doc_roster(r.persons)
    return dr.join(_case_docs(spark, d), "doc_id").withColumn("seq", F.col("doc_id"))


def _case_roster(spark, d):
    return R.merge_case_roster(_doc_rosters(spark, d))


def _part_rosters(spark, d):
    """Rosters of documents of part names: a person is the first word of the name, so documents share persons."""
    p = T.part_names(spark, d)
    doc = F.floor(F.col("p_partkey") / 50).cast("long")
    m = p.select(doc.alias("doc_id"), F.lit(0).alias("run_no"), F.col("p_partkey").alias("start"), F.col("name").alias("text"),
                 F.substring_index(F.lower("p_name"), " ", 1).alias("person_key"))
    return R.doc_roster(PS.persons(m)).withColumn("case_id", F.col("doc_id") % 5)


def q_roster_by_completion(spark, d):
    """G7, merged view: of all documents that were ever done, the last completion wins."""
    return R.merge_case_roster(R.completed(_part_rosters(spark, d), T.ledger(spark, d)), "done")


def q_roster_current(spark, d):
    """G7, current view: documents whose latest state is done."""
    return R.merge_case_roster(R.completed(_part_rosters(spark, d), T.ledger(spark, d), current=True), "done")


def q_doc_roster(spark, d):
    return R.doc_roster(redaction(spark, d).persons)


def q_case_roster(spark, d):
    return _case_roster(spark, d)


def _removals(spark, d):
    cr = _case_roster(spark, d)
    first = F.substring("person_key", 1, 1)
    hit = cr.where(first < "m").select("case_id", "person_key")
    miss = cr.where(first >= "m").select("case_id", F.concat("person_key", F.lit(" x")).alias("person_key"))
    return hit.union(miss).withColumn("seq", F.lit(10 ** 12))


def q_roster_after_remove(spark, d):
    log = R.roster_log(_doc_rosters(spark, d), _removals(spark, d))
    return R.current_roster(log)


def q_removal_found(spark, d):
    return R.removal_found(_case_roster(spark, d), _removals(spark, d))


def q_roster_json(spark, d):
    return R.roster_json(_case_roster(spark, d))


def q_roster_sorted(spark, d):
    return R.sorted_roster(_case_roster(spark, d))


def q_case_summary(spark, d):
    return L.case_summary(_case_docs(spark, d), _latest(spark, d), _case_roster(spark, d))


def q_newest_per_case(spark, d):
    created = T.ledger(spark, d).groupBy("doc_id").agg(F.min("ts").alias("created"))
    return L.newest_per_case(_case_docs(spark, d), created, 3).select("case_id", "doc_id", "rn")


def q_run_summary(spark, d):
    """Documents, mentions, persons and initials of the run; of the ledger's
    documents how many are done, and the seconds from its first event to its last."""
    r = redaction(spark, d)
    none = lambda t: F.lit(None).cast(t)
    parts = [
        r.redacted().select("doc_id", "n_mentions", none("string").alias("initials"), none("string").alias("status"), none("timestamp_ntz").alias("ts")),
        r.persons.select("doc_id", none("long").alias("n_mentions"), "initials", none("string").alias("status"), none("timestamp_ntz").alias("ts")),
        L.latest(T.ledger(spark, d)).select("doc_id", none("long").alias("n_mentions"), none("string").alias("initials"), "status", "ts"),
        T.ledger(spark, d).select("doc_id", none("long").alias("n_mentions"), none("string").alias("initials"), none("string").alias("status"), "ts")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return rows.agg(F.count("n_mentions").alias("n_docs"), F.sum("n_mentions").alias("n_mentions"),
                    F.count("initials").alias("n_persons"), F.count_distinct("doc_id", "initials").alias("n_initials"),
                    F.count("status").alias("n_total"), F.count_if(F.col("status") == "done").alias("n_ok"),
                    (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("elapsed_s"))


def q_persons_numbered_case(spark, d):
    r = redaction(spark, d)
    m = r.mentions.where("label = 'PERSON'").join(_case_docs(spark, d), "doc_id")
    return PS.case_persons(m).select("case_id", "person_key", "initials", "k",
                                     F.col("n_same").cast("long").alias("n_same"), "substitute")


def _part_mentions(spark, d):
    """Mentions of part names, fifty to a document, five cases: many persons share their initials."""
    p = T.part_names(spark, d)
    doc = F.floor(F.col("p_partkey") / 50).cast("long")
    return p.select(doc.alias("doc_id"), (doc % 5).alias("case_id"), F.lit(0).alias("run_no"), F.col("p_partkey").alias("start"),
                    F.col("name").alias("text"), F.lower("name").alias("person_key"))


def q_parts_numbered(spark, d):
    return PS.persons(_part_mentions(spark, d)).select(
        "doc_id", "person_key", "initials", "k", F.col("n_same").cast("long").alias("n_same"),
        F.col("n_mentions").cast("long").alias("n_mentions"), "substitute")


def q_parts_numbered_case(spark, d):
    return PS.case_persons(_part_mentions(spark, d)).select(
        "case_id", "person_key", "initials", "k", F.col("n_same").cast("long").alias("n_same"), "substitute")


# ---- evaluation and corpus ---------------------------------------------------

DIGITS9 = "[0-9]{9,}"


def golden_files(spark, d):
    """One golden file per document: each non-blank line is a case; the
    expected output redacts 9+ digit runs only, else NO_CHANGE."""
    docs = T.table(spark, d, "documents")
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line")).where(
        F.col("line").rlike(PT.NOT_SPACE))
    case = F.concat(F.lit('ANONYMIZE("'), F.col("line"), F.lit('") = '),
                    F.when(F.col("line").rlike(DIGITS9),
                           F.concat(F.lit('"'), F.regexp_replace("line", DIGITS9, "(...)"), F.lit('"')))
                    .otherwise(F.lit("NO_CHANGE")))
    g = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ln", case.alias("c")))).alias("cs"))
    return g.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".test")).alias("file"),
                    F.array_join(F.col("cs.c"), "\n").alias("content"))


def _golden_cases(spark, d):
    return G.read_cases(golden_files(spark, d))


def q_golden_cases(spark, d):
    c = _golden_cases(spark, d)
    return c.select("file", "case_no", "input", F.array_join("expected", " | ").alias("expected"), "no_change")


def _verdicts(spark, d):
    cases = _golden_cases(spark, d)
    case_id = F.concat(F.col("case_no").cast("string"), F.lit("#"), F.col("file"))
    docs = cases.select(case_id.alias("doc_id"), F.col("input").alias("text"), F.lit("txt").alias("fmt"))
    out = fixture_redaction(docs).redacted()
    out = out.select(F.substring_index("doc_id", "#", 1).cast("int").alias("case_no"),
                     F.regexp_replace("doc_id", "^[0-9]+#", "").alias("file"), "text", "n_mentions")
    return EV.verdicts(cases, out)


def q_golden_verdicts(spark, d):
    return _verdicts(spark, d)


def q_golden_rollup(spark, d):
    return EV.totals(_verdicts(spark, d))


def q_span_metrics(spark, d):
    gold = redaction(spark, d, threshold=0.6).spans
    pred = redaction(spark, d).spans
    return EV.span_metrics(gold, pred)


def _examples(spark, d):
    r = redaction(spark, d)
    return r.over_parts(lambda p: C.run_examples(p.segments, r.spans) if p.alone else C.bio_examples(C.bio_tags(p.marked, r.spans)))


def q_bio_dataset(spark, d):
    ex = _examples(spark, d)
    return ex.select("doc_id", "run_no", F.size("tokens").cast("long").alias("n_tokens"),
                     F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


def _tagged_examples(spark, d):
    """Examples of the tagged documents, the labels of their mentions by number."""
    r = redaction(spark, d, tags=True)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("run_no", "start"))
    labels = r.spans.select("doc_id", n.alias("mention"), "label")
    return r.over_parts(lambda p: C.tagged_examples(r.redacted(p.source), labels, p.alone))


def q_bio_from_tags(spark, d):
    """Training examples from tagged output, aligned with the source text."""
    ex = _tagged_examples(spark, d)
    return ex.select("doc_id", "text", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"),
                     F.array_join(F.transform("starts", lambda x: x.cast("string")), " ").alias("starts"),
                     F.array_join("labels", " ").alias("labels"))


def q_bio_json(spark, d):
    """The same examples written as JSON lines and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/bio-{uuid.uuid4().hex}"
    C.write_bio(_tagged_examples(spark, d), path)
    ex = C.read_bio(spark, path)
    return ex.select("text", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("labels", " ").alias("labels"))


def q_split_80_20(spark, d):
    ex = _examples(spark, d).select("doc_id", "run_no")
    return C.split_by_document(ex, 80, key="mod")


def q_redaction_diff(spark, d):
    r = redaction(spark, d)
    return r.over_parts(lambda p: EV.change_set(r.outputs(p).drop("opens"), None if p.alone else r.touched_pieces(p)))


def q_leak_audit(spark, d):
    r = redaction(spark, d)
    kept = r.spans.select("doc_id", "run_no", "span")
    span_toks = r.span_tokens.join(kept, ["doc_id", "run_no", "span"])
    # a document without kept spans has no tokens to look for
    red = r.redacted().join(r.touched(), "doc_id", "left_semi").select("doc_id", "text", F.lit("txt").alias("fmt"))
    out_toks = tokens.pieces(markup_segments(red)).where("is_tok")
    return EV.leak_audit(span_toks, out_toks)


# ---- sources, failures, streams -----------------------------------------------

def _named(spark, d):
    docs = T.table(spark, d, "documents")
    sfx = (F.when(F.pmod("doc_id", F.lit(10)) == 3, F.lit(".pdf")).when(F.pmod("doc_id", F.lit(10)) == 7, F.lit(".XML"))
           .otherwise(F.lit(".txt")))
    return docs.select("doc_id", "source", "text", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), sfx).alias("name"))


def q_admission(spark, d):
    # every tenth document ends in a byte that UTF-8 does not have
    tail = F.when(F.pmod("doc_id", F.lit(10)) == 9, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    f = _named(spark, d).select("doc_id", "name", F.concat(F.encode("text", "UTF-8"), tail).alias("content"))
    return FS.admission(f).select("doc_id", "name", "size", "status", "reason")


def _assigned(spark, d):
    docs = T.table(spark, d, "documents")
    man = docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("source")).alias("case_id"),
                      F.when(F.pmod("doc_id", F.lit(5)) == 0,
                             F.concat(F.lit(" case-"), F.pmod("doc_id", F.lit(17)).cast("string"), F.lit(" ")))
                      .otherwise(F.lit("")).alias("new_case_id"))
    cases = docs.select(F.col("source").alias("case_id")).distinct()
    return FS.assign_cases(man, cases)


def q_case_assignment(spark, d):
    return _assigned(spark, d)


def q_new_cases(spark, d):
    """Cases that the manifest creates, each once."""
    return FS.new_cases(_assigned(spark, d))


def q_result_names(spark, d):
    return _named(spark, d).select("doc_id", FS.result_name(F.col("name")).alias("result_name"))


def q_doc_formats(spark, d):
    """The mode of a document from its name's suffix, and its run under it."""
    docs = _named(spark, d).select("doc_id", "name", FS.fmt_of(F.col("name")).alias("fmt"), "text")
    runs = markup_segments(docs).where("is_run").groupBy("doc_id").agg(F.count("*").alias("n_runs"))
    return docs.join(runs, "doc_id", "left").select("doc_id", "name", "fmt", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def q_sources_union(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", F.lit("document").alias("kind"), F.length("text").alias("n_chars"))
    conv = (T.table(spark, d, "conversations").groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
            .select(F.col("conv_id").alias("doc_id"), F.lit("conversation").alias("kind"),
                    F.length(F.array_join(F.col("t.text"), "\n")).alias("n_chars")))
    return docs.unionByName(conv)


def q_failures_isolated(spark, d):
    """A model that raises on some documents, one row without text and one with a NUL character."""
    docs = T.text_docs(spark, d).select("doc_id", "text", "fmt")
    odd = spark.createDataFrame([(-1, None, "txt"), (-2, "nul\u0000byte", "txt")], "doc_id long, text string, fmt string")
    x = redact_isolated(docs.unionByName(odd), rule_lemmas, fragile_model_factory)
    return x.select("doc_id", "status", F.substring_index("error", "\n", 1).alias("error"),
                    F.coalesce(F.contains("error", F.lit("Traceback")), F.lit(False)).alias("has_trace"), "n_mentions")


def _lifecycle(spark, d) -> Lifecycle:
    """The lifecycle of all documents: some asked to stop before they are
    claimed, some while they are worked, some deleted meanwhile, and a model that raises on some."""
    key = (spark.sparkContext.applicationId, d, "lifecycle")
    if key not in _cache:
        e = T.table(spark, d, "events").where("value > 220")
        stop = e.select(F.col("user_id").alias("doc_id"), F.lit("stop").alias("request"), F.lit(0).cast("long").alias("seq"))
        gone = (T.table(spark, d, "labels").where("toxic = 1")
                .select("doc_id", F.lit("delete").alias("request"), F.lit(0).cast("long").alias("seq")))
        views = itertools.cycle([stop.where("event_id % 2 = 0"), stop.unionByName(gone)])  # at the claim, at the recheck
        docs = SJ.document_stream(spark, d).select(
            "doc_id", F.col("source").alias("case_id"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("name"), "text")
        path = f"{checkpoint_dir(spark).rstrip('/')}/streams/lifecycle-{uuid.uuid4().hex[:12]}"
        _cache[key] = Lifecycle(spark, path, rule_lemmas, fragile_model_factory, lambda: next(views)).run(docs)
    return _cache[key]


def q_lifecycle_results(spark, d):
    return _lifecycle(spark, d).results().select("run_id", "doc_id", "result_name", "text")


def q_lifecycle_ledger(spark, d):
    return _lifecycle(spark, d).ledger().select(
        "doc_id", "case_id", "seq", "step", "attempt", "status", "entity_count", "person_count",
        F.substring_index("error", "\n", 1).alias("error"))


def q_lifecycle_roster(spark, d):
    return _lifecycle(spark, d).roster()


def q_stream_redact(spark, d):
    out = SJ.redact_stream(spark, d, fixture_redaction)
    return spark.read.parquet(out).select("doc_id", "text", "n_mentions")


def q_stream_dedup(spark, d):
    return SJ.dedup_stream(spark, d).read("accepted").select("doc_id", F.date_format("ts", TS_FMT).alias("ts"), "event_id")


def q_stream_throughput(spark, d):
    x = SJ.current_throughput(spark.read.parquet(SJ.throughput_stream(spark, d)))
    return x.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("w_start"), "n",
                    F.round("avg_s", 6).alias("avg_s"))


def q_stream_roster(spark, d):
    return SJ.roster_stream(spark, d, fixture_redaction).read("roster").select("case_id", "person_key", "initials")


# ---- more inventory items ------------------------------------------------------

LABEL_LIST = ["O", "B-PERSON", "I-PERSON", "B-LOCATION", "B-SENSITIVE", "B-PRODUCT", "I-PRODUCT", "MAIL"]


def q_spans_trimmed(spark, d):
    """P3 on external spans: decoded spans padded with a space on each side."""
    s = redaction(spark, d).spans
    ext = s.select("doc_id", "run_no", (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"), "label",
                   F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("text"))
    return SP.trim_spans(ext).select("doc_id", "run_no", "start", "end", "label", "text")


def q_initials_frequency(spark, d):
    """Persons (not mentions) per initials in each document."""
    return (redaction(spark, d).persons.groupBy("doc_id", "initials")
            .agg(F.count(F.lit(1)).alias("n_persons"), F.sum("n_mentions").alias("n_mentions")))


def q_preds_from_label_map(spark, d):
    """Predicted label ids mapped through a label-map JSON."""
    lab = redaction(spark, d).over_parts(lambda p: p.token_labels)
    ids = F.array_position(F.array(*[F.lit(x) for x in LABEL_LIST]), F.col("label")) - 1
    pred_ids = lab.select("doc_id", "run_no", "tok_no", ids.cast("int").alias("label_id"), "confidence")
    js = "{\"id2label\": {" + ", ".join(f'\"{i}\": \"{x}\"' for i, x in enumerate(LABEL_LIST)) + "}}"
    m = spark.createDataFrame([(js,)], "json string")
    out = recognize.apply_label_map(pred_ids, m)
    return out.where("label <> 'O'").select("doc_id", "run_no", "tok_no", "label_id", "label",
                                            F.round("confidence", 6).alias("confidence"))


def q_spans_model_hosted(spark, d):
    """X1(c): the same rule as a Python model hosted in mapInArrow."""
    docs = T.text_docs(spark, d)
    return _spans_out(fixture_redaction(docs, recognizer=recognize.hosted_model(rule_model_factory)).spans)


def _turn_segments(spark, d):
    c = T.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seg_no"),
                    F.coalesce("text", F.lit("")).alias("seg"), F.lit(False).alias("is_xml"), F.lit(True).alias("is_run"))


def person_terms(spark, d):
    """A term list learnt from the documents: tokens of PERSON spans."""
    r = redaction(spark, d)
    person = r.spans.where("label = 'PERSON'").select("doc_id", "run_no", "span")
    toks = r.span_tokens.where("is_tok").join(person, ["doc_id", "run_no", "span"]).select(F.col("token").alias("term")).distinct()
    return toks.select("term", F.lit("B-PERSON").alias("label"), F.lit(0.9).alias("confidence"))


def benchmark_terms(spark, d):
    """Terms of three, two and one words: the first tokens of the benchmark's passages."""
    toks = F.regexp_extract_all("text", F.lit(PT.TOKEN_WITH_TRAIL_JAVA), F.lit(1))
    kinds = [(1, 3, "PRODUCT", 0.9), (4, 2, "LOCATION", 0.85), (6, 1, "PERSON", 0.8)]
    rows = F.array(*[F.struct(F.slice("t", a, n).alias("w"), F.lit(n).alias("n"), F.lit(lab).alias("label"), F.lit(c).alias("confidence"))
                     for a, n, lab, c in kinds])
    x = T.table(spark, d, "benchmark").select(toks.alias("t")).select(F.explode(rows).alias("x"))
    return x.where("size(x.w) = x.n").select(F.array_join("x.w", " ").alias("term"), "x.label", "x.confidence")


def q_terms_matched(spark, d):
    """X1(b): spans of a term list with terms of one to three words."""
    rec = recognize.term_list(benchmark_terms(spark, d))
    return _spans_out(fixture_redaction(T.text_docs(spark, d), recognizer=rec).spans)


def q_conversation_substitutes(spark, d):
    """Conversations whose turns are runs, recognised with the term list
    (X1b); one numbering per conversation."""
    terms = person_terms(spark, d)
    rec = lambda p: recognize.gazetteer_labels(p, terms)
    r = fixture_redaction(None, segments=_turn_segments(spark, d), recognizer=rec, rowwise=True)
    return r.mentions.select(F.col("doc_id").alias("conv_id"), F.col("run_no").alias("turn"), "start", "label", "substitute")


def q_stream_ledger(spark, d):
    """T3 as a stream: latest status per document."""
    return SJ.latest_status_stream(spark, d).read("latest").select("doc_id", F.col("event_type").alias("last_event"))


def q_throughput_sliding(spark, d):
    x = L.throughput(T.ledger(spark, d), "1 hour", "30 minutes")
    return x.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("w_start"), "n",
                    F.round("avg_s", 6).alias("avg_s"))


def q_token_accuracy(spark, d):
    g = redaction(spark, d, threshold=0.6)
    p = redaction(spark, d)

    def agreement(gold, pred):
        if not gold.alone:
            return EV.agreement(C.bio_tags(gold.marked, g.spans), C.bio_tags(pred.marked, p.spans))
        runs = tokens.run_tokens(gold.segments).select("doc_id", F.col("seg_no").alias("run_no"), "tokens")
        return EV.run_agreement(C.tag_runs(C.tag_runs(runs, g.spans, "gold"), p.spans, "pred"))

    parts = [agreement(*x) for x in zip(g.parts, p.parts, strict=True)]
    return EV.token_accuracy(functools.reduce(DataFrame.unionByName, parts))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
