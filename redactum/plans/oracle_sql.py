"""DuckDB twins of the catalog queries (the correctness oracle).

Each query is written the plain relational way (unnest, window, join,
group) with the same regular expressions as the Spark side; RE2 lacks
look-behind, so title stripping captures and re-emits the preceding
character. Tables are the pre-registered views of the test data.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..fixtures.rules import PREPOSITIONS
from ..operators.names import CASES
from ..sources.golden import CASE_PATTERN
from ..sources.tables import PART_NAMES_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(P.EDGE_SPACE)}, '', 'g')"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(P.SPACE_RUN)}), lambda s: s <> '')"


def letter(x: str, shift: int) -> str:
    first = f"upper(substring({x}, 1, 1))"
    if shift <= 0:
        return first
    return (f"chr(65 + (((ascii(translate({first}, {q(P.FOLD_FROM)}, {q(P.FOLD_TO)})) - 65 + {shift}) % 26) + 26) % 26)")


def initials(x: str, shift: int = 0) -> str:
    parts = split_ws(x)
    return f"""(SELECT CASE WHEN n = 0 THEN 'X.'
        WHEN n = 1 THEN {letter('p[1]', shift)} || '.'
        WHEN hyph IS NOT NULL THEN {letter('p[1]', shift)} || '. ' || coalesce(CASE WHEN sur IS NOT NULL AND {strip('sur')} <> '' THEN {letter('sur', shift)} END, 'X') || '.'
        ELSE {letter('p[1]', shift)} || '. ' || {letter('p[n]', shift)} || '.' END
      FROM (SELECT p, n, hyph,
              CASE WHEN split_part(hyph, '-', 1) <> '' THEN split_part(hyph, '-', 1)
                   WHEN n > 2 AND list_position(p, hyph) - 1 > 1 THEN p[list_position(p, hyph) - 1] END AS sur
            FROM (SELECT p, len(p) AS n,
                    list_filter(list_slice(p, 2, len(p)), lambda s: contains(s, '-'))[1] AS hyph
                  FROM (SELECT {parts} AS p))))"""


def clean_name(x: str) -> str:
    s1 = f"regexp_replace({strip(x)}, {q(P.TITLES_1_RE2)}, '\\1', 'gi')"
    s2 = f"regexp_replace({s1}, {q(P.TITLES_2_RE2)}, '\\1', 'gi')"
    return strip(s2)


def inlist(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


CAP3 = r"^\p{Lu}\p{Ll}{2,}$"
CAPS = r"^\p{Lu}{3,}$"


def docs_txt() -> str:
    return "SELECT doc_id, text, 'txt' AS fmt FROM documents"


def docs_xml() -> str:
    return "SELECT page_id AS doc_id, html AS text, 'xml' AS fmt FROM pages"


def segments_cte(docs_sql: str, skip_tagged: bool = True) -> str:
    lags = " || ".join(f"coalesce(lag(seg, {i}) OVER w, '')" for i in range(11, 1, -1))
    tagged = "AND NOT coalesce(regexp_matches(lag(seg, 2) OVER w, '^xAnon(\\s|$)'), false)" if skip_tagged else ""
    return f"""
d AS ({docs_sql}),
xs AS (
  SELECT doc_id, fmt = 'xml' AS is_xml,
    CASE WHEN fmt = 'xml' AND len(regexp_extract_all(text, {q(P.MARKUP_PIECE)}, 0)) > 0
         THEN regexp_extract_all(text, {q(P.MARKUP_PIECE)}, 0) ELSE [coalesce(text, '')] END AS arr
  FROM d),
xp AS (SELECT doc_id, is_xml, unnest(arr) AS seg, generate_subscripts(arr, 1) - 1 AS seg_no FROM xs),
segs AS (
  SELECT doc_id, seg_no, seg, is_xml,
    CASE WHEN NOT is_xml THEN true ELSE coalesce(
      seg NOT IN ('<', '>') AND lag(seg) OVER w = '>' AND lead(seg) OVER w = '<'
      AND regexp_matches(seg, {q(P.NOT_SPACE)})
      AND NOT ends_with(regexp_replace(right({lags}, 10), {q(P.TRAILING_SPACE)}, ''), '="')
      {tagged}, false) END AS is_run
  FROM xp WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no))"""


def pieces_cte() -> str:
    return f"""
ta AS (
  SELECT doc_id, seg_no AS run_no, is_xml, seg, is_run,
    regexp_extract_all(seg, {q(P.TOKEN_WITH_TRAIL)}, 1) AS toks,
    regexp_extract_all(seg, {q(P.TOKEN_WITH_TRAIL)}, 2) AS trails
  FROM segs),
tb AS (
  SELECT doc_id, run_no, is_xml, is_run AND len(toks) > 0 AS is_tok,
    CASE WHEN is_run AND len(toks) > 0 THEN regexp_extract(seg, {q(P.LEADING_SPACE)}, 0) ELSE '' END AS lead0,
    CASE WHEN is_run AND len(toks) > 0 THEN toks ELSE [seg] END AS t1,
    CASE WHEN is_run AND len(toks) > 0 THEN trails ELSE [''] END AS t2
  FROM ta),
tc AS (SELECT doc_id, run_no, is_xml, is_tok, lead0, unnest(t1) AS token, unnest(t2) AS trail,
         generate_subscripts(t1, 1) - 1 AS pos FROM tb),
pieces AS (
  SELECT doc_id, run_no, pos, is_xml, is_tok, CASE WHEN pos = 0 THEN lead0 ELSE '' END AS lead, token, trail,
    CAST(length(lead0) + sum(length(token) + length(trail)) OVER (PARTITION BY doc_id, run_no ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(token) - length(trail) AS INTEGER) AS start
  FROM tc),
pieces2 AS (SELECT *, CAST(start + length(token) AS INTEGER) AS "end" FROM pieces)"""


def labels_cte(officials=()) -> str:
    """``officials``: role words after which persons stay clear, if any."""
    s = f"""
lw AS (SELECT *, lag(token) OVER w AS prev, lead(token) OVER w AS nxt, lag(token, 2) OVER w AS prev2
       FROM pieces2 WINDOW w AS (PARTITION BY doc_id, run_no ORDER BY pos)),
lab0 AS (
  SELECT doc_id, run_no, pos, is_xml, is_tok, lead, token, trail, start, "end", prev, prev2,
    CASE WHEN NOT is_tok THEN 'O'
      WHEN regexp_matches(token, '^[0-9]{{9,}}$') THEN 'B-SENSITIVE'
      WHEN regexp_matches(token, {q(CAPS)}) AND nxt = 'License' THEN 'B-PRODUCT'
      WHEN token = 'License' AND regexp_matches(prev, {q(CAPS)}) THEN 'I-PRODUCT'
      WHEN regexp_matches(token, {q(CAP3)}) AND regexp_matches(prev, {q(CAP3)}) THEN 'I-PERSON'
      WHEN regexp_matches(token, {q(CAP3)}) AND regexp_matches(nxt, {q(CAP3)}) THEN 'B-PERSON'
      WHEN regexp_matches(token, {q(CAP3)}) AND prev IN {inlist(PREPOSITIONS)} THEN 'B-LOCATION'
      WHEN token = '@' THEN 'MAIL' ELSE 'O' END AS label,
    CASE WHEN is_tok THEN CAST(0.5 AS DOUBLE) + (length(token) % 5) * CAST(0.125 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence
  FROM lw)"""
    if not officials:
        return s + ",\nlab AS (SELECT * FROM lab0)"
    roles = inlist([r.lower() for r in officials])
    return s + f""",
lo1 AS (SELECT *, coalesce(label = 'B-PERSON' AND (lower(prev) IN {roles} OR lower(prev2) IN {roles}), false) AS official,
          sum(CASE WHEN label <> 'I-PERSON' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run_no ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM lab0),
lo2 AS (SELECT *, max(official) OVER (PARTITION BY doc_id, run_no, grp) AS off2 FROM lo1),
lab AS (SELECT doc_id, run_no, pos, is_xml, is_tok, lead, token, trail, start, "end",
          CASE WHEN off2 THEN 'O' ELSE label END AS label, confidence FROM lo2)"""


def spans_cte(threshold: float = 0.7) -> str:
    return f"""
m1 AS (SELECT *, CASE WHEN label = 'O' OR confidence < {threshold} THEN 'O' ELSE label END AS eff FROM lab),
m2 AS (SELECT *, CASE WHEN eff = 'O' THEN 'O' WHEN starts_with(eff, 'B-') THEN 'B'
                      WHEN starts_with(eff, 'I-') THEN 'I' ELSE 'T' END AS kind FROM m1),
m3 AS (SELECT *, CASE WHEN kind IN ('B', 'I') THEN substring(label, 3) END AS etype FROM m2),
m4 AS (SELECT *, CASE WHEN kind = 'O' THEN '#O#' ELSE etype END AS state FROM m3),
m5 AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY doc_id, run_no ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_state FROM m4),
m6 AS (SELECT *, (kind = 'B' OR (kind = 'I' AND (prev_state IS NULL OR prev_state <> etype))) AS is_start FROM m5),
m7 AS (SELECT *, sum(CAST(is_start AS INTEGER)) OVER (PARTITION BY doc_id, run_no ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span_no FROM m6),
m8 AS (SELECT *, CASE WHEN kind IN ('B', 'I') THEN span_no WHEN kind = 'O' THEN -1 END AS key FROM m7),
m9 AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id, run_no ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_key,
          lead(key IGNORE NULLS) OVER (PARTITION BY doc_id, run_no ORDER BY pos) AS next_key FROM m8),
marked AS (SELECT *, CAST(CASE WHEN key >= 0 THEN key
                 WHEN key IS NULL AND prev_key = next_key AND prev_key >= 0 THEN prev_key END AS INTEGER) AS span FROM m9),
spans AS (
  SELECT doc_id, run_no, span, min(start) AS start, max("end") AS "end", max(etype) AS label,
    avg(CASE WHEN kind IN ('B', 'I') THEN confidence END) AS confidence,
    count(CASE WHEN kind IN ('B', 'I') THEN 1 END) AS n_tokens, min(pos) AS first_pos, max(pos) AS last_pos,
    left(string_agg(token || trail, '' ORDER BY pos), max("end") - min(start)) AS text
  FROM marked WHERE span IS NOT NULL GROUP BY doc_id, run_no, span
  HAVING avg(CASE WHEN kind IN ('B', 'I') THEN confidence END) >= {threshold} AND max(etype) <> '')"""


def fixture_lemmas_sql(words: str) -> str:
    stem = "substring(word, 1, length(word) - 1)"
    rules = [
        ("lower(word) LIKE '%a'", 0, stem, "subst:sg:gen:m1"),
        ("lower(word) LIKE '%a'", 1, "word || ':Sf'", "subst:sg:nom:f"),
        ("lower(word) LIKE '%a'", 2, "word", "adj:sg:nom:f:pos"),
        ("lower(word) LIKE '%e'", 0, "word", "adj:sg:nom:n:pos"),
        ("lower(word) LIKE '%e'", 1, f"{stem} || 'a'", "subst:sg:loc:f"),
        ("lower(word) LIKE '%e'", 2, stem, "subst:pl:nom:m1"),
        ("regexp_matches(lower(word), '[nrzh]$')", 0, "word", "subst:sg:nom:m1"),
        ("regexp_matches(lower(word), '[nrzh]$')", 1, "word || 'a'", "subst:pl:gen:f"),
        ("regexp_matches(lower(word), '[iy]$')", 0, "word", "subst:pl:nom:m1"),
        ("regexp_matches(lower(word), '[iy]$')", 1, "word", "subst:sg:gen:f"),
        ("lower(word) LIKE '%s'", 0, "word", "verb:fin:sg:ter"),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT word AS orth, {o} AS ord, {l} AS lemma, {q(t)} AS tag FROM (SELECT DISTINCT word FROM {words}) WHERE {c}"
        for c, o, l, t in rules)


def name_keys_cte(names: str) -> str:
    """names: a CTE/table with column name -> keys(name, first, last, person_key)."""
    case_expr = "CASE " + " ".join(f"WHEN contains(tag, ':{c}') THEN '{c}'" for c in CASES) + " END"
    return f"""
nk0 AS (SELECT DISTINCT name FROM {names}),
nk1 AS (SELECT name, {split_ws(clean_name('name'))} AS parts FROM nk0),
nk2 AS (SELECT name, parts, len(parts) AS n_parts, parts[1] AS w_first,
          CASE WHEN len(parts) >= 2 THEN parts[-1] END AS w_last FROM nk1),
nwords AS (SELECT DISTINCT unnest(parts) AS word FROM nk1),
lemmas AS ({fixture_lemmas_sql('nwords')}),
bw AS (SELECT word FROM nwords),
bl0 AS (SELECT b.word, l.ord, l.lemma, l.tag, coalesce(starts_with(l.tag, 'subst'), false) AS noun
        FROM (SELECT DISTINCT word FROM bw WHERE word IS NOT NULL) b LEFT JOIN lemmas l ON l.orth = b.word),
bl AS (SELECT word, CASE WHEN lemma IS NULL AND ord IS NULL THEN lower(word) ELSE lower(split_part(lemma, ':', 1)) END AS best
       FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY noun DESC,
               CASE WHEN noun THEN CAST(contains(tag, ':sg:') AS INTEGER) * 2 + CAST(contains(tag, ':nom:') AS INTEGER) ELSE 0 END DESC,
               ord ASC NULLS LAST) AS r FROM bl0) WHERE r = 1),
ip AS (SELECT orth AS word, ord, lower(split_part(lemma, ':', 1)) AS lemma,
         CASE WHEN contains(tag, 'm1') THEN 'm1' WHEN contains(tag, ':f') THEN 'f' END AS gender,
         {case_expr} AS gcase, CASE WHEN contains(tag, ':sg:') THEN 'sg' ELSE 'pl' END AS number
       FROM lemmas WHERE starts_with(tag, 'subst')),
ip2 AS (SELECT * FROM ip WHERE gender IS NOT NULL AND gcase IS NOT NULL),
pr AS (SELECT n.name, f.lemma AS f_lemma, l.lemma AS l_lemma, f.ord AS f_ord, l.ord AS l_ord,
         100 + CASE WHEN f.gcase = l.gcase THEN 50 ELSE 0 END
             + CASE WHEN f.number = l.number THEN CASE WHEN f.number = 'sg' THEN 30 ELSE 20 END ELSE 0 END
             + CASE WHEN f.gcase = 'nom' THEN 5 ELSE 0 END AS score
       FROM nk2 n JOIN ip2 f ON f.word = n.w_first JOIN ip2 l ON l.word = n.w_last AND l.gender = f.gender
       WHERE n.n_parts >= 2),
bp AS (SELECT name, f_lemma, l_lemma FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, f_ord, l_ord) AS r FROM pr) WHERE r = 1),
nk3 AS (SELECT n.name, n.n_parts,
          CASE WHEN n.n_parts = 0 THEN '' WHEN n.n_parts = 1 THEN b1.best ELSE coalesce(bp.f_lemma, b1.best) END AS first,
          CASE WHEN n.n_parts <= 1 THEN '' ELSE coalesce(bp.l_lemma, b2.best) END AS last
        FROM nk2 n LEFT JOIN bp ON bp.name = n.name LEFT JOIN bl b1 ON b1.word = n.w_first LEFT JOIN bl b2 ON b2.word = n.w_last),
keys AS (SELECT name, first, last, {strip("first || ' ' || last")} AS person_key FROM nk3)"""


def persons_cte(shift: int = 0) -> str:
    return f"""
pm AS (SELECT s.doc_id, s.run_no, s.span, s.start, s.text, k.person_key, {initials('s.text', shift)} AS ini
       FROM spans s LEFT JOIN keys k ON k.name = s.text WHERE s.label = 'PERSON'),
pf AS (SELECT doc_id, person_key, ini AS initials, run_no AS o_run, start AS o_start, n_mentions FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id, person_key ORDER BY run_no, start DESC) AS r,
                count(*) OVER (PARTITION BY doc_id, person_key) AS n_mentions FROM pm) WHERE r = 1),
persons AS (SELECT *, CASE WHEN n_same = 1 THEN initials ELSE initials || ' (' || CAST(k AS VARCHAR) || ')' END AS substitute
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, initials ORDER BY o_run, o_start DESC) AS k,
               count(*) OVER (PARTITION BY doc_id, initials) AS n_same FROM pf)),
subs AS (
  SELECT pm.doc_id, pm.run_no, pm.span, 'PERSON' AS label, pm.start, p.substitute, pm.person_key
  FROM pm LEFT JOIN persons p ON p.doc_id = pm.doc_id AND p.person_key = pm.person_key
  UNION ALL
  SELECT doc_id, run_no, span, label, start,
    CASE WHEN label = 'LOCATION' THEN CASE WHEN {strip('text')} = '' THEN '(...)' ELSE upper(substring({strip('text')}, 1, 1)) || '.' END
         WHEN label = 'PRODUCT' THEN CASE WHEN {strip('text')} = '' THEN '(...)'
              WHEN len({split_ws(strip('text'))}) = 1 THEN upper(substring({strip('text')}, 1, 1)) || '.'
              ELSE upper(substring({strip('text')}, 1, 1)) || '. (...)' END
         ELSE '(...)' END, NULL
  FROM spans WHERE label <> 'PERSON')"""


def redact_cte(tags: str = "is_xml") -> str:
    esc = "replace(replace(replace(s.substitute, '&', '&amp;'), '<', '&lt;'), '''', '&apos;')"
    return f"""
em AS (SELECT m.*, s.substitute, sp.first_pos, sp.last_pos FROM marked m
       LEFT JOIN subs s ON s.doc_id = m.doc_id AND s.run_no = m.run_no AND s.span = m.span
       LEFT JOIN spans sp ON sp.doc_id = m.doc_id AND sp.run_no = m.run_no AND sp.span = m.span),
outs AS (SELECT doc_id, run_no, pos, CASE WHEN {tags} THEN
           lead || CASE WHEN substitute IS NOT NULL AND pos = first_pos THEN '<xAnon xSubst=''' || replace(replace(replace(substitute, '&', '&amp;'), '<', '&lt;'), '''', '&apos;') || '''>' ELSE '' END
                || token || CASE WHEN substitute IS NOT NULL AND pos = last_pos THEN '</xAnon>' ELSE '' END || trail
         ELSE
           lead || CASE WHEN substitute IS NOT NULL AND pos = first_pos THEN substitute ELSE '' END
                || CASE WHEN substitute IS NULL THEN token ELSE '' END
                || CASE WHEN substitute IS NULL OR pos = last_pos THEN trail ELSE '' END END AS out
         FROM em),
redacted AS (SELECT o.doc_id, string_agg(out, '' ORDER BY run_no, pos) AS text FROM outs o GROUP BY o.doc_id),
red AS (SELECT r.doc_id, r.text, coalesce(c.n, 0) AS n_mentions FROM redacted r
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) c ON c.doc_id = r.doc_id)"""


LEVELS = ["segments", "pieces", "labels", "spans", "keys", "persons", "redact"]


def core(docs_sql: str, upto: str = "redact", *, officials=(), shift: int = 0,
         tags: str = "is_xml", extra_names: str = "", threshold: float = 0.7) -> str:
    """WITH-prefix of the redaction plan up to a level (no trailing comma)."""
    names = "(SELECT text AS name FROM spans WHERE label = 'PERSON'" + (
        f" UNION SELECT name FROM {extra_names}" if extra_names else "") + ")"
    parts = [segments_cte(docs_sql).lstrip(), pieces_cte(), labels_cte(officials), spans_cte(threshold),
             name_keys_cte(names), persons_cte(shift), redact_cte(tags)]
    return "WITH " + ",".join(parts[:LEVELS.index(upto) + 1])


# --------------------------------------------------------------------------
# The oracle queries, keyed like the Spark catalog.
# --------------------------------------------------------------------------

TXT = docs_txt()
XML = docs_xml()
SPANS_OUT = ("SELECT doc_id, run_no, start, \"end\", label, round(confidence, 6) AS confidence, "
             "CAST(n_tokens AS BIGINT) AS n_tokens, text FROM spans")


def names_sql() -> str:
    return (core(TXT, "spans") + ",\nnames AS (SELECT text AS name FROM spans WHERE label = 'PERSON' "
            f"UNION SELECT name FROM {PART_NAMES_SQL} UNION SELECT c_name FROM customer)")


def _names_then(body: str) -> str:
    return names_sql() + "," + name_keys_cte("names") + "\n" + body


def _chunks() -> str:
    size, step = 64, 48
    return (core(TXT, "pieces") + f""",
tk AS (SELECT doc_id, run_no, pos AS tok_no FROM pieces2 WHERE is_tok),
ch AS (SELECT doc_id, run_no, tok_no, unnest(range(CAST(greatest(ceil((tok_no - {size} + 1) / {step}), 0) AS BIGINT),
          CAST(floor(tok_no / {step}) AS BIGINT) + 1)) AS chunk FROM tk)
SELECT doc_id, run_no, tok_no, CAST(chunk AS INTEGER) AS chunk FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, run_no, tok_no ORDER BY
     least(tok_no - chunk * {step}, {size - 1} - (tok_no - chunk * {step})) DESC, chunk ASC) AS r FROM ch) WHERE r = 1""")


MENTION_RE2 = r"(?s)<xAnon(?:\s+xSubst=(?:'([^']*)'|\"([^\"]*)\"))?\s*>(.*?)</xAnon>"
TAGGED_RE2 = r"(?s)<xAnon\s+xSubst=(?:'([^']*)'|\"([^\"]*)\")\s*>.*?</xAnon>"


def _markup_red(body: str) -> str:
    return core(XML) + ",\nmred AS (SELECT * FROM red)" + body


ORACLES = {
    "tokens_with_offsets": core(TXT, "pieces") + "\nSELECT doc_id, run_no, pos AS tok_no, start, \"end\", token FROM pieces2 WHERE is_tok",
    "markup_runs": core(XML, "segments") + """,
sx AS (SELECT *, CAST(coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY seg_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM segs)
SELECT doc_id, seg_no AS run_no, start, seg AS text FROM sx WHERE is_run""",
    "preds_joined": core(TXT, "labels") + """
SELECT doc_id, run_no, pos AS tok_no, token, label, round(CASE WHEN label = 'O' THEN 1.0 ELSE confidence END, 6) AS confidence
FROM lab WHERE is_tok""",
    "first_subtoken": core(TXT, "labels") + """,
sb AS (SELECT doc_id, run_no, pos AS tok_no, label, confidence,
         unnest(range(0, CAST(greatest(ceil(length(token) / 3), 1) AS BIGINT))) AS sub_no FROM lab WHERE is_tok),
sc AS (SELECT doc_id, run_no, tok_no, sub_no, CASE WHEN sub_no = 0 THEN label ELSE 'X' END AS label,
         confidence - sub_no * 0.015625 AS confidence FROM sb)
SELECT doc_id, run_no, tok_no, label, round(confidence, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, run_no, tok_no ORDER BY sub_no) AS r FROM sc) WHERE r = 1""",
    "spans_decoded": core(TXT, "spans") + "\n" + SPANS_OUT,
    "officials_excluded": core(TXT, "spans", officials=("gnu", "an.")) + "\n" + SPANS_OUT,
    "chunked_predictions": _chunks(),
    "name_pair_key": _names_then("SELECT name, first, last, person_key FROM keys"),
    "best_lemma": _names_then("SELECT word, best FROM bl"),
    "titles_stripped": names_sql() + f"\nSELECT name, {clean_name('name')} AS clean FROM names",
    "name_parts": names_sql() + f""",
np AS (SELECT name, {split_ws(clean_name('name'))} AS p FROM names)
SELECT name, CAST(len(p) AS BIGINT) AS n_parts, CASE WHEN len(p) >= 1 THEN p[1] END AS first,
       CASE WHEN len(p) >= 2 THEN p[-1] END AS last FROM np""",
    "initials_basic": names_sql() + f"\nSELECT name, {initials('name')} AS initials FROM names",
    "initials_hyphen": names_sql() + f"\nSELECT name, {initials('name')} AS initials FROM names WHERE contains(name, '-')",
    "initials_shifted": names_sql() + f"\nSELECT name, {initials('name', 2)} AS ini2, {initials('name', 7)} AS ini7 FROM names",
    "same_person": f"""WITH pn AS {PART_NAMES_SQL},
names AS (SELECT p_name AS name FROM pn UNION SELECT name FROM pn),""" + name_keys_cte("names") + """
SELECT pn.p_partkey, pn.p_name AS a, pn.name AS b, ka.person_key AS key_a, kb.person_key AS key_b,
       ka.person_key IS NOT DISTINCT FROM kb.person_key AS same
FROM pn LEFT JOIN keys ka ON ka.name = pn.p_name LEFT JOIN keys kb ON kb.name = pn.name""",
    "persons_numbered": core(TXT, "persons") + """
SELECT doc_id, person_key, initials, k, CAST(n_same AS BIGINT) AS n_same, CAST(n_mentions AS BIGINT) AS n_mentions, substitute FROM persons""",
    "substitutes": core(TXT, "persons") + "\nSELECT doc_id, run_no, start, label, substitute FROM subs",
    "redacted_text": core(TXT) + "\nSELECT doc_id, text, n_mentions FROM red",
    "redacted_markup": core(XML) + "\nSELECT doc_id, text, n_mentions FROM red",
    "mentions_parsed": _markup_red(f""",
mz AS (SELECT doc_id, regexp_extract_all(text, {q(MENTION_RE2)}, 1) AS a, regexp_extract_all(text, {q(MENTION_RE2)}, 2) AS b,
         regexp_extract_all(text, {q(MENTION_RE2)}, 3) AS o FROM mred),
mu AS (SELECT doc_id, unnest(a) AS a, unnest(b) AS b, unnest(o) AS orig, generate_subscripts(a, 1) AS n FROM mz)
SELECT doc_id, n, nullif(concat(a, b), '') AS subst, orig FROM mu"""),
    "tagged_to_plain": core(XML) + f"\nSELECT doc_id, regexp_replace(text, {q(TAGGED_RE2)}, '\\1\\2', 'g') AS text FROM red",
    "clean_text": core(XML) + f""",
c1 AS (SELECT doc_id, regexp_replace(text, {q(TAGGED_RE2)}, '\\1\\2', 'g') AS t FROM red),
c2 AS (SELECT doc_id, regexp_replace(t, '(?s)<xAnon\\s*>.*?</xAnon>', '(...)', 'g') AS t FROM c1),
c3 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM c2)
SELECT doc_id, t AS clean FROM c3""",
    "doc_counts": core(TXT, "persons") + """
SELECT d.doc_id, coalesce(m.n, 0) AS n_mentions, coalesce(p.n, 0) AS n_persons FROM d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) m ON m.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(DISTINCT person_key) AS n FROM persons GROUP BY doc_id) p ON p.doc_id = d.doc_id""",
}


# ---- ledger, cases, rosters ------------------------------------------------
LEDGER = """ledger AS (SELECT user_id AS doc_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending'
  WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' END AS status,
  value AS duration FROM events),
lat AS (SELECT doc_id, status, ts, n_events FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, seq DESC) AS r,
  count(*) OVER (PARTITION BY doc_id) AS n_events FROM ledger) WHERE r = 1),
cdocs AS (SELECT doc_id, source AS case_id FROM documents)"""
TSF = "'%Y-%m-%d %H:%M:%S.%f'"
DOC_ROSTER = """droster AS (SELECT p.doc_id, p.person_key, p.substitute AS initials, c.case_id, p.doc_id AS seq
  FROM persons p JOIN cdocs c ON c.doc_id = p.doc_id),
croster AS (SELECT case_id, person_key, initials FROM (SELECT *, row_number() OVER (PARTITION BY case_id, person_key ORDER BY seq DESC) AS r
  FROM droster) WHERE r = 1),
removals AS (SELECT case_id, person_key, 1000000000000 AS seq FROM croster WHERE substring(person_key, 1, 1) < 'm'
  UNION ALL SELECT case_id, person_key || ' x', 1000000000000 FROM croster WHERE substring(person_key, 1, 1) >= 'm')"""


# events and requests of a document, one after the other, through the state rules
REQUEST_STATES = """rq AS (SELECT user_id AS doc_id, ts, event_id AS seq, CASE WHEN value > 45 THEN 'stop' WHEN value < 3 THEN 'retry' END AS request FROM events),
step AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, seq, kind) AS n FROM (
  SELECT doc_id, ts, seq, 0 AS kind, status AS what FROM ledger
  UNION ALL SELECT doc_id, ts, seq, 1, request FROM rq WHERE request IS NOT NULL)),
walk AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS state, false AS flag, CAST(1 AS BIGINT) AS attempt,
    CAST(NULL AS VARCHAR) AS request, CAST(NULL AS VARCHAR) AS outcome FROM step
  UNION ALL
  SELECT w.doc_id, s.n,
    CASE WHEN s.kind = 0 THEN s.what WHEN s.what = 'stop' AND w.state = 'pending' THEN 'cancelled'
         WHEN s.what = 'retry' AND w.state <> 'processing' THEN 'pending' ELSE w.state END,
    CASE WHEN s.kind = 0 THEN false WHEN s.what = 'stop' AND w.state = 'processing' THEN true ELSE w.flag END,
    w.attempt + CASE WHEN s.kind = 1 AND s.what = 'retry' AND w.state <> 'processing' THEN 1 ELSE 0 END,
    CASE WHEN s.kind = 1 THEN s.what END,
    CASE WHEN s.kind = 0 THEN NULL WHEN w.state IS NULL THEN 'noop'
         WHEN s.what = 'stop' THEN CASE w.state WHEN 'pending' THEN 'cancelled' WHEN 'processing' THEN 'stopping' ELSE 'noop' END
         WHEN w.state = 'processing' THEN 'refused' ELSE 'requeued' END
  FROM walk w JOIN step s ON s.doc_id = w.doc_id AND s.n = w.n + 1)"""
REQUEST_END = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM walk) WHERE r = 1"


def _with_persons(body):
    return core(TXT, "persons") + ",\n" + LEDGER + ",\n" + DOC_ROSTER + "\n" + body


ORACLES.update({
    "ledger_latest": f"WITH {LEDGER} SELECT doc_id, status, strftime(ts, {TSF}) AS ts, n_events FROM lat",
    "ledger_subset": f"""WITH RECURSIVE {LEDGER}, {REQUEST_STATES} SELECT lat.doc_id, status, status = 'pending' AS pending,
        status IN ('pending', 'processing') AS in_progress, status IN ('done', 'failed', 'cancelled') AS finished,
        status = 'processing' AND coalesce(st.flag, false) AS stopping FROM lat LEFT JOIN
        ({REQUEST_END}) st ON st.doc_id = lat.doc_id""",
    "todo_docs": f"WITH {LEDGER} SELECT doc_id, case_id FROM cdocs WHERE doc_id IN (SELECT doc_id FROM lat WHERE status = 'pending')",
    "published_only": core("SELECT doc_id, text, 'txt' AS fmt FROM documents WHERE doc_id NOT IN "
                           "(SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r "
                           "FROM events) WHERE r = 1 AND event_type = 'signup')") + ",\n" + LEDGER + """
SELECT doc_id, n_mentions, length(text) AS n_chars FROM red WHERE doc_id NOT IN (SELECT doc_id FROM lat WHERE status = 'cancelled')""",
    "erase_outcome": f"""WITH {LEDGER}, sel AS (SELECT DISTINCT doc_id FROM labels)
SELECT s.doc_id, CASE WHEN l.status = 'processing' THEN 'skipped' ELSE 'deleted' END AS outcome FROM sel s LEFT JOIN lat l ON l.doc_id = s.doc_id""",
    "ledger_resolved": f"""WITH RECURSIVE {LEDGER}, {REQUEST_STATES}
SELECT e.doc_id, l.status, e.request, e.outcome, CASE WHEN e.flag THEN 'cancelled' ELSE e.state END AS new_status,
  e.flag AS stopping, e.attempt FROM ({REQUEST_END}) e JOIN lat l ON l.doc_id = e.doc_id
WHERE e.doc_id IN (SELECT doc_id FROM rq WHERE request IS NOT NULL)""",
    "overdue_docs": f"""WITH {LEDGER}, a AS (SELECT max(ts) AS as_of FROM ledger)
SELECT doc_id, strftime(ts, {TSF}) AS ts, CAST(epoch(date_trunc('second', (SELECT as_of FROM a))) - epoch(date_trunc('second', ts)) AS BIGINT) AS age_s FROM lat
WHERE status = 'processing' AND epoch(date_trunc('second', (SELECT as_of FROM a))) - epoch(date_trunc('second', ts)) > 1800""",
    "throughput_hourly": f"""WITH {LEDGER} SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS w_start,
  count(*) AS n, round(avg(duration), 6) AS avg_s FROM ledger WHERE status = 'done' GROUP BY 1""",
    "case_sessions": f"""WITH {LEDGER},
e AS (SELECT c.case_id, l.ts FROM ledger l LEFT JOIN cdocs c ON c.doc_id = l.doc_id),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY case_id ORDER BY ts) IS NULL
        OR ts - lag(ts) OVER (PARTITION BY case_id ORDER BY ts) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS nw FROM e),
h AS (SELECT *, sum(nw) OVER (PARTITION BY case_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT case_id, strftime(min(ts), {TSF}) AS s_start, strftime(max(ts) + INTERVAL '30 minutes', {TSF}) AS s_end, count(*) AS n
FROM h GROUP BY case_id, sid""",
    "docs_by_day_status": f"""WITH {LEDGER} SELECT strftime(ts, '%Y-%m-%d') AS day, status, count(*) AS n,
  CAST(grouping(strftime(ts, '%Y-%m-%d'), status) AS BIGINT) AS gid FROM ledger GROUP BY CUBE (strftime(ts, '%Y-%m-%d'), status)""",
    "docs_with_case": f"""WITH {LEDGER}, cases AS (SELECT DISTINCT case_id FROM cdocs WHERE case_id NOT IN ('src3', 'src7'))
SELECT d.doc_id, c.case_id FROM cdocs d LEFT JOIN cases c ON c.case_id = d.case_id""",
    "doc_roster": core(TXT, "persons") + "\nSELECT doc_id, person_key, substitute AS initials FROM persons",
    "case_roster": _with_persons("SELECT case_id, person_key, initials FROM croster"),
    "roster_after_remove": _with_persons("""
, rlog AS (SELECT case_id, person_key, initials, 'put' AS op, seq FROM droster
         UNION ALL SELECT case_id, person_key, NULL, 'del', seq FROM removals)
SELECT case_id, person_key, initials FROM (SELECT *, row_number() OVER (PARTITION BY case_id, person_key ORDER BY seq DESC) AS r FROM rlog)
WHERE r = 1 AND op = 'put'"""),
    "removal_found": _with_persons("""
SELECT r.case_id, r.person_key, (c.person_key IS NOT NULL) AS found FROM removals r
LEFT JOIN croster c ON c.case_id = r.case_id AND c.person_key = r.person_key"""),
    "roster_json": _with_persons("""
SELECT case_id, person_key, CAST(json_object('case_id', case_id, 'person', person_key, 'initials', initials) AS VARCHAR) AS json FROM croster
UNION ALL SELECT case_id, NULL, CAST(json_object('case_id', case_id, 'count', count(*)) AS VARCHAR) FROM croster GROUP BY case_id"""),
    "roster_sorted": _with_persons("SELECT case_id, person_key, initials, row_number() OVER (PARTITION BY case_id ORDER BY person_key) AS rn FROM croster"),
    "case_summary": _with_persons("""
, cd AS (SELECT d.case_id, count(*) AS n_docs, count(*) FILTER (WHERE l.status = 'done') AS n_done FROM cdocs d LEFT JOIN lat l ON l.doc_id = d.doc_id GROUP BY d.case_id),
cp AS (SELECT case_id, count(*) AS n FROM croster GROUP BY case_id)
SELECT cd.case_id, n_docs, n_done, coalesce(cp.n, 0) AS n_persons FROM cd LEFT JOIN cp ON cp.case_id = cd.case_id"""),
    "newest_per_case": f"""WITH {LEDGER}, cr AS (SELECT doc_id, min(ts) AS created FROM ledger GROUP BY doc_id)
SELECT case_id, doc_id, rn FROM (SELECT d.case_id, d.doc_id, row_number() OVER (PARTITION BY d.case_id ORDER BY cr.created DESC NULLS LAST, d.doc_id) AS rn
  FROM cdocs d LEFT JOIN cr ON cr.doc_id = d.doc_id) WHERE rn <= 3""",
    "run_summary": core(TXT) + ",\n" + LEDGER + """
SELECT (SELECT count(*) FROM red) AS n_docs, (SELECT CAST(sum(n_mentions) AS BIGINT) FROM red) AS n_mentions,
       (SELECT count(*) FROM persons) AS n_persons, (SELECT count(DISTINCT (doc_id, initials)) FROM persons) AS n_initials,
       (SELECT count(*) FROM lat) AS n_total, (SELECT count(*) FROM lat WHERE status = 'done') AS n_ok,
       (SELECT CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) FROM ledger) AS elapsed_s""",
    "persons_numbered_case": core(TXT, "persons") + """,
cdocs AS (SELECT doc_id, source AS case_id FROM documents),
pc AS (SELECT c.case_id, pm.doc_id, pm.person_key, pm.ini, pm.run_no, pm.start FROM pm JOIN cdocs c ON c.doc_id = pm.doc_id),
pc1 AS (SELECT case_id, person_key, ini AS initials, doc_id AS o_doc, run_no AS o_run, start AS o_start FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, person_key ORDER BY doc_id, run_no, start DESC) AS r FROM pc) WHERE r = 1),
pc2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, initials ORDER BY o_doc, o_run, o_start DESC) AS INTEGER) AS k,
  count(*) OVER (PARTITION BY case_id, initials) AS n_same FROM pc1)
SELECT case_id, person_key, initials, k, CAST(n_same AS BIGINT) AS n_same,
  CASE WHEN n_same = 1 THEN initials ELSE initials || ' (' || CAST(k AS VARCHAR) || ')' END AS substitute FROM pc2""",
})


PART_MENTIONS = f"""WITH m AS (SELECT p_partkey // 50 AS doc_id, (p_partkey // 50) % 5 AS case_id, p_partkey AS s,
  lower(name) AS person_key, {initials('name')} AS ini FROM {PART_NAMES_SQL})"""
NUMBERED = "CASE WHEN n_same = 1 THEN initials ELSE initials || ' (' || CAST(k AS VARCHAR) || ')' END AS substitute"
ORACLES.update({
    "parts_numbered": PART_MENTIONS + f""",
p AS (SELECT doc_id, person_key, arg_max(ini, s) AS initials, max(s) AS s, count(*) AS n_mentions FROM m GROUP BY doc_id, person_key),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, initials ORDER BY s DESC) AS k, count(*) OVER (PARTITION BY doc_id, initials) AS n_same FROM p)
SELECT doc_id, person_key, initials, k, n_same, n_mentions, {NUMBERED} FROM r""",
    "parts_numbered_case": PART_MENTIONS + f""",
p AS (SELECT case_id, person_key, ini AS initials, doc_id, s FROM m
  QUALIFY row_number() OVER (PARTITION BY case_id, person_key ORDER BY doc_id, s DESC) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, initials ORDER BY doc_id, s DESC) AS k, count(*) OVER (PARTITION BY case_id, initials) AS n_same FROM p)
SELECT case_id, person_key, initials, k, n_same, {NUMBERED} FROM r""",
})


def _completed(current: bool) -> str:
    last = "AND done = (SELECT max((ts, seq)) FROM ledger l WHERE l.doc_id = d.doc_id)" if current else ""
    return f"""WITH {LEDGER},
m AS (SELECT p_partkey // 50 AS doc_id, p_partkey AS s, split_part(lower(p_name), ' ', 1) AS person_key, {initials('name')} AS ini
      FROM {PART_NAMES_SQL}),
p AS (SELECT doc_id, person_key, arg_max(ini, s) AS initials, max(s) AS s FROM m GROUP BY doc_id, person_key),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, initials ORDER BY s DESC) AS k, count(*) OVER (PARTITION BY doc_id, initials) AS n_same FROM p),
dn AS (SELECT * FROM (SELECT doc_id, max((ts, seq)) AS done FROM ledger WHERE status = 'done' GROUP BY doc_id) d WHERE true {last}),
x AS (SELECT r.doc_id % 5 AS case_id, person_key, {NUMBERED}, done FROM r JOIN dn ON dn.doc_id = r.doc_id)
SELECT case_id, person_key, substitute AS initials FROM x
QUALIFY row_number() OVER (PARTITION BY case_id, person_key ORDER BY done DESC) = 1"""


ORACLES.update({"roster_by_completion": _completed(False), "roster_current": _completed(True)})


# ---- evaluation and corpus ---------------------------------------------------

GOLD_FILES = f"""SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.test' AS file, string_agg(cs, chr(10) ORDER BY ln) AS content FROM (
  SELECT doc_id, ln, 'ANONYMIZE("' || line || '") = ' || CASE WHEN regexp_matches(line, '[0-9]{{9,}}')
      THEN '"' || regexp_replace(line, '[0-9]{{9,}}', '(...)', 'g') || '"' ELSE 'NO_CHANGE' END AS cs
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)
  WHERE regexp_matches(line, {q(P.NOT_SPACE)})) GROUP BY doc_id"""


def _collapse(x):
    return strip(f"regexp_replace({x}, {q(P.SPACE_RUN)}, ' ', 'g')")


GOLD_CASES = f"""SELECT file, CAST(k AS INTEGER) AS case_no, {_collapse('i')} AS input,
    CASE WHEN coalesce(n = 'NO_CHANGE', false) THEN ['NO_CHANGE'] ELSE list_transform(string_split(coalesce(e, ''), '" OR "'), lambda z: {_collapse('z')}) END AS expected,
    coalesce(n = 'NO_CHANGE', false) AS no_change
  FROM (SELECT file, unnest(ii) AS i, unnest(ee) AS e, unnest(nn) AS n, generate_subscripts(ii, 1) AS k FROM (
    SELECT file, regexp_extract_all(content, {q(CASE_PATTERN)}, 1) AS ii, regexp_extract_all(content, {q(CASE_PATTERN)}, 2) AS ee,
           regexp_extract_all(content, {q(CASE_PATTERN)}, 3) AS nn FROM ({GOLD_FILES})))"""

GOLD_DOCS = f"""SELECT CAST(case_no AS VARCHAR) || '#' || file AS doc_id, input AS text, 'txt' AS fmt FROM ({GOLD_CASES})"""

NW = q(P.NOT_WORD)
VERDICTS = f"""
SELECT c.file, c.case_no, r.n_mentions,
  CASE WHEN c.no_change THEN r.n_mentions = 0 ELSE
    len(list_filter(c.expected, lambda e: regexp_replace(e, {NW}, '', 'g') = regexp_replace(r.text, {NW}, '', 'g'))) > 0 END AS passed
FROM ({GOLD_CASES}) c JOIN red r ON r.doc_id = CAST(c.case_no AS VARCHAR) || '#' || c.file"""


def _spans_only(threshold):
    return core(TXT, "spans", threshold=threshold) + '\nSELECT doc_id, run_no, start, "end", label FROM spans'


ORACLES.update({
    "golden_cases": f"SELECT file, case_no, input, array_to_string(expected, ' | ') AS expected, no_change FROM ({GOLD_CASES})",
    "golden_verdicts": core(GOLD_DOCS) + VERDICTS,
    "golden_rollup": core(GOLD_DOCS) + f""", v AS ({VERDICTS})
SELECT file, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) - count(*) FILTER (WHERE passed) AS failed,
  round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS pass_rate, CAST(grouping(file) AS BIGINT) AS gid
FROM v GROUP BY ROLLUP (file)""",
    "span_metrics": f"""WITH gold AS ({_spans_only(0.6)}), pred AS ({_spans_only(0.7)}),
x AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS in_g, p.doc_id IS NOT NULL AS in_p FROM gold g FULL OUTER JOIN pred p
  ON g.doc_id = p.doc_id AND g.run_no = p.run_no AND g.start = p.start AND g."end" = p."end" AND g.label = p.label),
a AS (SELECT label, count(*) FILTER (WHERE in_g AND in_p) AS tp, count(*) FILTER (WHERE NOT in_g) AS fp,
         count(*) FILTER (WHERE NOT in_p) AS fn, CAST(grouping(label) AS BIGINT) AS gid FROM x GROUP BY ROLLUP (label))
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, gid FROM a""",
    "bio_dataset": core(TXT, "spans") + """,
bt AS (SELECT m.doc_id, m.run_no, m.pos, m.token, CASE WHEN s.label IS NULL THEN 'O' WHEN m.pos = s.first_pos THEN 'B-' || s.label
         ELSE 'I-' || s.label END AS tag FROM marked m LEFT JOIN spans s ON s.doc_id = m.doc_id AND s.run_no = m.run_no AND s.span = m.span
       WHERE m.is_tok)
SELECT doc_id, run_no, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(tag, ' ' ORDER BY pos) AS labels
FROM bt GROUP BY doc_id, run_no""",
    "bio_from_tags": core(TXT, "spans") + """,
bt AS (SELECT m.doc_id, m.pos, m.start, m.token, CASE WHEN s.label IS NULL THEN 'O' WHEN m.pos = s.first_pos THEN 'B-' || s.label
         ELSE 'I-' || s.label END AS tag FROM marked m LEFT JOIN spans s ON s.doc_id = m.doc_id AND s.run_no = m.run_no AND s.span = m.span
       WHERE m.is_tok)
SELECT d.doc_id, d.text, count(bt.pos) AS n_tokens, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens,
  coalesce(string_agg(CAST(start AS VARCHAR), ' ' ORDER BY pos), '') AS starts, coalesce(string_agg(tag, ' ' ORDER BY pos), '') AS labels
FROM documents d LEFT JOIN bt ON bt.doc_id = d.doc_id GROUP BY d.doc_id, d.text""",
    "split_80_20": core(TXT, "pieces") + """
SELECT DISTINCT doc_id, run_no, CASE WHEN doc_id % 100 < 80 THEN 'train' ELSE 'val' END AS split FROM pieces2 WHERE is_tok""",
    "redaction_diff": core(TXT) + """
SELECT o.doc_id, o.run_no, o.pos, p.lead || p.token || p.trail AS before, o.out AS after FROM outs o
JOIN pieces2 p ON p.doc_id = o.doc_id AND p.run_no = o.run_no AND p.pos = o.pos WHERE p.lead || p.token || p.trail <> o.out""",
    "leak_audit": core(TXT) + f""",
st AS (SELECT DISTINCT m.doc_id, m.token FROM marked m JOIN spans s ON s.doc_id = m.doc_id AND s.run_no = m.run_no AND s.span = m.span),
ot AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {q(P.TOKEN_WITH_TRAIL)}, 1)) AS token FROM red)
SELECT st.doc_id, count(*) AS n_leaks FROM st JOIN ot ON ot.doc_id = st.doc_id AND ot.token = st.token GROUP BY st.doc_id""",
})


ORACLES["bio_json"] = f"SELECT text, n_tokens, labels FROM ({ORACLES['bio_from_tags']})"


# ---- sources, failures, streams -----------------------------------------------
NAMED = """(SELECT doc_id, source, text, 'doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 10 = 3 THEN '.pdf'
  WHEN doc_id % 10 = 7 THEN '.XML' ELSE '.txt' END AS name FROM documents)"""
SFX = "regexp_extract(name, '^(.*?)(\\.[^.]+)?$', 2)"
STEM = "regexp_extract(name, '^(.*?)(\\.[^.]+)?$', 1)"

# documents that the fragile model raises on, with its message
UNREADABLE = """unreadable AS (SELECT doc_id, 'cannot read ' || arg_min(token, pos) AS error FROM pieces2
  WHERE is_tok AND regexp_matches(token, '^[0-9]{9,}$') GROUP BY doc_id)"""

LIFECYCLE = core(TXT) + f""",
{UNREADABLE},
stop AS (SELECT user_id AS doc_id, bool_or(event_id % 2 = 0) AS early FROM events WHERE value > 220 GROUP BY user_id),
fin AS (SELECT x.doc_id, x.source AS case_id, coalesce(s.early, false) AS early, u.error,
    CASE WHEN s.doc_id IS NOT NULL THEN 'cancelled' WHEN u.doc_id IS NOT NULL THEN 'failed' ELSE 'done' END AS status
  FROM documents x LEFT JOIN stop s ON s.doc_id = x.doc_id LEFT JOIN unreadable u ON u.doc_id = x.doc_id
  WHERE x.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
np AS (SELECT doc_id, count(*) AS n FROM persons GROUP BY doc_id)
"""

ORACLES.update({
    "lifecycle_results": LIFECYCLE + """SELECT 'run-0' AS run_id, f.doc_id, 'doc_' || CAST(f.doc_id AS VARCHAR) || '_anon.txt' AS result_name, r.text
FROM fin f JOIN red r ON r.doc_id = f.doc_id WHERE f.status = 'done'""",
    "lifecycle_ledger": LIFECYCLE + """SELECT f.doc_id, f.case_id, CAST(0 AS BIGINT) AS seq, CAST(e.step AS INTEGER) AS step, CAST(1 AS INTEGER) AS attempt,
  CASE e.step WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' ELSE f.status END AS status,
  CASE WHEN e.step = 2 AND f.status = 'done' THEN r.n_mentions END AS entity_count,
  CASE WHEN e.step = 2 AND f.status = 'done' THEN coalesce(np.n, 0) END AS person_count,
  CASE WHEN e.step = 2 AND f.status = 'failed' THEN f.error END AS error
FROM fin f JOIN red r ON r.doc_id = f.doc_id LEFT JOIN np ON np.doc_id = f.doc_id
CROSS JOIN (VALUES (0), (1), (2)) e(step) WHERE NOT (e.step = 1 AND f.early)""",
    "lifecycle_roster": LIFECYCLE + """SELECT case_id, person_key, substitute AS initials FROM (
  SELECT f.case_id, p.person_key, p.substitute, row_number() OVER (PARTITION BY f.case_id, p.person_key ORDER BY p.doc_id DESC) AS r
  FROM persons p JOIN fin f ON f.doc_id = p.doc_id WHERE f.status = 'done') WHERE r = 1""",
    "admission": f"""SELECT doc_id, name, CAST(octet_length(encode(text)) + CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END AS BIGINT) AS size,
  CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM (
  SELECT *, CASE WHEN lower({SFX}) NOT IN ('.xml', '.txt') THEN 'suffix' WHEN doc_id % 10 = 9 AND text IS NOT NULL THEN 'encoding' END AS reason FROM {NAMED})""",
    "case_assignment": """WITH man AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS case_id,
    CASE WHEN doc_id % 5 = 0 THEN trim(' case-' || CAST(doc_id % 17 AS VARCHAR) || ' ') END AS new FROM documents),
cases AS (SELECT DISTINCT source AS case_id FROM documents)
SELECT doc_id, CASE WHEN m.case_id IS NOT NULL AND new IS NOT NULL THEN NULL ELSE coalesce(new, m.case_id) END AS case_id,
  CASE WHEN m.case_id IS NOT NULL AND new IS NOT NULL THEN 'rejected' WHEN new IS NOT NULL OR m.case_id IS NOT NULL THEN 'ok' ELSE 'none' END AS status,
  NOT (m.case_id IS NOT NULL AND new IS NOT NULL) AND new IS NOT NULL AND new NOT IN (SELECT case_id FROM cases) AS created
FROM man m""",
    "doc_formats": "WITH " + segments_cte(f"SELECT doc_id, text, CASE WHEN lower({SFX}) = '.xml' THEN 'xml' ELSE 'txt' END AS fmt FROM {NAMED}") + f"""
SELECT n.doc_id, n.name, CASE WHEN lower({SFX}) = '.xml' THEN 'xml' ELSE 'txt' END AS fmt, coalesce(r.n_runs, 0) AS n_runs FROM {NAMED} n
LEFT JOIN (SELECT doc_id, count(*) AS n_runs FROM segs WHERE is_run GROUP BY doc_id) r ON r.doc_id = n.doc_id""",
    "result_names": f"SELECT doc_id, {STEM} || '_anon' || {SFX} AS result_name FROM {NAMED}",
    "sources_union": """SELECT doc_id, 'document' AS kind, length(text) AS n_chars FROM documents
UNION ALL SELECT conv_id, 'conversation', length(string_agg(text, chr(10) ORDER BY turn)) FROM conversations GROUP BY conv_id""",
    "failures_isolated": core(TXT) + f""",
{UNREADABLE}
SELECT r.doc_id, CASE WHEN u.doc_id IS NULL THEN 'done' ELSE 'failed' END AS status, u.error, u.error IS NOT NULL AS has_trace,
  CASE WHEN u.doc_id IS NULL THEN n_mentions ELSE 0 END AS n_mentions FROM red r LEFT JOIN unreadable u ON u.doc_id = r.doc_id
UNION ALL SELECT -1, 'failed', 'no text', false, 0 UNION ALL SELECT -2, 'done', NULL, false, 0""",
    "stream_redact": core(TXT) + "\nSELECT doc_id, text, n_mentions FROM red",
    "stream_dedup": f"""SELECT user_id AS doc_id, strftime(ts, {TSF}) AS ts, event_id FROM events WHERE event_type = 'view'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "stream_throughput": ORACLES["throughput_hourly"],
    "stream_roster": ORACLES["case_roster"],
})


ORACLES["new_cases"] = f"SELECT DISTINCT case_id FROM ({ORACLES['case_assignment']}) WHERE created"


# ---- more inventory items ------------------------------------------------------
TURNS = """d AS (SELECT DISTINCT conv_id AS doc_id FROM conversations),
segs AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_no, coalesce(text, '') AS seg, false AS is_xml, true AS is_run FROM conversations)"""


def core_turns():
    """Conversation turns as runs, labelled by the term list learnt from
    the documents' person spans."""
    full = core(TXT, "pieces")
    a = full.index("d AS (")
    b = full.index("ta AS (")
    terms = (core(TXT, "spans") + "\nSELECT DISTINCT m.token AS term FROM marked m JOIN spans s ON s.doc_id = m.doc_id "
             "AND s.run_no = m.run_no AND s.span = m.span WHERE s.label = 'PERSON' AND m.is_tok")
    lab = f"""terms AS ({terms}),
lab AS (SELECT p.doc_id, p.run_no, p.pos, p.is_xml, p.is_tok, p.lead, p.token, p.trail, p.start, p."end",
  CASE WHEN p.is_tok AND t.term IS NOT NULL THEN 'B-PERSON' ELSE 'O' END AS label,
  CASE WHEN t.term IS NOT NULL THEN CAST(0.9 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence
  FROM pieces2 p LEFT JOIN terms t ON t.term = p.token)"""
    names = "(SELECT text AS name FROM spans WHERE label = 'PERSON')"
    return (full[:a] + TURNS + ",\n" + full[b:] + ",\n" + lab + "," + spans_cte() + "," + name_keys_cte(names)
            + "," + persons_cte(0))


LABEL_IDS = "['O', 'B-PERSON', 'I-PERSON', 'B-LOCATION', 'B-SENSITIVE', 'B-PRODUCT', 'I-PRODUCT', 'MAIL']"

ORACLES.update({
    "spans_trimmed": core(TXT, "spans") + '\nSELECT doc_id, run_no, start, "end", label, text FROM spans',
    "initials_frequency": core(TXT, "persons") + """
SELECT doc_id, initials, count(*) AS n_persons, CAST(sum(n_mentions) AS BIGINT) AS n_mentions FROM persons GROUP BY doc_id, initials""",
    "preds_from_label_map": core(TXT, "labels") + f"""
SELECT doc_id, run_no, pos AS tok_no, CAST(list_position({LABEL_IDS}, label) - 1 AS INTEGER) AS label_id, label,
  round(confidence, 6) AS confidence FROM lab WHERE is_tok AND label <> 'O'""",
    "spans_model_hosted": ORACLES["spans_decoded"],
    "conversation_substitutes": core_turns() + """
SELECT doc_id AS conv_id, run_no AS turn, start, label, substitute FROM subs""",
    "stream_ledger": """SELECT user_id AS doc_id, event_type AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
})


ORACLES["terms_matched"] = core(TXT, "pieces").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
bt AS (SELECT regexp_extract_all(text, {q(P.TOKEN_WITH_TRAIL)}, 1) AS t FROM benchmark),
terms AS (SELECT DISTINCT w, len(w) AS n, label, c FROM (
  SELECT t[1:3] AS w, 3 AS n, 'PRODUCT' AS label, CAST(0.9 AS DOUBLE) AS c FROM bt UNION ALL SELECT t[4:5], 2, 'LOCATION', CAST(0.85 AS DOUBLE) FROM bt
  UNION ALL SELECT t[6:6], 1, 'PERSON', CAST(0.8 AS DOUBLE) FROM bt) WHERE len(w) = n),
tk AS (SELECT doc_id, run_no, pos, token, start, "end", lead(token) OVER o AS t2, lead(token, 2) OVER o AS t3 FROM pieces2 WHERE is_tok
  WINDOW o AS (PARTITION BY doc_id, run_no ORDER BY pos)),
mt AS (SELECT tk.doc_id, tk.run_no, tk.pos, n, label, c FROM tk JOIN terms ON w[1] = token AND (n < 2 OR w[2] = t2) AND (n < 3 OR w[3] = t3)
  QUALIFY row_number() OVER (PARTITION BY tk.doc_id, tk.run_no, tk.pos ORDER BY n DESC) = 1),
nx AS (SELECT *, (SELECT min(b.pos) FROM mt b WHERE b.doc_id = a.doc_id AND b.run_no = a.run_no AND b.pos >= a.pos + a.n) AS behind FROM mt a),
wk AS (SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY doc_id, run_no ORDER BY pos) = 1
  UNION ALL SELECT nx.* FROM wk JOIN nx ON nx.doc_id = wk.doc_id AND nx.run_no = wk.run_no AND nx.pos = wk.behind)
SELECT k.doc_id, k.run_no, a.start, z."end", k.label, round(k.c, 6) AS confidence, CAST(k.n AS BIGINT) AS n_tokens,
  substring(d.text, a.start + 1, z."end" - a.start) AS text
FROM wk k JOIN tk a ON a.doc_id = k.doc_id AND a.run_no = k.run_no AND a.pos = k.pos
JOIN tk z ON z.doc_id = k.doc_id AND z.run_no = k.run_no AND z.pos = k.pos + k.n - 1 JOIN documents d ON d.doc_id = k.doc_id"""


def _tags_sql(threshold):
    return core(TXT, "spans", threshold=threshold) + """
SELECT m.doc_id, m.run_no, m.pos, CASE WHEN s.label IS NULL THEN 'O' WHEN m.pos = s.first_pos THEN 'B-' || s.label
  ELSE 'I-' || s.label END AS tag FROM marked m LEFT JOIN spans s ON s.doc_id = m.doc_id AND s.run_no = m.run_no AND s.span = m.span
WHERE m.is_tok"""


ORACLES.update({
    "throughput_sliding": f"""WITH {LEDGER},
dn AS (SELECT ts, duration FROM ledger WHERE status = 'done'),
ws AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS w, duration FROM dn
       UNION ALL SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes', duration FROM dn)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS w_start, count(*) AS n, round(avg(duration), 6) AS avg_s FROM ws GROUP BY w""",
    "token_accuracy": f"""WITH g AS ({_tags_sql(0.6)}), p AS ({_tags_sql(0.7)})
SELECT count(*) AS n_tokens, count(*) FILTER (WHERE g.tag = p.tag) AS n_equal,
  round(count(*) FILTER (WHERE g.tag = p.tag) / nullif(count(*), 0), 6) AS accuracy
FROM g JOIN p ON p.doc_id = g.doc_id AND p.run_no = g.run_no AND p.pos = g.pos""",
})
