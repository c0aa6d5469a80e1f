"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import (
    html_blocks, language, merge_dropout, order_minhash, orc_tokens, packing, prefix_trie, repetition, token_counts, topk, url_filter,
    vector_codes, warc)
from redactum.llm.common import prepare, table
from redactum.llm.tokens import default_path

END_ID = 2


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.identify(table(spark, sf_dir, "documents"))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return orc_tokens.store_tokens(spark, docs, default_path("word_bpe_49k.json"), END_ID)[1]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    _, rows = warc.archive(spark, table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return rows.filter("gap IS NULL").select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", number(F.col("refers_id"))).alias("refers_to"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(spark, docs, default_path("byte_bpe_50k.json"), END_ID)


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return merge_dropout.encode_decode(table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark, table(spark, sf_dir, "pages"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repetition.quality(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark, table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_topk, op2_order_minhash, op3_language, op4_html_blocks, op5_orc_tokens, op6_warc, op7_packing,
    op8_merge_dropout, op9_url_filter, op10_repetition, op11_token_counts, op12_prefix_trie, op13_vector_codes)}
TOP_K_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.n AS query, q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10"""


def _covered_sql(n: int) -> str:
    """c<n>(doc_id, p): words under a window of n words found twice or more."""
    return f"""
w{n} AS (SELECT doc_id, i, list_slice(ws, i, i + {n - 1}) AS g FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM t WHERE len(ws) >= {n})),
d{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w{n}),
c{n} AS (SELECT DISTINCT doc_id, i + o AS p FROM d{n}, unnest(range({n})) AS u(o) WHERE c > 1),
s{n} AS (SELECT c.doc_id, count(*) AS words, sum(length(w)) AS chars FROM c{n} c
         JOIN words USING (doc_id, p) GROUP BY c.doc_id)"""


_SPACES = "\\x20\\x09-\\x0D"
REPETITION_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS ws
           FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM t),
chars AS (SELECT doc_id, sum(length(w)) AS chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
repeated AS (SELECT doc_id, line, count(*) - 1 AS n FROM lines WHERE regexp_matches(line, '[^{_SPACES}]')
             GROUP BY doc_id, line HAVING count(*) > 1),
dup AS (SELECT doc_id, sum(n) AS n, sum(n * length(regexp_replace(line, '[{_SPACES}]', '', 'g'))) AS chars
        FROM repeated GROUP BY doc_id),
{",".join(_covered_sql(n) for n in (repetition.BASE_WINDOW, *repetition.LIMITS))},
m AS (SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(chars.chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(s8.words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars,
    {", ".join(f"CAST(coalesce(s{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars" for n in repetition.LIMITS)}
  FROM t LEFT JOIN chars USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN s8 USING (doc_id)
  {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in repetition.LIMITS)}),
b AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.BASE_PERCENT} * n_words AS base_failed
      FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {repetition.LINE_LIMIT} * word_chars
    AND {" AND ".join(f"dup_{n}gram_chars <= {x} * word_chars" for n, x in repetition.LIMITS.items())} AS kept FROM b"""

# crc32 of the decimal id, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
        lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

TRIE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                   sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS k FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS head, {_CRC} % 9 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS half, k, role, text FROM c JOIN o ON o.conv_id = c.head AND k <= h
      UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
q AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY half, k) FILTER (k IS NOT NULL) AS turns
      FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE turns[1:d] END AS p, d = coalesce(len(turns), 0) AS ends
      FROM (SELECT *, unnest(range(0, coalesce(len(turns), 0) + 1)) AS d FROM q)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].text) END AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM m GROUP BY p, d),
kids AS (SELECT CASE WHEN d = 1 THEN [] ELSE p[1:d - 1] END AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (p)),
sub AS (SELECT CASE WHEN k = 0 THEN [] ELSE p[1:k] END AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM x) GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, sub.n_leaves,
       CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN sub USING (p) LEFT JOIN x up ON x.d > 0 AND up.d = x.d - 1 AND up.p = (CASE WHEN x.d = 1 THEN [] ELSE x.p[1:x.d - 1] END)"""


def _codes_sql(parts: int, entries: int, factor: int, rounds: int) -> str:
    def assigned(k: int) -> str:
        """a<k>(r, p, m): the least distance of a part times ``entries`` plus its entry."""
        return f"""
a{k} AS (SELECT r, p, min(dist * {entries} + e) AS m FROM (
    SELECT r, p, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS HUGEINT) AS dist
    FROM part JOIN (SELECT p, e, x AS y FROM b{k}) USING (p)) GROUP BY r, p)"""

    def moved(k: int) -> str:
        return f"""
s{k} AS (SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, sum(v) AS s, count(*) AS c FROM (
        SELECT p, CAST(m % {entries} AS BIGINT) AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM part JOIN a{k} USING (r, p))
    GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(s{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN s{k} USING (p, e))"""

    steps = ",".join(f"{assigned(k)},{moved(k)}" for k in range(rounds))
    return f"""
WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {parts} = 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM f),
kept AS (SELECT * FROM k WHERE len(v) = (SELECT len(v) FROM k WHERE r = 1)),
part AS (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
         FROM (SELECT *, unnest(range({parts})) AS p FROM kept)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e, x FROM part
       QUALIFY row_number() OVER (PARTITION BY p ORDER BY r) <= {entries}),{steps},{assigned(rounds)},
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
          FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM b{rounds})),
coded AS (SELECT r, string_agg(format('{{:02x}}', CAST(m % {entries} AS BIGINT)), '' ORDER BY p) AS code,
                 CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books"""


ORACLES: dict[str, str] = {
    "op1_topk": TOP_K_SQL, "op10_repetition": REPETITION_SQL, "op12_prefix_trie": TRIE_SQL,
    "op13_vector_codes": _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.FACTOR, vector_codes.ROUNDS)}
