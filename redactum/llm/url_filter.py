"""URL filter by a character language-model ratio, DataFrame functions only.

Rules judge the URLs they fit. The others are judged by two smoothed
variable-order Markov models over characters, one of accepted and one of
rejected URLs (those that a rule allows or blocks). A URL's score is the
difference of its log-likelihoods under the two models, divided by the number
of characters; it is allowed at or above a threshold calibrated on the judged
URLs.

Model: host and path are lower-cased, digits become ``0``, other characters
outside ``a-z 0 . / _ -`` become ``~``; ``^^`` goes before, ``$`` behind. The
alphabet has 34 symbols, so there are at most 34**3 = 39,304 trigrams whatever
the input: the one table that is broadcast has that many rows at most. Per
class, with ``n`` the counts and ``t(h)`` the distinct symbols after ``h``,

    P(c)    = (n(c) + 1) / (n + 34)
    P(c|h)  = (n(hc) + t(h) P(c|h')) / (n(h) + t(h)),  h' without its first symbol

over contexts of up to two symbols; a context never seen falls to the shorter
one. Log differences are kept as whole millionths, so sums are exact in any
order.

Threshold: the point equally many standard deviations from both classes' mean
scores. Without accepted or without rejected URLs every other URL is allowed.
Null URLs and those without ``://`` have an empty host and path and are judged
like the rest; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redactum.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 34
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def folded(host: Column, path: Column) -> Column:
    """The text that the models see."""
    low = F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "0" * 9)
    return F.concat(F.lit("^^"), F.regexp_replace(low, r"[^a-z0./_\-]", "~"), F.lit("$"))


def trigrams(text: Column) -> Column:
    chars = F.split(text, "")
    return F.transform(F.sequence(F.lit(0), F.length(text) - 3),
                       lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))


def model(texts: DataFrame) -> DataFrame:
    """(text, n_allow, n_block, ...) -> (gram, delta) for every trigram of the texts.

    ``texts`` holds distinct texts with the number of judged rows of either
    class. One pass counts trigrams (summed before the shuffle); all shorter
    counts are sums over that bounded table.
    """
    tri = (texts.select(F.explode(trigrams(F.col("text"))).alias("gram"), "n_allow", "n_block")
           .groupBy("gram").agg(F.sum("n_allow").alias("allow"), F.sum("n_block").alias("block")))
    tri = tri.select("gram", F.substring("gram", 1, 2).alias("h2"), F.substring("gram", 2, 1).alias("h1"),
                     F.substring("gram", 2, 2).alias("pair"), F.substring("gram", 3, 1).alias("c"), "allow", "block")
    pairs = tri.groupBy("pair", "h1", "c").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    ones = pairs.groupBy("c").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))

    def smooth(df, context, k, lower=None):
        """Add p<k>_allow and p<k>_block to a table of counts of (context, c)."""
        w = W.partitionBy(context)
        for side in ("allow", "block"):
            n, t = F.sum(side).over(w), F.sum((F.col(side) > 0).cast("long")).over(w)
            p = (F.col(side) + t * F.col(f"p{lower}_{side}")) / (n + t)
            df = df.withColumn(f"p{k}_{side}", F.when(n > 0, p).otherwise(F.col(f"p{lower}_{side}")))
        return df

    total = W.partitionBy(F.lit(1))  # at most 34 rows
    for side in ("allow", "block"):
        ones = ones.withColumn(f"p1_{side}", (F.col(side) + 1) / (F.sum(side).over(total) + SYMBOLS))
    pairs = smooth(pairs.join(ones.drop("allow", "block"), "c"), "h1", 2, 1)
    tri = smooth(tri.join(pairs.select("pair", "p2_allow", "p2_block"), "pair"), "h2", 3, 2)
    delta = F.round(1e6 * (F.log("p3_allow") - F.log("p3_block"))).cast("long")
    return tri.select("gram", delta.alias("delta"))


def score(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(text) distinct -> (text, score): mean log difference per character."""
    per = (texts.select("text", F.explode(trigrams(F.col("text"))).alias("gram"))
           .join(F.broadcast(grams), "gram")  # at most SYMBOLS ** 3 rows
           .groupBy("text").agg(F.sum("delta").alias("total")))
    return per.select("text", (F.col("total") / 1e6 / (F.length("text") - 2)).alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """From (score, n_allow, n_block) of distinct texts; one row comes back."""
    a, b, s = F.col("n_allow"), F.col("n_block"), F.col("score")
    r = scored.agg(F.sum(a).alias("na"), F.sum(b).alias("nb"), F.sum(a * s).alias("sa"), F.sum(b * s).alias("sb"),
                   F.sum(a * s * s).alias("qa"), F.sum(b * s * s).alias("qb")).first()
    if not r.na or not r.nb:
        return None
    ma, mb = r.sa / r.na, r.sb / r.nb
    da, db = (max(q / n - m * m, 0.0) ** 0.5 for q, n, m in ((r.qa, r.na, ma), (r.qb, r.nb, mb)))
    return round((ma * db + mb * da) / (da + db) if da + db > 0 else (ma + mb) / 2, 6)


def filter_urls(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", folded(F.col("host"), F.col("path")).alias("text"), rule.alias("rule"), said.alias("said"))
    texts = stored(spark, rows.groupBy("text").agg(
        F.sum((F.col("said") == "allow").cast("long")).alias("n_allow"),
        F.sum((F.col("said") == "block").cast("long")).alias("n_block")).na.fill(0), "url-texts")
    grams = stored(spark, model(texts), "url-model")
    scores = stored(spark, score(texts, grams).join(texts, "text"), "url-scores")
    least = threshold(scores)
    mine = F.lit("allow") if least is None else F.when(F.col("score") >= F.lit(least), "allow").otherwise("block")
    return (rows.join(scores.select("text", "score"), "text")
            .select("page_id", "host", "path", "rule", F.coalesce("said", mine).alias("verdict"), "score"))
