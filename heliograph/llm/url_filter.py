"""URL filtering by association rules over the tokens of hosts and paths.

Hand-written host and path rules label the urls that they fit; all urls are transactions, with a verdict where there is a
label. So a combination's confidence is the share of blocked ones among all urls that hold it, and unlabelled urls count
against it. Rules have MOST_TOKENS tokens at most, a limit of the model and of the mining alike: tokens of too little
support are dropped first (no combination with one can pass), tokens of the very same urls are mined as one (a rule on any
of them says the same), and the combinations of up to MOST_TOKENS of what is left of a url become the transactions
{combination, verdict} of Spark's FP-growth, whose rules pass the support and confidence bounds. A url of m such tokens
costs m^3 / 6 combinations, never 2^m. The model judges the urls that no hand-written rule fits. Rules are matched through an
inverted index: each url looks up the rules of its own tokens and a rule applies where all of its tokens are found. Beyond
BROADCAST_RULES rules the index is joined by a shuffle.

Defined cases: null urls and urls without :// have an empty host and path and fit no rule; what no mined rule blocks
is allowed. With no labelled url all others are allowed. Repeated rows are transactions each.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import common as C

#: Rule (host and path), verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
SUPPORT = 0.005
LEAST = 10  # urls that must hold a combination, however few there are in all
CONFIDENCE = 0.6
MOST_TOKENS = 3
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, lower-cased in A-Z; without :// empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first, so it is put on last
        h, _, p = text.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct items of a url: its host's labels, its top-level domain by name, its path's segments by depth (numbers as one)."""
    labels = F.filter(F.split(host_, r"\."), lambda x: x != "")
    segments = F.transform(F.filter(F.split(path_, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    depth = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), x))
    top = F.transform(F.slice(F.reverse(labels), 1, 1), lambda x: F.concat(F.lit("tld="), x))
    return F.array_distinct(F.concat(top, F.transform(labels, lambda x: F.concat(F.lit("h="), x)), depth))


def combinations(items: Column, most: int) -> Column:
    """All combinations of one to `most` (at most 3) of the items, each an array in the order of the items."""
    after = lambda i: F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
    out = [F.transform(items, lambda a: F.array(a))]
    if most > 1:
        out.append(F.flatten(F.transform(items, lambda a, i: F.transform(after(i), lambda b: F.array(a, b)))))
    if most > 2:
        third = lambda i, j: F.slice(items, i + j + 3, F.greatest(F.size(items) - i - j - 2, F.lit(0)))
        out.append(F.flatten(F.transform(items, lambda a, i: F.flatten(F.transform(after(i), lambda b, j: F.transform(third(i, j), lambda c: F.array(a, b, c)))))))
    return F.concat(*out)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST_TOKENS) -> DataFrame:
    """Rules (rule_id, tokens, n, confidence, support) for blocking, from rows (items, verdict or null)."""
    if most not in (1, 2, 3):
        raise ValueError("rules have one to three tokens")
    spark = labelled.sparkSession
    rows = C.cut(labelled.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("items").alias("items"), "verdict"))
    schema = "rule_id long, tokens array<string>, n int, confidence double, support double"
    n = rows.count()
    least = math.ceil(max(support * n, LEAST) - 1e-9)
    held = rows.select("row", F.explode("items").alias("token"))
    # A token's urls are told by their number and two sums of hashes.
    stats = held.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")).filter(F.col("n") >= least)
    one = stats.groupBy("n", "a", "b").agg(F.min("token").alias("one"))
    one = C.cut(stats.join(one, ["n", "a", "b"]).select("token", "one"))
    short = held.join(one, "token").groupBy("row").agg(F.array_sort(F.collect_set("one")).alias("items"))
    made = rows.select("row", "verdict").join(short, "row").select(F.explode(combinations(F.col("items"), most)).alias("tokens"), "verdict")
    mark = F.when(F.col("verdict").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("verdict="), F.col("verdict"))))
    made = C.cut(made.select(F.concat(F.array(F.concat(F.lit("of="), F.to_json("tokens"))), mark).alias("items")))
    total = made.count()
    if not total:
        return spark.createDataFrame([], schema)
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total), minConfidence=confidence).fit(made)
    rules = frequent.associationRules.filter((F.element_at("consequent", 1) == "verdict=block") & F.element_at("antecedent", 1).startswith("of="))
    rules = rules.select(F.element_at("antecedent", 1).alias("key"), "confidence", F.round(F.col("support") * total).alias("hits"))
    tokens_of = F.from_json(F.substring("key", F.lit(4), F.length("key")), "array<string>")
    rules = rules.select(tokens_of.alias("tokens"), "confidence", (F.col("hits") / n).alias("support"))
    return C.cut(rules.select(F.xxhash64("tokens").alias("rule_id"), "tokens", F.size("tokens").alias("n"), "confidence", "support"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per key the best confidence of the mined rules that apply; rows (key, items)."""
    index = rules.select(F.explode("tokens").alias("token"), "rule_id", "n", "confidence")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = urls.select("key", F.explode("items").alias("token")).join(index, "token")
    full = hits.groupBy("key", "rule_id", "n", "confidence").agg(F.count("*").alias("found")).filter("found = n")
    return full.groupBy("key").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages(page_id, url): page_id, host, path, rule, verdict, confidence (of a mined rule; else null)."""
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"))
    items = tokens(F.col("host"), F.col("path"))
    mined = mine(base.select(items.alias("items"), F.col("given").alias("verdict")))
    # Equal urls are judged once: hosts and paths are the key of the inverted search.
    key = F.struct("host", "path")
    open_ = base.filter("given is null").select(key.alias("key"), items.alias("items")).dropDuplicates(["key"])
    found = matched(open_, mined).select("key.host", "key.path", "confidence")
    both = base.join(found, ["host", "path"], "left")
    verdict = F.coalesce("given", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("confidence")


def _oracle() -> str:
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    longest = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in longest) + " END"
    return f"""
WITH r AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS MATERIALIZED (
  SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r
), g AS MATERIALIZED (
  SELECT *, {case(0)} AS rule, {case(1)} AS given, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels,
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '0', 'g')) AS segments FROM p
), t AS MATERIALIZED (
  SELECT DISTINCT n, given, unnest(list_concat(list_transform(labels[-1:], lambda x: 'tld=' || x), list_transform(labels, lambda x: 'h=' || x),
    list_transform(segments, lambda x, i: 'p' || (i - 1) || '=' || x))) AS t FROM g
), least AS (
  SELECT ceil(greatest({SUPPORT} * count(*), {LEAST}) - 1e-9) AS least FROM g
), f AS MATERIALIZED (
  SELECT t.* FROM t JOIN (SELECT t FROM t, least GROUP BY t, least HAVING count(*) >= least) USING (t)
), c AS MATERIALIZED (
  SELECT n, given, t AS a, '' AS b, '' AS c FROM f
  UNION ALL SELECT x.n, x.given, x.t, y.t, '' FROM f x JOIN f y ON x.n = y.n AND x.t < y.t
  UNION ALL SELECT x.n, x.given, x.t, y.t, z.t FROM f x JOIN f y ON x.n = y.n AND x.t < y.t JOIN f z ON z.n = x.n AND y.t < z.t
), rules AS (
  SELECT a, b, c FROM c, least GROUP BY a, b, c, least HAVING count(*) FILTER (given = 'block') >= least AND count(*) FILTER (given = 'block') / count(*) >= {CONFIDENCE}
), bad AS (
  SELECT DISTINCT n FROM c JOIN rules USING (a, b, c)
)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN bad.n IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM g LEFT JOIN bad USING (n)
"""


ORACLE = _oracle()
