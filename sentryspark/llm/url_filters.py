"""URL filters: given rules, and association rules mined from the urls that they label.

Urls are split into tokens (scheme, labels of the host, path segments, query names). Tokens that
reach the support are candidates. One that reaches the confidence alone is a rule of its own and takes
no part in combinations, which it would only lengthen. Of the others, tokens that occur in the same
urls count as one item, and equal sets of items are counted once. All frequent combinations of a url's
items are counted, however many it has, but those that are in the same urls as a shorter one or in urls of
one label only, as they cannot decide. Combinations that reach support and confidence for a label are the
mined rules; one that only adds a token to a rule of no less confidence is dropped.

Rules are indexed by their rarest token: a url meets only the rules listed under one of its tokens, and
a rule counts if the url has all its tokens. The rule of the highest confidence, then support, then
fewest tokens, decides; without any, the url is allowed.

A null url, or one without ``://``, has an empty host and path and no tokens, and is allowed. Without
labelled urls there are no mined rules. Repeated rows get the same verdict. An empty table gives no row.
A long url is one array of tokens. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import query, table, written

# The given rules (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Parameters of the mined rules.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_REST = "substring(url, instr(url, '://') + 3)"
_HAS = "coalesce(instr(url, '://') > 0, false)"
HOST = f"IF({_HAS}, translate(regexp_extract({_REST}, '^[^/?#]*', 0), {_LOWER}), '')"
PATH = f"IF({_HAS}, regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '')"
QUERY_NAMES = "regexp_extract_all(url, '[?&]([^=&#]+)', 1)"
TOKENS = (
    f"IF({_HAS}, array_distinct(filter(concat("
    "array(concat('s:', substring_index(url, '://', 1))), "
    "transform(split(host, '[.]'), x -> IF(x = '', '', concat('h:', x))), "
    "transform(split(path, '/'), x -> IF(x = '', '', concat('p:', x))), "
    f"transform({QUERY_NAMES}, x -> concat('q:', x))), x -> x <> '')), array())"
)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``rule_verdict`` of the longest rule that fits."""
    listed = ", ".join(
        f"named_struct('size', {len(host + path)}, 'rule', '{host + path}', 'verdict', '{verdict}', "
        f"'host', '{host}', 'path', '{path}')" for verdict, host, path in rules)
    fits = ("filter(array({}), r -> (host = r.host OR endswith(host, concat('.', r.host))) "
            "AND startswith(path, r.path))").format(listed)
    return (
        pages.withColumn("host", F.expr(HOST)).withColumn("path", F.expr(PATH))
        .withColumn("__best", F.array_max(F.expr(fits)))
        .withColumn("rule", F.col("__best.rule")).withColumn("rule_verdict", F.col("__best.verdict"))
        .drop("__best")
    )


RULE_SHAPE = "tokens array<string>, verdict string, confidence double, support double"


def token_counts(baskets: DataFrame) -> DataFrame:
    """(token, n, blocked, places) of all tokens: urls, blocked ones, and a print of which urls."""
    print_of = F.xxhash64("url").cast("decimal(38, 0)")
    return baskets.select("url", "label", F.explode("own").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("blocked"),
        F.sum(print_of).alias("places"))


def mine_rules(labelled: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence, support, token): mined rules under their rarest token.

    ``labelled`` has ``url``, ``host``, ``path`` and a ``label``. The frequent tokens and the rules are
    few by the support, which bounds what is broadcast: a url's tokens divided by MIN_SUPPORT.
    """
    spark = labelled.sparkSession
    baskets = written(labelled.selectExpr("url", "label", f"{TOKENS} AS own"), "labelled-urls")
    total = baskets.count()
    if not total:
        return spark.createDataFrame([], f"{RULE_SHAPE}, token string")
    blocked = F.col("blocked") / F.col("n")
    frequent = written(
        token_counts(baskets).where(F.col("n") >= MIN_SUPPORT * total)
        .withColumn("confidence", F.greatest(blocked, 1 - blocked))
        .withColumn("verdict", F.when(blocked >= 0.5, F.lit("block")).otherwise(F.lit("allow"))),
        "frequent-tokens")
    decided = F.col("confidence") >= MIN_CONFIDENCE
    alone = frequent.where(decided).select(
        F.array("token").alias("tokens"), "verdict", "confidence", (F.col("n") / total).alias("support"))
    items = frequent.where(~decided).groupBy("places", "n", "confidence").agg(
        F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members"))
    combined = combinations_of(baskets, items, total)
    rules = written(without_longer(alone.unionByName(combined)), "mined-rules")
    return (
        rules.withColumn("token", F.explode("tokens")).join(frequent.select("token", "n"), "token")
        .groupBy("tokens", "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    )


def combinations_of(baskets: DataFrame, items: DataFrame, total: int) -> DataFrame:
    """Rules over several undecided items, counted size by size over the distinct sets of items.

    A set is taken further while a label still reaches the support, both labels are in it, and it is in
    fewer urls than any set of one item less. Others only lengthen a rule that is as good for every url
    they are in, which would decide first. So no item of a url is left out.
    """
    spark = baskets.sparkSession
    # Rows get their numbers before they are taken apart.
    numbered = baskets.select(F.monotonically_increasing_id().alias("row"), "label", "own").select(
        "row", "label", F.explode("own").alias("item"))
    held = written(
        numbered.join(F.broadcast(items.select("item")), "item")
        .groupBy("row", "label").agg(F.sort_array(F.collect_list("item")).alias("held"))
        .groupBy("held").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("blocked")),
        "url-items")
    found = spark.createDataFrame([], "items array<string>, n long, label_n long, verdict string")
    # Sets of items, each with the place of its last one in the url's items.
    sets = held.select("*", F.posexplode("held").alias("at", "item")).withColumn("items", F.array("item")).drop("item")
    shorter, size = None, 1
    while True:
        sets = written(sets, "item-sets")
        counted = sets.groupBy("items").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).select(
            "items", "n", F.greatest("blocked", F.col("n") - F.col("blocked")).alias("label_n"),
            F.expr("IF(2 * blocked >= n, 'block', 'allow')").alias("verdict")).where(
            F.col("label_n") >= MIN_SUPPORT * total)
        if shorter is not None:
            counted = fewer_urls(counted, shorter, size)
        counted = written(counted, "item-counts")
        if size > 1:
            found = found.unionByName(counted.where(F.col("label_n") >= MIN_CONFIDENCE * F.col("n")))
        shorter = counted.where("label_n < n")
        if shorter.isEmpty():
            break
        sets = sets.join(shorter.select("items"), "items").withColumn(
            "at", F.explode(F.expr("filter(sequence(0, size(held) - 1), x -> x > at)"))).withColumn(
            "items", F.expr("array_append(items, held[at])"))
        size += 1
    mined = found.select(
        F.monotonically_increasing_id().alias("rule"), "items", "verdict",
        (F.col("label_n") / F.col("n")).alias("confidence"), (F.col("label_n") / total).alias("support"))
    mined = mined.select("*", F.explode("items").alias("item")).drop("items")
    return (
        written(mined, "item-rules").join(F.broadcast(items.select("item", "members")), "item")
        .groupBy("rule", "verdict", "confidence", "support")
        .agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("tokens"))
        .select("tokens", "verdict", "confidence", "support")
    )


def fewer_urls(counted: DataFrame, shorter: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` items whose sets of one item less are all in ``shorter`` and in more urls."""
    parts = counted.select("items", F.col("n").alias("own"), F.explode("items").alias("left_out")).select(
        F.col("items").alias("whole"), "own", F.expr("filter(items, x -> x <> left_out)").alias("items"))
    narrower = parts.join(shorter.select("items", "n"), "items").where("n > own").groupBy("whole").agg(
        F.count("*").alias("parts")).where(F.col("parts") == size)
    return counted.join(narrower.select(F.col("whole").alias("items")), "items", "left_semi")


def without_longer(rules: DataFrame) -> DataFrame:
    """Rules but those that add one token to a rule of the same verdict and no less confidence."""
    shorter = rules.select("*", F.posexplode("tokens").alias("at", "left_out")).select(
        "tokens", "verdict", F.expr("filter(tokens, x -> x <> left_out)").alias("part"))
    own = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("known"))
    best = shorter.join(own, ["part", "verdict"]).groupBy("tokens", "verdict").agg(F.max("known").alias("known"))
    return rules.join(best, ["tokens", "verdict"], "left").where(
        "known IS NULL OR known < confidence").drop("known")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_verdict): the verdict of the best mined rule of each url that meets one.

    ``urls`` has ``url``, ``host`` and ``path``. Rules come to the urls, so matching is done where
    the urls are read and only matches are shuffled, once per url and task.
    """
    met = urls.selectExpr("url", f"{TOKENS} AS own").withColumn("token", F.explode("own"))
    met = met.join(F.broadcast(rules), "token")
    best = F.max(F.struct("confidence", "support", -F.size("tokens"), "verdict"))
    return (
        met.where("size(array_except(tokens, own)) = 0")
        .groupBy("url").agg(best["verdict"].alias("mined_verdict"))
    )


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_verdict) of every page."""
    marked = with_rule(pages.select("page_id", "url"), rules)
    labelled = marked.where("rule IS NOT NULL").withColumn("label", F.col("rule_verdict"))
    mined = written(mine_rules(labelled), "url-rules")
    found = match_rules(marked.where("url IS NOT NULL"), mined)
    return marked.join(found, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "mined_verdict", F.lit("allow")).alias("verdict"),
        "mined_verdict")


@query("op1_url_filters")
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
