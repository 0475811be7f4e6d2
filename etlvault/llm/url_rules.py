"""URL filter: given rules first, then association rules mined by FP-growth, all in DataFrame operations.

A given rule is a host and a path; it fits the host and its subdomains where the path of the url
begins with its own, and the longest fitting rule decides. Urls without a fitting rule are judged
by mined rules: combinations of url tokens that labelled pages of one verdict share with enough
support and confidence. Mined rules are indexed by their rarest token; the tokens of a url look up
that index and each rule found is checked for its other tokens. The most confident one decides, the
longer one of equals, block before allow; without any the verdict is allow.

Labels: a page is labelled by a fitting given rule, else by its row in ``labels`` (block when toxic
or of quality 0).

Defined cases: a NULL url and one without ``://`` have an empty host and path, fit no rule and are
allowed; NULL labels are no labels; several labels of one id block if one of them does; repeated rows and NULL
ids are judged like others, as a verdict depends on the url alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import cut, read

MIN_SUPPORT = 0.004     # share of the labelled pages that hold a combination
MIN_PAGES = 10          # and their number
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.05
ALLOW, BLOCK = "allow", "block"
LABEL = "label="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The given rules, as (host, path, verdict).
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL."""
    by_length = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
             for h, p, v in by_length]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, registered domain, path segments (numbers as #), query keys, fragment."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))),
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("domain="), F.substring_index(host, ".", -2)))).otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(F.lower(x), "[0-9]+", "#"))),
        F.transform(keys, lambda x: F.concat(F.lit("query="), F.lower(F.substring_index(x, "=", 1)))),
        F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(items, verdict, confidence) of the rules that (tokens, verdict) rows support.

    Support bounds the number of frequent combinations whatever the number of rows. Of rules
    with one verdict, those with a shorter rule inside that is as confident are pruned.
    """
    spark = labelled.sparkSession
    schema = "items array<string>, verdict string, confidence double"
    rows = labelled.count()
    if not rows:
        return spark.createDataFrame([], schema)
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_PAGES / rows)), minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL) & (F.col("lift") >= MIN_LIFT)
                                          & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
             .select(F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 99).alias("verdict"), "confidence"))
    rules = cut(rules)
    # a rule without one of its items, as long as anything is left of it
    inside = (rules.where(F.size("items") > 1).select("*", F.explode("items").alias("without"))
              .select("items", "verdict", F.col("confidence").alias("own"), F.array_remove("items", F.col("without")).alias("shorter")))
    needless = (inside.join(rules.select(F.col("items").alias("shorter"), "verdict", F.col("confidence").alias("other")), ["shorter", "verdict"])
                .where(F.col("other") >= F.col("own")).select("items", "verdict").distinct())
    return rules.join(needless, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence")


def index_of(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules by their rarest token: (token, items, verdict, confidence)."""
    needed = rules.select("items", "verdict", "confidence", F.explode("items").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    return (needed.join(seen, "token", "left").groupBy("items", "verdict", "confidence")
            .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest")).select("rarest.token", "items", "verdict", "confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every page; ``mined`` holds the tokens of the mined rule that decided."""
    url = F.col("url")
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    base = parts.withColumn("given", fitting_rule(F.col("host"), F.col("path"), rules))

    known = (labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)").groupBy(F.col("doc_id").alias("page_id"))
             .agg(F.max((F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)))).alias("bad")))
    labelled = (base.join(known, "page_id", "left")
                .select(tokens_of(url, F.col("host"), F.col("path")).alias("tokens"), "host",
                        F.coalesce("given.verdict", F.when(F.col("bad"), BLOCK).when(~F.col("bad"), ALLOW)).alias("verdict"))
                .where("verdict IS NOT NULL AND host <> ''").select("tokens", "verdict"))
    mined = mine(labelled)

    open_urls = (base.where("given IS NULL AND host <> ''").select("url", "host", "path").distinct()
                 .select("url", tokens_of(url, F.col("host"), F.col("path")).alias("tokens")))
    index = index_of(mined, open_urls)
    best = F.struct(F.col("confidence"), F.size("items").alias("n"), F.col("verdict"), F.col("items"))
    decided = (open_urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
               .where(F.size(F.array_except("items", "tokens")) == 0)
               .groupBy("url").agg(F.max(best).alias("found")).select("url", F.col("found.verdict").alias("by_tokens"), F.col("found.items").alias("mined")))
    out = base.join(decided, "url", "left")
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"),
                      F.coalesce("given.verdict", "by_tokens", F.lit(ALLOW)).alias("verdict"), "mined")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLE: dict[str, str] = {}
