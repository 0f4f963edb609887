"""URL filters: listed rules by host and path, and association rules mined from labelled URLs.

Spark's FP-growth finds combinations of URL tokens that go with a bad label. Rules with enough support and confidence are
kept, and pruned where a part of their tokens says as much; an inverted index on each rule's rarest token finds the rules
that a URL may fit. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import beside, sampled
from tamis.session import written

#: Listed rules: verdict, host, path.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share of labelled URLs that hold a rule's tokens and the label, and least share of the URLs with the tokens that do.
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Least number of bad URLs behind a rule, whatever the share, and standard errors by which its confidence must exceed the share of bad
#: URLs among all labelled ones (lower end of Wilson's interval).
LEAST, ERRORS = 10, 2.0
#: Labelled URLs that rules are mined from: those with the smallest hash of their row, about so many.
LABELLED = 2_000_000
BAD = "label:bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest listed rule (host and path, like ``net/``) that fits, and its verdict; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Equally long rules go by host, then path.
    The rules are a parameter, checked in order of length by one expression.
    """
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host, its registered end, host words, path words without digits, query names."""
    labels = F.split(host, r"\.")
    words = F.regexp_extract_all(host, F.lit(r"([a-z]+)"), 1)
    segments = F.filter(F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), "/"), lambda s: s != "")
    query = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), 1)
    prefixed = lambda mark, array: F.transform(array, lambda t: F.concat(F.lit(mark), t))
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("end:"), F.element_at(labels, -1))),
        prefixed("word:", words), prefixed("path:", segments), prefixed("query:", query),
    ))


def mine(
    urls: DataFrame, bad: Column, *, support: float = SUPPORT, confidence: float = CONFIDENCE, limit: int = LABELLED,
    least: int = 1, errors: float | None = None,
) -> DataFrame:
    """Rules from labelled urls (column ``url``): rule_id, tokens, key (the rarest token), support, confidence.

    FP-growth runs over about ``limit`` labelled URLs at most; a rule whose tokens include those of another rule with as much
    confidence is pruned. The number of rules is bounded by the support, not by the URLs. A rule rests on ``least`` bad URLs at least;
    with ``errors``, so many standard errors below its confidence must still lie above the share of bad URLs among all.

    Tokens found with the label less often than the support are dropped before, which loses no rule. Of tokens that the same
    URLs hold, one is mined: a rule with two of them would be pruned, and a rule with one of them holds for each.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    labelled = sampled(urls.where(bad.isNotNull()), limit, *urls.columns).select("url", bad.alias("bad"))
    baskets = written(labelled.select(
        F.monotonically_increasing_id().alias("row"), "bad", tokens(host, path, F.col("url")).alias("items")
    ), "baskets")
    total, all_bad = baskets.agg(F.count("*"), F.count_if("bad")).head()
    least = max(math.ceil(support * total), least, 1)
    if least > total:
        return _no_rules(urls.sparkSession)
    held = baskets.select("row", "bad", F.explode("items").alias("token"))
    # Two hashes of the set of rows that hold a token: tokens of one set are mined as one.
    counts = held.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("n_bad"),
        F.bit_xor(F.xxhash64("row")).alias("print"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("other_print"),
    ).where((F.col("n_bad") >= least) & (F.col("n_bad") > 0))
    classes = written(counts.groupBy("print", "other_print", "n").agg(F.array_sort(F.collect_list("token")).alias("members")), "token-classes").select(
        F.col("members")[0].alias("token"), "members", "n"
    )
    named = held.join(beside(classes.select("token"), "class-names"), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    mined = written(baskets.select("row", "bad").join(named, "row", "left").select(F.concat(
        F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    ).alias("items")), "mined-baskets")
    model = FPGrowth(itemsCol="items", minSupport=least / total * (1 - 1e-9), minConfidence=confidence).fit(mined)
    found = written(
        model.associationRules.where(F.element_at("consequent", 1) == BAD)
        .where(_telling(total, all_bad, errors)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules",
    )
    # A rule is pruned by a rule on fewer of its tokens: its subsets, each looked up by value, not pairs of rules.
    singles = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    parts = found.select("tokens", "confidence", F.posexplode("tokens").alias("at", "token")).select(
        "tokens", "confidence", F.array_remove("tokens", F.col("token")).alias("part")
    ).unionByName(found.select("tokens", "confidence", F.explode(F.transform("tokens", lambda t: F.array(t))).alias("part")).where(F.size("tokens") > 1))
    worse = parts.join(singles, "part").where(F.col("part_confidence") >= F.col("confidence")).select("tokens").distinct()
    kept = found.join(worse, "tokens", "left_anti")
    # A kept rule stands for every choice of one member from each of its classes.
    told = kept.select("tokens", "support", "confidence", F.explode("tokens").alias("token")).join(classes, "token").groupBy(
        "tokens", "support", "confidence"
    ).agg(F.collect_list(F.struct("n", "members")).alias("parts"))
    rules = told.select("support", "confidence", F.explode(F.aggregate(
        "parts", F.array(F.array().cast("array<struct<n:bigint,token:string>>")),
        lambda done, part: F.flatten(F.transform(done, lambda d: F.transform(
            part["members"], lambda m: F.concat(d, F.array(F.struct(part["n"].alias("n"), m.alias("token"))))
        ))),
    )).alias("chosen")).select("support", "confidence", F.array_sort(F.col("chosen.token")).alias("tokens"), F.array_min("chosen")["token"].alias("key"))
    return written(rules.select(F.concat_ws(" ", "tokens").alias("rule_id"), "tokens", "key", "support", "confidence"), "kept-rules")


def _telling(total: int, all_bad: int, errors: float | None) -> Column:
    """Whether a rule's confidence exceeds the share of bad URLs by more than chance gives it."""
    if errors is None:
        return F.lit(True)
    share, count, square = F.col("confidence"), F.col("support") * total / F.col("confidence"), errors * errors
    spread = errors * F.sqrt(share * (1 - share) / count + square / (4 * count * count))
    return (share + square / (2 * count) - spread) / (1 + square / count) > all_bad / total


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, confidence): the strongest mined rule for each distinct url that fits one.

    A URL meets a rule through the rule's rarest token alone; the rest of its tokens are then checked.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    keys = beside(rules.select("key").distinct(), "rule-keys")
    met = (
        urls.select("url", F.explode(tokens(host, path, F.col("url"))).alias("key")).join(keys, "key", "left_semi")
        .join(rules.select("key", "rule_id", "tokens", "confidence", "support"), "key")
        .where(F.size(F.array_except("tokens", tokens(host, path, F.col("url")))) == 0)
    )
    best = F.max(F.struct("confidence", "support", "rule_id"))
    return met.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(
    pages: DataFrame, labels: DataFrame | None = None, *, rules=LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE,
    least: int = LEAST, errors: float | None = ERRORS,
) -> DataFrame:
    """The verdict on every page: page_id, url, host, path, rule, verdict, mined_rule, confidence.

    A listed rule decides; else a mined rule that fits blocks; else the page is allowed. ``labels`` (doc_id, quality, toxic)
    label pages by id: bad where the quality is 0 or the page toxic. Without labels, or with none for these pages, nothing
    is mined.

    A missing url, or one without ``://``, has an empty host and path and fits no listed rule; long urls are read whole,
    and all their distinct words, path parts and query names are tokens; pages labelled twice count twice; repeated
    rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("listed"))
    mined = _no_rules(spark)
    if labels is not None:
        labelled = pages.select("url", F.col("page_id")).join(
            labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")), "page_id"
        ).where("url is not null and bad is not null")
        if labelled.limit(1).count():
            mined = mine(labelled, F.col("bad"), support=support, confidence=confidence, least=least, errors=errors)
    # Each distinct url that no listed rule decides is matched once.
    fits = matched(judged.where("rule is null and url is not null").select("url").distinct(), mined)
    return judged.join(fits.select(F.col("url").alias("fit_url"), "mined_rule", "confidence"), F.col("url") == F.col("fit_url"), "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("rule").isNull() & F.col("mined_rule").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"),
    )


def _no_rules(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(
        F.lit("").alias("rule_id"), F.array(F.lit("")).alias("tokens"), F.lit("").alias("key"), F.lit(0.0).alias("support"), F.lit(0.0).alias("confidence")
    )
