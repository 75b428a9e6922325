"""URL filters: stated rules, and association rules that FP-growth mines from labelled urls.

A url becomes a set of tokens: the domains above its host, the host, path segments (numbers alike), query keys. Mining finds the token
combinations that are frequent among bad urls and of whose urls enough are bad:

1. Tokens that are rules by themselves are found by counting. A combination with one of them inside changes nothing.
2. Of the others, those that all labelled urls have together or not at all are one: it stands for a choice among them. So a frequent url of
   forty tokens, of which nothing tells one from the other, is not mined for its 2**40 combinations.
3. FP-growth mines the bad urls' combinations, whose confidence is then counted over all labelled urls.

A rule stands in an inverted index under the tokens that the fewest labelled urls have, so that a url is held only against rules that share one of these, and then for
all of the rule's choices.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.llm.shared import written

#: Share of labelled urls, and number of them, that a rule needs; and the share of those with its tokens that have the label.
SUPPORT, LEAST, CONFIDENCE = 0.002, 20, 0.8
#: Rules that are sent to all tasks; more are joined by a shuffle.
BROADCAST_RULES = 10_000
#: Labelled urls that are mined, at most; of more, those with the least digests.
LABELLED = 200_000
#: Steps in which the bound on digests is sought, so that about a 64th of LABELLED may stay unused.
STEPS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


class Stated(NamedTuple):
    host: str
    path: str
    verdict: str


STATED = (Stated("com", "/", "allow"), Stated("example.com", "/en/", "block"), Stated("www.example.com", "/en/", "allow"), Stated("net", "/es/", "block"), Stated("net", "/fr/", "block"))


def part(url: Column, group: int) -> Column:
    """Host (1), path (2) or query (3); empty where there is none."""
    found = F.coalesce(F.regexp_extract(url, URL, group), F.lit(""))
    return F.translate(found, _UPPER, _LOWER) if group == 1 else found


def tokens(url: Column) -> Column:
    """The url's set of tokens; null has none."""
    labels = F.split(part(url, 1), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    names = F.filter(F.split(part(url, 2), "/"), lambda x: x != "")
    segments = F.transform(names, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.filter(F.split(part(url, 3), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.array_distinct(F.concat(above, segments, keys))).otherwise(F.array().cast("array<string>"))


RULE = "choices array<array<string>>, keys array<string>, confidence double, support double"


def digest(url: Column) -> Column:
    """A number from 0 to 1 by the url's MD5."""
    return F.conv(F.substring(F.md5(url), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def sample(labelled: DataFrame, most: int = LABELLED) -> DataFrame:
    """(url, bad) of `most` distinct urls of labelled (url, bad) at most, each once: bad if most of its rows are. Rows without a url or a label tell nothing.

    Of more urls those with digests below a bound are taken: how often a url occurs, and where, has no part in it. The bound comes from counts by
    steps of the digest, so no task gets all candidates."""
    known = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.sum(F.col("bad").cast("int")).alias("n_bad"), F.count("*").alias("n"))
    known = written(known.select("url", (F.col("n_bad") * 2 > F.col("n")).alias("bad"), digest(F.col("url")).alias("_at")), "labelled")
    n = known.count()
    if n <= most:
        return known.select("url", "bad")
    step = F.floor(F.col("_at") * F.lit(n / most) * STEPS)
    counts = known.where(step < 2 * STEPS).groupBy(step.alias("step")).count().orderBy("step").collect()
    taken, bound = 0, -1
    for r in counts:
        taken += r["count"]
        if taken > most:
            break
        bound = r.step
    return known.where(step <= bound).select("url", "bad")


def mine(labelled: DataFrame) -> DataFrame:
    """(choices, keys, confidence, support) of the rules of labelled (url, bad): a url fits that has one token at least of each choice. keys is the choice
    that the fewest labelled urls have.

    A rule is bad in LEAST urls and SUPPORT of all labelled ones at least, and in CONFIDENCE of those that fit. Rows without a url or a label tell
    nothing. A rule with a rule inside it would change nothing, and is dropped."""
    spark = labelled.sparkSession
    known = labelled.where("url is not null and bad is not null").select(tokens(F.col("url")).alias("tokens"), F.col("bad").cast("int").alias("bad")).where(F.size("tokens") > 0)
    baskets = written(known.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad")), "baskets")
    n = baskets.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, -(-n * int(SUPPORT * 1000) // 1000))
    # tokens of the same urls have the same sums of the urls' digests
    sums = [F.sum(F.xxhash64(F.lit(k), "tokens").cast("decimal(38,0)")).alias(f"sum_{k}") for k in range(2)]
    counted = baskets.select("*", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), *sums).where(F.col("n_bad") >= least)
    same = written(counted.groupBy("n", "n_bad", "sum_0", "sum_1").agg(F.array_sort(F.collect_list("token")).alias("choice")).drop("sum_0", "sum_1"), "choices")
    enough = F.col("n_bad") / F.col("n") >= CONFIDENCE
    measured = ((F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / F.lit(max(n, 1))).alias("support"))
    single = same.where(enough).select(F.explode("choice").alias("token"), *measured).select(F.array(F.array("token")).alias("choices"), F.array("token").alias("keys"), "confidence", "support")
    names = same.where(~enough).select(F.get("choice", F.lit(0)).alias("token"), "choice", F.col("n").alias("urls"))
    reduced = written(baskets.select("n", "n_bad", "tokens", F.explode("tokens").alias("token")).join(names, "token").groupBy("tokens").agg(F.first("n").alias("n"), F.first("n_bad").alias("n_bad"), F.array_sort(F.collect_list("token")).alias("items")), "reduced")
    bad = reduced.where("n_bad > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), "n_bad"))).select("items")
    n_bad = bad.count()
    if n_bad < least:
        return written(single, "rules")
    frequent = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_bad).fit(bad).freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad"))
    frequent = written(frequent, "frequent")
    # each combination is looked for in the urls that have its least frequent token
    rare = frequent.select("items", "n_bad", F.explode("items").alias("token")).join(same.select(F.get("choice", F.lit(0)).alias("token"), "n"), "token").groupBy("items", "n_bad").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    held = reduced.select("n", F.col("items").alias("own"), F.explode("items").alias("token")).join(rare, "token").where(F.size(F.array_except("items", "own")) == 0)
    several = held.groupBy("items", "n_bad").agg(F.sum("n").alias("n")).where(enough).select("items", *measured)
    spelt = several.select(F.monotonically_increasing_id().alias("id"), "*")
    spelt = written(spelt, "several")
    wide = spelt.select("id", "confidence", "support", F.explode("items").alias("token")).join(names, "token").groupBy("id", "confidence", "support").agg(F.array_sort(F.collect_list("choice")).alias("choices"), F.min_by("choice", F.struct("urls", "choice")).alias("keys")).select("choices", "keys", "confidence", "support")
    # narrow rules first, so that wider ones are held only against rules that stay
    left, kept = written(wide, "rules"), spark.createDataFrame([], RULE).unionByName(single)
    while (width := left.agg(F.min(F.size("choices"))).first()[0]) is not None:
        own = left.where(F.size("choices") == width)
        wider = left.where(F.size("choices") > width)
        kept = kept.unionByName(own)
        left = written(wider.join(_holding(wider.select("choices", F.flatten("choices").alias("own")), own, "choices"), "choices", "left_anti"), "rules")
    return written(kept, "rules")


def _holding(rows: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """The distinct values of column name of rows, whose tokens are own, that fit a rule."""
    keyed = rules.select(F.col("choices").alias("rule"), F.explode("keys").alias("token"))
    index = F.broadcast(keyed) if rules.count() <= BROADCAST_RULES else keyed
    own = rows.select(F.col(name).alias("name"), "own", F.explode("own").alias("token"))
    return own.join(index, "token").where(F.forall("rule", lambda c: F.arrays_overlap(c, F.col("own")))).select(F.col("name").alias(name)).distinct()


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the distinct urls (column url) that fit a rule."""
    return _holding(urls.select("url", tokens(F.col("url")).alias("own")), rules, "url")


def judge(pages: DataFrame, labelled: DataFrame, stated: tuple[Stated, ...] = STATED) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url), by the longest stated rule that fits, else by mined rules.

    A stated rule fits its host and hosts below it, where the path starts with the rule's. A null url, or one without ://, has an empty host
    and path, no rule, and is allowed. Rows are judged by their url alone, so repeated ones alike. labelled is (url, bad), a bounded
    number of rows, as sample() gives. Other columns are not used."""
    at = pages.select("page_id", "url", part(F.col("url"), 1).alias("host"), part(F.col("url"), 2).alias("path"))
    by_length = sorted(stated, key=lambda r: -len(r.host + r.path))
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    first = lambda value: F.coalesce(*(F.when(fits(r), F.lit(value(r))) for r in by_length)) if by_length else F.lit(None).cast("string")
    at = at.withColumns({"rule": first(lambda r: r.host + r.path), "said": first(lambda r: r.verdict)})
    blocked = matching(at.where("said is null and url is not null").select("url").distinct(), mine(labelled))
    # a url of a third of all pages is dealt over several tasks, and pages without one, or that a stated rule decides, by their number
    blocked = blocked.select(F.col("url").alias("open"), F.lit(True).alias("hit"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    at = at.withColumns({"open": F.when(F.col("said").isNull(), F.col("url")), "salt": F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(16)).cast("int")})
    out = at.join(blocked, ["open", "salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
