"""URL filter: host and path rules, else the likelihood ratio of two character models.

Accepted and rejected URLs (those that a rule decides) each train a smoothed
variable-order Markov model over characters. A URL without a rule is judged by
its length-normalised log-likelihood difference against a threshold calibrated
on labelled URLs that the models have not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Verdict, host, path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
START = "\x02"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (``host`` + ``path`` as one string) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(of_path))
        rule = F.when(fits, F.lit(of_host + of_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(url: Column, order: int) -> Column:
    """One string of ``order`` + 1 characters for each character of the URL: its context and itself."""
    padded = F.concat(F.lit(START * order), url)
    return F.transform(F.sequence(F.lit(1), F.length(url)), lambda i: F.substring(padded, i, F.lit(order + 1)))


def _present(count: Column) -> Column:
    return F.count_if(count > 0)


def gram_scores(labelled: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """Log-likelihood difference of each gram of ``wanted`` (gram): the last
    character after its context, accepted model against rejected model.

    ``labelled`` has (gram, accepted, rejected) counts. Each order k mixes its
    relative frequency with order k-1 by Witten-Bell weights: n / (n + t), where
    the context occurred n times with t different next characters; below order 0
    all 65536 characters are alike.
    """
    scores = wanted
    prob = {"a": F.lit(1.0 / 65536), "r": F.lit(1.0 / 65536)}
    for k in range(order + 1):
        cut = F.right(F.col("gram"), F.lit(k + 1))
        counts = labelled.groupBy(cut.alias(f"g{k}")).agg(F.sum("accepted").alias(f"a{k}"), F.sum("rejected").alias(f"r{k}"))
        scores = scores.withColumn(f"g{k}", cut).join(counts, f"g{k}", "left")
        totals = ((f"a{k}", F.sum, f"na{k}"), (f"r{k}", F.sum, f"nr{k}"), (f"a{k}", _present, f"ta{k}"), (f"r{k}", _present, f"tr{k}"))
        totals = [f(F.col(x)).alias(n) for x, f, n in totals]
        if k:
            context = F.left(F.col(f"g{k}"), F.lit(k)).alias(f"c{k}")
            scores = scores.withColumn(f"c{k}", context).join(counts.groupBy(context).agg(*totals), f"c{k}", "left")
        else:  # one context: four numbers
            scores = scores.withColumns({n: F.lit(x) for n, x in counts.agg(*totals).first().asDict().items()})
        for m in "ar":
            n, t, c = (F.coalesce(F.col(x), F.lit(0)) for x in (f"n{m}{k}", f"t{m}{k}", f"{m}{k}"))
            prob[m] = F.when(n == 0, prob[m]).otherwise((c + t * prob[m]) / (n + t))
        scores = scores.withColumn(f"p_a{k}", prob["a"]).withColumn(f"p_r{k}", prob["r"])
        prob = {"a": F.col(f"p_a{k}"), "r": F.col(f"p_r{k}")}
    return scores.select("gram", (F.log(prob["a"]) - F.log(prob["r"])).alias("llr"))


def judge(pages: DataFrame, rules=RULES, order: int = 3, broadcast_rows: int = 200_000, salts: int = 16) -> DataFrame:
    """Verdict on each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    A fifth of the rule-labelled URLs (by hash of the URL) is held out of the
    models and calibrates the threshold: between the mean scores of both classes,
    in proportion to their deviations. Repeated URLs count as often as they occur.

    The scores of grams are broadcast while there are at most ``broadcast_rows``
    of them, each under 100 bytes; beyond that they are joined by shuffle on the
    gram and a salt of the row, because a few grams occur in every URL.

    A null or empty URL, or one without ``://``, has an empty host and path, no
    rule, and is scored on what it has; without any character its score is 0. If
    one class has no labelled URL, all URLs without rule get the verdict allow.
    An empty table gives no rows; further columns are ignored; equal rows each
    have their result.
    """
    host, path = host_and_path(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": said})
    rows = settled(rows.withColumns({"row": F.monotonically_increasing_id(), "held": F.pmod(F.xxhash64("url"), F.lit(5)) == 0}), "url-rows")
    text = F.coalesce(F.col("url"), F.lit(""))
    grams = rows.filter(F.length(text) > 0).select("row", "said", "held", F.explode(_grams(text, order)).alias("gram"))
    learned = F.col("said").isNotNull() & ~F.col("held")
    counts = settled(
        grams.groupBy("gram").agg(F.count_if(learned & (F.col("said") == "allow")).alias("accepted"), F.count_if(learned & (F.col("said") == "block")).alias("rejected")),
        "url-grams",
    )
    labelled = counts.filter("accepted > 0 or rejected > 0")
    scores = settled(gram_scores(labelled, counts.select("gram"), order), "url-scores")
    if scores.count() <= broadcast_rows:
        hits = grams.select("row", "gram").join(F.broadcast(scores), "gram")
    else:
        salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
        hits = grams.select("row", "gram", salt.alias("salt")).join(scores.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(salts)]))), ["gram", "salt"])
    summed = hits.groupBy("row").agg((F.sum("llr") / F.count("*")).alias("score"))
    scored = settled(rows.join(summed, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "url-judged")
    known = scored.filter(F.col("said").isNotNull() & F.col("held"))
    seen = {r.said: r for r in known.groupBy("said").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev")).collect()}
    if {"allow", "block"} <= seen.keys():
        a, b = seen["allow"], seen["block"]
        cut = (a["mean"] * (b.dev + 1e-9) + b["mean"] * (a.dev + 1e-9)) / (a.dev + b.dev + 2e-9)
    else:
        cut = float("-inf")
    own = F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "score")
