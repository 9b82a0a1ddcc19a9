"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models, of accepted and of rejected URLs, are learnt from the URLs
that a rule judges.  The probability of a character interpolates all orders from 0 to ORDER by
Witten-Bell weights; a URL's score is the difference of the two log-likelihoods per character,
against a threshold calibrated on three sixteenths of the judged URLs, which the models don't
learn from.
Everything is DataFrame work: character counts are aggregated before they meet, and the model is
one row per context and character.  Characters are folded to ALPHABET, so a model has at most
``(len(ALPHABET) + 1) ** (ORDER + 1)`` rows for each order, whatever the number of URLs; that
bound is what allows broadcasting it.  Costs are whole numbers (millionths of a nat), so sums
don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept

#: Characters the models tell apart; digits are one, all others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-_/:?=&#%"
DIGITS = "0123456789"
FOREIGN = "~"
START = "^"
ORDER = 3
MICRO = 1_000_000
#: Calibration looks at scores in steps of a hundredth of a nat; no score exceeds a few dozen nats.
BIN = MICRO // 100
#: First hex digits of the hashed addresses that calibrate and don't teach, three in sixteen.
ASIDE = "012"
CLASS = "a-z0._/:?=&#%-"

Rule = tuple[str, str]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    tail = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.locate("/", tail)
    return F.coalesce(F.when(at > 0, F.substring(tail, at, F.length(tail))), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_fits(rule: str, host_: Column, path_: Column) -> Column:
    """Whether ``name/prefix`` covers the host or a subdomain and the path starts with the prefix."""
    name, _, prefix = rule.partition("/")
    return ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + prefix)


def longest_rule(rules: list[Rule], host_: Column, path_: Column) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        out = F.when(rule_fits(rule, host_, path_), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
                     ).otherwise(out)
    return out


def folded(text: Column) -> Column:
    """Text in the models' alphabet: A-Z as a-z, digits as 0, anything else as one character."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + DIGITS, "abcdefghijklmnopqrstuvwxyz" + "0" * len(DIGITS))
    return F.regexp_replace(plain, f"[^{CLASS}]", FOREIGN)


def _grams(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys``, and each character of ``seen`` with the ORDER characters before it as ``gram``."""
    padded = F.concat(F.lit(START * ORDER), "seen")
    places = F.explode(F.sequence(F.lit(1), F.length("seen")))
    return (rows.where(F.length("seen") > 0).select(*keys, padded.alias("_p"), places.alias("_at"))
            .select(*keys, F.substring(F.col("_p"), F.col("_at"), F.lit(ORDER + 1)).alias("gram")))


def _costs(counts: DataFrame) -> DataFrame:
    """Of each gram the whole-number difference of its log-probabilities, accepted minus rejected.

    Order by order, p(c | context) = (n(context, c) + T * p(c | shorter context)) / (n(context) + T),
    T being the number of distinct characters the class has after the context; a context the
    class doesn't have leaves the shorter one's probability.
    """
    out = counts.withColumns({f"p_{c}": F.lit(1.0 / (len(ALPHABET) + 1)) for c in "ar"}).drop("a", "r")
    for order in range(ORDER + 1):
        key = F.substring("gram", ORDER + 1 - order, order + 1)
        by_key = counts.groupBy(key.alias("_k")).agg(F.sum("a").alias("_a"), F.sum("r").alias("_r"))
        context = lambda k: F.substring(k, 1, order) if order else F.lit("")
        by_context = by_key.groupBy(context("_k").alias("_c")).agg(
            *[x for c in "ar" for x in (F.sum(f"_{c}").alias(f"n_{c}"), F.count_if(F.col(f"_{c}") > 0).alias(f"t_{c}"))])
        out = (out.withColumn("_k", key).withColumn("_c", context("_k"))
               .join(F.broadcast(by_key), "_k").join(F.broadcast(by_context), "_c"))
        for c in "ar":
            n, t, p = F.col(f"n_{c}"), F.col(f"t_{c}"), F.col(f"p_{c}")
            out = out.withColumn(f"p_{c}", F.when(n > 0, (F.col(f"_{c}") + t * p) / (n + t)).otherwise(p))
        out = out.select("gram", "p_a", "p_r")
    return out.select("gram", F.round((F.log("p_a") - F.log("p_r")) * MICRO).cast("bigint").alias("delta"))


def _cut(bins: list[tuple[int, bool, int]]) -> int:
    """The score from which URLs are accepted: the bin edge of highest balanced accuracy, the lowest of several."""
    accepted, rejected = (sum(n for _, ok, n in bins if ok == x) for x in (True, False))
    if not accepted or not rejected:
        return 0
    best, at = -1.0, 0
    for edge in sorted({b for b, _, _ in bins}):
        right = (sum(n for b, ok, n in bins if ok and b >= edge) / accepted
                 + sum(n for b, ok, n in bins if not ok and b < edge) / rejected)
        if right > best:
            best, at = right, edge
    return at * BIN


def judge(pages: DataFrame, rules: list[Rule], id_: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``score`` is the mean log-likelihood difference per character, in millionths of a nat, where
    no rule fits (0 otherwise); the verdict there is allow from the calibrated threshold up.
    A null URL, or one without ``://``, has an empty host and path, fits no rule, and scores 0.
    Without judged URLs of both classes the threshold is 0.  Repeated rows and null ids keep
    their rows, an empty table gives none, and further columns are not read.
    """
    address = F.col(url).cast("string")
    rows = (pages.select(F.col(id_).cast("bigint").alias("page_id"), host(address).alias("host"), path(address).alias("path"))
            .withColumn("_rule", longest_rule(rules, F.col("host"), F.col("path")))
            .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"),
                    folded(F.concat("host", "path")).alias("seen"))
            .withColumn("_aside", F.substring(F.md5("seen"), 1, 1).isin(*ASIDE)))
    learns = F.col("rule").isNotNull() & ~F.col("_aside")
    accepted = F.col("_verdict") == "allow"
    grams = _grams(rows.select("seen", (learns & accepted).alias("_in_a"), (learns & ~accepted).alias("_in_r")),
                   "_in_a", "_in_r")
    counts = kept(grams.groupBy("gram").agg(F.count_if("_in_a").alias("a"), F.count_if("_in_r").alias("r")), "url-grams")
    costs = kept(_costs(counts), "url-costs")
    # Each distinct address is scored once; the costs have a row per gram of a bounded alphabet.
    scored = kept(_grams(rows.where(F.col("rule").isNull() | F.col("_aside")).select("seen").distinct(), "seen")
                  .join(F.broadcast(costs), "gram").groupBy("seen")
                  .agg(F.floor(F.sum("delta") / F.length("seen")).cast("bigint").alias("score")), "url-scores")
    rows = rows.join(scored, "seen", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    bins = (rows.where(F.col("rule").isNotNull() & F.col("_aside"))
            .groupBy(F.floor(F.col("score") / BIN).cast("bigint").alias("bin"), accepted.alias("ok")).count().collect())
    cut = _cut([tuple(b) for b in bins])
    free = F.col("rule").isNull()
    return rows.select("page_id", "host", "path", "rule",
                       F.coalesce("_verdict", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"),
                       F.when(free, F.col("score")).otherwise(F.lit(0)).alias("score"))
