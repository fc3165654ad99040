"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule accepts or rejects train one variable-order Markov model each: counts of all
character contexts up to ``order`` in all of those urls. A character's probability in the longest
context is smoothed by the shorter ones (Witten-Bell: the more different characters followed a
context, the more weight goes to the shorter one), down to a uniform distribution. A url without a
rule is scored by the mean log-likelihood difference per character; the threshold is the one that
best separates the scores of labelled urls that were held out of the training.

Models are tables: counts are grouped and joined by context as far as the corpus has contexts. Only
distinct scored strings take part, and only distinct windows of characters are rated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, small, stored

ORDER = 4
ALPHABET = 256  # of the uniform distribution below the shortest context
START, END = "\x02", "\x03"
CLASSES = ("allow", "block")
# Scores are compared in steps of 1 / 100 between -10 and 10 to find the threshold.
STEPS, FARTHEST = 100, 10
# One of this many parts of the labelled texts sets the threshold and does not train.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return (
        F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.

    A rule fits its host and all subdomains of it where the path starts with its own; so no rule
    with a path fits an empty one. Equally long rules: the first in the list.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: -len(r.name))
    for rule in reversed(ordered):
        at_host = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        at_path = F.startswith(path, F.lit(rule.path))
        named = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(at_host & at_path, named).otherwise(found)
    return found


def windows(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per character of ``text``, which is replaced by ``window``: the character and the
    ``order`` ones before it. Texts start after ``order`` start marks and end with an end mark, so
    an empty one has a row. Each row holds its window alone, so the work grows with the characters.
    """
    padded = F.concat(F.lit(START * order), "text", F.lit(END))
    found = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))
    kept = [c for c in texts.columns if c != "text"]
    return texts.select(*kept, F.explode(found).alias("window"))


def contexts(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """``window`` cut into next character and context, once per context length up to ``order``."""
    return counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("length")).select(
        "*",
        F.substr("window", F.lit(order + 1) - F.col("length"), F.col("length")).alias("context"),
        F.right("window", F.lit(1)).alias("next"),
    )


def spread_out(texts: DataFrame) -> DataFrame:
    """Few rows give many characters: deal them to all cores before they are cut."""
    return texts.repartition(texts.sparkSession.sparkContext.defaultParallelism)


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts of both models by context: (context, models), models by class.

    ``labelled`` has columns text, verdict and weight (how often the text occurs). Equal windows are
    counted before they are cut into contexts.
    """
    counted = (
        windows(spread_out(labelled.select("text", "verdict", "weight")), order)
        .groupBy("window", "verdict")
        .agg(F.sum("weight").alias("weight"))
    )
    counts = contexts(counted, order).groupBy("context", "verdict", "next").agg(
        F.sum("weight").alias("times")
    )
    by_class = counts.groupBy("context", "verdict").agg(
        F.sum("times").alias("total"),
        F.count(F.lit(1)).alias("kinds"),
        F.map_from_entries(F.collect_list(F.struct("next", "times"))).alias("followers"),
    )
    return by_class.groupBy("context").agg(
        F.map_from_entries(
            F.collect_list(F.struct("verdict", F.struct("total", "kinds", "followers")))
        ).alias("models")
    )


def window_ratios(found: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``(window, ratio)`` of distinct windows: log P(accepted model) - log P(rejected model) of the
    last character after the others."""
    seen = contexts(found, order).join(small(model), "context", "left")

    def step(verdict: str) -> Column:
        known = F.try_element_at("models", F.lit(verdict))
        return F.struct(
            F.coalesce(F.try_element_at(known["followers"], F.col("next")), F.lit(0)).alias("times"),
            F.coalesce(known["kinds"], F.lit(0)).alias("kinds"),
            F.coalesce(known["total"], F.lit(0)).alias("total"),
        )

    def log_probability(verdict: str) -> Column:
        steps = F.transform("steps", lambda s: s[verdict])
        return F.log(
            F.aggregate(
                steps,
                F.lit(1.0 / ALPHABET),
                lambda p, s: F.when(s["total"] == 0, p).otherwise(
                    (s["times"] + s["kinds"] * p) / (s["total"] + s["kinds"])
                ),
            )
        )

    entry = F.struct("length", *[step(v).alias(v) for v in CLASSES])
    steps = seen.groupBy("window").agg(F.array_sort(F.collect_list(entry)).alias("steps"))
    ratio = log_probability(CLASSES[0]) - log_probability(CLASSES[1])
    return steps.select("window", ratio.alias("ratio"))


def scores(texts: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``(text, score)`` of the distinct texts: the mean ratio of their characters.

    Texts go by a number while they are cut, so however long one is, no row or shuffle repeats it.
    Each distinct window is rated once, whatever the number of characters that have it.
    """
    numbered = spread_out(texts.select("text").distinct())
    numbered = stored(numbered.select(F.monotonically_increasing_id().alias("key"), "text"), "url-numbers")
    counted = windows(numbered, order).groupBy("key", "window").agg(F.count(F.lit(1)).alias("times"))
    counted = stored(counted, "url-windows")
    rated = stored(window_ratios(counted.select("window").distinct(), model, order), "url-ratios")
    # Rounded, as the order of addition may differ between runs.
    mean = F.round(F.sum(F.col("times") * F.col("ratio")) / F.sum("times"), 9)
    by_key = counted.join(small(rated), "window").groupBy("key").agg(mean.alias("score"))
    return numbered.join(by_key, "key").select("text", "score")


def threshold(scored: DataFrame) -> float:
    """The score from which on texts count as accepted: the one with the best mean of both classes'
    hit rates among ``scored`` (score, verdict, weight); ties: nearest to 0. 0 without both classes.
    """
    step = F.least(F.greatest(F.floor(F.col("score") * STEPS), F.lit(-FARTHEST * STEPS)), F.lit(FARTHEST * STEPS))
    rows = scored.groupBy(step.alias("step"), "verdict").agg(F.sum("weight").alias("n")).collect()
    total = {v: sum(r.n for r in rows if r.verdict == v) for v in CLASSES}
    if not all(total.values()):
        return 0.0

    def quality(cut: int) -> float:
        kept = sum(r.n for r in rows if r.verdict == CLASSES[0] and r.step >= cut)
        gone = sum(r.n for r in rows if r.verdict == CLASSES[1] and r.step < cut)
        return kept / total[CLASSES[0]] + gone / total[CLASSES[1]]

    cuts = {0} | {r.step for r in rows} | {r.step + 1 for r in rows}
    return min(cuts, key=lambda c: (-round(quality(c), 12), abs(c), c)) / STEPS


def folds(labelled: DataFrame, parts: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """Labelled texts that fit the models, and the others, that set the threshold.

    One of ``parts`` parts, by the CRC-32 of the text, is held out. Where one of the two would lack a
    class, all labelled texts do both.
    """
    aside = F.crc32("text") % parts == 0
    seen = labelled.select("verdict", aside.alias("aside")).distinct().count()
    if seen < 2 * len(CLASSES):
        return labelled, labelled
    return labelled.filter(~aside), labelled.filter(aside)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """Columns page_id, host, path, rule, verdict and score for every row of ``pages``.

    Rules decide where one fits; else the models do, on host and path with digits made alike, and
    a url without a rule is allowed from the calibrated threshold on. ``score`` is null where a rule
    decided. If no url at all was accepted or none rejected by rules, the threshold is 0. Null urls
    have empty host and path and are scored like any other. Equal strings have equal scores; repeated
    rows stay. Urls may be of any length: work and memory grow with their characters. Further columns
    of ``pages``, whatever their names, are not read.
    """
    host, path = url_parts(F.col("url"))
    judged = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
        .withColumn("text", F.regexp_replace(F.concat("host", "path"), "[0-9]", "0"))
    )
    judged = stored(judged, "urls")
    texts = stored(
        judged.groupBy("text", F.col("by_rule.verdict").alias("verdict")).agg(
            F.count(F.lit(1)).alias("weight")
        ),
        "url-texts",
    )
    labelled = texts.filter(F.col("verdict").isNotNull())
    fitting, calibrating = folds(labelled)
    model = stored(train(fitting, order), "url-models")
    scored = stored(scores(texts, model, order), "url-scores")
    cut = threshold(calibrating.join(scored, "text"))
    named = F.when(F.col("score") >= cut, CLASSES[0]).otherwise(CLASSES[1])
    return judged.join(scored, "text").select(
        "page_id",
        "host",
        "path",
        F.col("by_rule.rule").alias("rule"),
        F.coalesce("by_rule.verdict", named).alias("verdict"),
        F.when(F.col("by_rule").isNull(), F.col("score")).alias("score"),
    )
