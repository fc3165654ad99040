"""Secret scans with a trigram index.

Each rule is a regular expression. From the literals that every match must contain come its
trigrams, as a Boolean query: all trigrams of one literal, for one of the alternatives. The index
holds for each text which of the rules' trigrams occur in it; posting lists are kept with the
documents (one bit per trigram and document), so that intersecting them is arithmetic on the row,
and the candidates are verified by the same task without moving a text. A rule without a mandatory
literal of three characters scans every text.

DataFrame functions only. Positions come from the lengths of the gaps between matches: a lazy
group before the pattern takes what no match covers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` without outer groups; ``value`` is the group whose length counts (0: all).

    ``literals``: strings of which every match contains one, in any case of the letters if
    ``any_case``. Matches with a value shorter than ``shortest`` are dropped after matching.
    """

    kind: str
    pattern: str
    shortest: int = 0
    value: int = 0
    literals: tuple[str, ...] = ()
    any_case: bool = False
    base: bool = False

    def query(self) -> tuple[frozenset[str], ...]:
        """Alternatives of trigrams that must occur together; empty: scan everything."""
        if not self.literals or any(len(x) < 3 for x in self.literals):
            return ()
        texts = [x.lower() if self.any_case else x for x in self.literals]
        return tuple(frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in texts)


RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))",
        shortest=6,
        value=2,
        literals=("password", "passwd", "secret", "token", "apikey", "api_key"),
        any_case=True,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", shortest=20, literals=("AKIA",), base=True),
    Rule("hex", r"[0-9a-f]{24,}", shortest=24, base=True),
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?",
        literals=("-----BEGIN ",),
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", literals=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", literals=("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", literals=("eyJ",)),
)


def trigrams(rules: tuple[Rule, ...]) -> list[tuple[str, bool]]:
    """All trigrams of the rules' queries with whether case is ignored, in a fixed order."""
    return sorted({(g, r.any_case) for r in rules for part in r.query() for g in part})


def _bit(condition: Column, place: int) -> Column:
    return F.when(condition, F.lit(1 << place)).otherwise(F.lit(0)).cast("long")


def indexed(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``postings``: which trigrams of the rules occur in ``text``, one bit each.

    Letters for rules that ignore case are looked up in the lower-cased text, which has every
    trigram that a match can have.
    """
    grams = trigrams(rules)
    words = [grams[i : i + 63] for i in range(0, len(grams), 63)]
    masks = [
        reduce(
            Column.bitwiseOR,
            [
                _bit(F.contains("_lower" if any_case else "text", F.lit(gram)), place)
                for place, (gram, any_case) in enumerate(part)
            ],
        )
        for part in words
    ]
    lowered = texts.withColumn("_lower", F.lower("text"))
    return lowered.withColumn("postings", F.array(*masks)).drop("_lower")


def posting_lists(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same index by trigram: ``(trigram, text_key)``, one row per posting."""
    grams = trigrams(rules)
    listed = F.array(*[F.struct(F.lit(g).alias("trigram"), F.lit(i).alias("place")) for i, (g, _) in enumerate(grams)])
    held = F.filter(
        listed,
        lambda g: F.getbit(
            F.element_at("postings", F.floor(g["place"] / 63).cast("int") + 1), g["place"] % 63
        )
        == 1,
    )
    return indexed(texts, rules).select("text_key", F.explode(held).alias("gram")).select(
        "gram.trigram", "text_key"
    )


def candidate(rule: Rule, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the posting lists of the rule's trigrams, intersected, hold the document."""
    places = {gram: i for i, gram in enumerate(trigrams(rules))}
    parts = []
    for part in rule.query():
        wanted: dict[int, int] = {}
        for gram in part:
            word, bit = divmod(places[gram, rule.any_case], 63)
            wanted[word] = wanted.get(word, 0) | 1 << bit
        parts.append(
            reduce(
                Column.__and__,
                [
                    F.element_at("postings", w + 1).bitwiseAND(F.lit(mask)) == F.lit(mask)
                    for w, mask in wanted.items()
                ],
            )
        )
    if not parts:
        return F.rlike("text", F.lit(rule.pattern))  # no mandatory trigram: the whole text
    return reduce(Column.__or__, parts)


def _lengths(rule: Rule, group: int) -> Column:
    # Anchored to the end of the match before: after the last one, no other start is tried.
    gapped = F.lit(rf"\G(?s)(.*?)({rule.pattern})")
    return F.transform(F.regexp_extract_all("text", gapped, F.lit(group)), F.length)


def matches(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add one column per rule: the lengths of gaps, matches and values in the order of the text."""
    found = indexed(texts, rules)
    for rule in rules:
        value = _lengths(rule, 2 + rule.value)
        lengths = F.arrays_zip(
            _lengths(rule, 1).alias("gap"), _lengths(rule, 2).alias("size"), value.alias("value")
        )
        found = found.withColumn(rule.kind, F.when(candidate(rule, rules), lengths))
    return found.drop("postings")


def spans(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(text_key, kind, rank, start, end)`` of the matches long enough; code points, end exclusive.

    Matches of a kind don't overlap: a dropped one still covers its characters.
    """
    rows = None
    for rank, rule in enumerate(rules):
        part = found.filter(F.size(rule.kind) > 0).select(
            "text_key", F.lit(rank).alias("rank"), F.posexplode(rule.kind).alias("turn", "match")
        )
        rows = part if rows is None else rows.unionByName(part)
    before = Window.partitionBy("text_key", "rank").orderBy("turn")
    end = F.sum(F.col("match.gap") + F.col("match.size")).over(before)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    least = F.array(*[F.lit(r.shortest) for r in rules])
    return (
        rows.withColumn("end", end)
        .filter(F.col("match.value") >= F.get(least, F.col("rank")))
        .select(
            "text_key",
            F.get(kinds, F.col("rank")).alias("kind"),
            "rank",
            (F.col("end") - F.col("match.size")).alias("start"),
            "end",
        )
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns doc_id, ``n_<kind>`` for each rule, base_spans and spans, for every row of ``docs``.

    Spans are ``kind:start:end`` by start, then in the order of the rules, comma-joined; base_spans
    leaves out the rules that are not base. Null and empty texts have none. Equal texts are
    matched per row but their spans are put together once. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.md5(text).alias("text_key"), text.alias("text"))
    rows = stored(matches(texts, rules).drop("text"), "matches")
    kinds = [r.kind for r in rules]
    some = reduce(Column.__or__, [F.coalesce(F.size(k), F.lit(0)) > 0 for k in kinds])
    once = rows.filter(some).select("text_key", *kinds).dropDuplicates(["text_key"])
    once = stored(once, "texts-with-matches")
    base = F.array(*[F.lit(r.base) for r in rules])
    entry = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("span"))
    listed = (
        spans(once, rules)
        .groupBy("text_key")
        .agg(
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
            F.array_sort(F.collect_list(entry)).alias("all"),
        )
        .select(
            "text_key",
            *[f"n_{k}" for k in kinds],
            F.concat_ws(
                ",", F.transform(F.filter("all", lambda x: F.get(base, x["rank"])), lambda x: x["span"])
            ).alias("base_spans"),
            F.concat_ws(",", F.transform("all", lambda x: x["span"])).alias("spans"),
        )
    )
    listed = stored(listed, "spans")
    return rows.select("doc_id", "text_key").join(listed, "text_key", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
