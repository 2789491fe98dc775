"""Quality rules whose cutoffs are chosen with a risk guarantee, per stratum.

Every rule compares a whole number per document with a cutoff. For each stratum (language) the labelled good
documents are the holdout. Going from the mildest cutoff to the strictest, a cutoff is accepted while the exact
binomial test rejects "it removes a share of more than ``risk`` of the good documents", and the walk ends at the
first that is not accepted. Walking in a fixed order needs no correction; the rules and strata do, so each walk
gets ``error / (rules * strata)``, and each rule ``risk`` of the total risk. Hence, with probability
``1 - error``, in every stratum at most ``len(RULES) * risk`` of the good documents are removed.

The holdout is counted in the cluster; the driver gets one row per stratum, rule and cutoff.
All per-document work is column expressions.

Edge cases: a NULL text has no words; NULL or unlisted languages form the stratum ``other``; labels that are
NULL, or repeated for a document and not all good, are no evidence; a stratum with too few labels gets no cutoff, so
that only the base rules act there; rows with equal ids are judged each by its own text.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import carried, taken_back, words
from emberline.operators.lineage import settle

SYMBOLS = "[#*$%&|<>]"
STRATA = ("de", "en", "es", "fr")
RISK, ERROR = 0.02, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """Removes documents whose ``measure`` is over the cutoff (below it if not ``over``); cutoffs mild to strict."""

    name: str
    measure: str
    cutoffs: tuple[int, ...]
    over: bool = True


#: Measures are whole thousandths, so that every engine agrees on them.
RULES = (
    Rule("symbols", "1000 * n_symbols div n_words", (3000, 2500, 2000, 1500, 1000, 700, 500, 400, 300, 200, 150, 100, 50)),
    Rule("dup_lines", "1000 * n_dup_lines div n_lines", (900, 800, 700, 600, 500, 450, 400, 350, 300)),
    Rule("repeats", "1000 * n_repeat_words div n_words", (500, 450, 400, 350, 300, 250, 200)),
    Rule("long_words", "1000 * word_chars div n_words", (20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000)),
    Rule("short_words", "1000 * word_chars div n_words", (1500, 2000, 2500, 3000, 3500, 3800), over=False),
)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: window starts, in order, cover three words each."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        twins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(twins, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, bind(bind(ranked, starts), covered)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base numbers of every text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("_words")
    hash_of = lambda a, b: F.xxhash64(a, b)
    pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), hash_of)
    triple = F.slice(F.zip_with(pairs, F.slice(w, 3, F.size(w)), hash_of), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return (
        docs.withColumns({"_words": words(F.col(text)), "_lines": lines})
        .withColumn("_triples", triple)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": _repeat_words(F.col("_triples")),
            }
        )
        .drop("_words", "_lines", "_triples")
        .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    )


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def _log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for k below the mean, summed downwards until terms no longer count."""
    log = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log)
    for j in range(k, 0, -1):
        term *= j * (1 - p) / ((n - j + 1) * p)
        total += term
        if term < total * 1e-18:
            break
    return total


def accepted(n: int, removed: int, risk: float, error: float) -> bool:
    """Does the exact test reject that more than ``risk`` of the good are removed?"""
    return n > 0 and removed < n * risk and binomial_cdf(removed, n, risk) <= error


def choose(counts: list[tuple[str, int, dict[str, list[int]]]], risk: float = RISK, error: float = ERROR) -> dict:
    """(stratum, rule) -> cutoff, from ``(stratum, good documents, {rule: removed per cutoff})``."""
    share = error / (len(RULES) * (len(STRATA) + 1))
    chosen = {}
    for name, n, removed in counts:
        for rule in RULES:
            for cutoff, k in zip(rule.cutoffs, removed[rule.name]):
                if not accepted(n, k, risk, share):
                    break
                chosen[name, rule.name] = cutoff
    return chosen


def _hit(rule: Rule, cutoff: int) -> Column:
    measure = F.expr(f"CASE WHEN n_words > 0 THEN {rule.measure} END")
    return F.coalesce(measure > cutoff if rule.over else measure < cutoff, F.lit(False))


def holdout_counts(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> list:
    """Per stratum the good documents that pass the base rules, and how many of them each cutoff removes."""
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good")).where("_good = 1")
    held = measured.where(~F.col("base_failed")).join(good, F.col(doc_id) == F.col("_id"), "left_semi")
    sums = [F.sum(_hit(r, c).cast("long")).alias(f"{r.name}_{c}") for r in RULES for c in r.cutoffs]
    found = held.groupBy(stratum(F.col(lang)).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    return [(x["stratum"], x["n"], {r.name: [x[f"{r.name}_{c}"] for c in r.cutoffs] for r in RULES}) for x in found]


def judge(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = RISK,
    error: float = ERROR,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """``doc_id, lang``, the base numbers, ``base_failed``, the rules that hit (``removed_by``) and ``kept``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("_text"))
    measured = settle(measures(narrow, "_text").drop("_text"), "quality-measures")
    chosen = choose(holdout_counts(measured, labels), risk, error)
    return measured.withColumn("removed_by", _verdict(chosen)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("removed_by") == 0)
    )


def _verdict(chosen: dict) -> Column:
    hits = [
        F.when((stratum(F.col("lang")) == s) & _hit(rule, chosen[s, rule.name]), F.lit(rule.name))
        for s in (*STRATA, "other")
        for rule in RULES
        if (s, rule.name) in chosen
    ]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that pass, with their own columns. The numbers are worked out twice, so that texts are not moved."""
    narrow = docs.select("doc_id", F.col("lang"), F.col("text").alias("_text"))
    measured = settle(measures(narrow, "_text").drop("_text"), "quality-measures")
    chosen = choose(holdout_counts(measured, labels), risk, error)
    own = [v.alias(c) for c, v in taken_back(docs).items()]
    again = measures(docs.select(carried(docs), F.col("lang"), F.col("text").alias("_text")), "_text")
    # a filter does not sink through a projection with a row number, else the measures would be worked out per array element
    again = again.withColumn("_once", F.monotonically_increasing_id())
    return again.where((F.col("_once") >= 0) & ~F.col("base_failed") & (F.size(_verdict(chosen)) == 0)).select(*own)
