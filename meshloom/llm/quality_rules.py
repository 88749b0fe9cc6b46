"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditional expressions.

Sequential covering: a rule is a conjunction of threshold conditions on document statistics. It grows by
the condition of the highest information gain on two thirds of the labelled rows, is pruned from its end on
the other third, and is kept while it rejects almost only documents labelled poor. Every count comes from
one Spark aggregation over the statistics table; only histograms (features x cut points) reach the driver.
Nothing here runs Python on the executors.

Defined results: a null text has no words (all counts 0, base_failed, not kept); a null doc_id is returned
as it is and never joins a label; repeated rows give repeated results; without labelled rows of both kinds
the list is empty and the verdict is the base filter's; further columns of the table are ignored.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, fold, text_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What a condition may test; null, so that no condition holds, where a text has no words.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "try_divide(word_chars, n_words)",
    "symbol_share": "try_divide(n_symbols, word_chars)",
    "duplicate_lines": "cast(n_dup_lines as double)",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
    "capital_share": "try_divide(n_capitals, word_chars)",
    "exclamation_share": "try_divide(n_exclamations, n_words)",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the whole text's counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_capitals, n_exclamations. One scan, no shuffle: three-word windows are hashed, and only a text in which
    two windows agree sorts them, so the work stays n log n however long a text is."""
    t = docs.select(F.col("doc_id"), text_of(docs, text).alias("t"))
    t = t.withColumns({
        "w": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)),
        "lines": F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
        "word_chars": F.length(F.translate("t", BLANKS, "")).cast("long"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
        "n_capitals": (F.length("t") - F.length(F.translate("t", CAPITALS, ""))).cast("long"),
        "n_exclamations": (F.length("t") - F.length(F.translate("t", "!", ""))).cast("long"),
    }).drop("t")
    t = t.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "g": F.expr("if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])), cast(array() as array<bigint>))"),
    }).drop("w", "lines")
    t = t.withColumn("s", F.expr("if(size(array_distinct(g)) < size(g), sort_array(transform(g, (h, i) -> struct(h, i))), null)")).drop("g")
    t = t.withColumn("p", F.expr("sort_array(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))")).drop("s")
    covered = "aggregate(transform(p, (x, k) -> cast(least(3, coalesce(get(p, k + 1) - x, 3)) as bigint)), 0L, (a, x) -> a + x)"
    return t.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long"))).drop("p")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= F.lit(self.value) if self.at_least else x < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, a document that none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rejected_by(self) -> Column:
        """The number of the rule that rejects, from 1; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
        return F.lit(0) if out is None else out.otherwise(0)


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """FOIL's information gain of going from (p0 poor, n0 good) covered rows to (p, n)."""
    if p <= 0:
        return -1.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, n_cuts: int = 48, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.95, least_cover: int = 8) -> DecisionList:
    """Learn the list from rows of statistics with `poor` (boolean) and `part` (0 and 1 grow, 2 prunes).
    least_precision: share of poor rows among those that a pruned rule covers on either part."""
    names = list(FEATURES)
    rows = labelled.select("poor", "part", *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    cuts_row = rows.agg(*[F.percentile_approx(n, [k / n_cuts for k in range(1, n_cuts)], 20_000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(cuts_row[n] or ())) for n in names}
    if not any(cuts.values()):
        return DecisionList()

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.lit([float(c) for c in cuts[name]]).cast("array<double>"), lambda c: F.col(name) >= c))

    bins = F.array(*[F.struct(F.lit(k).alias("f"), bin_of(n).alias("b")) for k, n in enumerate(names)])
    binned = cut(rows.withColumn("bins", bins), "rules")

    def holds(conditions: list[Condition]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & (F.col(c.feature) >= F.lit(c.value) if c.at_least else F.col(c.feature) < F.lit(c.value))
        return out

    out = DecisionList()
    left = F.lit(True)
    for _ in range(max_rules):
        conditions: list[Condition] = []
        while len(conditions) < max_conditions:
            grown = binned.where(left & holds(conditions) & (F.col("part") != 2))
            counts = grown.select("poor", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.count_if("poor").alias("p"), F.count_if(~F.col("poor")).alias("n")).collect()
            p0 = sum(r.p for r in counts if r.f == 0)
            n0 = sum(r.n for r in counts if r.f == 0)
            if p0 < least_cover or n0 == 0:
                break
            best: tuple[float, Condition] | None = None
            for k, name in enumerate(names):
                below_p = below_n = 0
                by = {r.b: (r.p, r.n) for r in counts if r.f == k}
                for b, value in enumerate(cuts[name]):
                    p, n = by.get(b, (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for at_least, (cp, cn) in ((False, (below_p, below_n)), (True, (p0 - below_p, n0 - below_n))):
                        if cp >= least_cover and (g := _gain(p0, n0, cp, cn)) > (best[0] if best else 1e-9):
                            best = (g, Condition(name, at_least, float(value)))
            if best is None or best[1] in conditions:
                break
            conditions.append(best[1])
        if not conditions:
            break
        # Reduced-error pruning: all beginnings of the rule are counted in one aggregation.
        sums = []
        for k in range(1, len(conditions) + 1):
            for part, name in ((F.col("part") == 2, "v"), (F.col("part") != 2, "g")):
                sums += [F.count_if(part & F.col("poor") & holds(conditions[:k])).alias(f"{name}p{k}"), F.count_if(part & ~F.col("poor") & holds(conditions[:k])).alias(f"{name}n{k}")]
        r = binned.where(left).agg(*sums).first()
        worth = [((r[f"vp{k}"] - r[f"vn{k}"]) / max(1, r[f"vp{k}"] + r[f"vn{k}"]), r[f"vp{k}"], k) for k in range(1, len(conditions) + 1)]
        k = max(worth)[2]
        p, n = r[f"vp{k}"] + r[f"gp{k}"], r[f"vn{k}"] + r[f"gn{k}"]
        if p < least_cover or p < least_precision * (p + n) or r[f"vp{k}"] < least_precision * (r[f"vp{k}"] + r[f"vn{k}"]):
            break
        rule = conditions[:k]
        out.rules.append(Rule(tuple(rule)))
        left = left & ~holds(rule)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", **learning) -> tuple[DataFrame, DecisionList]:
    """Statistics of every document, the list learned from the labelled ones outside the held-out third, and
    the verdicts. The texts are read once: the statistics are written to the shared folder, slim."""
    stats = cut(statistics(docs, text), "stats")
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where(~base_failed() & (fold(F.col("doc_id")) != 1)).join(marks, "doc_id").withColumns({
        "poor": F.col("quality") == 0,
        "part": F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(3)),
    })
    rules = learn(known, **learning)
    verdict = stats.withColumns({"base_failed": base_failed(), "rule": rules.rejected_by()})
    return verdict.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.col("rule") == 0)), rules
