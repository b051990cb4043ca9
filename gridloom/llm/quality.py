"""Quality rules: text statistics and a learned decision list, in DataFrame operations alone.

The statistics are row-local expressions; the texts never cross an exchange. From labelled rows, binned at quantiles, sequential
covering learns an ordered list of threshold conjunctions that describe bad texts: a rule grows literal by literal by
information gain on two thirds of the rows, is pruned from its end on the other third, and the rows it covers are set
aside before the next rule grows. Each step is one aggregation over all labelled rows to (feature, bin, label) counts, so
what reaches the driver is bounded by features x bins. The list becomes one Spark CASE expression.

Nulls: a null text has no words and fails. Null ids and labels are not learned from; several labels of an id count as their
minimum. Without labels of both kinds the list is empty and the base rules alone decide. Repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, written

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
FEATURES = ("n_words", "mean_word", "symbols", "caps", "marks", "repeats", "dup_lines")
QUANTILES = (0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.995)


def _removed(pattern: str) -> Column:
    """How many characters of the text match ``pattern``."""
    return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of every row."""
    out = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    out = out.select(
        key, F.length("text").alias("n_chars"), _removed(SYMBOLS).alias("n_symbols"), _removed(r"\p{Lu}+").alias("n_caps"), _removed("[!?]+").alias("n_marks"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
    )
    out = out.select(
        key, "n_chars", "n_symbols", "n_caps", "n_marks", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    kept = [key, "n_chars", "n_symbols", "n_caps", "n_marks", "n_lines", "n_dup_lines", "n_words", "word_chars"]
    for half in (1, 2, 4):  # hashes of 2, 4, 8 words from those of half as many
        of, to = f"h{half}", f"h{2 * half}"
        pairs = F.expr(f"transform(slice({of}, 1, greatest(size({of}) - {half}, 0)), (x, i) -> xxhash64(x, {of}[i + {half}]))")
        out = out.select(*kept, pairs.alias(to))
    found = F.size(F.array_distinct("h8")) < F.size("h8")
    out = out.select(*kept, F.when(found, F.expr("sort_array(transform(h8, (h, i) -> struct(h, i)))")).alias("sorted"))
    # starts of windows that stand twice or more, ascending; each covers what the next one doesn't
    starts = F.expr("sort_array(transform(filter(transform(sorted, (s, j) -> struct(s.i as i, (j > 0 and s.h = sorted[greatest(j - 1, 0)].h) or s.h = get(sorted, j + 1).h as twice)), s -> s.twice), s -> s.i))")
    out = out.select(*kept, starts.alias("starts"))
    covered = F.expr(f"aggregate(starts, struct(0L as n, cast(-{WINDOW} as int) as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n)")
    out = out.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "n_chars").alias("symbols"),
        per("n_caps", "n_chars").alias("caps"), per("n_marks", "n_chars").alias("marks"), per("n_repeat_words", "n_words").alias("repeats"), per("n_dup_lines", "n_lines").alias("dup_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    bin: int
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold

    def binned(self) -> Column:
        return F.col(f"b_{self.feature}") >= self.bin if self.at_least else F.col(f"b_{self.feature}") < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose literals all hold says that a text is bad, none says that it is good."""

    rules: list[tuple[Literal, ...]] = field(default_factory=list)

    def bad(self) -> Column:
        """The list as one CASE expression."""
        if not self.rules:
            return F.lit(False)
        holds = [reduce(lambda a, b: a & b, (x.column() for x in rule)) for rule in self.rules]
        return reduce(lambda case, h: case.when(h, True), holds[1:], F.when(holds[0], True)).otherwise(False)

    def __str__(self) -> str:
        return "\n".join("bad if " + " and ".join(map(str, rule)) for rule in self.rules)


def learn(labelled: DataFrame, most_rules: int = 6, most_literals: int = 3, precision: float = 0.9) -> DecisionList:
    """A list from rows with the features and ``bad`` (boolean); rules of less than ``precision`` on the held third are not taken."""
    grid = labelled.agg(*[F.percentile_approx(c, list(QUANTILES), 10_000).alias(c) for c in FEATURES]).first()
    cuts = {c: sorted({float(x) for x in grid[c] or []} | ({1e-4} if c not in ("n_words", "mean_word") else set())) for c in FEATURES}
    bins = [F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in cuts[c]) or 'cast(null as double)'}), t -> t <= {c}))").alias(f"b_{c}") for c in FEATURES]
    rows = written(labelled.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *bins), "binned")

    def counts(left: DataFrame) -> dict:
        """(feature, bin, held) -> [good, bad]."""
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b_{c}").alias("bin")) for c in FEATURES]))
        out: dict = {}
        for r in left.select("bad", "held", each.alias("at")).groupBy("at.feature", "at.bin", "held", "bad").count().collect():
            out.setdefault((r["feature"], r["bin"], r["held"]), [0, 0])[r["bad"]] = r["count"]
        return out

    def side(found: dict, x: Literal | None, held: bool) -> list[int]:
        """[good, bad] rows for which the literal holds."""
        name = x.feature if x else FEATURES[0]
        cells = [v for (f, b, h), v in found.items() if f == name and h == held and (x is None or (b >= x.bin) == x.at_least)]
        return [sum(v[k] for v in cells) for k in (0, 1)]

    def gain(before: list[int], after: list[int]) -> float:
        if not after[1]:
            return -1.0
        return after[1] * (math.log2(after[1] / sum(after)) - math.log2(before[1] / sum(before)))

    literals = [Literal(c, way, i + 1, t) for c in FEATURES for i, t in enumerate(cuts[c]) for way in (True, False)]
    found_rules, left = [], rows
    all_counts = counts(left)
    while len(found_rules) < most_rules and side(all_counts, None, False)[1]:
        rule, inside, scores = [], all_counts, []
        while len(rule) < most_literals:
            before = side(inside, None, False)
            if not before[0]:
                break
            best = max(literals, key=lambda x: (gain(before, side(inside, x, False)), -literals.index(x)))
            if gain(before, side(inside, best, False)) <= 0:
                break
            held = side(inside, best, True)
            rule.append(best)
            scores.append(((held[1] - held[0]) / max(1, sum(held)), held))
            inside = counts(left.where(reduce(lambda a, b: a & b, (x.binned() for x in rule))))
        if not rule:
            break
        keep = max(range(len(rule)), key=lambda i: (scores[i][0], -i))  # pruned after the literal that is best on held rows
        rule, held = rule[: keep + 1], scores[keep][1]
        if not held[1] or held[1] / sum(held) < precision:
            break
        found_rules.append(tuple(rule))
        left = left.where(~reduce(lambda a, b: a & b, (x.binned() for x in rule)))
        all_counts = counts(left)
    return DecisionList(found_rules)


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """doc_id, the statistics, base_failed and kept of every row; and the list that decided."""
    rows = written(statistics(docs), "statistics")
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rules = learn(rows.join(told, "doc_id"))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rules.bad()), rules
