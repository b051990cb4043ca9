"""How filters interact: what each removes at each step of every order, from one CUBE over their failure flags.

Each document gets one flag a filter. Rows are counted once by (part, flags); a CUBE over part and flags then has, for each subset of
filters, a grouping-set row in which just the flags of that subset are kept: where these are all false it counts the subset's
survivors. A step of an order takes its filter from the subset before to the subset after, so everything asked of it is a
difference of two subsets' survivors.

``flagged`` gives the five flags of the audit of texts:

* A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * letters A-Z > 3 * code points; D: holds one of ``#$%&*|``;
* E: equal to the text of a row with a smaller doc_id, in whatever part that row is and whether or not it is removed.

Nulls: a null text is empty, a null part an empty string. A row without an id is no copy of anything and nothing is a copy of it; it has
no labels. Repeated rows are rows of their own: of several with the smallest id of a text none is a copy. An id with several labels
counts as good or toxic if any label says so. A very long text is one row: its words stand in one task's memory. Ties don't occur, since all is
counting. An empty table gives no parts, hence no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, written

#: What is counted of a group of documents: all, those of quality 1, those that are toxic.
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Flags of a text that need nothing but the text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): counts of rows that have these flags, several rows for equal ones.

    Texts are read once; what moves afterwards is a digest of each. Rows of one id and text are counted together before any of them
    is joined, so that copies of a row don't meet in one task; the many ids of a common text are spread by their ids.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    told = seen.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_flags(F.col("text")).items()])
    held = written(told.groupBy("doc_id", "digest", "part", "A", "B", "C", "D").agg(F.count("*").alias("n")), "flags")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = written(known.agg(F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic")), "labels")
    judged = held.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    judged = judged.withColumns({m: F.col("n") * F.coalesce(F.col(f"_{m}"), F.lit(0)) for m in ("good", "toxic")})
    first = held.where("doc_id is not null").groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    found = judged.join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left")
    return found.select("part", "A", "B", "C", "D", (F.col("doc_id").isNotNull() & F.col("_first").isNull()).alias("E"), *MEASURES)


def survivors(flags: DataFrame, filters: str) -> DataFrame:
    """(part, subset, n, good, toxic): rows of each part that no filter of the subset (bit i: ``filters[i]``) removes; all subsets, zeros included."""
    names = list(filters)
    counted = flags.groupBy("part", *names).agg(*[F.sum(m).alias(m) for m in MEASURES])
    cube = counted.cube("part", *names).agg(*[F.sum(m).alias(m) for m in MEASURES], F.grouping("part").alias("_all"), *[F.grouping(f).alias(f"_{f}") for f in names])
    passed = reduce(lambda a, b: a & b, [(F.col(f"_{f}") == 1) | ~F.col(f) for f in names])
    subset = reduce(lambda a, b: a + b, [(1 - F.col(f"_{f}").cast("int")) * (1 << i) for i, f in enumerate(names)])
    found = written(cube.where((F.col("_all") == 0) & passed).select("part", subset.alias("subset"), *MEASURES), "survivors")
    grid = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    return grid.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MEASURES])


def steps(spark, filters: str) -> DataFrame:
    """(filter_order, step, filter, before, after): every step of every order, with the subsets between which it stands."""
    rows = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << filters.index(f)
            rows.append(("".join(order), step, f, before, after))
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def interactions(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row for each part, order and step; see the columns at its end. ``filters`` names columns of ``flags``, at most six (720 orders)."""
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six filters of different names")
    found = written(survivors(flags, filters), "subsets")  # 2 ** len(filters) rows a part
    before = found.select(F.col("subset").alias("before"), "part", *[F.col(m).alias(f"{m}_0") for m in MEASURES])
    after = found.select(F.col("subset").alias("after"), "part", *[F.col(m).alias(f"{m}_1") for m in MEASURES])
    pairs = before.join(F.broadcast(steps(found.sparkSession, filters)), "before").join(after, ["part", "after"])  # at most 4,320 rows are broadcast
    whole = Window.partitionBy("part", "filter")
    removed = F.col("n_0") - F.col("n_1")
    at = lambda step: F.max(F.when(F.col("step") == step, removed)).over(whole)
    return pairs.select(
        "part", "filter_order", "step", "filter",
        F.col("n_1").alias("kept"),
        removed.alias("removed"),
        (at(1) - removed).alias("redundant"),  # as the first filter it removes all that fail it
        at(len(filters)).alias("unique_fails"),  # as the last, those that fail nothing else
        (F.col("good_0") - F.col("good_1")).alias("good_lost"),
        (F.col("toxic_0") - F.col("toxic_1")).alias("toxic_lost"),
        F.sum(removed).over(whole).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(flagged(docs, labels))
