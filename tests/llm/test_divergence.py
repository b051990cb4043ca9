"""The audit of sources against exact counting with integers, for different sizes of teams, blocks and seats."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import divergence
from tests.llm.cases import frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows(seed=2, n=260):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "über", "日本", "x", "don't", "a1b", "ÉCOLE", "épée", "omega", "\U0001f600", "A-b", *(f"t{chr(97 + i)}" for i in range(26))]
    out = []
    for i in range(n):
        source = rng.choice([f"s{rng.randint(0, 10)}", "s0", None])
        some = vocabulary[rng.randint(0, 20) :]
        out.append((i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "en", "fr", None]), source, 1))
    out += [(900, "only here", "de", "a", 1), (901, None, "de", "b", 1), (902, "", "de", None, 1), (903, "123 ...", "it", "alone", 1), (904, "alpha " * 60_000, "en", "s3", 1), out[5], out[5], (None, "alpha beta", "fr", "s1", None)]
    return out


def brute(data, least=10):
    found, within, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in data:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        found[lang, source].update(terms)
        within[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in within[lang].items() if n >= least]
        shares = {}
        for key in [*sources, None]:
            counts = found[lang, key] if key is not None else sum((found[lang, s] for s in sources), Counter())
            total = sum(counts[t] for t in kept)
            shares[key] = {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for a in sources:
            pairs = sorted((-sum(f(shares[a][t], shares[b][t]) for t in kept), b.encode(), b) for b in sources if b != a)
            told = sorted((-f(p, shares[None][t]), t.encode(), t) for t, p in shares[a].items() if found[lang, a][t] and p > shares[None][t])[:10]
            out |= {(lang, a, part, item, -value, rank) for part, ranked in (("pair", pairs), ("term", told)) for rank, (value, _, item) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"seat_entries": 20, "least_team": 1}, {"seat_entries": 8, "least_team": 2}, {"least_team": 3, "least_documents": 1}, {"least_documents": 10_000}])
def test_audit_equals_counting_by_hand(spark, options):
    data = rows()
    got = [tuple(r) for r in divergence.divergence(frame(spark, data), **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, options.get("least_documents", 10))


def test_every_pair_of_teams_meets_once(spark):
    for teams in range(1, 12):
        met = Counter()
        for turn in range(teams + teams % 2 - 1):
            found = spark.range(teams).select(F.col("id").cast("int").alias("a"), divergence.partner(F.col("id").cast("int"), F.lit(teams), turn).alias("b")).where(F.col("b") < teams).collect()
            assert all((r["b"], r["a"]) in {tuple(x) for x in found} for r in found)
            met.update((r["a"], r["b"]) for r in found)
        assert met == Counter({(a, b): 1 for a in range(teams) for b in range(teams) if a != b})


def test_residents_are_not_exchanged(spark):
    members, seats = divergence.seats_of(frame(spark, rows()), 10, 20, 1)
    visitors = seats.select("lang", "block", "team", F.col("pack").alias("visitor")).where("team > 2").withColumn("team", F.col("team") - 1)
    plan = seats.join(visitors.hint("merge"), ["lang", "block", "team"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(9_300_000_000_000, 80_000_000_000_001, 123_456_789), (0, 0, 0)], "c bigint, n bigint, v bigint")
    assert [r[0] for r in row.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == [1 + 10**9 * 9_300_000_000_002 // (80_000_000_000_001 + 2 * 123_456_789), 1]


def test_empty_table_and_bad_ranks(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="ranks"):
        divergence.divergence(frame(spark, []), ranks=11)


def test_a_task_counts_groups_whose_texts_alternate_in_one_row_a_term():
    from itertools import chain

    import pyarrow as pa

    letters = "abcdefghijklmnopqrst"
    names = ["".join(letters[i // 20**k % 20] for k in range(5)) for i in range(200_000)]
    texts = [" ".join(names[:100_000]), "Aaaaa aaaaa é", " ".join(names[100_000:]), None, "aaaaa", " ".join(names)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y", "y", None]), pa.array(["s", None, "s", None, None, "s"]), pa.array(texts)], names=["lang", "source", "text"])
    rows = list(chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in divergence.counted(iter([batch, batch]))))
    got = {r[:3]: r[3:] for r in rows}
    assert len(got) == len(rows) == 2 * 200_001 + 3  # 400,002 terms are held at once
    assert got["y", "", "aaaaa"] == (6, 4) and got["y", "", "é"] == (2, 2) and got["y", "", None] == (0, 0) and got["x", "s", names[150_000]] == (2, 2)
