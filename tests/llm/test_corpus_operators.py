"""Operators whose results depend on the whole table, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import jaccard, mixing, shingles, substrings
from gridloom.llm.components import components
from tests.llm.cases import documents, frame, sentence

ROWS = documents()
NO_ID = 1 << 62


def words(text):
    return (text or "").encode().split()


# shingles


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 7, 8, 13])
def test_window_hashes_depend_on_the_window_alone(k):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 400).astype(np.uint64)
    got, by_window = shingles.window_hashes(h, k), {}
    assert len(got) == 400 - k + 1
    for i, x in enumerate(got):
        assert by_window.setdefault(tuple(h[i : i + k]), x) == x
    assert len(set(by_window.values())) == len(by_window)
    assert len(shingles.window_hashes(h[: k - 1], k)) == 0


# substrings


def brute_removed(rows, width):
    first = {}
    for doc_id, text, *_ in rows:
        w, own = words(text), NO_ID if doc_id is None else doc_id
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            first[x] = min(first.get(x, own), own)
    out = []
    for doc_id, text, *_ in rows:
        w, own = words(text), NO_ID if doc_id is None else doc_id
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < own for j in range(i, i + width)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [3, 13])
def test_removed_words(spark, width, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 2000)  # several runs in a task
    got = substrings.removed(frame(spark, ROWS), width, blocks=5)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == brute_removed(ROWS, width)
    assert substrings.removed(frame(spark, []), width).count() == 0


def test_batches_against_an_index_of_runs(spark, tmp_path):
    """Three batches by rising ids, each against the compacted runs of those before, give what one batch gives."""
    rows = [r for r in ROWS if r[0] is not None]
    cuts, blocks, history, got = [0, 20, 45, 10_000], 4, None, []
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        batch = frame(spark, [r for r in rows if a <= r[0] < b])
        got += substrings.removed(batch, 13, history, blocks).collect()
        new = substrings.runs(batch, 13, blocks).where("block >= 0")
        path = str(tmp_path / f"run{a}")
        substrings.compacted(new if history is None else history.unionByName(new)).write.parquet(path)
        history = spark.read.parquet(path)
        assert history.count() <= blocks
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute_removed(rows, 13)


def test_packed_runs_round_trip():
    rng = np.random.default_rng(2)
    for n, high in ((0, 10), (1, 2**63), (500, 1000), (3000, 2**63), (20, 2**63)):
        prints = np.sort(rng.integers(0, high, n).astype(np.uint64) * np.uint64(2))
        check, doc = rng.integers(0, 256, n).astype(np.uint8), rng.integers(0, 9, n)
        ids = np.array([-5, 0, 3, 7, 100, 2**40, 2**41, 2**62, 2**63 - 1], np.int64)
        got = substrings.unpacked(substrings.packed(prints, check, doc, ids))
        assert all(np.array_equal(a, b) for a, b in zip(got, (prints, check, ids[doc]), strict=True))


def test_equal_fingerprints_with_different_checks_stay_apart():
    order, least = substrings.smallest(np.array([5, 5, 5, 5], np.uint64), np.array([1, 2, 1, 2], np.uint8), np.array([9, 4, 3, 8]))
    assert dict(zip(order.tolist(), least.tolist(), strict=True)) == {0: 3, 2: 3, 1: 4, 3: 4}


# Jaccard join


def brute_components(rows, k, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = r[0] if least[root(i)] is None else min(least[root(i)], r[0])
    return sorted(((r[0], len(sets[i]), least[root(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def near_copies(seed):
    """Chains and stars of near copies around the threshold, with a passage that all share."""
    rng, rows = random.Random(seed), []
    passage = sentence(rng, 50)
    for group in range(6):
        base = sentence(rng, rng.choice([8, 40, 100])).split() + (passage.split() if group % 2 else [])
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 10**6)}"
            rows.append((" ".join(own)))
            if rng.random() < 0.5:
                base = own
    rng.shuffle(rows)
    return [(1000 + i, t, "en", "s", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent", "rows"), [(4, 85, ROWS), (5, 80, near_copies(1)), (4, 85, near_copies(2)), (2, 60, near_copies(3) + ROWS)])
def test_components_of_the_join(spark, k, percent, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)  # all documents order the n-grams
    got = jaccard.join(frame(spark, rows), k, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, k, percent)


def test_join_without_an_order_and_with_exchanged_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_COMMON", 0)
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", -1)
    rows = near_copies(4)
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, 4, 85)
    assert jaccard.join(frame(spark, [])).count() == 0


def test_a_row_without_id_links_by_a_text_of_its_own(spark):
    """Two texts that are alike only through a third, which rows without an id alone have."""
    own = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(own), "en", "s", 1), (None, " ".join(own + [f"x{i}" for i in range(12)]), "en", "s", 1), (3, " ".join(own + [f"x{i}" for i in range(24)]), "en", "s", 1)]
    rows += [(None, None, "en", "s", 1), (None, "", "en", "s", 1), (None, "quite another text that is like none of the others", "en", "s", 1)]
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, 4, 85)
    assert [r["component_id"] for r in got if r["doc_id"] == 3] == [1]


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (205, 201), (None, 3), (-7, 300)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 200, 201: 200, 205: 200, -7: -7, 300: -7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# mixing


def brute_targets(sizes, limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(limit * sizes[s] for s in capped)
        target = {s: limit * sizes[s] for s in capped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > limit * sizes[s]}
        if not over:
            return target
        capped |= over


def mixing_rows(n=600):
    rng = random.Random(9)
    names = ["a", "b", "ä", "Z", None, "tiny"]
    return [(i, sentence(rng, rng.randint(0, 120)) if i % 17 else None, "en", rng.choices(names, [300, 20, 9, 9, 20, 2])[0], 1) for i in range(n)]


def test_mixture_meets_its_targets(spark):
    rows = mixing_rows()
    sizes, source_sizes = {r[0]: len(words(r[1])) for r in rows}, defaultdict(int)
    for r in rows:
        source_sizes[r[3]] += sizes[r[0]]
    target = brute_targets(source_sizes)
    assert any(target[s] == 3 * source_sizes[s] for s in target)
    mixture = mixing.mix(frame(spark, rows), block_words=16, bucket_rows=32)
    got = mixture.result().collect()
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == source_sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in target:
        assert abs(taken[s] - target[s]) <= max(48, 0.02 * target[s]), s
    again = mixing.mix(frame(spark, rows).repartition(5), block_words=16, bucket_rows=32).result().collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in got}
    assert "Python" not in mixture.result()._jdf.queryExecution().toString()


def test_shards_draw_their_sources(spark):
    mixture = mixing.mix(frame(spark, mixing_rows(200)), block_words=16, shard_slots=8, bucket_rows=32)
    slots = mixture.slots.collect()
    by_source, shards = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in slots:
        by_source[r["source_no"]].append(r["k"])
        shards[r["shard"]][r["source_no"]] += 1
    for ks in by_source.values():  # every slot of a source once
        assert sorted(ks) == list(range(len(ks)))
    assert set(shards) == set(range(-(-len(slots) // 8)))
    assert len({tuple(sorted(x.items())) for x in shards.values()}) > len(shards) / 2  # shards differ, as draws do


def test_mixing_rows_without_ids_agrees_under_any_partitioning(spark):
    """A third of the rows have no id, many of them one text; which of equal rows gets which share is free."""
    rows = mixing_rows(300)
    rows += [(None, rows[i % 7][1], "en", rows[i % 7][3], 1) for i in range(150)] + [(5, rows[9][1], "en", rows[9][3], 1)] * 40
    got = [sorted(tuple(r) for r in mixing.mix(frame(spark, rows).repartition(n), block_words=16, bucket_rows=16).result().drop("row").fillna(-1).collect()) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_index_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 4096, 5000, 12289):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(11)).alias("x"))
        assert sorted(r["x"] for r in got.collect()) == list(range(n))


def test_mixing_awkward_tables(spark):
    assert mixing.mix(frame(spark, [])).result().count() == 0
    empty = mixing.mix(frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).result().collect()
    assert [(r["size"], r["taken"], r["target"]) for r in empty] == [(0, 0, 0.0)] * 2
    assert mixing.mix(frame(spark, ROWS)).result().count() == len(ROWS)
