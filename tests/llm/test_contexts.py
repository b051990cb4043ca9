"""The mixing of bit predictors over whole texts (F8)."""

import math
import zlib

import numpy as np
import pytest

from gridloom.llm import contexts, lm
from tests.llm.cases import frame


def test_codes_are_prefix_free_and_as_short_as_huffman_says():
    counts = np.array([40, 1, 7, 7, 3, 19, 2])
    codes = contexts.Codes.of(counts)
    assert sum(2.0**-n for n in codes.length.tolist()) == 1 and (codes.length * counts).sum() == 160
    paths = [tuple(codes.path[a : a + n]) for a, n in zip(codes.start, codes.length, strict=True)]
    assert len(set(paths)) == len(counts) and all(p[0] >> 1 == paths[0][0] >> 1 for p in paths)
    assert contexts.Codes.of(np.array([5])).length.tolist() == [0]


@pytest.mark.parametrize("trained", [False, True])
def test_all_tokens_after_a_beginning_sum_to_one(trained):
    """A table in which every occurrence was counted gives a distribution over the next token, windows or not; words two tokens back change it."""
    rng = np.random.default_rng(1)
    ids = np.tile([0, 1, 2, 0, 3, 4], 60)
    ids[rng.integers(0, 360, 40)] = 5
    starts = np.arange(0, 360, 60)
    kinds = np.zeros(6, np.int32)
    model = contexts.Model.fresh(contexts.Codes.of(np.bincount(ids, minlength=7) + 1))
    if trained:
        table = np.zeros(2 * int(contexts.STARTS[-1]), np.uint32)
        for _, bit, _, slots in model.events(ids, starts, kinds):
            for s in slots:
                np.add.at(table, s * 2 + bit, np.uint32(1))
        model.table = np.searchsorted(contexts.COUNTS, table).astype(np.uint8).reshape(-1, 2)
        for _ in range(20):
            model.learn(ids, starts, kinds)
    one = np.zeros(1, np.int32)
    said = lambda *x: 10 ** model.cost(np.array(x), np.array([0]), one, np.array([False]))[0]
    for beginning in ((1, 2), (4,), (5, 0)):
        assert sum(said(*beginning, w) for w in range(7)) == pytest.approx(said(*beginning), rel=1e-6)
    if trained:
        after = lambda *x: said(*x) / said(*x[:-1])
        assert after(4, 0, 1) > 2 * after(2, 0, 1) and after(2, 0, 3) > 2 * after(4, 0, 3)


def test_every_place_of_a_token_is_predicted_from_what_stands_before(spark):
    """The follower of a pair of rare words is learned, though no single word tells it; look-ups by token, and candidates of common words alone, gave both the same score."""
    rows, rng = [], np.random.default_rng(2)
    for i in range(400):
        a, b = rng.integers(0, 2, 2)
        rows.append((i, " ".join(f"l{x} r{y} {'same' if x == y else 'other'}" for x, y in rng.integers(0, 2, (12, 2))) + f" l{a} r{b}", "en", "s", 1))
    held = [i for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 5 == 1][:16]
    for k, i in enumerate(held):  # the same words; in every second text each follower stands after the wrong pair
        x, last = k // 2 % 2, ("same", "other") if k % 2 == 0 else ("other", "same")
        rows.append((i, f"l{x} r{x} {last[0]} l{x} r{1 - x} {last[1]} " * 6 + "l0 " * (k // 4), "en", "s", 1))
    got = {r["doc_id"]: r for r in lm.scores(frame(spark, rows)).collect()}
    right, wrong = (np.mean([got[i]["score"] for i in held[k::2]]) for k in (0, 1))
    assert right > wrong + 3 and all(math.isfinite(r["score"]) for r in got.values())
