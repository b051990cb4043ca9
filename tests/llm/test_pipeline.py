"""The pipeline's stages over awkward tables, and its queries in the entry module."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline isn't here", allow_module_level=True)

import corpus_pipeline
from gridloom.llm.queries import QUERIES
from tests.llm.cases import documents, frame, labels
from tests.llm.test_corpus_operators import brute_components
from tests.llm.test_row_operators import base_spans

ROWS = documents()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    frame(spark, ROWS).write.parquet(str(where / "documents.parquet"))
    labels(spark, ROWS).write.parquet(str(where / "labels.parquet"))
    docs, out = spark.read.parquet(str(where / "documents.parquet")), {}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(where)).write.parquet(str(where / name))
        out[name] = docs = spark.read.parquet(str(where / name))
    out["run"] = corpus_pipeline.run(spark, str(where))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["start"].columns


def test_near_copies_leave_one_of_each_component(stages):
    before = [tuple(r)[:5] for r in stages["toxicity"].collect()]
    after = Counter(r["doc_id"] for r in stages["near_copies"].collect())
    keep = [doc_id for doc_id, _, component in brute_components(before, 5, 80) if doc_id is None or doc_id == component]
    assert set(after) == set(keep)
    assert all(after[x] == 1 for x in after if x is not None)


def test_secrets_are_marked_and_nothing_else_changes(stages):
    before = {r["doc_id"]: r["text"] for r in stages["near_copies"].collect()}
    after = stages["secrets"].collect()
    assert len(after) == stages["near_copies"].count()
    for r in after:
        if base_spans(before[r["doc_id"]] or ""):
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
        elif "[SECRET]" not in (r["text"] or ""):
            assert r["text"] == before[r["doc_id"]]


def test_mixing_repeats_at_most_three_times(stages):
    copies = Counter(r["doc_id"] for r in stages["mixing"].collect())
    assert copies and max(n for k, n in copies.items() if k is not None) <= 3
    texts = {r["doc_id"]: r["text"] for r in stages["secrets"].collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in stages["mixing"].collect())


def test_run_gives_the_last_stage(stages):
    pieces = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pieces(stages["run"]) == pieces(stages["packing"])


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py" and len(corpus_pipeline.STAGES) == 5
