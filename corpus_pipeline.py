"""The corpus pipeline: toxicity, near copies, secrets, source mixing, packing.

Each stage works on all that its predecessor kept, and writes nothing of its own but scratch tables in the shared folder:

* ``toxicity`` drops documents that score 0.5 or more;
* ``near_copies`` keeps one document, that of the smallest id, of each component of the n-gram Jaccard join. It takes five
  words and a similarity of 0.8, as stages on word shingles do unless a contract says otherwise;
* ``secrets`` replaces found secrets by a mark, and keeps every document;
* ``mixing`` repeats or leaves out documents so that each source's words come near its target: a document stands once for each
  time that the mixture takes all its words, and once more with the probability of what remains;
* ``packing`` cuts the documents' token ids into sequences of at most 1024, one row for each piece.

All but the last return the columns of ``docs``, whatever these are besides doc_id, text, source and n_chars.

Nulls: rows without an id are never dropped as near copies; rows without a text pass the first three stages, and have no words to mix. Of
repeated rows one stays, unless they have no id. Ties (equal ids, equal hashes) are decided by hash. A very long text is one document in
every stage, and is cut only into sequences. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard, mixing, packing, secrets, toxicity
from gridloom.llm.common import read_table, scratch_path, written
from gridloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"), texts=read_table(spark, sf_dir, "documents"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the rows of its smallest id; of several rows with one id, one. Rows without an id can't be told apart and stay."""
    found = written(jaccard.join(docs, k=5, percent=80).where("doc_id is not null"), "components")
    by_id = found.groupBy(F.col("doc_id").alias("_gl_id")).agg(F.min("component_id").alias("component"), F.count("*").alias("rows"))
    by_id = written(by_id.select("_gl_id", (F.col("component") < F.col("_gl_id")).alias("_gl_gone"), (F.col("rows") > 1).alias("_gl_often")).where("_gl_gone or _gl_often"), "gone")
    left = docs.join(by_id.where("_gl_gone").select("_gl_id"), F.col("doc_id") == F.col("_gl_id"), "left_anti")
    often = by_id.where("_gl_often and not _gl_gone").select("_gl_id")
    if often.isEmpty():
        return left
    once = left.join(often, F.col("doc_id") == F.col("_gl_id"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(often, F.col("doc_id") == F.col("_gl_id"), "left_anti").union(once)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of equal id and text share what the mixture takes of them."""
    result = mixing.mix(docs).result().where("size > 0")
    plan = result.groupBy("doc_id", "content").agg((F.sum("taken") / F.sum("size")).alias("_gl_times")).where("_gl_times > 0")
    plan = written(plan.select(F.col("doc_id").alias("_gl_id"), F.col("content").alias("_gl_content"), "_gl_times"), "copies")
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_gl_id")) & (F.xxhash64("text") == F.col("_gl_content")))
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # else rows without an id and of one text would all be drawn alike
    drawn = F.pmod(F.xxhash64("doc_id", "_gl_content", row, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor("_gl_times")
    copies = (whole + (drawn < F.col("_gl_times") - whole).cast("int")).cast("int")
    return joined.withColumn("_gl_copies", copies).withColumn("_gl_copy", F.explode(F.array_repeat(F.lit(0), F.col("_gl_copies")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The models, the hashes and the tokenizer are nothing that SQL can express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
