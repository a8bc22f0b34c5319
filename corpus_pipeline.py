"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next stage's ``docs``. All but the last
return the columns of ``docs``; the last adds what the mix decided.

1. language_id: documents without a letter, or whose language the calibrated
   model rejects, go. The model learns from the labelled rows of its own input.
2. near_dedup: of each group of near-duplicates (five-word shingles, 0.8)
   the document with the smallest id stays.
3. decontaminate: documents that hold a benchmark item within the allowed edits go.
4. secret_scan: found secrets are replaced by a mark; all documents stay.
5. source_mix: documents that the mix takes, with their size, their source's
   size and target, and the words taken (repeats counted).

Defined results: null texts go in stage 1; rows without id take part in all
stages but stand alone in stage 2; rows are told apart by a hash of id and text where
a stage decides on rows; columns may have any names besides doc_id, text, lang and source;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.llm import decontaminate, lang_id, mix, near_dup, secrets
from replenish.llm.common import BROADCAST_ROWS, table, written
from replenish.session import scratch, scratch_folder

#: The stages train models and walk components in rounds; SQL cannot express them.
ORACLE_SQL = None


def _neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that clash with nothing, and the name of each column there."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _row_key(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64(F.col(names["doc_id"]).cast("string"), F.col(names["text"])))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.fit(docs)
    plain, names = _neutral(docs)
    others = [n for c, n in names.items() if c != "doc_id"]
    out = lang_id.predict(plain, model, names["doc_id"], names["text"], others).where("not rejected")
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _neutral(docs)
    plain = _row_key(plain, names)
    found = decontaminate.find(plain, table(spark, sf_dir, "benchmark"), "row_key", names["text"])
    found = written(spark, found.select(F.col("doc_id").alias("row_key")).distinct(), "contaminated")
    small = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return plain.join(small, "row_key", "left_anti").select(*(F.col(n).alias(c) for c, n in names.items()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _neutral(docs)
    plain = _row_key(plain, names)
    found = secrets.find(plain, "row_key", names["text"])
    out = secrets.redact(plain.withColumn("before", F.length(names["text"])), found, "row_key", names["text"])
    if "n_chars" in names:
        n, text = F.col(names["n_chars"]), F.col(names["text"])
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(names["n_chars"], F.when(F.length(text) != F.col("before"), F.length(text).cast(kind)).otherwise(n))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _neutral(docs)
    others = [n for c, n in names.items() if c != "doc_id"]
    out = mix.mix_by_source(plain, names["doc_id"], names["text"], names["source"], others).where("taken > 0")
    added = [c for c in ("size", "source_size", "target", "taken") if c not in names]
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), *added)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read back.

    What a stage wrote on its way is deleted once its result stands.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        if k == len(STAGES):
            return stage(spark, docs, sf_dir)
        path = scratch_folder(spark, name)
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
