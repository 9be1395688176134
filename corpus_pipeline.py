"""A corpus pipeline: five stages, each one operator of ``corvane.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept
and returns a DataFrame; ``run`` writes it as Parquet and reads it again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, jaccard, secrets, toxicity
from corvane.llm.common import OWN, checkpoint_dir, cut, table
from corvane.sources.sinks import remove

#: SQL has no equivalent of the first stage's model, so none for the rows of run().
ORACLE_SQL = None


def _columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go.

    Null and empty texts, which have no words, stay; repeated rows go or stay together; an
    empty table stays empty. Further columns, whatever their names, stay as they are.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least id stays.

    Of rows that share an id and a text one stays, with further columns as they come
    first in order; rows that share an id but not the text count as one document and
    stay or go together. Rows without an id link with nothing; of equal texts without an
    id one stays, null and blank ones, which link with nothing, all. An empty table
    stays empty. Further columns stay as they are; they must be of types that have an order.
    """
    found = jaccard.jaccard_components(docs, k=5, num=4, den=5)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return _without_repeats(docs.join(gone, "doc_id", "left_anti").select(*_columns(docs)), docs)


def _without_repeats(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """``kept``, which comes from ``docs``, with one row of each id and text, the least by its other columns.

    Only rows that repeat are exchanged; mostly there are none, and that is seen first.
    """
    digest, repeats = F.xxhash64("text"), F.col("doc_id").isNotNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    twice = cut(docs.where(repeats).groupBy("doc_id", digest.alias(f"{OWN}digest")).count().where("count > 1").select(F.col("doc_id").alias(f"{OWN}id"), f"{OWN}digest"))
    if twice.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (F.col(f"{OWN}own") == F.col(f"{OWN}digest")) & F.coalesce(repeats, F.lit(False))
    marked = kept.withColumn(f"{OWN}own", digest)
    once = marked.join(twice, same, "left_anti").select(*_columns(docs))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.min(F.struct(F.lit(0).alias(f"{OWN}none"), *(F.col(f"`{c}`") for c in others))).alias(f"{OWN}row")
    rest = marked.join(twice, same, "left_semi").groupBy("doc_id", "text").agg(row)
    return once.union(rest.select(*(F.col(f"{OWN}row")[c].alias(c) if c in others else F.col(c) for c in docs.columns)))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts have no words and stay; rows are judged one by one, so repeated
    rows go or stay together; an empty table stays empty, and an empty benchmark rejects
    nothing. Further columns stay as they are.
    """
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), prefix=OWN)
    return found.where(~decontam.is_contaminated(f"{OWN}n_words", f"{OWN}n_hit")).select(*_columns(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes.

    ``n_chars``, where there is such a column, follows a text that changes. Null and empty
    texts stay as they are, repeated rows change alike, an empty table stays empty, and
    columns named as the operator's own (``base``, ``spans``) stay as they are.
    """
    spans = f"{OWN}spans"
    found = secrets.secret_spans(docs, secrets.model(spark, docs), base=f"{OWN}base", spans=spans)
    new = found.withColumn("text", F.when(F.size(spans) > 0, secrets.redacted("text", spans)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids of the text, their number, and whether decoding gives the text again.

    Null and empty texts have no tokens; each row gives one row, repeated ones too;
    further columns are not returned.
    """
    import public_tokenizers

    codec = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = codec.round_trip(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.encode("text", "UTF-8")).alias("same"))


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on ``documents``. What lies between them is in the checkpoint folder;
    a stage's rows are deleted when the next ones are written, but for those that the result reads."""
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            remove(spark, f"{top}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
