"""The queries opN_<name> over the synthetic tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import oracles
from corvane.llm.common import cut, table


def _sha(ids: str) -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.severity(docs, model)
    return scored.select("doc_id", "severity", "grade", "p_toxic", toxicity.is_toxic(model).alias("toxic"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.bpe import ByteBpe

    bpe = ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs).drop("text")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(key: str, parts: int) -> Column:
    """Rows that training must not see: crc32 of the key as text is divisible by ``parts``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == 0, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import quality

    stats, names = quality.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stats = cut(stats)
    rules = quality.train(stats, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5)), names)
    score = rules.score({n: F.col(n) for n in names})
    return stats.select("doc_id", held_out("doc_id", 5).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


#: Bytes of text that one shard may hold.
SHARD_BYTES = 4 << 20


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import classlm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, rest = classlm.train(docs.where(~held_out("doc_id", 10)))
    return classlm.score(docs, model, rest, [F.col("doc_id"), held_out("doc_id", 10).alias("held_out")])


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import licences

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.licence_findings(docs, licences.model(docs))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select("doc_id", F.size(sure).cast("long").alias("n_findings"), licences.families().alias("families"), F.transform(sure, lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])).alias("lines"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.decontam import contamination, is_contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secret_spans(docs, secrets.model(spark, docs))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.described("base"), 256).alias("base_sha256"), secrets.described("spans").alias("spans"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.wordbpe import WordBpe

    bpe = WordBpe(spark, public_tokenizers.path("word_bpe_49k.json"))
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm import merkle

    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = merkle.leaf(*(low if c == "text" else F.col(c) for c in merkle.FIELDS))
    built = merkle.manifest(table(spark, sf_dir, "documents"), changed=F.when(held_out("doc_id", 5), changed))
    found = built.proofs().withColumn("folded_root", merkle.folded(F.col("path"), F.coalesce("changed", "hash")))
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    return found.select(F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_class_lm": op4_class_lm,
    "op5_licences": op5_licences,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard": op9_jaccard,
    "op10_secrets": op10_secrets,
    "op11_search": op11_search,
    "op12_word_bpe": op12_word_bpe,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL: dict[str, str] = {"op11_search": oracles.SEARCH, "op13_merkle": oracles.MERKLE}
