"""One registered query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import ann, chat, decontaminate, divergence, forest_join, hmm, host_suffix, langid, oracles, pfair, pii, quality, runs, token_counts

#: Demonstration key, for sessions that set none in spark.crestline.pii.key.
PII_KEY = b"crestline demonstration key"

#: Target weights of the mix; any other source has weight 2.
MIX_WEIGHTS = {"src0": 5, "src1": 4, "src2": 3, "src3": 1}
MIX_DEFAULT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_rest(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def pii_key(spark: SparkSession) -> bytes:
    named = spark.conf.get("spark.crestline.pii.key", None)
    return named.encode() if named else PII_KEY


def op1_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffix.extract(table(spark, sf_dir, "pages"))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, learn=id_rest("doc_id", 3) != 1)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_rest("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat.digest(chat.format_chats(turns.unionByName(extra)))


def op6_marginal_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_rest("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (id_rest("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark)).withColumn("n_pii", F.size("pii_kinds"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.mix(docs, MIX_WEIGHTS, default_weight=MIX_DEFAULT)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.plant(table(spark, sf_dir, "documents"))))


def op13_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.score_texts(table(spark, sf_dir, "documents"), id_rest("doc_id", 7) != 2)
    return found.withColumn("learn", ~F.col("learn")).withColumnRenamed("learn", "held_out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_qgram_decontamination, op2_minhash_forest_join, op3_host_suffix_text, op4_pairwise_quality, op5_prefix_target_chat, op6_marginal_unigram_langid, op7_feistel_pii, op8_pfair_mix, op9_token_counts, op10_anisotropic_search, op11_source_divergence, op12_lyndon_runs, op13_hidden_markov_scores)
}

#: The others learn, hash or decode; tests hold them against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op2_minhash_forest_join": oracles.NEAR_DUPLICATES,
    "op5_prefix_target_chat": oracles.CHATS,
    "op8_pfair_mix": oracles.mix(MIX_WEIGHTS, MIX_DEFAULT),
    "op11_source_divergence": oracles.DIVERGENCE,
}
