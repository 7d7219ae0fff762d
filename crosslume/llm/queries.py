"""Registered queries of the operators of this package: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslume.llm import (
    ball_tree,
    centroids,
    chat,
    decontaminate,
    language,
    order_minhash,
    packing,
    prefix_trie,
    quality,
    setsketch,
    substring_dedup,
    toxicity,
    training_order,
)
from crosslume.llm.labelled import fold
from crosslume.sources.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.edited(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(
        spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    )
    talks = chat.read_back(chat.examples(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = language.fit(docs, ~held_out)
    rows = language.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.with_score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = setsketch.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
    # The operator keeps one of several rows that share a doc_id; here ids are asked for.
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.with_score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    members = stage(found.members, "centroids-members")
    own = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    texts = [(i, ",".join(map(str, c))) for i, c in enumerate(found.centroids.tolist())]
    names = spark.createDataFrame(texts, "cluster int, centroid string")
    total = own.agg(F.sum("cluster_inertia").alias("inertia"))
    own = own.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(total))  # a row for each centroid
    return members.join(F.broadcast(own), "cluster").select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2("centroid", 256).alias("centroid_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_substring_dedup,
        op3_best_fit_packing,
        op4_order_minhash,
        op5_chat_format,
        op6_language_id,
        op7_quality,
        op8_training_order,
        op9_near_dedup,
        op10_toxicity,
        op11_top_k,
        op12_centroids,
        op13_prefix_trie,
    )
}
