"""The thin queries that apply each operator to its whole table and derive the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, conversations, decontaminate, jaccard, langid, linededup, media, mixing, oracles, pieces, pii, repeats, tokenids, toxicity
from .shared import arrow_rows, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary"))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    frames = tokenids.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    with arrow_rows(spark, 1):
        return written(tokenids.read(frames, with_ids=False), "token-counts")


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = written(media.store_texts(table(spark, sf_dir, "documents")), "media")
    described = media.describe(kept.select("digest", "form"))
    # The size travels with the page, so that a repeated or null doc_id needs no join back.
    parsed = media.parse(kept.select("doc_id", "n_bytes", "html"), "doc_id", size_col="n_bytes")
    out = media.resolve(parsed, described)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))

    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    def listed(kinds: tuple[str, ...]) -> Column:
        some = [F.transform(of(kind), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for kind in kinds]
        return F.array_join(F.concat(*some), ",")

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        listed(pii.KINDS).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 6).alias("top_score"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=id_crc() % 5 != 0)
    out = toxicity.predict(docs, model)
    return out.select("doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces, CRC-32 of their ids as little-endian 32-bit integers, SHA-256 of what they decode to."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digests(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model))


def piece_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn=id_crc() % 4 != 2)
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), words=False)
    return mixing.taken(mixed).select("doc_id", "size", "source_size", "target", "taken")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damaged(table(spark, sf_dir, "conversations"))
    out = conversations.repair(turns, turns["there"])
    lines = F.array_join(F.transform("repaired", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_media_sequences, op3_pii, op4_toxicity, op5_line_dedup, op6_ngram_jaccard_join, op7_repeated_strings, op8_decontamination, op9_sentence_pieces, op10_language_id, op11_centroid_clusters, op12_source_mix, op13_conversation_repair)}
ORACLES: dict[str, str] = oracles.ORACLES
