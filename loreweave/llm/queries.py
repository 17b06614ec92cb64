"""The dealt operators' queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, divergence, licenses, media, packing, quality, secrets, sharding, simhash, trie, warc
from .common import Scratch, shared_folder
from .oracles import ORACLES

#: The conversation that holds the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"
SHARDS = 16
CAPACITY = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.chat_digest(chat.format_chats(turns.unionByName(extra)))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def tokenizer_path() -> str:
    """The vocabulary file, installed at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)
    return packing.pack(pieces, CAPACITY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "identifiers", F.array_join("licences", ",").alias("licences"), "n_known", "n_left")


#: The rules of the first of op5's two scans: one of them has changed since.
EARLIER_RULES = tuple(secrets.SecretRule("hex", "0", r"[0-9a-f]{32,}") if r.kind == "hex" else r for r in secrets.RULES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of a ledger: the English documents under earlier rules, then all documents under today's.

    The second scan takes blobs that are new under all rules and the others under
    the one that has changed; findings of its earlier version are not reported.
    """
    docs, scratch = table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "ledger")
    earlier = secrets.addressed(table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "text"))
    ledger = scratch.write(secrets.scan_unseen(earlier, EARLIER_RULES))
    versions = secrets.addressed(docs)
    ledger = ledger.unionByName(scratch.write(secrets.scan_unseen(versions, secrets.RULES, ledger)))
    found = secrets.on_paths(versions.select("doc_id", "blob", "marked"), secrets.findings(ledger))
    return found.select("doc_id", *(c.alias(k) for k, c in secrets.counts().items()), F.sha2(secrets.listed(secrets.base_spans()), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path()))


#: Seconds from a page's capture to its revisit.
REVISIT_AFTER = 6000


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its response at second page_id, and later a not-modified revisit with the same entity tag."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(start) + s)
    tag = F.md5("html")
    response = F.struct(
        (2 * F.col("page_id")).alias("record_id"),
        F.lit("response").alias("kind"),
        at(F.col("page_id")).alias("date"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.octet_length("html").cast("string")).alias("headers"),
        F.sha1("html").alias("payload_digest"),
        F.col("html").alias("body"),
    )
    revisit = F.struct(
        (2 * F.col("page_id") + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        at(F.col("page_id") + REVISIT_AFTER).alias("date"),
        F.lit(304).alias("status"),
        F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("string").alias("body"),
    )
    return pages.select("url", F.inline(F.array(response, revisit)))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' captures are written as WARC files to the shared folder, read from there and resolved."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(captures(table(spark, sf_dir, "pages")), folder)
    records = Scratch(spark, "records").write(warc.read_warc(spark, folder))  # without bodies
    rows = warc.resolve_revisits(records)
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return rows.select(number("record_id").alias("record_id"), "canonical", "verdict", number("response_id").alias("response_id"), "payload_digest", headers.alias("headers"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.read_media(media.store_texts(table(spark, sf_dir, "documents"))))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_rendezvous_shards": op2_rendezvous_shards,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_quality_rules": op9_quality_rules,
    "op10_webp_media": op10_webp_media,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_prefix_trie": op13_prefix_trie,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
