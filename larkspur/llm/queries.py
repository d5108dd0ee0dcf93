"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import byte_pairs, conversations, fingerprints, pii, toxicity
from larkspur.llm.common import lower_ascii, remainder
from larkspur.llm.decontaminate import decontaminate
from larkspur.llm.language_model import score_documents
from larkspur.llm.line_templates import dedup_lines
from larkspur.llm.manifest import digest, manifest
from larkspur.llm.packing import pack
from larkspur.llm.simhash import simhash_components
from larkspur.llm.substrings import dedup_substrings
from larkspur.llm.url_rules import best_rule, host, judge, path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    a, b, c = (fingerprints.selected_hashes(F.col(x)) for x in ("fp", "edited_fp", "next_fp"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fp")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(a, b).alias("near_edited"),
        fingerprints.likeness(a, c).alias("near_next"),
    )


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled documents that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(F.col("doc_id"), 5) != 0)
    return toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels are the given rules' verdicts on the pages that they fit: rules mined from these judge the others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    given = best_rule(host(F.col("url")), path(F.col("url")))
    return judge(pages, pages.select("url", (given["verdict"] == "block").alias("block")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(pii.as_text(F.col("base")).cast("binary"), 256)
    sanitised = F.sha2(pii.redacted(F.col("text"), F.col("spans")).cast("binary"), 256).alias("sanitised_sha256")
    return found.select("doc_id", *(count(k) for k in pii.KINDS[:4]), digest.alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), sanitised)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair_report(conversations.damage(rows), rows)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampering lower-cases the text of every third document or so, chosen by its id; one without an id isn't chosen."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower_ascii(F.col("text")))
    found = manifest(table(spark, sf_dir, "documents"), tampered)
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """`vocabulary` is the path of a file of ranks."""
    import public_tokenizers

    ranks = byte_pairs.read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = lambda ids, decoded: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
    return byte_pairs.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, both, "ids_sha256 string, decoded_sha256 string")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_url_rules": op3_url_rules,
    "op4_packing": op4_packing,
    "op5_line_templates": op5_line_templates,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_model": op7_language_model,
    "op8_simhash": op8_simhash,
    "op9_personal_data": op9_personal_data,
    "op10_substrings": op10_substrings,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_manifest": op12_manifest,
    "op13_byte_pairs": op13_byte_pairs,
}
