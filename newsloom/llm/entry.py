"""The numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.llm import decontaminate, language_id, license_scan, mixing, near_embeddings, packing, periodic_runs, secret_scan, setsketch, spelling, token_counts, url_filter, warc_archive
from newsloom.llm.shared import Scratch, table


def op1_near_embeddings(spark, sf_dir):
    return near_embeddings.near_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = secret_scan.fit_forest(secret_scan.labelled_findings(docs))
    return secret_scan.scan_secrets(docs, model)


def op5_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_edited(docs.withColumn("edits", token_counts.derived_edits("text")))


def op6_setsketch_dedup(spark, sf_dir):
    out = setsketch.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_source_mixing(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_warc_archive(spark, sf_dir):
    folder = Scratch(spark, "warc").root
    warc_archive.write_archive(table(spark, sf_dir, "pages"), folder)
    back = warc_archive.verified_records(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha1("record").alias("record_digest"), F.octet_length("record").cast("long").alias("record_bytes"))


def op11_periodic_runs(spark, sf_dir):
    """Texts of which some have planted repeats."""
    docs = periodic_runs.with_repeats(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_spelling_groups(spark, sf_dir):
    """Words of which some have lost a letter."""
    return spelling.spelling_groups(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_embeddings, op2_license_scan, op3_language_id, op4_secret_scan, op5_token_counts, op6_setsketch_dedup, op7_decontamination, op8_source_mixing, op9_url_filter, op10_warc_archive, op11_periodic_runs, op12_spelling_groups, op13_packing)}
ORACLE_SQL = {"op8_source_mixing": mixing.ORACLE, "op9_url_filter": url_filter.ORACLE, "op10_warc_archive": warc_archive.ORACLE}
