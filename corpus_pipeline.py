"""From raw documents to a mixed training corpus: five stages, each on all that the one before kept.

Rows whose doc_id is null or repeats are judged by doc_id and text together; texts are read whole; null and empty texts
go with the first stage; an empty table stays empty. Stages read doc_id, text and source (null where a table has no such
column); all other columns, whatever their names, travel as one struct and come back as they were. The first four stages
give the columns of documents, n_chars following a redacted text; the last adds copy and taken, and calls them
mix_copy and mix_taken (or mix_mix_copy and so on) where the documents have columns of these names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.llm import decontaminate, language_id, mixing, secret_scan, setsketch
from newsloom.llm.shared import Scratch, broadcast_if_small, table

#: Language scores below this (no profile is any nearer than chance) count as no language.
LANGUAGE_SCORE = 0.02
#: Near duplicates share so many per cent of their five-word shingles.
NEAR = 80
#: What stages read.
READ = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}


def _narrow(docs):
    """What stages read of ``docs``, and all of its other columns as one struct, ``row``."""
    read = [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in READ.items()]
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]
    return docs.select(*read, F.struct(F.lit(0).alias("_"), *rest).alias("row"))


def _whole(narrow, columns):
    """The rows of ``_narrow`` with the ``columns`` that they came from, the text as it now is."""
    return narrow.select(*[F.col("text") if c == "text" else F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)])


def _keyed(narrow):
    """With a hash of doc_id and text, by which a row is known: doc_ids can repeat or be null."""
    return narrow.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _only(keyed, rows, how):
    """Rows of ``keyed`` (with row_key) whose doc_id and text are those of a row of ``rows``, or not."""
    rows = broadcast_if_small(rows.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")))
    return keyed.join(rows, (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), how)


def language(spark, docs, sf_dir):
    """Documents without text, letters or any language's n-grams go."""
    judged = language_id.identify(_narrow(docs))
    return _whole(judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)), docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: that with the smallest doc_id (null last), then the smallest
    hash of its text; of rows that repeat it the first by a hash of the whole row. Texts without a word are in no group and stay."""
    scratch = Scratch(spark, "unique")
    judged = scratch.save(setsketch.near_duplicates(docs, NEAR).where("group is not null"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    best = judged.groupBy("group").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1").select("f.doc_id", "f.row_key")
    best = scratch.save(best.withColumn("best", F.lit(True)))
    groups = judged.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    several = judged.join(groups, "group", "left_semi").groupBy("doc_id", "row_key").agg(F.count("*").alias("n"))
    several = several.join(best.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "best"), (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    several = scratch.save(several.select("doc_id", "row_key", "n", F.coalesce("best", F.lit(False)).alias("best")))
    keyed = _keyed(_narrow(docs))
    kept = _only(keyed, several.where("not best or n > 1"), "left_anti")
    repeated = scratch.save(several.where("best and n > 1"))
    if not repeated.isEmpty():  # one of the rows that are alike in doc_id and text
        same = _only(keyed, repeated, "left_semi").groupBy("doc_id", "row_key").agg(F.min_by(F.struct("text", "lang", "source", "row"), F.xxhash64(F.to_json("row"))).alias("r"))
        kept = kept.unionByName(same.select("doc_id", "r.text", "r.lang", "r.source", "r.row", "row_key"))
    return _whole(kept, docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go, those without doc_id too; others that share a doc_id with one stay."""
    keyed = _keyed(_narrow(docs))
    found = decontaminate.contaminated(keyed.select(F.struct("doc_id", "row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = Scratch(spark, "ids").save(found.select("doc_id.doc_id", "doc_id.row_key").distinct())
    return _whole(_only(keyed, found, "left_anti"), docs.columns)


def secrets(spark, docs, sf_dir):
    """Secrets in the text are replaced by a mark; n_chars follows."""
    narrow = _narrow(docs)
    changed = _whole(secret_scan.redact(narrow, secret_scan.fit_forest(secret_scan.labelled_findings(narrow))), docs.columns)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def mixing_stage(spark, docs, sf_dir):
    """The mixed corpus: documents as often as the mix takes them, the last copy cut where a target ends."""
    mixed = mixing.mixed_rows(mixing.mix(_narrow(docs)))
    own = {}
    for c in ("copy", "taken"):
        name = c
        while name in docs.columns:
            name = f"mix_{name}"
        own[c] = name
    kept = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return mixed.select(*[kept.get(c, F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)], *[F.col(c).alias(n) for c, n in own.items()])


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("source mixing", mixing_stage),
]
#: The stages use trained models and sketches, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
