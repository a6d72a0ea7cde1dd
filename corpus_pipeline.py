"""The corpus pipeline: from documents to packed training sequences.

Each stage works on what the one before has kept.  All but the last return the columns
of ``documents``; their decisions are in the rows and texts that they return.

In every stage a null text counts as empty and stays null, equal rows are rows of their own until near
duplicates keeps one of them, texts of any length are taken whole, columns of other names, also of names
that operators use, come back as they are, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import secret_scan, toxicity
from tributary.llm.common import free_name, staged, table
from tributary.llm.near_duplicates import one_of_each
from tributary.llm.packing import pack
from tributary.llm.queries import fold, vocabulary
from tributary.llm.substrings import drop_repeats

#: What stands for a secret in a kept text.
SECRET = "[SECRET]"


def _same_columns(changed: DataFrame, docs: DataFrame, new: Column) -> DataFrame:
    """The columns of ``docs``, with the length counted anew where the text is another one."""
    counts = {"n_chars": F.when(new, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return changed.withColumns(counts).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the classifier learns from the labelled folds only."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels").filter(fold() != 0))
    score = free_name(docs, "score")
    return toxicity.with_score(docs, model, into=score).filter(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked over five-word shingles at 0.8 or more, the one with the smallest id stays; those without an id or a word stay."""
    return one_of_each(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that start at two places or more are cut out; other texts stay as they are."""
    # The operator adds two columns; those of the input that have their names stand aside meanwhile.
    aside = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_words", "n_removed")}
    changed = drop_repeats(docs.withColumnsRenamed(aside), window=35)
    removed = free_name(docs, "removed")
    changed = changed.withColumnRenamed("n_removed", removed).drop("n_words").withColumnsRenamed({new: old for old, new in aside.items()})
    return _same_columns(changed, docs, F.col(removed) > 0)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    spans = free_name(docs, "spans")
    found = secret_scan.with_spans(docs, secret_scan.ratios(secret_scan.transitions(secret_scan.samples_of(docs))), into=spans)
    return _same_columns(secret_scan.redacted(found, F.lit(SECRET), spans=spans), docs, F.size(spans) > 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left, cut into sequences of 2048."""
    return pack(docs, vocabulary("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("substring_dedup", repeated_passages),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: Classifier, sketches and tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = staged(step(spark, docs, sf_dir), name).frame
    return STAGES[-1][1](spark, docs, sf_dir)
