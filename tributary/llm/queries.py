"""One query per operator over the given tables, with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import language_model, quality
from tributary.llm.common import table
from tributary.llm.html_text import main_text
from tributary.llm.near_duplicates import near_duplicates
from tributary.llm.oracles import ORACLES
from tributary.llm.packing import pack
from tributary.llm.prefix_trie import prefix_trie
from tributary.llm.secret_scan import listed, of_kind, ratios, samples_of, transitions, with_spans
from tributary.llm.sentence_pieces import with_ids, with_text
from tributary.llm.sharding import shards
from tributary.llm.substrings import drop_repeats
from tributary.llm.structure_repair import repairs
from tributary.llm.toxicity import fitted, with_score
from tributary.llm.turns import n_words, numbered, part_of, parts, turn_key
from tributary.llm.vectors import nearest

__all__ = ["ORACLES", "QUERIES"]

#: Bytes of text in a shard at most.
SHARD_BYTES = 1 << 20

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, and decode its ids again."""
    path = vocabulary("piece_bpe_32k.model")
    both = with_text(with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path, into="decoded")
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def fold(doc_id: str = "doc_id") -> Column:
    """The fold of a row by its id: fold 0 of five is held out of all learning."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, quality.fitted(docs, table(spark, sf_dir, "labels").filter(fold() != 0)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels").filter(fold() != 0))
    return with_score(docs, model).select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_BYTES)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, ratios(transitions(samples_of(docs)))).select("doc_id", "spans")
    kinds = ("assign", "access", "hex")
    counts = [F.size(of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(listed(of_kind(F.col("spans"), *kinds)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_repeats(docs, window=35, rejoin=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to"
    )


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the turns ``conv_id, depth, key, words``, and each ``conv_id``.

    Conversation c begins with the first h turns of conversation c - c % ``every`` and goes on with its own
    turns after its first h, where h is crc32(c) % ``most``.  Turns go by turn, null first, then role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    keep = ["conv_id", turn_key(F.col("role"), F.col("text")).alias("key"), n_words(F.col("text")).alias("words")]
    turns = numbered(given, ["conv_id", "turn", "role", "text"], keep, "turns").frame
    spans = parts(turns, "conv_id")
    heads = turns.filter(F.col("conv_id") % every == 0).withColumn("part", part_of()).join(spans, ["conv_id", "part"])
    heads = heads.select(F.col("conv_id").alias("source"), "key", "words", (F.col("at") - F.col("first") + F.col("before")).alias("place")).filter(F.col("place") < most - 1)
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    convs = spans.groupBy("conv_id").agg(F.any_value("total").alias("total")).withColumn("source", F.col("conv_id") - F.col("conv_id") % every).withColumn("taken", taken)
    begin = convs.join(heads, "source").filter("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "key", "words")
    held = convs.select("conv_id", "source", "taken").join(convs.select(F.col("conv_id").alias("source"), F.col("total").alias("held")), "source", "left")
    held = held.select("conv_id", "taken", F.least("taken", F.coalesce("held", F.lit(0))).alias("headed"))
    own = turns.withColumn("part", part_of()).join(spans.join(held, "conv_id"), ["conv_id", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before"))
    own = own.filter("place >= taken").select("conv_id", (F.col("place") - F.col("taken") + F.col("headed") + 1).alias("depth"), "key", "words")
    return begin.unionByName(own), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations of which some rows are lost, emptied, cut, doubled or given to the user; a null counts as one space."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn"))) % 20
    rows = conversations.select("conv_id", "turn", lot.alias("lot"), held("role").alias("role"), held("text").alias("text")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    done = repairs(damaged(conversations))
    everyone = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("conv_id").alias("of")).distinct()
    found = everyone.join(done.summary, "conv", "left").join(done.sha256(), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("of").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 0 of ten is held out of all learning."""
    tenth = F.crc32(F.col("doc_id").cast("string")) % 10
    return language_model.scored(table(spark, sf_dir, "documents"), learn=tenth != 0, held_out=tenth == 0)


QUERIES: dict[str, Query] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_html_text": op6_html_text,
    "op7_sharding": op7_sharding,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_language_model": op13_language_model,
}
