"""Grounding context for conversations and the references in answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import last_segment, strip
from tributary.schemas import HISTORY_MESSAGES, OUTLINE_CALLS, OUTLINE_ENTRIES, OUTLINE_FILES, SUGGESTED_QUESTIONS
from tributary.session import KEYS, first_k


def outline_lines(nodes: DataFrame, limit: int = OUTLINE_FILES, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(file, start_line, id, line)``: the repository outline as lines.

    The first files by path; under each its definitions by start line, with
    the summary when there is one.
    """
    keys = list(keys)
    files = first_k(nodes.filter(F.col("type") == "file").select(*keys, "id"), keys, ["id"], limit)
    chosen = files.select(*keys, F.col("id").alias("file"))
    head = files.select(*keys, F.col("id").alias("file"), F.lit(0).alias("start_line"), "id", F.concat(F.lit("  "), "id").alias("line"))
    suffix = F.when(F.length("summary") > 0, F.concat(F.lit(" — "), "summary")).otherwise("")
    word = F.when(F.col("type") == "function", "def ").otherwise("class ")
    children = nodes.filter(F.col("type").isin("function", "class")).join(chosen, [*keys, "file"], "left_semi").select(*keys, "file", F.coalesce("start_line", F.lit(0)).alias("start_line"), "id", F.concat(F.lit("    "), word, "label", suffix).alias("line"))
    return head.unionByName(children)


def outline_text(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(file, text)``: the outline block of each listed file.

    A file's definitions come from one file of bounded size, so a block fits
    one row.
    """
    return (
        lines.groupBy(*keys, "file")
        .agg(F.sort_array(F.collect_list(F.struct("start_line", "id", "line"))).alias("l"))
        .select(*keys, "file", F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("text"))
    )


def entry_context(nodes: DataFrame, limit: int = OUTLINE_ENTRIES, keys: Sequence[str] = KEYS) -> DataFrame:
    """First entry points of each repository, as context lines."""
    rows = nodes.filter(F.col("is_entry_point") & (F.col("type") != "file")).select(*keys, "id", "summary")
    return first_k(rows, keys, ["id"], limit).select(
        *keys, "rank", "id", F.concat(F.lit("  "), "id", F.lit(": "), F.coalesce("summary", F.lit(""))).alias("line")
    )


def call_context(edges: DataFrame, limit: int = OUTLINE_CALLS, keys: Sequence[str] = KEYS) -> DataFrame:
    """First call edges of each repository, as context lines."""
    rows = edges.filter(F.col("type") == "calls").select(*keys, "source", "target")
    return first_k(rows, keys, ["source", "target"], limit).select(
        *keys, "rank", F.concat(F.lit("  "), "source", F.lit(" → "), "target").alias("line")
    )


def last_messages(turns: DataFrame, limit: int = HISTORY_MESSAGES, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last messages of every conversation; rank 1 is the newest."""
    return first_k(turns, [conversation], [F.col(turn).desc()], limit)


def suggestions(nodes: DataFrame, keys: Sequence[str] = KEYS, limit: int = 4) -> DataFrame:
    """``(rank, question)``: starting questions for each repository."""
    keys = list(keys)
    entry = nodes.filter(F.col("is_entry_point") & (F.col("type") != "file")).groupBy(*keys).agg(
        F.min_by("label", "id").alias("entry")
    )
    files = nodes.filter(F.col("type") == "file").select(*keys, "id")
    first = (
        first_k(files, keys, ["id"], 4)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("f1"),
            F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("f2"),
        )
    )
    overall, connections, purpose, relation = SUGGESTED_QUESTIONS
    questions = F.array(
        F.lit(overall),
        F.lit(connections),
        F.when(F.col("entry").isNotNull(), F.format_string(purpose, "entry")),
        F.when(F.col("files") > 3, F.format_string(relation, last_segment(F.col("f1"), "/"), last_segment(F.col("f2"), "/"))),
    )
    repos = nodes.select(*keys).distinct()
    rows = repos.join(entry, keys, "left").join(first, keys, "left")
    return rows.select(*keys, F.posexplode(F.slice(F.array_compact(questions), 1, limit)).alias("pos", "question")).select(
        *keys, (F.col("pos") + 1).alias("rank"), "question"
    )


def answer_references(answers: DataFrame, nodes: DataFrame, carry: Sequence[str], keys: Sequence[str] = KEYS, column: str = "answer") -> DataFrame:
    """``(carry.., ordinal, id)``: ids listed on ``NODE:`` lines that exist."""
    rows = answers.select(
        *keys, *carry, F.posexplode_outer(F.split(column, "\n")).alias("ordinal", "_line")
    ).filter(F.startswith(strip(F.col("_line")), F.lit("NODE:")))
    ids = rows.select(*keys, *carry, "ordinal", strip(F.substring(strip(F.col("_line")), 6, 1 << 30)).alias("id"))
    return ids.join(nodes.select(*keys, "id"), [*keys, "id"], "left_semi").select(*keys, *carry, "ordinal", "id")


def inline_references(
    answers: DataFrame, nodes: DataFrame, carry: Sequence[str], keys: Sequence[str] = KEYS, column: str = "answer", by_label: bool = False
) -> DataFrame:
    """``(carry.., ordinal, token, id)``: back-ticked names that are nodes.

    The closing reference list is cut off first.  Chat answers accept ids with
    ``::``; impact answers (``by_label``) accept ids and labels, and an id
    wins over a label.
    """
    keys = list(keys)
    body = F.regexp_replace(column, r"(?s)(?:\n|^)References:.*", "") if not by_label else F.col(column)
    tokens = answers.select(
        *keys, *carry, F.posexplode_outer(F.regexp_extract_all(body, F.lit("`([^`]+)`"), F.lit(1))).alias("ordinal", "token")
    ).filter(F.col("token").isNotNull())
    if not by_label:
        hits = tokens.filter(F.contains("token", F.lit("::"))).join(
            nodes.select(*keys, F.col("id").alias("token")), [*keys, "token"], "left_semi"
        )
        return hits.select(*keys, *carry, "ordinal", "token", F.col("token").alias("id"))
    names = nodes.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("id").alias("token"), F.lit(0).alias("o")), F.struct(F.col("label").alias("token"), F.lit(1).alias("o"))
            )
        ).alias("n"),
        "id",
    ).groupBy(*keys, "n.token").agg(F.min(F.struct("n.o", "id")).alias("m"))
    return tokens.join(names.select(*keys, "token", "m.id"), [*keys, "token"]).select(*keys, *carry, "ordinal", "token", "id")
