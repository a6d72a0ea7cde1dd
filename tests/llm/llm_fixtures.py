"""Texts that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

ODD = [None, "", " \t\n", "word", "a b", "x" * 5000, "naïve café 日本語 🙂 é", "one\r\ntwo\x0bthree\x0cfour", "\x00 \x1f   end"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark: SparkSession, texts: list[str | None], ids: list[int | None] | None = None, clash: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``doc_id, text`` and columns whose names clash with those that the operators make."""
    rows = [(i, t, *("other" for _ in clash)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in clash)])
    return spark.createDataFrame(rows, schema)
