"""Versioned snapshots of graphs in shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.text import repo_key, snapshot_key
from tributary.schemas import EDGES, NODES
from tributary.session import KEYS

CATALOG = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("snapshot_key", T.StringType()),
    T.StructField("write_id", T.StringType()),
    T.StructField("cached_at", T.TimestampType()),
    T.StructField("node_count", T.LongType()),
    T.StructField("edge_count", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("deleted", T.BooleanType()),
])


def listing(catalog: DataFrame) -> DataFrame:
    """Stored snapshots with their size, newest first."""
    return catalog.select(
        "repo", "commit_sha", "cached_at", F.round(F.col("bytes") / 1024, 1).alias("size_kb")
    ).orderBy(F.col("cached_at").desc(), "repo", "commit_sha")


def stats(catalog: DataFrame) -> DataFrame:
    """One row: entries, total size, oldest and newest; zeros when empty."""
    return catalog.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1024, 1).alias("total_size_kb"),
        F.min("cached_at").alias("oldest_entry"),
        F.max("cached_at").alias("newest_entry"),
    )


def latest(entries: DataFrame, repo: str = "repo", at: str = "cached_at", tie: Sequence[str] = ("commit_sha",)) -> DataFrame:
    """The newest entry of each repository, matched without case.

    A grouped arg-max: partial results cross the wire, never all entries of a
    repository.
    """
    return (
        entries.groupBy(F.lower(repo).alias("_repo"))
        .agg(F.max_by(F.struct(*entries.columns), F.struct(at, *tie)).alias("e"))
        .select("e.*")
    )


def graph_meta(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Node, edge and entry point counts; the entry ids are their own rows in
    :func:`tributary.operators.graph.entry_points`."""
    n = nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("is_entry_point")).alias("entry_points")
    )
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, list(keys), "left").na.fill(0, ["edge_count"]).select(
        *keys, "node_count", "edge_count", "entry_points"
    )


class SnapshotStore:
    """Append-only tables of nodes, edges and a catalog under one folder.

    A write appends its rows under a fresh ``write_id`` and only then appends
    its catalog rows.  Readers start from the newest catalog row of a key, so a
    half-written or replaced snapshot is never visible.  Within one write rows
    are ranged by key: reading one repository prunes to its write and then to
    the row groups that hold it, and a repository of any size spreads over
    many files.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def write(self, nodes: DataFrame, edges: DataFrame) -> str:
        """Store the graphs of all repositories in ``nodes``; returns the id."""
        write_id = uuid.uuid4().hex
        for name, table, order in (("nodes", nodes, "id"), ("edges", edges, "source")):
            (
                table.withColumn("repo_key", repo_key(F.col("repo")))
                .withColumn("write_id", F.lit(write_id))
                .repartitionByRange("repo_key", "commit_sha", order)
                .sortWithinPartitions("repo_key", "commit_sha", order)
                .write.mode("append")
                .partitionBy("write_id")
                .parquet(f"{self.root}/{name}")
            )

        def measured(table: DataFrame, count: str, size: str) -> DataFrame:
            stored = F.octet_length(F.to_json(F.struct(*table.columns)))
            return table.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(count), F.sum(stored).alias(size))

        entry = (
            measured(nodes, "node_count", "_nb")
            .join(measured(edges, "edge_count", "_eb"), list(KEYS), "left")
            .na.fill(0, ["edge_count", "_eb"])
            .select(
                *KEYS,
                snapshot_key(F.col("repo"), F.col("commit_sha")).alias("snapshot_key"),
                F.lit(write_id).alias("write_id"),
                F.current_timestamp().alias("cached_at"),
                "node_count",
                "edge_count",
                (F.col("_nb") + F.col("_eb")).alias("bytes"),
                F.lit(False).alias("deleted"),
            )
        )
        entry.to(CATALOG).write.mode("append").parquet(f"{self.root}/catalog")
        return write_id

    def catalog(self) -> DataFrame:
        """Current snapshots: the newest row of each key, if not deleted."""
        rows = self._table("catalog", CATALOG)
        return (
            rows.groupBy("snapshot_key")
            .agg(F.max_by(F.struct(*CATALOG.names), F.struct("cached_at", "write_id")).alias("e"))
            .select("e.*")
            .filter(~F.col("deleted"))
        )

    def _read(self, name: str, schema: T.StructType, wanted: DataFrame, only: Column | None = None) -> DataFrame:
        stored = T.StructType([
            *schema.fields, T.StructField("repo_key", T.StringType()), T.StructField("write_id", T.StringType())
        ])
        ids = wanted.select(repo_key(F.col("repo")).alias("repo_key"), "commit_sha", "write_id")
        rows = self._table(name, stored)
        rows = rows if only is None else rows.filter(only)
        return rows.join(ids, ["write_id", "repo_key", "commit_sha"], "left_semi").select(*schema.names)

    def read(self, repo: str, commit_sha: str, node_schema: T.StructType = NODES) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of one snapshot; empty tables on a miss."""
        key = snapshot_key(F.lit(repo), F.lit(commit_sha))
        wanted = self.catalog().filter(F.col("snapshot_key") == key)
        only = (F.col("repo_key") == repo_key(F.lit(repo))) & (F.col("commit_sha") == commit_sha)  # stored columns: pushed to the scan
        tables = []
        for name, schema in (("nodes", node_schema), ("edges", EDGES)):
            tables.append(self._read(name, schema, wanted, only))
        return tables[0], tables[1]

    def exists(self, repo: str, commit_sha: str) -> bool:
        """Whether a key is stored; reads the catalog only."""
        key = snapshot_key(F.lit(repo), F.lit(commit_sha))
        return not self.catalog().filter(F.col("snapshot_key") == key).isEmpty()

    def find(self, repo: str) -> DataFrame:
        """All snapshots of a repository, matched without case, newest first."""
        return listing(self.catalog().filter(F.lower("repo") == repo.lower()))

    def invalidate(self, repo: str, commit_sha: str | None = None) -> int:
        """Remove one commit of a repository, or all; returns how many."""
        rows = self.catalog().filter(F.lower("repo") == repo.lower())
        if commit_sha is not None:
            rows = rows.filter(F.col("commit_sha") == commit_sha)
        count = rows.count()
        if count:
            gone = rows.withColumns({"deleted": F.lit(True), "cached_at": F.current_timestamp(), "write_id": F.lit("~deleted")})
            gone.select(*CATALOG.names).write.mode("append").parquet(f"{self.root}/catalog")
        return count

    def missing(self, keys: DataFrame) -> DataFrame:
        """Of the given ``(repo, commit_sha)`` keys, those not stored yet."""
        key = snapshot_key(F.col("repo"), F.col("commit_sha"))
        stored = self.catalog().select("snapshot_key")
        return keys.withColumn("snapshot_key", key).join(stored, ["snapshot_key"], "left_anti").select(*KEYS)


_DOCUMENT = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("lines", T.ArrayType(T.IntegerType())),
    ]))),
    T.StructField("edges", T.ArrayType(T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("type", T.StringType()),
    ]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored JSON documents, one file each, with ``valid``.

    Empty or unreadable files and documents without nodes or edges are not
    valid; split them off as rejects.
    """
    return checked_documents(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def checked_documents(raw: DataFrame) -> DataFrame:
    """The same for documents held as rows ``file, value``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    doc = raw.select("file", F.from_json("value", _DOCUMENT, options).alias("d"))
    valid = F.col("d._corrupt_record").isNull() & F.col("d.nodes").isNotNull() & F.col("d.edges").isNotNull()
    return doc.select("file", F.coalesce(valid, F.lit(False)).alias("valid"), "d.repo", "d.commit_sha", "d.nodes", "d.edges")


def document_nodes(documents: DataFrame) -> DataFrame:
    return documents.filter("valid").select(*KEYS, F.explode("nodes").alias("n")).select(
        *KEYS, "n.id", "n.label", "n.type", "n.file", "n.summary",
        F.try_element_at("n.lines", F.lit(1)).alias("start_line"), F.try_element_at("n.lines", F.lit(2)).alias("end_line"),
    )


def document_edges(documents: DataFrame) -> DataFrame:
    return documents.filter("valid").select(*KEYS, F.explode("edges").alias("e")).select(*KEYS, "e.*")
