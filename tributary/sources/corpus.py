"""Reading a corpus: addresses, listings, contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.schemas import ADDRESS, EXCLUDED_PATH_TERMS, FILES
from tributary.session import KEYS, salted_join


def parse_repo_urls(urls: DataFrame, column: str = "url", host: str = r"github\.com") -> DataFrame:
    """Add ``owner``, ``name`` and ``valid`` to rows with a repository address.

    The address has an optional scheme and ``www.``, the host (a pattern) and
    exactly two path parts; a trailing ``.git`` is cut.  Split accepted from
    rejected rows on ``valid``.
    """
    clean = F.regexp_replace(F.regexp_replace(column, r"^\s+|\s+$", ""), r"/+$", "")
    pattern = ADDRESS.format(host=host)
    valid = F.coalesce(clean.rlike(pattern), F.lit(False))
    name = F.regexp_replace(F.regexp_extract(clean, pattern, 2), r"\.git$", "")
    return urls.withColumns(
        {
            "valid": valid,
            "owner": F.when(valid, F.regexp_extract(clean, pattern, 1)),
            "name": F.when(valid, name),
        }
    )


def repo_path(urls: DataFrame, column: str = "url", host: str = r"github\.com") -> DataFrame:
    """Add ``repo_path``: the ``owner/name`` found anywhere in the text."""
    found = F.regexp_extract(column, host + r"/([^/]+/[^/?#]+)", 1)
    return urls.withColumn("repo_path", F.nullif(F.regexp_replace(found, r"\.git$", ""), F.lit("")))


def list_sources(
    tree: DataFrame, match: str = "substring", max_bytes: int | None = None, terms: Sequence[str] = EXCLUDED_PATH_TERMS
) -> DataFrame:
    """Source files worth reading, judged by path and size alone.

    Files larger than ``max_bytes`` are left out only if a caller asks for it.
    Excluded terms match anywhere in the path, or whole path parts with
    ``match="segment"``.  A ``type`` column restricts rows to blobs.
    """
    path = F.col("path")
    keep = F.endswith(path, F.lit(".py")) & (F.substring_index(path, "/", -1) != "__init__.py")
    if max_bytes is not None:
        keep = keep & (F.coalesce("size", F.lit(0)) <= max_bytes)
    if match == "segment":
        keep = keep & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(t) for t in terms]))
    else:
        for term in terms:
            keep = keep & ~F.contains(path, F.lit(term))
    if "type" in tree.columns:
        keep = keep & (F.col("type") == "blob")
    return tree.filter(keep)


def over_limit(tree: DataFrame, cap: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Repositories with more listed files than ``cap``, and their counts."""
    return tree.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") > cap)


def within_limit(tree: DataFrame, cap: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Files of repositories within the cap, if there is one; others are rejected whole."""
    if cap is None:
        return tree
    return salted_join(tree, over_limit(tree, cap, keys).select(*keys), keys, "left_anti", ["path"])


def _below(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below the root with ``_parts``: owner, name, commit and the rest of the path."""
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
        .load(root)
    )
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    qualified = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return raw.withColumn("_parts", F.split(F.substr("path", F.lit(len(qualified) + 2)), "/", 4))


def read_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Files below ``root/owner/name/commit/...`` with their contents.

    Listing predicates on path and size apply before contents are read, since
    the file source drops the content column until it is used.  Files that
    vanish or cannot be read are skipped, and so are files of zero bytes, which
    Spark's file source leaves out.  ``misplaced`` lists files that lie too high.
    """
    rows = _below(spark, root, glob)
    parts = F.col("_parts")
    return rows.filter(F.size(parts) == 4).select(
        F.concat_ws("/", parts[0], parts[1]).alias("repo"),
        parts[2].alias("commit_sha"),
        parts[3].alias("path"),
        F.col("length").alias("size"),
        F.col("content").alias("bytes"),
    )


def misplaced(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Files below the root that are in no owner, name and commit folder."""
    return _below(spark, root, glob).filter(F.size("_parts") < 4).select("path", F.col("length").alias("size"))


def load_contents(tree: DataFrame) -> DataFrame:
    """Decode file bytes; files without bytes are dropped."""
    return tree.filter(F.col("bytes").isNotNull()).select(
        *KEYS, "path", F.make_valid_utf8(F.col("bytes").cast("string")).alias("content")
    ).to(FILES)


def file_sources(files: DataFrame, wanted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contents of the wanted ``(keys, path)``, with ``found``."""
    stored = files.filter(F.col("content").isNotNull()).select(*keys, "path", "content", F.lit(True).alias("found"))
    rows = wanted.select(*keys, "path").distinct().join(stored, [*keys, "path"], "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(False)))


def spread(df: DataFrame) -> DataFrame:
    """Fill all task slots when a small input has fewer partitions.

    Large inputs arrive in many splits and stay as they are; only an input of
    fewer splits than slots pays for a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if len(df.inputFiles()) < slots else df
