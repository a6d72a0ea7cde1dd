"""Session helpers: staging of loop rounds and skew-safe joins."""

from __future__ import annotations

import copy
import os
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading key of every table.
KEYS = ("repo", "commit_sha")

#: Rows of one join key that go to one task; a key with more rows is split.
ROWS_PER_CHUNK = 2_000_000


def local_session(app: str = "tributary", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and for the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.driver.memory", os.environ.get("TRIBUTARY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    may fall back to a folder of its own, since there driver and executors
    are one process.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tributary-"))
    return sc.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader over the copy.

    This cuts the lineage of loops and lets several consumers share one
    evaluation.  The copy is ordinary Parquet in shared storage: it survives
    the loss of executors, and its real size steers later join choices.
    """
    path = f"{shared_dir(df.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"
    _written(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


#: Spark's own switch: what a finished execution shuffled is deleted, not only when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> None:
    """Write ``df``; the copy stands for it from then on, so its shuffle files go at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


class StagedRounds:
    """One staged table written round by round, each a folder of its own in it: no round is copied."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.total = 0

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self.paths)}"
        _written(df, path)
        self.paths.append(path)
        self.schema = df.schema
        part = self.spark.read.schema(df.schema).parquet(path)
        self.total += part.count()  # read from the footers of the staged files
        return part

    def rows(self, since: int = 0) -> DataFrame:
        out = self.spark.read.schema(self.schema).parquet(*self.paths[since:])
        out._staged_at = self.path
        return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no pending result reads any more; other tables stay."""
    if not hasattr(df, "_staged_at"):
        return
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def telling_first(by: Sequence[str]) -> list[str]:
    """Keys to sort and group by, the one with most values first.

    Tables lead with the repository.  Sorts compare rows by the first bytes of
    their first column, so a column that rows of one repository share would make every
    comparison a full one.
    """
    return list(by)[::-1]


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    salts: int = 32,
) -> DataFrame:
    """Join a table to a much smaller one whose key may be hot in ``big``.

    The rows of one key spread over ``salts`` tasks by a hash of ``spread``;
    the small side is repeated once per salt.  No broadcast is asked for: if
    the repeated side turns out small, the size check of adaptive execution
    makes it one.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join keeps the left side, so not {how!r}")
    cols = list(spread) or [c for c in big.columns if c not in on]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


class KeyedChunks:
    """A table prepared for skew-safe joins on ``on``.

    Keys with more than ``rows_per_chunk`` rows are cut into chunks by a hash
    of ``spread``.  The probe side is repeated once per chunk for those keys
    only, so no task ever gets more than about one chunk of a hot key and the
    join result stays whole.

    The table is staged unless the caller says it is.  With ``resident`` it
    serves the rounds of a loop: if it is large it is partitioned and sorted by
    its key and kept on the executors, so a round moves only its frontier (if rounds
    tell how many rows they have, once several had many).  A
    lost executor's part is rebuilt from the staged copy.  Use it as a context
    manager to let go of it after the loop: then the copy it made is deleted too.
    """

    #: Rounds of many rows that read the staged table before it is kept on the executors.
    ROUNDS_UNPLACED = 3

    def __init__(
        self,
        table: DataFrame,
        on: Sequence[str],
        spread: Sequence[str],
        rows_per_chunk: int = ROWS_PER_CHUNK,
        label: str = "chunks",
        resident: bool = False,
        staged: bool = False,
    ) -> None:
        self.on = telling_first(on)
        self.rows_per_chunk = rows_per_chunk
        self.copies = [] if staged else [stage(table, label)]
        table = table if staged else self.copies[0]
        self.large = table.count() > rows_per_chunk  # read from the footers of the staged files
        self.has_hot = False
        if self.large:
            hot = (
                table.groupBy(*self.on)
                .agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > rows_per_chunk)
                .select(*self.on, F.ceil(F.col("_n") / rows_per_chunk).cast("int").alias("_chunks"))
            )
            self.hot = stage(hot, f"{label}-hot")
            self.copies.append(self.hot)
            self.has_hot = not self.hot.isEmpty()
        if self.has_hot:
            table = (
                salted_join(table, self.hot, self.on, "left", spread)
                .withColumn("_chunk", F.pmod(F.xxhash64(*spread), F.coalesce("_chunks", F.lit(1))).cast("int"))
                .drop("_chunks")
            )
        self.resident = resident and self.large
        self.large_rounds, self.placed = 0, False
        self.table = table

    def __enter__(self) -> KeyedChunks:
        return self

    def __exit__(self, *_) -> None:
        if self.placed:
            self.table.unpersist()
        for copy in self.copies:
            unstage(copy)

    def _place_if_due(self, count: int | None) -> None:
        """A round of few rows has them sent to the table, which moves then in no case."""
        self.large_rounds += count is not None and count * 4 > self.rows_per_chunk
        due = count is None or self.large_rounds > self.ROUNDS_UNPLACED
        if self.resident and due and not self.placed:
            self.table, self.placed = _placed(self.table, [*self.on, "_chunk"] if self.has_hot else self.on), True

    def at(self, keys: DataFrame, label: str) -> KeyedChunks:
        """The rows of some keys, staged, for one probe: where the keys are few enough to be sent around, no other row moves."""
        part = copy.copy(self)
        part.table, part.resident = stage(self.table.join(keys.select(*self.on), self.on, "left_semi"), label), False
        return part

    def probe(self, rows: DataFrame, count: int | None = None) -> DataFrame:
        """Inner join of ``rows`` to the table on the key columns; a loop whose rounds differ tells how many they are."""
        self._place_if_due(count)
        if not self.has_hot:
            return rows.join(self.table, self.on)
        spread_rows = (
            rows.join(self.hot, self.on, "left")
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
            .drop("_chunks")
        )
        return spread_rows.join(self.table, [*self.on, "_chunk"]).drop("_chunk")


def _placed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by).sortWithinPartitions(*by).persist(StorageLevel.MEMORY_AND_DISK)


class Collected:
    """What a loop has found so far, for joins on ``by``.

    While it is small its staged parts are read again.  Once it is large the
    parts are kept on the executors, partitioned by ``by``.
    """

    def __init__(self, by: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> None:
        self.by = telling_first(by)
        self.limit = rows_per_chunk
        self.total = 0
        self.parts: list[DataFrame] = []
        self.placed = 0

    def __enter__(self) -> Collected:
        return self

    def __exit__(self, *_) -> None:
        for part in self.parts[: self.placed]:
            part.unpersist()

    def add(self, staged: DataFrame) -> None:
        self.parts.append(staged)
        self.total += staged.count()  # read from the footers of the staged files
        if self.total > self.limit:
            for i in range(self.placed, len(self.parts)):
                self.parts[i] = _placed(self.parts[i], self.by)
            self.placed = len(self.parts)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def require(df: DataFrame, columns: Sequence[str], operator: str) -> None:
    """Fail early, with names, when an operator's input lacks columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{operator}: input lacks columns {missing}; it has {df.columns}")


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank.

    A top-k report: Spark limits each group before the shuffle
    (WindowGroupLimit), so a hot group sends at most ``k`` rows per task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*telling_first(by)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
