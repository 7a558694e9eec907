"""Tables written once in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session gets one of its own when none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file:///tmp/checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._is_written = True
    return out


def is_written(df: DataFrame) -> bool:
    """Whether `df` is a table as `written` gave it, so that reading it again costs no more than that."""
    return getattr(df, "_is_written", False)


#: Rows of keys and numbers that one task of a shuffle sorts or hashes, about: some 100 MB with what it keeps of them.
ROWS_EACH = 500_000
#: Tasks for each core that rows are dealt to by number, at most, unless there are too many rows for so few.
TASKS_A_CORE = 4


def dealt_to(spark: SparkSession) -> int:
    """The session's partitions, but no more than the cores have a use for: each is a task and a file in every table that is dealt by number,
    and a session for large inputs has hundreds, for small tables too."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def parts_of(spark: SparkSession, n_rows: int) -> int:
    """Partitions for a shuffle of so many narrow rows: those of `dealt_to`, and more where a task's share would grow beyond ROWS_EACH."""
    return max(dealt_to(spark), -(-n_rows // ROWS_EACH))


def spread_out(spark: SparkSession, n_rows: int = 0, each: int = ROWS_EACH) -> int:
    """Partitions for rows that take much more work than their bytes tell, so that none is left to be merged by size: two for each core or
    partition of `dealt_to`, one for each `each` rows if that is more, and as many for each core, so that files that are
    written so are dealt evenly when they are read."""
    cores = spark.sparkContext.defaultParallelism
    n = max(2 * cores, 2 * dealt_to(spark), -(-n_rows // each))
    return -(-n // cores) * cores


def side_by_side(spark: SparkSession, *makers: Callable) -> list:
    """What functions give that need nothing of each other, made at the same time: their many small jobs fill the cores together."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    with ThreadPool(len(makers)) as pool:
        going = [pool.apply_async(inheritable_thread_target(spark)(make)) for make in makers]
        return [one.get() for one in going]


#: Keys that a join hands to each task without a shuffle, about.
FEW_KEYS = 1_000_000


def without(rows: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """`rows` of a written table without those of `keys` (written): read anew each time while the keys are few, else written once."""
    rest = rows.join(keys, on, "left_anti")
    return rest if keys.count() <= FEW_KEYS else written(rest, name)


def open_shared(uri: str, mode: str):
    """A file in a shared folder, whichever file system that is in."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def join_counted(rows: DataFrame, few: DataFrame, on, how: str = "inner", limit: int = 200_000, most_bytes: int = 16 << 20) -> DataFrame:
    """Joins with a side that is counted first: broadcast up to `limit` rows and `most_bytes` of texts, binaries and lists, shuffled beyond."""
    from pyspark.sql import functions as F

    sizes = [F.lit(8 * len(few.columns))]
    for field in few.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0)))
    n, size = few.agg(F.count("*"), F.sum(sum(sizes[1:], sizes[0]))).first()
    return rows.join(F.broadcast(few) if n <= limit and (size or 0) <= most_bytes else few, on, how)
