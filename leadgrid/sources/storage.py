"""Where derived tables go, and how layers are stored."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from leadgrid.config import table_name

CHECKPOINT_DIR = "spark.checkpoint.dir"
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
_local_root: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session may fall back to a folder of this machine, one for
    the whole process.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    if not _local_root or not os.path.isdir(_local_root[0]):
        _local_root[:] = [tempfile.mkdtemp(prefix="leadgrid-")]
    return _local_root[0]


def _run_name(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/leadgrid/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the run's own folder."""
    return f"{_run_name(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove the run's folder. Call it when no result of the run is read any
    more; frames over stored intermediates fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_name(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: later uses scan the files instead of running
    the plan again, and a lost executor costs no recomputation behind them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_view(df: DataFrame, table: str, layer: str | None = None) -> DataFrame:
    """Silver staging: a view that re-reads Bronze when queried.

    A session's views have no schema, so the layer is part of the name; builds
    that share a session are told apart by their layers.
    """
    name = table_name(table, layer).replace(".", "__")
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def as_table(
    df: DataFrame, table: str, layer: str | None = None, partition_by=(), bucket_by=(),
    judge: Callable[[], None] | None = None,
) -> DataFrame:
    """Silver and Gold tables: a full rebuild, stored as Parquet.

    A schema that does not exist yet is created in the session's warehouse. If
    the catalog ends with the session, so do its tables: they get a folder of
    the run there, and no later run finds files that no catalog knows.

    ``bucket_by`` deals rows into as many sorted buckets as the session has
    shuffle partitions, so tables that have the same keys meet without a
    shuffle. Choose keys of which none holds much of the table.

    ``judge`` is called when the rows are written but not yet published; if it
    raises, the table is as it was, and what was written stays aside under the
    name with ``__unchecked``.
    """
    spark, name = df.sparkSession, table_name(table, layer)
    schema, place = name.split(".")[0], ""
    if spark.conf.get("spark.sql.catalogImplementation") == "in-memory":
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        place = f" LOCATION '{warehouse}/{spark.sparkContext.applicationId}/{schema}.db'"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}{place}")
    writer = df.write
    if bucket_by:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # dealt out as the buckets are, so that each is one file
        writer = df.repartition(buckets, *bucket_by).write.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    target = name if judge is None else f"{name}__unchecked"
    writer.mode("overwrite").partitionBy(*partition_by).format("parquet").saveAsTable(target)
    if judge is not None:
        judge()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"ALTER TABLE {target} RENAME TO {name}")
        if partition_by and spark.conf.get("spark.sql.catalogImplementation") == "in-memory":
            _move_partitions(spark, name)
    return spark.table(name)


def _move_partitions(spark: SparkSession, name: str) -> None:
    """Point a renamed table's partitions at its folder.

    The catalog that ends with the session moves the files with the table, but
    still looks for its partitions in the folder of the old name.
    """
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    folder = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()[-1]["data_type"]
    for row in spark.sql(f"SHOW PARTITIONS {name}").collect():
        values = [map(unquote, part.split("=", 1)) for part in row["partition"].split("/")]
        spec = ", ".join(f"`{k}` = {'NULL' if v == _NULL_PARTITION else quoted(v)}" for k, v in values)
        spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION {quoted(folder + '/' + row['partition'])}")


def load(spark: SparkSession, table: str, layer: str | None = None) -> DataFrame:
    """A stored table or a staging view by its layer's name."""
    name = table_name(table, layer)
    view = name.replace(".", "__")
    return spark.table(view if spark.catalog.tableExists(view) else name)
