"""Session settings, lineage cuts and skew-aware joins shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let the runtime split a skewed key even when the next aggregate then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# A plan's estimate of sizes does not count the rows an explode adds, and a road is exploded to vertices, samples
# and cells: up to hundreds of rows for one.  So little is broadcast by an estimate, and not much by what was measured.
_SMALL_BROADCASTS = {
    "spark.sql.autoBroadcastJoinThreshold": "256KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB",
}


def tune(spark: SparkSession, explodes: bool = False) -> SparkSession:
    """Apply the session settings the operators count on.

    With ``explodes`` also the limits on broadcasts for jobs that explode their tables; without, those the cluster was started with.
    """
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in _SMALL_BROADCASTS.items():
        value = value if explodes else spark.sparkContext.getConf().get(key)
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark


def table_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A temporary folder of our own is used only in local mode with the setting unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, **metrics: Column) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` as a table in the shared folder and read it back.

    This ends the lineage (a lost executor costs a re-read, not a re-run) and gives the
    optimizer the real size of the result.  Named aggregate columns in ``metrics`` are
    computed by the same job and returned beside the table.
    """
    spark = df.sparkSession
    path = f"{table_dir(spark)}/wayframe-{uuid.uuid4().hex}"
    if not metrics:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    seen = Observation()
    observed = df.observe(seen, *[c.alias(name) for name, c in metrics.items()])
    observed.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`cut` wrote and nothing reads any more, such as the rounds before the last."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/wayframe-" in f.rsplit("/", 1)[0]}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys of which a few may hold a large share of the rows.

    Both sides are read once.  The runtime measures the shuffled partitions, splits those that
    are much larger than the others over several tasks and repeats the other side's part for
    them (``tune`` has this on, also where the next aggregate then needs a shuffle of its own).
    No estimate decides anything.
    """
    return left.join(right, on, how)


def rule_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of fixed rules, written in the plan itself."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
