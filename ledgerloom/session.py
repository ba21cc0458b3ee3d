"""Session set-up, table loading and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of Parquet that a side may have to be broadcast by hint.
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "ledgerloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster use the session given."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers of the session, once, so that it need not be installed
    on them."""
    context = spark.sparkContext
    if not getattr(context, "_ledgerloom_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_package.zip"  # on the driver, which serves it
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, str(module.relative_to(root.parent)))
        context.addPyFile(str(archive))
        context._ledgerloom_shipped = True
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir. Only a session
    on one machine may leave that unset; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to storage that all executors share, so that the loss of an
    executor costs no recomputation of the whole lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collects a table that is small by its nature; raises instead of collecting more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows and must not be gathered on the driver")
    return rows


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def sized_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast hint only for a table whose row count was checked; otherwise the table as it is, so
    that the join shuffles."""
    return F.broadcast(df) if small_enough(df, most) else df
