"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Upper bound, in rows, of any table an operator may hand to every executor.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; columns are pruned by Catalyst from the operators' selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own, else (local mode only) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="tidewire-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (written somewhere), marked for broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidewire-src-")) / "tidewire_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("tidewire") / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._tidewire_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer than half as many pieces, as a small single file does.

    Inputs of normal size come in more pieces than there are cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
