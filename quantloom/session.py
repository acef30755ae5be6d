"""Sessions, and the package's way to the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("quantloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Have workers able to import this package: by PYTHONPATH or the working directory, or else by a zip sent with the job."""
    home = str(_ROOT.parent)
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == home or os.path.isdir("quantloom"):
        return spark
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        to = Path(tempfile.mkdtemp(prefix="quantloom-")) / "quantloom.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the folder of ``spark.checkpoint.dir``; partitions stay as they are. Where that is unset, as in tests, a local
    session gets a folder of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        set_by = spark.conf.get("spark.checkpoint.dir", None)
        if not set_by and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(set_by or tempfile.mkdtemp(prefix="quantloom-"))
    return df.checkpoint(eager=True)
