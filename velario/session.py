"""Session settings for local runs, and shipping the package to the executors."""

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores="*", name="velario", partitions=8, memory="16g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use spark-submit's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


_SHIPPED = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    # Executors fetch the archive from this path when they start, so it stays.
    path = os.path.join(tempfile.mkdtemp(prefix="velario-"), "velario_package.zip")
    with open(path, "wb") as target:
        target.write(data.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``.

    A session without that setting (tests on one machine) uses its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_saved").rstrip("/")


def saved(df, name: str):
    """Write to the shared folder and read back: rows that are used more than once
    and must be the same each time, and a lineage that ends in files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
