"""What the operators of this package share: session settings, saved tables, text rows."""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.session import ship_package

# Documents that a Python worker treats at once. Spark bounds the bytes of an Arrow
# batch; this bounds what is made of them.
BATCH_ROWS = 256
# Documents encoded at once: the more, the fewer look-ups of words.
ENCODED_ROWS = 2048


def ready(spark: SparkSession) -> str:
    """Prepare a session for Python stages; the shared folder for saved tables.

    The folder is ``spark.checkpoint.dir``. Only a session without that setting
    (tests on one machine) uses a folder beside its warehouse instead. No setting of
    the session is changed.
    """
    ship_package(spark)
    return shared_folder(spark)


def small(batches, rows=BATCH_ROWS):
    """Arrow batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm_saved"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost
    executor costs a read of a file and never the steps before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone: other columns, whatever their
    names, never meet the helper columns of an operator."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def row_key(docs: DataFrame) -> DataFrame:
    """Add ``key_id`` and ``key_hash``: never null, the same for repeated rows only."""
    return docs.withColumns({"key_id": F.coalesce("doc_id", F.lit(-1)),
                             "key_hash": F.xxhash64("doc_id", "text")})


def column_bytes(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 ``bytes``, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def rows_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
