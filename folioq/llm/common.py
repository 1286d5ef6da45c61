"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, U+0009 to U+000D and the space.
SPACES = "\t\n\x0b\x0c\r "
#: Rows that are taken out of Arrow at a time.
PIECE = 256
#: Rows that go to a Python worker at a time at most, and the session's setting for it.
ARROW_ROWS, ARROW_SETTING = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches PIECE rows at a time, so that a task holds few rows as Python objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, PIECE):
            yield batch.slice(a, PIECE)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers at most ARROW_ROWS rows at a time, so that neither side holds buffers of thousands of whole
    texts; a smaller setting stays. It holds for what is planned later too, as a result is planned when it is read."""
    if not 0 < int(spark.conf.get(ARROW_SETTING)) <= ARROW_ROWS:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; without one only a single local JVM gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioq-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like cut, but as a Parquet table in the shared folder: far smaller than a checkpoint where values repeat.

    The table stays until the folder is cleared.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column has yet, in whatever case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def split_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fold(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed; null is empty."""
    return text.encode("utf-8").lower() if text else b""
