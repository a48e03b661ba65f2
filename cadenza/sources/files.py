"""Reading and writing panels: Parquet, CSV, Feather, and JSON lines for logs."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession


class FileFormat(Enum):
    PARQUET = "parquet"
    CSV = "csv"
    FEATHER = "feather"

    @classmethod
    def of(cls, name: str | FileFormat) -> FileFormat:
        try:
            return name if isinstance(name, cls) else cls(str(name).lower())
        except ValueError:
            raise ValueError(f"unknown file format {name!r}") from None


#: Rows that a Feather file may have here: it is written by the driver alone.
FEATHER_ROWS = 5_000_000


def read(spark: SparkSession, path: str, fmt: str | FileFormat, schema: str | None = None) -> DataFrame:
    """Feather goes through the driver and is meant for small tables; the others are scans."""
    fmt = FileFormat.of(fmt)
    if fmt is FileFormat.FEATHER:
        import pyarrow.feather

        return spark.createDataFrame(pyarrow.feather.read_table(path))
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt is FileFormat.CSV:
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    return reader.parquet(path)


def write(df: DataFrame, path: str, fmt: str | FileFormat, partition_by: tuple[str, ...] = ()) -> None:
    fmt = FileFormat.of(fmt)
    if fmt is FileFormat.FEATHER:
        import pyarrow.feather

        small = df.limit(FEATHER_ROWS + 1).toArrow()
        if small.num_rows > FEATHER_ROWS:
            raise ValueError(f"more than {FEATHER_ROWS} rows: write Parquet")
        pyarrow.feather.write_feather(small, path)
        return
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True).csv if fmt is FileFormat.CSV else writer.parquet)(path)


def append_log(df: DataFrame, path: str) -> None:
    """Trial logs as JSON lines; appends of several runs don't disturb each other."""
    df.write.mode("append").json(path)
