"""Writers for reports and features."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_label(text: Column) -> Column:
    """A label that a spreadsheet will not read as a formula."""
    return F.when(F.ltrim(text).rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def field_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per field and value, as text."""
    fields = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot([key], fields, "field", "value")


def hex_feature(corners: Column, properties: Column) -> Column:
    """A GeoJSON polygon feature from an array of corners (x, y) and a struct of properties."""
    ring = F.transform(F.concat(corners, F.slice(corners, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def publish(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes beside the destination and renames when complete; a destination that exists is an error and stays as it was."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place(path)):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.format(form).save(staged)
    if not fs.rename(place(staged), place(path)):
        raise OSError(f"could not publish {path}")
