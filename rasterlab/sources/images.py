"""Photos from folders to pixel tables."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from rasterlab.functions.scalar import exif_orientation, uploadable
from rasterlab.operators.scans import first_file

LAYOUT = r"([^/]+)/(UV|visible_light)/([^/]+)$"


def path_parts(path: Column) -> list[Column]:
    """Code, light and file name of ``<code>/<light>/<file>``."""
    return [F.regexp_extract(path, LAYOUT, i + 1).alias(n) for i, n in enumerate(("code", "light", "name"))]


def photo_files(spark: SparkSession, root: str) -> DataFrame:
    """(code, light, name, path) of the photos under ``root``; contents are
    not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.where(uploadable(F.col("path"))).select(*path_parts(F.col("path")), "path").where(F.col("code") != "")


def chosen_photos(files: DataFrame) -> DataFrame:
    """One photo per (code, light): the first by name, with the number found."""
    return first_file(files.withColumn("path", F.col("name"))).withColumnRenamed("path", "name")


def codes_without_uv(files: DataFrame) -> DataFrame:
    uv = files.where(F.col("light") == "UV").select("code").distinct()
    return files.select("code").distinct().join(uv, "code", "left_anti")


def _decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every photo under ``root`` as the image reader sees it; what it cannot decode has a height of -1."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).load(root)
    return raw.select(*path_parts(F.col("image.origin")), F.col("image.height").alias("h"), F.col("image.width").alias("w"),
                      F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def read_photos(spark: SparkSession, root: str) -> DataFrame:
    """(image_id, code, light, h, w, channels, data, orientation) of the chosen photos that can be decoded.

    ``h`` and ``w`` are those of the upright photo, ``data`` is as stored; ``pixels`` and ``packed.frame_rows`` turn it.
    The image reader keeps no tags, so the first bytes of the files are read a second time.
    """
    tags = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(uploadable(F.col("path"))).select(
        *path_parts(F.col("path")), exif_orientation(F.col("content")).alias("orientation"))
    picked = chosen_photos(photo_files(spark, root)).join(tags, ["code", "light", "name"])
    photos = _decoded(spark, root).where(F.col("h") > 0).join(picked, ["code", "light", "name"])
    return upright_size(photos).withColumn("image_id", F.concat_ws("/", "code", "light"))


def photo_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """(code, light, name, outcome, saved) of the chosen photos, for ``scans.ingest_report``: ``unreadable`` ones are
    those that the reader cannot decode."""
    read = _decoded(spark, root).where(F.col("h") > 0).select("code", "light", "name", F.lit(True).alias("_ok"))
    out = chosen_photos(photo_files(spark, root)).join(read, ["code", "light", "name"], "left")
    ok = F.coalesce("_ok", F.lit(False))
    return out.select("code", "light", "name", F.when(ok, "ok").otherwise("unreadable").alias("outcome"), ok.alias("saved"))


def upright_size(photos: DataFrame) -> DataFrame:
    """Photos whose stored ``h`` and ``w`` become those of the upright photo."""
    turned = F.col("orientation") >= 5
    return photos.withColumns({"h": F.when(turned, F.col("w")).otherwise(F.col("h")), "w": F.when(turned, F.col("h")).otherwise(F.col("w"))})


_TURNS = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.T,
          6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].T, 8: lambda a: np.rot90(a)}


@F.pandas_udf(ArrayType(IntegerType()))
def _packed(data: pd.Series, channels: pd.Series, h: pd.Series, w: pd.Series, orientation: pd.Series) -> pd.Series:
    """Upright pixels as 0xRRGGBB from interleaved BGR, BGRA or gray bytes."""
    out = []
    for raw, n, rows, cols, o in zip(data, channels, h, w, orientation):
        a = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(np.int32)
        b, g, r = (a[:, 0], a[:, 0], a[:, 0]) if n == 1 else (a[:, 0], a[:, 1], a[:, 2])
        rgb = (r << 16) | (g << 8) | b
        if o in _TURNS and len(rgb) == rows * cols:
            rgb = _TURNS[o](rgb.reshape((cols, rows) if o >= 5 else (rows, cols))).ravel()
        out.append(rgb)
    return pd.Series(out)


def packed_rgb(photos: DataFrame) -> Column:
    """The upright frame of each photo as one array; photos without ``orientation`` are upright."""
    o = F.col("orientation") if "orientation" in photos.columns else F.lit(1)
    return _packed("data", "channels", "h", "w", o)


def pixels(photos: DataFrame, keep=("image_id",)) -> DataFrame:
    """One row per pixel, laid out by image.

    The encoded frames are shuffled, not their pixels: the hash layout set
    here holds through the explode.
    """
    own = [c for c in ("h", "w", "channels", "data", "orientation") if c in photos.columns]
    laid = photos.select(*[c for c in keep if c not in own], *own).repartition("image_id")
    each = laid.select(*keep, "h", "w", F.posexplode(packed_rgb(laid)).alias("_pos", "_p"))
    p = F.col("_p")
    return each.select(*keep, "h", "w", F.expr("_pos div w").cast("int").alias("y"), (F.col("_pos") % F.col("w")).alias("x"),
                       F.shiftright(p, 16).bitwiseAND(F.lit(255)).alias("r"),
                       F.shiftright(p, 8).bitwiseAND(F.lit(255)).alias("g"), p.bitwiseAND(F.lit(255)).alias("b"))
