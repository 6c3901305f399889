"""Image files to tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumentab.operators.phash import HASHES, equal_sizes, stack_hashes
from lumentab.session import ship_package
from lumentab.sources.paths import is_image, parent_name

IMAGE_SCHEMA = T.StructType([
    T.StructField("image", T.StructType([
        T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType()),
    ]))
])
FEATURES = T.StructType([T.StructField("mean_v", T.DoubleType()), T.StructField("sd_v", T.DoubleType()), *HASHES.fields])
FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of the image files below a folder, sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").filter(is_image(F.col("path"))).orderBy("path")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Path, class folder and SHA-256 of every image file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(is_image(F.col("path")))
    return files.select("path", parent_name(F.col("path")).alias("class_name"), F.sha2("content", 256).alias("digest"))


def scanned(images: DataFrame) -> DataFrame:
    """Flat image rows; a file that cannot be decoded is a row with ``read_ok`` false."""
    i = F.col("image")
    return images.select(
        i["origin"].alias("path"), (i["width"] > 0).alias("read_ok"), i["height"].alias("height"), i["width"].alias("width"),
        i["nChannels"].alias("channels"), i["data"].alias("data"),
    )


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Batch scan with failure isolation: one bad file never ends the job."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    return scanned(raw)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def byte_cells(data: pd.Series) -> pd.Series:
    """Image bytes to an array of numbers; there is no built-in for this step."""
    return data.map(lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.float64))


def image_rasters(images: DataFrame) -> DataFrame:
    """Readable images as raster rows with one plane per channel (b, g, r)."""
    ship_package(images.sparkSession)
    good = images.filter("read_ok").withColumn("flat", byte_cells("data"))

    def plane(c):
        return F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda p: F.get("flat", p * F.col("channels") + c))

    planes = F.transform(F.sequence(F.lit(0), F.col("channels") - 1), plane)
    return good.select("path", F.col("height").alias("h"), F.col("width").alias("w"), planes.alias("planes"))


def gray_stack(data: list[bytes], height: int, width: int, channels: int) -> np.ndarray:
    """Gray values (n, h, w) of equally large images, as ``gray`` mixes them; fewer than three channels give the first."""
    planes = np.stack([np.frombuffer(b, dtype=np.uint8) for b in data]).reshape(len(data), height, width, channels).astype(np.float64)
    if channels < 3:
        return planes[..., 0]
    return np.clip(np.rint(planes[..., 2] * 0.299 + planes[..., 1] * 0.587 + planes[..., 0] * 0.114), 0, 255)


@F.pandas_udf(FEATURES)
def gray_features(data: pd.Series, h: pd.Series, w: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Mean, population deviation and both hashes of the gray image; null where there is no whole image."""
    out = pd.DataFrame({"mean_v": np.nan, "sd_v": np.nan, "phash": pd.array([None] * len(data), "Int64"), "dhash": pd.array([None] * len(data), "Int64")})
    out = out.astype({"mean_v": "Float64", "sd_v": "Float64"})
    size = np.array([-1 if b is None else len(b) for b in data], dtype=np.int64)
    whole = (size > 0) & (size == (h * w * channels).to_numpy())
    for kind in np.unique(channels.to_numpy()[whole]):
        for at, height, width in equal_sizes(h, w, whole & (channels == kind).to_numpy()):
            stack = gray_stack([data.iloc[i] for i in at], height, width, int(kind))
            flat = stack.reshape(len(at), -1)
            mean, squares = flat.sum(axis=1) / flat.shape[1], (flat * flat).sum(axis=1) / flat.shape[1]
            spread = np.sqrt(np.maximum(0.0, squares - mean * mean))
            for place, values in enumerate((mean, spread, *stack_hashes(stack))):
                out.iloc[at, place] = values
    return out


def file_features(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory, quality and hashes of every image file below a folder, in one scan.

    ``path, class_name, read_ok, h, w, mean_v, sd_v, phash, dhash``; a file that cannot be
    read is a row without features. Nothing is shuffled; images go to numpy as bytes, and those
    of one size are worked on together, a few megabytes at a time.
    """
    ship_package(spark)
    rows = read_images(spark, folder)
    known = lambda c: F.when(F.col("read_ok"), F.col(c))
    made = rows.withColumn("f", gray_features(known("data"), "height", "width", "channels"))
    return made.select("path", parent_name(F.col("path")).alias("class_name"), "read_ok", known("height").alias("h"), known("width").alias("w"), "f.mean_v", "f.sd_v", "f.phash", "f.dhash")


def image_pixels(images: DataFrame) -> DataFrame:
    """Readable images as ``path, y, x, c, v`` rows."""
    ship_package(images.sparkSession)
    good = images.filter("read_ok").select("path", "width", "channels", F.posexplode(byte_cells("data")).alias("i", "v"))
    cell = F.floor(F.col("i") / F.col("channels"))
    return good.select(
        "path", F.floor(cell / F.col("width")).cast("int").alias("y"), (cell % F.col("width")).cast("int").alias("x"),
        (F.col("i") % F.col("channels")).alias("c"), F.col("v").cast("int").alias("v"),
    )


def pixels_of_arrays(rows: DataFrame, key: str, cells: str, width: int, channels: int = 1) -> DataFrame:
    """Row-major arrays to ``key, y, x, c, v`` rows."""
    cut = rows.select(key, F.posexplode(cells).alias("i", "v"))
    return cut.select(
        key, F.expr(f"cast(i div {width * channels} as int)").alias("y"), F.expr(f"cast(i div {channels} % {width} as int)").alias("x"),
        (F.col("i") % channels).alias("c"), F.col("v").cast("double").alias("v"),
    )


def score_in_batches(df: DataFrame, scorer, schema: str) -> DataFrame:
    """Arrow batches to a user's model; ``scorer`` maps one pandas frame to one."""

    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)
