"""Pictures decoded in the JVM: JPEG, TIFF and what else its image library reads, by Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pictures(spark: SparkSession, folder: str, metadata: DataFrame | None = None) -> DataFrame:
    """(path, content) of all files below ``folder``, as ``features.decode`` reads them: a line with height, width, channels and orientation, then the pixels as stored.

    ``metadata`` (path, orientation) gives stored orientations, 1 without it. Files that aren't pictures, or broken ones, have empty contents, which fail to decode by themselves. Paths of
    the local file system are without scheme. An empty folder gives an empty table.
    """
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    rows = image.withColumn("path", F.regexp_replace("origin", "^file:/+", "/"))
    if metadata is None:
        rows = rows.withColumn("orientation", F.lit(1))
    else:
        rows = rows.join(metadata.select("path", F.col("orientation").cast("int").alias("orientation")).dropDuplicates(["path"]), "path", "left")
    head = F.encode(F.format_string("PIXELS %d %d %d %d\n", "height", "width", "nChannels", F.coalesce("orientation", F.lit(1))), "UTF-8")
    return rows.select("path", F.when((F.col("height") > 0) & (F.col("nChannels") > 0), F.concat(head, F.col("data"))).otherwise(F.lit(b"")).alias("content"))
