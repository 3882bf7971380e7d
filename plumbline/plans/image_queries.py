"""Image files made of the driver's tables, written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.catalog import register
from plumbline.session import importable, scratch, table
from plumbline.sources import images

c = F.col
FILES = "path string, content binary"


def kept(files: DataFrame) -> DataFrame:
    """The files as they come back from the shared folder."""
    files.write.parquet(path := scratch(files.sparkSession, "files"))
    return files.sparkSession.read.schema(FILES).parquet(path)


@register("depth_rasters", """
SELECT 'frame' || vec_id || '.png' AS path, (k - 1) % 8 AS u, (k - 1) // 8 AS v, greatest(0, floor((embedding[k]::DOUBLE + 3) * 10000))::INT AS value
FROM embeddings, range(1, 65) t(k)""")
def depth_rasters(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as an 8 by 8 depth raster of 16 bits, its rows under all five filters."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rasters = [images.put_png(np.array(v, np.uint16).reshape(8, 8), (0, 1, 2, 3, 4)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rasters, pa.binary())], names=["path", "content"])

    values = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.floor((x.cast("double") + 3) * 10000)).cast("int"))
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("frame"), c("vec_id").cast("string"), F.lit(".png")).alias("path"), values.alias("v"))
    return images.png_pixels(kept(rows.mapInArrow(run, FILES))).select("path", "u", "v", "value")


@register("photo_devices", """
WITH p AS (SELECT p_partkey // 5 AS capture, p_brand AS make, CASE WHEN p_size % 3 = 0 THEN upper(p_brand) || ' ' || p_type ELSE p_type END AS model, p_size % 7 = 0 AS bare, p_partkey % 5 < p_partkey // 5 % 4 AS shown FROM part),
d AS (SELECT DISTINCT capture, CASE WHEN bare OR NOT shown THEN NULL WHEN contains(lower(model), lower(make)) THEN model ELSE make || ' ' || model END AS own FROM p)
SELECT capture, CASE count(own) WHEN 0 THEN NULL WHEN 1 THEN min(own) || ' (EXIF; OS and capture app unknown)' ELSE 'Mixed camera models in photo EXIF: ' || string_agg(own, '; ' ORDER BY own) END AS device FROM d GROUP BY 1""")
def photo_devices(spark: SparkSession, sf: str) -> DataFrame:
    """The camera of each capture by its photos' tags: three kinds of file, both byte orders, some without tags."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            content = [images.put_photo(r["kind"], images.put_tags(r["make"], r["model"], r["order"]) if r["tagged"] else b"") for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    key, brand = c("p_partkey"), c("p_brand")
    capture = F.floor(key / 5)
    model = F.when(c("p_size") % 3 == 0, F.concat(F.upper(brand), F.lit(" "), c("p_type"))).otherwise(c("p_type"))
    tagged = (c("p_size") % 7 != 0) & (key % 5 < capture % 4)
    kind, order = F.element_at(F.array(*map(F.lit, ("jpeg", "png", "tiff"))), (key % 3 + 1).cast("int")), F.when(key % 2 == 0, "<").otherwise(">")
    rows = table(spark, sf, "part").select(F.concat_ws("/", capture.cast("string"), key.cast("string")).alias("path"), kind.alias("kind"), order.alias("order"), brand.alias("make"), model.alias("model"), tagged.alias("tagged"))
    found = images.cameras(kept(rows.mapInArrow(run, FILES)))
    return images.photo_device(found.withColumn("capture", F.split("path", "/")[0].cast("long")), "capture")
