"""Sinks: GeoJSON, CSV reports, keyed JSON, and configurations."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.geometry import shapes


def features(df: DataFrame, geom: str = "geom") -> DataFrame:
    """(value): a GeoJSON feature as text for each row, with all other columns as properties."""
    properties = [c for c in df.columns if c != geom]

    def run(batches):
        for b in batches:
            out = []
            for text, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                polygons = [[[*r.tolist(), r[0].tolist()] for r in p] for p in shapes.from_wkb(g)] if g is not None else []
                shape = None if not polygons else {"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons}
                out.append(json.dumps({"type": "Feature", "properties": json.loads(text), "geometry": shape}, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    ready = df.select(F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}).alias("p"), F.col(geom).alias("g"))
    return ready.mapInArrow(run, "value string")


def write_geojson(df: DataFrame, path: str, geom: str = "geom") -> None:
    """One feature a line, in as many files as df has partitions; collection() makes one document of a small layer."""
    features(df, geom).write.mode("overwrite").text(path)


def collection(df: DataFrame, geom: str = "geom") -> str:
    """A layer as one GeoJSON document, for exports whose size is that of one district."""
    return '{"type": "FeatureCollection", "features": [' + ",\n".join(r.value for r in features(df, geom).toLocalIterator()) + "]}"


def write_report(df: DataFrame, path: str, order: list[str] = ()) -> None:
    """A CSV report with a header."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def keyed_json(df: DataFrame, key: str) -> DataFrame:
    """(value): a "key": {...} member as text for each row."""
    rest = [c for c in df.columns if c != key]
    body = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    name = F.regexp_replace(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r'^\{"k":(.*)\}$', "$1")
    return df.select(F.concat(name, F.lit(": "), body).alias("value"))


def write_configs(configs: DataFrame, path: str, force: bool = False) -> None:
    """Configurations as JSON, one a line and code; codes that are there already stay unless forced."""
    spark = configs.sparkSession
    if force:
        configs.write.mode("overwrite").json(path)
        return
    try:
        known = spark.read.json(path).select("admin_code")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        configs.write.json(path)
        return
    configs.join(known, "admin_code", "left_anti").write.mode("append").json(path)
