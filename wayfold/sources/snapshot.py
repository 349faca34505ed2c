"""Tables kept with a manifest: read again only if version and fingerprint agree, replaced only when written whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


class Stale(Exception):
    """The snapshot was made by other code or from other inputs."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    """Names of the manifests, the newest last; numbers have leading zeros, so they sort as text."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(at)) if n.startswith("manifest-") and n.endswith(".json"))


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], fingerprint: str) -> None:
    """Tables go to a folder of their own, then a manifest of the next number that names it is moved into place; the newest counts.

    Whatever fails on the way, the manifests before it are untouched, so the old snapshot stays readable.
    """
    fresh = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{fresh}/{name}")
    manifest = json.dumps({"version": VERSION, "fingerprint": fingerprint, "data": fresh, "tables": sorted(tables)})
    held = _manifests(spark, folder)
    number = int(held[-1].removeprefix("manifest-").removesuffix(".json")) + 1 if held else 0
    fs, temporary = _fs(spark, f"{folder}/{fresh}/manifest.tmp")
    out = fs.create(temporary)
    out.write(bytearray(manifest.encode()))
    out.close()
    _, final = _fs(spark, f"{folder}/manifest-{number:012d}.json")
    if not fs.rename(temporary, final):
        raise OSError(f"{final} can't be made: another writer was first")


def load(spark: SparkSession, folder: str, fingerprint: str) -> dict[str, DataFrame]:
    held = _manifests(spark, folder)
    if not held:
        raise FileNotFoundError(f"{folder} holds no snapshot")
    text = spark.read.text(f"{folder}/{held[-1]}", wholetext=True).first()[0]
    m = json.loads(text)
    if m["version"] != VERSION or m["fingerprint"] != fingerprint:
        raise Stale(f"{folder}: version {m['version']}, fingerprint {m['fingerprint']}")
    return {name: spark.read.parquet(f"{folder}/{m['data']}/{name}") for name in m["tables"]}
