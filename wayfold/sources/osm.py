"""Street extracts in PBF: nodes, ways and relations as rows, and ways as segments.

A file is a task: cut large extracts into files first, as blocks can't be found without reading.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wire

ELEMENTS = "kind string, id long, lat double, lon double, refs array<long>, tags map<string,string>"
_SCHEMA = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])


def _blocks(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        header = wire.message(data[at + 4 : at + 4 + size])
        at += 4 + size
        blob = wire.message(data[at : at + header[3][0]])
        at += header[3][0]
        if header[1][0] == b"OSMData":
            yield blob[1][0] if 1 in blob else zlib.decompress(blob[3][0])


def _running(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += wire.zigzag(v)
        out.append(total)
    return out


def elements(data: bytes) -> Iterator[dict]:
    for raw in _blocks(data):
        block = wire.message(raw)
        strings = [wire.text(s) for s in wire.message(block[1][0]).get(1, [])]
        unit, lat0, lon0 = block.get(17, [100])[0], block.get(19, [0])[0], block.get(20, [0])[0]
        place = lambda offset, v: 1e-9 * (offset + unit * v)
        tags = lambda m: [(strings[k], strings[v]) for k, v in zip(wire.packed(m.get(2, [b""])[0]), wire.packed(m.get(3, [b""])[0]), strict=True)]
        for group in map(wire.message, block.get(2, [])):
            for m in map(wire.message, group.get(2, [])):
                ids, lats, lons = (_running(wire.packed(m.get(n, [b""])[0])) for n in (1, 8, 9))
                words = iter(wire.packed(m.get(10, [b""])[0]))
                for i, y, x in zip(ids, lats, lons, strict=True):
                    own = []
                    while key := next(words, 0):
                        own.append((strings[key], strings[next(words)]))
                    yield {"kind": "node", "id": i, "lat": place(lat0, y), "lon": place(lon0, x), "refs": None, "tags": own}
            for number, kind, refs in ((3, "way", 8), (4, "relation", 9)):
                for m in map(wire.message, group.get(number, [])):
                    yield {"kind": kind, "id": m[1][0], "lat": None, "lon": None, "refs": _running(wire.packed(m.get(refs, [b""])[0])), "tags": tags(m)}


def read(files: DataFrame) -> DataFrame:
    """Elements of the extracts in a column content, as of the format binaryFile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for row in elements(content):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.select("content").mapInArrow(run, ELEMENTS)


def segments(found: DataFrame) -> DataFrame:
    """way, seq, a, b, lat1, lon1, lat2, lon2, tags: consecutive node pairs of ways."""
    order = Window.partitionBy("id").orderBy("seq")
    pairs = found.where("kind = 'way'").select("id", "tags", F.posexplode("refs").alias("seq", "a")).withColumn("b", F.lead("a").over(order)).where("b is not null")
    at = lambda c, y, x: found.where("kind = 'node'").select(F.col("id").alias(c), F.col("lat").alias(y), F.col("lon").alias(x))
    return pairs.withColumnRenamed("id", "way").join(at("a", "lat1", "lon1"), "a").join(at("b", "lat2", "lon2"), "b")


def cycle_route_ways(found: DataFrame) -> DataFrame:
    """way: members of bicycle and mountain-bike route relations."""
    routes = found.where((F.col("kind") == "relation") & F.col("tags")["type"].isin("route", "superroute") & F.col("tags")["route"].isin("bicycle", "mtb"))
    return routes.select(F.explode("refs").alias("way")).distinct()


def rail_ways(found: DataFrame) -> DataFrame:
    return segments(found.where((F.col("kind") == "node") | F.col("tags")["railway"].isin("rail", "light_rail")))
