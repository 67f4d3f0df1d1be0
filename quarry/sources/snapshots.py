"""Snapshots of the index: immutable parts, and a manifest that is put in place last.

A part is one Parquet table of chunks with their vectors and term counts, one of postings, and one of the rows of older parts that
its documents replace. A manifest lists the parts of one version; readers take the highest version there is, so a write that
fails in between leaves what was there. Manifests are made by renaming a finished file to a name that must not
exist, so of two writers at a time one gets an error."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import grid, lexical

#: Blocks of a part, as a power of two: its number is above them.
PART_BITS = 48


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest manifest, or that of ``version``; empty if there is none."""
    known = versions(spark, path)
    if not known:
        return {}
    at = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{path}/manifest-{at:08d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, data: dict) -> None:
    fs, draft = _files(spark, f"{path}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(data, ensure_ascii=False, indent=2).encode()))
    out.close()
    final = _files(spark, f"{path}/manifest-{data['version']:08d}.json")[1]
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another write made version {data['version']} of {path}")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _gone(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame | None:
    own = [spark.read.schema(schemas.GONE).parquet(f"{path}/{p['name']}/gone") for p in parts if p["gone"]]
    return _union(own) if own else None


def stored(spark: SparkSession, path: str, data: dict) -> DataFrame:
    """The living rows of a manifest's parts, all columns."""
    rows = _union([spark.read.schema(schemas.STORED).parquet(f"{path}/{p['name']}/chunks") for p in data["parts"]])
    gone = _gone(spark, path, data["parts"])
    return rows if gone is None else rows.join(gone.select("block", "at"), ["block", "at"], "left_anti")


def write(chunks: DataFrame, path: str, metadata: dict, now: str, upsert: bool = False) -> dict:
    """``chunks`` (of ``schemas.CHUNKS``) as a part of the next version: the only one, or with ``upsert`` one more,
    whose documents replace those of the same doc_id; nothing else is written again."""
    spark = chunks.sparkSession
    data = manifest(spark, path)
    before = data["parts"] if upsert and data else []
    number = 1 + max((p["number"] for p in data.get("parts", [])), default=-1)
    name = f"part-{number:05d}-{uuid.uuid4().hex}"
    names = [f.name for f in schemas.CHUNKS.fields]
    counts = grid.term_counts(chunks.select(*names, F.col("text").alias("counted")), "counted")
    numbered = lexical.numbered(counts, number << PART_BITS).select([f.name for f in schemas.STORED.fields])
    numbered.write.option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{path}/{name}/chunks")
    rows = spark.read.schema(schemas.STORED).parquet(f"{path}/{name}/chunks")
    lexical.postings(rows).write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/{name}/postings")
    replaced = 0
    if before:
        held = stored(spark, path, {**data, "parts": before})
        old = held.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select([f.name for f in schemas.GONE.fields])
        old.write.parquet(f"{path}/{name}/gone")
        replaced = spark.read.schema(schemas.GONE).parquet(f"{path}/{name}/gone").count()
    total = sum(p["chunks"] - p["gone"] for p in before) + rows.count() - replaced
    full = {**metadata, "created_at": now, "chunk_count": total}
    part = {"name": name, "number": number, "chunks": rows.count(), "gone": replaced}
    _commit(spark, path, {"version": 1 + data.get("version", 0), "metadata": full, "parts": [*before, part]})
    return full


def keyword_index(spark: SparkSession, path: str, data: dict, key) -> lexical.KeywordIndex:
    """The postings of a manifest's parts; ``key`` makes the key of a row from its columns."""
    read = lambda p, kind: spark.read.parquet(f"{path}/{p['name']}/{kind}")
    rows = _union([spark.read.schema(schemas.STORED).parquet(f"{path}/{p['name']}/chunks") for p in data["parts"]])
    blocks = _union([read(p, "postings") for p in data["parts"]])
    return lexical.KeywordIndex.of(rows.select("block", "at", "dl", key.alias("key")), blocks, _gone(spark, path, data["parts"]))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep``, and parts that none of those lists. Not while an ingest runs."""
    known = versions(spark, path)
    held = {p["name"] for v in known[-keep:] for p in manifest(spark, path, v)["parts"]}
    fs, where = _files(spark, path)
    old = [s.getPath() for s in fs.listStatus(where)]
    old = [p for p in old if p.getName().startswith("part-") and p.getName() not in held or p.getName().startswith("draft-")]
    for v in known[:-keep]:
        fs.delete(_files(spark, f"{path}/manifest-{v:08d}.json")[1], False)
    for p in old:
        fs.delete(p, True)
    return [p.getName() for p in old]
