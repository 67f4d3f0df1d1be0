"""Replies of services, each paid for once.

A request is known by the hash of its kind and content. What the table at ``path`` has is not asked again; the rest goes out in
batches, several at a time from each task and again after a pause where a call fails. A task notes each batch's reply in a journal in the same
store before it goes on, so a task that is run again, or a run after one that died, asks only what is not noted. Replies are
appended to the table at the end of a wave, and the journal goes. A batch that fails for good, or whose replies are not as many as its requests, leaves
an error in its own rows and nothing in the table.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .pdf import _exists

Ask = Callable[[list[str]], list[str]]


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file:///" + uri[5:].lstrip("/") if uri.startswith("file:/") else uri)


class Journal:
    """Replies by batch, one small file each; written under another name first."""

    def __init__(self, uri: str):
        self.fs, self.at = _place(uri)

    def get(self, name: str) -> list | None:
        from pyarrow import fs

        if self.fs.get_file_info(f"{self.at}/{name}").type != fs.FileType.File:
            return None
        with self.fs.open_input_file(f"{self.at}/{name}") as f:
            return json.loads(f.read())

    def put(self, name: str, replies: list[str]) -> None:
        self.fs.create_dir(self.at, recursive=True)
        draft = f"{self.at}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(replies).encode())
        self.fs.move(draft, f"{self.at}/{name}")


class Replies:
    ROWS = "digest string, kind string, body string"

    def __init__(self, spark: SparkSession, path: str, batch: int = 1, concurrency: int = 8, attempts: int = 4, pause: float = 1.0, wave: int = 100_000, tasks: int = 64):
        self.spark, self.batch, self.concurrency, self.attempts, self.pause, self.wave, self.tasks = spark, batch, concurrency, attempts, pause, wave, tasks
        self.path = path if ":" in path else str(Path(path).absolute())

    def known(self, kind: str) -> DataFrame:
        rows = self.spark.read.schema(self.ROWS).parquet(f"{self.path}/rows") if _exists(self.spark, f"{self.path}/rows") else self.spark.createDataFrame([], self.ROWS)
        return rows.where(F.col("kind") == kind).select("digest", "body").dropDuplicates(["digest"])

    def of(self, df: DataFrame, request: str, kind: str, make_client: Callable[[], Ask]) -> DataFrame:
        """``df`` with ``reply`` and ``reply_error`` to its text column ``request``; equal requests are one."""
        asked = df.withColumn("__digest", F.sha2(F.concat(F.lit(kind + "\n"), F.coalesce(request, F.lit(""))), 256))
        wanted = asked.select(F.col("__digest").alias("digest"), F.coalesce(request, F.lit("")).alias("request")).dropDuplicates(["digest"]).join(self.known(kind), "digest", "left_anti")
        wanted = shared.write_table(wanted, "requests")
        failed = self._ask(wanted, wanted.count(), kind, make_client)
        shared.drop_table(wanted)
        replies = self.known(kind).select(F.col("digest").alias("__digest"), F.col("body").alias("reply"), F.lit(None).cast("string").alias("reply_error"))
        for f in failed:
            replies = replies.unionByName(f.select(F.col("digest").alias("__digest"), F.col("body").alias("reply"), F.col("error").alias("reply_error")))
        return asked.join(replies, "__digest", "left").select(*df.columns, "reply", "reply_error")

    def _ask(self, wanted: DataFrame, n: int, kind: str, make_client: Callable[[], Ask]) -> list[DataFrame]:
        journal = f"{self.path}/journal/{hashlib.sha256(kind.encode()).hexdigest()[:16]}"
        size, concurrency, attempts, pause = self.batch, self.concurrency, self.attempts, self.pause

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client, notes = make_client(), Journal(journal)

            def call(batch: pd.DataFrame) -> pd.DataFrame:
                name = hashlib.sha256("".join(batch["digest"]).encode()).hexdigest()
                made, error = notes.get(name), None
                for attempt in range(0 if made is not None else attempts):
                    if attempt:
                        time.sleep(pause * 2 ** (attempt - 1))
                    try:
                        made, error = [str(x) for x in client(batch["request"].tolist())], None
                        if len(made) != len(batch):
                            made, error = None, f"ValueError: {len(made)} replies to {len(batch)} requests"
                            continue
                        notes.put(name, made)
                        break
                    except Exception as e:  # any failure of the service belongs to its rows
                        error = f"{type(e).__name__}: {e}"
                return pd.DataFrame({"digest": batch["digest"].tolist(), "body": made or [None] * len(batch), "error": error})

            with ThreadPoolExecutor(concurrency) as pool:
                for frame in frames:
                    batches = [frame.iloc[at : at + size] for at in range(0, len(frame), size)]
                    yield from pool.map(call, batches)

        failed = []
        many = -(-n // self.wave)
        for k in range(many):
            wave = wanted.where(F.pmod(F.xxhash64("digest"), F.lit(many)) == k) if many > 1 else wanted
            tasks = max(1, min(self.tasks, -(-n // (many * size))))
            made = shared.write_table(wave.repartition(tasks, "digest").sortWithinPartitions("digest").mapInPandas(each, "digest string, body string, error string"), "replies")
            made.where("error is null").select("digest", F.lit(kind).alias("kind"), "body").write.mode("append").parquet(f"{self.path}/rows")
            failed.append(made.where("error is not null"))
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(journal)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return failed
