"""Embedders, and vector similarity."""

from __future__ import annotations

import hashlib
import json
import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import shared
from ..sources.replies import Replies

CACHE_TOKENS = 500_000
REMOTE_BATCH = 64


class Embedder(ABC):
    """Adds an ``embedding`` column (array<double>) to a table that has a text column."""

    model_name: str

    @abstractmethod
    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame: ...


def _bucket(token: str) -> int:
    """The digest's low byte says bucket and sign (for up to 256 dimensions): big-endian
    value modulo the dimensions, and its lowest bit."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")


class LocalHashEmbedder(Embedder):
    """Signed feature hashing of tokens, with multiplicity, scaled to unit length; a text
    without tokens is the zero vector. Tokens are cut on the JVM side; only hashing runs in Python, with
    no shuffle."""

    def __init__(self, dimensions: int = 256):
        self.dimensions, self.model_name = dimensions, f"local-hash-{dimensions}"

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        dims = self.dimensions

        @F.arrow_udf("array<double>")
        def hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, int] = {}
            for column in columns:
                coded = column.flatten().dictionary_encode()
                if len(known) > CACHE_TOKENS:
                    known.clear()
                value = np.array([known.get(t) if t in known else known.setdefault(t, _bucket(t)) for t in coded.dictionary.to_pylist()], np.uint64)
                bucket, sign = (value % np.uint64(dims)).astype(np.int64), np.where(value & np.uint64(1), -1.0, 1.0)
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                token = coded.indices.to_numpy(zero_copy_only=False)
                made = np.bincount(np.repeat(np.arange(len(column)), size) * dims + bucket[token], sign[token], len(column) * dims).astype(np.float64).reshape(-1, dims)
                length = np.sqrt((made * made).sum(1, keepdims=True))
                made = np.divide(made, length, out=made, where=length > 0)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * dims, pa.int32()), pa.array(made.ravel()))

        return df.withColumn(out, hashed(tx.tokenize(F.col(text))))


class NativeHashEmbedder(Embedder):
    """The same construction on md5, which the JVM has: built-in expressions only, one small
    aggregation. ``sparse`` gives (key, bucket, weight) rows before scaling."""

    def __init__(self, dimensions: int = 256):
        if dimensions != 256:
            raise ValueError("the native embedder has 256 dimensions")
        self.dimensions, self.model_name = dimensions, "native-md5-256"

    def sparse(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        tokens = df.select(key, F.explode(tx.tokenize(F.col(text))).alias("token"))
        bucket = F.conv(F.right(F.md5("token"), F.lit(2)), 16, 10).cast("int")
        return tokens.groupBy(key, bucket.alias("bucket")).agg(F.sum(F.when(bucket % 2 == 1, -1).otherwise(1)).alias("weight"))

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        buckets = F.transform(tx.tokenize(F.col(text)), lambda t: F.conv(F.right(F.md5(t), F.lit(2)), 16, 10).cast("int"))
        signed = F.transform(
            F.sequence(F.lit(0), F.lit(255)),
            lambda b: F.size(F.filter("__b", lambda x: x == b)).cast("double") * F.when(b % 2 == 1, -1.0).otherwise(1.0),
        )
        raw = df.withColumn("__b", buckets).withColumn("__v", signed).withColumn("__n", norm(F.col("__v")))
        return raw.withColumn(out, F.when(F.col("__n") > 0, F.transform("__v", lambda x: x / F.col("__n"))).otherwise(F.col("__v"))).drop("__b", "__v", "__n")


class RemoteEmbedder(Embedder):
    """Vectors from a service. ``make_client`` runs once for each Python worker and returns a
    function from a list of at most 64 texts to (index, vector) items, in any order, one for each text. With ``replies``,
    vectors come from that store and what it lacks is asked for once; texts that could not be
    embedded end the call, after the others have been stored."""

    def __init__(self, model_name: str, make_client: Callable[[], Callable[[list[str]], list[tuple[int, list[float]]]]] | None = None, replies: Replies | None = None):
        if make_client is None:
            if not os.getenv("OPENAI_API_KEY"):
                raise RuntimeError("no API key: set OPENAI_API_KEY, or use the local embedder for an offline smoke test")
            make_client = _openai_embeddings(model_name)
        self.model_name, self._make_client, self.replies = model_name, make_client, replies

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        make_client = self._make_client

        def vectors(ask: Callable, texts: list[str]) -> list[list[float]]:
            items = sorted(ask(texts), key=lambda x: x[0])
            if [i for i, _ in items] != list(range(len(texts))):
                raise ValueError(f"{len(items)} vectors for {len(texts)} texts")
            return [list(map(float, vector)) for _, vector in items]

        if self.replies is not None:

            def listed() -> Callable[[list[str]], list[str]]:
                ask = make_client()
                return lambda texts: [json.dumps(v) for v in vectors(ask, texts)]

            made = shared.write_table(self.replies.of(df, text, f"embedding:{self.model_name}", listed), "embedded")
            bad = made.where("reply_error is not null").agg(F.count("*"), F.first("reply_error")).first()
            if bad[0]:
                raise RuntimeError(f"{bad[0]} texts could not be embedded: {bad[1]}")
            return made.withColumn(out, F.from_json("reply", "array<double>")).select(*[c for c in df.columns if c != out], out)

        @F.pandas_udf("array<double>")
        def remote(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ask = make_client()
            for column in columns:
                rows: list[list[float]] = []
                for at in range(0, len(column), REMOTE_BATCH):
                    rows += vectors(ask, column.iloc[at : at + REMOTE_BATCH].fillna("").tolist())
                yield pd.Series(rows, index=column.index)

        return df.withColumn(out, remote(F.col(text)))


def _openai_embeddings(model_name: str):
    def make():
        from openai import OpenAI

        client = OpenAI()
        return lambda texts: [(x.index, x.embedding) for x in client.embeddings.create(model=model_name, input=texts).data]

    return make


PROVIDERS: dict[str, Callable[[str, Replies | None], Embedder]] = {
    "local": lambda model, replies: LocalHashEmbedder(),
    "native": lambda model, replies: NativeHashEmbedder(),
    "openai": lambda model, replies: RemoteEmbedder(model, replies=replies),
}


def make_embedder(provider: str, model_name: str = "", replies: Replies | None = None) -> Embedder:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown embedding provider: {provider}")
    return PROVIDERS[provider](model_name, replies)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """0 where either is missing or empty, lengths differ, or a norm is zero."""
    a_norm, b_norm = a_norm if a_norm is not None else norm(a), b_norm if b_norm is not None else norm(b)
    comparable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.coalesce(F.when(comparable & (a_norm > 0) & (b_norm > 0), F.try_divide(dot(a, b), a_norm * b_norm)), F.lit(0.0))
