"""Bloom filters of files' keys as a side table: (file, part, filter)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.codec import BloomPolicy, FilterPolicy

#: Keys of one filter; a file with more has several, dealt by a hash of the key.
PART_KEYS = 100_000


def _bytes(key) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


def build(keys: DataFrame, bits: int = 10, part_keys: int = PART_KEYS, policy: FilterPolicy | None = None) -> DataFrame:
    """Filters of (key, file), by Bloom's or another policy. Parts of a file are dealt by the key's hash, so
    a file with very many keys is built in as many tasks as it has parts."""
    sizes = keys.groupBy("file").agg(F.ceil(F.count("*") / part_keys).cast("int").alias("parts"))
    dealt = keys.join(sizes, "file").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    policy = policy or BloomPolicy(bits)

    def made(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file": [batch.file.iloc[0]], "part": [batch.part.iloc[0]], "parts": [batch.parts.iloc[0]], "filter": [policy.create(_bytes(k) for k in batch.key)]})

    kind = keys.schema["file"].dataType.simpleString()
    return dealt.groupBy("file", "part").applyInPandas(made, f"file {kind}, part int, parts int, filter binary")


def probe(filters: DataFrame, probes: DataFrame, policy: FilterPolicy | None = None) -> DataFrame:
    """``probes`` (key, file, ...) with ``may_match``. Bloom filters are tested
    for all keys of a batch that share one at once."""
    policy = policy or BloomPolicy()
    sizes = filters.groupBy("file").agg(F.max("parts").alias("parts"))
    placed = probes.join(sizes, "file").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    joined = placed.join(filters.select("file", "part", "filter"), ["file", "part"])
    columns = probes.columns

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = getattr(policy, "may_match_many", lambda keys, f: [policy.may_match(k, f) for k in keys])
        for b in batches:
            good = pd.Series(False, index=b.index)
            for filter_, rows in b.groupby(b["filter"].map(bytes), sort=False).groups.items():
                good[rows] = many([_bytes(k) for k in b.key[rows]], filter_)
            yield b[columns].assign(may_match=good)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in probes.schema.fields)
    return joined.mapInPandas(tested, f"{fields}, may_match boolean")
