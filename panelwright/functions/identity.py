"""Content identities: canonical JSON, hashes over it, MinHash signatures, group ids, composite keys."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Permutations of a signature and their modulus.
PERMUTATIONS, MODULUS = 128, (1 << 61) - 1


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with struct fields and map keys in order of their names, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))))
    return value


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Compact JSON of the columns with sorted keys; nulls are written."""
    kind = T.StructType([df.schema[c] for c in columns])
    return F.to_json(canonical(F.struct(*[F.col(c) for c in columns]), kind), {"ignoreNullFields": "false"})


def config_hash(df: DataFrame, excludes: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical JSON of a row without the excluded columns."""
    return F.sha2(canonical_json(df, [c for c in df.columns if c not in excludes]), 256)


def support_id(df: DataFrame, columns: list[str], prefix: str = "sup-", digits: int = 20) -> Column:
    """A content-addressed id of a record."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(df, columns), 256), 1, digits))


def composite_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def mint_run_id(started: Column, entropy: Column) -> Column:
    """A UTC stamp and the first four hex digits of the entropy's hash."""
    return F.concat_ws("-", F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), F.substring(F.md5(entropy), 1, 4))


def _keyed(data: bytes, key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=key).digest(), "big")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 for values below it, in limbs of 31 bits: 2^61 counts as 1."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & np.uint64((1 << 31) - 1), b >> np.uint64(31), b & np.uint64((1 << 31) - 1)
    middle = a1 * b0 + a0 * b1
    total = ((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    return _modulo(total)


def _modulo(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(MODULUS)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(MODULUS), x - np.uint64(MODULUS), x)


class MinHash:
    """Seeded signatures: the least of a h + b modulo 2^61 - 1 over a set's hashes, for each of the permutations."""

    def __init__(self, seed: str):
        self.key = hashlib.blake2b(seed.encode(), digest_size=32).digest()
        self.a = np.array([_keyed(f"a:{i}".encode(), self.key) % (MODULUS - 1) + 1 for i in range(PERMUTATIONS)], np.uint64)
        self.b = np.array([_keyed(f"b:{i}".encode(), self.key) % MODULUS for i in range(PERMUTATIONS)], np.uint64)

    def signature(self, items: list[str]) -> list[int] | None:
        """None for an empty set."""
        if not items:
            return None
        least = np.full(PERMUTATIONS, MODULUS, np.uint64)
        hashes = np.array([_keyed(s.encode(), self.key) % MODULUS for s in items], np.uint64)
        for at in range(0, len(hashes), 4096):  # a bounded table at a time
            part = hashes[at : at + 4096, None]
            least = np.minimum(least, _modulo(_times(self.a[None], part) + self.b[None]).min(0))
        return [int(x) for x in least]


def signatures(sets: DataFrame, seed: str, key: str = "key", items: str = "items") -> DataFrame:
    """(key, signature array<long>, digest): MinHash of each set of strings and a digest of it; null for empty sets.

    The keyed hash is none of Spark's, so this runs in Arrow batches.
    """
    rows = sets.select(F.col(key).alias("key"), F.col(items).alias("items"))

    def run(batches):
        made = MinHash(seed)
        for batch in batches:
            found = [made.signature(x or []) for x in batch.column(1).to_pylist()]
            digests = [None if s is None else hashlib.blake2b(b"".join(v.to_bytes(8, "big") for v in s), digest_size=16).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(digests, pa.string())], ["key", "signature", "digest"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, signature array<long>, digest string")


def group_ids(members: DataFrame, version: str, prefix: str = "sg-", scope: str = "scope", group: str = "group", member: str = "member") -> DataFrame:
    """(scope, group, group_id): the prefix and a 10-byte digest of [version, scope, sorted members]; it changes with the members."""
    rows = members.groupBy(scope, group).agg(F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("members")).select(F.col(scope).alias("scope"), F.col(group).alias("group"), "members")

    def run(batches):
        for batch in batches:
            ids = [prefix + hashlib.blake2b(json.dumps([version, str(s), m], separators=(",", ":")).encode("ascii"), digest_size=10).hexdigest() for s, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids)], ["scope", "group", "group_id"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("scope", "group")]
    return rows.mapInArrow(run, f"scope {kinds[0]}, `group` {kinds[1]}, group_id string")
