"""Ed25519 signatures over DataFrames, checked in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from chunklake.functions.hashing import ed25519_verify


def verified(df: DataFrame, key: str, message: Column, sig: str) -> DataFrame:
    """df with `ok`: whether sig (128 hex digits) is that of the message (binary) by the key (64 hex digits, letter case not counting).

    Null, malformed and forged signatures, keys and messages are false. Other columns, also one called ok, which is replaced, don't matter;
    repeated rows stay repeated. One check costs some milliseconds of a core, so anti-join known signatures away before."""
    rest = [c for c in df.columns if c != "ok"]
    one = df.select(*[df[f"`{c}`"] for c in rest], message.alias("_message"))
    shape = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "ok boolean"])
    k, s = rest.index(key), rest.index(sig)

    def check(public: str | None, text: bytes | None, signature: str | None) -> bool:
        try:
            return text is not None and ed25519_verify(bytes.fromhex(public or ""), text, bytes.fromhex(signature or ""))
        except ValueError:
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(len(rest))]
            ok = [check(*x) for x in zip(cols[k].to_pylist(), b.column(len(rest)).to_pylist(), cols[s].to_pylist())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ok, pa.bool_())], [*rest, "ok"])

    return one.mapInArrow(run, schema=shape)
