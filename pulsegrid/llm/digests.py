"""Digests of long ordered groups, read as a sorted stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY = hashlib.sha256().hexdigest()


def joined_sha256(df: DataFrame, keys: list[str], order: list[str], piece: str, separator: str, out: str) -> DataFrame:
    """(keys, ``out``): for each key the SHA-256, in lowercase hex, of its pieces in order with ``separator`` between them.

    A task sorts its keys' rows, with spill, and hashes them as they come, so no group sits in memory however many rows it has.
    Keys and pieces must not be null.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(out, T.StringType())])
    between = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list) -> pa.RecordBatch:
            arrow = [pa.array([r[i] for r in rows], type_) for i, type_ in enumerate(types)]
            return pa.RecordBatch.from_arrays([*arrow, pa.array([r[-1] for r in rows], pa.string())], [*keys, out])

        now, state, types = None, None, None
        for batch in batches:
            types, rows = [batch.column(k).type for k in keys], []
            for *key, text in zip(*(batch.column(k).to_pylist() for k in keys), batch.column(piece).to_pylist(), strict=True):
                if key == now:
                    state.update(between)
                else:
                    if now is not None:
                        rows.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(text.encode())
            if rows:
                yield told(rows)
        if now is not None:
            yield told([(*now, state.hexdigest())])

    return df.select(*keys, *order, F.col(piece).cast("string").alias(piece)).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
