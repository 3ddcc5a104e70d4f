"""Digests of texts that are made of many rows, without putting a text together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_digests(rows: DataFrame, keys: list[str], order: str, text: str, head: str | None = None, sums: tuple[str, ...] = (), carried: tuple[str, ...] = ()) -> DataFrame:
    """keys, carried, sha256 and sums of each group of rows: the digest of head and the texts in order, joined by line feeds.

    Rows are dealt by the keys and sorted within their partitions; a task feeds one text after another into an incremental
    hash, so a group may be larger than any memory. Null texts are left out. head and carried are columns that are equal
    within a group (head is not null); sums are columns of whole numbers that are added up on the way.
    """
    given = rows.select(*keys, *carried, *[F.col(c).cast("long").alias(c) for c in sums], F.col(text).alias("_text"), (F.col(head) if head else F.lit(None).cast("string")).alias("_head"), F.col(order).alias("_order"))
    dealt = given.repartition(*keys).sortWithinPartitions(*keys, "_order").drop("_order")
    fields = {f.name: f for f in dealt.schema.fields}
    schema = T.StructType([*[fields[c] for c in (*keys, *carried)], T.StructField("sha256", T.StringType()), *[fields[c] for c in sums]])
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = digest = None
        begun, about, totals = False, {}, {}
        for batch in batches:
            got = {c: batch.column(c).to_pylist() for c in (*keys, *sums, "_text")}
            own = list(zip(*[got[c] for c in keys], strict=True))
            done, at = [], 0
            while at < len(own):
                end = at + 1
                while end < len(own) and own[end] == own[at]:
                    end += 1
                if digest is None or own[at] != group:
                    if digest is not None:
                        done.append(about | totals | {"sha256": digest.hexdigest()})
                    group, digest, begun, totals = own[at], hashlib.sha256(), False, dict.fromkeys(sums, 0)
                    about = {c: batch.column(c)[at].as_py() for c in (*keys, *carried)}
                    if head:
                        digest.update(batch.column("_head")[at].as_py().encode() + b"\n")
                texts = [t for t in got["_text"][at:end] if t is not None]
                if texts:
                    digest.update((b"\n" if begun else b"") + "\n".join(texts).encode())
                    begun = True
                for c in sums:
                    totals[c] += sum(v for v in got[c][at:end] if v is not None)
                at = end
            if done:
                yield pa.RecordBatch.from_pylist(done, made)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([about | totals | {"sha256": digest.hexdigest()}], made)

    return dealt.mapInArrow(run, schema)
