"""Groups compared in blocks: a group's members are split over blocks, and each pair of blocks is one unit of work.

No task holds more than two blocks of a group, no pair is emitted, and no member is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(members: DataFrame, group: list[str], member: str, block: int) -> DataFrame:
    """One row for each pair of blocks (part, side) that a member of a group of two or more belongs to.

    side is 0 or 1 in a pair of different blocks, 2 where the block is compared with itself.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = members.join(sizes, group).withColumn("_m", F.ceil(F.col("_n") / block).cast("int"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(member, F.lit("block")), F.col("_m")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    part = F.least("_b", "_o") * F.col("_m") + F.greatest("_b", "_o")
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return rows.select("*", part.cast("bigint").alias("part"), side.cast("int").alias("side")).drop("_n", "_m", "_b", "_o")


def each(rows: DataFrame, group: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs work over the rows of each (group, part); its results may come from many groups in one task."""
    keys = [*group, "part"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in stream:
            if not len(batch):
                continue
            columns = [np.asarray(batch.column(k)) for k in keys]
            new = np.zeros(len(batch), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = tuple(c[0] for c in columns)
            starts = np.flatnonzero(new)
            if held and first != last:
                yield from done(held)
                held = []
            a = 0
            for b in [*starts.tolist(), len(batch)]:
                if a:
                    yield from done(held)
                    held = []
                held.append(batch.slice(a, b - a))
                a = b
            last = tuple(c[-1] for c in columns)
        if held:
            yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = work(pa.Table.from_batches(held).combine_chunks())
        if got is not None:
            yield got

    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)


class Union:
    """Union-find over 0..n-1; the smallest number is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
