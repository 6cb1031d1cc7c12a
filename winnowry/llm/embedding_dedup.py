"""Near-duplicate embeddings by Euclidean p-stable hashing, checked by exact cosine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import components, mix64, table

WIDTH, BLOCK = 1.26, 512


def miss(width: float, distance: float) -> float:
    """Chance that one quantised projection puts two points at that distance in one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float, recall: float = 0.995) -> tuple[int, int]:
    """(projections a table, tables): cells of unrelated vectors hold about 64, pairs at the bound are found with that recall."""
    near, far = miss(WIDTH, math.sqrt(2 - 2 * cosine)), miss(WIDTH, math.sqrt(2))
    k = max(6, math.ceil(math.log(max(n, 64) / 64) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def unit(rows: list) -> np.ndarray:
    """Vectors of length one; each is first divided by its largest component, as squares of huge or tiny ones can't be held."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def hasher(k: int, tables: int, seed: int):
    def batches(stream):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in stream:
            vectors = batch.column("v").to_pylist()
            keys = np.zeros((len(vectors), tables), np.int64)
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                if d not in planes:
                    rng = np.random.default_rng([seed, int(d)])
                    planes[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, WIDTH, tables * k)
                at = np.flatnonzero(sizes == d)
                a, b = planes[d]
                cells = np.floor((unit([vectors[i] for i in at]) @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(at), tables, k)
                h = np.full((len(at), tables), np.uint64(d))
                with np.errstate(over="ignore"):
                    for j in range(k):
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
                keys[at] = h.view(np.int64)
            arrays = [batch.column("rep"), batch.column("copies"), batch.column("v"), pa.array(list(keys), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "copies", "v", "keys"])

    return batches


def comparer(cosine: float):
    def work(t: pa.Table):
        side = np.asarray(t.column("side"))
        rep, copies = np.asarray(t.column("rep")), np.asarray(t.column("copies"))
        n, number = len(rep), int(t.column("tab")[0].as_py())
        vectors = t.column("v").to_pylist()
        if len({len(v) for v in vectors}) > 1:
            return None  # cells hash the dimension too: different ones only meet by a collision of hashes
        x = unit(vectors)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        near = x[left] @ x[right].T >= cosine
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        ok = (i < j) if side[0] == 2 else np.ones(len(i), bool)
        i, j = i[ok], j[ok]
        if number and len(i):
            keys = np.asarray(t.column("keys").combine_chunks().values).reshape(n, -1)[:, :number]
            first = np.concatenate([~(keys[i[a : a + 100_000]] == keys[j[a : a + 100_000]]).any(1) for a in range(0, len(i), 100_000)])
            i, j = i[first], j[first]  # a pair counts in the first table where it meets
        if not len(i):
            return None
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        low = rep.copy()
        while True:  # lowest reachable within the block
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at].astype(np.int64)), pa.array(low[at])], ["rep", "links", "low"])

    return work


def dedup(vectors: DataFrame, cosine: float = 0.95, seed: int = 11) -> DataFrame:
    """One row a vector: n_links (others with at least that cosine), component_id, kept.

    Equal vectors are compared once, by their smallest vec_id, and counted as often as they
    occur. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. A repeated vec_id is a vector of its own that shares the id. Vectors of different
    length don't link. Other columns are dropped; an empty table gives no row.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fine", fine)
    # -0.0 and 0.0 are the same number
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v", F.lit(1)))
    good = rows.where("fine")
    classes = table(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    k, tables = parameters(classes.count(), cosine)
    hashed = table(classes.select("rep", "copies", "v").mapInArrow(hasher(k, tables, seed), "rep bigint, copies bigint, v array<double>, keys array<bigint>"), "hashed")
    members = hashed.select("rep", "copies", F.transform("v", lambda x: x.cast("float")).alias("f"), "v", "keys", F.posexplode("keys").alias("tab", "key"))
    single = hashed.where(~F.forall("v", lambda x: x.cast("float").cast("double") == x)).isEmpty()
    members = members.withColumn("v", F.col("f")).drop("f") if single else members.drop("f")
    spread = blocks.spread(members, ["tab", "key"], "rep", BLOCK)
    found = table(blocks.each(spread, ["tab", "key"], comparer(cosine), "rep bigint, links bigint, low bigint"), "links")
    comps = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    summary = classes.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    summary = summary.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("fine"))
    out = rows.select("vec_id", "h1", "h2", "fine").join(summary, ["h1", "h2", "fine"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
