"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified candidates.

A vector is rotated by three rounds of random signs and the fast Hadamard transform; its hash is the axis, with sign,
of the largest coordinate. HASHES hashes make a table's key and there are TABLES tables. A vector is indexed under its
own keys and asks its own and PROBES - 1 further keys of each table, those where one hash takes its second-best axis.
Candidates are verified by cosine in double precision.

No pair leaves a task as a row. Buckets that cannot hold a pair are dropped by key alone; a bucket of more than BLOCK
vectors is cut into blocks by hash and every pair of blocks is a task's work of bounded memory. A pair that meets in
several buckets is counted in the first of them, which both vectors' keys tell. A group returns for each vector how
many others it links with and the smallest id of its part, so components come from at most one link for each vector
and group. Equal vectors are one class with a count, so exact copies are never compared with one another.

Edge cases: null or empty vectors, zero vectors and vectors with null or non-finite components have no links and are
their own component; vectors of other lengths than the first are compared among their own length; repeated ids are
separate vectors for n_links and keep their rows, and where they lie in different components each row has its own; null
ids link and are counted like any, have a null component, are not kept and are no component's smallest id; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packreview.llm.common import components, materialise, reach_workers, table

THRESHOLD, TABLES, HASHES, PROBES, BLOCK, SEED = 0.95, 10, 3, 4, 512, 23


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def keys_of(v: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """int64[rows, tables, probes]: the keys that each row asks; the first of a table is its own."""
    dim = v.shape[1]
    n = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((len(v), n))
    x[:, :dim] = v
    out = np.zeros((len(v), tables, probes), np.int64)
    for t in range(tables):
        axes, drops = [], []
        for k in range(hashes):
            signs = np.random.default_rng([seed, t, k]).choice([-1.0, 1.0], (3, n))
            y = x
            for s in signs:
                y = hadamard(y * s)
            order = np.argsort(-np.abs(y), axis=1)[:, :2]
            value = np.take_along_axis(y, order, 1)
            axes.append(order * 2 + (value < 0))
            drops.append(np.abs(value[:, 0]) - np.abs(value[:, 1]))
        best, second = np.stack(axes)[:, :, 0].T, np.stack(axes)[:, :, 1].T
        cheap = np.argsort(np.stack(drops).T, axis=1)  # hashes in the order of what a probe of them gives up
        for p in range(probes):
            pick = best.copy()
            if p:
                at = cheap[:, min(p - 1, hashes - 1)]
                pick[np.arange(len(v)), at] = second[np.arange(len(v)), at]
            key = np.full(len(v), t, np.int64)
            for k in range(hashes):
                key = key * (2 * n) + pick[:, k]
            out[:, t, p] = key
    return out


def _keys(batches):
    for batch in batches:
        col = batch.column(1)
        size = np.asarray(pc.list_value_length(col))
        flat, ends = np.asarray(col.flatten(), np.float64), np.cumsum(size)
        asks = np.zeros((batch.num_rows, TABLES * PROBES), np.int64)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            v = flat[(ends[rows] - d)[:, None] + np.arange(d)]
            v = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)
            asks[rows] = keys_of(v).reshape(len(rows), -1) * 4099 + d
        asks = pa.FixedSizeListArray.from_arrays(pa.array(asks.reshape(-1)), TABLES * PROBES).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, asks], names=["rep", "v", "copies", "low", "asks"])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows over links a-b."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _linked(group: pa.Table, threshold: float) -> dict[str, np.ndarray]:
    """Links counted in a run of whole groups sorted by (key, bi, bj)."""
    g = {c: np.asarray(group.column(c)) for c in ("key", "bi", "bj", "block", "rep", "copies")}
    n = group.num_rows
    new = np.ones(n, bool)
    new[1:] = (g["key"][1:] != g["key"][:-1]) | (g["bi"][1:] != g["bi"][:-1]) | (g["bj"][1:] != g["bj"][:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    asks = np.asarray(group.column("asks").combine_chunks().flatten()).reshape(n, TABLES, PROBES)
    col = group.column("v").combine_chunks()
    size = np.asarray(pc.list_value_length(col))
    v = np.zeros((n, size.max()))
    flat = np.asarray(col.flatten(), np.float64)
    v[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    v /= np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    left, right = [], []
    for a, b in zip(start, end, strict=True):
        if b - a < 2:
            continue
        cos = v[a:b] @ v[a:b].T if b - a > 2 else None
        if cos is None:
            pairs = (np.array([a]), np.array([a + 1])) if v[a] @ v[a + 1] >= threshold else None
        else:
            i, j = np.nonzero(np.triu(cos >= threshold, 1))
            pairs = (i + a, j + a) if len(i) else None
        if pairs:
            left.append(pairs[0])
            right.append(pairs[1])
    if not left:
        return {"rep": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)}
    i, j = np.concatenate(left), np.concatenate(right)
    keep = np.ones(len(i), bool)
    for c in range(0, len(i), 20_000):  # where a pair counts: the first table where one asks the other's own key
        x, y = i[c : c + 20_000], j[c : c + 20_000]
        x, y = np.where(g["rep"][x] < g["rep"][y], x, y), np.where(g["rep"][x] < g["rep"][y], y, x)
        by_x = (asks[y] == asks[x][:, :, :1]).any(axis=2)  # y asks x's own key
        by_y = (asks[x] == asks[y][:, :, :1]).any(axis=2)
        t = np.argmax(by_x | by_y, axis=1)
        r = np.arange(len(x))
        key = np.where(by_x[r, t], asks[x, t, 0], asks[y, t, 0])
        ok = (by_x | by_y).any(axis=1) & (key == g["key"][x])
        # two blocks meet in the task of both; a block meets itself in the task of its own
        bx, by = g["block"][x], g["block"][y]
        ok &= (np.minimum(bx, by) == g["bi"][x]) & (np.maximum(bx, by) == g["bj"][x])
        keep[c : c + 20_000] = ok
    i, j = i[keep], j[keep]
    low = _labels(n, i, j)
    touched = np.unique(np.concatenate([i, j]))
    links = np.bincount(i, g["copies"][j], n) + np.bincount(j, g["copies"][i], n)
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, low[touched], g["rep"][touched])
    return {"rep": g["rep"][touched], "n": links[touched].astype(np.int64), "low": smallest[low[touched]]}


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each row."""
    spark = vectors.sparkSession
    reach_workers(spark)
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    good = F.when(F.col("fine"), F.xxhash64("v"))
    classes = rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # a class's number is its own, as ids may be repeated or null; the table that is written fixes it
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "v", "copies", "low")
    schema = StructType.fromDDL("rep long, v array<double>, copies long, low long, asks array<long>")
    classes = materialise(classes.mapInArrow(_keys, schema), "vector_classes")
    place = F.posexplode("asks").alias("p", "key")
    cells = classes.select("rep", place).select("key", "rep", (F.col("p") % PROBES == 0).alias("own")).distinct()
    sizes = cells.groupBy("key").agg(F.count_distinct("rep").alias("size"), F.max("own").alias("owned")).where("size > 1 and owned")
    sizes = sizes.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    cells = cells.groupBy("key", "rep").agg(F.max("own").alias("own")).join(sizes, "key")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = cells.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", "rep", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    work = cells.join(classes.drop("low"), "rep").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table):
            got = _linked(t, threshold)
            return pa.RecordBatch.from_arrays([pa.array(got[c], pa.int64()) for c in ("rep", "n", "low")], names=["rep", "n", "low"])

        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                edge = np.ones(part.num_rows, bool)
                for c in ("key", "bi", "bj"):
                    x = np.asarray(part.column(part.schema.get_field_index(c)))
                    same = np.ones(part.num_rows, bool)
                    same[:-1] = x[1:] == x[:-1]
                    edge = same if c == "key" else edge & same
                ends = np.flatnonzero(~edge)
                if len(ends):  # the last group of the part may go on in the next one
                    cut = int(ends[-1]) + 1
                    yield out(pa.Table.from_batches([*held, part.slice(0, cut)]))
                    held = [part.slice(cut)]
                else:
                    held.append(part)
                    last = [np.asarray(held[0].column(held[0].schema.get_field_index(c)))[0] for c in ("key", "bi", "bj")]
                    here = [np.asarray(part.column(part.schema.get_field_index(c)))[0] for c in ("key", "bi", "bj")]
                    if last != here and len(held) > 1:
                        yield out(pa.Table.from_batches(held[:-1]))
                        held = [part]
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    found = materialise(work.mapInArrow(run, "rep long, n long, low long"), "vector_links")
    comp = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    comp = materialise(comp, "vector_components")
    # the smallest id of each component that has links; its first class is in no row of comp
    member = comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct())
    member = member.join(classes.select(F.col("rep").alias("id"), "low"), "id")
    smallest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = member.join(smallest, "component").select(F.col("id").alias("rep"), "component_id")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = classes.select("rep", "v", "copies", "low").join(links, "rep", "left").join(of_class, "rep", "left")
    per_class = per_class.select(
        F.xxhash64("v").alias("key"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "low").alias("component_id"),
    )
    joined = rows.withColumn("key", good).join(per_class, "key", "left")
    joined = joined.where(F.col("w").isNull() | (F.col("w") == F.col("v")))
    component = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("component_id", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
