"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are first one class. A k-means over the unit vectors, fitted on a bounded sample, assigns every class to the
cell of its nearest centroid; cells are cut into blocks of bounded size. Two blocks of one label are multiplied
unless the triangle inequality on angles shows that no pair between them can reach the threshold, and a
vector takes part in the product only if it can reach the other cell itself. So every link is found. Products run in
double precision, a block against a block; what leaves a task is one row per vector, never a pair.

Where the vectors have no structure (all angles near 90 degrees) no cell can be ruled out and the work is that of all pairs inside a label, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from larkspur.llm.graph import components
from larkspur.llm.store import cut
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.93
#: Rows that the centroids are fitted on at most.
FIT_ROWS = 20_000
#: Rows of a block at most, about.
BLOCK_ROWS = 2_048
#: Rows of one label that one more centroid stands for, and the number of centroids at most.
CELL_ROWS, MOST_CELLS = 4_096, 256
#: What an angle may be off, near zero, for the rounding of its cosine; pairs of centroids that are sent to every executor at most.
SLACK, BROADCAST_GAPS = 1e-6, 500_000


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids (fewer if there are fewer different rows)."""
    rng = np.random.default_rng(seed)
    centers = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(unit @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, unit)
        norm = np.linalg.norm(sums, axis=1)
        keep = norm > 1e-12
        centers = np.where(keep[:, None], sums / np.where(keep, norm, 1)[:, None], centers)
    return centers


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _angle(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def link_block(a: np.ndarray, b: np.ndarray | None, threshold: float, wa: np.ndarray, wb: np.ndarray | None):
    """Weighted link counts and component roots of the rows of a, then of b (None: a with itself)."""
    n = len(a)
    other, wo = (a, wa) if b is None else (b, wb)
    mask = np.empty((n, len(other)), bool)
    for i in range(0, n, 512):
        mask[i : i + 512] = a[i : i + 512] @ other.T >= threshold
    if b is None:
        mask |= mask.T
        np.fill_diagonal(mask, False)
    count = [mask @ wo]
    if b is not None:
        count.append(wa @ mask)
    label_a = np.arange(n)
    label_b = label_a if b is None else n + np.arange(len(other))
    far = n + len(other)
    while True:
        before = label_a.copy(), label_b.copy()
        for i in range(0, n, 512):
            low = np.where(mask[i : i + 512], label_b[None, :], far).min(axis=1, initial=far)
            label_a[i : i + 512] = np.minimum(label_a[i : i + 512], low)
        if b is not None:
            for j in range(0, len(other), 512):
                low = np.where(mask[:, j : j + 512], label_a[:, None], far).min(axis=0, initial=far)
                label_b[j : j + 512] = np.minimum(label_b[j : j + 512], low)
        if np.array_equal(before[0], label_a) and np.array_equal(before[1], label_b):
            break
    return np.concatenate(count), label_a if b is None else np.concatenate([label_a, label_b])


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    A vector that is null, empty, zero or has null or non-finite components links with nothing, and so does one without a label
    or without an id. Vectors of different lengths have no cosine. Rows that repeat an id count as vectors of their own
    that share a component id. A null id has a null component and is not kept.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid).withColumn("dim", F.size("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v", F.lit(2)))
    key = ["label", "dim", "h1", "h2"]
    classes = cut(rows.where("valid").groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    sizes = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most")).collect()
    if not sizes:
        links = rows.sparkSession.createDataFrame([], "rep long, links long")
        parts = rows.sparkSession.createDataFrame([], "node long, component long")
    else:
        links, parts = _links(classes, {r["dim"]: r["most"] for r in sizes}, threshold)
    found = classes.join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    found = found.select(
        *(F.col(k).alias(f"k_{k}") for k in key),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    match = F.col("valid")
    for k in key:
        match = match & (F.col(k) == F.col(f"k_{k}"))
    out = rows.drop("v").join(found, match, "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _links(classes: DataFrame, most: dict[int, int], threshold: float) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    centers = {}
    for dim, n in most.items():
        sample = classes.where(F.col("dim") == dim).orderBy("h1", "h2").limit(FIT_ROWS).select("v").toArrow()
        centers[dim] = spherical_kmeans(_unit(_matrix(sample.column("v"))), min(MOST_CELLS, math.ceil(n / CELL_ROWS)))

    def assign(batches):
        for batch in batches:
            dims = np.asarray(batch.column(batch.schema.get_field_index("dim")))
            cell, angle = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            vectors = batch.column(batch.schema.get_field_index("v"))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                dots = _unit(_matrix(vectors.take(pa.array(at)))) @ centers[int(dim)].T
                cell[at] = np.argmax(dots, axis=1)
                angle[at] = _angle(dots.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    schema = classes.select("*").schema.add("cell", "long").add("angle", "double")
    placed = classes.mapInArrow(assign, schema)
    cells = cut(placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS))
    same = placed.join(cells.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"])
    placed = cut(same.withColumn("block", F.pmod("h1", F.col("blocks"))).drop("blocks"))
    limit = float(np.arccos(threshold)) + SLACK
    apart = [(d, i, j, g) for d, c in centers.items() for i, row in enumerate(_angle(c @ c.T).tolist()) for j, g in enumerate(row)]
    gaps = spark.createDataFrame(apart, "dim int, cell long, cell2 long, gap double")
    gaps = F.broadcast(gaps) if len(apart) <= BROADCAST_GAPS else gaps
    blocks = placed.groupBy("label", "dim", "cell", "block").agg(F.max("angle").alias("radius"))
    blocks = cut(blocks)
    second = blocks.select("label", "dim", F.col("cell").alias("cell2"), F.col("block").alias("block2"), F.col("radius").alias("radius2"))
    pairs = blocks.join(gaps, ["dim", "cell"]).join(second, ["label", "dim", "cell2"])
    pairs = pairs.where(F.col("gap") <= F.col("radius") + F.col("radius2") + limit)
    pairs = pairs.where((F.col("cell") < F.col("cell2")) | ((F.col("cell") == F.col("cell2")) & (F.col("block") <= F.col("block2"))))
    # a vector goes only where the other block can hold a partner: the angles to the two centroids differ by their gap at most
    task = ["label", "dim", "cell", "block", "cell2", "block2"]
    pairs = cut(pairs.select(*task, (F.col("gap") - F.col("radius2") - limit).alias("reach"), (F.col("gap") - F.col("radius") - limit).alias("reach2")))
    left = placed.join(pairs.select(*task, F.lit(0).alias("side"), "reach"), ["label", "dim", "cell", "block"]).where("angle >= reach")
    right = pairs.where("cell <> cell2 or block <> block2").select(*task, F.lit(1).alias("side"), "reach2")
    moved = placed.withColumnRenamed("cell", "cell2").withColumnRenamed("block", "block2")
    right = moved.join(right, ["label", "dim", "cell2", "block2"]).where("angle >= reach2")
    columns = [*task, "side", "rep", "weight", "v"]
    both = left.select(*columns).union(right.select(*columns))

    def product(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        side = np.asarray(found.column("side"))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rep, weight = (np.asarray(found.column(c)) for c in ("rep", "weight"))
        unit = _unit(_matrix(found.column("v")))
        order = np.concatenate([first, second])
        same = found.column("cell")[0] == found.column("cell2")[0] and found.column("block")[0] == found.column("block2")[0]
        if not len(first) or not (same or len(second)):
            count, root = np.zeros(len(order), np.int64), np.arange(len(order))
        else:
            count, root = link_block(unit[first], None if same else unit[second], threshold, weight[first], None if same else weight[second])
        ids = rep[order]
        keep = (count > 0) | (root != np.arange(len(order)))
        return pa.table({"rep": ids[keep], "links": count[keep].astype(np.int64), "root": ids[root][keep]})

    linked = cut(both.groupBy(*task).applyInArrow(product, "rep long, links long, root long"))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    return links, components(linked.where("rep <> root"), "rep", "root")


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
