"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of a label (and of one dimension) are dealt to tiles of a bounded number of rows.  For
each pair of tiles, the product of the int8 forms gives every cosine up to a bound that follows
from each vector's own quantisation error; only pairs that may reach the threshold are computed
in double precision.  A tile pair hands on, for each vector, the number of its links and a
spanning forest of them, never the pairs, so many copies of a vector stay linear.

Equal vectors of a label are one class before tiling; each counts the others of its class as
links.  Null labels and vectors that are null, empty, zero, or hold null or non-finite values
link with nothing: no links, a component of their own.  Repeated rows are vectors of their own.
Null ids are never the smallest of a component that has others, and never kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessloom.llm.common import stored
from accessloom.llm.components import components

TILE = 1024
#: Pairs computed in double precision at a time.
EXACT_PAIRS = 1 << 15
_FOUND = "rep long, root long, n_links long"


def quantised(unit: np.ndarray):
    """Int8 forms as float32 (sums of their products up to 2**24 are exact), scales, norms of
    what is left over, and norms of the forms."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.float32), scale, error, np.linalg.norm(codes, axis=1) * scale


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each vector of ``a`` has a cosine of at least ``threshold`` with each of ``b``."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ea, ha = quantised(a / na[:, None])
    qb, sb, eb, hb = quantised(b / nb[:, None])
    product = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):  # 1024 * 127**2 < 2**24
        product += qa[:, at : at + 1024] @ qb[:, at : at + 1024].T
    product *= sa[:, None] * sb[None, :]
    # x.y - x'.y' = (x - x').y' + x.(y - y')
    product += ea[:, None] * hb[None, :] + eb[None, :] + 1e-9
    i, j = np.nonzero(product >= threshold)
    linked = np.zeros(product.shape, bool)
    for at in range(0, len(i), EXACT_PAIRS):
        x, y = i[at : at + EXACT_PAIRS], j[at : at + EXACT_PAIRS]
        linked[x, y] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the least node of its component."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, number: str = "vec_id", vector: str = "embedding",
    label: str = "label", tile: int = TILE,
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id and kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine over 0")
    rows = vectors.select(
        F.col(number).alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    ).withColumn("uid", F.monotonically_increasing_id())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    # parts of a large range would overflow when squared; a cosine doesn't depend on the scale
    scale = F.when(F.array_max(F.transform("v", F.abs)).between(1e-100, 1e100), F.lit(1.0)).otherwise(
        F.array_max(F.transform("v", F.abs)))
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x / scale)))
    rows = stored(rows, "vectors")
    usable_rows = rows.where("v IS NOT NULL")
    classes = usable_rows.groupBy("label", "v").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    members = usable_rows.join(classes, ["label", "v"]).select("uid", "rep", "copies")
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(
        F.ceil(F.count("*") / tile).alias("tiles"))
    tiled = classes.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"]).withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    other = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = other.select(
        "label", "dim", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"),
        "tile", "rep", "copies", "v",
    )

    def product(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ta, tb = key[2], key[3]
        frame = frame.sort_values("rep")
        v, copies = np.stack(frame["v"].to_numpy()), frame["copies"].to_numpy()
        first = (frame["tile"] == ta).to_numpy()
        if ta == tb:
            linked = tile_links(v, v, threshold)
            np.fill_diagonal(linked, False)
            linked |= linked.T
        else:
            linked = np.zeros((len(v), len(v)), bool)
            if first.any() and not first.all():
                across = tile_links(v[first], v[~first], threshold)
                linked[np.ix_(first, ~first)] = across
                linked[np.ix_(~first, first)] = across.T
        some = linked.any(axis=1)
        reps = frame["rep"].to_numpy()
        return pd.DataFrame({
            "rep": reps[some], "root": reps[forest(linked)][some], "n_links": (linked @ copies)[some],
        })

    found = stored(pairs.groupBy("label", "dim", "ta", "tb").applyInPandas(product, _FOUND), "found")
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("n"))
    out = (
        rows.select("uid", "vec_id").join(members, "uid", "left")
        .join(links, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            "vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("component", "rep", "uid").alias("c"),
        )
    )
    out = stored(out, "vector_links")
    smallest = out.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    return out.join(smallest, "c").select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
