"""Near-duplicate embeddings by int8 tile products with exact bounds on the quantisation error.

A vector x of length 1 is held as ``scale * codes`` with codes in -127..127, plus the length ``error`` of what
rounding lost. For two vectors ``|x.y - approx| <= |scale_x codes_x| * error_y + error_x``, so the product of the
codes decides most pairs: below the threshold for certain, or above it for certain; only those between are computed in double precision. Codes are made once
a tile, and they are what travels to the pairs of tiles; the vectors stay in a file a tile, which a pair with open cases reads.

Equal vectors are one node with a weight. Nodes are put into tiles of about ``TILE`` by their nearest pivot (a bounded sample
of vectors), and a pair of tiles is skipped where the angles to their pivots prove that no pair
of its vectors can reach the threshold. There are at most ``MOST_TILES`` tiles, whose outlines are broadcast. A pair of tiles returns, per node, the
weight linked to it, and a spanning forest of its links, so that a group of n copies yields in the order of n rows.

Null and zero vectors and vectors with null, infinite or undefined components link with nothing; vectors of
different lengths do not link. Repeated rows are copies of each other. A cosine equal to the threshold
links. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.llm.components import components
from cellpath.llm.exchange import read_block, store_block
from cellpath.llm.staged import keep
from cellpath.session import scratch_path

THRESHOLD = 0.95
TILE = 4096
MOST_TILES = 1 << 16
MOST_PIVOTS = 256
#: Covers rounding in double precision of sums and roots over some thousand components.
SLACK = 1e-9
_ROWS = 512


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in double precision, also where squares would overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Quantised:
    """Codes of unit vectors and what bounds the error of their products."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, length: np.ndarray, error: np.ndarray):
        self.codes, self.scale, self.length, self.error = codes, scale, length, error

    @classmethod
    def of(cls, unit: np.ndarray) -> Quantised:
        scale = np.abs(unit).max(1) / 127
        codes = np.rint(unit / scale[:, None])
        held = codes * scale[:, None]
        return cls(codes.astype(np.int8), scale, np.sqrt((held * held).sum(1)), np.sqrt(((unit - held) ** 2).sum(1)) + SLACK)

    def pack(self) -> dict[str, bytes]:
        return {"codes": self.codes.tobytes(), "facts": np.stack([self.scale, self.length, self.error]).tobytes()}

    @classmethod
    def unpack(cls, codes: bytes, facts: bytes, dims: int) -> Quantised:
        return cls(np.frombuffer(codes, np.int8).reshape(-1, dims), *np.frombuffer(facts, np.float64).reshape(3, -1))

    def approx(self, rows: slice, other: Quantised) -> np.ndarray:
        """Products of the vectors that the codes stand for. Integer sums stay exact: single precision up to
        1,040 components (127 * 127 * 1,040 < 2**24), double beyond."""
        kind = np.float32 if self.codes.shape[1] <= 1040 else np.float64
        product = self.codes[rows].astype(kind) @ other.codes.astype(kind).T
        return product * (self.scale[rows, None] * other.scale[None, :])

    def bound(self, rows: slice, other: Quantised) -> np.ndarray:
        return self.length[rows, None] * other.error[None, :] + self.error[rows, None] + SLACK


def linked(x: Callable[[], np.ndarray], y: Callable[[], np.ndarray], q: Quantised, r: Quantised, rows: slice, threshold: float) -> np.ndarray:
    """Which of ``x()[rows]`` and ``y()`` (unit vectors, asked for only if pairs are open) have a cosine of the threshold at least."""
    approx, bound = q.approx(rows, r), q.bound(rows, r)
    sure = approx - bound >= threshold
    open_ = ~sure & (approx + bound >= threshold)
    i, j = np.nonzero(open_)
    for at in range(0, len(i), 1 << 16):  # full precision for these pairs only
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        sure[a, b] = np.einsum("ij,ij->i", x()[rows][a], y()[b]) >= threshold
    return sure


def _forest(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, representative) that connect what the links ``a[i], b[j]`` connect; no more than nodes."""
    nodes, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    s, t = place[: len(i)], place[len(i) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[s], label[t])
        new = label.copy()
        np.minimum.at(new, s, least)
        np.minimum.at(new, t, least)
        np.minimum.at(new, label[s], least)
        np.minimum.at(new, label[t], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _compare(threshold: float, dims: int, folder: str):
    def vectors(name: int) -> Callable[[], np.ndarray]:
        """Unit vectors of a tile, read once, when asked for."""
        return cache(lambda: _unit(read_block(folder, name)["values"].to_numpy().reshape(-1, dims)))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch[n][k].as_py() for n in batch.schema.names}
                n_a, n_b = (np.frombuffer(row[c], np.int64) for c in ("nodes_a", "nodes_b"))
                w_a, w_b = (np.frombuffer(row[c], np.int64) for c in ("weights_a", "weights_b"))
                x, y, same = vectors(row["file_a"]), vectors(row["file_b"]), row["a"] == row["b"]
                q, r = (Quantised.unpack(row[f"codes_{s}"], row[f"facts_{s}"], dims) for s in "ab")
                sum_a, sum_b, edges = np.zeros(len(n_a), np.int64), np.zeros(len(n_b), np.int64), []
                for low in range(0, len(n_a), _ROWS):
                    rows = slice(low, min(low + _ROWS, len(n_a)))
                    hit = linked(x, y, q, r, rows, threshold)
                    if same:
                        hit[np.arange(rows.stop - low), np.arange(low, rows.stop)] = False
                    i, j = np.nonzero(hit)
                    if not len(i):
                        continue
                    sum_a[rows] += np.bincount(i, w_b[j], rows.stop - low).astype(np.int64)
                    if not same:
                        sum_b += np.bincount(j, w_a[rows][i], len(n_b)).astype(np.int64)
                    edges.append(_forest(i, j, n_a[rows], n_b))
                s, t = (np.concatenate([e[z] for e in edges] or [np.zeros(0, np.int64)]) for z in (0, 1))
                node = np.concatenate([n_a, n_b, s])
                links = np.concatenate([sum_a, sum_b, np.zeros(len(s), np.int64)])
                to = np.concatenate([np.zeros(len(n_a) + len(n_b), np.int64), t])
                edge = np.concatenate([np.zeros(len(n_a) + len(n_b), np.bool_), np.ones(len(s), np.bool_)])
                use = (links > 0) | edge
                yield pa.RecordBatch.from_arrays([pa.array(v[use]) for v in (node, links, to, edge)], names=["node", "links", "other", "edge"])

    return act


def _tiles(nodes: DataFrame, pivots: np.ndarray, count: int, tile: int) -> DataFrame:
    """cell and salt of every node: its nearest pivot, and a part of the cell dealt out by hash."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(np.array(batch["embedding"].to_pylist(), np.float64))
                cosine = np.clip(x @ pivots.T, -1, 1)
                cell = cosine.argmax(1)
                angle = np.arccos(cosine[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays(
                    [batch["node"], batch["weight"], pa.array(cell), pa.array(angle), batch["embedding"]],
                    names=["node", "weight", "cell", "angle", "embedding"],
                )

    return nodes.select("node", "weight", "embedding").mapInArrow(
        assign, "node long, weight long, cell long, angle double, embedding array<double>"
    )


_TILE = "tile long, cell long, radius double, nodes binary, weights binary, codes binary, facts binary, file long"


def _gather(folder: str, dims: int):
    """One row per tile: nodes and weights, codes and what bounds their errors, the file of its vectors, and the widest angle to the pivot."""

    def act(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy(), kind="stable")
        flat = table["embedding"].combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[order]
        name = store_block(folder, (table["tile"][0].as_py(), 0), {"values": pa.array(values.ravel())})
        packed = Quantised.of(_unit(values)).pack()
        return pa.table({
            "tile": table["tile"][:1],
            "cell": table["cell"][:1],
            "radius": pa.array([float(np.max(table["angle"].to_numpy()))]),
            "nodes": pa.array([table["node"].to_numpy()[order].tobytes()], pa.binary()),
            "weights": pa.array([table["weight"].to_numpy()[order].tobytes()], pa.binary()),
            "codes": pa.array([packed["codes"]], pa.binary()),
            "facts": pa.array([packed["facts"]], pa.binary()),
            "file": pa.array([name], pa.int64()),
        })

    return act


def _of_one_length(nodes: DataFrame, dims: int, threshold: float, tile: int) -> DataFrame:
    """Links between nodes of one dimension: (node, links, other, edge)."""
    spark = nodes.sparkSession
    n = nodes.count()
    tile = max(tile, -(-n // (MOST_TILES // 2)))
    k = max(1, min(MOST_PIVOTS, n // (4 * tile)))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(k).select("embedding").collect()  # MOST_PIVOTS rows at most
    pivots = _unit(np.array([r[0] for r in sample], np.float64))
    folder = scratch_path(spark, "tiles")
    placed = keep(_tiles(nodes, pivots, n, tile))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size"))
    dealt = placed.join(sizes, "cell").withColumn("parts", F.ceil(F.col("size") / tile))
    dealt = dealt.withColumn("tile", F.shiftleft("cell", 32) + F.pmod(F.xxhash64("node"), F.col("parts")))
    tiles = keep(
        dealt.select("tile", "cell", "angle", "node", "weight", "embedding")
        .groupBy("tile")
        .applyInArrow(_gather(folder, dims), _TILE)
    )
    outline = tiles.select("tile", "cell", "radius").toArrow()  # MOST_TILES rows at most
    number, cell, radius = (outline[c].to_numpy() for c in ("tile", "cell", "radius"))
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = np.arccos(threshold) + 1e-6
    shared = spark.sparkContext.broadcast((number, cell, radius, between))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, radius, between = shared.value
        for batch in batches:
            for a, c, w in zip(batch["tile"].to_pylist(), batch["cell"].to_pylist(), batch["radius"].to_pylist()):
                b = number[(number >= a) & (between[c, cell] - w - radius <= reach)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b)], names=["a", "b"])

    pairs = keep(tiles.select("tile", "cell", "radius").mapInArrow(near, "a long, b long"))
    side = lambda s: tiles.select(
        F.col("tile").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("nodes", "weights", "codes", "facts", "file"))
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(_compare(threshold, dims, folder), "node long, links long, other long, edge boolean")


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE
) -> DataFrame:
    """Per vector row: vec_id, n_links, component_id, kept."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    rows = rows.withColumn("node", F.when(sound, F.xxhash64("embedding")))
    nodes = keep(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    )
    lengths = sorted(r[0] for r in nodes.select(F.size("embedding")).distinct().collect())
    found = None
    for dims in lengths:
        part = _of_one_length(nodes.where(F.size("embedding") == dims), dims, threshold, tile)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = keep(found)
    counts = found.where("not edge").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("edge").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    facts = keep(
        named.join(least, "component")
        .join(counts, "node", "left")
        .select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    own = F.col("node").isNull()
    return rows.join(facts, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(own, F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
        (own | F.col("least").eqNullSafe(F.col("vec_id"))).alias("kept"),
    )
