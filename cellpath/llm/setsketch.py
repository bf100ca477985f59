"""Near-duplicate documents by SetSketch registers.

A document's set is that of its distinct ``SHINGLE``-word shingles (its whole word sequence where it has fewer
words). Register ``i`` of a sketch is ``floor(1 - log_BASE(x))``, cut to a byte, of the smallest exponential value ``x``
that hash function ``i`` gives to a shingle: minima rounded to exponentially spaced steps. Sketches of parts
merge by the maximum of each register, and registers of two sets agree at least as often as their
Jaccard similarity.

1. Documents with equal sets become one node.
2. Nodes with equal registers in one of ``BANDS`` bands of ``ROWS`` share a bucket. At a similarity of 0.75 a pair shares none
   with a probability of 2 in 100,000.
3. Every node of a bucket is compared with the one that shares most buckets with others, which in a group of copies is what
   they were copied from, so that one comparison a node connects most of the group. Nodes that share a bucket and
   are still apart are then compared in blocks; pairs that are connected already are not.
4. A comparison estimates the similarity from both sketches by maximum likelihood, given the set sizes; pairs that
   are at least ``exp(-CAUTION)`` times as likely at the threshold are confirmed on the full sets.

Null texts and texts without words have empty sets and link with nothing. Repeated rows are copies of each other. Equal
similarities need no tie rule; a component is named by its smallest document id, and a row without an id is kept only
if its component has none. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.llm.bitmaps import bitmap, holds
from cellpath.llm.components import components
from cellpath.llm.staged import keep, stage
from cellpath.llm.words import NOT_SPACE, Words, grams, mix, slices

SHINGLE = 5
BANDS = 40
ROWS = 5
BASE = 1.1
PERCENT = 75
CAUTION = 10.0
#: Register of a smallest value of 1; with it, sets of one to 10**9 shingles fit in a byte.
ZERO = 32
#: Nodes a block has on each side.
CHUNK = 512

_M = BANDS * ROWS
_SEEDS = np.random.default_rng(7).integers(1, (1 << 64) - 1, _M, np.uint64) | np.uint64(1)
_BLOCK = 1 << 15


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each, and where each row's begin."""
    counts = words.counts()
    full = grams(words.hashes, SHINGLE)
    sets = []
    for low, count in zip(words.rows[:-1], counts):
        if count >= SHINGLE:
            sets.append(np.unique(full[low : low + count - SHINGLE + 1]))
        elif count:
            sets.append(grams(words.hashes[low : low + count], int(count)))
        else:
            sets.append(np.zeros(0, np.uint64))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), at


def registers(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketches of non-empty rows of ``values``: one row of bytes each."""
    out = np.empty((len(at) - 1, _M), np.uint64)
    row = 0
    while row < len(at) - 1:  # blocks that fit in a core's cache; a long row alone
        end = max(row + 1, int(np.searchsorted(at, at[row] + _BLOCK, "right")) - 1)
        block, begins = values[at[row] : at[end]], at[row:end] - at[row]
        product = np.empty_like(block)
        for i in range(_M):
            np.multiply(block, _SEEDS[i], out=product)
            out[row:end, i] = np.minimum.reduceat(product, begins)
        row = end
    x = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + ZERO, 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def _fingerprint(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per non-empty row of distinct values, whatever their order."""
    total = np.add.reduceat(mix(values ^ np.uint64(0x5DEECE66D)), at[:-1])
    return mix(total + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, node (hash of the set; null if empty), sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingles(Words(part["text"], NOT_SPACE, lower=True))
                size = np.diff(at)
                full = np.flatnonzero(size)
                bounds = np.concatenate([at[:-1][full], at[-1:]])
                node, sketch = [None] * len(size), [None] * len(size)
                if len(full):
                    prints = _fingerprint(values, bounds).view(np.int64).tolist()
                    for i, p, r in zip(full, prints, registers(values, bounds)):
                        node[i], sketch[i] = p, r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(size), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())],
                    names=["doc_id", "n", "node", "sketch"],
                )

    return docs.mapInArrow(make, "doc_id long, n long, node long, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """bucket, node for every band of every node."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(batch["node"].to_numpy(), BANDS))], names=["bucket", "node"]
                )

    return nodes.select("node", "sketch").mapInArrow(split, "bucket long, node long")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely Jaccard similarity of each pair of sketches, and by how much its log-likelihood exceeds
    that at the threshold (0 where the estimate is beyond it)."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def likelihood(j: np.ndarray) -> np.ndarray:
        def p(x):
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the log-likelihood has one maximum
        third = (high - low) / 3
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    best = (low + high) / 2
    bound = PERCENT / 100
    return best, np.where(best >= bound, 0.0, likelihood(best) - likelihood(np.minimum(bound, np.minimum(u / v, v / u))))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` that may reach the threshold."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s_a, s_b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, _M) for c in ("s_a", "s_b"))
                _, behind = estimate(s_a, s_b, batch["n_a"].to_numpy().astype(float), batch["n_b"].to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(behind <= CAUTION))

    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(fits).select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(possible, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, short: bool = False) -> DataFrame:
    """node, items: sets of the wanted ``(node, doc_id)``, made again from the texts of those documents.

    A bitmap of their ids picks them where they are read; an exact join drops what else it lets through. Full sets are arrays of
    64-bit hashes; ``short`` ones are 32 bits of each as bytes, sorted.
    """
    ids = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(_id_hash("doc_id").alias("h")), per_hash=16))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.filter(pa.array(holds(ids.value, batch["h"].to_numpy().view(np.uint64))))
            for part in slices(picked, "text"):
                values, at = shingles(Words(part["text"], NOT_SPACE, lower=True))
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    bounds = np.concatenate([at[:-1][full], at[-1:]])
                    prints = pa.array(_fingerprint(values, bounds).view(np.int64))
                    if short:
                        upper = (values >> np.uint64(32)).astype(np.uint32)
                        sets = pa.array([upper[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())
                    else:
                        sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([prints, sets], names=["node", "items"])

    kind = "binary" if short else "array<long>"
    made = docs.select(_id_hash("doc_id").alias("h"), "text").mapInArrow(make, f"node long, items {kind}")
    return made.join(wanted.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))


def _id_hash(column: str):
    return F.xxhash64(F.col(column))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Pairs that reach the threshold on their full sets; None if no pair may."""
    likely = stage(_likely(pairs, nodes), "likely", small=True)
    if likely.isEmpty():
        return None
    wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    wanted = stage(wanted.join(nodes, "node").select("node", F.col("first").alias("doc_id")), "wanted", small=True)
    sets = keep(_sets_of(docs, wanted))
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("i_a"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("i_b"))
    shared = F.size(F.array_intersect("i_a", "i_b"))
    union = F.size("i_a") + F.size("i_b") - shared
    return likely.join(b.hint("merge"), "b").join(a.hint("merge"), "a").where(100 * shared >= PERCENT * union).select("a", "b")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """bucket, node, component of the buckets that hold more than one component."""
    placed = members.select("bucket", "node").join(components(links), "node", "left")
    placed = placed.select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return stage(placed.join(mixed.select("bucket"), "bucket", "left_semi"), "apart", small=True)


def _leads(members: DataFrame) -> DataFrame:
    """bucket, lead: the member that shares buckets with the most nodes, so the one most others are copies of."""
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    return members.join(weights.hint("merge"), "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("lead"))


def _band_keys(sketches: np.ndarray) -> np.ndarray:
    regs = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = regs[:, :, 0] + (np.arange(BANDS, dtype=np.uint64) << np.uint64(48))
    for i in range(1, ROWS):
        key += regs[:, :, i] << np.uint64(8 * i)
    return mix(key).view(np.int64)


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Pairs of a block of a bucket that may be links: one of the nodes outside the bucket's main component."""
    out = []
    inner = table["inner"].to_numpy()
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, _M)
    node, group, n = (table[c].to_numpy() for c in ("node", "component", "n"))
    minor = table["minor"].to_numpy()
    items = [np.frombuffer(x, np.uint32) for x in table["items"].to_pylist()]
    left, right = np.flatnonzero(inner), np.flatnonzero(~inner)
    if len(left) and len(right):
        band = int(np.flatnonzero(_band_keys(sketch[left[:1]])[0] == table["bucket"][0].as_py())[0])
        for x in left:
            y = right[(group[right] != group[x]) & (~minor[right] | (node[x] < node[right]))]
            y = y[PERCENT * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])]
            shared = (sketch[y] == sketch[x]).reshape(-1, BANDS, ROWS).all(2)
            y = y[shared.argmax(1) == band]  # a pair is looked at in its first common bucket only
            if not len(y):
                continue
            _, behind = estimate(np.broadcast_to(sketch[x], (len(y), _M)), sketch[y], np.full(len(y), float(n[x])), n[y].astype(float))
            y = y[behind <= CAUTION]
            if not len(y):
                continue
            every = np.concatenate([items[i] for i in y])
            begins = np.cumsum([0, *(len(items[i]) for i in y[:-1])])
            place = np.minimum(np.searchsorted(items[x], every), len(items[x]) - 1)
            both = np.add.reduceat((items[x][place] == every).astype(np.int64), begins)
            # 32 bits may make sets share a little more; full sets decide
            y = y[100 * both >= (PERCENT - 1) * (n[x] + n[y] - both)]
            out += [(min(node[x], node[i]), max(node[x], node[i])) for i in y]
    return pa.table({"a": pa.array([int(p[0]) for p in out], pa.int64()), "b": pa.array([int(p[1]) for p in out], pa.int64())})


def _rest(apart: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that share a bucket, are not connected yet, and may be links.

    Members outside a bucket's largest component meet all members, in blocks of ``CHUNK`` by ``CHUNK``, and only what
    may be a link leaves a block.
    """
    sizes = apart.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("total"))
    main = main.select(
        "bucket",
        F.col("main.component").alias("main"),
        F.ceil((F.col("total") - F.col("main.size")) / CHUNK).cast("int").alias("rows"),
        F.ceil(F.col("total") / CHUNK).cast("int").alias("columns"),
    )
    tagged = apart.join(main.hint("merge"), "bucket").withColumn("minor", F.col("component") != F.col("main"))
    spot = F.abs(F.xxhash64("node", "bucket"))
    across = tagged.where("minor").select(
        "bucket", "node", "component", "minor", F.lit(True).alias("inner"), (spot % F.col("rows")).cast("int").alias("r"), F.explode(F.expr("sequence(0, columns - 1)")).alias("c")
    )
    down = tagged.select(
        "bucket", "node", "component", "minor", F.lit(False).alias("inner"), F.explode(F.expr("sequence(0, rows - 1)")).alias("r"), (spot % F.col("columns")).cast("int").alias("c")
    )
    wanted = keep(apart.select("node").distinct().join(nodes.hint("merge"), "node").select("node", F.col("first").alias("doc_id"), "n", "sketch"))
    held = keep(wanted.drop("doc_id").join(_sets_of(docs, wanted.select("node", "doc_id"), short=True).hint("merge"), "node"))
    blocks = across.union(down).join(held.hint("merge"), "node")
    return blocks.groupBy("bucket", "r", "c").applyInArrow(_compare_blocks, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = stage(_sketches(plain), "sketches")
    filled = made.where("node is not null")
    nodes = keep(
        filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    buckets = _bands(nodes)
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = keep(buckets.join(shared.hint("merge"), "bucket"))

    led = members.join(_leads(members).hint("merge"), "bucket").where("node != lead")
    pairs = led.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    none = spark.createDataFrame([], "a long, b long")
    links = stage(_verified(pairs, plain, nodes) or none, "links", small=True)
    apart = _apart(members, links)
    if not apart.isEmpty():
        more = _verified(stage(_rest(apart, plain, nodes), "rest", small=True), plain, nodes)
        if more is not None:
            links = stage(links.union(more), "links", small=True)

    groups = components(links)
    named = nodes.select("node", "first").join(groups, "node").groupBy("component").agg(F.min("first").alias("least"))
    labels = stage(groups.join(named, "component").select("node", "least"), "labels", small=True)
    firsts = nodes.select("node", "first").join(labels, "node", "left").select("node", F.coalesce("least", "first").alias("least"))
    return made.join(firsts, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (F.col("node").isNull() | F.col("least").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )
