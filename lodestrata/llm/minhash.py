"""Near-duplicate documents with an LSH forest over MinHash signatures.

Texts with the same shingle set form a class. Each of ``TREES`` trees orders the classes by its own
rotation of the signature: the first ``DEPTH`` values (hashed), then deeper ones. The order is a range
sort of single rows, so a region of any size spreads over tasks.

1. Deepest first: every class is a candidate with its neighbour in each order, the one it shares the
   longest prefix with. Of these each class keeps the ``NEAREST``, by prefix length over all trees.
   Candidates are confirmed on full shingle sets, and links joined into components.
2. Wider where needed: a region (classes with a common prefix of DEPTH values) that still holds several
   components is opened whole. Its classes meet block by block inside tasks, but for pairs of its largest
   component; pairs of different components whose signatures agree in ``LEAST_AGREE`` values or more
   are confirmed on full sets, in the first tree where they meet. A task returns the links that
   join components, so no candidate is dropped and no pair inside a component is ever listed.

A pair at similarity 0.8 shares DEPTH values in no tree with probability (1 - 0.8**4)**24 = 3e-6, and falls
under LEAST_AGREE with probability below 1e-5; closer pairs miss far less.

Null or empty texts, and texts of blanks, have no shingles and link with nothing. Rows with a null
doc_id link with nothing and have a null component. Rows that share a doc_id share a component. Ties
in prefix length go to the smaller doc_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import SALT, components
from .scratch import Scratch
from .shingles import SIGNATURE, shingle_set, signature
from .workers import lean

DEPTH = 4
TREES = SIGNATURE // DEPTH
NEAREST = 3
BLOCK = 512
#: Signature values, of SIGNATURE, in which a candidate of an opened region agrees at least (0.6).
LEAST_AGREE = 58


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, size)
                key = xxhash.xxh3_128_digest(own.tobytes())
                values = signature(own) if len(own) else None
                n.append(len(own))
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                sig.append(None if values is None else values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, prefix, deep, cls) rows -> the rows of regions with several classes, each with the class before it.

    The first and last row of a partition are kept in any case: their region may go on elsewhere.
    """
    names = ["tree", "prefix", "cls", "before", "shared"]
    held = None  # (tree, prefix, deep, cls, same as its predecessor, predecessor, shared, first of the partition)
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        prefix, cls = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        deep = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(len(tree), DEPTH)
        if held is None:
            before = np.array([-1])
            tree0, prefix0, deep0, cls0 = np.array([-1]), np.array([0]), np.zeros((1, DEPTH), np.uint32), before
        else:
            tree0, prefix0, deep0, cls0 = held[0]
        t, p, d, c = np.concatenate([tree0, tree]), np.concatenate([prefix0, prefix]), np.concatenate([deep0, deep]), np.concatenate([cls0, cls])
        same = (t[1:] == t[:-1]) & (p[1:] == p[:-1])
        shared = np.where(same, DEPTH + np.cumprod(d[1:] == d[:-1], axis=1).sum(axis=1), 0)
        if held is not None:
            # the row held back is known now: it counts if it matches a neighbour or opens the partition
            if held[1] or held[3] or same[0]:
                yield _rows(names, t[:1], p[:1], c[:1], np.array([held[2][0]]), np.array([held[2][1]]), np.array([held[1]]))
        keep = same[:-1] | same[1:]
        if held is None and len(keep):
            keep[0] = True
        own = np.flatnonzero(keep)
        if len(own):
            yield _rows(names, t[1:][own], p[1:][own], c[1:][own], c[:-1][own], shared[own], same[own])
        held = ((t[-1:], p[-1:], d[-1:], c[-1:]), bool(same[-1]), (c[-2], shared[-1]), held is None and len(tree) == 1)
    if held is not None:
        (t, p, _, c), same, (before, shared), _ = held
        yield _rows(names, t, p, c, np.array([before]), np.array([shared]), np.array([same]))


def _rows(names, tree, prefix, cls, before, shared, same) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(prefix, pa.int64()), pa.array(cls, pa.int64()), pa.array(before, pa.int64(), mask=~np.asarray(same, dtype=bool)), pa.array(shared, pa.int32())], names=names)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, exactly."""
    if min(len(a), len(b)) * 100 < 80 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(i).to_pylist() for i in (2, 3))
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist(), len(cols)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(cols[a])
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of a region, from blocks i and j of it; see the module's second step."""
    for rows in _runs(batches, 4):
        tree, i, j = (rows.column(k)[0].as_py() for k in (0, 2, 3))
        blk, cls, comp = (rows.column(k).to_numpy() for k in (4, 5, 6))
        sig = np.frombuffer(b"".join(rows.column(7).to_pylist()), dtype=np.uint32).reshape(len(blk), SIGNATURE)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column(8).to_pylist()]
        links = _links(tree, sig, sets, cls, comp, np.flatnonzero(blk == i), np.flatnonzero(blk == j))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def _links(tree: int, sig: np.ndarray, sets: list[np.ndarray], cls: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Confirmed links that join components of the ``left`` rows with those of the ``right`` rows."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    low = sig.astype(np.uint8)
    size = np.array([len(x) for x in sets])
    out: list[tuple[int, int]] = []
    for x in left.tolist():
        near = right[comp[right] != comp[x]]
        near = near[(low[near] == low[x]).sum(axis=1) >= LEAST_AGREE]
        near = near[(np.minimum(size[near], size[x]) * 100 >= 80 * np.maximum(size[near], size[x]))]
        if tree and len(near):  # pairs that met in an earlier tree are compared there
            met = (sig[near, : tree * DEPTH] == sig[x, : tree * DEPTH]).reshape(len(near), tree, DEPTH).all(axis=2).any(axis=1)
            near = near[~met]
        own = root(int(comp[x]))
        near = np.array([y for y in near.tolist() if root(int(comp[y])) != own], dtype=np.int64)
        if not len(near):
            continue
        every = np.concatenate([sets[y] for y in near])
        at = np.minimum(np.searchsorted(sets[x], every), size[x] - 1)
        both = np.add.reduceat(sets[x][at] == every, np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
        for y in near[100 * both >= 80 * (size[near] + size[x] - both)].tolist():
            a, b = root(int(comp[x])), root(int(comp[y]))
            if a != b:
                parent[a] = b
                out.append((int(cls[x]), int(cls[y])))
    return out


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, on shingles of ``size`` words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.cut(texts.mapInArrow(lean(_sign(size)), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.cut(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls")), "set-classes")
    reps = usable.join(classes, (usable.k1 == classes.k1) & (usable.k2 == classes.k2) & (usable.doc_id == classes.cls), "left_semi").select(F.col("doc_id").alias("cls"), "k1", "sig").dropDuplicates(["cls", "k1"])
    reps = scratch.cut(reps, "class-signatures")

    width = 4 * DEPTH
    entries = reps.select("cls", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree",
        F.xxhash64(F.expr(f"substring(sig, {width} * tree + 1, {width})")).alias("prefix"),
        F.expr(f"substring(sig, {width} * ((tree + 1) % {TREES}) + 1, {width})").alias("deep"),
        "cls",
    )
    order = ["tree", "prefix", "deep", "cls"]
    members = scratch.cut(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_neighbours), "tree int, prefix long, cls long, before long, shared int"), "members")

    pairs = members.where("before <> cls").groupBy(F.least("cls", "before").alias("a"), F.greatest("cls", "before").alias("b")).agg(F.sum("shared").alias("shared"))
    both = pairs.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("of"))
    nearest = both.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("shared"), "a", "b"))).where(F.col("r") <= NEAREST)
    candidates = scratch.cut(nearest.select("a", "b").distinct(), "candidates")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, size).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    wanted = members.select(F.col("cls").alias("doc_id")).distinct()
    sets = scratch.cut(texts.join(wanted, "doc_id", "left_semi").mapInArrow(lean(shingled), "id long, shingles binary"), "shingle-sets")

    def confirmed(rows: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        full = rows.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
        return scratch.cut(full.mapInArrow(lean(_confirm), "a long, b long").distinct(), name)

    links = confirmed(candidates, "links")
    found = components(links, scratch, "component-links")
    placed = members.select("tree", "prefix", "cls").distinct().join(found.withColumnRenamed("id", "cls"), "cls", "left").select("tree", "prefix", "cls", F.coalesce("component", "cls").alias("comp"))
    placed = scratch.cut(placed, "placed")
    by_component = placed.groupBy("tree", "prefix", "comp").agg(F.count("*").alias("n"))
    regions = by_component.groupBy("tree", "prefix").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    regions = scratch.cut(regions.select("tree", "prefix", F.col("most.comp").alias("most"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("g_rest"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("g_most")), "regions")
    # blocks of the region's largest component never meet each other
    largest = F.col("comp") == F.col("most")
    dealt = (
        placed.join(regions, ["tree", "prefix"])
        .withColumn("blk", F.when(largest, F.col("g_rest") + F.pmod(F.xxhash64("cls", F.lit(7)), F.col("g_most"))).otherwise(F.pmod(F.xxhash64("cls", F.lit(7)), F.col("g_rest"))).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.when(largest, F.col("g_rest")).otherwise(F.col("g_rest") + F.col("g_most")) - 1)))
        .select("tree", "prefix", F.least("blk", "k").alias("i"), F.greatest("blk", "k").alias("j"), "blk", "cls", "comp")
    )
    full = dealt.join(reps.select("cls", "sig"), "cls").join(sets.withColumnRenamed("id", "cls"), "cls").select("tree", "prefix", "i", "j", "blk", "cls", "comp", "sig", "shingles")
    keys = ["tree", "prefix", "i", "j"]
    new = scratch.cut(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_open), "a long, b long").distinct(), "opened")
    found = components(links.unionByName(new), scratch, "component-links")

    label = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("k1", "k2", F.coalesce("component", "cls").alias("component_id"), F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("salt"))
    every = signed.select("doc_id", "n_shingles", "k1", "k2", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"), ((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).alias("linked"))
    out = every.join(label, ["k1", "k2", "salt"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """``docs`` without the documents whose component holds a smaller doc_id; rows with a null doc_id stay."""
    gone = near_duplicates(docs, scratch, size).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
