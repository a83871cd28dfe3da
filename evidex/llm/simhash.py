"""SimHash near-duplicates: exact comparison of fingerprint tiles by exclusive-or and bit counts.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and link
like any other; repeated rows stay as rows; a row without an id gets the smallest id that its group
has, null if it has none; an empty table gives an empty table; other columns are not read.

Scale: texts become 8-byte fingerprints where they are read. Only distinct fingerprints are compared,
in square cells of hashed blocks of at most ``BLOCK`` fingerprints, so that a task holds two blocks
whatever the input. Within a cell, fingerprints are sorted by the bit counts of their four quarters and
cut into tiles; a pair of tiles is skipped when those counts differ by more than the radius. A cell
returns a forest, never all pairs, and the forests are joined to components by star contraction on
DataFrames. The comparison stays quadratic in distinct fingerprints; tiles only divide the constant.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, parallelism, release

WIDTH, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a block, and in a tile.
BLOCK, TILE = 131_072, 256
#: Strips that a cell is cut into at most.
STRIPS = 8
#: Hashes whose bits are counted at a time, and pairs of links held before they are merged.
HASHES, PAIRS = 65_536, 1_000_000
#: Parts that the rows of a large group are dealt to.
SALTS = 32
#: A fingerprint that more than one of so many rows have is a hot one; there are no more hot ones than that.
HOT = 5000


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit fingerprint, unsigned. bytes.lower() and bytes.split() know ASCII only."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[width - 1 :] or ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(ends), HASHES):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[k : k + HASHES], ends[k : k + HASHES])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view(np.uint64)[0])


def as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, fp) and the long columns ``more``: fp as a signed long."""

    def start():
        def step(ids, texts, *rest):
            return ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist(), *rest

        return step

    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more], start, ", ".join(["id long, fp long", *(f"{c} long" for c in more)]))


def _settle(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union the pairs (u, v) into a forest of flat trees whose roots are the smallest members."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _tiles(x: np.ndarray, tile: int):
    """The order by quarters' bit counts, and each tile's least and greatest counts."""
    quarters = [np.bitwise_count((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4)]
    order = np.lexsort(quarters[::-1])
    counts = np.stack([np.bitwise_count(x), *quarters]).astype(np.int16)[:, order]
    cuts = np.arange(0, len(x), tile)
    return order, np.minimum.reduceat(counts, cuts, axis=1), np.maximum.reduceat(counts, cuts, axis=1)


def cell_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, tile: int = TILE, strip: int = 0, strips: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A forest (member, root) of all links between a and b, or within a if b is None. Both uint64 and distinct.

    Of ``strips`` strips, that share a's tiles evenly, only one is done.
    """
    nodes = np.sort(np.concatenate([a, b]) if b is not None else a)
    parent, held, n = np.arange(len(nodes)), [], 0
    oa, lo_a, hi_a = _tiles(a, tile)
    oa_rank = np.searchsorted(nodes, a[oa])
    sa = a[oa]
    if b is None:
        sb, ob_rank, lo_b, hi_b = sa, oa_rank, lo_a, hi_a
    else:
        ob, lo_b, hi_b = _tiles(b, tile)
        sb, ob_rank = b[ob], np.searchsorted(nodes, b[ob])
    xor, bits, hit = (np.empty((tile, tile), t) for t in (np.uint64, np.uint8, bool))
    for i in range(strip, lo_a.shape[1], strips):
        gaps = np.maximum(0, np.maximum(lo_a[:, i : i + 1] - hi_b, lo_b - hi_a[:, i : i + 1]))
        near = np.nonzero(np.maximum(gaps[0], gaps[1:].sum(0)) <= radius)[0]
        left = sa[i * tile : (i + 1) * tile, None]
        for j in near:
            if b is None and j < i:
                continue
            right = sb[None, j * tile : (j + 1) * tile]
            shape = np.s_[: left.shape[0], : right.shape[1]]
            np.bitwise_xor(left, right, out=xor[shape])
            np.bitwise_count(xor[shape], out=bits[shape])
            np.less_equal(bits[shape], radius, out=hit[shape])
            if not np.count_nonzero(hit[shape]):
                continue
            p, q = np.nonzero(hit[shape])
            if b is None and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                held.append((oa_rank[i * tile + p], ob_rank[j * tile + q]))
                n += len(p)
        if n > PAIRS:
            parent, held, n = _settle(parent, *map(np.concatenate, zip(*held))), [], 0
    if held:
        parent = _settle(parent, *map(np.concatenate, zip(*held)))
    members = np.nonzero(parent != np.arange(len(nodes)))[0]
    return nodes[members], nodes[parent[members]]


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect exactly those fingerprints of ``nodes`` (fp, distinct) that chains of links connect."""
    spark = nodes.sparkSession
    n, cores = nodes.count(), parallelism(spark)
    # enough blocks to occupy the cores, unless there is little to do, and none beyond its bound
    g = max(1, math.ceil(n / block), min(math.ceil(math.sqrt(2 * cores)), n // 8192))
    b = F.pmod(F.xxhash64("fp"), F.lit(g)).cast("int")
    # few cells are cut into strips, so that each core has several tasks and no task is a long one
    strips = min(STRIPS, math.ceil(8 * cores / (g * (g + 1))))
    # in a fixed order, so that all strips of a cell see the same tiles
    packed = nodes.groupBy(b.alias("b")).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda j: F.least("b", j) * g + F.greatest("b", j))
    pairs = packed.select(F.explode(cells).alias("cell"), F.struct("b", "fps").alias("side")).select("cell", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), "side")
    pairs = pairs.repartition(min(g * (g + 1) * strips, 20_000), "cell", "strip").groupBy("cell", "strip").agg(F.sort_array(F.collect_list("side"))["fps"].alias("sides"))

    def start():
        def step(which, sides):
            out = [cell_links(*([np.array(x, np.int64).view(np.uint64) for x in s] + [None])[:2], radius, TILE, k, strips) for k, s in zip(which, sides)]
            return [np.concatenate([o[k] for o in out]).view(np.int64).tolist() for k in (0, 1)]

        return step

    return arrow_map(pairs, ["strip", "sides"], start, "u long, v long", 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (u, v) with the smallest node of its component, itself included.

    Alternating large-star and small-star steps; each is an aggregation by node and a join, kept as a
    table. The minimum is aggregated before the join, and a hot node's side of the join can be split.
    They end at stars: no node has two smaller neighbours, or a smaller and a greater one.
    """
    now = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # kept, so that adaptive execution can split a hot node's rows: both sides of the join are plain exchanges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.max("v").alias("greatest"))
        least = keep(least.select("u", "m", ((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("greatest") > F.col("u")))).alias("open")), "least")
        if least.filter("open").isEmpty():
            release(least)
            break
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = keep(large, "large")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        after = keep(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        for old in (least, large, now):
            release(old)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def fingerprint_groups(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``nodes`` (fp, distinct, and the least id that has it) as a kept table (fp, grp, component)."""
    labels = components(fingerprint_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    labels = keep(labels, "labels")
    # a group of many fingerprints is one key here, so its rows are salted
    salted = labels.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    groups = labels.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    grouped = salted.join(groups, ["root", "salt"]).select("fp", "root", "component", F.lit(True).alias("linked"))
    named = nodes.join(grouped, "fp", "left")
    named = named.select("fp", F.coalesce("root", "fp").alias("grp"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component"))
    return keep(named, "named")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: (id, fp signed, grp, component). grp is a fingerprint that names the group."""
    prints = keep(with_fingerprints(df, id_col, text_col), "prints")
    nodes = keep(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "nodes")
    named = fingerprint_groups(nodes.select("fp", "least"), radius)
    # rows of hot fingerprints are not shuffled by them: at most HOT names go to every task
    hot = nodes.filter(F.col("rows") > prints.count() / HOT).select("fp")
    often, others = F.broadcast(named.join(hot, "fp", "left_semi")), prints.join(F.broadcast(hot), "fp", "left_anti")
    return prints.join(often, "fp").unionByName(others.join(named, "fp")).select("id", "fp", "grp", "component")


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each group of near duplicates: that of the smallest id, any one if no row has an id.

    An id does not tell rows apart, so rows are numbered where they are kept, and the row that wins its group stays.
    """
    row = f"_row_{uuid.uuid4().hex}"  # no column of the table
    rows = keep(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = keep(with_fingerprints(rows, id_col, text_col, row), "prints")
    # of equal ids that of the smallest fingerprint; a null id comes last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", row))
    best = prints.groupBy("fp").agg(first.alias("first"))
    best = keep(best, "best")
    groups = fingerprint_groups(best.select("fp", F.col("first.id").alias("least")), radius)
    stay = best.join(groups, "fp").groupBy("grp").agg(F.min("first").alias("first")).select(f"first.{row}")
    return rows.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
