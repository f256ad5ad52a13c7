"""Embedding near-duplicates: a subspace pigeonhole join over blocks of rotated vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import col, components, table

TILE, WIDE = 512, 4096
#: Share of a tile's pairs from which on it is verified as one matrix product.
DENSE = 0.02
SLACK = 1e-6
#: Far above the error of a squared distance in single precision.
ROUGH = 1e-4


def rotate(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors turned by random signs and a Hadamard transform, then shuffled.

    The transform is orthogonal, so all distances stay, and it spreads what a few coordinates
    hold over all of them. Lengths that are no power of two are filled with zeros first.
    """
    n, d = vectors.shape
    width = 1 << max(0, (d - 1).bit_length())
    rng = np.random.default_rng(seed)
    signs, order = rng.choice([-1.0, 1.0], width), rng.permutation(width)
    out = np.zeros((n, width))
    out[:, :d] = vectors / np.sqrt(np.square(vectors).sum(axis=1))[:, None]
    out *= signs
    h = 1
    while h < width:
        pair = out.reshape(n, -1, 2, h)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return out[:, order] / np.sqrt(width)


def read_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, cls, vec): vec as doubles, cls a 128-bit key of them; both null where nothing can link."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs = [], []
            for value in b.column("vec"):
                v = value.as_py()
                x = np.asarray(v, dtype=np.float64) if v and None not in v else None
                data = x.tobytes() if x is not None and np.isfinite(x).all() and np.square(x).sum() > 0 else None
                vecs.append(data)
                keys.append(xxhash.xxh3_128_digest(data) if data else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "cls", "vec"])

    rows = df.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"id {kind}, cls binary, vec binary")


def reach_of(dim: int, blocks: int, cosine: float) -> float:
    """How far apart two linked vectors of ``dim`` components can lie in the block with the largest share."""
    blocks = min(blocks, dim)
    widest = -(-dim // blocks) / dim
    return float(np.sqrt((2 - 2 * cosine) * widest * (1 + SLACK) + SLACK))


def deal(classes: DataFrame, blocks: int, cosine: float, chunk: int, seed: int) -> DataFrame:
    """Rows of the range joins: (block, strip, c1, c2, chunk, home, cid, copies, vec).

    In each block a vector lives in the strip of its first coordinate and visits the next one if
    a partner may live there. A strip is compared in chunks, each pair of chunks in one group, so
    the size of a group does not depend on how many vectors fall in a strip.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("cid", "dim", "block", "strip", "home")}
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(b.column("vec")):
                by_dim.setdefault(len(v.as_py()) // 8, []).append(i)
            cids = b.column("cid").to_pylist()
            for dim, at in by_dim.items():
                turned = rotate(np.stack([np.frombuffer(b.column("vec")[i].as_py()) for i in at]), seed)
                reach = reach_of(turned.shape[1], blocks, cosine)
                width = 2 * reach
                for k in range(min(blocks, turned.shape[1])):
                    first = turned[:, k * turned.shape[1] // min(blocks, turned.shape[1])]
                    strip = np.floor(first / width).astype(int)
                    visit = first + reach * (1 + 1e-9) >= (strip + 1) * width
                    for j, i in enumerate(at):
                        for s, home in ((strip[j], True), (strip[j] + 1, False))[: 1 + bool(visit[j])]:
                            for name, x in zip(out, (cids[i], dim, k, int(s), home), strict=True):
                                out[name].append(x)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()), strict=True)})

    placed = table(classes.select("cid", "vec").mapInArrow(run, "cid long, dim int, block int, strip int, home boolean"), "strips")
    keys = ["dim", "block", "strip"]
    sizes = table(placed.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / chunk)).cast("int").alias("chunks")), "strip_sizes")
    own = placed.join(sizes, keys).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    pairs = own.select(*keys, "home", "cid", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    return pairs.select(*keys, F.least("chunk", "o").alias("c1"), F.greatest("chunk", "o").alias("c2"), "chunk", "home", "cid").join(classes.select("cid", "copies", "vec"), "cid")


def _stars(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Lowest node of the component of each of ``n`` nodes, by links (rows[i], cols[i])."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, rows, label[cols])
        np.minimum.at(low, cols, low[rows])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def compare(vecs: np.ndarray, home: np.ndarray, copies: np.ndarray, first: np.ndarray, second: np.ndarray, block: int, blocks: int, cosine: float, seed: int):
    """Links between the rows ``first`` and ``second`` that this block is the one to report.

    A pair within the whole squared-distance budget is within the block's share of it in some
    block; it is taken in the first such block only, then verified by its cosine in doubles.
    Gives links by row and, per tile, star links that keep every component together.
    """
    turned = rotate(vecs, seed)
    width, budget = turned.shape[1], 2 - 2 * cosine
    blocks = min(blocks, width)
    edges = [k * width // blocks for k in range(blocks + 1)]
    share = [budget * (edges[k + 1] - edges[k]) / width * (1 + SLACK) + SLACK for k in range(blocks)]
    unit = vecs / np.sqrt(np.square(vecs).sum(axis=1))[:, None]
    part = [turned[:, edges[k] : edges[k + 1]] for k in range(block + 1)]
    norm = [np.square(p).sum(axis=1) for p in part]
    # one product gives all squared distances of a tile; single precision only sorts out
    one = np.ones(len(vecs))
    left = np.column_stack([part[block], norm[block], one]).astype(np.float32)
    right = np.column_stack([-2 * part[block], one, norm[block]]).astype(np.float32)
    degree, stars = np.zeros(len(vecs), dtype=np.int64), []
    same = first is second or np.array_equal(first, second)
    tiles = [(first[s : s + TILE], second[t : t + WIDE]) for s in range(0, len(first), TILE) for t in range(s // WIDE * WIDE if same else 0, len(second), WIDE)]
    for a, b in tiles:
        mask = left[a] @ right[b].T <= share[block] + ROUGH
        n = np.count_nonzero(mask)
        if not n:
            continue
        if n > DENSE * mask.size:
            near = lambda k: norm[k][a][:, None] + norm[k][b][None, :] - 2 * (part[k][a] @ part[k][b].T) <= share[k]
            mask &= near(block)
            mask &= home[a][:, None] | home[b][None, :]
            if same:
                mask &= a[:, None] < b[None, :]
            for k in range(block):
                mask &= ~near(k)
            mask &= unit[a] @ unit[b].T >= cosine
            i, j = np.nonzero(mask)
        else:
            i, j = np.nonzero(mask)
            keep = np.zeros(len(i), dtype=bool)
            for s in range(0, len(i), 1 << 16):
                x, y = a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]]
                apart = lambda k: norm[k][x] + norm[k][y] - 2 * np.einsum("ij,ij->i", part[k][x], part[k][y])
                good = (np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine) & (home[x] | home[y]) & (apart(block) <= share[block])
                if same:
                    good &= x < y
                for k in range(block):
                    good &= apart(k) > share[k]
                keep[s : s + (1 << 16)] = good
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        x, y = a[i], b[j]
        degree += np.bincount(x, copies[y], len(vecs)).astype(np.int64) + np.bincount(y, copies[x], len(vecs)).astype(np.int64)
        node, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        low = _stars(back[: len(x)], back[len(x) :], len(node))
        stars.append(np.stack([node, node[low]], axis=1)[low != np.arange(len(node))])
    return degree, np.concatenate(stars) if stars else np.zeros((0, 2), dtype=np.int64)


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, blocks: int = 4, chunk: int = 16_384, seed: int = 11
) -> DataFrame:
    """Operator 5. Per row: id, n_links, component_id (smallest id reachable), kept.

    Unit vectors with a cosine of ``cosine`` are no further apart than 2 - 2 * cosine squared.
    Rotated vectors are split into ``blocks``, the budget is shared out in proportion to their
    dimensions, each block is range-joined under its share, and the union of the candidates is
    verified exactly; no pair is missed. Equal vectors are one class with a count. Pairs are
    compared in chunks inside tasks: links are counted per vector and reduced to star links
    there, so neither candidates nor links are ever rows.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different lengths do not link; a null id counts as a vector with
    links, is not the smallest id, and is kept only if its component has no id; rows with a
    repeated id are vectors of their own; an empty table gives an empty result; columns other
    than the two named are not read.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows = table(read_vectors(df, id_col, vector_col), "vectors")
    folded = rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
    classes = table(folded.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")

    def run(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        vecs = np.stack([np.frombuffer(v.as_py()) for v in group["vec"]])
        cid, copies, chunk_of, home = (group[c].to_numpy() for c in ("cid", "copies", "chunk", "home"))
        c1, c2 = group["c1"][0].as_py(), group["c2"][0].as_py()
        first, second = np.flatnonzero(chunk_of == c1), np.flatnonzero(chunk_of == c2)
        degree, stars = compare(vecs, home.astype(bool), copies, first, first if c1 == c2 else second, block, blocks, cosine, seed)
        at = np.flatnonzero(degree)
        a, b, d = np.concatenate([cid[at], cid[stars[:, 0]]]), np.concatenate([cid[at], cid[stars[:, 1]]]), np.concatenate([degree[at], np.zeros(len(stars), dtype=np.int64)])
        return pa.table({"a": a, "b": b, "links": d})

    dealt = deal(classes, blocks, cosine, chunk, seed).groupBy("dim", "block", "strip", "c1", "c2")
    found = table(dealt.applyInArrow(run, "a long, b long, links long"), "found")
    comp = components(found.filter("a <> b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).filter("links > 0").select(F.col("a").alias("cid"), "links")
    named = table(
        classes.select("cid", "cls", "id", "copies").join(comp.select(F.col("id").alias("cid"), "comp"), "cid", "left").join(links, "cid", "left")
        .select("cls", "id", F.coalesce("comp", "cid").alias("comp"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named",
    )
    lowest = table(named.groupBy("comp").agg(F.min("id").alias("component_id")), "lowest")
    by_class = table(named.join(lowest, "comp").select("cls", "n_links", "component_id"), "by_class")
    placed = rows.filter("cls is not null").select("id", "cls").join(by_class, "cls").select("id", "n_links", "component_id")
    alone = rows.filter("cls is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return placed.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
