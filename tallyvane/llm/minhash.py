"""Near-duplicates by SuperMinHash: signatures, banding, exact verification, union of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import GOLDEN, as_bytes, col, components, mix, signed, table, window_hashes, word_hashes, words_of

CHUNK = 4096


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; A-Z count as a-z.

    With fewer than ``width`` words the whole sequence is the one shingle; without words: empty.
    """
    words = words_of(text.lower() if text else text)  # bytes.lower changes A-Z only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        return mix(window_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(hashes, width))


def super_minhash(items: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signature: ``size`` values, the same for equal sets.

    Each element shuffles the positions on its own, step by step. At step j it offers j plus a
    random fraction to the position the shuffle put at place j, and each position keeps the lowest
    offer. So an element's offers are correlated, every position gets one from each element, and
    the estimate varies less than with independent hashes. Offers of a step are above all of the
    steps before: once the highest value kept is below j, no later offer matters and the element
    stops. All elements of a chunk take a step at once.
    """
    kept = np.full(size, np.inf)
    for at in range(0, len(items), CHUNK):
        own = items[at : at + CHUNK]
        place = np.tile(np.arange(size, dtype=np.int16), (len(own), 1))
        row = np.arange(len(own))
        j = 0
        while j < size and kept.max() >= j:
            with np.errstate(over="ignore"):
                rnd = mix(own + np.uint64(j + 1) * GOLDEN)
            k = j + ((rnd & np.uint64(0xFFFFFFFF)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
            target = place[row, k]
            place[row, k] = place[:, j]
            place[:, j] = target
            np.minimum.at(kept, target, j + (rnd >> np.uint64(32)).astype(np.float64) / 2.0**32)
            j += 1
    return kept


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; the band's number is part of the key."""
    parts = signature.view(np.uint64).reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, len(parts) + 1, dtype=np.uint64) * GOLDEN
        for i in range(rows):
            key = mix(key + parts[:, i])
    return key


def read_sets(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, place (64 bits of id and text), size of its set, class key (128 bits of the whole set) and band keys."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, found = [], [], []
            for text in as_bytes(b.column("text")):
                own = shingle_set(text, width)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                found.append(signed(band_keys(super_minhash(own, bands * rows), rows)) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("place"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "place", "n", "cls", "bands"]
            )

    return table(_placed(df, id_col, text_col).mapInArrow(run, f"id {kind}, place long, n long, cls binary, bands array<long>"), "sets")


def _placed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and place of every row: the place is never null and differs for the texts of one id."""
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("place"), "text")


def _sets_of(df: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """Whole shingle sets of the classes in ``wanted`` (cls, id of a document that has it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # rows that repeat id and text bring the same set again
        for b in batches:
            keys, sets = [], []
            for cls, text in zip(b.column("cls").to_pylist(), as_bytes(b.column("text")), strict=True):
                own = shingle_set(text, width) if cls not in done else None
                # an id that several texts share may bring other sets along
                if own is not None and xxhash.xxh3_128_digest(own.tobytes()) == cls:
                    done.add(cls)
                    keys.append(cls)
                    sets.append(signed(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "items"])

    texts = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    right = table(texts.join(wanted, "id").mapInArrow(run, "cls binary, items array<long>"), "items")
    return right.groupBy("cls").agg(F.any_value("items").alias("items")) if _repeats(right) else right


def _repeats(sets: DataFrame) -> bool:
    return not sets.groupBy("cls").count().filter("count > 1").isEmpty()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose whole sets reach the similarity."""
    left, right = sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("t")).filter(100 * F.col("s") >= percent * (F.col("t") - F.col("s"))).select("a", "b")


def _joined(comp: DataFrame, linked: DataFrame) -> DataFrame:
    """(cls, comp) after the components that ``linked`` (a, b) connects became one."""
    ends = linked.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b")
    moved = table(components(ends.select("ca", "cb"), "ca", "cb").select(F.col("id").alias("comp"), F.col("comp").alias("to")), "moved")
    return table(comp.join(moved, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")), "comp")


def _led(state: DataFrame, percent: int, seeds: range) -> DataFrame:
    """Pairs (a, b) of a class and the leaders, one per seed, that stand first among its buckets'."""
    lead = lambda i: F.min(F.struct(F.xxhash64("cls", F.lit(i)).alias("o"), "cls", "comp", "n")).alias(f"l{i}")
    mixed = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *[lead(i) for i in seeds]).filter(F.col("lo") != F.col("hi"))
    met = state.join(table(mixed.drop("lo", "hi"), "mixed"), "key")
    fits = lambda i: (F.col("comp") != F.col(f"l{i}.comp")) & (100 * F.least("n", f"l{i}.n") >= percent * F.greatest("n", f"l{i}.n"))
    best = met.groupBy("cls").agg(*[F.min(F.when(fits(i), F.struct(f"l{i}.o", f"l{i}.cls"))).alias(f"l{i}") for i in seeds])
    pairs = best.select("cls", F.explode(F.array(*[F.col(f"l{i}.cls") for i in seeds])).alias("other")).filter("other is not null")
    return table(pairs.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct(), "pairs")


def _bucket_links(key: int, x: list[int], y: list[int], rows: dict, percent: int) -> list[tuple[int, int]]:
    """Links between the members ``x`` and ``y`` of a bucket that lie in different components.

    A pair is taken only in the first bucket it shares, and of the links of one member to one
    component a single one is given.
    """
    comp, stray, order, bands, items = rows["comp"], rows["stray"], rows["order"], rows["bands"], rows["items"]
    vocabulary, codes = np.unique(np.concatenate([items[i] for i in y]), return_inverse=True)
    size = np.array([len(items[i]) for i in y])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    comp_y, stray_y, order_y, bands_y = comp[y], stray[y], order[y], bands[y]
    out = []
    for i in x:
        may = (comp_y != comp[i]) & (~stray_y | (order_y > order[i]))
        may &= (100 * np.minimum(size, len(items[i])) >= percent * np.maximum(size, len(items[i])))
        if not may.any():
            continue
        shared = bands_y == bands[i]
        may &= bands[i][shared.argmax(axis=1)] == key
        if not may.any():
            continue
        have = np.zeros(len(vocabulary), dtype=np.int64)
        have[np.searchsorted(vocabulary, np.intersect1d(vocabulary, items[i], assume_unique=True))] = 1
        both = np.add.reduceat(have[codes], starts)
        good = np.flatnonzero(may & (100 * both >= percent * (size + len(items[i]) - both)))
        out += [(i, y[j]) for j in good[np.unique(comp_y[good], return_index=True)[1]]]
    return out


def _rest(state: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, part_items: int) -> DataFrame:
    """Links (a, b) among members of one bucket that are still in different components.

    The members outside a bucket's largest component are compared with all its members, inside
    tasks. Both sides are cut into parts of about ``part_items`` shingles, and each pair of parts
    is one unit of work, so no unit grows with its bucket.
    """
    mixed = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(F.col("lo") != F.col("hi")).select("key")
    open_ones = table(state.join(mixed, "key"), "open")
    weights = open_ones.groupBy("key", "comp").agg(F.sum("n").alias("w"))
    parts = lambda w: F.greatest(F.lit(1), F.ceil(w / part_items)).cast("int")
    buckets = weights.groupBy("key").agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("w"))
    buckets = table(buckets.select("key", F.col("top.comp").alias("major"), parts(F.col("w")).alias("all_parts"), parts(F.col("w") - F.col("top.w")).alias("stray_parts"), "w"), "buckets")
    placed = open_ones.join(buckets.drop("w"), "key").withColumn("stray", F.col("comp") != F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = placed.filter("stray").withColumn("i", own("stray_parts")).select("key", "cls", "comp", "stray", F.lit(True).alias("asks"), "i", each("all_parts").alias("j"))
    y = placed.withColumn("j", own("all_parts")).select("key", "cls", "comp", "stray", F.lit(False).alias("asks"), each("stray_parts").alias("i"), "j")
    total = buckets.agg(F.coalesce(F.sum(F.col("w") * F.col("stray_parts")), F.lit(0))).first()[0]
    units = x.unionByName(y).withColumn("unit", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-int(total) // part_items)))))
    full = units.join(sets.join(classes.select("cls", "bands"), "cls"), "cls")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("cls", "ascending")])
        cls = group["cls"].to_pylist()
        code = {c: k for k, c in enumerate(sorted({*cls}))}
        comps = {c: k for k, c in enumerate(sorted({*group["comp"].to_pylist()}))}
        flat = group["items"].combine_chunks()
        values, offsets = np.asarray(flat.values), np.asarray(flat.offsets)
        rows = {
            "comp": np.array([comps[c] for c in group["comp"].to_pylist()]), "stray": group["stray"].to_numpy().astype(bool), "order": np.array([code[c] for c in cls]),
            "bands": np.stack([np.asarray(v.values) for v in group["bands"]]), "items": [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])],
        }
        asks = group["asks"].to_numpy().astype(bool)
        spot = np.stack([group[c].to_numpy() for c in ("key", "i", "j")], axis=1)
        cuts = np.flatnonzero((np.diff(spot, axis=0) != 0).any(axis=1)) + 1
        found = []
        for a, b in zip([0, *cuts], [*cuts, len(spot)]):
            at = np.arange(a, b)
            x, y = at[asks[a:b]].tolist(), at[~asks[a:b]].tolist()
            if x and y:
                found += _bucket_links(spot[a, 0], x, y, rows, percent)
        return pa.table({"a": pa.array([cls[i] for i, _ in found], pa.binary()), "b": pa.array([cls[j] for _, j in found], pa.binary())})

    return table(full.groupBy("unit").applyInArrow(run, "a binary, b binary"), "rest")


def link(classes: DataFrame, sets_for, percent: int, rounds: int = 2, leaders: int = 4, part_items: int = 500_000) -> DataFrame:
    """Component of every class that shares a band key with another: (cls, comp).

    ``classes`` has cls, id, n and bands; ``sets_for(wanted)`` gives the sets to verify with. A
    bucket never becomes all its pairs. In each of ``rounds`` leader rounds a class is compared
    with ``leaders`` others at most: among its buckets' leaders outside its own component, the
    first in as many pseudo-random orders. Groups of near copies collapse by that. Then the members
    of a bucket outside its largest component are compared with the others inside tasks. So two
    classes in a bucket end in one component or have been compared: no link among candidates is
    lost.
    """
    keyed = classes.select("cls", "id", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    live = table(keyed.join(shared, "key").select("key", "cls", "id", "n"), "live")
    sets = sets_for(live.select("cls", "id").distinct())
    live = live.drop("id")
    comp = table(live.select("cls", F.col("cls").alias("comp")).distinct(), "comp")
    for i in range(rounds):
        pairs = _led(live.join(comp, "cls"), percent, range(i * leaders, (i + 1) * leaders))
        comp = _joined(comp, table(_verified(pairs, sets, percent), "linked"))
    return _joined(comp, _rest(live.join(comp, "cls"), classes, sets, percent, part_items))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, bands: int = 40, rows: int = 6, rounds: int = 2,
) -> DataFrame:
    """Operator 8. Per row: id, n_shingles, component_id (smallest id reachable), kept.

    Documents with equal sets form a class before any comparison, so copies are never paired.
    Classes are linked when 100 * intersection >= ``percent`` * union of their whole sets. With 40
    bands of 6 values of a SuperMinHash signature, a pair at similarity 0.8 shares no band with
    probability 5e-6, one further apart is rarely compared. Band keys are counted before they are
    joined, hot buckets are joined as plain exchanges that Spark splits, and the components are
    found by distributed stars.

    Defined cases: null and empty texts have an empty set and link with nothing; a null id links
    through its text like any other, does not count as the smallest, and is kept only if no other
    row of its component has an id; a repeated id with equal texts is one document twice (both
    rows kept or dropped alike), with different texts each row belongs to its own text's
    component; ties cannot occur, as the smallest id decides; an empty table gives an empty
    result; columns other than the two named are not read.
    """
    sets = read_sets(df, id_col, text_col, width, bands, rows)
    classes = table(
        sets.filter("cls is not null").groupBy("cls")
        .agg(F.min("id").alias("id"), F.min("place").alias("place"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes"
    )
    # sets are fetched by place: a null id has one too, and an id of many texts brings only the text asked for
    texts = _placed(df, id_col, text_col)
    comp = link(classes.select("cls", F.col("place").alias("id"), "n", "bands"), lambda wanted: _sets_of(texts, "place", "text", width, wanted), percent, rounds)
    named = classes.join(comp, "cls", "left").select("cls", "id", F.coalesce("comp", "cls").alias("comp"))
    lowest = table(named.groupBy("comp").agg(F.min("id").alias("component_id")), "lowest")
    by_class = table(named.join(lowest, "comp").select("cls", "component_id"), "by_class")
    # rows without a set keep their own id; a key of their own spares the join a hot null
    placed = sets.filter("cls is not null").select("id", "n", "cls").join(by_class, "cls").select("id", "n", "component_id")
    alone = sets.filter("cls is null").select("id", "n", F.col("id").alias("component_id"))
    return placed.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )
