"""Packing of documents into fixed-length token sequences: first-fit decreasing by tournament tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import col, table
from tallyvane.llm.encoders import AddedEncoder, rank_encoder

PIECES = "row_id long, doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long{ids}"


class Tournament:
    """Leftmost bin with room, over bins of equal capacity, in logarithmic time.

    A complete binary tree; each inner node holds the larger room of its two children, as the
    winner of a match, so the descent always knows whether the left half has a bin that fits.
    """

    def __init__(self, n_bins: int, capacity: int):
        self.width = 1 << max(0, (n_bins - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """Bin and the room it had before; there is always an empty bin left."""
        room, i = self.room, 1
        while i < self.width:
            i = 2 * i if room[2 * i] >= size else 2 * i + 1
        had = room[i]
        room[i] = had - size
        at = i
        while at > 1:
            at >>= 1
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return i - self.width, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size. Larger first; equal sizes in the order given."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    tree = Tournament(max(1, len(sizes)), capacity)
    for i in order:
        bins[i], had = tree.place(sizes[i])
        offsets[i] = capacity - had
    return bins, offsets


def cut(df: DataFrame, id_col: str, text_col: str, ranks: str, pattern: str, end_id: int, length: int, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of each document: full sequences from its start, then the rest.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. One pass over
    the texts without a shuffle; only lengths and checksums leave it unless ``with_ids``.
    """
    kind = dict(df.dtypes)[id_col]
    schema = PIECES.format(id=kind, ids=", ids binary" if with_ids else "")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = AddedEncoder(rank_encoder(ranks, pattern), added or {})
        for batch in batches:
            at, start, size, crc, total, own = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                data = encode(text.as_py() or "") + end
                n = len(data) // 4
                for s in range(0, n, length):
                    part = data[4 * s : 4 * (s + length)]
                    at.append(i)
                    start.append(s)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        own.append(part)
            take = pa.array(at, pa.int64())
            cols = [batch.column("row_id").take(take), batch.column("doc_id").take(take), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
            names = ["row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(own, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = df.select(F.monotonically_increasing_id().alias("row_id"), col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pack(
    df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1,
    group_size: int = 2048, seed: int = 42, with_ids: bool = False, added: dict[str, int] | None = None,
) -> DataFrame:
    """Operator 10. Documents packed into sequences of at most ``length`` tokens.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with ``ids`` as
    little-endian 32-bit integers if asked for). Documents are cut into full sequences and a
    rest; the rests are dealt at random into groups of about ``group_size`` and each group is
    packed on its own, largest first, each into the first sequence with room, found by a
    tournament tree of the rooms left. Groups depend on a hash of the row's number, so a source,
    key or set of copies that owns a third of the rows is spread like any other; a group's size
    does not grow with the input, only the number of groups does. Strings of ``added`` tokens in a
    text become their ids, as ``tokenizers`` does by default; without it they are ordinary text.

    Defined cases: null and empty texts are one piece with ``end_id`` alone; a null or repeated
    doc_id changes nothing, each row is packed as a document of its own; equal lengths go in row
    order; a text that needs many sequences yields as many full pieces; an empty table gives an
    empty result; columns other than the two named are not read.
    """
    if length < 1 or group_size < 1:
        raise ValueError("length and group_size must be positive")
    pieces = table(cut(df, id_col, text_col, ranks, pattern, end_id, length, with_ids, added), "pieces")
    n_groups = max(1, -(-pieces.count() // group_size))
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_id", "start"], ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].tolist(), length)
        rows["sequence_id"] = np.asarray(bins, dtype=np.int64) + rows["pack_group"].to_numpy(np.int64) * (1 << 32)
        rows["offset"] = offsets
        return rows[names]

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row_id", "start", F.lit(seed)), F.lit(n_groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, schema)
