"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.common import as_bytes, col

UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
SYMBOL = b"#*$%&|<>"
HIGH = bytes(range(128, 256))
SHAPES = ("distinct", "adjacent", "upper", "digit", "symbol", "bang", "bar", "high", "lines_again", "word_length", "line_words", "stops", "words")
BINS = 8
#: Slots below this hold statistics, their bins and metadata bins; hashed words come after.
FIRST_WORD = 256


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray  # (slots,)
    factors: np.ndarray  # (slots, rank)

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """Probability of label 1 in time linear in the features.

        The sum over pairs <v_i, v_j> x_i x_j is half of (sum of v x) squared minus the sum of
        (v x) squared, per factor; no pair is formed.
        """
        vx = self.factors[index] * value[:, None]
        pairs = 0.5 * float(np.square(vx.sum(axis=0)).sum() - np.square(vx).sum())
        z = self.bias + float(self.linear[index] @ value) + pairs
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def _shapes(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    size, n = max(1, len(text)), max(1, len(words))
    count = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        distinct / n,
        sum(map(operator.eq, words, words[1:])) / n,
        min(1.0, 2 * count(UPPER)),
        min(1.0, 4 * count(DIGIT)),
        min(1.0, 4 * count(SYMBOL)),
        min(1.0, 4 * text.count(b"!") / size),
        min(1.0, 8 * text.count(b"|") / size),
        min(1.0, 4 * count(HIGH)),
        1.0 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(text) / n / 16),
        min(1.0, n / max(1, len(lines)) / 64),
        min(1.0, 4 * sum(w.endswith(b".") for w in words) / n),
        min(1.0, np.log2(1 + len(words)) / 16),
    ]


def features(text: bytes | None, meta: float | None, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one document, over its whole text.

    Each statistic gives a value and a bin; the metadata number (null: its own slot) a bin of its
    logarithm; each distinct word a slot by CRC-32, the values of all words having length one.
    """
    text = text or b""
    words = text.split()
    distinct = set(words)
    shapes = _shapes(text, words, len(distinct))
    k = len(shapes)
    index = [*range(k), *(k + BINS * i + min(BINS - 1, int(BINS * s)) for i, s in enumerate(shapes))]
    value = [*shapes, *[1.0] * k]
    index.append(FIRST_WORD - 1 if meta is None else FIRST_WORD - 2 - min(40, int(np.log2(1 + max(0.0, meta)))))
    value.append(1.0)
    crc, room = zlib.crc32, slots - FIRST_WORD
    hashed = np.fromiter((crc(w) for w in distinct), dtype=np.int64, count=len(distinct)) % room + FIRST_WORD
    spread = np.full(len(distinct), 1.0 / np.sqrt(max(1, len(distinct))), dtype=np.float32)
    return np.concatenate([np.asarray(index, dtype=np.int64), hashed]), np.concatenate([np.asarray(value, dtype=np.float32), spread])


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, slots: int, rank: int = 8, steps: int = 320, batch: int = 128,
    rate: float = 0.1, decay: float = 1e-4, seed: int = 7,
) -> Model:
    """Logistic loss by ``steps`` AdaGrad mini-batches; without rows every score is one half."""
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(slots), rng.normal(0, 0.02, (slots, rank))
    if not len(rows):
        return Model(0.0, linear.astype(np.float32), np.zeros((slots, rank), dtype=np.float32))
    share = np.clip(labels.mean(), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    seen_b, seen_l, seen_f = 1e-2, np.full(slots, 1e-2), np.full((slots, rank), 1e-2)
    per_pass = -(-len(rows) // batch)
    for _ in range(-(-steps // per_pass)):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            chosen = order[at : at + batch]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen]).astype(np.float64)
            sizes = np.array([len(rows[i][0]) for i in chosen])
            starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(chosen)), sizes)
            vx = factors[index] * value[:, None]
            total = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(linear[index] * value, starts) + 0.5 * (np.square(total).sum(1) - np.add.reduceat(np.square(vx).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            slot, back = np.unique(index, return_inverse=True)
            ex = error[owner] * value
            g = np.bincount(back, ex) + decay * linear[slot]
            grad = ex[:, None] * (total[owner] - vx)
            gf = np.stack([np.bincount(back, grad[:, f]) for f in range(rank)], axis=1) + decay * factors[slot]
            seen_b += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(seen_b)
            seen_l[slot] += g**2
            linear[slot] -= rate * g / np.sqrt(seen_l[slot])
            seen_f[slot] += gf**2
            factors[slot] -= rate * gf / np.sqrt(seen_f[slot])
    return Model(bias, linear.astype(np.float32), factors.astype(np.float32))


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(col(id_col).cast("string")) % 4 == 2


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", label_col: str = "quality",
    max_rows: int = 8_000, slots: int = 1 << 16, rank: int = 8,
) -> Model:
    """Model learned from at most ``max_rows`` labelled documents that are not held out.

    The sample is the labelled ids with the smallest hashes, with one row each; only features of
    these rows reach the driver. An id labelled more than once counts with its smallest label;
    null ids and labels are ignored; of the rows that share an id the one whose text has the
    smallest hash teaches, so no id weighs more than another.
    """
    known = (
        labels.filter(col(id_col).isNotNull() & col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(col(id_col).alias("_id")).agg(F.min(col(label_col)).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    meta = col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")
    chosen = df.select(col(id_col).alias("_id"), col(text_col).cast("string").alias("_text"), meta.alias("_meta")).join(F.broadcast(known), "_id")
    chosen = chosen.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text", "_meta")).alias("row")).select("_id", "_y", "row._text", "row._meta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t, m, slots) for t, m in zip(as_bytes(b.column("_text")), b.column("_meta").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").cast(pa.string()), b.column("_y"), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                ["id", "y", "slot", "value"],
            )

    got = chosen.mapInArrow(run, "id string, y double, slot binary, value binary").collect()
    got.sort(key=lambda r: (zlib.crc32(r.id.encode()), r.id, bytes(r.slot)))
    rows = [(np.frombuffer(r.slot, dtype=np.int64), np.frombuffer(r.value, dtype=np.float32)) for r in got]
    return train(rows, np.array([r.y for r in got]), slots, rank)


def scored(df: DataFrame, model: Model, text_col: str = "text", meta_col: str | None = "n_chars", score_col: str = "score") -> DataFrame:
    """Every row of ``df`` with all its columns and ``score_col``; one pass, no shuffle.

    ``score_col`` must not be a column of ``df``.
    """
    if score_col in df.columns:
        raise ValueError(f"{score_col} is a column already")
    slots = len(model.linear)
    schema = T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = b.column(meta_col).to_pylist() if meta_col else [None] * len(b)
            found = [model.score(*features(t, None if m is None else float(m), slots)) for t, m in zip(as_bytes(b.column(text_col)), meta, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, score_col])

    return df.mapInArrow(run, schema)


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", label_col: str = "quality",
    threshold: float = 0.7, **options,
) -> DataFrame:
    """Operator 1. Per document: id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Defined cases: a null or empty text is scored by its statistics and metadata, as any text; a
    null metadata number has a slot of its own; a null id is not held out; repeated rows are each
    scored; a document's score depends on its text and metadata alone; an empty table gives an
    empty result; without usable labels every score is one half. Columns other than those named
    are not read.
    """
    model = fit(df, labels, id_col, text_col, meta_col, label_col, **options)
    needed = df.select(*[col(c) for c in dict.fromkeys([id_col, text_col, *([meta_col] if meta_col else [])])])
    return scored(needed, model, text_col, meta_col, "_score").select(
        col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )
