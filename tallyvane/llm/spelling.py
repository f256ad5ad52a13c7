"""Spelling variants of a corpus vocabulary by FM-index search with one error."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import as_bytes, col, table

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 after A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Different words a task counts before it sends them on.
FLUSH = 300_000
#: Queries searched at once.
CHUNK = 8192
INDEX = 9


def _drop_at(run: bytes, at: int) -> bytes:
    s = run.decode()
    return (s[:at] + s[at + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str, text_col: str, damage: int, least_length: int) -> DataFrame:
    """(word, n): occurrences of every word, counted in the tasks first.

    Of a run whose CRC-32 with its document's id is divisible by ``damage``, one code point is deleted.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = [(w, n) for w, n in total.items() if len(w) - w.count(b"\xc3") >= least_length]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.binary()).cast(pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for doc, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1))):
                runs = RUN.findall((text or b"").lower())
                seed = crc((doc or b"") + b":")
                hit = {w: crc(w, seed) for w in set(runs) if not crc(w, seed) % damage}
                if hit:
                    hit = {w: _drop_at(w, h % (len(w) - w.count(b"\xc3"))) for w, h in hit.items()}
                    runs = [hit.get(w, w) for w in runs]
                total.update(runs)
                if len(total) > FLUSH:
                    yield rows()
        yield rows()

    texts = docs.select(col(id_col).cast("string").alias("id"), col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """FM-index of sorted different words, each between delimiters.

    Row r < number of words of the suffix order begins with the delimiter before word r. An interval
    of rows holds all suffixes that begin with what was read so far; ``extend`` puts one more
    character in front, for many intervals at once: the sorted (character, row) pairs of the
    Burrows-Wheeler transform give the rank of a character up to a row by binary search.
    """

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, code = np.unique(points, return_inverse=True)
        self.words, n = len(words), len(code)
        # delimiters are all different, in the order of their words, so comparing stops at them
        rank = np.where(code == 0, np.cumsum(code == 0) - 1, self.words + code)
        step = 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[:-step] = rank[step:] + 1
            order = np.argsort(rank * (n + self.words + len(self.alphabet) + 2) + after, kind="stable")
            keys = (rank[order], after[order])
            new = np.cumsum(np.concatenate([[0], (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)]))
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
        self.before = np.where(order > 0, code[order - 1], -1)
        self.n = n
        rows = np.flatnonzero(self.before >= 0)
        pairs = self.before[rows] * n + rows
        pairs.sort()
        self.pairs = pairs

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of words in this index's alphabet (-1 if absent), where each word begins, its length."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1), np.cumsum(lengths) - lengths, lengths

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base, letter = c * self.n, c > 0
        return np.searchsorted(self.pairs, base + lo) + letter, np.searchsorted(self.pairs, base + hi) + letter

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions by a letter that occur: (which interval, letter, lo, hi)."""
        letters = len(self.alphabet)
        wide = hi - lo > letters
        big, small = np.flatnonzero(wide), np.flatnonzero(~wide)
        sizes = (hi - lo)[small]
        which = np.repeat(small, sizes)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[small], sizes)
        seen = np.unique(which * letters + np.maximum(self.before[rows], 0))
        which = np.concatenate([seen // letters, np.repeat(big, letters)])
        c = np.concatenate([seen % letters, np.tile(np.arange(letters), len(big))])
        which, c = which[c > 0], c[c > 0]
        a, b = self.extend(lo[which], hi[which], c)
        live = a < b
        return which[live], c[live], a[live], b[live]

    def near(self, words: list[str], kept: np.ndarray, op: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word of the index) with one error behind the ``kept`` first characters.

        ``words`` and the indexed words run in opposite directions. ``op`` is 0 for a replaced
        character, 1 for one more, -1 for one less; of a run of equal characters only the last one is
        inserted or deleted, so each pair is found once.
        """
        code, start, length = self.codes(words)
        q = np.arange(len(words))
        lo, hi = np.zeros(len(words), dtype=np.int64), np.full(len(words), self.words + 1)
        for step in range(int(kept.max(initial=0))):
            going = step < kept[q]
            lo[going], hi[going] = self.extend(lo[going], hi[going], code[start[q[going]] + step])
            live = lo < hi
            q, lo, hi = q[live], lo[live], hi[live]
        at = kept[q]
        erred: list[tuple] = []
        while len(q):
            inside = at < length[q]
            next_char = np.where(inside, code[np.minimum(start[q] + at, max(len(code) - 1, 0))], -2)
            if op == -1:
                last = np.where(at + 1 < length[q], code[np.minimum(start[q] + at + 1, len(code) - 1)], -2) != next_char
                ok = inside & last
                erred.append((q[ok], at[ok] + 1, lo[ok], hi[ok]))
            else:
                from_, c, a, b = self.children(lo, hi)
                ok = c != next_char[from_]
                if op == 0:
                    ok &= inside[from_]
                from_ = from_[ok]
                erred.append((q[from_], at[from_] + (op == 0), a[ok], b[ok]))
            q, at, lo, hi = q[inside], at[inside], lo[inside], hi[inside]
            lo, hi = self.extend(lo, hi, next_char[inside])
            live = lo < hi
            q, at, lo, hi = q[live], at[live] + 1, lo[live], hi[live]
        q, at, lo, hi = (np.concatenate(x) for x in zip(*erred)) if erred else (np.zeros(0, dtype=np.int64),) * 4
        found: list[tuple] = []
        while len(q):
            ends = at == length[q]
            c = np.where(ends, 0, code[np.minimum(start[q] + at, max(len(code) - 1, 0))])
            lo, hi = self.extend(lo, hi, c)
            live = lo < hi
            found.append((q[ends & live], lo[ends & live]))
            go = live & ~ends
            q, at, lo, hi = q[go], at[go] + 1, lo[go], hi[go]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def _search(rows: pa.Table) -> pa.Table:
    """One shard: per query with a near word (word, n_near, best_n, best)."""
    words, n, op = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("op").to_numpy()
    backward = bool(len(words)) and rows.column("backward")[0].as_py()
    turn = (lambda w: w) if backward else (lambda w: w[::-1])
    own = sorted((turn(words[i]), i) for i in np.flatnonzero(op == INDEX))
    out: list[tuple] = []
    if own:
        index = Index([t for t, _ in own])
        place = np.array([i for _, i in own])
        targets = [words[i] for i in place]
        by_rank = sorted(range(len(own)), key=lambda r: (-n[place[r]], targets[r]))
        rank = np.empty(len(own), dtype=np.int64)
        rank[by_rank] = np.arange(len(own))
        for kind in (-1, 0, 1):
            asked = np.flatnonzero(op == kind)
            for k in range(0, len(asked), CHUNK):
                queries = [words[i] for i in asked[k : k + CHUNK]]
                sizes = np.fromiter(map(len, queries), dtype=np.int64)
                kept = sizes - sizes // 2 if backward else sizes // 2
                q, x = index.near([w[::-1] for w in queries] if backward else queries, kept, kind)
                if backward:  # what also keeps the first half has been found from there
                    heads = [w[: len(w) // 2] for w in queries]
                    new = np.fromiter((not targets[j].startswith(heads[i]) for i, j in zip(q, x)), dtype=bool, count=len(q))
                    q, x = q[new], x[new]
                if len(q):
                    line = np.lexsort((rank[x], q))
                    q, x = q[line], x[line]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0]))
                    counts = np.diff(np.append(first, len(q)))
                    out += [(queries[q[f]], int(c), int(n[place[x[f]]]), targets[x[f]]) for f, c in zip(first, counts)]
    columns = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame, shard_words: int, least_length: int) -> DataFrame:
    """(word, n_near, best) for words (word, n) that have a word at one error; best is (-n, word)."""
    size = F.length("word")
    plans = []
    for backward in (False, True):
        read = F.reverse("word") if backward else F.col("word")
        share = lambda l: F.floor(l / 2) if backward else F.floor((l - 1) / 2)
        for op in (-1, 0, 1, INDEX):
            l = size + (0 if op == INDEX else op)
            bucket = F.xxhash64(F.lit(backward), l, F.substring(read, F.lit(1), share(l).cast("int")))
            plans.append(F.struct(F.lit(backward).alias("backward"), F.lit(op).alias("op"), bucket.alias("bucket"), l.alias("l")))
    sent = vocabulary.select("word", "n", F.explode(F.array(*plans)).alias("p")).select("word", "n", "p.*").filter(F.col("l") >= least_length)
    sent = table(sent, "sent")
    shards = -(-vocabulary.count() // shard_words)
    crowded = table(
        sent.filter(F.col("op") == INDEX).groupBy("bucket").agg(F.count("*").alias("c")).filter(F.col("c") > shard_words).select("bucket", F.ceil(F.col("c") / shard_words).alias("m")), "crowded")
    # a crowded bucket is cut in m parts of words and m of queries, each pair of parts a shard of its own
    own = F.pmod(F.xxhash64("word", F.lit("part")), "m")
    all_parts, index = F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1), F.col("op") == INDEX
    dealt = sent.join(crowded, "bucket", "left").withColumn("m", F.coalesce("m", F.lit(1).cast("bigint")))
    dealt = dealt.withColumn("x", F.explode(F.when(index, F.array(own)).otherwise(all_parts))).withColumn("q", F.explode(F.when(index, all_parts).otherwise(F.array(own))))
    alone = F.col("m") > 1
    dealt = dealt.select("word", "n", "op", "backward", F.when(alone, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(max(shards, 1)))).alias("shard"), alone.alias("alone"), "x", "q")
    keys = ["backward", "alone", "shard", "x", "q"]
    found = dealt.repartition(max(8, 2 * shards), *keys).groupBy(*keys).applyInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed from the last ones down, a step of all words a round.

    A word is the form of few others (those one error away), so no key of the join is hot; a form is
    at least twice as frequent as its word, so rounds grow with the logarithm of the largest count.
    """
    hung = table(forms.filter(F.col("form").isNotNull()).select("word", "form"), "hung")
    level = table(forms.filter(F.col("form").isNull()).select("word", F.col("word").alias("root")), "roots")
    found = level
    while not level.isEmpty():
        level = table(hung.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots")
        found = found.unionByName(level)
    return found


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2, shard_words: int = 32_768,
) -> DataFrame:
    """Operator 13. Per word of the vocabulary: (word, n, n_near, form, form_n, root).

    An error leaves one half of a word as it is. Words are dealt to shards by length and by the
    shared start (or end) that a word of the asked length must have, so a query visits one shard for
    each kind of error and half. A shard indexes its words between delimiters, once read forward and
    once backward: in both, the kept half is matched exactly from its delimiter, then extended across
    the other half with one error, by intervals of suffix ranks. Since halves begin at a delimiter,
    only the interval of the direction of extension is carried. A bucket of more than
    ``shard_words`` words is cut in blocks, words against queries; all are searched.

    Defined cases: null texts have no words; a null id is empty before the colon; words longer than
    any other are kept whole; equal counts go to the smaller word in code-point order; repeated rows
    count again; an empty table gives an empty result; columns other than the two named are not read.
    """
    vocabulary = table(count_words(docs, id_col, text_col, damage, least_length).filter(F.col("n") >= least_count), "vocabulary")
    near = near_words(vocabulary, shard_words, least_length)
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    forms = table(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")),
        "forms",
    )
    return forms.join(roots(forms), "word").select("word", "n", "n_near", "form", "form_n", "root")
