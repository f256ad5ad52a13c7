"""WARC archives with a two-level capture index: compressed sorted blocks and a sparse directory."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import col, table
from tallyvane.llm.url_rules import host_of
from tallyvane.storage import scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
GAP = 1 << 16


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


# ---- records --------------------------------------------------------------------

def _plain(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member of its own: a response with its payload, or a revisit without."""
    payload, revisit = page["payload"], page["record_type"] == "revisit"
    urn = lambda *x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(x))}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {page['record_type']}", f"WARC-Record-ID: {urn(page['page_id'], page['digest'])}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{page['digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"X-Page: {json.dumps(page['page_id'])}",
    ]
    if page["url"] is not None:
        lines.append(f"WARC-Target-URI: {_plain(page['url'])}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(page['refers_to'], page['digest'])}", f"X-Refers-To-Page: {json.dumps(page['refers_to'])}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(member: bytes) -> dict:
    """Fields of a record; the digest of a response is computed from the payload and compared."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/") or rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": json.loads(fields["X-Page"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": json.loads(fields.get("X-Refers-To-Page", "null")), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def surt(url: Column) -> Column:
    """Sort key: host parts from last to first, ``)``, and what follows the host; null: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), rest)
    return F.when(F.coalesce(url, F.lit("")).contains("://"), key).otherwise(F.coalesce(url, F.lit("")))


# ---- writing --------------------------------------------------------------------

def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Pages with their payload, digest, record_type and refers_to.

    The smallest id per digest comes from a map-side combined minimum that is written first, so
    the join that follows has plain exchanges on both sides and Spark splits a hot payload.
    """
    text = F.coalesce(col(html_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), F.encode(text, "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = rows.join(table(first.select("digest", "first"), "first"), "digest", "left")
    later = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return both.select("page_id", "url", "payload", "digest", F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"))


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Archives in ``folder``, a record per row; returns (surt, page_id, file, offset, length).

    A task writes files under names of its own and reports them only when it ends well, so a
    repeated task leaves files that nothing refers to and no damage.
    """
    kind = dict(decided.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows, files, offsets, lengths = b.to_pylist(), [], [], []
            for page in rows:
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page)
                out.write(data)
                files.append(name)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [b.column("surt"), b.column("page_id"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["surt", "page_id", "file", "offset", "length"]
            )
        if out is not None:
            out.close()

    rows = decided.select("page_id", "url", "payload", "digest", "record_type", "refers_to", surt(F.col("url")).alias("surt"))
    return table(rows.mapInArrow(run, f"surt string, page_id {kind}, file string, offset long, length long"), "captures")


# ---- index ----------------------------------------------------------------------

def _key(row: dict) -> tuple[str, int, int]:
    """Order of the index: key, then id, nulls first."""
    return row["surt"].encode(), row["page_id"] is not None, row["page_id"] or 0


def write_index(captures: DataFrame, folder: str, per_file: int, per_block: int) -> DataFrame:
    """Index files in ``folder``; returns a row per file: first and last key, blocks.

    Lines sorted by reversed host and id are cut into blocks of ``per_block`` and compressed each
    by itself. The directory of a file holds each block's first key, offset and length; it is
    written behind the blocks, and its place ends the file.
    """
    spark = captures.sparkSession
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name, out, at, directory, lines, last = f"{uuid.uuid4().hex}.cdx", None, 0, [], [], None

        def flush() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(data)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            at, lines = at + len(data), []

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                lines.append([r["surt"], r["page_id"], r["file"], r["offset"], r["length"]])
                last = r
                if len(lines) == per_block:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        data = zlib.compress(json.dumps(directory).encode())
        out.write(data + len(data).to_bytes(8, "little"))
        out.close()
        row = {"name": [name], "size": [at + len(data) + 8], "first": [json.dumps(directory[0][:2])], "last": [json.dumps([last["surt"], last["page_id"]])], "blocks": [len(directory)]}
        yield pa.RecordBatch.from_pydict(row)

    ordered = captures.repartitionByRange(n_files, "surt", "page_id", "file", "offset").sortWithinPartitions("surt", "page_id", "file", "offset")
    return table(ordered.mapInArrow(run, "name string, size long, first string, last string, blocks long"), "index_files")


class Index:
    """Lookups by binary search: file by its range, block by the directory, line in the block.

    The list of files has one entry per two million captures; a directory and a block are read by
    range when a key needs them, and kept while keys stay within them.
    """

    def __init__(self, store: pafs.FileSystem, base: str, files: list[dict]):
        key = lambda text: _key(dict(zip(("surt", "page_id"), json.loads(text), strict=True)))
        self.store, self.base = store, base
        self.files = sorted((key(f["first"]), key(f["last"]), f["name"], f["size"]) for f in files)
        self.lasts = [f[1] for f in self.files]
        self.loaded: dict[str, tuple] = {}

    def _directory(self, name: str, size: int) -> tuple:
        if name not in self.loaded:
            source = self.store.open_input_file(f"{self.base}/{name}")
            n = int.from_bytes(source.read_at(8, size - 8), "little")
            rows = json.loads(zlib.decompress(source.read_at(n, size - 8 - n)))
            self.loaded = {name: (source, [_key({"surt": a, "page_id": b}) for a, b, _, _ in rows], [(o, k) for _, _, o, k in rows], {})}
        return self.loaded[name]

    def find(self, surt_key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of each capture with this key and id."""
        want = _key({"surt": surt_key, "page_id": page_id})
        out = []
        for first, _, name, size in self.files[bisect_left(self.lasts, want) :]:
            if first > want:
                break
            source, keys, places, block = self._directory(name, size)
            for k in range(max(0, bisect_left(keys, want) - 1), bisect_right(keys, want)):
                if k not in block:
                    block.clear()
                    lines = [json.loads(x) for x in zlib.decompress(source.read_at(places[k][1], places[k][0])).split(b"\n")]
                    block[k] = [_key({"surt": x[0], "page_id": x[1]}) for x in lines], lines
                have, lines = block[k]
                out += [tuple(x[2:]) for x in lines[bisect_left(have, want) : bisect_right(have, want)]]
        return out


def lookup(queries: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Places (file, offset, length) of the captures of ``queries`` (surt, page_id).

    Queries are sorted, so a task walks through a stretch of the index and reads each block once.
    """
    path = files.inputFiles()
    listed = [r.asDict() for r in files.collect()] if path else []  # one short row per index file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*open_store(folder), listed)
        for b in batches:
            found = [x for s, p in zip(b.column("surt").to_pylist(), b.column("page_id").to_pylist(), strict=True) for x in index.find(s, p)]
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["file", "offset", "length"])

    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = queries.select("surt", "page_id").distinct().repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return ordered.mapInArrow(run, "file string, offset long, length long")


def read_records(places: DataFrame, folder: str, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """Records at ``places``, read by ranges; ranges close to each other are read as one."""
    extra = ", payload binary" if with_payload else ""
    schema = f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, url string{extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, source = None, None
        for b in batches:
            files, offsets, lengths = (b.column(c).to_pylist() for c in ("file", "offset", "length"))
            i, rows = 0, []
            while i < len(files):
                j, end = i, offsets[i]
                while j < len(files) and files[j] == files[i] and offsets[j] - end <= GAP and offsets[j] + lengths[j] - offsets[i] <= 8 << 20 or j == i:
                    end = offsets[j] + lengths[j]
                    j += 1
                if files[i] != name:
                    name, source = files[i], store.open_input_file(f"{base}/{files[i]}")
                data = source.read_at(end - offsets[i], offsets[i])
                rows += [parse(data[offsets[k] - offsets[i] : offsets[k] - offsets[i] + lengths[k]]) for k in range(i, j)]
                i = j
            cols = [r.split()[0] for r in schema.split(", ")]
            kinds = [b.schema.field("offset").type if k in ("page_id", "payload_bytes", "refers_to") else pa.binary() if k == "payload" else pa.string() for k in cols]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(cols, kinds, strict=True)], cols)

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, per_file: int = 2_000_000, per_block: int = 256, folder: str | None = None,
) -> tuple[DataFrame, DataFrame, str]:
    """Writes archives and index of all pages: (captures, index files, folder)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    decided = decide(pages.withColumn(id_col, col(id_col).cast("bigint")), id_col, url_col, html_col, least)
    captures = write_archives(decided, f"{folder}/archive")
    return captures, write_index(captures, f"{folder}/index", per_file, per_block), folder


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Operator 3. A record per page is written, found through the index by its URL, and read back.

    Per page: id, payload_bytes, payload_digest, record_type, refers_to, as the archives say. Of
    payloads that are equal and have ``least`` bytes or more, that of the smallest id is stored,
    the others are revisits of it.

    Defined cases: null html is an empty payload; smaller payloads are all stored; a null URL is
    archived without target under an empty key; a null id is never the smallest and revisits any
    other page with its payload; rows that repeat the smallest id and its payload are responses
    each; line breaks in a URL are percent-encoded in the record; an empty table writes nothing
    and gives an empty result; columns other than the three named are not read.
    """
    captures, files, folder = archive(pages, id_col, url_col, html_col, **options)
    places = lookup(captures.select("surt", "page_id"), files, f"{folder}/index")
    found = read_records(places, f"{folder}/archive").drop("url")
    return found.withColumnRenamed("page_id", id_col)
