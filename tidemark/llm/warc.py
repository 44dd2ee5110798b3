"""WARC archives: writing, normalising monolithic gzip files, reading through a sidecar index.

Crawlers sometimes leave a whole archive as one gzip stream, which can only be
read from its beginning. The normaliser inflates such a file once, as a
stream, rewrites every record as a gzip member of its own and writes a sidecar
index (one JSON line a record: offset, length, id, type), so that any record
can then be read alone.

Payloads never cross the network: a task writes the rows of its partition,
only digests and ids are shuffled to find equal payloads, and the task that
normalises a file turns the repeats among its records into revisit records.

Files go through ``pyarrow.fs`` to the folder the cluster shares. Every attempt
of a task writes files of its own and the committed rows name the ones that
count, so a lost executor or a speculative attempt does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, utf8, written

FILE_BYTES = 32 << 20     # payload bytes of one archive
FILE_RECORDS = 20_000
MOST_TASKS = 20_000       # tasks of a step that works file by file; each takes its share of the files
PIECE = 1 << 20           # bytes inflated at a time
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record: version, headers, block and the two closing line ends."""
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response(page_id, url, payload: bytes, record_id: str) -> bytes:
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE),
                   ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
                   ("X-Page-Id", page_id), ("X-Payload-Length", len(payload)),
                   ("Content-Type", "application/http; msgtype=response")], HTTP + payload)


def revisit(headers: dict[str, str], refers_to) -> bytes:
    """The revisit record that stands for the response with ``headers``."""
    keep = ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "X-Page-Id", "X-Payload-Length")
    return record([("WARC-Type", "revisit"), *((k, headers.get(k)) for k in keep), ("WARC-Profile", PROFILE),
                   ("X-Refers-To-Page-Id", refers_to), ("Content-Type", "application/http; msgtype=response")], HTTP)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a stream of inflated bytes; holds one record at a time."""
    have = bytearray()

    def more() -> bool:
        piece = next(chunks, None)
        if piece is None:
            return False
        have.extend(piece)
        return True
    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not more():
                if have.strip():
                    raise ValueError("archive ends inside a record")
                return
        lines = bytes(have[:end]).decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        total = end + 4 + size + 4
        while len(have) < total:
            if not more():
                raise ValueError("archive ends inside a record")
        yield headers, bytes(have[end + 4:end + 4 + size])
        del have[:total]


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file, of one member or of many, in pieces of bounded size."""
    z, piece = zlib.decompressobj(31), b""
    while True:
        piece = z.unconsumed_tail or piece or stream.read(PIECE)
        if not piece:
            return
        out = z.decompress(piece, PIECE)
        piece = b""
        if out:
            yield out
        if z.eof:
            piece, z = z.unused_data, zlib.decompressobj(31)


def _open(path: str):
    where, inner = pafs.FileSystem.from_uri(path)
    return where, inner


def normalise_file(source: str, target: str, repeats: dict[int, object] | None = None) -> list[dict]:
    """Rewrite the archive ``source`` as ``target`` with a member a record, and write ``target``.idx.

    ``repeats`` maps the number of a record to the page its payload repeats.
    Returns the index entries.
    """
    entries, at = [], 0
    where, path = _open(source)
    there, out = _open(target)
    with where.open_input_stream(path, compression=None) as stream, there.open_output_stream(out, compression=None) as sink:
        for number, (headers, block) in enumerate(records(inflate(stream))):
            if repeats and number in repeats:
                raw, kind = revisit(headers, repeats[number]), "revisit"
            else:
                own = [(k, v) for k, v in headers.items() if k != "Content-Length"]
                raw, kind = record(own, block), headers.get("WARC-Type", "")
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            sink.write(member)
            entries.append({"offset": at, "length": len(member), "id": headers.get("WARC-Record-ID"), "type": kind})
            at += len(member)
    with there.open_output_stream(out + ".idx", compression=None) as sink:
        sink.write("".join(json.dumps(e) + "\n" for e in entries).encode())
    return entries


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a normalised archive, each by its offset in the sidecar index."""
    where, inner = _open(path)
    with where.open_input_stream(inner + ".idx", compression=None) as side:
        entries = [json.loads(line) for line in side.read().decode().splitlines()]
    with where.open_input_file(inner) as archive:
        for e in entries:
            archive.seek(e["offset"])
            yield from records(iter([zlib.decompress(archive.read(e["length"]), 31)]))


def _write(root: str):
    """Pages -> monolithic archives; one row a record: its place, digest and size."""
    def run(batches):
        state = {"sink": None, "n": 0, "bytes": 0, "path": "", "z": None}

        def close():
            if state["sink"]:
                state["sink"].write(state["z"].flush())
                state["sink"].close()
                state["sink"] = None
        try:
            for batch in batches:
                rows = {"page_id": [], "file": [], "number": [], "digest": [], "bytes": []}
                for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(),
                                              utf8(batch.column("html"))):
                    if state["sink"] and (state["bytes"] >= FILE_BYTES or state["n"] >= FILE_RECORDS):
                        close()
                    if not state["sink"]:
                        state["path"] = f"{root}/raw-{uuid.uuid4().hex}.warc.gz"
                        where, inner = _open(state["path"])
                        where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        state |= {"sink": where.open_output_stream(inner, compression=None), "n": 0, "bytes": 0,
                                  "z": zlib.compressobj(2, zlib.DEFLATED, 31)}
                    payload = html or b""
                    raw = response(page_id, url, payload, f"<urn:uuid:{uuid.uuid4()}>")
                    state["sink"].write(state["z"].compress(raw))
                    rows["page_id"].append(page_id)
                    rows["file"].append(state["path"])
                    rows["number"].append(state["n"])
                    rows["digest"].append(hashlib.sha256(payload).digest())
                    rows["bytes"].append(len(payload))
                    state["n"] += 1
                    state["bytes"] += len(payload)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["page_id"], pa.int64()), pa.array(rows["file"], pa.string()),
                     pa.array(rows["number"], pa.int64()), pa.array(rows["digest"], pa.binary()),
                     pa.array(rows["bytes"], pa.int64())], list(rows))
        finally:
            close()
    return run


def _normalise(root: str):
    """The records of one raw archive with what they repeat -> the normalised archive's name."""
    def run(key, rows):
        import pandas as pd
        repeated = rows[rows["refers_to"].notna()]
        repeats = dict(zip(repeated["number"].tolist(), repeated["refers_to"].astype("int64").tolist()))
        target = f"{root}/{uuid.uuid4().hex}.warc.gz"
        entries = normalise_file(key[0], target, repeats)
        return pd.DataFrame({"archive": [target], "records": [len(entries)]})
    return run


def _read(batches):
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            out = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for headers, block in read_file(path):
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(headers["X-Payload-Length"])
                if kind == "response":
                    payload = block[len(HTTP):]
                    if len(payload) != size or payload_digest(payload) != digest:
                        raise ValueError(f"{path}: damaged payload of {headers['WARC-Record-ID']}")
                page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                for k, v in zip(out, (None if page is None else int(page), headers.get("WARC-Target-URI"), size, digest,
                                      kind, None if refers is None else int(refers))):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def _tasks(files: int) -> int:
    return max(1, min(files, MOST_TASKS))


def write_archives(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as normalised archives under ``root``; returns (archive, records), one row a file.

    Of the pages with one payload of at least ``least_bytes``, the one with the
    largest id is a response and the others revisit it; smaller payloads are
    always responses. Rows that repeat the largest id are all responses. Null
    html is an empty payload; null ids count as smallest and, where a group has
    no other, are all responses.
    """
    spark = pages.sparkSession
    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                       pages[html_col].alias("html"))
    log = written(src.mapInArrow(_write(f"{root}/raw"), "page_id long, file string, number long, digest binary, "
                                 "bytes long"), scratch(spark, "warc-log"))
    groups = log.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    marked = log.join(groups, "digest", "left").select("file", "number", F.when(
        F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
    # a group is one file's records, at most FILE_RECORDS narrow rows; rows are few for the work they stand for,
    # so the number of tasks follows the number of files
    files = log.select("file").distinct().count()
    return written(marked.repartition(_tasks(files), "file").groupBy("file").applyInPandas(_normalise(root), "archive string, records long"),
                   scratch(spark, "warc-files"))


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of the archives in ``files`` (archive): page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. Payloads of responses are checked against their digest."""
    spread = files.select("archive").repartition(_tasks(files.count()), "archive")
    return spread.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                    "record_type string, refers_to long")


def archive_folder(spark: SparkSession) -> str:
    path = scratch(spark, "warc")
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
