"""WARC archives: written with revisits, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .store import cut, open_fs, rows_below, work_dir

MAGIC = b"WARC/1.0\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes read at once beyond a block, as long as a header that starts in it doesn't end.
READ_ON = 1 << 16
#: Bytes of archives that a task reads, at most, where the session's shuffle partitions would have more.
TASK_BYTES = 256 << 20
#: Salts of a digest's rows when they look up the first of their payload.
SALTS = 16
#: Rows of the table of repeated payloads (40 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")


def base32_sha1(payload) -> F.Column:
    """Upper-case base32 SHA-1 of a binary column: 5 hex digits make 4 letters."""
    digest, out = F.sha1(payload), []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(page, url, kind, refers, digest, size, payload: bytes) -> bytes:
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]").encode())
    if refers is not None:
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers)
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % size, b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _writer(folder: str, file_bytes: int):
    def write(batches):
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        part, done, out, size, path = TaskContext.get().partitionId(), [], None, 0, ""
        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "html")), strict=True):
                page, url, kind, refers, digest, n, html = (x.as_py() for x in r)
                record = _record(page, url, kind, refers, digest, n, b"" if kind == "revisit" else (html or "").encode())
                if out is None or size and size + len(record) > file_bytes:
                    if out is not None:
                        out.close()
                        done.append((path, size))
                    path, size = f"{part:06d}-{uuid.uuid4().hex}.warc", 0
                    out = fs.open_output_stream(f"{where}/{path}")
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["file", "bytes"])

    return write


def write_warc(pages: DataFrame, min_revisit: int = 0, file_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """Write one record for each row of ``pages (page_id, url, html)``; returns the folder and ``(file, bytes)``.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least ``min_revisit``
    bytes the smallest page_id's record is a response; the others are revisits, without payload,
    that name it. Rows that repeat the smallest page_id are all responses, as are rows whose equals
    all have null page_ids; a null page_id beside others revisits them. A null url leaves its header
    out. An empty table makes no files. Other columns aren't read.
    """
    ship(pages.sparkSession)
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    firsts = seen.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = cut(firsts.select("payload_digest", "first"), "warc")
    if rows_below(firsts, BROADCAST_ROWS):
        typed = seen.join(F.broadcast(firsts), "payload_digest", "left")
    else:  # a digest's rows meet salted copies of its first
        firsts = firsts.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salt = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(SALTS)).cast("int")
        typed = seen.withColumn("salt", salt).join(firsts, ["payload_digest", "salt"], "left")
    typed = typed.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    typed = typed.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    folder = work_dir(spark, "warc")
    return folder, cut(typed.mapInArrow(_writer(folder, file_bytes), "file string, bytes long"), "warc")


def _length(data: bytearray, begin: int, stop: int) -> tuple[int, int] | None:
    """Where a header first gives a length, and that."""
    m = _LENGTH.search(data, begin, stop + 2)
    return (m.start(), int(m[1])) if m else None


def _scanner(folder: str):
    """Every place in a block where a header can start, with the place after its record."""

    def scan(batches):
        fs, where = open_fs(folder)
        for batch in batches:
            for file, size, begin, end in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "begin", "end")), strict=True):
                at, after = [], []
                with fs.open_input_file(f"{where}/{file}") as f:
                    f.seek(begin)
                    data = bytearray(f.read(min(size, end + READ_ON) - begin))
                    k, stop, found = data.find(MAGIC), -1, None
                    while 0 <= k < end - begin:
                        if stop < k:  # else the header's end is that of the candidate before
                            stop = data.find(b"\r\n\r\n", k)
                            while stop < 0 and begin + len(data) < size:
                                had = len(data)
                                data += f.read(min(READ_ON, size - begin - had))
                                stop = data.find(b"\r\n\r\n", max(k, had - 3))
                            if stop < 0:  # neither this candidate's header ends nor a later one's
                                break
                            found = _length(data, k, stop)
                        elif found and found[0] < k:
                            found = _length(data, k, stop)
                        if found and begin + stop + 8 + found[1] <= size:
                            at.append(begin + k)
                            after.append(begin + stop + 8 + found[1])
                        k = data.find(MAGIC, k + 1)
                jump = dict(zip(at, after, strict=True))
                for a in reversed(at):  # chains are followed to the block's end here
                    jump[a] = jump.get(jump[a], jump[a])
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(at, pa.int64()), pa.array(after, pa.int64()), pa.array([jump[a] for a in at], pa.int64())], names=["file", "at", "after", "jump"])

    return scan


def _parser(folder: str):
    def parse(batches):
        fs, where = open_fs(folder)
        for batch in batches:
            rows, opened = [], {}
            for file, at, after in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "after")), strict=True):
                if file not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {file: fs.open_input_file(f"{where}/{file}")}
                opened[file].seek(at)
                head, _, payload = opened[file].read(after - at - 4).partition(b"\r\n\r\n")
                h = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
                page = h[b"WARC-Record-ID"][10:-1]
                kind, digest = h[b"WARC-Type"].decode(), h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file} at {at}: the payload doesn't have its digest")
                n = int(h[b"X-Payload-Length"]) if kind == "revisit" else len(payload)
                rows.append((None if page == b"None" else int(page), n, digest, kind, int(h[b"WARC-Refers-To"][10:-1]) if b"WARC-Refers-To" in h else None, file, at))
            for f in opened.values():
                f.close()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "file_offset"])

    return parse


def _tasks(files: DataFrame) -> int:
    """Tasks for work on archives: their rows are small, so the bytes behind them must count."""
    total = files.agg(F.sum("bytes")).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)


def record_boundaries(folder: str, files: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """``(file, at, after)`` of the records of uncompressed archives ``files (file, bytes)`` in a folder.

    Tasks each scan one block and emit every candidate (magic, header end and length that fit the
    file) with its successor. Pointer jumping from offset 0 then keeps those reachable: jumps lead
    past the candidate's block at once and double in each round, so a magic inside a payload, on no
    chain from the file's start, falls away. A break in the chain ends a file's records.
    """
    tasks = _tasks(files)
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {block_bytes}L)")).alias("begin"))
    blocks = blocks.withColumn("end", F.least("bytes", F.col("begin") + block_bytes))
    found = cut(blocks.repartition(tasks, "file", "begin").mapInArrow(_scanner(folder), "file string, at long, after long, jump long"), "warc")
    # entries: where chains enter a block. jump: candidate -> first place in a later block
    jump = found.select("file", "at", "jump")
    entry = files.where("bytes > 0").select("file", F.lit(0).cast("long").alias("at"))
    known = -1
    while True:
        step = entry.join(jump, ["file", "at"]).select("file", F.col("jump").alias("at"))
        entry = cut(entry.union(step).distinct(), "warc")
        n = entry.count()
        if n == known:
            break
        known = n
        further = jump.select("file", F.col("at").alias("jump"), F.col("jump").alias("next"))
        jump = cut(jump.join(further, ["file", "jump"], "left").select("file", "at", F.coalesce("next", "jump").alias("jump")), "warc")
    # within its block, a candidate is reached if the chain from the block's entry meets it
    marked = found.join(entry.withColumn("enters", F.lit(True)), ["file", "at"], "left").withColumn("block", F.floor(F.col("at") / block_bytes))
    return marked.repartition("file", "block").sortWithinPartitions("file", "at").mapInArrow(_walk(block_bytes), "file string, at long, after long")


def _walk(block_bytes: int):
    """Follows each block's chain from its entry; rows come sorted by file and place."""

    def walk(batches):
        file, due = None, -1
        for batch in batches:
            keep = []
            files, at, after, enters = (batch.column(c).to_pylist() for c in ("file", "at", "after", "enters"))
            for i, f in enumerate(files):
                if f != file:
                    file, due = f, -1
                if enters[i] or at[i] == due:
                    keep.append(i)
                    due = after[i]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], t) for x, t in ((files, pa.string()), (at, pa.int64()), (after, pa.int64()))], names=["file", "at", "after"])

    return walk


def read_warc(folder: str, files: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """Records of archives that ``write_warc`` wrote, each payload checked against its digest.

    Raises ValueError where a file's records don't fill it.
    """
    ship(files.sparkSession)
    records = cut(record_boundaries(folder, files, block_bytes), "warc")
    filled = records.groupBy("file").agg(F.sum(F.col("after") - F.col("at")).alias("filled"))
    broken = files.where("bytes > 0").join(filled, "file", "left").where("filled is null or filled <> bytes").first()
    if broken:
        raise ValueError(f"{broken.file}: its records have {broken.filled or 0} of its {broken.bytes} bytes")
    dealt = records.repartition(_tasks(files), "file", F.floor(F.col("at") / block_bytes)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(_parser(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, file_offset long")
