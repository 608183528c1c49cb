"""WARC archives: a deduplicating writer, and a reader that salvages what follows damage and logs the gaps."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, hot_keys, read_table, salted_join, ship

#: Payloads of so many bytes or more are revisited rather than repeated.
REVISIT_BYTES = 1000
#: An archive is closed after so many compressed bytes.
ARCHIVE_BYTES = 4 << 20
_MANIFEST = "path string, records long, bytes long"
_FOUND = "path string, offset long, length long, reason string, warc_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record(kind: str, page: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record. A revisit keeps the HTTP header, whose Content-Length is that of the payload it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', uri)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(root: str, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out, n, size, rolled = None, 0, 0, 0

        def close() -> pd.DataFrame:
            out.close()
            fs.move(f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}")  # a retried task replaces what it wrote before
            return pd.DataFrame({"path": [f"{root}/{name}"], "records": [n], "bytes": [size]})

        for pdf in batches:
            for page, url, html, digest, keep in zip(pdf["page"], pdf["url"], pdf["html"], pdf["digest"], pdf["keep"], strict=True):
                if out is None:
                    name, n, size = f"part-{task.partitionId():06d}-{rolled:05d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/.{name}.{task.taskAttemptId()}")
                payload = (html or "").encode()
                member = gzip.compress(record("response" if keep is None else "revisit", page, url or "", payload, digest, keep), 4, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= most:
                    yield close()
                    out, rolled = None, rolled + 1
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, work: Workspace, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes a record per row (page_id, url, html), each a gzip member, and returns the folder and the table of archives.

    Of rows with equal payloads of revisit_bytes or more, those with the largest page_id (null is the smallest) are
    responses and the others revisits of it; all other rows are responses. Null html is an empty payload, a null url an
    empty URI. Tasks sort what they write and name archives by partition, so a lost task writes the same files anew.
    """
    ship(work.spark)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.sha2(html, 256).alias("_same"), F.octet_length(html).alias("_n"))
    groups = rows.where(F.col("_n") >= revisit_bytes).groupBy("_same").agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    groups = work.save(groups, "copies")
    hot = hot_keys(groups, "_same", "_rows")
    both = salted_join(rows, groups.select("_same", "_keep"), "_same", hot, "page_id", "left")
    revisits = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    both = both.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), "url", "html", "digest", F.when(revisits, F.col("_keep").cast("string")).alias("keep"))
    root = work.path("warc")
    return root, work.save(both.sortWithinPartitions("page", "url", "digest").mapInPandas(_writer(root, archive_bytes), _MANIFEST), "archives")


_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r\n")
_VERSION = re.compile(rb"WARC/1\.\d\r\n")
_GZIP = b"\x1f\x8b\x08"
#: Bytes that are read or inflated at once; a member of no more than SMALL is inflated once.
BLOCK, SMALL = 1 << 20, 16 << 20


class Source:
    """An archive's bytes, at any place, through a window: of a file no more is held than a block, or what is asked for."""

    def __init__(self, data: bytes = b"", file=None):
        self.file, self.size, self.start, self.held = file, file.size() if file else len(data), 0, data

    def get(self, pos: int, n: int) -> bytes:
        if (n := min(n, self.size - pos)) <= 0:
            return b""
        if pos < self.start or pos + n > self.start + len(self.held):
            self.file.seek(pos)
            self.start, self.held = pos, self.file.read(min(max(n, BLOCK), self.size - pos))
        return self.held[pos - self.start : pos - self.start + n]

    def find(self, what: re.Pattern, pos: int) -> int:
        """Where what is found at pos or later, or else the end. No match is longer than 16 bytes."""
        while pos < self.size:
            m = what.search(self.get(pos, BLOCK))
            if m:
                return pos + m.start()
            pos += BLOCK - 16 if pos + BLOCK < self.size else BLOCK
        return self.size


def _length(head: bytes) -> int:
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    if not m:
        raise ValueError("length")
    return int(m[1])


def _parsed(head: bytes, block: bytes) -> tuple[dict, bool]:
    """What a record holds, and whether a digest says that it is whole; ValueError if one says it isn't."""
    named = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        named[k.strip().lower()] = v.strip()
    own = named.get("warc-block-digest", "")
    if own.startswith("sha1:") and own[5:] != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    kind, digest = named.get("warc-type", ""), named.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and digest and digest != hashlib.sha1(payload).hexdigest():
        raise ValueError("payload digest")
    ident = lambda k: (named.get(k, "").removeprefix("<").removesuffix(">")) or None
    return {
        "warc_type": kind, "record_id": ident("warc-record-id"), "uri": named.get("warc-target-uri"), "refers_to": ident("warc-refers-to"),
        "payload_bytes": int(said[1]) if kind == "revisit" and said else len(payload), "payload_digest": digest or hashlib.sha1(payload).hexdigest(), "payload": payload,
    }, own.startswith("sha1:") or kind != "revisit" and bool(digest)


def _plain(source: Source, pos: int) -> tuple[int, dict]:
    """The end of the plain record at pos, and what it holds. A header may be of any length; the block is read once its end is seen to be where it should be."""
    if source.get(pos, 7) != b"WARC/1.":
        raise ValueError("header")
    n, at = 4096, 0
    while (end := (head := source.get(pos, n)).find(b"\r\n\r\n", at)) < 0:
        if pos + n >= source.size:
            raise ValueError("header")
        n, at = 4 * n, n - 3
    begin = pos + end + 4
    stop = begin + _length(head[:end])
    if source.get(stop, 4) != b"\r\n\r\n":
        raise ValueError("record end")
    return stop + 4, _parsed(head[:end], source.get(begin, stop - begin))[0]


def _inflated(source: Source, pos: int, ended: list) -> Iterator[bytes]:
    """What the gzip member at pos holds, block by block; its end goes to ended. zlib.error if its checks fail."""
    d, at = zlib.decompressobj(31), pos
    while not d.eof:
        chunk = d.unconsumed_tail or source.get(at, 1 << 16)
        if not chunk:
            raise zlib.error("cut off")
        at += 0 if d.unconsumed_tail else len(chunk)
        out = d.decompress(chunk, BLOCK)
        if out:
            yield out
    ended.append(at - len(d.unused_data))


def _inside(blocks: Iterator[bytes]) -> Iterator[tuple[str | None, dict, bool]]:
    """(reason, what, sure) of what an inflated member holds: its good records and, with a reason and no record, a row per gap between them. No more is held than a record."""
    held, gap = bytearray(), None

    def more() -> bool:
        held.extend(block := next(blocks, b""))
        return bool(block)

    while True:
        while len(held) < 16 and more():
            pass
        if not held:
            break
        try:
            if not held.startswith(b"WARC/1."):
                raise ValueError("header")
            at = 0
            while (end := held.find(b"\r\n\r\n", at)) < 0:
                at = max(0, len(held) - 3)
                if not more():
                    raise ValueError("header")
            head = bytes(held[:end])
            size = end + 4 + _length(head)
            while len(held) < size + 4:
                if not more():
                    raise ValueError("record end")
            if held[size : size + 4] != b"\r\n\r\n":
                raise ValueError("record end")
            what, sure = _parsed(head, bytes(held[end + 4 : size]))
        except ValueError as error:
            gap = gap or str(error)
            while not (m := _VERSION.search(held, 1)) and more():
                del held[: max(0, len(held) - BLOCK)]
            del held[: m.start() if m else len(held)]
            continue
        if gap:
            yield gap, {}, False
            gap = None
        yield None, what, sure
        del held[: size + 4]
    if gap:
        yield gap, {}, False


def salvage(data: bytes | Source) -> Iterator[tuple[int, int | None, str | None, dict]]:
    """(offset, length, reason, what) of an archive's records and, with a reason and no record, of the gaps between them.

    After a failed check it goes on at the next byte that can begin a gzip member or a version line; what begins there
    has to pass all checks too, so the gap may grow. Archives may be gzipped by record, as a whole, plain, or both in turn.
    A gzip member that holds a flawed record gives the others, found by version lines inside it; they and its gaps have
    the offset and length of the member, as bytes inside have no place of their own in the archive. A member that the
    archive's end breaks off gives the records before that which a digest of their own says are whole; their length is
    null, and the gap begins with the member. One that fails its checksum gives none: a digest doesn't cover headers. Of a file no more is held than a record and a few blocks.
    """
    source = data if isinstance(data, Source) else Source(data)
    pos, gap, why = 0, None, ""
    while pos < source.size:
        end, reason, rows = None, None, iter(())
        if source.get(pos, 3) == _GZIP:
            ended, small, n = [], [], 0
            try:
                for block in _inflated(source, pos, ended):
                    n += len(block)
                    small = [*small, block] if n <= SMALL else []
                end = ended[0]
            except zlib.error as error:
                reason = str(error)
            if end is not None:
                inner = _inside(iter(small) if n <= SMALL else _inflated(source, pos, []))
                first = next(inner, None)
                held = [] if first is None else [first]
                if first is not None and first[0]:  # is there a good record at all?
                    held += [x for x in [next(inner, None)] if x]
                if held and all(x[0] for x in held):
                    reason, end = held[0][0], None
                else:
                    rows = ((pos, end - pos, *x[:2]) for x in chain(held, inner))
            elif reason == "cut off":
                def sound(at=pos):
                    try:
                        for why_not, what, sure in _inside(_inflated(source, at, [])):
                            if not why_not and sure:
                                yield at, None, None, what
                    except zlib.error:
                        return

                rows = sound()
        else:
            try:
                end, what = _plain(source, pos)
                rows = iter([(pos, end - pos, None, what)])
            except ValueError as error:
                reason = str(error)
        if reason is None and gap is not None:
            yield gap, pos - gap, why, {}
            gap = None
        yield from rows
        if reason is None:
            pos = end
        else:
            if gap is None:
                gap, why = pos, reason
            pos = source.find(_NEXT, pos + 1)
    if gap is not None:
        yield gap, source.size - gap, why, {}


def _file_uri(path: str) -> str:
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def _opens(root: str) -> bool:
    """Whether pyarrow knows the file system of root."""
    from pyarrow import ArrowException
    from pyarrow.fs import FileSystem

    try:
        FileSystem.from_uri(_file_uri(root))
    except (ArrowException, OSError, ValueError):
        return False
    return True


def _reader(payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        names = [x.split()[0] for x in _FOUND.split(", ")]
        for pdf in batches:
            for k, path in enumerate(pdf["path"]):
                if "content" in pdf:
                    source = Source(bytes(pdf["content"].iloc[k]))
                else:
                    fs, at = FileSystem.from_uri(_file_uri(path))
                    source = Source(file=fs.open_input_file(at))
                rows, held = [], 0
                for offset, length, reason, what in salvage(source):
                    rows.append({"path": path, "offset": offset, "length": length, "reason": reason} | what | ({} if payloads else {"payload": None}))
                    held += len(rows[-1].get("payload") or b"")
                    if len(rows) == 2000 or held > 16 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})

    return run


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives in root, and a row with a reason per quarantined gap of bytes. payloads: whether to return these as well.

    Files are read through a window, so archives of any size fit. Where only Spark opens root's file system, each comes
    whole, by way of Spark, and has to fit a task.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(root)
    return files.select("path", *([] if _opens(root) else ["content"])).mapInPandas(_reader(payloads), _FOUND)


def whole(found: DataFrame, archives: DataFrame) -> DataFrame:
    """The records of found, which should be saved; raises if they aren't as many as the archives' manifest counts."""
    good = found.where("reason is null")
    want, got = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], good.count()
    if got != want:
        raise ValueError(f"{got} records were read back of {want} written")
    return good


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    root, archives = write_archives(read_table(spark, sf_dir, "pages"), work)
    found = whole(work.save(read_archives(spark, root, payloads=False), "found"), archives)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  after urn:page:
    return work.result(found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to")))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM k
"""
