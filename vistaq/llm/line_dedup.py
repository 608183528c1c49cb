"""Line dedup: hashes of lines range-partitioned and sorted by document and position, streamed, and answered with a keep bitmap per document."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, hot_keys, read_table, row_of, salted_join, ship

MIN_DOCS, MIN_CHARS = 10, 1
#: Lines that a task hands on at once.
STEP = 100_000
_LINE = "h1 long, h2 long, doc binary, pos int, n long"
_FOUND = "h1 long, h2 long, doc binary, pos int, first boolean, docs long, open boolean"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def doc_key(doc_id: Column, text: Column) -> Column:
    """What a row is known by: its id, of any type, and text. Rows that repeat both share it, and their count is carried along, since each is a document. The id's length stands before it, so no other id and text make the same."""
    name = doc_id.cast("string")
    head = F.coalesce(F.concat(F.octet_length(name), F.lit(":"), name), F.lit("-"))
    return F.unhex(F.md5(F.concat(head, F.lit(":"), F.coalesce(text, F.lit("")))))


def _hashed(min_chars: int):
    """Of each document (doc, n, text as bytes) a row per line whose key is long enough: 128 bits of the key's MD5, doc, the line's place, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, docs, pos, times = [], [], [], []

        def give() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            out = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.binary()), pa.array(pos, pa.int32()), pa.array(times, pa.int64())]
            for held in (digests, docs, pos, times):
                held.clear()
            return pa.RecordBatch.from_arrays(out, names=["h1", "h2", "doc", "pos", "n"])

        for b in batches:
            for doc, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, line in enumerate(text.split(b"\n")):
                    key = line.strip(b" \t\n\x0b\x0c\r").lower()  # of bytes, so A-Z alone
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                        digests.append(hashlib.md5(key).digest())
                        docs.append(doc), pos.append(i), times.append(n)
                        if len(digests) >= STEP:
                            yield give()
        if digests:
            yield give()

    return run


def repeats(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc, n) for the keys of rows that repeat id and text."""
    keys = docs.groupBy(doc_key(F.col("doc_id"), F.col("text")).alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    return work.save(keys.where("n > 1"), "repeats")


def _stream(min_docs: int):
    """Over a partition sorted by (h1, h2, doc, pos), in which n tells how many rows doc stands for: a row per line of a key that is in min_docs documents or may be.

    Keys inside the partition are settled here. The first and the last key may go on in the neighbours, which hold other
    documents, since ranges are cut between documents; their rows are open and carry the documents counted here. A run
    is held as arrays of fixed-width keys, and written out as soon as it is known to reach min_docs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.binary()), ("pos", pa.int32()), ("first", pa.bool_()), ("docs", pa.int64()), ("open", pa.bool_())])
        state = {"key": None, "rows": [], "docs": 0, "last": None, "edge": True}

        def give(rows, docs, is_open):
            t = pa.concat_tables([pa.table([r[0], r[1], r[2], r[3], r[4]], names=["h1", "h2", "doc", "pos", "first"]) for r in rows]).combine_chunks()
            n = t.num_rows
            t = t.append_column("docs", pa.array(np.full(n, docs, np.int64))).append_column("open", pa.array(np.full(n, is_open)))
            return [b.cast(schema) for b in t.to_batches()]

        def close(at_end: bool) -> list:
            if state["key"] is None:
                return []
            is_open = state["edge"] or at_end
            if not is_open and state["docs"] < min_docs:
                return []
            out = give(state["rows"], 0, is_open) if state["rows"] else []
            if is_open:  # one more row tells how many documents this partition counts for the key
                k = state["key"]
                out += [pa.RecordBatch.from_arrays([pa.array([k[0]]), pa.array([k[1]]), pa.array([None], pa.binary()), pa.array([None], pa.int32()), pa.array([False]), pa.array([state["docs"]]), pa.array([True])], schema=schema)]
            return out

        for b in batches:
            if not b.num_rows:
                continue
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            doc, pos, n = b.column(2), b.column(3), b.column(4).to_numpy()
            raw = np.frombuffer(b"".join(doc.to_pylist()), np.dtype("V16"))
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = [0, *cut.tolist()]
            new_doc = np.ones(len(h1), bool)
            new_doc[1:] = raw[1:] != raw[:-1]
            new_doc[cut] = True
            for s, e in zip(starts, [*starts[1:], len(h1)], strict=True):
                key = (int(h1[s]), int(h2[s]))
                if key == state["key"]:
                    new_doc[s] = raw[s].tobytes() != state["last"]
                else:
                    before = state["key"]
                    yield from close(False)
                    state.update(key=key, rows=[], docs=0, edge=before is None)
                state["docs"] += int(n[s:e][new_doc[s:e]].sum())
                state["last"] = raw[e - 1].tobytes()
                state["rows"].append((b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), doc.slice(s, e - s), pos.slice(s, e - s), pa.array(new_doc[s:e])))
                if len(state["rows"]) > 1 and (state["edge"] or state["docs"] >= min_docs):
                    yield from give(state["rows"], 0, state["edge"])
                    state["rows"] = []
        yield from close(True)

    return run


def pack_bits(dropped: list[int]) -> bytes:
    """A document's keep bitmap, deflated: a bit per line up to the last that goes, 1 to keep. Later lines stay."""
    keep = np.ones(max(dropped) + 1, np.uint8)
    keep[np.asarray(dropped, int)] = 0
    return struct.pack("<I", len(keep)) + zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(bitmap: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", bitmap)[0]
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), np.uint8))[:n].astype(bool)


def _packed(dropped: pd.Series) -> pd.Series:
    return pd.Series([pack_bits(d) for d in dropped], dtype=object)


def _unpacked(keep: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else unpack_bits(k) for k in keep], dtype=object)


def keep_bitmaps(docs: DataFrame, work: Workspace, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, again: DataFrame | None = None) -> DataFrame:
    """A row (doc, keep) for each document that loses a line; doc is doc_key, keep the bitmap of pack_bits.

    Lines whose key has min_chars code points or more and is found in min_docs documents or more go from all documents,
    or with keep_first from all but the first in the order of doc, pos. Each row is a document, rows that repeat id and
    text too: these are told apart by again, the table of repeats, dealt out once and counted by their number. Null and empty texts have one empty line, whose
    key is too short to go if min_chars is 1 or more. A key is known by the 128 bits of its MD5. Ranges are cut by
    (key, doc), so lines that many documents share spread over partitions; what two partitions hold of one key is added
    up in a table of at most two rows per partition.
    """
    spark = work.spark
    ship(spark)
    # the key is made before the lines are dealt out, once a document
    again = repeats(docs, work) if again is None else again
    keyed = docs.select(doc_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    if again.isEmpty():
        keyed = keyed.withColumn("n", F.lit(1).cast("long"))
    else:  # rows that repeat come once, combined before they are dealt out
        many = broadcast_if_small(again)
        some = keyed.join(many, "doc").groupBy("doc").agg(F.min("text").alias("text"), F.first("n").alias("n"))
        keyed = keyed.join(many, "doc", "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(some)
    raw = keyed.select("doc", "n", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    hashed = work.save(raw.mapInArrow(_hashed(min_chars), _LINE), "hashed")  # so the sample for the ranges doesn't hash all lines
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = hashed.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    found = work.save(dealt.mapInArrow(_stream(min_docs), _FOUND), "found")
    edges = found.where("open and doc is null").groupBy("h1", "h2").agg(F.sum("docs").alias("total"))
    edges = work.save(edges.where(F.col("total") >= min_docs).select("h1", "h2"), "edges")  # at most 2 rows a partition
    rows = found.where("doc is not null")
    drop = rows.where("not open").unionByName(rows.where("open").join(broadcast_if_small(edges, 2 * parts), ["h1", "h2"], "left_semi"))
    if keep_first:
        firsts = drop.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("_one"))
        firsts = work.save(firsts.select(F.col("_one.doc").alias("doc"), F.col("_one.pos").alias("pos")), "firsts")
        drop = drop.join(firsts, ["doc", "pos"], "left_anti")
    lost = drop.groupBy("doc").agg(F.collect_list("pos").alias("dropped"))  # no longer than the document: rows that repeat came once
    return lost.select("doc", F.pandas_udf(_packed, "binary")("dropped").alias("keep"))


def drop_lines(docs: DataFrame, work: Workspace, **how) -> DataFrame:
    """docs with n_lines, n_dropped, keep (the bitmap, null where nothing goes) and kept_text, in place of columns of these names."""
    again = repeats(docs, work)
    lost = keep_bitmaps(docs, work, again=again, **how)
    keyed = docs.select(row_of(docs), doc_key(F.col("doc_id"), F.col("text")).alias("doc"))
    text = F.col("row").getField("text")  # which goes through the join once, in its row
    hot = hot_keys(again, "doc", "n")
    if hot:  # rows that repeat differ in nothing but their place
        keyed = keyed.withColumn("_place", F.monotonically_increasing_id())
    both = salted_join(keyed, lost, "doc", hot, "_place", "left").withColumn("_lines", lines(text))
    both = both.withColumn("_bits", F.when(F.col("keep").isNotNull(), F.pandas_udf(_unpacked, "array<boolean>")("keep")))
    kept = F.when(F.col("_bits").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.filter("_lines", lambda _, i: F.coalesce(F.get("_bits", i), F.lit(True))), "\n"))
    gone = F.size(F.filter("_bits", lambda k: ~k))
    made = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.when(F.col("_bits").isNull(), 0).otherwise(gone).cast("long"), "keep": F.col("keep"), "kept_text": kept}
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in made]
    return both.select(*own, *(v.alias(k) for k, v in made.items()))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    work = Workspace(spark, "lines")
    out = drop_lines(docs, work)
    return work.result(out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
  FROM k LEFT JOIN f USING (key) GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN g USING (r)
"""
