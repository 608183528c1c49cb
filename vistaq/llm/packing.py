"""Best-fit packing by sums of squares: each document goes where the squared counts of open bins per residual gap become smallest."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, exact_ids, id_text, read_table, ship

LENGTH, END = 1024, 2
#: Pieces that one bin packing takes: so many leave few bins unfilled and pack in seconds.
SHARD = 50_000
_PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"


class ByteBPE:
    """The ids that tokenizers gives for a text, by tiktoken with the same vocabulary as ranks, which takes a fifth of the time.

    Texts that hold a string of an added token are given to tokenizers, which alone knows it.
    """

    #: P.PATTERN with possessive repeats, which split alike and never back off.
    PATTERN = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None):
        import base64

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        at = lambda x: os.path.join(folder, x) if folder else P.path(x)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(at(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(at(f"{name}.json"))
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        if any(a in text for a in self.added):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit; else full pieces after a first that takes the rest."""
    first = n % length or length if n > length else n
    return [(0, first), *((s, length) for s in range(first, n, length))]


def _pieces(folder: str | None, length: int, end: int, field: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = ByteBPE(folder=folder)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf[field], strict=True):
                ids = tok.ids(text or "")
                ids.append(end)
                raw = np.array(ids, "<u4").tobytes()
                for k, (s, n) in enumerate(cuts(len(ids), length)):
                    out.append((doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken by falling length.

    Of the bins that have room, and a new one once none has, an item goes where the sum over gaps of the squared number
    of open bins grows least; of equal ones, where the smallest gap stays. Bins of one gap are alike: the newest is used.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; 0 (full) never counts
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in order.tolist():
        size = int(lengths[i])
        have = count[size:]  # gaps size .. capacity; afterwards 0 .. capacity - size
        best = -1
        if have.any():
            after = count[: capacity + 1 - size]
            # moving a bin from gap g to g - size adds (n+1)^2 - n^2 there and takes n^2 - (n-1)^2 here
            change = np.where(have > 0, 2 * (after - have), np.iinfo(np.int64).max)
            change[0] -= 1 if have[0] else 0  # a bin that fills up leaves the sum
            best = int(change.argmin())
        if best >= 0:
            gap = best + size
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            stacks[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def _pack(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(np.int64), length)
        return pdf.assign(sequence_id=(pdf["_shard"].to_numpy(np.int64) << 40) | bins, offset=offsets).drop(columns="_shard")

    return run


def pack(docs: DataFrame, work: Workspace, text: str = "text", length: int = LENGTH, end: int = END, shard: int = SHARD, tokenizers: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt at random to about pieces/shard bin packings, each of one task; the few bins that each leaves
    unfilled are what it costs to have no task see all pieces. Null and empty texts are the end id alone. Rows that
    repeat are packed once each. An empty table gives none.
    tokenizers: the folder of the vocabulary files, where it isn't that of public_tokenizers.
    """
    ship(work.spark)
    run = _pieces(tokenizers, length, end, text)
    pieces = work.save(docs.select(id_text(docs), F.col(text)).mapInPandas(run, _PIECE), "pieces")
    shards = max(1, round(pieces.count() / shard))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit("pack")), F.lit(shards)))
    return exact_ids(dealt.groupBy("_shard").applyInPandas(_pack(length), _PIECE + ", sequence_id long, offset long"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pack")
    return work.result(pack(read_table(spark, sf_dir, "documents"), work))
