"""Best-fit packing by length-histogram planning.

1. Every document is tokenized, closed by an end id, and cut if it is longer than a sequence: the
   last pieces are full, the first takes the rest.
2. The pieces are counted by length: at most `capacity` counts, whatever the input.
3. Best fit, decreasing, runs over the counts: a run of equal pieces goes into a run of equally
   filled sequences. The plan has a row for each such placing: at most a few thousands.
4. Each piece takes the planned slot of its rank among the pieces of its length.

Tokens come from the library that reads the same vocabulary as ranks, at about a third of the cost;
where the two could differ (special strings inside a text) or its pattern's search runs out of
stack (white space by the thousand), and for any other vocabulary, from the tokenizer's own.

Defined results: null and empty texts are the end id alone; texts are taken whole; repeated rows
and ids are documents like any other; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENS = "byte_bpe_50k.json"
#: The file that holds a tokenizer's vocabulary as ranks.
RANKS = {TOKENS: "byte_bpe_50k.tiktoken"}
LONG_SPACE = re.compile(r"\s{1000}")


class Ids:
    """Token ids in one worker process."""

    kept: dict = {}

    @classmethod
    def of(cls, name: str) -> "Ids":
        if name not in cls.kept:
            cls.kept[name] = cls(name)
        return cls.kept[name]

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranked = None
        if name in RANKS:
            import base64

            import tiktoken

            with open(public_tokenizers.path(RANKS[name]), "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def of_text(self, text: str) -> list[int]:
        if self.ranked is None or any(s in text for s in self.special) or LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked(text)


def pieces(docs: DataFrame, capacity: int = 1024, end: int = 2, name: str = TOKENS) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, piece, start, length, ids_crc32)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = Ids.of(name)
        little = np.dtype("<u4")
        for batch in batches:
            for some in common.slices(batch, 1):
                totals, checks = [], []
                for text in some.column(1).to_pylist():
                    tokens = ids.of_text(text)
                    tokens.append(end)
                    tokens = memoryview(np.frombuffer(array("I", tokens), np.uint32).astype(little, copy=False)).cast("B")
                    n = len(tokens) // 4
                    totals.append(n)
                    # The first piece is the shorter one.
                    at = 0
                    for stop in range((n - 1) % capacity + 1, n + 1, capacity):
                        checks.append(zlib.crc32(tokens[4 * at : 4 * stop]))
                        at = stop
                total = np.array(totals, np.int64)
                count = -(-total // capacity)
                owner = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = ((total - 1) % capacity + 1)[owner]
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(checks, pa.int64())], names
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places `counts` pieces of each length: (length, first rank, count, first sequence, offset).

    The pieces of ranks first .. first + count - 1 go, in order, into as many sequences on from the
    first one. Open sequences are kept as runs of equal room; of those that a piece fits in, the
    fullest take it.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, count)
    rooms: list[int] = []
    following = 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
                taken = min(count, left)
                leave(room, first + taken, count - taken)
            else:
                # New sequences take as many of these pieces as they hold, so open only what is needed.
                room, first = capacity, following
                taken = -(-left // (capacity // length))
                following += taken
            placed.append((length, rank, taken, first, capacity - room))
            leave(room - length, first, taken)
            rank, left = rank + taken, left - taken
    return placed


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """`cut` (doc_id, piece, length, ...) with sequence_id and offset. Read twice: see common.cut."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    rows = plan(counts, capacity)
    n_buckets = common.buckets(max(counts.values(), default=0))
    planned = cut.sparkSession.createDataFrame(rows, "_length bigint, _rank bigint, _count bigint, _sequence bigint, _offset bigint")
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    ranked = common.running(keyed, ["length"], "_bucket", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.lit(1).cast("long"), "_at", "_n")
    # The plan's size is bounded by the capacity, not by the input: at most a few rows a length.
    slot = (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_count"))
    return (
        ranked.join(F.broadcast(planned), slot)
        .withColumn("sequence_id", F.col("_sequence") + F.col("_at") - F.col("_rank"))
        .withColumn("offset", F.col("_offset"))
        .drop("_bucket", "_at", "_n", "_length", "_rank", "_count", "_sequence", "_offset")
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = common.cut(pieces(common.table(spark, sf_dir, "documents")))
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
