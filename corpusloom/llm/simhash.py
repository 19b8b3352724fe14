"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of the perfect Hamming [63, 57] code on a fingerprint's lower 63 bits:
its covering radius is 1, so every point lies within 1 of an anchor. Two fingerprints that differ
in at most `THRESHOLD` = 2 bits have a point within half the threshold of both; its anchor is
within 1 + 1 = 2 of both. So each distinct fingerprint is replicated to every anchor within the
covering radius plus half the threshold, at most 32 of them (found by its syndrome), and no link
can be missed. Within an anchor all 64 bits are compared.

Equal fingerprints are one fingerprint, so copies cost nothing, and an anchor has at most 4034
members, so there are no hot groups. An anchor gives a spanning set of its links, not all pairs.

Components are found over distinct fingerprints by alternately linking every vertex's larger and
all its neighbours to its least one; the tables between rounds are written to the shared folder.

Defined results: null, empty and blank texts have the fingerprint 0, linked like any other; texts
are taken whole; repeated rows and ids are documents like any other; null ids count as larger than
any id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
THRESHOLD = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles; a text of fewer words is one shingle."""
    import xxhash

    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words)) - 1
    starts = [0, *ends[: len(words) - 1 - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[k:] - 1).tolist())], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    h = hashes(text, shingle)
    return majority(h) if len(h) else 0


def majority(h: np.ndarray) -> int:
    """Bit by bit, whether it is set in over half of the hashes; counted a few thousand at a time."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 64 // 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, bits), the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, 1):
                bits = np.array([fingerprint(t, shingle) for t in some.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(bits)], ["doc_id", "bits"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, "doc_id bigint, bits bigint")


def _masks() -> list[list[int]]:
    """For each syndrome, what turns a point of that syndrome into the anchors within 2 of it."""
    one = lambda i: 1 << (i - 1)  # noqa: E731  position i of 1 to 63
    return [[0]] + [[one(s), *(one(i) | one(i ^ s) for i in range(1, 64) if i < i ^ s and i != s)] for s in range(1, 64)]


def anchors(bits: F.Column) -> F.Column:
    """The anchors within covering radius plus half the threshold."""
    point = bits.bitwiseAND(F.lit((1 << 63) - 1))
    syndrome = F.lit(0)
    for k in range(6):
        check = sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1)
        syndrome = syndrome + F.bit_count(point.bitwiseAND(F.lit(check))) % 2 * (1 << k)
    masks = F.from_json(F.lit(str(_masks())), "array<array<bigint>>")
    return F.transform(F.element_at(masks, (syndrome + 1).cast("int")), lambda m: point.bitwiseXOR(m))


def _spanning(points: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (larger, smaller) that connect what links of at most `threshold` bits connect."""
    points = np.sort(points)
    left = np.ones(len(points), bool)
    links = []
    while left.any():
        reached = [int(np.argmax(left))]
        left[reached[0]] = False
        while reached:
            at = points[reached.pop()]
            new = np.flatnonzero(left & (np.bitwise_count((points ^ at).view(np.uint64)) <= threshold))
            left[new] = False
            links += [(max(int(points[j]), int(at)), min(int(points[j]), int(at))) for j in new]
            reached += new.tolist()
    return links


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints, enough to connect each component."""
    assert threshold <= 2, "the anchors are set for two bits"
    met = distinct.select("bits", F.explode(anchors(F.col("bits"))).alias("anchor")).groupBy("anchor").agg(F.collect_list("bits").alias("bits"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for points in batch.column(0).to_pylist() for x in _spanning(np.array(points, np.int64), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met.where(F.size("bits") > 1).select("bits").mapInArrow(rows, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of each vertex of `edges` (a, b): root is the least vertex of its component.

    Rounds of two steps. Large star: every larger neighbour of a vertex goes to the least one of
    the vertex and its neighbours. Small star: the vertex and its smaller neighbours go to the least
    of them. Both keep the components; they end when every vertex points at its root. The rounds
    grow with the logarithm of a component's size.
    """
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        after = common.written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        # Done when the stars are what they were: each round either changes an edge or none.
        done = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        common.dropped(edges, large)
        if done:
            stars = common.cut(after)
            common.dropped(after)
            return stars.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
        edges = after


def grouped(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, bits, component_id), the least doc_id of the component."""
    marked = common.cut(fingerprints(docs, shingle))
    distinct = common.cut(marked.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    roots = components(links(distinct.select("bits"), threshold))
    members = distinct.join(roots, distinct["bits"] == roots["vertex"], "left").select("bits", F.coalesce("root", "bits").alias("root"), "first", "rows")
    members = common.cut(members)
    firsts = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.cut(members.join(firsts, "root").select("bits", "component_id", "rows"))
    # One fingerprint may be that of very many rows: 0 is that of all texts without words.
    return common.joined_spread(marked, named, "bits", "rows", F.xxhash64("doc_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
