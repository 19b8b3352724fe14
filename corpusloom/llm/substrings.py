"""Suffix-array dedup: removing the bytes of long strings that occur more than once.

1. A string of `length` bytes is keyed by the least hash of the short strings in it. Equal strings
   have equal keys, and neighbours mostly share one: a text falls into runs of strings of one key.
2. No string of a key found in one run of the whole corpus only starts outside that run. Runs of
   keys found more often become segments, the bytes that their strings cover; so do runs that hold
   the short string of their key twice, as periodic texts do.
3. Segments equal byte for byte are one, with a count. Keys are packed into shards by the bytes of
   their segments, so all the places of a string meet in one shard of at most twice `SHARD_BYTES`.
   A task takes its shards one after the other; each one's suffix array and permuted common prefixes
   tell which of its strings start elsewhere. See suffixes.py.
4. The strings found are joined back to the places of their segments; each text loses the bytes
   that they cover.

A key whose segments alone are more than a shard (the edge of a passage that very many texts share,
or a large group of near copies) is split by a longer key: its segments are cut again by the least
hash of the next length in `GRAMS`, which makes most of them equal or single, and go through the same
steps. The last length is that of the strings themselves, where a key has one segment and its count
is the answer. Nothing is dropped or capped. Segments longer than any run without repeats inside
(periodic texts) go to the last length at once.

Texts equal to another text lose every byte that such a string covers, and are taken once in all
of this. Texts are moved by content, never by doc_id.

Defined results: null texts are empty; texts shorter than `length` keep all; matches don't cross
texts; repeated rows and ids are texts like any other; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, suffixes

LENGTH = 200
#: Lengths of the short strings that key the others: at first, and for keys too large for a shard.
GRAMS = (64, 150, 185)
SHARD_BYTES = 1 << 20
#: Texts are hashed so many bytes at a time.
STEP = 1 << 18
#: An odd base and its inverse for hashes modulo 2^64, and an odd mixer.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93
#: Not a byte of any UTF-8 text.
BETWEEN = b"\xff"


class Powers:
    """Powers of the base and of its inverse, as far as a text has needed them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        while len(cls.up) < n:
            m = len(cls.up)
            cls.up, cls.down = (np.concatenate([x, x * np.uint64(pow(b, m, 1 << 64))]) for x, b in ((cls.up, BASE), (cls.down, INVERSE)))


def runs(text: bytes, length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """The runs of strings of one key: keys, first starts, numbers of strings, and whether what has
    the key's hash lies in the run twice, without which no two of its strings are equal."""
    n = len(text) - length + 1
    if n < 1:
        return *[np.empty(0, np.int64)] * 3, np.empty(0, bool)
    Powers.to(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * Powers.up[: len(text)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * Powers.down[: len(text) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(32)
    # The least of every `width` neighbours: of blocks, from their ends and from their starts.
    width = length - gram + 1
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], fore[width - 1 : width - 1 + n])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.append(starts[1:], n) - 1
    keys = least[starts]
    # The first place of the hash is in the first string, the last one in the last string.
    reach = np.lib.stride_tricks.sliding_window_view(h, width)
    twice = np.empty(len(starts), bool)
    for k in range(0, len(starts), 2048):
        a, b, key = starts[k : k + 2048], ends[k : k + 2048], keys[k : k + 2048, None]
        twice[k : k + 2048] = a + (reach[a] == key).argmax(axis=1) != b + width - 1 - (reach[b] == key)[:, ::-1].argmax(axis=1)
    return keys.view(np.int64), starts, ends - starts + 1, twice


def stepwise(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """runs() of a text of any length, STEP strings at a time: a run may be cut in two."""
    if len(text) < STEP + length:
        return runs(text, length, gram)
    found = []
    for base in range(0, len(text) - length + 1, STEP):
        keys, starts, n, twice = runs(text[base : base + STEP + length - 1], length, gram)
        found.append((keys, starts + base, n, twice))
    return tuple(np.concatenate(x) for x in zip(*found))


def content(text: Column) -> Column:
    """A text's content as a long: 60 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _keyed(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """`texts` (content, text) as (key, content, start, n, twice), one for each run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, 1):
                found = [stepwise(t.encode(), length, gram) for t in some.column(1).to_pylist()]
                each = np.repeat(some.column(0).to_numpy(), [len(f[0]) for f in found])
                key, start, n, twice = (np.concatenate([f[k] for f in found]) for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, each, start, n, twice)], ["key", "content", "start", "n", "twice"])

    return texts.mapInArrow(rows, "key bigint, content bigint, start bigint, n bigint, twice boolean")


NAMES = ["key", "to", "start", "n", "twice", "bytes", "segment"]


def _segments(chosen: DataFrame, length: int) -> DataFrame:
    """`chosen` (content, text, runs) as (key, to, start, n, twice, bytes, segment), `segment`
    naming the bytes, `to` the text that they are in."""
    import xxhash

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, 1, 1 << 19):
                texts = [t.encode() for t in some.column(1).to_pylist()]
                lists = some.column(2)
                key, start, n, twice = lists.flatten().flatten()
                owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                ends = start.to_numpy() + n.to_numpy() + length - 1
                parts = [texts[o][a:b] for o, a, b in zip(owner.tolist(), start.to_pylist(), ends.tolist())]
                named = [pa.array(parts, pa.binary()), pa.array(map(xxhash.xxh3_128_digest, parts), pa.binary())]
                yield pa.RecordBatch.from_arrays([key, some.column(0).take(pa.array(owner)), start, n, twice, *named], NAMES)

    return chosen.mapInArrow(rows, "key bigint, to bigint, start bigint, n bigint, twice boolean, bytes binary, segment binary")


def _cut_again(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """`segments` (segment, bytes) cut by a longer key, as _segments() has them; `to` is the segment
    that they are in."""
    import xxhash

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, 1, 1 << 19):
                whole = some.column(1).to_pylist()
                found = [stepwise(part, length, gram) for part in whole]
                owner = np.repeat(np.arange(len(whole)), [len(f[0]) for f in found])
                key, start, n, twice = (np.concatenate([f[k] for f in found]) for k in range(4))
                parts = [whole[o][a:b] for o, a, b in zip(owner.tolist(), start.tolist(), (start + n + length - 1).tolist())]
                named = [pa.array(parts, pa.binary()), pa.array(map(xxhash.xxh3_128_digest, parts), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(key), some.column(0).take(pa.array(owner)), *map(pa.array, (start, n, twice)), *named], NAMES)

    return segments.select("segment", "bytes").mapInArrow(rows, "key bigint, to binary, start bigint, n bigint, twice boolean, bytes binary, segment binary")


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _whole(segments: DataFrame, length: int) -> DataFrame:
    """`segments` (segment, bytes) as (segment, found), by keys as long as the strings: such a key
    has one string, and its count is the answer."""
    import xxhash

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places: dict[bytes, list[dict]] = {}
                for k in range(len(part) - length + 1):
                    mine = places.setdefault(xxhash.xxh3_128_digest(part[k : k + length]), [])
                    if mine and mine[-1]["last"] == k - 1:
                        mine[-1]["last"] = k
                    else:
                        mine.append({"first": k, "last": k})
                out[0] += places
                out[1] += [sum(x["last"] - x["first"] + 1 for x in mine) for mine in places.values()]
                out[2] += [name] * len(places)
                out[3] += places.values()
                if len(out[0]) > 1 << 15:
                    yield batch_of(out)
                    out = [[], [], [], []]
            yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        high, low = np.frombuffer(b"".join(out[0]), "<i8").reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], SPANS)], ["high", "low", "times", "segment", "found"])

    strings = segments.select("segment", "bytes").mapInArrow(rows, "high bigint, low bigint, times bigint, segment binary, found array<struct<first: bigint, last: bigint>>")
    strings = common.written(strings)
    again = strings.groupBy("high", "low").agg(F.sum("times").alias("_times"), F.count("*").alias("_rows")).where("_times > 1")
    again = common.cut(again.select(F.xxhash64("high", "low").alias("_string"), "high", "low", "_rows"))
    hits = common.joined_spread(strings.withColumn("_string", F.xxhash64("high", "low")), again.withColumnsRenamed({"high": "_high", "low": "_low"}), "_string", "_rows", F.xxhash64("segment"))
    hits = hits.where("high = _high AND low = _low")
    return hits.groupBy("segment").agg(F.flatten(F.collect_list("found")).alias("found"))


def _in_shards(segments: DataFrame, total: int, length: int) -> DataFrame:
    """`segments` (shard, segment, bytes) as (segment, found): the stretches (first, last) of string
    starts in the segment that start elsewhere among the segments of its shard too."""

    def answer(names: list[bytes], parts: list[bytes]) -> pa.RecordBatch:
        hit = suffixes.repeated(np.frombuffer(BETWEEN.join(parts), np.uint8), length)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        first, last = _stretches(hit)
        # A string with a separator in it may be found too, if two shards' neighbours agree on it.
        owner = np.searchsorted(begins, first, "right") - 1
        found: dict[int, list] = {}
        for k, a, b in zip(owner.tolist(), first.tolist(), last.tolist()):
            while a <= b:  # a stretch may go on into the next segments
                stop = int(begins[k] + sizes[k] - length)
                if a <= min(b, stop):
                    found.setdefault(k, []).append({"first": a - int(begins[k]), "last": min(b, stop) - int(begins[k])})
                k += 1
                a = int(begins[k]) if k < len(begins) else b + 1
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in found], pa.binary()), pa.array(list(found.values()), SPANS)], ["segment", "found"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, parts = None, [], []
        for batch in batches:
            for at, name, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at != shard and names:
                    yield answer(names, parts)
                    names, parts = [], []
                shard = at
                names.append(name)
                parts.append(part)
        if names:
            yield answer(names, parts)

    cores = segments.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-total // SHARD_BYTES), max(4 * cores, -(-total // (256 << 20)))))
    dealt = segments.repartition(tasks, "shard").sortWithinPartitions("shard").select("shard", "segment", "bytes")
    return dealt.mapInArrow(rows, "segment binary, found array<struct<first: bigint, last: bigint>>")


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last places of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def _answers(pieces: DataFrame, length: int, grams: tuple[int, ...], most: int) -> DataFrame:
    """`pieces` (key, n, twice, bytes, segment), one for each place, as (segment, found, places): the
    stretches of strings that start elsewhere, and at how many places; written out. `grams`: the
    lengths of keys still to come, `most`: the bytes of a shard."""
    distinct = pieces.groupBy("segment").agg(*[F.first(c).alias(c) for c in ("key", "n", "bytes", "twice")], F.count("*").alias("places"))
    distinct = common.written(distinct)
    used = [distinct]
    by_key = distinct.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.octet_length("bytes")).alias("size"), F.max("twice").alias("twice"), F.max("n").alias("longest"))
    # A key with one segment has its answer in the count, unless strings may repeat within.
    open_ = by_key.where("rows > 1 OR twice").withColumn("periodic", F.col("longest") > 4 * length)
    open_ = common.cut(open_.withColumn("fits", ~F.col("periodic") & (F.col("size") <= most)).withColumn("_hash", F.xxhash64("key")))
    open_ = open_.withColumn("_bucket", F.pmod("_hash", F.lit(common.buckets(open_.count()))))
    ahead = common.running(open_.where("fits"), [], "_bucket", [F.col("key")], F.col("size"), "_before", "_total").withColumn("shard", F.expr(f"_before div {most}"))
    columns = ["key", "rows", "shard", "periodic"]
    ahead = common.cut(ahead.select(*columns).unionByName(open_.where("NOT fits").withColumn("shard", F.lit(None).cast("bigint")).select(*columns)))
    rest = common.joined_spread(distinct.select("key", "segment", "bytes"), ahead, "key", "rows", F.xxhash64("segment"))
    if open_.where("NOT fits").isEmpty():
        found = _in_shards(rest, open_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], length)
    else:
        rest = common.written(rest)
        used.append(rest)
        found = _in_shards(rest.where("shard IS NOT NULL"), open_.where("fits").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], length)
        large = rest.where("shard IS NULL")
        if grams and not large.where("NOT periodic").isEmpty():
            again = _cut_again(large.where("NOT periodic"), length, grams[0])
            used.append(_answers(again, length, grams[1:], most))
            found = found.unionByName(_shifted(again, used[-1]).withColumnRenamed("to", "segment"))
            large = large.where("periodic")
        if not large.isEmpty():
            found = found.unionByName(_whole(large, length))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last")))
    copied = distinct.where("places > 1").select("segment", all_of_it.alias("found"), "places")
    # Several answers for a segment add up.
    answers = found.withColumn("places", F.lit(None).cast("bigint")).unionByName(copied)
    answers = common.written(answers.groupBy("segment").agg(F.flatten(F.collect_list("found")).alias("found"), F.max("places").alias("places")))
    common.dropped(*used)
    return answers


def _shifted(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """What was found in segments, for each `to` that they lie in at `start`."""
    found = found.withColumn("places", F.coalesce("places", F.lit(1)))
    placed = common.joined_spread(pieces.select("segment", "to", "start"), found, "segment", "places", F.xxhash64("to", "start"))
    moved = F.transform("found", lambda x: F.struct((x["first"] + F.col("start")).alias("first"), (x["last"] + F.col("start")).alias("last")))
    return placed.select("to", moved.alias("found")).groupBy("to").agg(F.flatten(F.collect_list("found")).alias("found"))


def removable(texts: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, most: int = SHARD_BYTES) -> DataFrame:
    """`texts` (content, text) with repeats as (content, text, found): the stretches of starts of
    strings that start elsewhere in another text or in the same one. Texts without any are left out."""
    keyed = common.written(_keyed(texts, length, grams[0]))
    many = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.count_if("twice").alias("twice_"))
    many = common.cut(many.where("rows > 1 OR twice_ > 0").select("key", "rows"))
    wanted = common.joined_spread(keyed, many, "key", "rows", F.xxhash64("content", "start"))
    wanted = wanted.groupBy("content").agg(F.collect_set(F.struct("key", "start", "n", "twice")).alias("runs"))
    once = texts.groupBy("content").agg(F.collect_set("text").alias("texts"))
    chosen = common.written(once.join(wanted, "content").select("content", F.explode("texts").alias("text"), "runs"))
    common.dropped(keyed)

    segments = _segments(chosen, length)
    hits = _shifted(segments, _answers(segments, length, grams[1:], most)).withColumnRenamed("to", "content")
    return chosen.select("content", "text").join(hits, "content")


def _removed(texts: DataFrame, length: int) -> DataFrame:
    """`texts` (text, found) as (sha, n_removed, n_spans, kept_sha256)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.encode()
                delta = np.zeros(len(text) + 1, np.int64)
                np.add.at(delta, [x["first"] for x in found], 1)
                np.add.at(delta, [x["last"] + length for x in found], -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((hashlib.sha256(text).hexdigest(), int(gone.sum()), len(_stretches(gone)[0]), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["sha", "n_removed", "n_spans", "kept"])

    return texts.select("text", "found").mapInArrow(rows, "sha string, n_removed bigint, n_spans bigint, kept string")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    narrow = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    long = docs.where(F.octet_length("text") >= length).select(content(F.col("text")).alias("content"), "text")
    copied = narrow.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("rows"), F.first("n_bytes").alias("n_bytes")).where("rows > 1")
    # A text with copies loses all: this outweighs what was found in part.
    copied = copied.select("sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept"), "rows")
    with common.scope():
        partly = _removed(removable(long, length), length).withColumn("rows", F.lit(1).cast("long"))
        fact = F.max_by(F.struct("n_removed", "n_spans", "kept"), "rows").alias("f")
        facts = common.cut(partly.unionByName(copied).groupBy("sha").agg(fact, F.max("rows").alias("rows")))
    return common.joined_spread(narrow, facts, "sha", "rows", F.xxhash64("doc_id"), "left").select(
        "doc_id", "n_bytes", F.coalesce("f.n_removed", F.lit(0)).alias("n_removed"), F.coalesce("f.n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("f.kept", "sha").alias("kept_sha256"),
    )


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
