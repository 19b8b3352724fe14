"""Near-duplicates by five-word Jaccard similarity of at least 0.8: SimHash first, then banded MinHash.

Texts with equal shingle sets are one set, so copies cost nothing. Every link is checked by counting
shared shingles. Candidates come in three steps, each over the components of the ones before:

* SimHash: sets whose fingerprints over five-word shingles differ in at most two bits, by the anchor
  points of simhash.py. A similarity of 0.8 leaves 4 to 14 bits, out of reach of any covering, so
* `BANDS` bands of `ROWS` minima follow: sets that agree in a band meet in its bucket. A pair at
  similarity s is missed with probability (1 - s^5)^24: 7e-5 at 0.8, 1e-6 at 0.85. One center of each
  bucket is compared with all members of other components.
* Buckets that still hold several components go whole to a task, with their members' shingles, and
  give links that connect what all pairs would; nothing is left out, and no pair is a row. A bucket
  of more than `MOST` shingles goes in pairs of blocks: every two members meet in a task, but for those
  of the bucket's largest component, who need not.

Shingles are counted by 32 bits of their hashes, which changes a share by about n / 2^32.

Defined results: a text of fewer than five words is one shingle; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
BANDS, ROWS = 24, 5
MULTIPLIERS = np.random.default_rng(3).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: How many shingles of a bucket go to a task; in pairs of blocks, half of it for each.
MOST = 1 << 19
SETS = "doc_id bigint, address string, id bigint, bits bigint, bands array<bigint>, shingles array<int>"


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(simhash.hashes(text, size))


def bands(hashed: np.ndarray) -> list[int]:
    """A key for each band; none without shingles."""
    import xxhash

    if not len(hashed):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashed), 2048):
        least = np.minimum(least, (MULTIPLIERS[:, None] * hashed[None, k : k + 2048]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sets(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as SETS: the text's content address, its set's id, fingerprint, bands and shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for some in common.slices(batch, 2):
                found = [shingles(t) for t in some.column(2).to_pylist()]
                ids = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], np.uint64).view(np.int64)
                short = [np.unique(h.astype(np.uint32).view(np.int32)) for h in found]
                ends = np.cumsum([0, *map(len, short)]).astype(np.int32)
                counted = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*short, np.zeros(0, np.int32)])))
                bits = np.array([simhash.majority(h) if len(h) else 0 for h in found], np.uint64).view(np.int64)
                keys = pa.array([bands(h) for h in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(ids), pa.array(bits), keys, counted], ["doc_id", "address", "id", "bits", "bands", "shingles"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("address"), text.alias("text")).mapInArrow(rows, SETS)


def verified(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets, `counted` (id, shingles), have a similarity of at least 0.8."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    both = sides.join(counted, "id").groupBy("a", "b").agg(F.collect_list("shingles").alias("s"))
    shared = F.size(F.array_intersect(F.col("s")[0], F.col("s")[1]))
    # shared / (m + n - shared) >= 4 / 5
    return both.where(9 * shared >= 4 * (F.size(F.col("s")[0]) + F.size(F.col("s")[1]))).select("a", "b")


def near(whole: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets, `whole` (id, bits), that connect those whose fingerprints differ in at
    most two bits: one set stands for each fingerprint, and the others of it are paired with that."""
    first = common.written(whole.groupBy("bits").agg(F.min("id").alias("c")))
    side = lambda k: first.select(F.col("bits").alias(k), F.col("c").alias(f"{k}_c"))
    apart = simhash.links(first.select("bits")).join(side("a"), "a").join(side("b"), "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))
    equal = whole.select("id", "bits").join(first, "bits").where("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b"))
    return apart.union(equal).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows (key, id, n) of buckets that hold several components of `joined` (vertex, root), with the root."""
    rows = rows.join(joined, rows["id"] == joined["vertex"], "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_m")).where("_l < _m").select("key")
    return common.written(rows.join(several, "key"))


def central(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of a center of each bucket of `rows` and the members of other components."""
    least = F.min(F.struct("id", "n", "root")).alias("c")
    centers = rows.groupBy("key").agg(least).select("key", F.col("c.id").alias("c"), F.col("c.n").alias("c_n"), F.col("c.root").alias("c_root"))
    # The larger set of a pair at 0.8 is at most a quarter larger.
    apt = (F.col("root") != F.col("c_root")) & (5 * F.least("n", "c_n") >= 4 * F.greatest("n", "c_n"))
    return rows.join(centers, "key").where(apt).select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct()


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """`rows` (key, id, n, root) as (key, part, id, root): a part has about `most` shingles, and any two
    members of a bucket that aren't both of its largest component meet in a part."""
    # Buckets of the same members are one.
    same = F.struct(F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1)))).alias("same")
    one = rows.groupBy("key").agg(same).groupBy("same").agg(F.min("key").alias("key")).select("key")
    sums = rows.groupBy("key", "root").agg(F.sum(F.col("n").cast("long")).alias("w")).groupBy("key")
    sums = sums.agg(F.sum("w").alias("total"), F.max(F.struct("w", "root")).alias("home")).join(one, "key")
    share = lambda w: F.when(F.col("total") > most, F.ceil(w / F.lit(most / 2))).cast("int")
    sums = sums.select("key", F.col("home.root").alias("home"), F.coalesce(share(F.col("home.w")), F.lit(0)).alias("h"), F.coalesce(share(F.col("total") - F.col("home.w")), F.lit(1)).alias("r"))
    deal = F.xxhash64("id", F.lit(2))
    at = F.when(F.col("h") == 0, 0).when(F.col("root") == F.col("home"), F.pmod(deal, F.col("h"))).otherwise(F.col("h") + F.pmod(deal, F.col("r"))).cast("int")
    from_ = F.when(F.col("at") < F.col("h"), F.col("h")).otherwise(0)
    others = F.sequence(from_, F.col("h") + F.col("r") - 1)
    parts = F.transform(others, lambda j: F.least("at", j).cast("long") * (F.col("h") + F.col("r")) + F.greatest("at", j))
    return rows.join(sums, "key").withColumn("at", at).select("key", F.explode(parts).alias("part"), "id", "root")


def spanning(found: list[np.ndarray], roots: np.ndarray) -> list[tuple[int, int]]:
    """Places of sets, of distinct 32-bit shingles, that are linked: with the components `roots` they
    connect all that pairs of at least 0.8 would."""
    n = np.array([len(s) for s in found], np.int64)
    label = np.unique(roots, return_inverse=True)[1]
    _, code = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(np.arange(len(found)), n)
    counts = np.bincount(code, minlength=1)
    posted = owner[np.argsort(code, kind="stable")]
    begin = np.cumsum(counts) - counts
    ends = np.cumsum(n)
    # A set can't be linked that shares too few of its shingles with all others together.
    shared = np.bincount(owner, counts[code] > 1, len(found)).astype(np.int64)
    able = (9 * shared >= 4 * (n + n.min())) & (5 * shared >= 4 * n)
    links = []
    for k in np.flatnonzero(able):
        if (label[able] == label[k]).all():
            continue
        own = code[ends[k] - n[k] : ends[k]]
        own = own[counts[own] > 1]
        each = counts[own]
        places = np.repeat(begin[own] - np.cumsum(each) + each, each) + np.arange(each.sum())
        both = np.bincount(posted[places], minlength=len(found))
        # both / (m + n - both) >= 4 / 5
        for j in np.flatnonzero((9 * both >= 4 * (n + n[k])) & (label != label[k])):
            if label[j] != label[k]:
                links.append((int(k), int(j)))
                label[label == label[j]] = label[k]
    return links


def within(rows: DataFrame, whole: DataFrame, most: int | None = None) -> DataFrame:
    """Links (a, b) that connect what the buckets of `rows` (key, id, n, root) still have apart."""

    def linked(ids: list[int], roots: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = [(max(ids[k], ids[j]), min(ids[k], ids[j])) for k, j in spanning(found, np.array(roots, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A part's rows follow each other, maybe over several batches.
        now, ids, roots, found = None, [], [], []
        for batch in batches:
            some = batch.column(4)
            values, ends = some.values.to_numpy(), some.offsets.to_numpy()
            for k, (key, part, id_, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if (key, part) != now:
                    if len(ids) > 1:
                        yield linked(ids, roots, found)
                    now, ids, roots, found = (key, part), [], [], []
                ids.append(id_)
                roots.append(root)
                found.append(values[ends[k] : ends[k + 1]].copy())
        if len(ids) > 1:
            yield linked(ids, roots, found)

    met = blocks(rows, most or MOST).join(whole.select("id", "shingles"), "id").select("key", "part", "id", "root", "shingles")
    return met.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(links, "a bigint, b bigint").distinct()


def roots(whole: DataFrame) -> DataFrame:
    """(vertex, root) of the sets of `whole` (id, bits, bands, shingles) that have a near-duplicate."""
    counted = whole.select("id", "shingles")
    links = common.cut(verified(common.cut(near(whole)), counted))
    rows = whole.select(F.explode("bands").alias("key"), "id", F.size("shingles").alias("n"))
    rows = _mixed(rows, simhash.components(links))
    links = common.cut(links.union(verified(common.cut(central(rows)), counted)))
    rows = _mixed(rows.drop("root"), simhash.components(links))
    return simhash.components(links.union(within(rows, whole)))


def _chosen(docs: DataFrame) -> DataFrame:
    """(_chosen, _first, _rows) of each component: the id and the content address of the row that
    stays, and how many rows are alike in both."""
    marked = common.written(sets(docs.select("doc_id", "text")))
    # Rows of one id may have several texts, or one text several times.
    each = common.written(marked.groupBy("id", "doc_id", "address").agg(F.count("*").alias("rows")))
    whole = common.written(marked.groupBy("id").agg(*[F.first(c).alias(c) for c in ("bits", "bands", "shingles")]))
    common.dropped(marked)
    known = common.cut(roots(whole))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "address", "rows")
    least = each.groupBy("id").agg(F.min(row).alias("first"))
    least = least.join(known, least["id"] == known["vertex"], "left").select(F.coalesce("root", "id").alias("root"), "first")
    chosen = least.groupBy("root").agg(F.min("first").alias("first"))
    return common.cut(chosen.select(F.col("first.doc_id").alias("_chosen"), F.col("first.address").alias("_first"), F.col("first.rows").alias("_rows")))


def firsts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) with one row of each component: that of the least doc_id, null ids
    last, and of rows with that id the one with the least content address.

    The texts aren't moved before the last join: only the rows' ids and content addresses are compared.
    """
    with common.scope():
        chosen = _chosen(docs)
    # Rows travel as one value, so that their columns may have any names.
    rows = docs.select(F.col("doc_id").alias("_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("_address"), F.struct("*").alias("_row"))
    kept = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_chosen")) & (F.col("_address") == F.col("_first")))
    single = kept.where("_rows = 1").select("_row")
    several = kept.where("_rows > 1").dropDuplicates(["_id", "_address"]).select("_row")
    return single.unionByName(several).select("_row.*")
