"""Operators against plain Python that recomputes them from their definitions."""

import hashlib
import math
import re
import struct

import numpy as np
import regex
import xxhash

from corpusloom.llm import catalog, fingerprints, pii, secrets


def query(n):
    return next(q for name, q in catalog.QUERIES.items() if name.startswith(f"op{n}_"))


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def hashed(*values):
    """The hash of columns, each seeded by the one before; nulls are passed over."""
    seed = 42
    for kind, x in values:
        if x is not None:
            seed = xxhash.xxh64_intdigest(x.encode() if kind == "s" else struct.pack({"i": "<i", "l": "<q"}[kind], x), seed)
    return signed(seed)


def test_fingerprints(spark, table):
    rng = np.random.default_rng(4)
    words = [f"w{k}é" if k % 3 else f"W{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(5, 60))) for _ in range(40)] + [None, "", "...", "only me", "only you"]
    texts += [texts[0], texts[1] + " more"]
    got = query(2)(spark, table(texts)).toPandas().set_index("doc_id").sort_index()
    terms = [sorted({hashed(("i", fingerprints.SEED), ("s", w)) for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w}) for t in texts]
    count: dict = {}
    for ts in terms:
        for t in ts:
            count[t] = count.get(t, 0) + 1
    band = {t for t, n in count.items() if 0.01 * len(texts) <= n <= max(2.0, 0.1 * len(texts))}

    def slots(text):
        every = sorted({hashed(("i", fingerprints.SEED), ("s", w)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w})
        own = [t for t in every if t in band] or every
        found: dict = {}
        for t in own:
            slot = (t & (1 << 64) - 1) >> 57
            found[slot] = hashed(("l", found[slot]), ("l", t)) if slot in found else hashed(("l", t))
        return [slot << 24 | h & (1 << 24) - 1 for slot, h in found.items()]

    def shown(text):
        return "".join(f"{x:08x}" for x in slots(text)) or "text-" + hashlib.sha256(text.encode()).hexdigest()

    def likeness(a, b):
        if a == b:
            return 1.0
        x, y = set(slots(a)), set(slots(b))
        either = {v >> 24 for v in x | y}
        return len(x & y) / len(either) if either else 0.0

    order = sorted(range(len(texts)), reverse=True)
    for at, k in enumerate(order):
        text, following = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got.loc[k]
        assert (row.fingerprint, row.edited_fingerprint) == (shown(text), shown(edited))
        assert math.isclose(row.near_edited, likeness(text, edited)) and math.isclose(row.near_next, likeness(text, following))
    assert got.loc[44].near_next > 0  # rare terms alone still tell near copies


def test_large_groups_of_copies_keep_their_terms(spark, table):
    """A third of the rows are one text, and count once: its terms stay in the band."""
    rng = np.random.default_rng(5)
    others = [" ".join(f"a{rng.integers(0, 4000)}" for _ in range(30)) for _ in range(240)]
    copy = " ".join(f"c{k}" for k in range(30))
    sf_dir = table(others + [copy] * 120)
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    known = set(fingerprints.lexicon(docs, lo=0.0))
    assert all(hashed(("i", fingerprints.SEED), ("s", f"c{k}")) in known for k in range(30))


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def test_personal_data():
    rng = np.random.default_rng(2)
    pieces = ["a", "b.c", "@", "@", ".", "-", "+", "1", "22", "255", "256", "300", " ", "(", ")", "4111111111111111", "4111 1111 1111 1111", "4012-8888-8888-1881", "+49 30 123456", "é", "x@y.zz", "1.2.3.4", "\n", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces, rng.integers(0, 14)))
        expected = [(kind, m.start(), m.end()) for kind, (pattern, valid) in BASE.items() for m in re.finditer(pattern, text) if valid(m[0])]
        assert [s for s in pii.find(text) if s[0] in BASE] == expected, text


def test_sharding(spark, table):
    rng = np.random.default_rng(3)
    texts = ["w" * int(rng.integers(0, 30)) if k % 7 else None for k in range(150)]
    docs = spark.read.parquet(table(texts, twice=(3, 9)) + "/documents.parquet").collect()
    got = sorted(map(tuple, query(8)(spark, table(texts, twice=(3, 9))).select("doc_id", "size", "text_crc32", "shard", "slot").collect()))
    import zlib

    rows = [(r["source"], r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs]
    key = lambda r: hashed(("i", 8), ("l", r[1]), ("l", r[2]), ("l", r[3]))
    line = []
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (key(r), r[1]))
        line += [((k + 0.5) / len(own), hashed(("i", 8), ("s", source)), key(r), r) for k, r in enumerate(own)]
    line.sort(key=lambda x: (x[0], x[1], x[2], x[3][1]))
    n = len(line)
    expected = []
    for place, (*_, r) in enumerate(line):
        shard = (place * 16 + 15) // n
        expected.append((*r[1:], shard, place - shard * n // 16))
    assert got == sorted(expected)
    # Every shard matches the mixture: of each source its share, but for one row or two.
    shares = {s: sum(r[0] == s for r in rows) / n for s in {r[0] for r in rows}}
    for k in range(16):
        own = [r for place, (*_, r) in enumerate(line) if (place * 16 + 15) // n == k]
        assert all(abs(sum(r[0] == s for r in own) - share * len(own)) <= 2 for s, share in shares.items())


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above its bound is shared anew until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, found = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not full:
            return found | {s: weight[s] * level for s in free}, order
        found |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return found, order


def test_mixing(spark, table):
    rng = np.random.default_rng(6)
    texts = [" ".join(["w"] * int(rng.integers(0, 40 if k % 3 else 4))) or None for k in range(90)]
    sf_dir = table(texts)
    docs = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in spark.read.parquet(sf_dir + "/documents.parquet").collect()]
    sizes: dict = {}
    for _, source, size in docs:
        sizes[source] = sizes.get(source, 0) + size
    wanted, order = targets(sizes)
    # Of small sources every word is a block of its own.
    want = {s: wanted[s] * max(sizes[s], 1) / max(sizes[s], 1) for s in order}
    total, edges, upto = sum(want.values()), [], 0.0
    for s in order:
        upto += want[s]
        edges.append(math.floor(upto / total * (1 << 32) + 0.5))
    times = {s: [0] * sizes[s] for s in order}
    rank = dict.fromkeys(order, 0)
    for i in range(math.floor(total + 0.5)):
        point = i * 2654435769 % (1 << 32)
        s = next(s for s, hi in zip(order, edges) if point < hi)
        if rank[s] < 3 * sizes[s]:
            times[s][rank[s] % sizes[s]] += 1
        rank[s] += 1
    expected = {}
    for s in order:
        at = 0
        for doc_id, _, size in sorted((d for d in docs if d[1] == s), key=lambda d: (hashed(("i", 10), ("l", d[0]), ("l", d[2])), d[0])):
            expected[doc_id] = sum(times[s][at : at + size])
            at += size
    for r in query(10)(spark, sf_dir).collect():
        source = docs[[d[0] for d in docs].index(r["doc_id"])][1]
        assert math.isclose(r["target"], wanted[source], abs_tol=1e-6) and r["source_size"] == sizes[source]
        assert r["taken"] == expected[r["doc_id"]]


def test_stored_ledger(spark, table, tmp_path):
    """A second run scans nothing that the stored ledger holds under the same rules."""
    docs = spark.read.parquet(table(["token=abcdefabcdef", "clean", "clean", None]) + "/documents.parquet")
    path = f"{tmp_path}/ledger"
    assert secrets.append(docs, path).count() == 3
    assert secrets.unseen(secrets.address(docs), secrets.load(spark, path)).isEmpty()
    more = docs.union(spark.createDataFrame([(9, "password: 0123456789abcdef", "en", "s", 1, "", "")], docs.schema))
    assert secrets.append(more, path).count() == 4
    assert len(secrets.RULE_VERSION) == 16
