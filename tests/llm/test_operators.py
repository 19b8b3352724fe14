"""The ten queries against plain Python on small tables, with nulls, ties, repeats and long texts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import catalog, packing, pii, quality, simhash, substrings, suffixes

WORD = re.compile("[^\x20\x09-\x0d]+")
ALL = list(catalog.QUERIES)


def run(spark, name, sf_dir):
    return catalog.QUERIES[name](spark, sf_dir).toPandas()


def query(n):
    return next(name for name in ALL if name.startswith(f"op{n}_"))


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, table, name):
    assert len(run(spark, name, table([]))) == 0


def test_packing(spark, table, odd_texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    got = run(spark, query(1), table(odd_texts, twice=(4, 9)))
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    expected = Counter()
    for k, t in list(enumerate(odd_texts)) + [(4, odd_texts[4]), (9, odd_texts[9])]:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) - start) % 1024 or 1024
            expected[k, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start, piece = start + n, piece + 1
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == expected
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 1


def test_plan_places_every_piece():
    counts = {1024: 3, 700: 5, 512: 7, 300: 11, 24: 100, 1: 2000}
    filled = Counter()
    for length, rank, count, first, offset in packing.plan(counts, 1024):
        for k in range(count):
            assert filled[first + k] == offset
            filled[first + k] += length
    assert max(filled.values()) <= 1024
    assert sum(filled.values()) == sum(k * n for k, n in counts.items())


def test_ids_are_the_librarys():
    ids = packing.Ids(packing.TOKENS)
    texts = ["a  b", " \xa0 \xa0 x", "a \n b\n c", "<|endoftext|> a<|endoftext|>", "", "  ", "x \t y", "it's I'LL 'quote'", "a" * 3000, " " * 5000 + "x", "=-" * 900, "日本語 €5 “q” ﬁ ½"]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1\n{chr(c)}" for c in [*range(0x600), *range(0x2000, 0x2100), 0x3000, 0x4E00, 0x1F600]]
    for t in texts:
        assert ids.of_text(t) == ids.library.encode(t, add_special_tokens=False).ids


def test_fingerprints(spark, table, odd_texts):
    got = run(spark, query(2), table(odd_texts)).set_index("doc_id").sort_index()
    order = sorted(range(len(odd_texts)), reverse=True)
    for at, k in enumerate(order):
        text, following = odd_texts[k] or "", odd_texts[order[(at + 1) % len(order)]] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got.loc[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got.loc[k].n_chars == len(text)
    assert got.loc[4].fingerprint == got.loc[5].fingerprint
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_simhash(spark, table, odd_texts):
    import xxhash

    got = run(spark, query(3), table(odd_texts, twice=(4,))).drop_duplicates().set_index("doc_id").sort_index()
    prints = {}
    for k, t in enumerate(odd_texts):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got.loc[k].fingerprint == f"{prints[k]:016x}"
    for k in prints:
        reach, todo = {k}, [k]
        while todo:
            a = todo.pop()
            new = {b for b in prints if b not in reach and (prints[a] ^ prints[b]).bit_count() <= 2}
            reach |= new
            todo += new
        assert got.loc[k].component_id == min(reach)


def test_anchors_join_what_differs_in_two_bits(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 62), 1 << 62, 30)
    points = {int(b) for b in base}
    for b in base:
        for _ in range(3):
            i, j = rng.integers(0, 63, 2)
            points.add(int(b) ^ (1 << int(i)) ^ ((1 << int(j)) if i != j else 0))
    df = spark.createDataFrame([(p,) for p in points], "bits bigint")
    roots = {r["vertex"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    linked = {p: {q for q in points if ((p ^ q) & (1 << 64) - 1).bit_count() <= 2} for p in points}
    for p in points:
        for q in linked[p]:
            assert roots.get(p, p) == roots.get(q, q)
    assert len({roots.get(p, p) for p in points}) == 30


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["vertex"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_pii(spark, table):
    texts = [None, "", "mail a.b@c.de, x@y and @z.com; 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111 and +49 (30) 1234-567.", "a@b.c@d.e @q.r@s.t", "9" * 5000]
    got = run(spark, query(4), table(texts)).set_index("doc_id").sort_index()
    assert got.loc[2].spans == "email:5:13,ip:31:38,ip:39:46"
    assert got.loc[3].n_card == 1 and got.loc[3].n_phone == 1
    assert got.loc[4].spans == "email:0:5,email:11:18"
    assert got.loc[0].spans == "" and got.loc[5].n_card == 0
    assert got.loc[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_added_kinds_need_checksum_or_context():
    assert [s[0] for s in pii.find("pay DE89370400440532013000 now")] == ["iban"]
    assert pii.find("pay DE89370400440532013001 now") == []
    assert [s[0] for s in pii.find("SSN 123-45-6789")] == ["id_number"]
    assert pii.find("part 123-45-6789") == []
    text = "mail a@b.cd or 1.2.3.4"
    assert pii.mask(text, pii.find(text)) == "mail <email> or <ip>"


def test_secrets(spark, table, odd_texts):
    texts = [*odd_texts, "token=secret: abcdefghijklmnop API_KEY = 'abcdefghijkl'", "deadbeefdeadbeef00 ghp_" + "a" * 36]
    got = run(spark, query(5), table(texts, twice=(4, 11))).drop_duplicates().set_index("doc_id").sort_index()
    patterns = (
        ("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    )
    for k, t in enumerate(texts):
        spans = sorted((m.start(), r, m.end(), kind) for r, (kind, p, g, least) in enumerate(patterns) for m in p.finditer(t or "") if len(m[g]) >= least)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert got.loc[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert "forge_token" in got.loc[13].spans


def test_secret_ledger_scans_only_what_is_new(spark, table):
    from corpusloom.llm import common, secrets

    first = common.table(spark, table(["token=abcdefabcdef", "clean"]), "documents")
    ledger = secrets.update(first)
    both = first.unionByName(first.limit(0)).collect()
    docs = spark.createDataFrame(both + [(9, "password: 0123456789abcdef", "en", "s", 1, "", "")], first.schema)
    assert secrets.unseen(secrets.address(docs), ledger).count() == 1
    assert secrets.update(docs, ledger).count() == 3


def test_quality(spark, table, odd_texts):
    got = run(spark, query(6), table(odd_texts, twice=(8,))).drop_duplicates().set_index("doc_id").sort_index()
    for k, t in enumerate(odd_texts):
        t = t or ""
        words = WORD.findall(t)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(got.loc[k][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]]) == expected
        assert not (failed and got.loc[k].kept)


def test_quality_lines(spark, table):
    prose = "\n".join(" ".join(f"word{k}of{j}" for j in range(12)) + "." for k in range(5))
    menu = "\n".join(f"Home{k} | About{k} | Contact{k} | News{k} | Help{k}" for k in range(6))
    got = run(spark, query(6), table([prose, menu, prose + "\n" + menu[:60]])).set_index("doc_id").sort_index()
    assert list(got.kept) == [True, False, True]


SEPARATORS, SIGNS = set("|»›·•"), set("#*$%&|<>{}=~^\\@")


def line_fails(line):
    """The three line rules in plain Python."""
    words = WORD.findall(line)
    chars = sum(map(len, words))
    n = len(re.split("[\x20\x09-\x0d]+", line))
    signs, shouts, separators = (sum(c in some for c in line) for some in (SIGNS, {"!"}, SEPARATORS))
    ends = re.search("[.!?…:;。！？][\"'”’»)\\]]*(?:[\x20\x09-\x0d]|$)", line)
    low = line.lower()
    return not ends or signs * 5 > chars or (shouts >= 3 and shouts * 4 > n) or (separators >= 2 and separators * 3 >= n) or any(x in low for x in quality.BOILERPLATE)


def test_line_rules_against_plain_python(spark):
    rng = np.random.default_rng(9)
    words = ["alpha", "beta.", "gamma!", "delta", "|", "»", "#", "$$$", "end.\"", "x;y", "Click here", "ALL RIGHTS RESERVED.", "é…", "", "\t", "!!", "a:b", "(so?)"]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(1, 7))) for _ in range(600)] + [None, "", "\n\n"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in quality.measure(docs).collect()}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        fails = [bool(WORD.search(x)) and line_fails(x) for x in lines]
        kept = sum(len(w) for x, f in zip(lines, fails) if not f for w in WORD.findall(x))
        assert got[k]["n_failing_lines"] == sum(fails), t
        assert got[k]["clean_text"] == (t if not any(fails) else "\n".join(x for x, f in zip(lines, fails) if not f))
        assert got[k]["kept_chars"] == kept
        assert got[k]["kept"] == (not got[k]["base_failed"] and 2 * kept >= got[k]["word_chars"])


def test_cleaning_removes_failing_lines(spark):
    prose = "\n".join(" ".join(f"word{k}of{j}" for j in range(12)) + "." for k in range(5))
    rows = [(1, prose + "\nHome | About | News | Help\n\n" + prose.upper(), "a", 7), (None, "Home | About", "b", 8), (None, prose, "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kept string, _row int")
    got = sorted(map(tuple, quality.clean(docs).collect()), key=str)
    assert got == sorted([(1, prose + "\n\n" + prose.upper(), "a", 7), (None, prose, "c", 9)], key=str)


def removed(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


def compared(spark, sf_dir, texts):
    got = run(spark, query(7), sf_dir).set_index("doc_id").sort_index()
    for k, expected in enumerate(removed(texts)):
        assert tuple(got.loc[k][["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == expected


def noise(rng, n):
    return "".join(rng.choice(list("abcdé \n"), n))


@pytest.mark.parametrize("most", [1 << 20, 2500])
def test_substrings(spark, table, monkeypatch, most):
    rng = np.random.default_rng(1)
    shared, period = noise(rng, 300), "ab" * 400
    texts = [None, "", noise(rng, 900), noise(rng, 500) + shared + noise(rng, 500), shared + noise(rng, 700), noise(rng, 90) + shared]
    texts += [period, noise(rng, 40) + "xyz" * 150, noise(rng, 600) * 2, "z" * 1200, noise(rng, 50) + "z" * 1100]
    texts += [noise(rng, 100) + shared + noise(rng, 100) for _ in range(4)]
    monkeypatch.setattr(substrings.removable, "__defaults__", (200, substrings.GRAMS, most))
    compared(spark, table(texts), texts)


@pytest.mark.parametrize("most", [60_000, 5000])
def test_substrings_of_a_large_group(spark, table, monkeypatch, most):
    """A passage that many differing texts share, and near copies with one change each: single keys
    with far more differing segments than a shard takes, at every length of key."""
    rng = np.random.default_rng(4)
    passage, base = noise(rng, 420), noise(rng, 700)
    texts = [noise(rng, int(rng.integers(150, 260))) + passage + noise(rng, int(rng.integers(150, 260))) for _ in range(150)]
    for _ in range(100):
        at = int(rng.integers(0, 700))
        texts.append(base[:at] + "Q" + str(rng.integers(0, 10**6)) + base[at:])
    monkeypatch.setattr(substrings.removable, "__defaults__", (200, substrings.GRAMS, most))
    monkeypatch.setattr(substrings, "STEP", 300)
    compared(spark, table(texts), texts)


def test_substrings_of_copies(spark, table, odd_texts):
    got = run(spark, query(7), table(odd_texts[:9], twice=(4,)))
    assert (got[got.doc_id == 4].n_removed == 0).all()
    long = "".join(np.random.default_rng(2).choice(list("abcdefgh "), 500))
    got = run(spark, query(7), table([long, long, "b"])).set_index("doc_id").sort_index()
    assert list(got.n_removed) == [500, 500, 0] and list(got.n_spans) == [1, 1, 0]


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for k in range(400):
        t = bytes(rng.choice(list(b"abc") if k % 2 else range(256), rng.integers(0, 120)).tolist()) * (1 + k % 3) + b"ab" * (k % 40)
        a = np.frombuffer(t, np.uint8)
        order = suffixes.suffix_array(a)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        if t:
            assert suffixes._of_names(a.astype(np.int32)).tolist() == order.tolist()


def test_sharding(spark, table, odd_texts):
    got = run(spark, query(8), table(odd_texts * 7, twice=range(10)))
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    for k, t in enumerate(odd_texts):
        row = got[got.doc_id == k].iloc[0]
        assert row["size"] == len((t or "").encode()) + 1 and row.text_crc32 == zlib.crc32((t or "").encode())


def test_token_counts(spark, table, odd_texts):
    import public_tokenizers
    import sentencepiece

    texts = [*odd_texts, "a▁b", " x", "y  ", "\x00 z", "  "]
    got = run(spark, query(9), table(texts, twice=(3,))).drop_duplicates().set_index("doc_id").sort_index()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for k, t in enumerate(texts):
        assert got.loc[k].n_tokens == len(library.encode(t or "")), t
        assert got.loc[k].n_bytes == len((t or "").encode())


def test_mixing(spark, table, odd_texts):
    sf_dir = table([t for t in odd_texts if t is None or len(t) < 9999] * 30, twice=range(20))
    got = run(spark, query(10), sf_dir)
    again = run(spark, query(10), sf_dir)
    key = list(got.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert (got.taken <= 3 * got["size"]).all()
    by_source = got.groupby("source_size").agg({"target": "first", "taken": "sum"})
    assert ((by_source.taken - by_source.target).abs() <= 0.02 * by_source.target + 8).all()
    assert abs(by_source.target.sum() - got["size"].sum()) < 1e-6 * got["size"].sum()


def test_pipeline(spark, table):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(900)]
    texts = [" ".join(rng.choice(words, 60)) + f". Mail user{k}@mail.com now." for k in range(40)]
    texts += [texts[0], texts[1], None, "", "a | b | c | d"]
    docs = spark.read.parquet(table(texts) + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "")
        assert docs.columns == before.columns, name
        if name == "simhash_near_dedup":
            assert {r["doc_id"] for r in docs.collect()} == set(range(40))
        if name == "pii":
            assert docs.where("text LIKE '%@%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.count() > 0
