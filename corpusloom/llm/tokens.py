"""Token counts by a map-side two-tier lookup.

The tokenizer's pieces never hold a space behind another character (checked when it is loaded),
so a text may be cut before every space that follows another character, and the tokens of the
parts add up. Such a part, a pre-token, is looked up first in a compact table of the corpus's
frequent pre-tokens, broadcast once, then in the worker's cache; what both miss is encoded in
batches. Pre-tokens are never shuffled.

The table is counted on the driver from a bounded sample of texts (`SAMPLE` rows, each task's list
bounded too); it sets the speed, and never a count.

Defined results: null and empty texts have 0 tokens; texts are counted whole, in parts; texts
that hold the library's own space mark or a null character go to the library uncut; repeated rows
and ids are rows like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: Texts with these go to the library whole: it treats them apart.
ODD = re.compile(f"[{MARK}\x00]")
PART = re.compile(" +[^ ]*")


def parts(text: str) -> list[str]:
    """The pre-tokens of a text, each without the one space that stands before it; the library
    itself puts that space before whatever it encodes."""
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [p[1:] for p in PART.findall(" " + text)]


class Frequent(dict):
    """The first tier; what it lacks is in `rest`, the second."""

    rest: common.Recent

    def __missing__(self, part: str) -> int:
        return self.rest[part]


class Counts:
    """Counts tokens in one worker process."""

    kept: dict = {}

    @classmethod
    def of(cls, name: str, version: str, table) -> "Counts":
        """The worker's own, for a tokenizer file and a broadcast table of (words, lengths)."""
        if (name, version) not in cls.kept:
            cls.kept = {(name, version): cls(name, *table.value)}
        return cls.kept[name, version]

    def __init__(self, name: str, words: str = "", lengths: bytes = b"", room: int = 300_000):
        import public_tokenizers
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = (self.library.id_to_piece(k) for k in range(self.library.get_piece_size()))
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        self.frequent = Frequent(zip(words.split(" "), lengths) if words else ())
        self.frequent.rest = common.Recent(room)

    def _plain(self) -> bool:
        """Whether the library leaves characters and spaces as they are, but for one in front."""
        return all(self.library.decode(self.library.encode(x)) == x for x in ("a  b", " a", "a ", "ﬁ ½ Ａ", "a\tb", "é\n", "e\u0301"))

    def one(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))

    def count(self, texts: list[str]) -> list[int]:
        cut = [parts(t) if self.cuts and not ODD.search(t) else None for t in texts]
        rest = self.frequent.rest
        missing = rest.lacking(set().union(*filter(None, cut)) - self.frequent.keys())
        if missing:
            rest.update(zip(missing, map(len, self.library.encode(missing, num_threads=1))))
        if "" in rest:  # a space at a text's end; alone, the library takes it for no text
            rest[""] = self.one("a ") - self.one("a")
        look = self.frequent.__getitem__
        return [self.one(t) if ps is None else sum(map(look, ps)) for t, ps in zip(texts, cut)]


#: How many texts, about, the table of frequent words is counted from, and in how many tasks.
SAMPLE, TASKS = 20_000, 16


def frequent(texts: DataFrame, size: int = 65_536, each: int = 16_384, sample: int = SAMPLE) -> list[str]:
    """The most frequent words between spaces in a sample of about `sample` texts. TASKS tasks return
    `each` words at most, whatever the table's size; their sums' `size` largest count."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for some in common.slices(batch, 0):
                for text in some.column(0).to_pylist():
                    seen.update(text.split(" "))
        top = [(w, n) for w, n in seen.most_common(each) if n > 1 and len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    rows = texts.count()
    chosen = texts.sample(False, min(1.0, sample / max(rows, 1)), 9)
    total: Counter = Counter()
    for r in chosen.repartition(TASKS).mapInArrow(head, "word string, n bigint").collect():
        total[r["word"]] += r["n"]
    return [w for w, _ in total.most_common(size)]


def count(docs: DataFrame, name: str = PIECES, size: int = 65_536) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, n_bytes, n_tokens)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = [w for w in frequent(docs.select("text"), size) if w and not ODD.search(w)]
    lengths = Counts(name).count(words)
    known = [(w, n) for w, n in zip(words, lengths) if n < 256]
    table = docs.sparkSession.sparkContext.broadcast((" ".join(w for w, _ in known), bytes(n for _, n in known)))

    version = uuid.uuid4().hex

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts.of(name, version, table)
        for batch in batches:
            for some in common.slices(batch, 1):
                n_tokens = counts.count(some.column(1).to_pylist())
                n_bytes = pc.binary_length(some.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), n_bytes, pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return count(docs).select("*", (F.col("n_tokens") > 4096).alias("over_limit"))
