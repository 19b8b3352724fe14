"""Transliteration files: a header, pages with variables, and loci, each a line of marked-up text.

A file is a row (path, value); files are read and parsed on their own, so many of them spread over
the cluster. Lines, identifiers and variables are taken apart by built-in functions; a locus's text
has nested brackets, which an Arrow function parses. parse_items() keeps every construct, and
render() gives the text back exactly; what isn't a locus, a page or the header isn't kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What may stand in a locus's text beside plain glyphs.
SIGNS = {".": "space", ",": "uncertain_space", "?": "unreadable", "'": "mark"}
TAGS = {"-": "gap", "~": "gap_without_break", "%": "para_start", "$": "para_end"}
#: An item is (kind, content): text, or a list of items for a ligature, or a list of those for
#: alternative readings.
Item = tuple


class Malformed(ValueError):
    """A file that isn't of the format, with the number of the line."""


def parse_items(text: str, line: int = 1) -> list[Item]:
    """A locus's text as items. Brackets and tags must be balanced."""
    end = len(text)
    found: list[Item] = []
    # Open brackets: the items around them, the kind, and the readings done so far.
    around: list[tuple[list[Item], str, list]] = []
    at = 0
    while at < end:
        c = text[at]
        at += 1
        if around and c in ("]:" if around[-1][1] == "alternatives" else "}"):
            outer, kind, readings = around[-1]
            if c == ":":
                readings.append(found)
                found = []
                continue
            around.pop()
            outer.append((kind, [*readings, found] if kind == "alternatives" else found))
            found = outer
        elif c in "[{":
            around.append((found, "alternatives" if c == "[" else "ligature", []))
            found = []
        elif c == "<":
            close = text.find(">", at)
            if close < 0:
                raise Malformed(f"line {line}: unbalanced bracket or tag: {text}")
            tag, at = text[at:close], close + 1
            if tag in TAGS:
                found.append((TAGS[tag], ""))
            elif tag.startswith("!"):
                found.append(("comment", tag[1:]))
            elif tag.startswith("@H=") and len(tag.encode()) == 4:
                found.append(("hand", tag[3]))
            else:
                found.append(("tag", tag))
        elif c == "@":
            stop = at
            while stop < end and text[stop] in "0123456789":
                stop += 1
            if stop > at and text[stop : stop + 1] == ";":
                found.append(("rare", text[at - 1 : stop + 1]))
                at = stop + 1
            else:
                found.append(("other", "@"))
        elif c in SIGNS:
            found.append((SIGNS[c], ""))
        elif c in "!%":
            found.append(("filler", c))
        elif not c.isascii():
            found.append(("rare", c))
        else:
            found.append(("glyph" if c.isalnum() else "other", c))
    if around:
        raise Malformed(f"line {line}: unbalanced bracket or tag: {text}")
    return found


def render(items: list[Item]) -> str:
    """The text that the items come from."""
    signs, tags = {v: k for k, v in SIGNS.items()}, {v: k for k, v in TAGS.items()}
    out = []
    for kind, content in items:
        if kind == "alternatives":
            out.append("[" + ":".join(map(render, content)) + "]")
        elif kind == "ligature":
            out.append("{" + render(content) + "}")
        elif kind in signs:
            out.append(signs[kind])
        elif kind in tags:
            out.append(f"<{tags[kind]}>")
        else:
            out.append({"comment": f"<!{content}>", "hand": f"<@H={content}>", "tag": f"<{content}>"}.get(kind, content))
    return "".join(out)


@dataclass(frozen=True)
class View:
    """How a file becomes a corpus: which loci count, what parts words, which words are dropped."""

    id: str
    categories: str
    uncertain_space_parts: bool = True
    gap_parts: bool = True
    gap_without_break_parts: bool = False
    drop_unreadable: bool = True
    drop_rare: bool = True

    def words(self, items: list[Item]) -> tuple[list[str], bool, bool]:
        """The words, and whether the locus starts and ends a paragraph. Of alternative readings the
        first counts; a glyph that can't be read is ?, a rare one *."""
        parting = {"space"} | {k for k, on in (("uncertain_space", self.uncertain_space_parts), ("gap", self.gap_parts), ("gap_without_break", self.gap_without_break_parts)) if on}
        dropping = {c for c, on in (("?", self.drop_unreadable), ("*", self.drop_rare)) if on}
        glyphs, flags = [], set()
        # Items still to come, the next one last.
        waiting = list(reversed(items))
        while waiting:
            kind, content = waiting.pop()
            if kind == "alternatives":
                waiting += reversed(content[0])
            elif kind == "ligature":
                waiting += reversed(content)
            elif kind in parting:
                glyphs.append(" ")
            elif kind in ("para_start", "para_end"):
                flags.add(kind)
            else:
                glyphs.append({"glyph": content, "rare": "*", "unreadable": "?"}.get(kind, ""))
        found = [w for w in "".join(glyphs).split(" ") if w and not dropping & set(w)]
        return found, "para_start" in flags, "para_end" in flags


    def read(self, text: str, line: int = 1) -> tuple[list[str], bool, bool]:
        """words() of a text's items. Text without alternative readings is taken apart by patterns; any
        other, and what may be malformed, item by item."""
        flat = self.flattened(text)
        if flat is None:
            return self.words(parse_items(text, line))
        glyphs, flags = flat
        dropping = "".join(c for c, on in (("?", self.drop_unreadable), ("*", self.drop_rare)) if on)
        found = [w for w in glyphs.split(" ") if w and not any(c in w for c in dropping)]
        return found, "<%>" in flags, "<$>" in flags

    def flattened(self, text: str) -> tuple[str, list[str]] | None:
        """The glyphs, with a space where words part, and the tags; None if it takes a parser."""
        if any(c in text for c in _MARKS):
            return None
        flags = _TAG.findall(text)
        if flags:
            gaps = {tag for tag, on in (("<->", self.gap_parts), ("<~>", self.gap_without_break_parts)) if on}
            text = _TAG.sub(lambda m: _MARKS[1] if m[0] in gaps else _MARKS[0], text)
        if "<" in text or "[" in text:
            return None
        while "{" in text:
            text, n = _LIGATURE.subn(_MARKS[0] + r"\1" + _MARKS[0], text)
            if not n:
                return None
        text = _RARE.sub(_MARKS[2], text)
        return text.translate(_GLYPHS[self.uncertain_space_parts]), flags


class _Glyphs(dict):
    def __missing__(self, code: int) -> str:
        return "*"


#: Stand for what was taken out, for a gap, and for a rare code.
_MARKS = "\x00\x01\x02"
_TAG, _LIGATURE, _RARE = re.compile(r"<[^>]*>"), re.compile(r"\{([^{}]*)\}"), re.compile(r"@[0-9]+;")
_ASCII = {k: chr(k) if chr(k).isalnum() else "" for k in range(128)} | {ord("."): " ", ord("?"): "?", 1: " ", 2: "*"}
#: What each character becomes, by whether an uncertain space parts words.
_GLYPHS = {on: _Glyphs(_ASCII | {ord(","): " " if on else ""}) for on in (True, False)}

#: Paragraph text, and text of every category.
PARAGRAPHS = View("para-v1", "P")
ALL = replace(PARAGRAPHS, id="all-v1", categories="PLCRTX")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _lines(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("k", "raw"))
    return lines.select("path", (F.col("k") + 1).alias("line_no"), F.trim("raw").alias("line"))


def headers(files: DataFrame) -> DataFrame:
    """(path, alphabet, version, extra); an error for a file that doesn't begin with a header. A
    file without a byte is no row."""
    pattern = r"^\s*#=IVTFF\s+(\S+)\s+(\S+)[^\S\n]*([^\n]*)"
    first = F.regexp_extract("value", r"^\s*([^\n]*)", 1)
    missing = F.when(F.length(F.trim(first)) == 0, "missing #=IVTFF header line").when(~first.rlike(pattern), F.concat(F.lit("malformed header: "), first))
    checked = files.where(F.coalesce(F.length(F.when(missing.isNotNull(), F.raise_error(missing))), F.lit(0)) == 0)
    extra = F.regexp_replace(F.trim(F.regexp_extract(first, pattern, 3)), r"\s+", " ")
    return checked.select("path", F.regexp_extract(first, pattern, 1).alias("alphabet"), F.regexp_extract(first, pattern, 2).alias("version"), extra.alias("extra"))


def _tagged(files: DataFrame) -> DataFrame:
    """The lines that open a page or a locus: id, what follows it, and the page's index in its file.

    A page goes on while loci name it; a line of its own opens a new one even of the same name.
    """
    lines = _lines(files).where(F.col("line").startswith("<"))
    unclosed = F.concat(F.lit("line "), F.col("line_no"), F.lit(": unbalanced bracket or tag: "), F.col("line"))
    close = F.when(F.instr("line", ">") == 0, F.raise_error(unclosed).cast("int")).otherwise(F.instr("line", ">"))
    lines = lines.withColumn("_close", close).withColumn("id", F.expr("substring(line, 2, _close - 2)")).withColumn("rest", F.expr("substring(line, _close + 1)")).drop("_close")
    in_file = Window.partitionBy("path").orderBy("line_no")
    lines = lines.withColumn("is_locus", F.col("id").contains(".")).withColumn("page", F.expr("CASE WHEN is_locus THEN substring_index(id, '.', 1) ELSE id END"))
    opens = ~F.col("is_locus") | ~F.col("page").eqNullSafe(F.lag("page").over(in_file))
    return lines.withColumn("page_index", F.sum(opens.cast("int")).over(in_file) - 1)


def page_vars(rest: Column) -> Column:
    """The variables on a page's line, $K=value, as (key, value) in order."""
    pattern = r"\$(?=(.)=([^\s>]*))"
    pairs = F.arrays_zip(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(rest, F.lit(pattern), F.lit(2)).alias("value"))
    return F.filter(pairs, lambda x: x["key"] != "")


def variable(variables: Column, key: str) -> Column:
    """A variable's value: the last one counts, null without any."""
    return F.try_element_at(F.filter(variables, lambda x: x["key"] == key), F.lit(-1))["value"]


def pages(files: DataFrame) -> DataFrame:
    """(path, page_index, name, quire, page_in_quire, illustration, currier, hand, variables)."""
    opened = _tagged(files).groupBy("path", "page_index").agg(F.min_by(F.struct("page", "is_locus", "rest"), "line_no").alias("x"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    variables = F.when(F.col("x.is_locus"), none).otherwise(page_vars(F.col("x.rest")))
    found = opened.select("path", "page_index", F.col("x.page").alias("name"), variables.alias("variables"))
    first = lambda key: F.nullif(F.left(variable(F.col("variables"), key), F.lit(1)), F.lit(""))
    currier = first("L")
    return found.select(
        "path", "page_index", "name", variable(F.col("variables"), "Q").alias("quire"), variable(F.col("variables"), "P").alias("page_in_quire"),
        first("I").alias("illustration"), F.when(currier.isin("A", "B"), currier).alias("currier"), first("H").alias("hand"), "variables",
    )


def loci(files: DataFrame) -> DataFrame:
    """(path, page_index, line_no, page, number, position, category, detail, text)."""
    found = _tagged(files).where("is_locus")
    pattern = r"^([^.]+)\.([^,]+),(.)(.)(.)$"
    malformed = F.concat(F.lit("line "), F.col("line_no"), F.lit(": malformed locus: "), F.col("line"))
    identifier = F.when(F.col("id").rlike(pattern), F.col("id")).otherwise(F.raise_error(malformed))
    found = found.withColumn("_id", identifier)
    part = lambda k: F.regexp_extract("_id", pattern, k)
    return found.select("path", "page_index", "line_no", "page", part(2).alias("number"), part(3).alias("position"), part(4).alias("category"), part(5).alias("detail"), F.trim("rest").alias("text"))


def corpus(files: DataFrame, view: View = PARAGRAPHS) -> DataFrame:
    """(path, page_index, line_no, number, words, para_start, para_end): the loci that keep a word."""
    schema = "path string, page_index bigint, line_no int, number string, words array<string>, para_start boolean, para_end boolean"
    names = ["path", "page_index", "line_no", "number", "words", "para_start", "para_end"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(2).to_pylist()
            found = [view.read(t, n) for t, n in zip(batch.column(4).to_pylist(), numbers)]
            kept = [k for k, (ws, _, _) in enumerate(found) if ws]
            some = batch.take(pa.array(kept, pa.int32()))
            made = [pa.array([found[k][0] for k in kept], pa.list_(pa.string())), *(pa.array([found[k][j] for k in kept], pa.bool_()) for j in (1, 2))]
            yield pa.RecordBatch.from_arrays([*some.columns[:4], *made], names)

    # Text outside the view is parsed too: a file with an unbalanced bracket is malformed under any.
    every = loci(files).withColumn("_in", F.instr(F.lit(view.categories), F.col("category")) > 0)
    chosen = every.select("path", F.col("page_index").cast("bigint").alias("page_index"), "line_no", F.when(F.col("_in"), F.col("number")).alias("number"), "text")
    # A task's work is that of its letters: many more than the bytes that tasks are sized by.
    chosen = chosen.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    return chosen.mapInArrow(rows, schema).where("number IS NOT NULL")


def filtered(lines: DataFrame, kept_pages: DataFrame) -> DataFrame:
    """`lines` on the pages (path, page_index) that are kept; these are numbered anew."""
    numbered = kept_pages.select("path", "page_index", (F.row_number().over(Window.partitionBy("path").orderBy("page_index")) - 1).cast("bigint").alias("_index"))
    return lines.join(numbered, ["path", "page_index"]).withColumn("page_index", F.col("_index")).drop("_index")


def to_text(lines: DataFrame) -> DataFrame:
    """(path, value): words joined by dots, a line for each, an empty one behind each paragraph."""
    line = F.concat(F.array_join("words", "."), F.lit("\n"), F.when(F.col("para_end"), F.lit("\n")).otherwise(F.lit("")))
    gathered = F.array_sort(F.collect_list(F.struct("page_index", "line_no", line.alias("line"))))
    return lines.groupBy("path").agg(F.array_join(F.transform(gathered, lambda x: x["line"]), "").alias("value"))


# Registered query ------------------------------------------------------------------------------


def written_as(lines: DataFrame) -> DataFrame:
    """Corpus lines as files of this format, one for each page: words in ligatures and alternative
    readings, all ways to part them, x as a glyph that can't be read and z as a rare one."""
    def word(w: Column, k: Column) -> Column:
        w = F.replace(F.replace(w, F.lit("x"), F.lit("?")), F.lit("z"), F.lit("@123;"))
        w = F.when(w.startswith("q"), F.concat(F.lit("["), w, F.lit(":{o}e]"))).when((F.length(w) % 5 == 4) & ~w.startswith("@"), F.concat(F.lit("{"), F.left(w, F.lit(1)), F.lit("}'"), F.substr(w, F.lit(2)))).otherwise(w)
        apart = F.when(k == 0, "").when(k % 4 == 1, ".").when(k % 4 == 2, ",").when(k % 4 == 3, "<->").otherwise("<!aside>.")
        return F.concat(apart, w)

    text = F.concat(
        F.when(F.col("para_start"), "<%>").otherwise("<@H=2>"), F.array_join(F.transform("words", word), ""), F.when(F.col("para_end"), "<$>").otherwise("%")
    )
    locus = F.concat(F.lit("<p."), F.col("line_no") + 1, F.when(F.col("line_no") % 5 == 4, ",@L0>   ").otherwise(",+P0>   "), text)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", locus.alias("x")))), lambda x: x["x"]), "\n")
    head = F.concat(F.lit("#=IVTFF Eva- 2.0\n# a comment\n<p>  <! $Q="), F.first("quire"), F.lit(" $L="), F.when(F.first("stratum") == "en", "A").when(F.first("stratum") == "fr", "B").otherwise("C"), F.lit(">\n"))
    return lines.groupBy("page_no").agg(F.concat(head, body).alias("value")).select(F.col("page_no").cast("string").alias("path"), "value")


def transliteration_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written in this format and read back: (page_no, quire, currier, number, line, flags)."""
    from . import corpus as documents

    files = written_as(documents.lines(spark, sf_dir))
    found = corpus(files).join(pages(files).select("path", "page_index", "quire", "currier"), ["path", "page_index"])
    return found.select(F.col("path").cast("bigint").alias("page_no"), "quire", "currier", "number", F.array_join("words", ".").alias("line"), "para_start", "para_end")


#: The same from the corpus itself: words with x or z are dropped, and every fifth line is a label.
SQL = """SELECT page_no, quire, CASE stratum WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' END AS currier, CAST(line_no + 1 AS VARCHAR) AS number,
  list_aggregate(list_filter(words, lambda w: NOT regexp_matches(w, '[xz]')), 'string_agg', '.') AS line, para_start, para_end FROM lines
  WHERE line_no % 5 <> 4 AND len(list_filter(words, lambda w: NOT regexp_matches(w, '[xz]'))) > 0"""
