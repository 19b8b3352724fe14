"""The transliteration format on a two-page file, and its errors."""

import pytest
from pyspark.errors import PySparkException

from corpusloom.sources import transliteration as T

#: Fixed text: every construct of the format.
FILE = """#=IVTFF Eva- 2.0 M 5
# comment line
<f1r>      <! $Q=A $P=A $F=a $B=1 $I=T $L=A $H=1 $C=1 $X=V>
# text only
<f1r.1,@P0>       <%>fachys.ykal.ar<->ataiin,shol<!þ>
<f1r.2,+P0>       sory.ck[h:e]ar.{ck}ey.qo?ar.@181;dy.d'y.chy<~>ol
<f1r.3,=P0>       <@H=2>daiin.chol<$>
<f1r.4,@L0>       otaly
<f2v>      <! $Q=A $P=D $I=H $L=B $H=2>
<f2v.1,@P0>       <%>qokeedy<$>
"""


@pytest.fixture
def files(spark, tmp_path):
    def write(text):
        (tmp_path / "x.txt").write_text(text)
        return T.read(spark, f"{tmp_path}/x.txt")

    return write


def test_header_pages_and_loci(files):
    f = files(FILE)
    assert tuple(T.headers(f).first())[1:] == ("Eva-", "2.0", "M 5")
    pages = T.pages(f).orderBy("page_index").collect()
    assert [tuple(p)[1:8] for p in pages] == [(0, "f1r", "A", "A", "T", "A", "1"), (1, "f2v", "A", "D", "H", "B", "2")]
    assert {x["key"]: x["value"] for x in pages[0]["variables"]}["X"] == "V"
    loci = T.loci(f).orderBy("line_no").collect()
    assert [(x["page"], x["number"], x["position"] + x["category"] + x["detail"]) for x in loci] == [("f1r", "1", "@P0"), ("f1r", "2", "+P0"), ("f1r", "3", "=P0"), ("f1r", "4", "@L0"), ("f2v", "1", "@P0")]


def test_views(files):
    f = files(FILE)
    words = lambda view: [r["words"] for r in T.corpus(f, view).orderBy("line_no").collect()]
    para = words(T.PARAGRAPHS)
    assert para == [["fachys", "ykal", "ar", "ataiin", "shol"], ["sory", "ckhar", "ckey", "dy", "chyol"], ["daiin", "chol"], ["qokeedy"]]
    assert words(T.ALL)[3] == ["otaly"] and len(words(T.ALL)) == 5
    keep = T.replace(T.PARAGRAPHS, drop_unreadable=False, drop_rare=False)
    assert words(keep)[1] == ["sory", "ckhar", "ckey", "qo?ar", "*dy", "dy", "chyol"]
    flags = [(r["para_start"], r["para_end"]) for r in T.corpus(f).orderBy("line_no").collect()]
    assert flags == [(True, False), (False, False), (False, True), (True, True)]
    joined = words(T.replace(T.PARAGRAPHS, uncertain_space_parts=False, gap_parts=False, gap_without_break_parts=True))
    assert joined[0] == ["fachys", "ykal", "arataiinshol"] and joined[1][-2:] == ["chy", "ol"]


def test_strata_and_text(files):
    f = files(FILE)
    b = T.filtered(T.corpus(f), T.pages(f).where("currier = 'B'")).collect()
    assert [(r["page_index"], r["words"]) for r in b] == [(0, ["qokeedy"])]
    assert T.to_text(T.corpus(f)).first()["value"] == "fachys.ykal.ar.ataiin.shol\nsory.ckhar.ckey.dy.chyol\ndaiin.chol\n\nqokeedy\n\n"


def test_items_render_exactly():
    texts = [line.split(">", 1)[1].strip() for line in FILE.splitlines() if "," in line.split(">")[0]]
    for text in [*texts, "a b!c%d@x.<unknown tag>e<!c>[{ab}:c]<@H=3>", "[a:[b:{c}]:]", "a:b]c}", "@12", "", "<@H=é>"]:
        assert T.render(T.parse_items(text)) == text
    items = T.parse_items("<%>ck[h:e]{ck}?@181;'<~>,<$>")
    assert [k for k, _ in items] == ["para_start", "glyph", "glyph", "alternatives", "ligature", "unreadable", "rare", "mark", "gap_without_break", "uncertain_space", "para_end"]


@pytest.mark.parametrize("text, said", [("#=IVTFF Eva- 2.0\n<f1r>\n<f1r.1,@P0> dai[n:m\n", "line 3"), ("#=IVTFF Eva- 2.0\n<f1r.1,P0> x\n", "line 2"), ("#=IVTFF Eva- 2.0\n<f1r\n", "line 2")])
def test_errors_have_line_numbers(files, text, said):
    with pytest.raises(PySparkException, match=said):
        T.corpus(files(text)).collect()


@pytest.mark.parametrize("text, said", [("", "missing"), ("\n \n", "missing"), ("# no header\n", "malformed")])
def test_headers_are_checked(spark, text, said):
    with pytest.raises(PySparkException, match=said):
        T.headers(spark.createDataFrame([("x", text)], "path string, value string")).collect()
    with pytest.raises(T.Malformed):
        T.parse_items("a<b")


def test_text_read_by_patterns_is_that_read_by_items():
    import random
    from dataclasses import replace

    from corpusloom.sources import transliteration as t

    rng, quick = random.Random(5), 0
    parts = ["a", "qo", "k9", ".", ",", "?", "'", "!", "%", "*", " ", "@", "@12;", "1", ";", "{", "}", "{ch}", "[a:b]", "[", "]", ":", "<->", "<~>", "<%>", "<$>", "<!no. {>", "<@H=2>", "<x", ">", "é", "\x01", "\x00"]
    views = [t.PARAGRAPHS, replace(t.ALL, uncertain_space_parts=False, gap_parts=False, gap_without_break_parts=True, drop_unreadable=False, drop_rare=False)]
    for k in range(6000):
        text = "".join(rng.choices(parts[: 15 + k % 20], k=rng.randint(0, 14)))
        for view in views:
            try:
                expected = view.words(t.parse_items(text))
            except t.Malformed:
                expected = None
            try:
                got = view.read(text)
            except t.Malformed:
                got = None
            assert got == expected, text
            quick += view.flattened(text) is not None
    assert quick > 4000
