"""The word bag holds every word, and draws from its table are those of a list in one task."""

from collections import Counter

from corpusloom.operators import generators


def test_every_word_is_in_the_bag(spark):
    counts = {f"w{k:04d}": 1 + (k % 7 == 0) * (k % 50) for k in range(2500)}
    words = [w for w, n in counts.items() for _ in range(n)]
    bag = generators.word_bag(spark.createDataFrame([(w,) for w in words], "w string"))
    expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    rows = bag.orderBy("before").collect()
    assert [(r["w"], r["n"]) for r in rows] == expected
    layouts = {3: [300, 0, 900], 8: [50]}
    pages = spark.createDataFrame(list(layouts.items()), "page_no bigint, layout array<int>")
    got = {(r["page_no"], r["seed"], r["line_no"]): r["words"] for r in generators.drawn_pages(pages, 2, bag).collect()}
    plain = {(r["page_no"], r["seed"], r["line_no"]): r["words"] for r in generators.simulate(pages, "bagofwords", 2, resources={"word_bag": expected}).collect()}
    assert got == plain
    drawn = {w for line in got.values() for w in line}
    assert drawn - {w for w, _ in expected[:2000]} and sum(Counter(words).values()) == rows[0]["total"]
