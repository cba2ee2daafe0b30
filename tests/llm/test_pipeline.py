import corpus_pipeline as c
from netweave.session import table

FOLDER = "/root/testdata/sf0.001"
PROSE = "The river had been rising for three days when the council met, and nobody in the room expected the old bridge to hold. "


def test_stages_take_odd_rows(spark):
    other = "A baker, two sailors and the mayor's cousin argued about flour; in the end, they sold the mill and moved to the coast. "
    rows = [(1, PROSE, "en", "a", 5, "x", 1, "y"), (1, PROSE, "en", "a", 5, "x", 1, "y"), (2, None, None, None, None, None, None, None), (None, PROSE + other, "en", None, 1, "x", 2, "z"), (3, "", "en", "b", 0, "", 0, ""), (4, (other + "\n") * 3 + other * 40, "en", "b", 9, None, 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string, __k1 long, band string")
    for name, stage in c.STAGES:
        got, none = stage(spark, df, FOLDER), stage(spark, df.limit(0), FOLDER)
        more = ["mix_pass", "mix_finish"] if name == "source_mix" else []
        assert got.columns == df.columns + more == none.columns and none.count() == 0, name
        assert {x.doc_id for x in got.collect()} <= {1, 2, 3, 4, None}
    assert [x.doc_id for x in c.drop_low_quality(spark, df.filter("doc_id = 2"), FOLDER).collect()] == []
    kept = {x.doc_id: x for x in c.drop_repeated_lines(spark, df, FOLDER).collect()}
    assert kept[1].text == PROSE and kept[1].n_chars == len(PROSE) and kept[1].band == "y"
    assert sum(line.strip() == other.strip() for line in kept[4].text.split("\n")) == 1


def test_run(spark):
    """Each stage works on what the one before it kept, and its result holds."""
    docs = table(spark, FOLDER, "documents")
    ids = {x.doc_id for x in docs.collect()}
    got = c.run(spark, FOLDER)
    found = got.collect()
    assert found and {x.doc_id for x in found} < ids and got.columns[: len(docs.columns)] == docs.columns
    assert max(x.mix_pass for x in found) < 3 and [x.mix_finish for x in found] == sorted(x.mix_finish for x in found)
    once = got.filter("mix_pass = 0").drop("mix_pass", "mix_finish")
    assert once.count() == len({x.doc_id for x in found})
    again = once
    for _, stage in c.STAGES[2:4]:  # nothing is left for these to find
        again = stage(spark, again, FOLDER)
    assert again.count() == once.count()
    lines = [" ".join(line.lower().split()) for x in once.collect() for line in x.text.split("\n") if line.strip()]
    assert len(lines) == len(set(lines))
