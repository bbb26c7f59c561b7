"""Markdown note parsing on the FIXTURES.md sample."""

from razao.operators import notes

NOTE = "\n".join([
    "---", 'title: "Um: dois"', "tags: a - b", "related:", " - x", " - y", "empty:", "---",
    "head #ação", "---", "body [[link]]", "---", "tail", ""])


def df(spark, text=NOTE):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_front_matter(spark):
    m = {r.key: r for r in notes.front_matter_long(df(spark)).collect()}
    assert m["title"].value == ["Um: dois"] and not m["title"].is_list
    assert m["tags"].value == ["a", "b"]
    assert m["related"].value == ["x", "y"] and m["related"].is_list
    assert m["empty"].value is None


def test_sections_tags_links(spark):
    s = notes.sections(df(spark)).collect()[0]
    assert (s.Head, s.Body, s.Tail) == (["head #ação"], ["body [[link]]"], ["tail"])
    assert notes.tags(df(spark)).collect()[0].tags == ["#ação"]
    assert notes.links(df(spark)).collect()[0].links == ["[[link]]"]


def test_sections_counts(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "h\n---\nb"), (3, "h\n---\nb1\n---\nb2\n---\nt")],
                                 "doc_id long, text string")
    out = {r.doc_id: r for r in notes.sections(rows).collect()}
    assert (out[1].Head, out[1].Body, out[1].Tail) == ([], ["a", "b"], [])
    assert (out[2].Head, out[2].Body, out[2].Tail) == (["h"], ["b"], [])
    assert (out[3].Head, out[3].Body, out[3].Tail) == (["h"], ["b1", "---", "b2"], ["t"])


def test_render_roundtrip(spark):
    d = df(spark)
    text = notes.render(notes.front_matter_long(d), notes.sections(d)).collect()[0].text
    assert text.startswith('---\ntitle: Um: dois\ntags:\n - a\n - b\nrelated:\n - x\n - y\nempty: \n---\n')
    assert "head #ação\n\n---\n\nbody [[link]]\n\n---\n\ntail\n\n---\n" in text
    again = notes.front_matter_long(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert {r.key: r.value for r in again.collect()}["related"] == ["x", "y"]


def test_front_matter_ownership_and_reassignment(spark):
    text = "\n".join(["---", "a:", " - x", "b: 1", " - y", "a: again", "c:", "", " - z", "---", "body", ""])
    m = {r.key: r for r in notes.front_matter_long(df(spark, text)).collect()}
    # items after a scalar key still belong to the last opened list; a later
    # scalar assignment of a list key wins
    assert m["a"].value == ["again"] and not m["a"].is_list and m["a"].key_pos == 0
    assert m["b"].value == ["1"]
    assert m["c"].value == ["z"] and m["c"].is_list
