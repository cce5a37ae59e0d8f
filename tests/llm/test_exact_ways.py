"""Exact ways past the cuts that keep operators fast."""


def test_licences_of_common_words_are_found_exactly(spark):
    from sonolake.llm import licenses
    from sonolake.llm.licence_texts import TEMPLATES

    words = TEMPLATES[1][2].split()
    filler = [(100 + i, "filler licensed under cc by sa 4 0") for i in range(60)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words))), (3, "plain prose"), (4, None), *filler], "doc_id long, text string")
    assert {r.labels for r in licenses.digest(d).where("doc_id >= 100").collect()} == {""}, "by rare words, as the SQL has it"
    got = {r.doc_id: r for r in licenses.digest(d, exact=True).collect()}
    assert len(got) == 64 and {got[i].labels for i in range(100, 160)} == {"cc-by-sa"} and got[100].score == 1.0
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["mit", "", "", ""]


def test_what_a_forest_left_out_between_classes_is_compared_again(spark):
    from sonolake.llm import neardup

    # 40 fingerprints a few bits apart: all tables are crowded, and forests keep 39 of 780 pairs
    rows = [(k, (1 << (k % 20)) | (1 << 20 if k % 2 else 0), 5) for k in range(40)]
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long")
    edges = neardup.candidates(nodes, 40)
    met = {(r.a, r.b) for r in edges.collect()}
    assert len(met) < 780 and all(r.forest for r in edges.where("lead = 0").collect())
    roots = {k: 0 if k < 20 else 20 if k < 38 else 38 for k in range(40)}
    root = spark.createDataFrame(sorted(roots.items()), "node long, root long")
    found = {(r.a, r.b) for r in neardup.left_out(nodes, edges, root, 40).collect()}
    assert found | met == {(a, b) for a in range(40) for b in range(a + 1, 40) if roots[a] != roots[b]} | met and not found & met
    assert neardup.left_out(nodes, edges, spark.createDataFrame([(k, 0) for k in range(40)], "node long, root long"), 40) is None, "one class has nothing left"


def test_licences_without_their_key_phrase_are_not_aligned(spark):
    """Of common words, nearly every text has enough votes somewhere: looked up exactly, all of those would be verified."""
    from sonolake.llm import licenses
    from sonolake.llm.licence_texts import TEMPLATES

    label, phrase, text = TEMPLATES[1]
    broken = text.replace("hereby", "herewith", 1)
    assert phrase.split()[2] == "hereby" and broken != text
    texts = [text, broken, f"{broken} {phrase}", phrase, "plain prose"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).cache()
    found = {r.row: r for r in licenses.aligned(rows.where("line is not null").select("row", "hits", "line"), licenses.rare_index(rows, True), True).collect()}
    ids = {r.row: r.doc_id for r in rows.collect()}
    assert 1 not in {ids[k] for k in found} and {ids[k] for k, r in found.items() if label in r.found} == {0, 2}
