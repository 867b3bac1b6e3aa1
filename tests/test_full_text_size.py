"""The full-text index and its search at the sizes of very common words (F1 of FINDINGS_r03)."""

from corpusmill.operators import store as ST


def test_common_words_make_no_row_a_chunk(spark):
    """Postings are a row for each term and segment, not for each term and chunk; what holds only a part of a query is no row."""
    docs = [(i, f"every chunk holds these words and number{i}, well-known words") for i in range(400)]
    index = ST.FullText.build(spark.createDataFrame(docs, "chunk_id long, content string").repartition(4))
    assert index.postings.filter("term = 'word'").count() <= 4 and index.n == 400
    queries = [(0, "these words"), (1, "words number7,"), (2, "every absent"), (3, "well-known"), (4, "known-well"), (5, "- !")]
    got = [(r.query_id, r.chunk_id, r["rank"]) for r in ST.full_text(index, spark.createDataFrame(queries, "query_id int, text string"), 3).collect()]
    assert sorted(got) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 7, 1), (3, 0, 1), (3, 1, 2), (3, 2, 3)]


def test_folding_is_by_character():
    import unicodedata

    from corpusmill.functions.stem import folded, stem

    for text in ("Ünï ÇA ́xͅ ṩ", "plain ASCII", "İstanbul", ""):
        assert folded(text) == "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    assert [stem(w) for w in ("relational", "hopping", "adoption")] == ["relat", "hop", "adopt"]
