from corpusmill.llm import pii


def test_terms_far_from_an_entity_give_it_away(spark):
    """A term discloses an entity of its text from any distance, before and after it."""
    far = " ".join(f"filler{k}" for k in range(40))
    rows = [(i, f"Zephyrine {i} wrote {far} to z.q@corp.example and {far} then Quillon left") for i in range(4)] + [(10 + i, f"nothing {i} {far}") for i in range(60)]
    got = {r.doc_id: r.spans.split(",") for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:4]:
        assert [x for x in got[i] if x == f"remove:{text.index('Zephyrine')}:{text.index('Zephyrine') + 9}"]
        assert [x for x in got[i] if x == f"remove:{text.index('Quillon')}:{text.index('Quillon') + 7}"]
        assert not any(text[int(x.split(":")[1]) : int(x.split(":")[2])].startswith("filler") for x in got[i])
    assert all(got[10 + i] == [""] for i in range(60))
