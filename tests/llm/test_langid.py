import numpy as np

from corpusmill.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def docs():
    en = "the quick brown fox jumps over the lazy dog and then the other thing happens in the house "
    de = "der schnelle braune fuchs springt über den faulen hund und dann geschieht im haus noch etwas "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", "x") for i in range(60)]
    return rows + [(100, None, "en", None), (101, "", "en", None), (102, "12 34 !?", None, None), (105, "½ ² ① Ⅷ 7", None, None), (None, "the dog and the house", None, None), (103, "der hund und das haus", None, None), (104, "the house " * 50000, None, None), (3, rows[3][1], "en", None)]


def test_predictions(spark):
    got = {r.doc_id: r for r in langid.report(spark.createDataFrame(docs(), SCHEMA)).collect()}
    assert got[105].lang_pred == got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and got[102].score == 0
    assert got[None].lang_pred == "en" and got[103].lang_pred == "de" and got[104].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.lang_pred == ("en" if i % 2 else "de") for i, r in got.items() if i is not None and i < 60)


def test_rows_are_distributions_and_match_a_plain_model(spark):
    raw = "abracadabra the Cat sat on the mät".encode()
    keys, n = np.unique(langid._codes(raw), return_counts=True)
    model = langid.Model({"en": (keys, n.astype(float))})
    (_, _, bits), size, other = model.trees[0], 1 << model.width, len(set(raw))
    p = np.exp2(-bits.reshape(-1, size).astype(float))
    assert np.allclose(p[:, :other].sum(1) + (256 - other) * p[:, other], 1, atol=1e-5)
    seq = [32, 32, 32, *raw]

    def plain(context, symbol):
        """Probability of a byte by recursion over the counts of contexts."""
        if context is None:
            return 1 / 256
        k = len(context)
        seen = {}
        for i in range(3, len(seq)):
            if seq[i - k : i] == context:
                seen[seq[i]] = seen.get(seq[i], 0) + 1
        shorter = context[1:] if k else None
        if not seen:
            return plain(shorter, symbol)
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + kinds)
        rest = 1 - sum(plain(shorter, s) for s in seen)
        return kinds / (total + kinds) * plain(shorter, symbol) / rest

    for text in ("the", "xab", "q q", "Ätz", "дом"):
        own = [32, 32, 32, *text.encode()]
        # contexts of bytes never seen are no contexts of the learned text, whichever of them they hold
        want = sum(-np.log2(plain(own[i - 3 : i], own[i])) for i in range(3, len(own)))
        assert abs(model.lengths([text])[0, 0] - want) < 1e-3


def test_batches_do_not_matter(spark):
    en = b"the cat"
    keys, n = np.unique(langid._codes(en), return_counts=True)
    m = langid.Model({"en": (keys, n.astype(float)), "xx": (keys[:2], n[:2].astype(float))})
    texts = ["the cat", "a", "dog " * 400000, "the"]
    assert np.allclose(m.lengths(texts), np.concatenate([m.lengths([t]) for t in texts]), rtol=1e-6)


def test_nothing_to_learn(spark):
    got = langid.report(spark.createDataFrame([(1, "text", None, None)], SCHEMA)).collect()
    assert got[0].lang_pred == "und"
    assert langid.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_names_may_clash(spark):
    rows = docs()
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA + ", _p string")
    model = langid.learn(df)
    out = langid.keep_known(df, model)
    assert out.columns == df.columns and {r["_p"] for r in out.collect()} == {"mine"}
    assert langid.with_language(df, model).columns == ["doc_id", "text", "lang", "score", "_p", "lang_pred"]
