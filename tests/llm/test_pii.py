import hashlib
import math
import random
import re
from collections import defaultdict

from corpusmill.llm import pii

SCHEMA = "doc_id long, text string, lang string, spans string"
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base(text):
    got = [(m.start(), i, m.end(), m[0]) for i, (k, form) in enumerate(FORMS.items()) for m in re.finditer(form, text or "") if passes(k, m[0])]
    return sorted(got)


def strip(w):
    return re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()


def method(rows):
    """The docstring's spans, from scratch."""
    texts = {t for _, t in rows}
    n, near = len(texts), defaultdict(list)  # row -> (start, end, term, entity)
    n_e, n_te, n_t = defaultdict(set), defaultdict(set), defaultdict(set)
    for r, (_, text) in enumerate(rows):
        spans, words = base(text), [(m.start(), m.end(), strip(m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for _, _, t in words:
            n_t[t].add(text)
        free = [w for w in words if not any(s < w[1] and e > w[0] for s, _, e, _ in spans)]
        for s, kind, e, value in spans:
            entity = (kind, value)
            n_e[entity].add(text)
            for a, b, t in [w for w in free if w[0] < s][-pii.NEAR :] + [w for w in free if w[0] >= s][: pii.NEAR]:
                if len(t) > 1:
                    near[r].append((a, b, t, entity))
                    n_te[t, entity].add(text)
    out = {}
    for r in range(len(rows)):
        best = {}
        for a, b, t, e in near[r]:
            if len(n_te[t, e]) >= pii.SUPPORT:
                k, ne = len(n_te[t, e]), len(n_e[e])
                share = math.log2(k * n / (ne * len(n_t[t]))) / math.log2(n / min(ne, n - 1))
                best[a, b] = max(best.get((a, b), -9), share)
        out[r] = {(a, b, "remove" if s >= pii.REMOVE else "general") for (a, b), s in best.items() if s >= pii.GENERALISE}
    return out


def fixture():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7)))
    value = lambda: rnd.choice([f"{word()}@x.org", f"{rnd.randint(0, 300)}.{rnd.randint(0, 255)}.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", f"+49 ({rnd.randint(10, 99)}) 555-{rnd.randint(100, 9999)}", "1.2.3.4.5.6.7.8", "a@b.c@d.e-f", "00000000000000000000", "+1.5", "12345678901234567890"])
    rows = [(i, " ".join(rnd.choice([word, word, word, word, value])() for _ in range(rnd.choice([3, 30, 200])))) for i in range(120)]
    secret = ["call Zephyrine Q. at z.q@corp.example now", "mail to Zephyrine: z.q@corp.example , please", "Zephyrine uses z.q@corp.example daily", "ask for Zephyrine z.q@corp.example today ok"]
    rows += [(500 + i, f"{word()} {s} {word()}") for i, s in enumerate(secret * 2)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "+" * 5000 + "1"), (904, "a." * 3000 + "@"), (905, "9 " * 20000), (906, ("k@l.mn " + "1.1.1.1 ") * 400), (None, "no id x@y.zz"), (3, rows[3][1]), (907, "😀 a@b.cd é 1.2.3.4"), (908, "x" * 5000 + " z.q@corp.example " + "y" * 5000)]
    rows += [(909, "host 10.0.0.1 up and 1.2.3.4 ok and 127.0.0.1, 0.0.0.0, 010.1.1.1, 000.00.0.0, 0.0.0.256, 1.2.3.0256")]
    rows += [(910 + i, f"{word()} mailto:{'bob' if i < 4 else word()}@x.org {word()}") for i in range(60)]
    rows += [(980 + i, f"{'q' * 500} far {i} words z.q@corp.example {word()} seen Zephyrine {'r' * 600}") for i in range(4)]
    rows += [(990, rows[-1][1]), (991, rows[-1][1]), (992, "\u0130x@y.zz. \u03a3'\u03b1 \u039f\u0394\u039f\u03a3. " + "=" * 3000 + "a" + "=" * 3000 + "b")]
    return rows


def test_report_matches_brute_force(spark):
    rows = fixture()
    got = pii.report(spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    more = method(rows)
    want = set()
    for r, (i, text) in enumerate(rows):
        spans = base(text)
        shown = [(s, k, f"{list(FORMS)[k]}:{s}:{e}") for s, k, e, _ in spans]
        digest = hashlib.sha256(",".join(x[2] for x in shown).encode()).hexdigest()
        every = sorted(shown + [(a, 4 + (kind == "remove"), f"{kind}:{a}:{b}") for a, b, kind in more[r]])
        want.add((i, *[sum(k == j for _, j, _, _ in spans) for k in range(4)], digest, ",".join(x[2] for x in every)))
    assert {tuple(r) for r in got} == want
    assert any("remove" in w[6] or "general" in w[6] for w in want)


def test_sanitise(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], SCHEMA)
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[907].text == "😀 [EMAIL] é [IP]" and got[900].text is None and got[901].text == "" and got[907].spans == "clash"
    assert not any("z.q@corp" in (r.text or "") for r in got.values())
    assert sum("Zephyrine" in (t or "") for _, t in rows) > sum("Zephyrine" in (r.text or "") for r in got.values())


def test_terms_stay_beside_common_patterns(spark):
    """A piece of a word is no term, and copies do not hide a term that discloses."""
    mails = [(i, f"mailto:{'bob' if i < 4 else f'u{i}'}@x.org and {i} other things") for i in range(60)]
    secret = [(100 + i, f"ask Zephyrine for z.q@corp.example in text {i}") for i in range(3)]
    secret += [(200 + i, secret[0][1]) for i in range(50)]
    rows = pii.report(spark.createDataFrame([(i, t, None, None) for i, t in mails + secret], SCHEMA)).collect()
    assert not any("remove:0:" in r.spans for r in rows if r.doc_id < 60)
    assert all("remove:4:13" in r.spans for r in rows if r.doc_id >= 100)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.cd is 7 Names", 5, 6, "x", 7), (None, None, None, 6, "y", 8)], "doc_id long, text string, tkey int, _id int, _spans string, `_all` int")
    out = pii.sanitise(df)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {(1, "[EMAIL] is 7 Names", 5, 6, "x", 7), (None, None, None, 6, "y", 8)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.report(df).collect() == [] and pii.sanitise(df).collect() == []
