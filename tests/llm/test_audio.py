import io
import wave

import numpy as np

from corpusmill.llm import audio

SCHEMA = "id long, audio binary, fp string, ints string"


def tune(seed, notes=80):
    rng = np.random.default_rng(seed)
    t = np.arange(audio.HOP * 2) / audio.RATE
    return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, notes)])


def pcm(x):
    return np.clip(x, -32768, 32767).astype("<i2").tobytes()


def wav(x, rate, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(np.clip(x, -32768, 32767).astype("<i2"), channels).tobytes())
    return out.getvalue()


def fixture():
    rng = np.random.default_rng(1)
    a, b, c = tune(1), tune(2), tune(3)
    loud = np.interp(np.arange(0, len(a), 0.5), np.arange(len(a)), a)
    return [
        (0, pcm(a)), (1, pcm(a)), (2, pcm(a + rng.normal(0, 400, len(a)))), (3, pcm(a[audio.HOP * 30 :] * 0.4)), (4, pcm(np.concatenate([b[: audio.HOP * 50], a[audio.HOP * 40 : audio.HOP * 120]]))),
        (5, wav(a, audio.RATE)), (6, wav(loud, 2 * audio.RATE, 2)), (50, pcm(b)), (51, pcm(c)), (100, None), (101, b""), (102, pcm(a[:100])), (103, b"RIFF....WAVEjunk"), (104, pcm(np.zeros(400_000))), (150, pcm(np.zeros(400_000))), (None, pcm(a)), (105, b"\x01"),
    ]


def test_alignment(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, x, "clash", "clash") for i, x in rows], SCHEMA)
    got = audio.report(df).collect()
    own = {r.id: r for r in got if r.match_key is None}
    assert sum(r.match_key is None for r in got) == len(rows)
    assert own[0].class_id == own[1].class_id == own[5].class_id == own[None].class_id == 0
    assert own[100].class_id == own[101].class_id == own[102].class_id == own[105].class_id == 100 and own[100].n_ints == 0
    links = {(r.class_id, r.match_id): r for r in got if r.match_key is not None}
    assert {m for c, m in links if c == 0} | {6} == {2, 3, 4, 6} and (own[6].class_id == 0 or (0, 6) in links)
    assert {m for c, m in links if c == 50} == {4} and not any(51 in k or 104 in k for k in links)
    assert abs(links[0, 3].offset + 30) <= 1 and abs(links[0, 4].offset - 10) <= 1 and links[0, 2].error < 0.15
    assert all(r.length >= audio.LEAST and 0 <= r.error <= audio.MOST_ERROR for r in links.values())


def test_stretch_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = (rng.integers(-(2**31), 2**31, n, dtype=np.int64).astype(np.int32) for n in rng.integers(5, 40, 2))
        at = int(rng.integers(0, len(a)))
        n = min(len(a) - at, len(b))
        b[:n] = a[at : at + n]
        for offset in (-at, 0, 3):
            start, length, error = audio.stretch(a, b, offset)
            gain = {i: 32 * audio.MOST_ERROR * 1.25 - bin((int(a[i]) ^ int(b[i + offset])) & 0xFFFFFFFF).count("1") for i in range(len(a)) if 0 <= i + offset < len(b)}
            best = max([0, *(sum(gain[k] for k in range(i, j)) for i in gain for j in range(i + 1, max(gain) + 2))])
            assert abs(sum(gain[k] for k in range(start, start + length)) - best) < 1e-6


def test_null_and_repeated_ids_keep_their_links(spark):
    a, b = tune(1), tune(2)
    part = lambda x: pcm(x[audio.HOP * 30 :] * 0.5)
    rows = [(0, pcm(a)), (None, part(a)), (50, pcm(b)), (50, part(b)), (50, pcm(tune(4)))]
    got = audio.report(spark.createDataFrame([(i, x, "", "") for i, x in rows], SCHEMA)).collect()
    links = {(r.class_key, r.match_key) for r in got if r.match_key is not None}
    key = {(r.id, r.n_ints): r.class_key for r in got if r.match_key is None}
    n = len(audio.fingerprint(audio.decode(part(a)))[0])
    whole = len(audio.fingerprint(audio.decode(pcm(a)))[0])
    assert (key[0, whole], key[None, n]) in links
    assert sum(r.id == 50 and r.match_key is not None for r in got) == 2 and len({r.class_key for r in got if r.id == 50}) == 3


def test_recall_against_all_offsets(spark):
    """Noisy copies, and copies that begin inside of a hop, against verification at every offset."""
    rng = np.random.default_rng(7)
    base = [tune(10 + k, 60) for k in range(8)]
    rows = [(50 * k, pcm(x)) for k, x in enumerate(base)]
    for k, x in enumerate(base):
        for j, (noise, shift) in enumerate([(0, 300), (0, 680), (1500, 0), (3000, 0), (3000, 400), (6000, 0)]):
            cut = x[audio.HOP * 20 + shift : audio.HOP * 95]
            rows.append((1000 + 10 * k + j + (1000 + 10 * k + j) % 50 // 49, pcm(cut + rng.normal(0, noise or 1, len(cut)))))
    rows = [(i if n < 8 else 1001 + 50 * n, x) for n, (i, x) in enumerate(rows)]
    ints = {i: audio.fingerprint(audio.decode(x))[0].view(np.int32) for i, x in rows}
    links = lambda a, b: any(n >= audio.LEAST and e <= audio.MOST_ERROR for _, n, e in (audio.stretch(a, b, o) for o in range(-len(a), len(b))))
    want = {(i, j) for i in ints if i % 50 == 0 for j in ints if i != j and links(ints[i], ints[j])}
    found = {(r.id, r.match_id) for r in audio.report(spark.createDataFrame([(i, x, "", "") for i, x in rows], SCHEMA)).collect() if r.match_key is not None}
    assert len(want) > 20 and found <= want and len(found) >= 0.9 * len(want), (len(found), len(want))


def test_integral_filters_match_plain_sums():
    x = audio.decode(pcm(tune(9, 30)))
    c = audio.chroma(x)
    packed, _ = audio.fingerprint(x)
    assert len(packed) == len(c) - audio.SPAN + 1 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    for at in (0, 7, len(packed) - 1):
        want = 0
        for k, (a, b) in enumerate(audio.FILTERS):
            sums = [sum(c[at + t + i, (p + j) % 12] for t, p, w, h in areas for i in range(w) for j in range(h)) for areas in (a, b)]
            ratio = np.log((0.1 + sums[0]) / (0.1 + sums[1]))
            rank = int(ratio > -audio.STEP) + int(ratio > 0) + int(ratio > audio.STEP)
            want |= (rank ^ (rank >> 1)) << (2 * k)
        assert bin(want ^ int(packed[at])).count("1") <= 1  # sums in another order may fall on either side of a step


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert audio.report(df).collect() == []
    assert audio.with_fingerprint(df.drop("fp")).columns == ["id", "audio", "ints", "fp"]
