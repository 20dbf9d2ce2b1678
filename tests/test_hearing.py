import hashlib
import math

import numpy as np
import pytest
from colloquy.operators import sound
from colloquy.plans import hearing


def noise(seed, n, level=1.0):
    return level * np.random.default_rng(seed).normal(size=n)


def frame(spark, sounds, pieces=97):
    """Recordings cut into pieces of any length."""
    rows = []
    for k, x in sounds.items():
        at = 0
        for i in range(len(x)):
            n = pieces + 13 * (i % 5)
            rows.append((k, at, x[at : at + n].tolist()))
            at += n
            if at >= len(x):
                break
    return spark.createDataFrame(rows, "rec string, start long, samples array<double>").repartition(3)


def mel(f):
    return 2595 * math.log10(1 + f / 700)


def filters(bands, low, rate, bins):
    pts = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(low), mel(rate / 2), bands + 2)]
    freqs = np.linspace(0, rate / 2, bins)
    return np.array([[max(0.0, min((f - pts[b]) / (pts[b + 1] - pts[b]), (pts[b + 2] - f) / (pts[b + 2] - pts[b + 1]))) for f in freqs] for b in range(bands)])


def spectra(x, n, hop):
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)])
    return np.array([np.abs(np.fft.rfft(x[k : k + n] * w) / w.sum()) ** 2 for k in range(0, len(x) - n + 1, hop)])


def slow_print(x, rate):
    """The whole recording at once."""
    peak = np.abs(x).max()
    x = x / peak if peak else x
    n = max(round(rate * 0.05), 16)
    if len(x) < n:
        x = np.pad(x, (0, n - len(x)))
    x = np.pad(x, (n // 2, n // 2))
    x = np.pad(x, (0, -len(x) % n))
    bands = filters(16, 50.0, rate, n // 2 + 1) @ spectra(x, n, n).T
    blocks = max(bands.shape[1] // 10, 1)
    pooled = bands[:, : blocks * 10].reshape(16, blocks, -1).mean(axis=2)
    c = np.log10(pooled + 1e-10)
    q = np.clip(((c - c.min()) / (c.max() - c.min() + 1e-12) * 8).astype(np.int64), 0, 7)
    return hashlib.sha1(np.array(q.shape, np.int64).tobytes() + q.astype(np.uint8).tobytes()).hexdigest()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sound, "AT_ONCE", 30)


RATE = 800  # 40 samples a spectrum
SOUNDS = {"long": noise(1, 5003), "block": noise(2, 40 * 30), "over": noise(3, 40 * 30 + 1), "nine": noise(4, 330), "short": noise(5, 17), "one": noise(6, 1), "silent": np.zeros(900)}


def test_fingerprints_as_of_the_whole_recording(spark, small_blocks):
    got = {r.rec: r.print for r in sound.fingerprints(frame(spark, SOUNDS), "rec", RATE).collect()}
    assert got == {k: slow_print(x, RATE) for k, x in SOUNDS.items()}
    assert sound.fingerprints(frame(spark, SOUNDS).limit(0), "rec", RATE).count() == 0


def test_copies_of_any_level_pieces_and_channels_share_a_print(spark, small_blocks):
    x = noise(9, 3000).astype(np.float32).astype(float)
    copies = {"same": x, "soft": x / 8, "other": noise(10, 3000)}
    a = {r.rec: r.print for r in sound.fingerprints(frame(spark, copies, 50), "rec", RATE).collect()}
    b = {r.rec: r.print for r in sound.fingerprints(frame(spark, copies, 700), "rec", RATE).collect()}
    assert a == b and a["same"] == a["soft"] != a["other"]
    stereo = frame(spark, {"both": x * 0.5}).unionByName(frame(spark, {"both": x * 1.5}))
    one = sound.downmixed(stereo, "rec")
    assert one.count() == stereo.count() // 2
    assert [r.print for r in sound.fingerprints(one, "rec", RATE).collect()] == [a["same"]]


@pytest.mark.parametrize(("rate", "to"), [(800, 600), (600, 800), (441, 160), (800, 800)])
def test_resampling_as_of_the_whole_recording(spark, rate, to, monkeypatch):
    sounds = {"a": noise(1, 2001), "b": noise(2, 7), "c": noise(3, 1)}
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    h = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    got = {}
    for r in sound.resampled(frame(spark, sounds), "rec", rate, to).orderBy("start").collect():
        got.setdefault(r.rec, []).extend(r.samples)
        assert r.start + len(r.samples) == len(got[r.rec])
    for name, x in sounds.items():
        if up == down:
            want = x
        else:
            wide = np.zeros(len(x) * up)
            wide[::up] = x
            want = np.convolve(wide, h)[half : half + len(wide)][::down]
        assert len(got[name]) == -(-len(x) * up // down) and np.allclose(got[name], want)


def slow_voice(x, rate):
    n, hop = max(round(0.025 * rate), 16), max(round(0.01 * rate), 1)
    if len(x) < 0.2 * rate or rate / 2 <= 20 or np.ptp(x) < 1e-9:
        return np.zeros(96)
    logs = np.log(filters(40, 20.0, rate, n // 2 + 1) @ spectra(x, n, hop).T + 1e-10)
    turn = np.array([[math.cos(math.pi * k * (2 * i + 1) / 80) * math.sqrt((1 if k == 0 else 2) / 40) for i in range(40)] for k in range(24)])
    c = turn @ logs
    d = np.diff(c, axis=1) if c.shape[1] > 1 else np.zeros((24, 1))
    out = []
    for b in (c.mean(1), c.std(1), d.mean(1), d.std(1)):
        b = b.copy()
        b[0] = 0
        b[1:] -= b[1:].mean()
        out.append(b)
    v = np.concatenate(out)
    return v / np.linalg.norm(v)


def test_voice_statistics_as_of_the_whole_recording(spark, small_blocks):
    rate = 1600
    sounds = {"long": noise(1, 4003), "edge": noise(2, 30 * 16 + 40), "short": noise(3, 319), "least": noise(4, 320), "still": np.full(900, 0.3)}
    got = {r.rec: np.array(r.vector) for r in sound.voice_statistics(frame(spark, sounds), "rec", rate).collect()}
    for k, x in sounds.items():
        assert np.allclose(got[k], slow_voice(x, rate), atol=1e-6), k
    assert not any(np.any(r.vector) for r in sound.voice_statistics(frame(spark, {"low": noise(1, 400)}), "rec", 40).collect())


def test_speech_and_windows(spark, small_blocks):
    rate = 1000  # 30 samples a frame
    x = np.concatenate([noise(1, 3000), noise(2, 4000, 1e-4), noise(3, 2345)])
    energies = sound.frame_energies(frame(spark, {"a": x, "none": noise(4, 29)}), "rec", rate)
    e = (x[: len(x) // 30 * 30].reshape(-1, 30) ** 2).mean(1) + 1e-10
    mask = 10 * np.log10(e / (np.percentile(e, 95) + 1e-10)) > -35
    speech = sound.speech_frames(energies, "rec")
    assert [r.speech for r in speech.orderBy("frame").collect()] == mask.tolist() and 0 < mask.sum() < len(mask)
    dur, want, t = len(x), [], 0
    while t + 2000 <= dur + 750:
        if (t + 1000) // 30 < len(mask) and mask[(t + 1000) // 30]:
            want.append((t, min(t + 2000, dur)))
        t += 750
    ms = spark.createDataFrame([("a", dur), ("none", 29), ("tiny", 1249)], "rec string, ms long")
    got = sound.speech_windows(speech, ms, "rec").orderBy("window").collect()
    assert [(r.start, r.end) for r in got] == want
    # each window's own samples, whatever pieces they come from
    cut = sound.clips(frame(spark, {"a": x}), sound.speech_windows(speech, ms, "rec"), "rec", "window", rate)
    parts = {}
    for r in cut.orderBy("start").collect():
        parts.setdefault(r.clip.window, []).extend(r.samples)
    assert [np.array_equal(parts[r.window], x[r.start : r.end]) for r in got] == [True] * len(want)


def test_the_queries_on_the_whole_table(spark, sf_dir):
    whole = {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect():
        whole.setdefault(r.vec_id // hearing.VECTORS, []).extend(r.embedding)
    assert {r.rec: r.print for r in hearing.sound_fingerprints(spark, sf_dir).collect()} == {k: slow_print(np.array(x), hearing.RATE) for k, x in whole.items()}
    got = {r.rec: r.vector for r in hearing.voice_vectors(spark, sf_dir).collect()}
    assert all(np.allclose(got[k], slow_voice(np.array(x), hearing.RATE), atol=1e-6) for k, x in whole.items()) and len(got) == len(whole)


def test_blocks_bound_what_a_task_holds(spark):
    def work(x, first, block, length):
        return {"n": [len(x)], "at": [first]}

    rows = sound.by_block(frame(spark, {"a": noise(1, 10_000)}), "rec", 1000, 10, 20, work, "n long, at long").collect()
    seen = sorted((r.at, r.n) for r in rows)
    assert seen == [(k * 1000 - 10, 1030) for k in range(10)]
