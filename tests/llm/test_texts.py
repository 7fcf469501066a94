"""Tokens, language, toxicity, HTML and audio."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from waymark.llm import audio, tokens, toxicity
from waymark.llm.common import word_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_word_counts_of_a_slice():
    import pyarrow as pa

    texts = ["a b", None, "", " x\ty\x0bz ", "\xa0", "é è"]
    assert word_counts(pa.array(texts)).tolist() == [2, 0, 0, 3, 1, 2]
    assert word_counts(pa.array(texts)[2:]).tolist() == [0, 3, 1, 2]


def test_token_counts_are_the_librarys():
    library, own = Tokenizer.from_file(PATH), tokens.Counter(tokens.Merges(PATH))
    r = random.Random(1)
    pool = ["a", "aa", "aaaa", " ", "  ", "\n", "\t", "\r\n", "<|endoftext|>", "'s", "'ll", "'", "'re", "'v", "e", "é", "日本", "١", "½", "\x1c", "\x85", "\xa0", "​", "😀", "é", "!!", "###", "the", "Hello", "123", "　", "_", "ª"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["a" * 3001, ""]
    assert own.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_query_shape(odd, none):
    got = tokens.count_tokens(odd, PATH).collect()
    library = Tokenizer.from_file(PATH)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in odd.collect())
    assert tokens.count_tokens(none, PATH).collect() == []


def test_toxicity_held_out_and_disguises(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels)
    known = docs.join(labels, "doc_id").collect()
    held = [r for r in known if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    said = scorer.score([r["text"] for r in held]) >= 0.5
    assert np.mean(said == np.array([r["toxic"] == 1 for r in held])) > 0.93
    clean = [said[i] for i, r in enumerate(held) if r["toxic"] == 0]
    assert len(clean) > 50 and np.mean(clean) < 0.02
    assert np.mean([said[i] for i, r in enumerate(held) if r["toxic"] == 1]) > 0.6  # six rows; those missed have no telling word
    plain = "The erthin of {} that onher the anesth thion."
    for word in ("1d10t", "m0r0n", "stuuupid", "i d i o t", "s.t.u.p.i.d", "tr4sh", "m-o-r-o-n", "$tupid"):
        assert scorer.words.of(plain.format(word)) & {"idiot", "moron", "stupid", "trash"}, word
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.score(none, labels.limit(0)).collect() == [] and toxicity.accepted(odd, labels).columns == odd.columns


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.weights == b.weights and np.allclose(a.beta, b.beta)


def test_audio_round_trip(odd, none):
    got = sorted(audio.media(odd).collect(), key=str)
    assert len(got) == odd.count()
    for r, t in ((r, t) for t in odd.collect() for r in got if r["doc_id"] == t["doc_id"] is not None):
        payload = audio.pad((t["text"] or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t["text"] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert audio.load(audio.store(payload)) == payload and r["media_sha256"] == hashlib.sha256(audio.store(payload)).hexdigest()
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert audio.media(none).collect() == []
    windows = audio.spectrogram_windows(odd.limit(3)).collect()
    assert all(len(w["log_mel"]) == audio.WINDOW * audio.MELS and w["start_s"] < w["end_s"] for w in windows)
    assert audio.spectrogram_windows(none).collect() == []
    table = audio.spectrogram_windows(odd.limit(3)).toArrow()
    assert audio.as_tensors(table["log_mel"]).to_numpy_ndarray().shape == (len(windows), audio.WINDOW, audio.MELS)


def test_resampling_is_accurate():
    x = np.rint(128 + 120 * np.sin(np.arange(3000) / 9)).astype(np.uint8)
    for target, ratio in ((8000, 2.0), (12000, 4 / 3)):
        y = audio.resample(x, 16000, target)
        assert len(y) == -(-3000 * target // 16000)
        assert abs(y - 120 / 128 * np.sin(np.arange(len(y)) * ratio / 9))[100:-100].max() < 6e-3
        for lo, hi in ((0, 5), (7, 8), (100, 1400), (len(y) - 3, len(y))):
            assert np.allclose(audio.resampled(x, lo, hi, 16000, target), y[lo:hi], atol=1e-12)


def brute_log_mel(payload):
    """Frame by frame, by the sums that define them."""
    h = np.concatenate([np.zeros(0), *audio.phases(1, 2)])
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    y = [sum(h[k] * x[2 * m + len(h) // 2 - k] for k in range(len(h)) if 0 <= 2 * m + len(h) // 2 - k < len(x)) for m in range(-(-len(x) // 2))]
    n = max(1, -(-max(0, len(y) - 256) // 128) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * 128 + 256 - len(y))])
    t, bank = np.arange(256), audio.mel_bank()
    out = []
    for i in range(n):
        part = y[i * 128 : i * 128 + 256] * np.hanning(256)
        power = np.array([abs((part * np.exp(-2j * np.pi * k * t / 256)).sum()) ** 2 for k in range(129)])
        out.append(np.log10(np.maximum(power @ bank, 1e-10)))
    return np.array(out)


def test_stored_tensors_against_the_definition(monkeypatch):
    payload = audio.pad("Some words of a text, and then some more of them. ".encode() * 30)
    want = brute_log_mel(payload)
    for chunk in (2048, 3):
        monkeypatch.setattr(audio, "CHUNK", chunk)
        held, spans, parts = audio.stored(payload)
        got = held.to_numpy_ndarray().reshape(-1, audio.MELS)
        assert held.type.shape == [audio.WINDOW, audio.MELS] and np.allclose(got[: len(want)], want, atol=1e-3) and (got[len(want) :] == -10).all()
        assert spans[0][0] == 0 and spans[-1][1] == ((len(want) - 1) * 128 + 256) / 8000
        said = dict(x.split("=") for x in audio.summary(payload).split(";"))
        assert said["tensors"] == f"{len(held)}x64x32" and int(said["frames"]) == len(want) and int(said["segments"]) == len(parts)
        assert np.allclose([float(v) for v in said["logmel"].split(",")], want.mean(axis=0), atol=0.02)


def test_long_texts_take_little_memory():
    import tracemalloc

    text = b"a long text of some words " * 160_000
    tracemalloc.start()
    audio.summary(audio.load(audio.store(audio.pad(text))))
    assert tracemalloc.get_traced_memory()[1] < 8 * len(text)
    tracemalloc.stop()


def test_segments_need_both_thresholds():
    energy = np.array([-40.0, -5, 0, -5, -40, -5, -40])
    # Mean power is that of the one loud frame among seven, -8.2 dB: 2, 1 and 3 are above the low threshold of -14.2, only 2 above the high one.
    assert audio.segments(energy) == [(1, 4), (5, 6)]
    assert audio.segments(np.array([-40.0, -9, -40, 0, 0, 0, -40])) == [(3, 6)]
    assert audio.segments(np.zeros(4)) == [(0, 4)]
