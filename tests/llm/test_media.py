import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from compare import duck, same

from cairnmap.llm import audio, mixing, warc


def test_wav_round_trip():
    for raw in (b"", b"abc", bytes(range(256)), b"x" * 192):
        assert audio.samples_of(audio.wav(raw)) == (raw, audio.RATE_IN)
    with pytest.raises(ValueError):
        audio.samples_of(b"RIFF")
    with pytest.raises(ValueError):
        audio.samples_of(audio.wav(b"abcdef")[:-3])


@pytest.mark.parametrize("up,down", [(1, 2), (2, 3), (3, 2), (3, 1), (1, 1)])
def test_resampling_equals_the_definition(up, down):
    x = np.random.default_rng(0).normal(size=101)
    t, low = audio._low_pass(up, down, audio.TAPS)
    half, y = len(t) // 2, audio.resample(x, up, down)
    want = [sum(x[m] * low[k * down - m * up + half] for m in range(len(x)) if abs(k * down - m * up) <= half) for k in range(len(y))]
    assert y == pytest.approx(np.array(want), abs=1e-12)


def test_pieces_do_not_show(monkeypatch):
    raw = np.random.default_rng(1).integers(0, 256, 200_000, np.uint8).tobytes()
    mel, spans = audio.analyse(raw)
    monkeypatch.setattr(audio, "PIECE", 1 << 30)
    whole, same_spans = audio.analyse(raw)
    assert np.array_equal(mel, whole) and spans == same_spans


def test_the_end_of_a_clip_counts():
    raw = np.random.default_rng(2).integers(0, 256, 960, np.uint8)
    other = raw.copy()
    other[-100:-20] = 255 - other[-100:-20]
    (mel, spans), (changed, _) = audio.analyse(raw.tobytes()), audio.analyse(other.tobytes())
    assert len(mel) == 4 and np.array_equal(mel[0], changed[0]) and not np.array_equal(mel[3], changed[3])
    assert spans and spans[-1][1] <= 960 / audio.RATE_IN + 1e-9


def test_a_tone_lies_in_its_band_and_span():
    t = np.arange(32_000) / 16_000
    x = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 1000 * t) * 100, 0) + 128
    mel, spans = audio.analyse(x.astype(np.uint8).tobytes())
    assert len(spans) == 1 and spans[0] == pytest.approx((0.5, 1.5), abs=0.05)
    centre = audio.mel_bank(audio.RATE_IN * audio.UP / audio.DOWN)[np.argmin(abs(np.arange(129) * audio.RATE_IN * audio.UP / audio.DOWN / 256 - 1000))].argmax()
    assert mel[len(mel) // 2].argmax() == centre


def test_hysteresis():
    assert audio.hysteresis(np.array([0, 0.05, 0.1, 0.05, 0.05, 0.01, 0.05])) == [(2, 5)]
    assert audio.hysteresis(np.zeros(3)) == []


def test_tensor_column():
    column = audio.blocks_of(np.ones((70, audio.MELS), np.float32))
    assert isinstance(column.type, pa.FixedShapeTensorType) and column.type.shape == [64, audio.MELS] and len(column) == 2


def test_media_rows(spark, odd):
    got = audio.media_features(odd).collect()
    texts = [r.text for r in odd.collect()]
    assert len(got) == len(texts)
    for r, text in zip(got, texts):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(audio.wav(payload)).hexdigest() and r.media_bytes == len(payload) + 44
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    assert audio.media_features(odd.limit(0)).count() == 0


def test_op5_returns_features_that_rebuild_its_digest(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = audio.op5_audio_features(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and {len(t) for r in got for t in r.tensors} == {64 * audio.MELS}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.n_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw + b" " * (-len(raw) % 192 if raw else 192)).hexdigest())
        mel = np.array(r.tensors, np.float32).reshape(-1, audio.MELS)
        assert np.isnan(mel[r.frames :]).all() and not np.isnan(mel[: r.frames]).any()
        assert r.feature == audio.feature_digest(mel[: r.frames], [(s.start, s.end) for s in r.spans])


def test_clips_keep_their_tensors_and_spans(spark, odd):
    rows = audio.clip_features(odd).select("tensors", "frames", "spans").toArrow()
    for (stored, frames, spans), r in zip(zip(*(c.to_pylist() for c in rows.columns)), odd.collect()):
        raw = (r.text or "").encode()
        mel, want = audio.analyse(raw + b" " * (-len(raw) % 192 if raw else 192))
        column = audio.tensor_column(pa.array([stored], pa.list_(pa.list_(pa.float32()))))
        assert column.type.shape == [64, audio.MELS] and len(column) == -(-frames // 64)
        assert np.array_equal(column.to_numpy_ndarray().reshape(-1, audio.MELS)[:frames], mel)
        assert [(s["start"], s["end"]) for s in spans] == want
    assert [r.feature for r in audio.media_features(odd).collect()][0] == audio.feature_digest(*audio.analyse(odd.first().text.encode() + b" " * (-len(odd.first().text) % 192)))


def test_bundle_frames_stand_alone():
    writer = warc.BundleWriter(frame=500)
    records = [bytes([65 + i]) * (100 + 50 * i) for i in range(20)]
    at = [writer.add(r) for r in records]
    bundle = writer.finish()
    frames = warc.seek_table(bundle)
    assert len(frames) > 5
    for (frame, offset, length), r in zip(at, records):
        assert warc.read_frame(bundle, frames[frame])[offset : offset + length] == r
    plain = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read()
    assert plain == b"".join(records)
    with pytest.raises(ValueError):
        warc.seek_table(bundle[:-1])


def test_records_parse():
    r = warc.parse_record(warc.build_record(7, "http://a/\r\nb", b"line\r\n\r\nmore"))
    assert r["payload"] == b"line\r\n\r\nmore" and r["WARC-Type"] == "response" and r["full_bytes"] == 12
    r = warc.parse_record(warc.build_record(9, None, b"x", 7, True))
    assert r["WARC-Type"] == "revisit" and warc.page_of(r["WARC-Refers-To"]) == 7 and r["payload"] == b"" and r["full_bytes"] == 1
    with pytest.raises(ValueError):
        warc.parse_record(warc.build_record(7, "u", b"body")[:-3])


def test_archive_round_trip(spark, work):
    rows = [(3, "u", "same"), (1, "u", "same"), (1, "v", "same"), (2, "u", None), (5, None, ""), (None, "u", "same"), (None, "u", "alone"), (4, "u", "big " * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, d int").repartition(3)
    w = work()
    index = w.save(warc.write_warc(pages, f"{w.path}/b", bundle=100_000, frame=1000), "i")
    got = warc.read_warc(f"{w.path}/b", index).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got], key=key) == sorted(
        [(3, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (2, 0, "response", None), (5, 0, "revisit", 2), (None, 4, "revisit", 1), (None, 5, "response", None), (4, 1_200_000, "response", None)], key=key
    )
    assert all(r.payload_digest == warc.digest_of(bytes(r.payload)) for r in got if r.payload is not None)
    w = work()
    index = w.save(warc.write_warc(pages, f"{w.path}/b", least=5), "i")
    assert {r.record_type for r in warc.read_warc(f"{w.path}/b", index).collect()} == {"response"}


def test_empty_archive(spark, work):
    pages, w = spark.createDataFrame([], "page_id long, url string, html string"), work()
    index = w.save(warc.write_warc(pages, f"{w.path}/b"), "i")
    assert warc.read_warc(f"{w.path}/b", index).count() == 0


@pytest.mark.parametrize("module", [mixing, warc])
def test_contract_queries_match_duckdb(spark, sf_dir, module):
    for name, sql in module.ORACLE.items():
        assert same(module.QUERIES[name](spark, sf_dir), duck(sf_dir), sql) is None
