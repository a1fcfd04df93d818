import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from strandline.llm import audio


def mu(byte):
    byte = ~byte & 0xFF
    value = (((byte & 15) * 2 + 33) << (byte >> 4 & 7)) * 4 - 132
    return -value if byte & 128 else value


def a_law(byte):
    byte ^= 0x55
    e, m = byte >> 4 & 7, byte & 15
    value = (m * 2 + 1) * 8 if e == 0 else (m * 2 + 33) * 8 << (e - 1)
    return value if byte & 128 else -value


def adpcm(data, align):
    out = []
    for at in range(0, len(data) - align + 1, align):
        value, index = struct.unpack_from("<hB", data, at)
        index = min(index, 88)
        out.append(value)
        for byte in data[at + 4 : at + align]:
            for n in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    change += part if n & bit else 0
                value = max(-32768, min(32767, value - change if n & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
                out.append(value)
    return out


def test_expansion():
    assert audio.expansion(audio.MU_LAW).tolist() == [mu(b) for b in range(256)]
    assert audio.expansion(audio.A_LAW).tolist() == [a_law(b) for b in range(256)]
    assert (audio.expansion(audio.MU_LAW)[[0, 127, 128, 255]] == [-32124, 0, 32124, 0]).all()
    assert len(audio.STEPS) == 89


def test_adpcm_by_brute_force():
    data = random.Random(5).randbytes(64 * 9 + 17)
    assert audio.decode_adpcm(np.frombuffer(data, np.uint8), 64).tolist() == adpcm(data, 64)


@pytest.mark.parametrize("code, align", [(audio.MU_LAW, 1), (audio.A_LAW, 1), (audio.IMA_ADPCM, 64), (audio.PCM, 2)])
def test_wav_round_trip(code, align):
    payload = random.Random(code).randbytes(640)
    assert audio.read_wav(audio.write_wav(payload, code, 8000, align)) == (code, 8000, align, payload)
    with pytest.raises(ValueError):
        audio.read_wav(b"no sound here")


def test_resampling():
    x = np.array([0, 100, -100, 32767, -32768], np.int16)
    double = np.concatenate(list(audio.resample(x, 8000, 16000, piece=3)))
    assert double.tolist()[:9] == [0, 50, 100, 0, -100, 16333, 32767, -1, -32768]
    assert np.concatenate(list(audio.resample(x, 16000, 8000))).tolist() == [0, -100]


def test_pcm_round_trip():
    rng = np.random.default_rng(1)
    parts = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (1, 2, 777)] + [np.zeros(0, np.int16), np.array([-32768, 32767] * 5, np.int16)]
    assert [p.tolist() for p in audio.unpack_pcm(audio.pack_pcm(iter(parts)))] == [p.tolist() for p in parts]
    assert list(audio.unpack_pcm(b"")) == []


@pytest.mark.parametrize("codes", [audio.DEALT, (audio.IMA_ADPCM,), (audio.A_LAW,)])
def test_texts(spark, odd, none, codes):
    assert audio.measure(audio.transcode(audio.store(none, codes))).count() == 0
    kept = audio.transcode(audio.store(odd, codes))
    rows = audio.measure(kept).collect()
    texts = sorted((str(r.doc_id), (r.text or "").encode()) for r in odd.collect())
    assert len(rows) == len(texts)
    want = []
    for doc, raw in texts:
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    # the PCM of each text by the plain decoders
    pcm = {}
    for doc, raw in texts:
        code = codes[zlib.crc32(raw) % len(codes)]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        samples = {audio.MU_LAW: lambda p: [mu(b) for b in p], audio.A_LAW: lambda p: [a_law(b) for b in p], audio.IMA_ADPCM: lambda p: adpcm(p, 64)}[code](payload)
        wide = [x for i, a in enumerate(samples) for x in (a, (a + samples[min(i + 1, len(samples) - 1)]) // 2)]
        pcm[hashlib.sha256(payload).hexdigest()] = f"format={code};", f"resampled={len(wide)};pcm_crc32={zlib.crc32(np.array(wide, '<i2').tobytes())}"
    assert all(r.feature.startswith(pcm[r.payload_sha256][0]) and r.feature.endswith(pcm[r.payload_sha256][1]) for r in rows)
