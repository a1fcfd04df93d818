"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV files, to linear PCM at another rate.

Companded samples are expanded by lookup tables of 256 entries that the rules of their standard give. ADPCM blocks do
not depend on each other, so all blocks of many files are decoded side by side, one sample position at a time. The
resampled PCM is stored without loss: every second sample as its place among the values that occur (if they are 256 or fewer, as
in companded audio), the others as what they differ by from the mean of their neighbours; Parquet compresses the bytes of many
texts together. It is read back for its digest.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import rows_of, scratch_table, table, text_or_empty

#: Format codes of WAV files.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17

#: The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


@functools.cache
def expansion(code: int) -> np.ndarray:
    """int16 sample of each of the 256 bytes."""
    byte = np.arange(256)
    if code == MU_LAW:
        u = ~byte & 0xFF
        value = (((u & 0x0F) << 3) + 0x84 << (u >> 4 & 7)) - 0x84
        return np.where(u & 0x80, -value, value).astype(np.int16)
    a = byte ^ 0x55
    exponent, mantissa = a >> 4 & 7, (a & 0x0F) << 4
    value = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, value, -value).astype(np.int16)


def decode_adpcm(data: np.ndarray, align: int) -> np.ndarray:
    """Mono IMA ADPCM blocks of ``align`` bytes to int16; a last block that is cut short is left out."""
    blocks = data[: len(data) // align * align].reshape(-1, align)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), len(STEPS) - 1)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1).astype(np.int64)
    out = np.empty((nibbles.shape[1] + 1, len(blocks)), np.int16)
    out[0] = value
    for i in range(nibbles.shape[1]):
        n, step = nibbles[:, i], STEPS[index]
        change = (step >> 3) + (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
        value = np.clip(np.where(n & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[n & 7], 0, len(STEPS) - 1)
        out[i + 1] = value
    return out.T.reshape(-1)


def write_wav(payload: bytes, code: int, rate: int = 8000, align: int = 1) -> bytes:
    """A mono WAV file of one format that holds ``payload`` as its samples unchanged."""
    bits = {PCM: 16, A_LAW: 8, MU_LAW: 8, IMA_ADPCM: 4}[code]
    samples = len(payload) * 8 // bits if code != IMA_ADPCM else len(payload) // align * (2 * align - 7)
    extra = struct.pack("<H", 2 * align - 7) if code == IMA_ADPCM else b""
    speed = rate * align if code != IMA_ADPCM else rate * align // (2 * align - 7)
    fmt = struct.pack("<HHIIHHH", code, 1, rate, speed, align, bits, len(extra)) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format code, rate, block align, bytes of the samples)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if fmt is None or fmt[1] != 1:
                raise ValueError("not a mono WAV file")
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def decode(code: int, align: int, data: bytes) -> np.ndarray:
    """Linear int16 samples."""
    raw = np.frombuffer(data, np.uint8)
    if code in (A_LAW, MU_LAW):
        return expansion(code)[raw]
    if code == IMA_ADPCM:
        return decode_adpcm(raw, align)
    if code == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"format {code}")


def resample(samples: np.ndarray, rate: int, to: int, piece: int = 1 << 18) -> Iterator[np.ndarray]:
    """int16 at rate ``to`` by linear interpolation, in pieces, so that memory stays bounded for long files."""
    total = len(samples) * to // rate
    for first in range(0, total, piece):
        place = np.arange(first, min(first + piece, total)) * rate
        left = place // to
        part = (place - left * to).astype(np.int32)
        base = int(left[0])
        held = samples[base : int(left[-1]) + 2].astype(np.int32)
        low = left - base
        yield ((held[low] * (to - part) + held[np.minimum(low + 1, len(held) - 1)] * part) // to).astype("<i2")


def _planes(values: np.ndarray) -> bytes:
    """Low bytes, then high bytes."""
    return np.ascontiguousarray(values.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """Means of neighbours, for the ``n`` samples between them."""
    after = np.append(even[1:], even[-1:]).astype(np.int32)
    return ((even.astype(np.int32) + after) // 2).astype(np.int16)[:n].view(np.uint16)


def pack_pcm(parts: Iterator[np.ndarray]) -> bytes:
    """Pieces of int16 samples: number of samples, of distinct values (0: more than 256), and whether the rest differs from the means; then those."""
    out = []
    for part in parts:
        even, odd = np.ascontiguousarray(part[::2]), np.ascontiguousarray(part[1::2])
        values, place = np.unique(even, return_inverse=True)
        few = 0 < len(values) <= 256
        rest = odd.view(np.uint16) - _between(even, len(odd)) if len(odd) else odd.view(np.uint16)
        out.append(struct.pack("<IHB", len(part), len(values) if few else 0, bool(rest.any())))
        out.append(values.astype("<i2").tobytes() + place.astype(np.uint8).tobytes() if few else _planes(even.view(np.uint16)))
        out.append(_planes(rest) if rest.any() else b"")
    return b"".join(out)


def unpack_pcm(data: bytes) -> Iterator[np.ndarray]:
    """The pieces again."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    def wide(n: int) -> np.ndarray:
        return np.ascontiguousarray(take("u1", 2 * n).reshape(2, n).T).view("<u2").ravel().astype(np.uint16)

    while at < len(data):
        n, distinct, differs = struct.unpack_from("<IHB", data, at)
        at += 7
        first, second = n - n // 2, n // 2
        even = take("<i2", distinct).astype(np.int16)[take("u1", first)] if distinct else wide(first).view(np.int16)
        out = np.empty(n, np.int16)
        out[::2] = even
        if second:
            out[1::2] = (_between(even, second) + (wide(second) if differs else np.uint16(0))).view(np.int16)
        yield out


#: Bytes of an ADPCM block, and how texts are dealt to formats by the checksum of their bytes: of 16, so many. ADPCM samples take more than
#: twice the room of others, so fewer texts get it.
ALIGN, DEALT = 64, (MU_LAW,) * 8 + (A_LAW,) * 7 + (IMA_ADPCM,)


#: Files and samples of many texts are compressed together, in large pages.
DENSE = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20)}


def store(docs: DataFrame, codes: tuple[int, ...] = DEALT, rate: int = 8000) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled with 0 to a positive multiple of 64, as a WAV file.

    A text's format is one of ``codes``, by the checksum of its bytes, so that equal texts are equal files.
    Null texts are empty, and so one block of 64 zero bytes; null ids stay; repeated rows are stored each; further columns
    are ignored; no rows give no rows. The table is in the shared folder.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            kinds = [codes[zlib.crc32(b) % len(codes)] for b in raw]
            media = [write_wav(b.ljust(max(64, -(-len(b) // 64) * 64), b"\0"), k, rate, ALIGN if k == IMA_ADPCM else 1) for b, k in zip(raw, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return scratch_table(text_or_empty(docs).mapInArrow(build, "doc_id long, n_bytes long, media binary"), "audio", **DENSE)


KEPT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"


def transcode(media: DataFrame, to: int = 16000) -> DataFrame:
    """Stored files read back, decoded and resampled: digests, features of the samples, and the PCM at rate ``to``, as a table in the shared folder."""

    def decoded(files: list[tuple]) -> list[np.ndarray]:
        """Samples of each (code, rate, align, payload); the ADPCM blocks of all together."""
        out = [decode(code, align, payload) if code != IMA_ADPCM else None for code, _, align, payload in files]
        for align in {f[2] for f in files if f[0] == IMA_ADPCM}:
            which = [i for i, f in enumerate(files) if f[0] == IMA_ADPCM and f[2] == align]
            blocks = [files[i][3][: len(files[i][3]) // align * align] for i in which]
            samples = decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8), align)
            ends = np.cumsum([len(b) // align * (2 * align - 7) for b in blocks])
            for i, part in zip(which, np.split(samples, ends[:-1])):
                out[i] = part
        return out

    def of(file: bytes, wav: tuple, samples: np.ndarray) -> tuple:
        code, rate, _, payload = wav
        wide = samples.astype(np.int64)
        crossings = int(np.count_nonzero(np.diff(samples < 0)))
        feature = f"format={code};samples={len(samples)};energy={int(wide @ wide)};crossings={crossings};peak={int(np.abs(wide).max(initial=0))};rate={to}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, pack_pcm(resample(samples, rate, to))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                files = [m.as_py() for m in part.column("media")]
                waves = [read_wav(f) for f in files]
                rows = [of(*x) for x in zip(files, waves, decoded(waves))]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=names)

    names = [f.split()[0] for f in KEPT.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return scratch_table(media.select("doc_id", "n_bytes", "media").mapInArrow(read, KEPT), "pcm", **DENSE)


def measure(kept: DataFrame) -> DataFrame:
    """The rows of ``transcode`` with their feature strings completed from the PCM as it was stored, and without it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = []
            for feature, pcm in zip(batch.column("feature").to_pylist(), batch.column("pcm")):
                crc, n = 0, 0
                for part in unpack_pcm(pcm.as_py()):
                    crc, n = zlib.crc32(part.astype("<i2").tobytes(), crc), n + len(part)
                features.append(f"{feature};resampled={n};pcm_crc32={crc}")
            columns = [pa.array(features) if c == "feature" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [f.split()[0] for f in KEPT.split(", ")][:-1]
    return kept.mapInArrow(read, KEPT.rpartition(", ")[0])


def op9_audio(spark, sf_dir):
    """Every text as telephony audio, stored, read back, decoded, resampled, and stored as PCM."""
    return measure(transcode(store(table(spark, sf_dir, "documents"))))
