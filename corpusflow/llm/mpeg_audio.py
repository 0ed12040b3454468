"""MPEG audio columns: framing, tags, variable-bitrate tables, checksums, seek offsets (operator 4).

`pack` stores a payload losslessly in a valid MPEG-1 Layer III stream: an ID3v2 tag holding the
payload's true length, a frame with a Xing/Info table, then one frame for every 576 payload bytes.
Each frame is protected by its CRC-16; its main data is empty (silence) and the payload is the
frame's ancillary data. `parse` reads any MPEG audio stream: it skips tags, resynchronises on
frame headers, checks checksums, reads Xing/Info and VBRI tables, and returns the exact duration as
samples over the sampling rate (as they are, and less an encoder's delay and padding, which the
table tells) and the byte offset of every frame.

Edge cases: a null text is an empty one; an empty payload still fills one unit of 576 bytes of 255;
damaged bytes between frames are counted in `skipped` and passed over; a table or tag that is cut off
isn't read; free-format frames aren't recognised; a stream without frames has no duration; equal texts give equal bytes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import arrays, storage

UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s and sampling rates in Hz.
RATES_V1 = {1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
RATES_V2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        table[i] = c
    return table


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        c = (c << np.uint16(8)) ^ CRC[(c >> np.uint16(8)) ^ column]
    return c


def _header_tables() -> tuple[np.ndarray, ...]:
    """For the 16 bits of header bytes 2 and 3: frame length, samples, sampling rate, bit rate; length 0: not a header."""
    length, samples, rate, kbits = (np.zeros(1 << 16, np.int32) for _ in range(4))
    for second in range(0xE0, 0x100):
        version, layer = second >> 3 & 3, 4 - (second >> 1 & 3)
        if version == 1 or layer == 4:
            continue
        for third in range(256):
            r, s, pad = third >> 4, third >> 2 & 3, third >> 1 & 1
            if r in (0, 15) or s == 3:
                continue
            kb, hz = (RATES_V1 if version == 3 else RATES_V2)[layer][r], SAMPLING[version][s]
            n = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            at = second << 8 | third
            length[at] = (12000 * kb // hz + pad) * 4 if layer == 1 else n // 8 * 1000 * kb // hz + pad
            samples[at], rate[at], kbits[at] = n, hz, kb
    return length, samples, rate, kbits


LENGTH, SAMPLES, RATE, KBITS = _header_tables()

# The stored form: MPEG-1 Layer III, protected, 224 kbit/s, 48 kHz, stereo: 672 bytes a frame.
HEADER = bytes((0xFF, 0xFA, 0xC4, 0x00))
FRAME = int(LENGTH[0xFAC4])
SIDE = 32
BODY = 4 + 2 + SIDE


def _safe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def pack(payload: bytes, n_bytes: int) -> bytes:
    """payload: a positive multiple of UNIT bytes, of which n_bytes are content."""
    count = len(payload) // UNIT
    frames = np.zeros((count + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[:, 4:6] = np.frombuffer(crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6 : 6 + SIDE]], 1)).astype(">u2").tobytes(), np.uint8)
    frames[1:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(count, UNIT)
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, count, (count + 1) * FRAME) + toc
    frames[0, BODY : BODY + len(info)] = np.frombuffer(info, np.uint8)
    value = b"\x03payload-bytes\x00%d" % n_bytes
    text = b"TXXX" + _safe(len(value)) + b"\x00\x00" + value
    return b"ID3\x04\x00\x00" + _safe(len(text)) + text + frames.tobytes()


def _tag(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes taken by a leading ID3v2 tag, its user text fields)."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 128 for b in data[6:10]):
        return 0, {}
    end = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    at, fields = 10, {}
    if data[5] & 64 and data[3] in (3, 4):  # an extended header comes first
        n = data[10:14]
        at += (n[0] << 21 | n[1] << 14 | n[2] << 7 | n[3] if data[3] == 4 else 4 + int.from_bytes(n, "big")) if len(n) == 4 else 0
    while at + 10 <= min(end, len(data)) and data[at] and data[3] in (3, 4):
        n = data[at + 4 : at + 8]
        size = n[0] << 21 | n[1] << 14 | n[2] << 7 | n[3] if data[3] == 4 else int.from_bytes(n, "big")
        if size > len(data):
            break
        if data[at : at + 4] == b"TXXX" and data[at + 10 : at + 11] in (b"\x00", b"\x03"):
            key, _, value = data[at + 11 : at + 10 + size].partition(b"\x00")
            fields[key.decode("latin-1")] = value.decode("utf-8", "replace").rstrip("\x00")
        at += 10 + size
    return end + 10 * bool(data[5] & 16), fields


def parse(data: bytes) -> dict:
    """Tags, frames, table and checks of one stream."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return _parse(data, len(data))
    whole = _parse(data, len(data))
    held = whole["offset"] + whole["length"] == len(data)  # bytes inside a frame of the chain are no tag
    return whole if len(held) > 1 and held[-1] and whole["offset"][-2] + whole["length"][-2] == whole["offset"][-1] else _parse(data, len(data) - 128)


def _parse(data: bytes, end: int) -> dict:
    """`parse` of the bytes before `end`."""
    raw = np.frombuffer(data, np.uint8)
    first, fields = _tag(data)
    at = np.flatnonzero((raw[: end - 3] == 0xFF) & (raw[1 : end - 2] >= 0xE0)) if end > 4 else np.zeros(0, np.int64)
    at = at[at >= first]
    code = raw[at + 1].astype(np.int64) << 8 | raw[at + 2]
    size = LENGTH[code]
    good = (size > 0) & (at + size <= end)
    at, code, size = at[good], code[good], size[good]
    place = {p: i for i, p in enumerate(at.tolist())}
    follow = (at + size).tolist()
    kinds = (code >> 9).tolist()  # version and layer stay the same through a stream
    chosen: list[int] = []
    now, skipped, i = first, 0, 0
    while i < len(follow):
        j = place.get(now)
        if j is not None and (not chosen or kinds[j] == kinds[chosen[0]]):
            chosen.append(j)
            now = follow[j]
            continue
        i = int(np.searchsorted(at, now + (j is not None)))  # resynchronise: a header whose frame leads to another header or to the end
        while i < len(follow) and not (follow[i] == end or follow[i] in place):
            i += 1
        if i < len(follow):
            skipped += int(at[i]) - now
            now = int(at[i])
    skipped += max(0, end - now)
    j = np.array(chosen, np.int64)
    offset, code = at[j], code[j]
    frames = {"fields": fields, "offset": offset, "length": size[j], "skipped": skipped, "samples": 0, "played": 0, "rate": 0, "table": None, "checked": 0, "wrong": 0, "code": code}
    if not len(j):
        return frames
    mono = raw[offset + 3] >> 6 == 3
    v1 = (code >> 11 & 3) == 3
    side = np.where(v1, np.where(mono, 17, 32), np.where(mono, 9, 17))
    safe = code >> 8 & 1 == 0
    for n in np.unique(side[safe]):
        rows = offset[safe & (side == n)]
        body = raw[rows[:, None] + np.concatenate([[2, 3], np.arange(6, 6 + n)])]
        told = raw[rows + 4].astype(np.uint16) << np.uint16(8) | raw[rows + 5]
        frames["checked"] += len(rows)
        frames["wrong"] += int((crc16(body) != told).sum())
    body = int(offset[0]) + 4 + 2 * bool(safe[0]) + int(side[0])
    stop = int(offset[0] + size[j[0]])  # a table lies whole within the first frame, or isn't one
    frames["table"] = xing_table(data[body:stop]) or vbri_table(data[int(offset[0]) + 36 : stop])
    drop = 1 if frames["table"] else 0  # the table's frame isn't played
    samples = int(SAMPLES[code[drop:]].sum())
    frames |= {"samples": samples, "rate": int(RATE[code[0]]), "played": max(0, samples - sum((frames["table"] or {}).get("trim", (0, 0))))}
    return frames


def xing_table(body: bytes) -> dict | None:
    """The table that starts a frame's main data with `Xing` or `Info`: counts, seek points, and samples to trim at both ends."""
    if body[:4] not in (b"Xing", b"Info") or len(body) < 8:
        return None
    flags, at = int.from_bytes(body[4:8], "big"), 8
    table: dict = {"kind": body[:4].decode(), "frames": None, "bytes": None, "seek": [], "trim": (0, 0)}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            if at + 4 > len(body):
                return None
            table[name], at = int.from_bytes(body[at : at + 4], "big"), at + 4
    if flags & 4:
        if at + 100 > len(body):
            return None
        table["seek"], at = [x * (table["bytes"] or 0) // 256 for x in body[at : at + 100]], at + 100
    at += 4 * bool(flags & 8)
    if at + 24 <= len(body) and body[at : at + 4] in (b"LAME", b"Lavf", b"Lavc"):
        trim = int.from_bytes(body[at + 21 : at + 24], "big")
        table["trim"] = (trim >> 12, trim & 4095)
    return table


def vbri_table(body: bytes) -> dict | None:
    """The table at byte 36 of a frame: counts and the byte offsets of its seek points."""
    if body[:4] != b"VBRI" or len(body) < 26:
        return None
    delay, _, size, count, points, scale, width, _ = struct.unpack_from(">HHIIHHHH", body, 6)
    seek = [0]
    if 1 <= width <= 4 and 26 + points * width <= len(body):
        for i in range(points):
            seek.append(seek[-1] + int.from_bytes(body[26 + i * width : 26 + (i + 1) * width], "big") * scale)
    return {"kind": "VBRI", "frames": count, "bytes": size, "seek": seek, "trim": (0, 0), "delay": delay}


def payload(data: bytes, found: dict) -> bytes:
    """The bytes that `pack` stored, from a stream that `parse` has read."""
    rows = found["offset"][1:]
    rows = rows[found["length"][1:] == FRAME]
    return np.frombuffer(data, np.uint8)[rows[:, None] + np.arange(BODY, BODY + UNIT)].tobytes()


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media: each whole text in its stored form, in a table of the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.sliced(batches, "text"):
            data, off = arrays.utf8(batch.column("text"))
            whole = data.tobytes()
            media = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                n = b - a
                media.append(pack(whole[a:b] + b"\xff" * (max(UNIT, -(-n // UNIT) * UNIT) - n), n))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(media, pa.binary())], [key, "media"])

    out = docs.select(F.col(key).cast("long"), F.col(text).alias("text")).mapInArrow(encode, f"{key} long, media binary")
    return storage.written(out, "media", compression="zstd")


def describe(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per stream: what it holds, its digests, exact duration and frame seek offsets."""
    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sampling_rate long, played long, seek array<long>"
    arrow = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "samples": pa.int64(), "sampling_rate": pa.int64(), "played": pa.int64(), "seek": pa.list_(pa.int64())}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.sliced(batches, "media"):
            out: dict[str, list] = {k: [] for k in arrow}
            for data in batch.column("media").to_pylist():
                f = parse(data)
                held = payload(data, f)
                table = f["table"] or {}
                kbits = KBITS[f["code"]]
                feature = f"frames={len(f['offset'])} kbps={int(kbits.min())}-{int(kbits.max())} duration={f['samples']}/{f['rate']} crc={f['checked'] - f['wrong']}/{f['checked']} skipped={f['skipped']} {table.get('kind')}={table.get('frames')}:{table.get('bytes')}" if len(kbits) else "no frames"
                told = f["fields"].get("payload-bytes", "")
                row = (int(told) if told.isdecimal() and len(told) < 16 else 0, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, f["samples"], f["rate"], f["played"], f["offset"].tolist())
                for k, v in zip(arrow, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(out[k], t) for k, t in arrow.items())], [key, *arrow])

    return media.mapInArrow(decode, schema)


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return describe(store(docs))
