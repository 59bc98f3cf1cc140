"""ISO base media files: write payloads as samples, walk boxes, decode sample tables; payloads are never decoded.

``index_media`` reads any such file (ISO/IEC 14496-12: nested boxes with 32- or 64-bit sizes, or running to the end):
for each track the codec, timescale, duration, sample count, and the byte ranges of its key frames, from stsd, mdhd,
stts, stsz or stz2, stsc, stco or co64, and stss (without stss every sample is a key frame). ``mux`` writes a payload
losslessly as 8-bit samples of one track, 64 samples to an access unit.

Null or empty content: no tracks. Truncated, foreign or hostile bytes: the boxes that are whole count, down to ``DEEPEST``
nested ones, the rest is ignored; a track with inconsistent tables, or with a sample outside the file, has no ranges, and
nothing raises. No table makes the reader hold more than a few numbers for each byte of the file. Very long contents: read
alone. Empty table: empty result. Repeated rows: one result each; equal contents give equal results. Ties do not arise.
Other columns of ``index_media`` pass through as asked for; one named tracks is replaced. ``digest`` reads doc_id and text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

#: Boxes that hold boxes; what stands before these is skipped.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
UNIT = 64
RATE = 8000
#: Boxes within boxes that are walked; the standard nests six.
DEEPEST = 32


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE, key_every: int = 16) -> bytes:
    """A file of one audio track whose samples are the payload's units (8-bit PCM); every 16th is marked as key."""
    if not payload or len(payload) % unit:
        raise ValueError("payload must be a positive multiple of the unit")
    n = len(payload) // unit
    keys = range(1, n + 1, key_every)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    big = len(payload) + 4096 + 4 * len(keys) >= 1 << 32

    def moov(at: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(">I", len(keys)), np.array(keys, dtype=">u4").tobytes()),
            full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            full(b"stsz", struct.pack(">II", unit, n)),
            full(b"co64", struct.pack(">IQ", 1, at)) if big else full(b"stco", struct.pack(">II", 1, at)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        duration = len(payload)
        long_ = duration >= 1 << 32
        times = struct.pack(">QQIQ" if long_ else ">IIII", 0, 0, rate, duration)
        mdhd = box(b"mdhd", bytes([int(long_), 0, 0, 0]), times, struct.pack(">HH", 0x55C4, 0))
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = box(b"tkhd", bytes([int(long_), 0, 0, 3]), struct.pack(">QQIIQ" if long_ else ">IIIII", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = box(b"mvhd", bytes([int(long_), 0, 0, 0]), times, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(at) + box(b"mdat", payload)


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box, outer before inner: its path of types, and where its body begins and ends."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_:
        path, lo, hi = open_.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if lo + 16 > hi:
                continue
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            continue
        open_.append((path, lo + size, hi))
        yield (*path, kind), lo + head, lo + size
        if kind in CONTAINERS and len(path) < DEEPEST:
            open_.append(((*path, kind), lo + head + CONTAINERS[kind], lo + size))


def _ints(data: memoryview, lo: int, hi: int, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=kind, count=max(0, min(n, (hi - lo) // width)), offset=lo).astype(np.int64)


def _table(data: memoryview, lo: int, hi: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, lo + 4)[0]
    got = _ints(data, lo + 8, hi, kind, n * columns)
    return got[: len(got) // columns * columns].reshape(-1, columns)


def _track(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> dict:
    """Codec, times and sample ranges of a track from its boxes."""
    out = {"codec": None, "timescale": 0, "duration": 0, "samples": 0, "at": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "key": np.zeros(0, np.int64)}
    if b"mdhd" in boxes:
        lo, hi = boxes[b"mdhd"]
        out["timescale"], out["duration"] = struct.unpack_from(">IQ", data, lo + 20) if data[lo] == 1 else struct.unpack_from(">II", data, lo + 12)
    if b"stsd" in boxes:
        lo, hi = boxes[b"stsd"]
        if hi >= lo + 16:
            out["codec"] = bytes(data[lo + 12 : lo + 16]).decode("latin-1")
    if not out["duration"] and b"stts" in boxes:
        t = _table(data, *boxes[b"stts"], 2)
        out["duration"] = sum(n * d for n, d in t.tolist())
    out["duration"] = min(out["duration"], (1 << 63) - 1)
    size = np.zeros(0, np.int64)
    if b"stsz" in boxes:
        lo, hi = boxes[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, lo + 4)
        # a fixed size needs no table, so its count alone is not proof: no more samples than the file has bytes for
        size = np.full(min(n, len(data) // fixed), fixed, np.int64) if fixed else _ints(data, lo + 12, hi, ">u4", n)
    elif b"stz2" in boxes:
        lo, hi = boxes[b"stz2"]
        width, n = data[lo + 7], struct.unpack_from(">I", data, lo + 8)[0]
        if width == 4:
            b = np.frombuffer(data[lo + 12 : hi], np.uint8)
            size = np.stack((b >> 4, b & 15), axis=1).reshape(-1)[:n].astype(np.int64)
        elif width in (8, 16):
            size = _ints(data, lo + 12, hi, f">u{width // 8}", n)
    out["samples"] = len(size)
    name = b"stco" if b"stco" in boxes else b"co64"
    if not len(size) or name not in boxes or b"stsc" not in boxes:
        return out
    chunk = _table(data, *boxes[name], 1, ">u4" if name == b"stco" else ">u8")[:, 0]
    runs = _table(data, *boxes[b"stsc"], 3)
    if not len(chunk) or not len(runs) or runs[0, 0] != 1:
        return out
    run = np.searchsorted(runs[:, 0], np.arange(1, len(chunk) + 1), side="right") - 1
    # Past the last sample chunks are empty: what is made has as many places as there are samples, whatever the table says.
    upto = np.minimum(np.cumsum(np.minimum(runs[run, 1], len(size)).astype(float)), len(size)).astype(np.int64)
    of = np.repeat(np.arange(len(chunk)), np.diff(upto, prepend=0))
    if len(of) < len(size):
        return out
    before = np.concatenate(([0], np.cumsum(size)))[:-1]
    first = np.searchsorted(of, np.arange(len(chunk)))
    at = chunk[of] + before - before[np.minimum(first, len(size) - 1)][of]
    if ((at < 0) | (size > len(data) - at)).any():
        return out
    key = np.arange(len(size))
    if b"stss" in boxes:
        key = _table(data, *boxes[b"stss"], 1)[:, 0] - 1
        key = key[(key >= 0) & (key < len(size))]
    out |= {"at": at, "size": size, "key": key}
    return out


def tracks(content: bytes | None) -> list[dict]:
    """The tracks of a file, in order."""
    data, found = memoryview(content or b""), []
    for path, lo, hi in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(path[-1], (lo, hi))
    out = []
    for boxes in found:
        try:
            out.append(_track(data, boxes))
        except (struct.error, ValueError, IndexError, OverflowError):  # a table cut short: what is known of the track is not kept
            out.append(_track(data, {}))
    return out


def spans(at: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, those that touch joined."""
    if not len(at):
        return []
    new = np.concatenate(([True], at[1:] != at[:-1] + size[:-1]))
    first = np.flatnonzero(new)
    return list(zip(at[first].tolist(), np.add.reduceat(size, first).tolist(), strict=True))


TRACKS = "array<struct<codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<offset:long,bytes:long>>>>"


def index_media(files: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ``tracks``: codec, duration and key frame byte ranges of each track of each file."""
    small_batches(files.sparkSession)
    keep = [c for c in files.columns if c != content] if keep is None else keep
    schema = files.select(*keep).schema.add("tracks", T.StructType.fromDDL(f"tracks {TRACKS}")["tracks"].dataType)

    def read(frames):
        for f in frames:
            out = f.drop(columns="__content")
            out["tracks"] = [
                [{"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": t["samples"], "keyframes": [{"offset": int(t["at"][k]), "bytes": int(t["size"][k])} for k in t["key"]] if len(t["at"]) else []} for t in tracks(c)]
                for c in f["__content"]
            ]
            yield out

    return files.select(*keep, F.col(content).alias("__content")).mapInPandas(tidy(read), schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Each text stored as such a file, read back through its sample table, with digests and a feature string.

    feature: codec, timescale, duration, samples, key frames, and the crc32 of the key frames' (offset, size) list.
    """
    small_batches(docs.sparkSession)

    def store(frames):
        for f in frames:
            rows = []
            for text in f["text"]:
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                media = mux(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)))
                (t,) = tracks(media)
                back = b"".join(media[a : a + n] for a, n in spans(t["at"], t["size"]))
                keys = np.stack((t["at"][t["key"]], t["size"][t["key"]]), axis=1).astype("<i8")
                feature = f"{t['codec'].strip()}/{t['timescale']} duration={t['duration']} samples={t['samples']} keys={len(keys)} ranges={zlib.crc32(keys.tobytes()):08x}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(store), DIGEST)
