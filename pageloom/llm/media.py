"""Media columns: clips of motion-JPEG videos in AVI files.

A file's frames are found by its index (``idx1``, or OpenDML's ``indx`` and ``ix``
chunks), or by walking ``movi`` if it has none that holds.  Each intra frame is
decoded, and neighbouring frames are compared by their histograms of brightness and
both colour components.  A shot begins where the difference is over an adaptive
threshold: the mean plus ``SPREADS`` standard deviations of the differences around
it, and at least ``LEAST`` of the pixels.  Each shot is a clip row.

Defined results: null and empty contents and files that are no AVI with motion-JPEG
frames give one row with an ``error`` and no times; an empty frame repeats the one
before, and a frame that can't be decoded counts as such and is reported in
``bad_frames`` of its clip; a file without a frame that can be decoded gives an error
row; rows without a key are treated like others; repeated rows have their own rows; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import jpeg, shared, wordhash

#: Frames on each side whose differences make the threshold.
AROUND = 8
SPREADS = 3.0
#: The least share of an image whose histogram must change at a cut.
LEAST = 0.25
#: Bytes of videos whose frames are decoded side by side.
_TOGETHER = 8 << 20


class AviError(ValueError):
    """The bytes are no AVI file with a motion-JPEG stream."""


@dataclass
class Video:
    width: int
    height: int
    fps: float
    frames: list[tuple[int, int]]  # offset and size of each


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, begin, end) of the chunks of a list; the last may be cut short."""
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def _walk(data: bytes, at: int, end: int, names: set[bytes]) -> Iterator[tuple[int, int]]:
    for name, a, b in _chunks(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _walk(data, a + 4, b, names)
        elif name in names:
            yield a, b - a


def _idx1(data: bytes, index: tuple[int, int], movi: int, names: set[bytes]) -> list[tuple[int, int]]:
    """The index's frames, if its offsets hold, from ``movi`` or from the file's beginning."""
    entries = [e for e in struct.iter_unpack("<4sIII", data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]) if e[0] in names]
    for base in (movi, 0):
        if entries and all(data[base + offset : base + offset + 4] == name and base + offset + 8 + size <= len(data) for name, _, offset, size in entries):
            return [(base + offset + 8, size) for _, _, offset, size in entries]
    return []


def _opendml(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int]]:
    """The frames of an ``indx`` or ``ix`` chunk's body, none if any part of the index is missing."""
    if end - at < 24:
        return []
    longs, _, kind, n = struct.unpack_from("<HBBI", data, at)
    out: list[tuple[int, int]] = []
    if kind == 0 and depth == 0 and longs == 4:
        if n > (end - at - 24) // 16:
            return []
        for i in range(n):
            offset, size, _ = struct.unpack_from("<QII", data, at + 24 + 16 * i)
            if not (found := _opendml(data, offset + 8, min(offset + size, len(data)), 1)):
                return []
            out += found
    elif kind == 1 and longs == 2:
        base = struct.unpack_from("<Q", data, at + 12)[0]
        if n > (end - at - 24) // 8:
            return []
        for i in range(n):
            offset, size = struct.unpack_from("<II", data, at + 24 + 8 * i)
            out.append((base + offset, size & 0x7FFFFFFF))
    return out if all(0 <= a and a + n <= len(data) for a, n in out) else []


def parse(data: bytes) -> Video:
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise AviError("not an AVI file")
    stream = width = height = 0
    fps, number, video = 0.0, -1, None
    index, movis, opendml = None, [], []
    for riff, a, b in _chunks(data, 0, len(data)):
        if riff != b"RIFF" or data[a : a + 4] not in (b"AVI ", b"AVIX"):
            continue
        for name, c, d in _chunks(data, a + 4, b):
            kind = data[c : c + 4] if name == b"LIST" else b""
            if name == b"idx1":
                index = (c, d)
            elif kind == b"movi":
                movis.append((c, d))
            elif kind == b"hdrl":
                for header, e, f in _chunks(data, c + 4, d):
                    if header == b"avih" and f - e >= 4 and (micro := struct.unpack_from("<I", data, e)[0]):
                        fps = fps or 1e6 / micro
                    if header != b"LIST" or data[e : e + 4] != b"strl":
                        continue
                    number += 1
                    parts = {n: (g, h) for n, g, h in _chunks(data, e + 4, f)}
                    if video is not None or b"strh" not in parts or data[parts[b"strh"][0] : parts[b"strh"][0] + 4] != b"vids" or parts[b"strh"][1] - parts[b"strh"][0] < 28:
                        continue
                    video, stream = number, parts[b"strh"][0]
                    scale, rate = struct.unpack_from("<II", data, stream + 20)
                    fps = rate / scale if rate and scale else fps
                    if b"strf" in parts and parts[b"strf"][1] - parts[b"strf"][0] >= 12:
                        width, height = struct.unpack_from("<ii", data, parts[b"strf"][0] + 4)
                    if b"indx" in parts:
                        opendml = _opendml(data, *parts[b"indx"])
    if video is None or not movis:
        raise AviError("no video stream")
    names = {b"%02d%s" % (video, kind) for kind in (b"dc", b"db")}
    frames = opendml or (_idx1(data, index, movis[0][0], names) if index else [])
    if not frames or (len(movis) > 1 and not opendml):
        frames = [f for a, b in movis for f in _walk(data, a + 4, b, names)]
    return Video(abs(width), abs(height), fps or 25.0, frames)


def histograms(images: np.ndarray) -> np.ndarray:
    """For each image the shares of 16 levels of brightness and of 8 levels of each colour component."""
    n, pixels = len(images), images.shape[1] * images.shape[2]
    flat = images.reshape(n, pixels, 3)
    out = []
    for c, levels in enumerate((16, 8, 8)):
        at = (flat[..., c] // (256 // levels)).astype(np.int64) + levels * np.arange(n)[:, None]
        out.append(np.bincount(at.ravel(), minlength=levels * n).reshape(n, levels))
    return np.concatenate(out, 1) / pixels


def cuts(differences: np.ndarray, around: int = AROUND, spreads: float = SPREADS, least: float = LEAST) -> list[int]:
    """The frames at which a shot begins; ``differences[i]`` is between frames i and i + 1."""
    out = []
    for i, d in enumerate(differences):
        near = np.concatenate([differences[max(0, i - around) : i], differences[i + 1 : i + 1 + around]])
        if d >= least and (not len(near) or d > near.mean() + spreads * near.std() or _flat(differences, i, around, least)):
            out.append(i + 1)
    return out


def _flat(differences: np.ndarray, i: int, around: int, least: float) -> bool:
    """Whether other cuts are what raises the threshold: the differences below ``least`` are quiet."""
    near = np.concatenate([differences[max(0, i - around) : i], differences[i + 1 : i + 1 + around]])
    quiet = near[near < least]
    return len(quiet) >= len(near) / 2 and differences[i] > quiet.mean() + SPREADS * quiet.std() if len(quiet) else False


@dataclass
class Shot:
    first: int
    end: int
    strength: float
    bad: int


def shots(data: bytes) -> tuple[Video, list[Shot]]:
    if isinstance(found := shots_of([data])[0], AviError):
        raise found
    return found


def shots_of(files: list[bytes]) -> list[tuple[Video, list[Shot]] | AviError]:
    """The shots of each file, or why there are none; frames of all files are decoded side by side."""
    videos: list[Video | AviError] = []
    for data in files:
        try:
            videos.append(parse(data))
        except AviError as e:
            videos.append(e)
    places = [(v, at, n) for v, video in enumerate(videos) if isinstance(video, Video) for at, n in video.frames if n]
    looks = lambda images: [(h, images.shape[1:3]) for h in histograms(images)]
    seen = iter(jpeg.decode_all([files[v][at : at + n] for v, at, n in places], looks))
    return [_shots_of_frames(v, [next(seen) if n else None for _, n in v.frames]) if isinstance(v, Video) else v for v in videos]


def _shots_of_frames(video: Video, frames: list[tuple | jpeg.JpegError | None]) -> tuple[Video, list[Shot]] | AviError:
    """``frames`` has each frame's histogram and size, None for an empty one, or why it can't be decoded."""
    seen: list[np.ndarray | None] = []
    last, bad, size = None, [], None
    for frame in frames:
        if isinstance(frame, tuple):
            last, size = frame
        bad.append(isinstance(frame, jpeg.JpegError))
        seen.append(last)
    if last is None:
        return AviError("no frame can be decoded")
    video.width, video.height = video.width or size[1], video.height or size[0]
    first = next(h for h in seen if h is not None)
    known = np.stack([first if h is None else h for h in seen])
    differences = np.abs(np.diff(known, axis=0)).reshape(-1, known.shape[1])
    differences = np.maximum(differences[:, :16].sum(1), np.maximum(differences[:, 16:24].sum(1), differences[:, 24:].sum(1))) / 2
    begins = [0, *cuts(differences)]
    ends = [*begins[1:], len(seen)]
    return video, [Shot(a, b, float(differences[a - 1]) if a else 0.0, sum(bad[a:b])) for a, b in zip(begins, ends)]


_CLIPS = pa.schema(
    [("media_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("cut_strength", pa.float64()), ("bad_frames", pa.int64()), ("error", pa.string())]
)


def clips(media: DataFrame, key: str = "media_id", content: str = "content") -> DataFrame:
    """(media_id, clip, first_frame, end_frame, start_s, end_s, width, height, cut_strength, bad_frames, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "content", _TOGETHER):
                files = [data or b"" for data in part.column("content").to_pylist()]
                rows: list[tuple] = []
                for media_id, found in zip(part.column("media_id").to_pylist(), shots_of(files)):
                    if isinstance(found, AviError):
                        rows.append((media_id, *[None] * 9, str(found)))
                        continue
                    video, own = found
                    rows += [(media_id, k, s.first, s.end, s.first / video.fps, s.end / video.fps, video.width, video.height, s.strength, s.bad, None) for k, s in enumerate(own)]
                yield shared.rows(_CLIPS, **dict(zip(_CLIPS.names, map(list, zip(*rows)))))

    ddl = "media_id long, clip int, first_frame long, end_frame long, start_s double, end_s double, width int, height int, cut_strength double, bad_frames long, error string"
    return media.select(F.col(key).cast("long").alias("media_id"), F.col(content).alias("content")).mapInArrow(run, ddl)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int, index: str = "idx1") -> bytes:
    """An AVI file of JPEG frames; ``index`` is "idx1", "absolute" (idx1 from the file's beginning), "opendml" or "none"."""
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    body, offsets = b"movi", []
    for f in frames:
        offsets.append(len(body))
        body += _chunk(b"00dc", f)

    def header(super_index: bytes) -> bytes:
        return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + super_index))

    indx = lambda at, size: _chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + struct.pack("<QII", at, size, len(frames)))
    top = header(indx(0, 0) if index == "opendml" else b"")
    movi = 12 + len(top) + 8
    if index == "opendml":
        ix = struct.pack("<HBBI4sQ4x", 2, 0, 1, len(frames), b"00dc", movi) + b"".join(struct.pack("<II", o + 8, len(f)) for o, f in zip(offsets, frames))
        top = header(indx(movi + len(body), len(ix) + 8))
        body += _chunk(b"ix00", ix)
    out = top + _chunk(b"LIST", body)
    if index in ("idx1", "absolute"):
        base = movi if index == "absolute" else 0
        out += _chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, base + o, len(f)) for o, f in zip(offsets, frames)))
    return _chunk(b"RIFF", b"AVI " + out)


_DRAWN = pa.schema([("media_id", pa.int64()), ("content", pa.binary())])
SIDE = 16


def draw(key: int, values: list[float]) -> tuple[bytes, list[int]]:
    """A small video made from numbers, and the frames at which its shots begin: what test media are."""
    values = [v for v in values if v is not None] or [0.0]
    images, begins = [], []
    for shot in range(2 + key % 3):
        begins.append(sum(map(len, images)))
        tone = np.array([values[(3 * shot + i) % len(values)] for i in range(3)])
        base = np.array([40 + 150 * (shot % 2), 60 + 130 * (shot // 2 % 2), 190 - 130 * (shot % 2)]) + 20 * np.tanh(tone)
        shots = np.tile(base, (4 + (key * 7 + shot) % 5, SIDE, SIDE, 1))
        for k, image in enumerate(shots):
            image[k % 8 : k % 8 + 4, 4:8, 0] += 30
        images.append(shots)
    drawings = np.clip(np.concatenate(images), 0, 255).astype(np.uint8)
    frames = jpeg.encode_all(drawings, tables=key % 2 == 0)
    return write_avi(frames, SIDE, SIDE, 12, ("idx1", "opendml", "absolute", "none")[key % 4]), begins


def drawn(table: DataFrame, key: str, values: str) -> DataFrame:
    """(media_id, content): a video for each row of a table of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                ids = part.column(0).to_pylist()
                yield shared.rows(_DRAWN, media_id=ids, content=[draw(i or 0, v or [])[0] for i, v in zip(ids, part.column(1).to_pylist())])

    return table.select(F.col(key).cast("long"), values).mapInArrow(run, "media_id long, content binary")
