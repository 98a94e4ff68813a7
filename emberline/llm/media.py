"""Media columns: texts kept as lossless media, found again by their signatures."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .memory import let_go
from .text import as_bytes, byte_slices

UNIT = 192  # bytes: a row of 64 RGB pixels
KINDS = ("wav", "png", "bmp")
PNG = b"\x89PNG\r\n\x1a\n"
#: Magic bytes and the types they announce.
MAGIC = {PNG: "png", b"RIFF": "wav", b"BM": "bmp", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg"}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_media(payload: bytes, kind: str) -> bytes:
    """A payload (a multiple of 192 bytes) as 8-bit samples: mono PCM, or RGB rows of 64 pixels."""
    rows = len(payload) // UNIT
    if kind == "wav":
        return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 16000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    if kind == "bmp":
        return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(payload), 0, 0, 54, 40, 64, -rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + payload
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", 64, rows, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, p, seen = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, set()
    while p + 8 <= min(end, len(b)):
        seen.add(b[p : p + 4])
        p += 8 + int.from_bytes(b[p + 4 : p + 8], "little")
        p += p - at & 1 if p < end else 0
    return end - at if end <= len(b) and p == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            try:
                for _ in _png_lines(b[at:p], filtered=True):
                    pass
            except (ValueError, zlib.error):
                return 0
            return p - at
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, bits, packed = struct.unpack_from("<iiHHI", b, at + 18)
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    return size if zero == 0 and width > 0 and head == 40 and planes == 1 and bits == 24 and packed == 0 and size == start + rows and start >= 54 and at + size <= len(b) else 0


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if len(b) < at + 13:
        return 0
    p = at + 13 + (3 * 2 ** ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 * 2 ** ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, framed = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2:
            return 0
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if 0 <= p < len(b) - 1 and b[p + 1] == 0xD9:
                return p + 2 - at if framed else 0
            if p < 0:
                return 0
    return 0


VALID = {"wav": _wav, "png": _png, "bmp": _bmp, "gif": _gif, "jpeg": _jpeg}


class Sniffer:
    """Finds all magic bytes of a blob in one Aho-Corasick pass; a find counts if its format's validator reads it whole."""

    def __init__(self):
        self.magic = ahocorasick.Automaton()
        for m, kind in MAGIC.items():
            self.magic.add_word(m.decode("latin-1"), (kind, len(m)))
        self.magic.make_automaton()

    def find(self, blob: bytes) -> list[tuple[int, int, str]]:
        """(start, length, type) of outermost valid media in order."""
        found, free = [], 0
        hits = sorted((end + 1 - n, kind) for end, (kind, n) in self.magic.iter(blob.decode("latin-1")))
        for start, kind in hits:
            if start >= free and (n := VALID[kind](blob, start)):
                found.append((start, n, kind))
                free = start + n
        return found


#: Bits a sample that each PNG colour type may have, its samples a pixel, and the passes of interlaced images.
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _inflated(parts: Iterator[bytes], most: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of one deflate stream in several parts, some at a time; an error unless it ends with them."""
    stream = zlib.decompressobj()
    for part in parts:
        while part:
            yield stream.decompress(part, most)
            part = stream.unconsumed_tail
    if not stream.eof or stream.unused_data:
        raise ValueError("the image data do not end with the stream")


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG line without its filter: each byte was stored as its difference from a guess by bytes left, above and both."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        pixels = np.concatenate((line, np.zeros(-len(line) % step, np.uint8))).reshape(-1, step)
        return np.cumsum(pixels, axis=0, dtype=np.uint8).ravel()[: len(line)]
    out = bytearray(len(line))
    stored_, up = line.tobytes(), above.tobytes()
    for i, x in enumerate(stored_):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (x + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _png_lines(media: bytes, filtered: bool = False) -> Iterator[bytes]:
    """The bytes of a PNG's lines (of an interlaced one pass by pass) in parts; with ``filtered`` as they are stored.

    A ``ValueError`` or ``zlib.error`` tells of a header that no image has, broken data, or too few or many of them.
    """
    chunks, p = [], 8
    while p < len(media):
        n = int.from_bytes(media[p : p + 4], "big")
        chunks.append((media[p + 4 : p + 8], p + 8, n))
        p += 12 + n
    if chunks[0][2] != 13:
        raise ValueError("no header")
    width, height, depth, colour, *method, laced = struct.unpack_from(">IIBBBBB", media, chunks[0][1])
    if not width or not height or depth not in PNG_DEPTHS.get(colour, ()) or any(method) or laced > 1:
        raise ValueError("no such image")
    bits = depth * PNG_SAMPLES[colour]
    sizes = [(width, height)]
    if laced:
        sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in PNG_PASSES if width > x and height > y]
    more, held = _inflated(media[at : at + n] for kind, at, n in chunks if kind == b"IDAT"), b""
    for w, left in sizes:
        line = (w * bits + 7) // 8 + 1
        above = np.zeros(line - 1, np.uint8)
        while left:
            parts, size = [held], len(held)
            while size < line:
                part = next(more, None)
                if part is None:
                    raise ValueError("too few lines")
                parts.append(part)
                size += len(part)
            held = b"".join(parts)
            n = min(left, size // line)
            lines = np.frombuffer(held, np.uint8, n * line).reshape(n, line)
            held, left = held[n * line :], left - n
            if lines[:, 0].max() > 4:
                raise ValueError("no such filter")
            if filtered or not lines[:, 0].any():
                yield lines[:, 1:].tobytes()
                above = lines[-1, 1:]
                continue
            for x in lines:
                above = _unfiltered(int(x[0]), x[1:], above, max(bits // 8, 1))
                yield above.tobytes()
    if held or any(more):
        raise ValueError("too many lines")


def samples_of(media: bytes, kind: str) -> Iterator[bytes]:
    """The samples of media that the format's validator accepts, in parts, as their bytes stand in the format.

    A WAV's data chunk; a BMP's lines from the top, without padding; a PNG's unfiltered lines. Other types give none.
    """
    if kind == "wav":
        p = 12
        while media[p : p + 4] != b"data":
            n = int.from_bytes(media[p + 4 : p + 8], "little")
            p += 8 + n + (n & 1)
        yield media[p + 8 : p + 8 + int.from_bytes(media[p + 4 : p + 8], "little")]
    elif kind == "bmp":
        start, width, height = int.from_bytes(media[10:14], "little"), *struct.unpack_from("<ii", media, 18)
        lines = np.frombuffer(media, np.uint8, offset=start).reshape(abs(height), -1)[:, : 3 * width] if height else np.zeros((0, 0), np.uint8)
        yield (lines[::-1] if height > 0 else lines).tobytes()
    elif kind == "png":
        yield from _png_lines(media)


def payload_of(media: bytes, kind: str) -> bytes:
    """All samples of valid media (:func:`samples_of`); of media made by :func:`to_media` the payload."""
    return b"".join(samples_of(media, kind))


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as media in the shared folder, and give the stored table.

    The UTF-8 bytes (null: none) are padded with spaces to a positive multiple of 192 and become samples of a format
    that their crc32 picks. A quarter stands behind a foreign preamble, as when a crawler keeps headers, and a fifth
    declares a wrong type; both depend on the bytes alone, so equal texts are stored alike. Columns: ``doc_id``,
    ``n_bytes``, ``declared``, ``media``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for rows in byte_slices(batch, 1):
                sizes, declared, media = [], [], []
                for b in as_bytes(rows.column(1)):
                    payload = b + b" " * (-len(b) % UNIT or (0 if b else UNIT))
                    crc = zlib.crc32(payload)
                    m = to_media(payload, KINDS[crc % 3])
                    sizes.append(len(b))
                    declared.append(KINDS[(crc + 1 if crc // 3 % 5 == 0 else crc) % 3])
                    media.append(b"Content-Length: %d\r\n\r\n" % len(m) + m if crc // 15 % 4 == 0 else m)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary"), "media")


SNIFFED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, actual string, carved_at long, n_media int"


def sniff_media(table: DataFrame) -> DataFrame:
    """Read stored media back: correct their declared type, carve what is embedded, and compute features of the samples.

    ``actual`` is the type of the first valid media found, ``carved_at`` its offset, ``n_media`` how many a blob holds.
    ``payload_*`` are its samples (none, and the empty digest, for a blob without media and for GIF and JPEG), ``media_*``
    the whole stored blob. Any valid PNG, WAV or 24-bit BMP will do; what its own format's reader cannot read to the end
    (broken deflate data, too few lines) is no media. ``feature`` names type, mean, spread and most frequent sample. Null media count as empty blobs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sniffer, names = Sniffer(), [c.split()[0] for c in SNIFFED.split(", ")]
        for batch in (part for whole in batches for part in byte_slices(whole, 3)):
            out: dict[str, list] = {k: [] for k in names[2:8] + names[9:]}
            for blob in as_bytes(batch.column(3)):
                found = sniffer.find(blob)
                at, n, kind = found[0] if found else (None, 0, None)
                count, sha, size, tail = np.zeros(256, np.int64), hashlib.sha256(), 0, b""
                for part in samples_of(blob[at : at + n], kind) if kind in KINDS else ():
                    count += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
                    sha.update(part)
                    size, tail = size + len(part), (tail + part)[-16:]
                total, square = int(count @ np.arange(256)), int(count @ np.arange(256) ** 2)
                mean = total * 1000 // max(size, 1)
                spread = square * 1000 // max(size, 1) - mean * mean // 1000
                values = (size, sha.hexdigest(), zlib.crc32(tail), len(blob), hashlib.sha256(blob).hexdigest(), f"{kind}:mean={mean}:var={spread}:mode={int(count.argmax())}:rows={size // UNIT}", kind, at, len(found))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            cols = [batch.column(0), batch.column(1), *(pa.array(out[k], t) for k, t in zip(names[2:8], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), batch.column(2), *(pa.array(out[k], t) for k, t in zip(names[9:], (pa.string(), pa.int64(), pa.int32()), strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return table.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, SNIFFED)
