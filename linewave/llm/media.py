"""Media columns in the Ogg container: write, verify, demultiplex and time logical streams (operator 3).

A media value is one physical Ogg bitstream of two multiplexed logical streams:

* ``audio``: 8-bit unsigned mono samples at 8 kHz. The first packet is a 28-byte header (the magic
  ``PCM     ``, version, format, rate, bits, channels), the others hold up to 4,096 samples. An audio page's granule
  position is the number of samples that end on or before it.
* ``text``: one packet of comments (``n_bytes=...``), whose granule position is 0.

Reading walks the pages: the capture pattern, the version, the page checksum and the sequence numbers
are verified, packets are put together from the lacing values (also across pages), streams are told apart by
their serial number, and times follow from the granule positions. Any damage raises ``OggError``, and so does a sound
bitstream whose streams are none of these two.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewave.llm.common import slices
from linewave.storage import written

RATE = 8000
PACKET = 4096
BLOCK = 64
#: Header type flags of a page.
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct(">8sHHIIBB6x")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A bitstream that breaks the container's rules."""


def page_checksum(page: bytes) -> int:
    """CRC-32 of the container (polynomial 04c11db7, bits not mirrored, no inversion), its field taken as 0.

    The library's CRC uses the same polynomial on mirrored bits, so the bytes are mirrored first and the
    result is mirrored back.
    """
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return b"".join((head[:22], struct.pack("<I", crc), head[26:], lacing, body))


def _paged(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one logical stream; the first packet stands alone on its page."""
    lacing, body, number, granule, fresh = bytearray(), [], 0, -1, True
    for i, (packet, position) in enumerate(packets):
        values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        at, used = 0, 0
        while at < len(values):
            take = min(255 - len(lacing), len(values) - at)
            part = values[at : at + take]
            size = sum(part)
            lacing += part
            body.append(packet[used : used + size])
            used, at = used + size, at + take
            done = at == len(values)
            if done:
                granule = position
            last = done and i == len(packets) - 1
            if len(lacing) == 255 or last or (done and i == 0):
                yield _page((0 if fresh else CONTINUED) | (FIRST if number == 0 else 0) | (LAST if last else 0), granule, serial, number, bytes(lacing), b"".join(body))
                lacing, body, number, granule, fresh = bytearray(), [], number + 1, -1, done


def payload_of(data: bytes) -> bytes:
    """``data`` with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def write_ogg(data: bytes) -> bytes:
    """The media form of ``data``: its padded payload as samples, its length as a comment."""
    payload = payload_of(data)
    serial = zlib.crc32(payload)
    audio = [(_PCM.pack(b"PCM     ", 1, 1, RATE, 8, 1, 0), 0)]
    audio += [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    text = [(b"text    ", 0), (f"n_bytes={len(data)}".encode(), 0)]
    first, second = list(_paged(audio, serial)), list(_paged(text, serial ^ 0xFFFFFFFF))
    # First pages stand before all others; then the streams alternate as far as they go.
    rest = [p for i in range(max(len(first), len(second))) for s in (second, first) if 0 < i < len(s) for p in (s[i],)]
    return b"".join([first[0], second[0], *rest])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(kind, granule, serial, number, lacing, body) of each page, its checksum verified."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise OggError(f"a page header is cut off at byte {at}")
        magic, version, kind, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page begins at byte {at}")
        lacing = media[at + _HEAD.size : at + _HEAD.size + segments]
        end = at + _HEAD.size + segments + sum(lacing)
        if len(lacing) < segments or end > len(media):
            raise OggError(f"the page at byte {at} is cut off")
        if page_checksum(b"".join((view[at : at + 22], bytes(4), view[at + 26 : end]))) != crc:
            raise OggError(f"the checksum of the page at byte {at} is wrong")
        yield kind, granule, serial, number, lacing, view[at + _HEAD.size + segments : end]
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int, int]]]:
    """Serial number -> packets (bytes, granule position of its page, page number) of each logical stream."""
    packets: dict[int, list[tuple[bytes, int, int]]] = {}
    parts: dict[int, list] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    for kind, granule, serial, number, lacing, body in read_pages(media):
        if bool(kind & FIRST) != (serial not in packets):
            raise OggError(f"stream {serial} does not begin with its first page")
        if serial in ended or number != numbers.get(serial, -1) + 1:
            raise OggError(f"page {number} of stream {serial} is out of sequence")
        held = parts.setdefault(serial, [])
        if bool(kind & CONTINUED) != bool(held):
            raise OggError(f"page {number} of stream {serial} continues no packet")
        numbers[serial] = number
        out, at, size = packets.setdefault(serial, []), 0, 0
        for value in lacing:
            size += value
            if value < 255:  # a packet ends here
                held.append(body[at : at + size])
                out.append((b"".join(held), granule, number))
                held.clear()
                at, size = at + size, 0
        if size or (lacing and lacing[-1] == 255):
            held.append(body[at:])
        if kind & LAST:
            ended.add(serial)
    if missing := set(packets) - ended:
        raise OggError(f"streams without a last page: {sorted(missing)}")
    if any(parts.values()):
        raise OggError("a packet does not end")
    return packets


def read_ogg(media: bytes) -> tuple[bytes, int, list[tuple[int, float]]]:
    """(payload, n_bytes, timeline) of a media value; timeline: samples and seconds after each audio page."""
    audio = text = None
    for packets in demultiplex(media).values():
        if packets and packets[0][0][:8] == b"PCM     ":
            audio = packets
        elif packets and packets[0][0] == b"text    ":
            text = packets
    if audio is None or text is None:
        raise OggError("the audio or the text stream is missing")
    if len(audio[0][0]) != _PCM.size:
        raise OggError(f"an audio header of {len(audio[0][0])} bytes")
    _, _, _, rate, bits, channels, _ = _PCM.unpack(audio[0][0])
    if bits != 8 or channels != 1 or not rate:
        raise OggError(f"{bits} bits, {channels} channels, {rate} samples a second")
    payload = b"".join(p for p, _, _ in audio[1:])
    pages = dict((number, granule) for _, granule, number in audio[1:])
    times = [(g, g / rate) for _, g in sorted(pages.items()) if g >= 0]
    if [g for g, _ in times] != sorted({g for g, _ in times}) or not times or times[-1][0] != len(payload) or not payload:
        raise OggError("granule positions do not fit the samples")
    comments = dict(p.split(b"=", 1) for p, _, _ in text[1:] if b"=" in p)
    length = comments.get(b"n_bytes", b"")
    if not (length.isdigit() and int(length) <= len(payload)):
        raise OggError("the comments name no length of the payload")
    return payload, int(length), times


def features(payload: bytes, times: list[tuple[int, float]]) -> str:
    """Duration, level, zero crossings and the loudest second of the samples, as ``name=value`` pairs."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    total, square, crossings, loud, at = 0, 0, 0, (0, 0), 0
    for lo in range(0, len(samples), RATE):  # a second at a time bounds memory
        part = samples[max(0, lo - 1) : lo + RATE].astype(np.int32) - 128
        own = part[(lo > 0) :]
        power = int((own * own).sum(dtype=np.int64))
        total, square = total + int(own.sum()), square + power
        crossings += int(np.count_nonzero((part[1:] >= 0) != (part[:-1] >= 0)))
        loud, at = max(loud, (power, -at)), at + 1
    n = len(samples)
    return f"seconds={times[-1][1]:.6f};pages={len(times)};mean={total / n:.4f};rms={(square / n) ** 0.5:.4f};crossings={crossings};peak_second={-loud[1]}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        media = [write_ogg((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        rows = []
        for media in batch.column("media").to_pylist():
            payload, n_bytes, times = read_ogg(media)
            rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, times), times[-1][1]))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=DIGEST.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))


DIGEST = "doc_id, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double"


def encode_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes as one Ogg bitstream. A null text counts as empty.

    Rows are kept one to one (repeated ids and empty texts too, an empty table stays empty); other columns
    of ``df`` are left out, so their names cannot clash.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode, "doc_id long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Read (doc_id, media) rows: verify and take apart each bitstream; sums and features of its payload.

    A null ``media`` is left out of the result; a damaged one raises :class:`OggError`.
    """
    return media.where(F.col("media").isNotNull()).mapInArrow(_decode, DIGEST.replace("doc_id,", "doc_id long,"))


def stored_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`encode_media` written to the shared folder and read back."""
    return written(encode_media(df, doc_id, text), "media", compression="zstd")
