"""GIF files: an encoder for 8-bit samples, and a decoder for LZW streams, palettes, disposal and transparency.

Format: public GIF89a specification.  Code widths depend on the number of codes since the last clear code alone, so the
bits of a whole run between clear codes are packed and unpacked with numpy; only the dictionary is walked in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 64
#: Rows of a frame of a stored payload: 256 KB; longer payloads take several frames.
ROWS = 4096
#: Hundredths of a second that a stored frame stays.
DELAY = 10
#: A screen or frame of so many pixels is taken whatever the length of its stream.
SMALL = 1 << 20


def _widths(n: int, least: int, late: int) -> np.ndarray:
    """Bits of the n codes after a clear code.  ``late`` is 1 where the reader's dictionary is one entry behind."""
    entries = (1 << (least - 1)) + 2 + np.maximum(np.arange(n) - late, 0)
    return np.minimum(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, 12).clip(least, 12)


#: Codes between clear codes at most, for 8-bit samples: the dictionary is then full.
RUN = 4096 - 258
_RUN_WIDTHS = _widths(RUN + 2, 9, 1)
_RUN_STARTS = np.cumsum(_RUN_WIDTHS) - _RUN_WIDTHS
#: Where the dictionary is full, codes keep 12 bits; they are read 2048 at once.
_FULL_WIDTHS = np.full(2048, 12)
_FULL_STARTS = np.arange(2048) * 12


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes, least bit first, as bytes.  A code touches three bytes at most, and no two codes a bit, so bytes are sums."""
    ends = np.cumsum(widths)
    starts = ends - widths
    first, value = starts >> 3, codes << (starts & 7)
    n = (int(ends[-1]) + 7 >> 3) + 2
    total = sum(np.bincount(first + i, weights=value >> 8 * i & 255, minlength=n) for i in range(3))
    return total[: n - 2].astype(np.uint8).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """The LZW stream of 8-bit samples: a clear code, runs that fill the dictionary, an end code."""
    out: list[np.ndarray] = []
    widths: list[np.ndarray] = []
    table: dict[int, int] = {}
    codes: list[int] = []
    add, find = codes.append, table.get
    top = 258
    clear = np.array([256])

    def flush() -> None:
        run = np.array(codes, dtype=np.int64)
        out.extend((clear, run))
        # the clear code itself has the width that the run before it has come to
        widths.extend((np.array([_RUN_WIDTHS[len(out[-3])] if len(out) > 2 else 9]), _RUN_WIDTHS[: len(run)]))

    if data:
        prefix = data[0]
        for c in data[1:]:
            key = prefix << 8 | c
            code = find(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            prefix = c
            if len(codes) >= RUN:
                flush()
                codes.clear()
                table.clear()
                top = 258
            else:
                table[key] = top
                top += 1
        add(prefix)
    flush()
    out.append(np.array([257]))
    widths.append(np.array([_RUN_WIDTHS[len(codes)]]))
    return _pack(np.concatenate(out), np.concatenate(widths))


def lzw_decode(stream: bytes, least: int, size: int) -> bytes:
    """At most ``size`` samples of a GIF's LZW stream with minimum code size ``least``.

    Codes after a full dictionary keep 12 bits; a stream that ends early, or a code that can't be, ends the samples.
    """
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    bits = 8 * len(stream)
    clear, end = 1 << least, (1 << least) + 1
    singles = [bytes((i,)) for i in range(clear)] + [b"", b""]
    table, parts, got, at, last = list(singles), [], 0, 0, b""
    room = 4096 - clear - 2
    fixed = _RUN_WIDTHS if least == 8 else _widths(room + 2, least + 1, 1)
    offsets = _RUN_STARTS if least == 8 else np.cumsum(fixed) - fixed
    count = 0  # codes since the clear code
    while got < size:
        # as many codes as have known widths, at once; those after a clear code are read again
        if count < len(fixed):
            ahead, starts = fixed[count:], offsets[count:] - offsets[count] + at
        else:
            ahead, starts = _FULL_WIDTHS, _FULL_STARTS + at
        fits = int(np.searchsorted(starts + ahead, bits, side="right"))
        if not fits:
            break
        ahead, starts = ahead[:fits], starts[:fits]
        first = starts >> 3
        codes = (raw[first] | raw[first + 1] << 8 | raw[first + 2] << 16) >> (starts & 7) & (1 << ahead) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if len(stop) else fits
        for code in codes[:used].tolist():
            if code < len(table):
                entry = table[code]
                if last and len(table) < 4096:
                    table.append(last + entry[:1])
            elif code == len(table) and last:
                entry = last + last[:1]
                if len(table) < 4096:
                    table.append(entry)
            else:
                return b"".join(parts)[:size]
            parts.append(entry)
            got += len(entry)
            last = entry
        count += used
        at = int(starts[used - 1] + ahead[used - 1]) if used else at
        if len(stop):
            if codes[used] == end:
                break
            at = int(starts[used] + ahead[used])
            table, last, count = list(singles), b"", 0
    return b"".join(parts)[:size]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


_GREY = bytes(c for i in range(256) for c in (i, i, i))


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """``payload`` (a positive multiple of ``width`` bytes) as a grey-scale GIF; each frame holds up to ``rows`` rows."""
    height = min(rows, len(payload) // width)
    word = lambda v: int(v).to_bytes(2, "little")
    out = [b"GIF89a", word(width), word(height), b"\xf7\0\0", _GREY]
    for i in range(0, len(payload), width * rows):
        part = payload[i : i + width * rows]
        # keep the frame; no transparent colour
        out += [b"\x21\xf9\x04\x04", word(delay), b"\0\0", b"\x2c\0\0\0\0", word(width), word(len(part) // width), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """A frame as stored and as shown."""

    left: int
    top: int
    samples: np.ndarray  # palette indices, rows by columns
    delay: int
    disposal: int
    transparent: int | None
    shown: np.ndarray | None  # rows by columns by (red, green, blue, alpha)


def _fillable(bits: int, least: int) -> int:
    """The samples that a stream of so many bits can hold at most: a code of least + 1 bits or more stands for 3838 at most."""
    return max(SMALL, bits // (least + 1) * 3838)


def _interlaced(rows: int) -> np.ndarray:
    """The order in which an interlaced image stores its rows."""
    return np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, shown: bool = True) -> list[Frame]:
    """The frames of a GIF.  With ``shown``, each is composed on the canvas under the rules of disposal: 2 clears the
    frame's area before the next one, 3 brings back what was there; transparent samples leave the canvas as it is.

    A file that breaks off gives the frames before the break; samples that are missing are 0.  A frame or screen larger than
    what its bytes can fill (and than ``SMALL`` pixels) is a break, so memory follows the file and not its header.  What isn't
    a GIF raises ValueError.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    word = lambda i: int.from_bytes(data[i : i + 2], "little")
    width, height, flags = word(6), word(8), data[10]
    at, palette = 13, None

    def colours(i: int, flag: int) -> tuple[np.ndarray, int]:
        n = 2 << (flag & 7)
        table = np.frombuffer(data[i : i + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        return np.vstack((table, np.zeros((256 - n, 3), np.uint8))), i + 3 * n

    if flags & 0x80:
        palette, at = colours(at, flags)
    if width * height > _fillable(8 * len(data), 2):
        raise ValueError("a screen larger than the file can fill")
    canvas = np.zeros((height, width, 4) if shown else (0, 0, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None

    def chunks(i: int) -> tuple[bytes, int]:
        parts = []
        while i < len(data) and data[i]:
            parts.append(data[i + 1 : i + 1 + data[i]])
            i += 1 + data[i]
        return b"".join(parts), i + 1

    while at < len(data):
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = chunks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, own = word(at + 1), word(at + 3), word(at + 5), word(at + 7), data[at + 9]
            at += 10
            table = palette if palette is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
            if own & 0x80:
                table, at = colours(at, own)
            if at >= len(data):
                break
            least = data[at]
            stream, at = chunks(at + 1)
            if w * h > _fillable(8 * len(stream), max(least, 1)):
                break
            samples = np.zeros(w * h, np.uint8)
            got = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8) if 1 <= least <= 8 else samples[:0]
            samples[: len(got)] = got
            samples = samples.reshape(h, w)
            if own & 0x40:
                turned = np.empty_like(samples)
                turned[_interlaced(h)] = samples
                samples = turned
            picture = None
            if shown:
                before = canvas.copy() if disposal == 3 else None
                area = canvas[top : top + h, left : left + w]
                part = samples[: area.shape[0], : area.shape[1]]
                colour = np.column_stack((table, np.full(256, 255, np.uint8)))
                if transparent is None:
                    area[...] = colour.take(part, axis=0)
                else:
                    seen = part != transparent
                    area[seen] = colour[part[seen]]
                picture = canvas.copy()
                if disposal == 2:
                    area[...] = 0
                elif before is not None:
                    canvas = before
            frames.append(Frame(left, top, samples, delay, disposal, transparent, picture))
            delay, disposal, transparent = 0, 0, None
        else:
            break
    return frames


def histogram(shown: np.ndarray) -> np.ndarray:
    """Visible pixels by colour: 4 levels of each of red, green and blue, 64 counts."""
    flat = shown.reshape(-1, 4)
    code = flat[:, 0] >> 2 & 48 | flat[:, 1] >> 4 & 12 | flat[:, 2] >> 6
    visible = flat[:, 3] > 0
    return np.bincount(code if visible.all() else code[visible], minlength=64)
