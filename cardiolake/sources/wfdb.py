"""WFDB records: headers, signal formats 8, 16, 24, 32, 61, 80, 160, 212, 310 and 311, and annotation files, by the public format description."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Annotation codes of the format and the symbols that stand for beats.
SYMBOLS = {
    1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q", 14: "~", 16: "|", 18: "s", 19: "T", 20: "*", 21: "D", 22: '"', 23: "=", 24: "p", 25: "B",
    26: "^", 27: "t", 28: "+", 29: "u", 30: "?", 31: "!", 32: "[", 33: "]", 34: "e", 35: "n", 36: "@", 37: "x", 38: "f", 39: "(", 40: ")", 41: "r",
}
BEAT_SYMBOLS = ("N", "L", "R", "A", "a", "J", "S", "V", "E", "j", "F", "/", "f", "Q", "e")


@dataclass(frozen=True)
class WfdbHeader:
    name: str
    fs_hz: float
    n_samples: int
    files: list[str]
    formats: list[int]
    gains: list[float]
    baselines: list[int]
    labels: list[str]
    initial: list[int] = field(default_factory=list)


def _lines(text: str) -> list[str]:
    return [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def segments(text: str) -> list[tuple[str, int]]:
    """(record name, samples) of the segments of a header of several segments, else none."""
    lines = _lines(text)
    first = lines[0].split()[0] if lines else ""
    return [(x.split()[0], int(x.split()[1])) for x in lines[1 : 1 + int(first.split("/")[1])]] if "/" in first else []


def header(text: str) -> WfdbHeader:
    lines = _lines(text)
    if not lines:
        raise ValueError("empty WFDB header")
    first = lines[0].split()
    n = int(first[1])
    fs = float(re.match(r"[0-9.]+", first[2])[0]) if len(first) > 2 else 250.0
    if not fs > 0:
        raise ValueError("the header names no positive sampling rate")
    size = int(first[3]) if len(first) > 3 else 0
    files, formats, gains, baselines, labels, initial = [], [], [], [], [], []
    for line in lines[1 : n + 1]:
        f = line.split(maxsplit=8)
        files.append(f[0])
        formats.append(int(re.match(r"\d+", f[1])[0]))
        gain = re.match(r"([-0-9.eE+]+)(?:\((-?\d+)\))?", f[2]) if len(f) > 2 else None
        gains.append(float(gain[1]) or 200.0 if gain else 200.0)
        zero = int(f[4]) if len(f) > 4 else 0
        baselines.append(int(gain[2]) if gain and gain[2] else zero)
        initial.append(int(f[5]) if len(f) > 5 else zero)
        labels.append(f[8].strip() if len(f) > 8 else "")
    if len(files) != n:
        raise ValueError("the header lists fewer signals than it announces")
    return WfdbHeader(first[0].split("/")[0], fs, size, files, formats, gains, baselines, labels, initial)


def _signed(x: np.ndarray, bits: int) -> np.ndarray:
    """Two's complement of the low ``bits``."""
    x = x & ((1 << bits) - 1)
    return x - ((x >> (bits - 1)) << bits)


def _triples(words: np.ndarray) -> np.ndarray:
    return words[: len(words) // 2 * 2].reshape(-1, 2).astype(np.int64)


#: Numbers and bytes of the smallest part of a signal file that can be decoded alone.
UNITS = {16: (1, 2), 61: (1, 2), 160: (1, 2), 24: (1, 3), 32: (1, 4), 80: (1, 1), 212: (2, 3), 310: (3, 4), 311: (3, 4)}


def span(fmt: int, n_channels: int, start: int, stop: int) -> tuple[int, int, int]:
    """(offset, bytes, numbers to skip) that hold samples [start, stop) of all channels of a file.
    Format 8 stores differences, so it is read from its beginning."""
    if fmt == 8:
        return 0, stop * n_channels, start * n_channels
    if fmt not in UNITS:
        raise ValueError(f"WFDB format {fmt} is not supported")
    numbers, size = UNITS[fmt]
    first, last = start * n_channels // numbers, -(-stop * n_channels // numbers)
    return first * size, (last - first) * size, start * n_channels - first * numbers


def length(fmt: int, n_channels: int, size: int) -> int:
    """Samples a channel of a signal file of ``size`` bytes."""
    numbers, each = UNITS.get(fmt, (1, 1))
    return size // each * numbers // n_channels


def digital(data: bytes, fmt: int, n_channels: int, initial: Sequence[int] = (), skip: int = 0) -> np.ndarray:
    """Digital samples [n, channels] of one signal file, or of the bytes of a ``span``;
    ``initial``: first values for format 8."""
    plain = {16: "<i2", 61: ">i2", 32: "<i4", 160: "<u2"}
    if fmt in plain:
        wide = np.dtype(plain[fmt]).itemsize
        flat = np.frombuffer(data, dtype=plain[fmt], count=len(data) // wide).astype(np.int64) - (32768 if fmt == 160 else 0)
    elif fmt == 8:  # differences between neighbours of a channel
        steps = np.frombuffer(data, dtype=np.int8).astype(np.int64)
        steps = steps[: len(steps) // n_channels * n_channels].reshape(-1, n_channels)
        return (steps.cumsum(axis=0) + np.array(list(initial) or [0] * n_channels))[skip // n_channels :]
    elif fmt == 24:
        b = np.frombuffer(data, dtype=np.uint8, count=len(data) // 3 * 3).astype(np.int64).reshape(-1, 3)
        flat = _signed(b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16, 24)
    elif fmt == 310:  # three 10-bit numbers in two little-endian words, the third in their top bits
        w = _triples(np.frombuffer(data, dtype="<u2", count=len(data) // 2))
        flat = _signed(np.stack([w[:, 0] >> 1, w[:, 1] >> 1, w[:, 0] >> 11 | (w[:, 1] >> 11) << 5], axis=1).ravel(), 10)
    elif fmt == 311:  # three 10-bit numbers in the low 30 bits of a little-endian word
        w = np.frombuffer(data, dtype="<u4", count=len(data) // 4).astype(np.int64)
        flat = _signed(np.stack([w, w >> 10, w >> 20], axis=1).ravel(), 10)
    elif fmt == 80:
        flat = np.frombuffer(data, dtype=np.uint8).astype(np.int32) - 128
    elif fmt == 212:  # two 12-bit numbers in three bytes
        b = np.frombuffer(data, dtype=np.uint8, count=len(data) // 3 * 3).astype(np.int32).reshape(-1, 3)
        pair = np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 2] | (b[:, 1] >> 4) << 8], axis=1).ravel()
        flat = pair - ((pair & 2048) << 1)
    else:
        raise ValueError(f"WFDB format {fmt} is not supported")
    flat = flat[skip:]
    return flat[: len(flat) // n_channels * n_channels].reshape(-1, n_channels)


def samples(h: WfdbHeader, files: dict[str, bytes], physical: bool = True) -> np.ndarray:
    """[n, channels] of the record; files of several signals interleave them."""
    columns: list[np.ndarray] = []
    for name in dict.fromkeys(h.files):
        own = [i for i, f in enumerate(h.files) if f == name]
        if len({h.formats[i] for i in own}) != 1:
            raise ValueError("signals of one file must share a format")
        if name not in files:
            raise ValueError(f"signal file {name} is missing")
        d = digital(files[name], h.formats[own[0]], len(own), [h.initial[i] for i in own] if h.initial else ())
        columns += [d[:, k] for k in range(len(own))]
    n = min(map(len, columns))
    n = min(n, h.n_samples) if h.n_samples else n
    out = np.stack([c[:n] for c in columns], axis=1).astype(float)
    return (out - np.array(h.baselines)) / np.array(h.gains) if physical else out


def annotations(data: bytes) -> list[tuple[int, str, int]]:
    """(sample, symbol, num) of an annotation file."""
    words = np.frombuffer(data, dtype="<u2", count=len(data) // 2).tolist()
    out, at, i, num = [], 0, 0, 0
    while i < len(words):
        code, value = words[i] >> 10, words[i] & 1023
        i += 1
        if code == 0 and value == 0:
            break
        if code == 59:  # long interval: two words, high one first
            step = words[i] << 16 | words[i + 1]
            at += step - (1 << 32) if step >> 31 else step
            i += 2
        elif code == 60:
            num = value - 1024 if value >= 512 else value
            if out:
                out[-1] = (*out[-1][:2], num)
        elif code in (61, 62):
            continue
        elif code == 63:
            i += (value + 1) // 2
        else:
            at += value
            if code in SYMBOLS:
                out.append((at, SYMBOLS[code], num))
    return out


def pack(d: np.ndarray, fmt: int) -> bytes:
    """The inverse of the plain formats 16, 24, 32, 61, 160, 310 and 311 (for tests and export)."""
    flat = d.astype(np.int64).ravel()
    if fmt == 160:
        flat = flat + 32768
    if fmt == 24:
        return np.stack([flat & 255, flat >> 8 & 255, flat >> 16 & 255], axis=1).astype(np.uint8).tobytes()
    if fmt in (310, 311):
        t = np.append(flat, np.zeros(-len(flat) % 3, np.int64)).reshape(-1, 3) & 1023
        if fmt == 311:
            return (t[:, 0] | t[:, 1] << 10 | t[:, 2] << 20).astype("<u4").tobytes()
        return np.stack([t[:, 0] << 1 | (t[:, 2] & 31) << 11, t[:, 1] << 1 | t[:, 2] >> 5 << 11], axis=1).astype("<u2").tobytes()
    return flat.astype({16: "<i2", 61: ">i2", 32: "<i4", 160: "<u2"}[fmt]).tobytes()


def pack_212(d: np.ndarray) -> bytes:
    """The inverse of format 212 (for tests and export)."""
    flat = d.astype(np.int32).ravel() & 4095
    flat = np.append(flat, 0) if len(flat) % 2 else flat
    a, b = flat[0::2], flat[1::2]
    return np.stack([a & 255, (a >> 8) | (b >> 8) << 4, b & 255], axis=1).astype(np.uint8).tobytes()


def pack_annotations(rows: list[tuple[int, str, int]]) -> bytes:
    codes, out, last, num = {s: c for c, s in SYMBOLS.items()}, [], 0, 0
    for at, symbol, n in rows:
        step = at - last
        if step > 1023:
            out += [59 << 10, step >> 16, step & 65535]
            step = 0
        out.append(codes[symbol] << 10 | step)
        if n != num:
            out.append(60 << 10 | n & 1023)
            num = n
        last = at
    return np.array([*out, 0], dtype="<u2").tobytes()
