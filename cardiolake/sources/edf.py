"""EDF and EDF+C files: header and samples from bytes, by the public format description."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class EdfHeader:
    labels: list[str]
    units: list[str]
    per_record: list[int]
    gain: list[float]
    offset: list[float]
    n_records: int
    record_s: float
    header_bytes: int
    subtype: str

    @property
    def signals(self) -> list[int]:
        """Numbers of the ordinary signals (annotation channels left out)."""
        return [i for i, name in enumerate(self.labels) if name != "EDF Annotations"]

    @property
    def fs_hz(self) -> float:
        rates = {self.per_record[i] / self.record_s for i in self.signals}
        if len(rates) != 1:
            raise ValueError("EDF channels must share one sampling rate")
        return rates.pop()

    @property
    def n_samples(self) -> int:
        return min(self.per_record[i] for i in self.signals) * self.n_records


def header(data: bytes, size: int | None = None) -> EdfHeader:
    """Facts of the header; ``size``: bytes of the whole file where ``data`` is its front only."""
    size = len(data) if size is None else size
    if len(data) < 256 or data[:8].strip() != b"0":
        raise ValueError("not an EDF file")
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    n = int(text(252, 4))
    if n < 1 or len(data) < 256 * (n + 1):
        raise ValueError("EDF header is incomplete")
    at, fields = 256, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        fields[name] = [text(at + i * width, width) for i in range(n)]
        at += n * width
    numbers = {k: [float(v or 0) for v in fields[k]] for k in ("pmin", "pmax", "dmin", "dmax")}
    gain = [(b - a) / (d - c) if d != c else 1.0 for a, b, c, d in zip(*(numbers[k] for k in ("pmin", "pmax", "dmin", "dmax")))]
    offset = [a - g * c for a, g, c in zip(numbers["pmin"], gain, numbers["dmin"])]
    per_record, head, record_s = [int(v) for v in fields["samples"]], int(text(184, 8)), float(text(244, 8))
    n_records = int(text(236, 8))
    if n_records < 0:
        n_records = (size - head) // (2 * sum(per_record))
    return EdfHeader(fields["label"], fields["unit"], per_record, gain, offset, n_records, record_s, head, text(192, 44))


def span(h: EdfHeader, start: int, stop: int) -> tuple[int, int]:
    """(offset, bytes) of the data records that hold samples [start, stop)."""
    width, each = 2 * sum(h.per_record), h.per_record[h.signals[0]]
    first, last = start // each, -(-stop // each)
    return h.header_bytes + width * first, width * max(last - first, 0)


def values(h: EdfHeader, records: bytes, start: int, stop: int) -> list[np.ndarray]:
    """Physical values of the ordinary signals in [start, stop) from the records of ``span``."""
    if h.subtype.startswith("EDF+D"):
        raise ValueError("discontinuous EDF+ is not supported")
    raw = np.frombuffer(records, dtype="<i2").reshape(-1, sum(h.per_record))
    edges, skip = np.cumsum([0, *h.per_record]), start - start // h.per_record[h.signals[0]] * h.per_record[h.signals[0]]
    return [raw[:, edges[i] : edges[i + 1]].ravel()[skip : skip + stop - start] * h.gain[i] + h.offset[i] for i in h.signals]


def samples(data: bytes, start: int = 0, stop: int | None = None) -> tuple[EdfHeader, list[np.ndarray]]:
    """Physical values of the ordinary signals in [start, stop), clipped to the file; whole records are decoded only where needed."""
    h = header(data)
    stop = h.n_samples if stop is None else min(stop, h.n_samples)
    offset, size = span(h, start, stop)
    return h, values(h, data[offset : offset + size], start, max(start, stop))


def write(labels: list[str], values: list[np.ndarray], fs_hz: int, unit: str = "mV", limits: tuple[float, float] | None = None) -> bytes:
    """A one-second-record EDF file (for tests and export); ``limits`` are the physical
    values of the least and largest digital one, by default those of each signal."""
    n, records = len(labels), -(-len(values[0]) // fs_hz)
    low = [float(min(v.min(), -1e-3)) for v in values]
    high = [float(max(v.max(), 1e-3)) for v in values]
    pad = lambda v, k: f"{v}"[:k].ljust(k).encode("latin-1")
    low, high = [float(f"{v:.5g}"[:8]) - 1e-2 for v in low], [float(f"{v:.5g}"[:8]) + 1e-2 for v in high]
    low, high = [float(f"{v:.4f}"[:8]) for v in low], [float(f"{v:.4f}"[:8]) for v in high]
    if limits is not None:
        low, high = [float(limits[0])] * n, [float(limits[1])] * n
    head = pad(0, 8) + pad("X", 80) + pad("X", 80) + pad("01.01.00", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(1, 8) + pad(n, 4)
    for items, k in ((labels, 16), ([""] * n, 80), ([unit] * n, 8), (low, 8), (high, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([fs_hz] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(v, k) for v in items)
    block = np.zeros((records, n, fs_hz), dtype="<i2")
    for i, v in enumerate(values):
        digital = np.round((np.pad(v, (0, records * fs_hz - len(v)), mode="edge") - low[i]) / (high[i] - low[i]) * 65535 - 32768)
        block[:, i] = digital.reshape(records, fs_hz)
    return head + block.tobytes()
