"""Elias-Fano sequences: non-decreasing numbers in little more than log2(range / n) + 2 bits each, any of which can be read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: One position of the high bits is kept for so many numbers; between them bits are counted.
SAMPLE = 256
#: Numbers whose low bits are laid out at a time; a multiple of 8.
STEP = 1 << 16


@dataclass
class EliasFano:
    """n numbers. `low` holds the `bits` low bits of each, `high` a one for each after as many zeros as its high part counts up.

    samples[k] is the place in `high` of number k * SAMPLE, in 32 bits.
    """

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: unsigned 64-bit, in ascending order, repeats allowed. Their number and the range's share stay below 2^31."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        ones[places] = 1
        parts = [np.zeros(0, np.uint8)]
        for at in range(0, n, STEP) if bits else ():
            own = values[at : at + STEP, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
            parts.append(np.packbits(own.astype(np.uint8), bitorder="little"))
        return cls(n, bits, np.concatenate(parts), np.packbits(ones, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def select(self, k: int) -> int:
        """Number k: the samples lead near its one in `high`, bits are counted from there."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SAMPLE])
        left, byte = k % SAMPLE, at // 8  # ones still to pass, the sample's own not counted
        left += int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: at % 8].sum())
        while left >= (own := int(self.high[byte]).bit_count()):
            left, byte = left - own, byte + 1
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left])
        return (place - k) << self.bits | self._low(k)

    def _low(self, k: int) -> int:
        first = k * self.bits
        window = int.from_bytes(self.low[first // 8 : (first + self.bits + 7) // 8].tobytes(), "little")
        return window >> first % 8 & (1 << self.bits) - 1

    def values(self) -> np.ndarray:
        """All numbers, as unsigned 64-bit."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)
        for at in range(0, self.n, STEP) if self.bits else ():
            n = min(STEP, self.n - at)
            first = at * self.bits // 8
            own = np.unpackbits(self.low[first : first + (n * self.bits + 7) // 8], bitorder="little", count=n * self.bits).reshape(n, self.bits)
            out[at : at + n] |= (own.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def tobytes(self) -> bytes:
        sizes = np.array([self.n, self.bits, len(self.low), len(self.high), len(self.samples)], "<u8")
        return b"".join((sizes.tobytes(), self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()))

    @classmethod
    def read(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """A sequence that tobytes() wrote at `at`, and where what follows it begins."""
        n, bits, low, high, samples = (int(x) for x in np.frombuffer(data, "<u8", 5, at))
        at += 40
        ends = np.cumsum([at, low, high, 4 * samples]).tolist()
        own = cls(n, bits, np.frombuffer(data, np.uint8, low, ends[0]), np.frombuffer(data, np.uint8, high, ends[1]), np.frombuffer(data, "<u4", samples, ends[2]))
        return own, ends[3]
