"""Bytes received out of order."""

MOST_RANGES = 16


class Ranges:
    """Sorted disjoint ranges of bytes that have arrived; what comes first stays."""

    def __init__(self) -> None:
        self.data = bytearray()
        self.spans: list[tuple[int, int]] = []

    def write(self, start: int, piece: bytes) -> bool:
        """Put bytes at an offset; whether they disagree with what is there."""
        end = start + len(piece)
        if end > len(self.data):
            self.data.extend(bytes(end - len(self.data)))
        conflict, at = False, start
        for a, b in self.spans:
            low, high = max(a, start), min(b, end)
            if low < high:
                conflict |= self.data[low:high] != piece[low - start : high - start]
                if at < low:
                    self.data[at:low] = piece[at - start : low - start]
                at = max(at, high)
        if at < end:
            self.data[at:end] = piece[at - start :]
        self.spans = merged([*self.spans, (start, end)])
        return conflict

    def contiguous(self) -> int:
        """Bytes from the start without a gap."""
        return self.spans[0][1] if self.spans and self.spans[0][0] == 0 else 0

    def shift(self, by: int) -> None:
        """Move everything ``by`` bytes further from the start."""
        self.data[:0] = bytes(by)
        self.spans = [(a + by, b + by) for a, b in self.spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
