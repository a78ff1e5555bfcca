"""Literal genomic ranges: chr1:1500, chr1:1000-2000, chr1:[1000,2000), chr1:[1000,2000]:+ ."""

from __future__ import annotations

from dataclasses import dataclass

# Messages that users of the dialect match on.
BAD_FORMAT = "Invalid genomic range format: {}"
BAD_ORDER = "Start must be less than end: {}"

#: Whether the end belongs to the range, by the bracket that closes it.
_CLOSED = {")": 0, "]": 1}


@dataclass(frozen=True)
class Range:
    """A range in canonical form: 0-based, half-open."""

    chrom: str
    start: int
    end: int
    strand: str | None = None

    @property
    def is_point(self) -> bool:
        return self.end == self.start + 1


class _Scanner:
    """Reads a literal from left to right; what doesn't fit raises ValueError."""

    def __init__(self, text: str):
        self.text, self.rest = text, text.strip().strip("'\"").strip()

    def fail(self) -> ValueError:
        return ValueError(BAD_FORMAT.format(self.text))

    def take(self, wanted: str) -> bool:
        """Whether the given mark comes next; it is passed."""
        hit = self.rest.startswith(wanted)
        self.rest = self.rest[len(wanted) :] if hit else self.rest
        return hit

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise self.fail()

    def number(self) -> int:
        digits = len(self.rest) - len(self.rest.lstrip("0123456789"))
        if not digits:
            raise self.fail()
        out, self.rest = int(self.rest[:digits]), self.rest[digits:]
        return out

    def name(self) -> str:
        out, colon, self.rest = self.rest.partition(":")
        if not colon or not out or not all(c.isalnum() or c in "_." for c in out):
            raise self.fail()
        return out

    def strand(self) -> str | None:
        if not self.rest:
            return None
        self.need(":")
        out, self.rest = self.rest, ""
        if out not in ("+", "-"):
            raise self.fail()
        return out


def parse_range(text: str) -> Range:
    """Reads a literal. Raises ValueError for anything else and for ranges whose start isn't below their end."""
    scan = _Scanner(text)
    chrom, closed = scan.name(), 0
    if scan.take("["):
        start = scan.number()
        scan.need(",")
        end = scan.number()
        bracket = scan.rest[:1]
        if bracket not in _CLOSED:
            raise scan.fail()
        scan.need(bracket)
        closed = _CLOSED[bracket]
    else:
        start = scan.number()
        if not scan.rest:
            return Range(chrom, start, start + 1)
        scan.need("-")
        end = scan.number()
    strand = scan.strand()
    if start >= end:
        raise ValueError(BAD_ORDER.format(text))
    return Range(chrom, start, end + closed, strand)
