import pytest

from locusloom.ranges import Range, parse_range
from locusloom.schema import IntervalSchema


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("chr1:1500", Range("chr1", 1500, 1501)),
        (" 'chr1:1000-2000' ", Range("chr1", 1000, 2000)),
        ("chr1:1000-2000:-", Range("chr1", 1000, 2000, "-")),
        ("chr1:[1000,2000)", Range("chr1", 1000, 2000)),
        ("chr1:[1000,2000]:+", Range("chr1", 1000, 2001, "+")),
        ("scaffold_1.2:[0,1)", Range("scaffold_1.2", 0, 1)),
    ],
)
def test_forms(text, expected):
    assert parse_range(text) == expected


@pytest.mark.parametrize("text", ["chr1", "chr1:", "chr1:5-", "chr1:(5,7)", "chr-1:5-7", "chr1:5:+"])
def test_malformed(text):
    with pytest.raises(ValueError, match="Invalid genomic range format"):
        parse_range(text)


@pytest.mark.parametrize("text", ["chr1:7-5", "chr1:[5,5]", "chr1:[5,5)"])
def test_start_below_end(text):
    with pytest.raises(ValueError, match="Start must be less than end"):
        parse_range(text)


def test_schema_checks_its_encoding():
    with pytest.raises(ValueError):
        IntervalSchema(coordinate_system="2based")
    with pytest.raises(ValueError):
        IntervalSchema(interval_type="open")
    assert IntervalSchema(coordinate_system="1based", interval_type="closed").shift == (-1, 0)
