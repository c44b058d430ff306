"""A stand-in for a REST listing, for trying the paged source without a network."""

from __future__ import annotations


def pages(offset: int) -> tuple[list[tuple[int, str]], int | None]:
    """Two rows a page, three pages."""
    return [(offset + i, f"v{offset + i}") for i in range(2)], offset + 2 if offset < 4 else None


def line_count(argument: str) -> int:
    """Rows of a listing that is a file of lines."""
    with open(argument) as f:
        return sum(1 for _ in f)


def lines(offset: int, argument: str) -> tuple[list[tuple[int, str]], int | None]:
    """Three rows of such a listing at a time: number and line."""
    with open(argument) as f:
        every = f.read().splitlines()
    rows = list(enumerate(every))[offset : offset + 3]
    return rows, offset + len(rows) if offset + len(rows) < len(every) else None
