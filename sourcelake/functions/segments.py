"""Cuts of a source along its symbols: every line belongs to the innermost symbol that covers it, or to the file."""

from __future__ import annotations

import re
from itertools import groupby
from typing import NamedTuple

# They must equal those of the contract.
MAX_SEGMENTS, MAX_RECORDS, MAX_INPUT = 8192, 8192, 64 << 20


class Owner(NamedTuple):
    kind: str
    name: str | None
    qualified_name: str | None
    occurrence: int


class Segment(NamedTuple):
    owner: Owner
    part_index: int
    start_byte: int
    end_byte: int


FILE = Owner("file", None, None, 0)


def owners(symbols: list[dict], lines: int) -> list[Owner]:
    """The owner of each line; of symbols that start alike the shorter one is the inner."""
    out, met = [FILE] * lines, {}
    for s in sorted(symbols, key=lambda s: (s["start_line"], -s["end_line"])):
        key = (s["kind"], s["qualified_name"])
        met[key] = met.get(key, -1) + 1
        first, last = max(s["start_line"], 1), min(s["end_line"], lines)
        out[first - 1 : last] = [Owner(s["kind"], s["name"], s["qualified_name"], met[key])] * max(0, last - first + 1)
    return out


def pieces(data: bytes, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most ``limit`` bytes (of a whole character at least) that end behind a newline where one fits, else between characters."""
    out = []
    while start < end:
        to = min(end, start + limit)
        if to < end:
            newline = data.rfind(b"\n", start, to)
            if newline >= 0:
                to = newline + 1
            else:
                while to > start + 1 and data[to] & 0xC0 == 0x80:
                    to -= 1
                while to < end and data[to] & 0xC0 == 0x80:
                    to += 1
        out.append((start, to))
        start = to
    return out


def segments(data: bytes, symbols: list[dict], limit: int) -> tuple[list[Segment], str | None]:
    """(segments that cover ``data`` in order, a code if a bound made them coarser or none). Empty data has none."""
    if len(data) > MAX_INPUT:
        return [], "index_input_limit"
    lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
    spans, at = [], 0
    for owner, group in groupby(zip(owners(symbols, len(lines)), lines), key=lambda pair: pair[0]):
        size = sum(len(line) for _, line in group)
        spans.append((owner, at, at + size))
        at += size
    code = None
    if len(spans) > MAX_SEGMENTS or sum(len(pieces(data, a, b, limit)) for _, a, b in spans) > MAX_RECORDS:
        spans, code = [(FILE, 0, len(data))], "index_structure_budget"
    out, parts = [], {}
    for owner, a, b in spans:
        for start, end in pieces(data, a, b, limit):
            out.append(Segment(owner, parts.get(owner, 0), start, end))
            parts[owner] = parts.get(owner, 0) + 1
    return (out, code) if len(out) <= MAX_RECORDS else ([], "index_record_budget")
