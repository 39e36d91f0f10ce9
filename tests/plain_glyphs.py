"""Tables from positioned text in plain Python: what the joins and windows of ``pennybrook.sources.glyphs`` are held against."""

from __future__ import annotations

import re
from dataclasses import dataclass
from statistics import median

from pennybrook.operators.lexicon import HEADER_KEYWORDS
from pennybrook.sources.glyphs import COLUMN_GAP, MAX_PAGES, MIN_HEADER_WORDS, ROW_TOLERANCE, TABLE_GAP

from .plain_containers import find_header

FAR = float("inf")


@dataclass
class Run:
    text: str
    x: float
    y: float
    width: float

    @property
    def right(self) -> float:
        return self.x + max(self.width, 0.0)


def is_cjk(c: str) -> bool:
    return 0x2E80 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF or 0xFF00 <= ord(c) <= 0xFFEF


def join_text(a: str, b: str) -> str:
    if not a or not b:
        return a or b
    return a + b if is_cjk(a[-1]) or is_cjk(b[0]) else f"{a} {b}"


def lines_of(runs: list[Run], tolerance: float = ROW_TOLERANCE) -> list[list[Run]]:
    """Visual lines from the top; a line's anchor is its first baseline."""
    out: list[list[Run]] = []
    for r in sorted((r for r in runs if r.text.strip()), key=lambda r: (-r.y, r.x)):
        if out and abs(r.y - out[-1][0].y) <= tolerance:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def header_line(lines: list[list[Run]]) -> int:
    hits = [sum(w in t for w in HEADER_KEYWORDS) for t in (" ".join(r.text for r in sorted(x, key=lambda r: r.x)) for x in lines)]
    best = max(range(len(hits)), key=lambda i: (hits[i], -i), default=-1)
    return best if best >= 0 and hits[best] >= MIN_HEADER_WORDS else -1


def columns_of(line: list[Run], gap: float = COLUMN_GAP) -> list[tuple[float, float]] | None:
    """A partition of the page at the middles between header cells."""
    cells: list[list[float]] = []
    for r in sorted(line, key=lambda r: r.x):
        if cells and r.x - cells[-1][1] <= gap:
            cells[-1][1] = max(cells[-1][1], r.right)
        else:
            cells.append([r.x, r.right])
    if len(cells) < 2:
        return None
    cuts = [-FAR, *((a[1] + b[0]) / 2 for a, b in zip(cells, cells[1:])), FAR]
    return list(zip(cuts, cuts[1:]))


def overlap(a: Run, span: tuple[float, float]) -> float:
    return min(a.right, span[1]) - max(a.x, span[0])


def column_for(r: Run, spans: list[tuple[float, float]]) -> int:
    """The column that a run overlaps most, the leftmost on ties."""
    return max(range(len(spans)), key=lambda i: (overlap(r, spans[i]), -i))


def split_run(r: Run, spans: list[tuple[float, float]]) -> list[Run]:
    """A run across several columns, cut at its blanks; widths by characters, CJK ones count double."""
    words = list(re.finditer(r"\S+", r.text))
    if r.width <= 0 or len(words) < 2 or sum(overlap(r, s) > 0 for s in spans) < 2:
        return [r]
    weight = [0]
    for c in r.text:
        weight.append(weight[-1] + (2 if is_cjk(c) else 1) * (2 if ord(c) > 0xFFFF else 1))
    unit = r.width / weight[-1]
    return [Run(w[0], r.x + weight[w.start()] * unit, r.y, (weight[w.end()] - weight[w.start()]) * unit) for w in words]


def cells_of(line: list[Run], spans: list[tuple[float, float]]) -> list[str]:
    out = [""] * len(spans)
    for r in sorted((p for r in line for p in split_run(r, spans)), key=lambda r: r.x):
        i = column_for(r, spans)
        out[i] = join_text(out[i], r.text.strip())
    return ["" if re.fullmatch("[-\u2010-\u2015\u2212]+", c.strip()) else c.strip() for c in out]


def row_pitch(ys: list[float], rowlike: list[bool]) -> float | None:
    at = [y for y, k in zip(ys, rowlike) if k]
    return median(a - b for a, b in zip(at, at[1:])) if len(at) > 1 else None


def rows_by_columns(lines: list[list[Run]], spans: list[tuple[float, float]], header: int) -> list[list[str]]:
    band = lines[max(header, 0) :]
    cells, ys = [cells_of(x, spans) for x in band], [x[0].y for x in band]
    pitch = row_pitch(ys, [c[0] != "" and sum(v != "" for v in c) >= 2 for c in cells])
    end = len(band)
    if pitch is not None:
        far = next((i for i in range(1, len(band)) if ys[i - 1] - ys[i] > TABLE_GAP * pitch), len(band))
        end = far if far > 1 else len(band)
    out: list[list[str]] = []
    for i in range(end):
        if cells[i][0] or not out:
            out.append(cells[i])
        elif pitch is None or ys[i - 1] - ys[i] < pitch:
            out[-1] = [join_text(a, b) for a, b in zip(out[-1], cells[i])]
    return out


def rows_by_gaps(lines: list[list[Run]], gap: float = COLUMN_GAP) -> list[list[str]]:
    out = []
    for line in lines:
        cells: list[str] = []
        last: Run | None = None
        for r in sorted(line, key=lambda r: r.x):
            if last is None or r.x - last.right > gap:
                cells.append(r.text)
            else:
                cells[-1] = join_text(cells[-1], r.text)
            last = r
        if any(c.strip() for c in cells):
            out.append([c.strip() for c in cells])
    return out


def without_repeated_headers(rows: list[list[str]]) -> list[list[str]]:
    at = find_header(rows)
    same = lambda r: [c.strip() for c in r] == [c.strip() for c in rows[at]]
    return rows if at < 0 else [r for i, r in enumerate(rows) if i == at or not same(r)]


@dataclass
class Rebuilt:
    rows: list[list[str]]
    consistency: float
    anchored: bool
    columns: int


def rebuild(pages: dict[int, list[Run]]) -> Rebuilt:
    """All pages of a file, in order; at most MAX_PAGES, as the limit is part of the result."""
    spans, rows, width = None, [], 0
    for page in sorted(pages)[:MAX_PAGES]:
        lines = lines_of(pages[page])
        header = header_line(lines)
        spans = (columns_of(lines[header]) if header >= 0 else None) or spans
        if lines:
            rows += rows_by_columns(lines, spans, header) if spans else rows_by_gaps(lines)
        width = max(width, len(spans or ()))
    rows = without_repeated_headers(rows)
    sizes = [len(r) for r in rows]
    return Rebuilt(rows, max((sizes.count(s) for s in set(sizes)), default=0) / len(rows) if rows else 0.0, spans is not None, width)
