"""The numeric work on whole pages, many at a time: glyphs to lines, tables, columns and cells.

The glyphs of all pages of a batch lie end to end in flat arrays, so a step is a few numpy calls for the
batch and no loop over its pages, lines or glyphs. A page is never cut. ``geometry`` puts these steps
into Spark passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyspark.functions import plain

#: Cells of the largest matrix of lines and bins that is made at once; more pages are halved.
MATRIX = 1 << 23


@dataclass
class Glyphs:
    """Glyphs of several pages; ``page`` numbers them from 0 and ascends."""

    page: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray
    ids: np.ndarray
    text: pa.StringArray


@dataclass
class Lines:
    """Printed lines of several pages, top down: each line's glyphs left to right as flat arrays, and
    where they begin, with the end. ``pitch``: the lower median of a line's advances."""

    page: np.ndarray
    row: np.ndarray
    starts: np.ndarray
    x: np.ndarray
    w: np.ndarray
    ids: np.ndarray
    texts: pa.StringArray
    left: np.ndarray
    right: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    pitch: np.ndarray
    text: pa.StringArray

    @property
    def center_y(self) -> np.ndarray:
        return (self.top + self.bottom) / 2


def ordered(*keys: np.ndarray) -> np.ndarray | slice:
    """The order by ``keys``, the first before the others; all as they stand if that is their order."""
    tied = np.ones(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        if (tied & ~(k[:-1] <= k[1:])).any():
            return np.lexsort(keys[::-1])
        tied &= k[:-1] == k[1:]
    return slice(None)


def taken(values: pa.Array, order: np.ndarray | slice) -> pa.Array:
    return values if isinstance(order, slice) else values.take(pa.array(order))


def _begins(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)


def counted_up(groups: np.ndarray) -> np.ndarray:
    """The place of each entry in its run of equal numbers."""
    begins = _begins(groups)
    return np.arange(len(groups)) - np.repeat(begins, _ends(begins, len(groups)) - begins)


def _ends(begins: np.ndarray, n: int) -> np.ndarray:
    return np.append(begins[1:], n).astype(np.int64)


def _spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the half-open spans, one span after the other."""
    n = stops - starts
    return np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _sorted_rows(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each group of ``n`` values in order, as a row of a matrix, filled up with infinity."""
    out = np.full((len(n), int(n.max(initial=0)) + 1), np.inf)
    out[np.repeat(np.arange(len(n)), n), _spans(np.zeros(len(n), np.int64), n)] = values
    out.sort(axis=1)
    return out


def number_rows(g: Glyphs, tolerance: float) -> np.ndarray:
    """The row of every glyph, from 0 on each page, top down: a glyph joins the open row if its bottom
    lies within ``tolerance`` upper-median heights of the mean bottom of the row so far."""
    n = len(g.page)
    begins = _begins(g.page)
    counts = _ends(begins, n) - begins
    middle = g.h[ordered(g.page, g.h)][begins + counts // 2]
    allowed = np.repeat(np.where(middle > 0, middle, 1.0) * tolerance, counts)
    order = ordered(g.page, g.y + g.h, g.ids)
    bottom = (g.y + g.h)[order]
    # the mean of a row lies between its first and its last bottom: a wider step always breaks, and
    # where all of a stretch lies within the tolerance nothing does; only other stretches are followed
    slack = 1e-9 * (np.abs(bottom) + allowed)
    new = np.append(True, ~(np.diff(bottom) <= (allowed + slack)[1:]))
    new[begins] = True
    at = np.flatnonzero(new)
    last = _ends(at, n) - 1
    for k in np.flatnonzero(~(bottom[last] - bottom[at] <= allowed[at] - slack[last])).tolist():
        total, held = 0.0, 0
        for i, own in enumerate(bottom[at[k] : last[k] + 1].tolist(), int(at[k])):
            if held and abs(own - total / held) > allowed[i]:
                new[i], total, held = True, 0.0, 0
            total, held = total + own, held + 1
    number = np.cumsum(new) - 1
    number -= np.repeat(number[begins], counts)
    out = np.empty(n, np.int64)
    out[order] = number
    return out


def read_texts(x: np.ndarray, texts: pa.StringArray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """What ``geometry.glyph_text`` reads of each stretch of glyphs, null of an empty one, and the lower
    median of its advances, 0 if there are none."""
    n = np.diff(starts)
    steps = np.maximum(n - 1, 0)
    at = _spans(starts[:-1], starts[:-1] + steps)  # between glyph k and the next
    advance = x[at + 1] - x[at]
    limit, pitch = np.full(len(n), np.inf), np.zeros(len(n))
    # stretches of like length together, so that a long one does not widen the matrix of all
    begins = np.append(0, np.cumsum(steps))
    size = np.frexp(steps)[1]
    for s in np.unique(size[steps > 0]).tolist():
        own = np.flatnonzero((size == s) & (steps > 0))
        m = steps[own]
        p = _sorted_rows(advance[_spans(begins[own], begins[own] + m)], m)
        low, k = (m - 1) // 2, np.arange(p.shape[1] - 1)
        pitch[own] = p[np.arange(len(own)), low]
        a, b = p[:, :-1], p[:, 1:]
        with np.errstate(all="ignore"):
            jump = (k >= low[:, None]) & (k <= m[:, None] - 2) & (a > 0) & (b > 1.5 * a) & (b / np.where(a > 0, a, 1) > 1.5)
        first, some = jump.argmax(1), np.flatnonzero(jump.any(1))
        limit[own[some]] = (p[some, first[some]] + p[some, first[some] + 1]) / 2
    spaced = at[advance > np.repeat(limit, steps)] + 1
    if texts.null_count:
        spaced = spaced[~texts.is_null().to_numpy(zero_copy_only=False)[spaced]]
    with_spaces = pa.concat_arrays([texts, pa.array([" "], pa.string())])
    with_spaces = with_spaces.take(pa.array(np.insert(np.arange(len(x)), spaced, len(x))))
    ends = np.frombuffer(with_spaces.buffers()[1], np.int32, len(with_spaces) + 1 + with_spaces.offset)[with_spaces.offset :]
    cut = ends[starts + np.searchsorted(spaced, starts)]
    known = pa.py_buffer(np.packbits(n > 0, bitorder="little")) if (n == 0).any() else None
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(np.ascontiguousarray(cut)), with_spaces.buffers()[2] or pa.py_buffer(b""), known), pitch


def read_lines(g: Glyphs, tolerance: float) -> Lines:
    row = number_rows(g, tolerance)
    order = ordered(g.page, row, g.x, g.ids)
    page, row, x, y, w, h, ids = (v[order] for v in (g.page, row, g.x, g.y, g.w, g.h, g.ids))
    texts = taken(g.text, order)
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (page[1:] != page[:-1]))) if len(row) else np.zeros(0, np.int64)
    starts = np.append(at, len(row))
    edge = lambda f, v: f.reduceat(v, at) if len(at) else np.zeros(0)
    text, pitch = read_texts(x, texts, starts)
    return Lines(page[at], row[at], starts, x, w, ids, texts, edge(np.minimum, x), edge(np.maximum, x + w), edge(np.minimum, y), edge(np.maximum, y + h), pitch, text)


def find_boundaries(lines: Lines, own: np.ndarray, bin_width: float, clear: float, min_gap: float, min_pitches: float) -> tuple[np.ndarray, np.ndarray]:
    """Column boundaries from the lines ``own``, which ascend by page: each boundary's page, and the
    boundaries, left to right."""
    none = np.zeros(0, np.int64), np.zeros(0)
    if not len(own):
        return none
    begins = _begins(lines.page[own])
    count = _ends(begins, len(own)) - begins
    left, right = np.minimum.reduceat(lines.left[own], begins), np.maximum.reduceat(lines.right[own], begins)
    wide = right > left
    if not wide.all():
        return find_boundaries(lines, own[np.repeat(wide, count)], bin_width, clear, min_gap, min_pitches)
    bins = np.ceil((right - left) / bin_width).astype(np.int64) + 1
    if len(begins) > 1 and len(own) * int(bins.max()) > MATRIX:
        half = begins[len(begins) // 2]
        parts = [find_boundaries(lines, part, bin_width, clear, min_gap, min_pitches) for part in (own[:half], own[half:])]
        return tuple(map(np.concatenate, zip(*parts)))
    glyphs = np.diff(lines.starts)[own]
    at = _spans(lines.starts[own], lines.starts[own] + glyphs)
    x, w = lines.x[at], lines.w[at]
    line = np.repeat(np.arange(len(own)), glyphs)
    of = np.repeat(np.arange(len(begins)), count)  # the page of a line
    page = of[line]
    low = np.maximum(np.floor((x - left[page]) / bin_width), 0).astype(np.int64)
    high = np.minimum(np.ceil((x + w - left[page]) / bin_width), bins[page] - 1).astype(np.int64)
    real, across = low <= high, int(bins.max())
    steps = np.bincount((line * (across + 1) + low)[real], minlength=len(own) * (across + 1)) - np.bincount((line * (across + 1) + high + 1)[real], minlength=len(own) * (across + 1))
    taken = np.cumsum(steps.reshape(len(own), across + 1), axis=1)[:, :across] > 0
    busy = np.add.reduceat(taken.astype(np.int32), begins, axis=0)
    free = (count[:, None] - busy >= count[:, None] * clear) & (np.arange(across) < bins[:, None])
    edge = np.diff(np.pad(free.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    where, place = np.nonzero(edge)
    where, a, b = where[::2], place[::2], place[1::2]  # runs [a, b) of open bins
    kept = (a > 0) & (b < bins[where]) & (b - a >= int(np.ceil(min_gap / bin_width)))
    where, boundary = where[kept], left[where[kept]] + (a[kept] + b[kept]) / 2 * bin_width
    if not len(where):
        return none
    real = np.ones(len(where), bool)
    nth = counted_up(where)
    centre, place, begin = x + w / 2, np.arange(len(x)), np.append(0, np.cumsum(glyphs)[:-1])
    for k in range(int(nth.max()) + 1):
        some = np.flatnonzero(nth == k)
        limit = np.full(len(begins), -np.inf)
        limit[where[some]] = boundary[some]
        before = centre < limit[page]
        l, r = np.maximum.reduceat(np.where(before, place, -1), begin), np.minimum.reduceat(np.where(before, len(x), place), begin)
        cut = np.flatnonzero((l >= 0) & (r < len(x)))
        gaps = x[r[cut]] - (x[l[cut]] + w[l[cut]])
        n = np.bincount(of[cut], minlength=len(begins))
        middle = np.arange(len(begins)), n // 2
        gap, pitch = _sorted_rows(gaps, n)[middle], _sorted_rows(lines.pitch[own[cut]], n)[middle]
        narrow = (n > 0) & ((gap < min_gap) | (pitch > 0) & (gap < pitch * min_pitches))
        real[some] = ~narrow[where[some]]
    return lines.page[own[begins]][where[real]], boundary[real]


def boundary_lists(pages: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """The boundaries of each of ``pages``."""
    at, end = np.searchsorted(found[0], pages), np.searchsorted(found[0], pages, side="right")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(end - at)), pa.int32()), pa.array(found[1][_spans(at, end)], pa.float64()))


def split_cells(lines: Lines, found: tuple[np.ndarray, np.ndarray], own: np.ndarray, inside: np.ndarray | None = None) -> pa.ListArray:
    """The text in each column of the lines ``own``, null where a line leaves it empty; of those that
    are not ``inside`` no cells."""
    at = np.searchsorted(found[0], lines.page[own])
    columns = np.searchsorted(found[0], lines.page[own], side="right") - at
    glyphs = np.diff(lines.starts)[own]
    place = _spans(lines.starts[own], lines.starts[own] + glyphs)
    line, centre = np.repeat(np.arange(len(own)), glyphs), lines.x[place] + lines.w[place] / 2
    column = np.zeros(len(place), np.int64)
    bounds = np.append(found[1], np.inf)
    for k in range(int(columns.max(initial=0))):
        limit = bounds[np.where(columns > k, at + k, len(found[1]))]
        column += limit[line] <= centre
    first = np.append(0, np.cumsum(columns + 1))
    cell = first[line] + column
    order = ordered(cell)
    place = place[order]
    texts = lines.texts if len(place) == len(lines.texts) and isinstance(ordered(place), slice) else lines.texts.take(pa.array(place))
    held = np.bincount(cell, minlength=int(first[-1]))
    values, _ = read_texts(lines.x[place], texts, np.append(0, np.cumsum(held)))
    if inside is None or inside.all():
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values, mask=pa.array(~inside))


@dataclass
class Tables:
    """``down``: lines by page, top down. ``inside``: which of those are in their page's table. ``anchor``:
    of every line, whether it starts with a date. ``dated``: the anchors of pages with tables."""

    down: np.ndarray
    inside: np.ndarray
    anchor: np.ndarray
    dated: np.ndarray


def find_tables(lines: Lines, min_anchors: int) -> Tables:
    """From each page's first anchor to its last, and one upper-median anchor gap below; a page with few
    anchors has no table."""
    center = lines.center_y
    anchor = np.array([plain.starts_with_date(t) for t in lines.text.to_pylist()], bool)
    down = np.arange(len(center))[ordered(lines.page, center, lines.row)]
    dated = down[anchor[down]]
    pages = lines.page[dated]
    begins = _begins(pages)
    count = _ends(begins, len(dated)) - begins
    some = count >= min_anchors
    dated, pages = dated[np.repeat(some, count)], pages[begins][some]
    count = count[some]
    if not len(pages):
        return Tables(down, np.zeros(len(down), bool), anchor, dated)
    end = np.cumsum(count)
    gap = np.diff(center[dated])
    gap = gap[np.setdiff1d(np.arange(len(gap)), end[:-1] - 1, assume_unique=True)]
    middle = _sorted_rows(gap, count - 1)[np.arange(len(count)), (count - 1) // 2]
    first, last = center[dated[end - count]], center[dated[end - 1]] + np.where(count > 1, middle, 0.0)
    k = np.minimum(np.searchsorted(pages, lines.page[down]), len(pages) - 1)
    inside = (pages[k] == lines.page[down]) & (center[down] >= first[k]) & (center[down] <= last[k])
    return Tables(down, inside, anchor, dated)


def characters(cells: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Every character of the cells, its cell and its place in it; nulls have none."""
    cells = pc.fill_null(cells, "")
    n = pc.utf8_length(cells).to_numpy(zero_copy_only=False)
    text = "".join(cells.to_pylist())
    if text.isascii():
        out = pa.StringArray.from_buffers(len(text), pa.py_buffer(np.arange(len(text) + 1, dtype=np.int32)), pa.py_buffer(text.encode()))
    else:
        out = pa.array(list(text), pa.string())
    return out, np.repeat(np.arange(len(n)), n), _spans(np.zeros(len(n), np.int64), n.astype(np.int64))
