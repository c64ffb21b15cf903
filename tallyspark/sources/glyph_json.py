"""The JSON of glyph dumps, many documents at a time: whole columns to text and text to whole columns.

A dump is one array of objects. It is written without blanks and with a line a glyph, so that a line is cut
at its x: what stands before, x itself and what follows come again and again on a page, and ``json`` reads
each but once. What has another form (other names or orders, blanks, what is no dump at all) is read by
``json`` glyph by glyph, a document at a time.
"""

from __future__ import annotations

import gzip
import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyspark.operators.pages import Glyphs, ordered, taken

#: Bytes of JSON that one step reads, a document at least.
STEP_BYTES = 4 << 20
_PAIRS = json.JSONDecoder(object_pairs_hook=tuple).decode
_PLACE = [("glyph_ord", pa.int64()), ("text", pa.string()), *((c, pa.float64()) for c in "xywh")]
PAGES = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("glyphs", pa.list_(pa.struct(_PLACE)))])


def _told(values: pa.Array, shown: Callable[[list], list[str]], after: str) -> pa.Array:
    """Each value's text and what follows it; a value that comes again is not put into words again."""
    found = values.dictionary_encode()
    words = [w + after for w in [*shown(found.dictionary.to_pylist()), "null"]]
    return pa.array(words, pa.large_string()).take(pc.fill_null(found.indices, len(words) - 1))


def _numbers(values: np.ndarray) -> Callable[[list], list[str]]:
    if not np.isfinite(values).all():
        raise ValueError(f"Out of range float values are not JSON compliant: {values[~np.isfinite(values)][0]}")
    return lambda bits: list(map(float.__repr__, np.array(bits, np.int64).view(np.float64).tolist()))


def dumps(g: Glyphs, page: np.ndarray, document: np.ndarray, n: int) -> Iterator[bytes]:
    """The dumps of ``n`` documents: of each glyph its page's number and its document, which ascend; in
    a document glyphs lie by their order, and where that is the same as they come."""
    order = ordered(document, g.ids)
    quoted = json.encoder.encode_basestring
    parts = [_told(taken(g.text, order), lambda v: [f'{{"text":{quoted(t)}' for t in v], ',"page":'), _told(pa.array(page[order]), lambda v: list(map(str, v)), ',"x":')]
    for c, after in zip("xywh", (',"y":', ',"w":', ',"h":', "},\n")):
        own = np.ascontiguousarray(getattr(g, c)[order], np.float64)
        # by their bits, for -0.0 equals 0.0
        parts.append(_told(pa.array(own.view(np.int64)), _numbers(own), after))
    joined = pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
    text = memoryview(joined.buffers()[2] or b"")
    cut = np.append(0, np.cumsum(np.bincount(document, minlength=n)))
    for a, b in zip(ends[cut[:-1]].tolist(), ends[cut[1:]].tolist()):
        yield b"".join((b"[", text[a : b - 2], b"]")) if b > a else b"[]"


def packed(data: bytes, level: int = 5) -> bytes:
    return gzip.compress(data, level, mtime=0)


def unpacked(data: bytes) -> bytes:
    return gzip.decompress(data)


def _head(cell: str) -> tuple[str, int]:
    (text, t), (page, p), (x, zero) = _PAIRS(cell + "0}")
    if (text, page, x, zero) != ("text", "page", "x", 0) or type(t) is not str or type(p) is not int or abs(p) >= 1 << 31 or not cell.endswith(":"):
        raise ValueError("no text and page")
    return t, p


def _number(value: object) -> float:
    if type(value) not in (int, float) or not math.isfinite(value):
        raise ValueError("no number")
    return float(value)


def _tail(cell: str) -> tuple[float, ...]:
    if not cell.endswith("},\n"):
        raise ValueError("no end")
    (_, _), (y, a), (w, b), (h, c) = _PAIRS('{"x":0' + cell[:-2])
    if (y, w, h) != ("y", "w", "h"):
        raise ValueError("no y, w and h")
    return _number(a), _number(b), _number(c)


def _at_once(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The glyphs of dumps with a line a glyph: texts, pages, places, and how many each dump has;
    ValueError if they aren't all such."""
    if not all(t[:1] == b"[" and t[-1:] == b"]" and len(t) > 1 for t in texts):
        raise ValueError("a glyph dump is an array")
    inner = [t[1:-1] for t in texts]
    n = np.array([t.count(b"\n") + 1 if t else 0 for t in inner], np.int64)
    text = b",\n".join([*filter(None, inner), b""])
    held = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(held == ord("\n")) + 1

    def named(c: str) -> np.ndarray:
        # no string of JSON holds a quote: ,"x": is a name
        at = np.flatnonzero(held[2:-2] == ord(c)) + 2
        return at[(held[at - 2] == ord(",")) & (held[at - 1] == ord('"')) & (held[at + 1] == ord('"')) & (held[at + 2] == ord(":"))]

    begins, x, y = np.append(0, ends[:-1])[: len(ends)], named("x") + 3, named("y") - 2
    if not len(ends) == len(x) == len(y) == n.sum() or not ((begins < x) & (x < y) & (y < ends)).all():
        raise ValueError("lines aren't glyphs")
    cuts = np.append(np.stack([begins, x, y], 1).ravel(), len(text)).astype(np.int64)
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)]).dictionary_encode()
    code, words = cells.indices.to_numpy().reshape(-1, 3), [w.decode() for w in cells.dictionary.to_pylist()]

    def read(k: int, one: Callable[[str], tuple]) -> tuple[np.ndarray, list[tuple]]:
        """Which of the cells that differ each line has, and what they hold."""
        used = np.zeros(len(words), bool)
        used[code[:, k]] = True
        return (np.cumsum(used) - 1)[code[:, k]], [one(words[i]) for i in np.flatnonzero(used).tolist()]

    of, heads = read(0, _head)
    text = pa.array([t for t, _ in heads], pa.string()).take(pa.array(of))
    page = np.array([p for _, p in heads], np.int64)[of]
    of, values = read(1, lambda cell: _number(json.loads(cell)))
    places = [np.array(values, np.float64)[of]]
    of, tails = read(2, _tail)
    return text, page, [*places, *(c[of] for c in np.array(tails, np.float64).reshape(-1, 3).T)], n


def pages(documents: Sequence[str], texts: list[bytes], rows: Callable[[int], list[tuple]]) -> pa.RecordBatch:
    """The pages of dumps: doc_id, page and the page's glyphs in the dump's order, which is their
    glyph_ord. ``rows``: the same of one dump, glyph by glyph, for what isn't read at once."""
    try:
        text, number, place, n = _at_once(texts)
    except (ValueError, OverflowError, TypeError):
        made = [rows(k) for k in range(len(texts))]
        n = np.array(list(map(len, made)), np.int64)
        columns = list(zip(*(r for own in made for r in own))) or [()] * 8
        text, number, place = pa.array(columns[2], pa.string()), np.array(columns[3], np.int64), [np.array(c, np.float64) for c in columns[4:]]
    document = np.repeat(np.arange(len(texts)), n)
    ids = np.arange(len(document)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
    order = ordered(document, number)
    document, number = document[order], number[order]
    begins = np.flatnonzero(np.append(True, (document[1:] != document[:-1]) | (number[1:] != number[:-1]))) if len(document) else np.zeros(0, np.int64)
    own = pa.StructArray.from_arrays([pa.array(ids[order]), taken(text, order), *(pa.array(c[order]) for c in place)], [c for c, _ in _PLACE])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(document)), pa.int32()), own)
    return pa.RecordBatch.from_arrays([pa.array(documents, pa.string()).take(pa.array(document[begins])), pa.array(number[begins], pa.int32()), lists], schema=PAGES)
