"""Pre-tokenisation of byte-level BPE without regular expressions.

The pattern splits text into contractions, letter runs, digit runs and runs of
other marks, each with an optional leading blank, and white space. Every code
point is of one of a few classes; a small automaton over classes says where pieces
start. Its transition functions form a finite monoid, so the state before every
code point comes from an associative scan: rows of 64 code points are composed
column by column, the rows' functions are combined by doubling, and a second sweep
applies the result. All steps are table look-ups over whole arrays.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

# States: what the piece that the last code point belongs to may become.
START, LETTERS, DIGITS, MARKS, BLANK, SPACE, QUOTE, QUOTE_RV, QUOTE_L, CONTRACTED = range(10)
# Classes of code points.
OTHER_LETTER, STMD, RV, LOWER_L, LOWER_E, DIGIT, APOSTROPHE, MARK, SP, WS, END = range(11)
CLASSES, STATES, COLUMNS = 11, 10, 64
#: The code points with the Unicode property White_Space, but U+0020.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _step(state: int, cls: int) -> tuple[int, bool, bool]:
    """Next state; whether a piece starts here; whether one started a place before."""
    letter, white = cls <= LOWER_E, cls in (SP, WS)
    done = (state == QUOTE_RV and cls == LOWER_E) or (state == QUOTE_L and cls == LOWER_L)
    late = (state in (QUOTE_RV, QUOTE_L) and not done) or (state in (BLANK, SPACE) and not white and cls != END)
    if cls == END:
        return START, True, late
    if done:
        return CONTRACTED, False, False
    if letter:
        if state == QUOTE and cls in (STMD, RV, LOWER_L):
            return {STMD: CONTRACTED, RV: QUOTE_RV, LOWER_L: QUOTE_L}[cls], False, False
        return LETTERS, state not in (LETTERS, BLANK, QUOTE_RV, QUOTE_L), late
    if cls == DIGIT:
        return DIGITS, state not in (DIGITS, BLANK), late
    if cls == APOSTROPHE:
        joined = state in (MARKS, QUOTE, BLANK)
        return (MARKS if joined else QUOTE), not joined, late
    if cls == MARK:
        return MARKS, state not in (MARKS, QUOTE, BLANK), late
    return (BLANK if cls == SP else SPACE), state not in (BLANK, SPACE), late


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """The automaton, and the monoid that its transition functions generate."""
    moves = [[_step(s, c) for c in range(CLASSES)] for s in range(STATES)]
    step = np.array([[m[0] for m in row] for row in moves], np.uint8)
    here = np.array([[m[1] for m in row] for row in moves], np.uint8)
    late = np.array([[m[2] for m in row] for row in moves], np.uint8)
    generators = [tuple(int(step[s, c]) for s in range(STATES)) for c in range(CLASSES)]
    elements, at = [tuple(range(STATES))], 0
    index = {elements[0]: 0}
    while at < len(elements):
        for g in generators:
            f = tuple(g[x] for x in elements[at])
            if f not in index:
                index[f] = len(elements)
                elements.append(f)
        at += 1
    table = np.array(elements, np.intp)
    n = len(elements)
    grow = np.array([[index[tuple(g[x] for x in e)] for g in generators] for e in elements], np.intp)
    mul = np.array([[index[tuple(table[b][table[a]])] for b in range(n)] for a in range(n)], np.intp)
    return {"step": step.ravel().astype(np.intp), "here": here.ravel(), "late": late.ravel(), "apply": table, "grow": grow.ravel(), "mul": mul.ravel(), "n": np.array(n)}


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, by its general category."""
    kind = {"L": OTHER_LETTER, "N": DIGIT}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], MARK) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = WS
    out[0x20], out[ord("'")] = SP, APOSTROPHE
    for letters, cls in (("stmd", STMD), ("rv", RV), ("l", LOWER_L), ("e", LOWER_E)):
        out[[ord(c) for c in letters]] = cls
    return out


def _scan(classes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before every place, and the one after the last."""
    t, n = _tables(), len(classes)
    rows = -(-n // COLUMNS)
    grid = np.full(rows * COLUMNS, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, COLUMNS).T)
    composed = np.zeros(rows, np.intp)
    for column in grid:
        composed = t["grow"].take(composed * CLASSES + column)
    size, shift = int(t["n"]), 1
    while shift < rows:  # inclusive scan by doubling
        composed[shift:] = t["mul"].take(composed[:-shift] * size + composed[shift:])
        shift *= 2
    at = np.empty(rows, np.intp)
    at[0] = state
    at[1:] = t["apply"][composed[:-1], state]
    out = np.empty((COLUMNS, rows), np.uint8)
    for j, column in enumerate(grid):
        out[j] = at
        at = t["step"].take(at * CLASSES + column)
    states = np.ascontiguousarray(out.T).ravel()[:n]
    return states, int(t["step"][int(states[-1]) * CLASSES + int(classes[-1])])


def piece_starts(classes: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Places where a piece starts; END places count as pieces of their own. Long
    input goes block by block with the state carried over."""
    t = _tables()
    flags, state = np.zeros(len(classes), np.uint8), START
    for a in range(0, len(classes), block):
        part = classes[a : a + block]
        states, state = _scan(part, state)
        key = states.astype(np.intp) * CLASSES + part
        flags[a : a + len(part)] |= t["here"].take(key)
        late = t["late"].take(key)
        flags[a : a + len(part) - 1] |= late[1:]
        if a:
            flags[a - 1] |= late[0]
    return np.flatnonzero(flags)


def split_texts(texts: list[str]) -> tuple[list[str], list[int], list[int]]:
    """The distinct pieces of the texts, the number of each piece in turn, and bounds:
    text k has the pieces bounds[k] to bounds[k + 1] - 2, its end mark is the next one.

    Pieces are never cut out one by one: their byte offsets over the joined text are an
    Arrow string array as they stand, whose dictionary encoding finds the distinct ones."""
    joined = "\n".join(texts) + "\n"
    data = joined.encode("utf-8", "surrogatepass")
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = class_table().take(points)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    classes[ends] = END
    starts = piece_starts(classes)
    offsets = starts
    if len(data) != len(points):
        width = (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8) + np.uint8(1)
        offsets = (np.cumsum(width, dtype=np.int64) - width)[starts]
    offsets = np.append(offsets, len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    bounds = np.r_[0, np.searchsorted(starts, ends) + 1]
    return pieces.dictionary.to_pylist(), pieces.indices.to_numpy().tolist(), bounds.tolist()


def chunks(rows, length, limit: int = 1 << 20):
    """rows in lists of about `limit` by length each; a longer row stands alone."""
    out, total = [], 0
    for r in rows:
        n = length(r)
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(r)
        total += n
    if out:
        yield out
