"""Pre-token boundaries of byte-level BPE without regular expressions.

The public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is a finite automaton over codepoint classes.  Every code point becomes a
symbol (its class, with one or two code points of look-ahead folded in), every
symbol is a function from automaton states to states, and composition of such
functions is associative.  The functions that symbols generate form a small
monoid, so a prefix of a text is one small integer and composing two prefixes
is one table look-up: the scan runs block-wise over numpy arrays of any length,
across all texts of a batch at once (a text's first symbol resets the state).
"""

from __future__ import annotations

import functools

import numpy as np

# States: what stands before the next code point.
_FRESH, _SPACES, _PREFIX, _LETTERS, _NUMBERS, _OTHERS, _ONE_LEFT, _TWO_LEFT = range(8)
# Symbols.
_INNER, _GLUED, _LONE, _LETTER, _NUMBER, _OTHER, _SHORT, _LONG = range(8)
_N_STATES, _N_SYMBOLS = 8, 16  # symbols 8 to 15: the same ones at the start of a text

#: Codepoint classes.
SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
_BLOCK = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts at the symbol."""
    if state == _TWO_LEFT:
        return _ONE_LEFT, False
    if state == _ONE_LEFT:
        return _FRESH, False
    if symbol == _INNER:  # white space that more white space or the end follows
        return _SPACES, state != _SPACES
    if symbol == _GLUED:  # the blank before a run: it belongs to that run
        return _PREFIX, True
    if symbol == _LONE:  # other white space before a run: alone
        return _FRESH, True
    run = {_LETTER: _LETTERS, _NUMBER: _NUMBERS}.get(symbol, _OTHERS)
    if state in (_PREFIX, run):
        return run, False
    if symbol == _SHORT:
        return _ONE_LEFT, True
    if symbol == _LONG:
        return _TWO_LEFT, True
    return run, True


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """next[state, symbol], starts[state, symbol], function of a symbol, composition table, functions' value at _FRESH."""
    nxt = np.zeros((_N_STATES, _N_SYMBOLS), np.uint8)
    starts = np.zeros((_N_STATES, _N_SYMBOLS), bool)
    for state in range(_N_STATES):
        for symbol in range(_N_SYMBOLS):
            reset = symbol >= 8
            to, new = _step(_FRESH if reset else state, symbol % 8)
            nxt[state, symbol], starts[state, symbol] = to, new or reset
    functions = {tuple(range(_N_STATES)): 0}
    generators = [tuple(int(x) for x in nxt[:, s]) for s in range(_N_SYMBOLS)]
    queue = list(functions)
    while queue:
        f = queue.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = len(functions)
                queue.append(h)
    names = list(functions)
    compose = np.array([[functions[tuple(g[x] for x in f)] for g in names] for f in names], np.uint16)
    return nxt, starts, np.array([functions[g] for g in generators], np.uint16), compose, np.array([f[_FRESH] for f in names], np.uint8)


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point, from the Unicode properties L, N and White_Space."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        found = "".join(regex.findall(pattern, every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] = SPACE
    return table


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Exclusive prefix composition of an array of functions (0 is the identity)."""
    n = len(functions)
    if n <= _BLOCK:
        out, so_far = np.zeros(n, np.uint16), 0
        for k, f in enumerate(functions.tolist()):
            out[k] = so_far
            so_far = int(compose[so_far, f])
        return out
    columns = _columns(functions, 0)
    partial = np.zeros(columns.shape, np.uint16)
    flat, width = compose.ravel(), compose.shape[1]
    so_far = np.zeros(columns.shape[1], np.intp)
    for k in range(_BLOCK):
        partial[k] = so_far
        so_far = flat[so_far * width + columns[k]].astype(np.intp)
    before = _scan(so_far.astype(np.uint16), compose).astype(np.intp)
    return flat[before * width + partial].T.ravel()[:n]


def _columns(values: np.ndarray, fill: int) -> np.ndarray:
    """Blocks of _BLOCK values as columns: row k holds the k-th value of every block."""
    padded = np.full(-(-len(values) // _BLOCK) * _BLOCK, fill, values.dtype)
    padded[: len(values)] = values
    return np.ascontiguousarray(padded.reshape(-1, _BLOCK).T)


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``first`` are the places where texts begin."""
    n = len(points)
    kinds = class_table()[points]
    ends = np.zeros(n, bool)
    ends[first[1:] - 1] = True
    ends[-1] = True
    white = kinds <= WHITE
    before_run = np.zeros(n, bool)
    before_run[:-1] = white[:-1] & ~white[1:]
    before_run &= ~ends
    symbols = np.array([_INNER, _INNER, _LETTER, _NUMBER, _OTHER], np.uint8)[kinds]
    symbols[before_run & (kinds == SPACE)] = _GLUED
    symbols[before_run & (kinds == WHITE)] = _LONE
    marks = np.flatnonzero(points == 39)
    if len(marks):
        spill = np.concatenate([points, np.zeros(2, points.dtype)])
        stop = np.concatenate([ends, np.ones(2, bool)])
        one, two = spill[marks + 1], spill[marks + 2]
        has_one = ~stop[marks]
        has_two = has_one & ~stop[marks + 1]
        short = has_one & np.isin(one, [ord(c) for c in "stmd"])
        pair = one.astype(np.int64) * 0x110000 + two
        long = has_two & np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
        symbols[marks[short]] = _SHORT
        symbols[marks[long & ~short]] = _LONG
    symbols[first] += 8
    return symbols


def starts_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, where pre-tokens start in it, and how many each text has."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begins = np.cumsum(lengths) - lengths
    nxt, starts, of_symbol, compose, at_fresh = _machine()
    symbols = _symbols(points, begins[lengths > 0])
    columns = _columns(symbols, _INNER).astype(np.intp)
    # Up: one function per block; then the state before each block; down: the states within blocks.
    flat, width = compose.ravel(), compose.shape[1]
    total = np.zeros(columns.shape[1], np.intp)
    for row in columns:
        total = flat[total * width + of_symbol[row]].astype(np.intp)
    state = at_fresh[_scan(total.astype(np.uint16), compose)].astype(np.intp)
    next_flat, start_flat = nxt.ravel(), starts.ravel()
    marks = np.zeros(columns.shape, bool)
    for k, row in enumerate(columns):
        at = state * _N_SYMBOLS + row
        marks[k] = start_flat[at]
        state = next_flat[at].astype(np.intp)
    places = np.flatnonzero(marks.T.ravel()[: len(points)])
    counts = np.searchsorted(places, begins + lengths) - np.searchsorted(places, begins)
    return joined, places, counts


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All pre-tokens of ``texts`` in order, how many each text has, and their start offsets."""
    joined, places, counts = starts_of(texts)
    bounds = places.tolist()
    bounds.append(len(joined))
    return [joined[a:b] for a, b in zip(bounds, bounds[1:])], counts, places
