"""Byte-level pre-tokens by array scans instead of a regular expression.

Each code point becomes one of a few symbols (its class, with the little look-ahead that the
pattern needs folded in). A symbol is a function from state to state of a small automaton; the
functions that can arise form a finite monoid, so composing two of them is a table look-up, and a
prefix scan over blocks gives the state at every code point. A token begins where the pair of the
previous state and the symbol says so. A separator between texts is a constant function, so many
texts are scanned at once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tallycast.llm.words import SEP, SEP_CODE, STEP_CHARS, code_points, steps

# White space of the Unicode property that \s stands for.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Symbols: separator, letter, number, other, apostrophe of a one- or two-letter ending, a blank before a
#: visible character, other white space before one, white space before white space or the end.
RESET, S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK, S_BREAK, S_WHITE = range(9)
STATES = ("start", "letters", "numbers", "others", "white", "blank", "break", "short", "long", "long2", "done")
AT = {s: i for i, s in enumerate(STATES)}
BLOCK = 64
#: Put between pieces before one fast split; a text that holds this code point is sliced instead.
CUT = 0x10FFFF


def _step(state: str, symbol: int) -> tuple[str, bool]:
    """Next state, and whether a token begins at this code point."""
    if symbol == RESET:
        return "start", True
    if symbol == S_LETTER:
        follow = {"letters": "letters", "blank": "letters", "short": "done", "long": "long2", "long2": "done"}
        return (follow[state], False) if state in follow else ("letters", True)
    if symbol == S_NUMBER:
        return "numbers", state not in ("numbers", "blank")
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in ("others", "blank"):
            return "others", False
        return {S_OTHER: "others", S_SHORT: "short", S_LONG: "long"}[symbol], True
    if symbol == S_WHITE:
        return "white", state != "white"
    return ("blank" if symbol == S_BLANK else "break"), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Function of each symbol, composition table (flat), action on states, token starts, number of functions."""
    symbols = range(9)
    simple = [tuple(AT[_step(s, x)[0]] for s in STATES) for x in symbols]
    known = {f: i for i, f in enumerate(dict.fromkeys(simple))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in simple:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = list(known)
    m = len(every)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8)
    begins = np.array([[_step(s, x)[1] for x in symbols] for s in STATES])
    return np.array([known[f] for f in simple], np.uint8), compose.ravel(), np.array(every, np.uint8).ravel(), begins.ravel(), m


@lru_cache(1)
def class_table() -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((of.get(g[0], OTHER) for g in map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))), np.uint8, sys.maxunicode + 1)
    out[list(WHITE)] = SPACE
    return out


def _scan(f: np.ndarray, compose: np.ndarray, m: int) -> np.ndarray:
    """Inclusive prefix compositions of a sequence of functions."""
    n = len(f)
    if n <= BLOCK:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * m + int(f[i])]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = compose[grid[j - 1].astype(np.intp) * m + grid[j]]
    before = _scan(grid[-1], compose, m)
    grid[:, 1:] = compose[before[:-1].astype(np.intp)[None, :] * m + grid[:, 1:]]
    return grid.T.ravel()[:n]


def symbols_of(cp: np.ndarray) -> np.ndarray:
    kind = class_table()[cp]
    kind[cp == SEP_CODE] = OTHER
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE], np.uint8)[kind]
    after = np.append(cp[1:], np.uint32(SEP_CODE))
    white = np.flatnonzero(kind == SPACE)
    follow = after[white]
    visible = (class_table()[follow] != SPACE) & (follow != SEP_CODE)
    white = white[visible]
    symbol[white] = np.where(cp[white] == 0x20, S_BLANK, S_BREAK)
    quote = np.flatnonzero(cp == ord("'"))
    if len(quote):
        one, two = after[quote], np.append(after, np.uint32(SEP_CODE))[quote + 1]
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        symbol[quote[long]] = S_LONG
    symbol[cp == SEP_CODE] = RESET
    return symbol


def boundaries(cp: np.ndarray) -> np.ndarray:
    """Positions where a pre-token or a separator begins."""
    if not len(cp):
        return np.zeros(0, np.int64)
    of_symbol, compose, action, begins, m = automaton()
    symbol = symbols_of(cp)
    scanned = _scan(of_symbol[symbol], compose, m)
    state = action[scanned.astype(np.intp) * len(STATES) + AT["start"]]
    before = np.empty(len(cp), np.intp)
    before[0], before[1:] = AT["start"], state[:-1]
    return np.flatnonzero(begins[before * 9 + symbol])


def _slices(joined: str) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of texts joined by separators, and the offset of the first of each text."""
    cp = code_points(joined)
    at = boundaries(cp)
    at = at[cp[at] != SEP_CODE]
    begin = np.concatenate(([0], np.flatnonzero(cp == SEP_CODE) + 1))
    first = np.append(np.searchsorted(at, begin), len(at))
    if (cp == CUT).any():
        return [joined[a:b] for a, b in zip(at.tolist(), np.minimum(np.append(at[1:], len(cp)), np.repeat(np.append(begin[1:] - 1, len(cp)), np.diff(first))).tolist())], first
    place = np.arange(len(cp)) + np.cumsum(np.bincount(at, minlength=len(cp)))
    cut = np.full(len(cp) + len(at), CUT, np.uint32)
    cut[place] = cp
    cut[cut == SEP_CODE] = CUT
    return list(filter(None, cut.tobytes().decode("utf-32-le").split(chr(CUT)))), first


def pretokens(texts: list[str], window: int = STEP_CHARS) -> Iterator[tuple[list[str], np.ndarray, bool]]:
    """Pieces in order: (pieces, first offset of each text, whether the next item goes on with the last text).

    Short texts are scanned together. A text longer than a window is scanned window by window: a
    match of the pattern depends only on what follows its start, so a window may begin anew at the
    last settled token, and memory stays bounded by the window.
    """
    for a, b in steps(texts, window):
        if b - a > 1 or len(texts[a]) <= window:
            pieces, first = _slices(SEP.join(texts[a:b]))
            yield pieces, first, False
            continue
        text, at, size = texts[a], 0, window
        while at < len(text):
            part = text[at : at + size]
            pieces, _ = _slices(part)
            last = at + size >= len(text)
            if not last:
                held, settled = len(part), len(pieces)
                while settled and held > size - 4:
                    settled -= 1
                    held -= len(pieces[settled])
                if not settled:
                    size *= 2
                    continue
                pieces = pieces[:settled]
                at += held
            else:
                at = len(text)
            yield pieces, np.array([0, len(pieces)]), not last
            size = window
