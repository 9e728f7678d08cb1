"""Counts over many texts at once, by whole arrays of code points.

A batch of texts is laid out as one array of code points. Each is classed by a table
made from the Unicode properties; lines, tokens, words and segments are stretches of
that array, and every count is a sum over stretches. No loop runs over lines or characters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# One bit for each class of code points.
SPACE, LINE_END, LETTER, DIGIT, SYMBOL, ODD, VOWEL, PAUSE, STOP, CLOSER, BULLET, INVISIBLE = (1 << k for k in range(12))
PLANES = 0x30000
_POINTS = {
    LINE_END: "\n\r\x0b\x0c\x85  ",
    PAUSE: ".,:;!?",
    STOP: ".!?…",
    CLOSER: "\"'”»)]",
    BULLET: "|•·",
}
_PLAIN = ".,;:!?'\"()-‐‑‒–—‘’“”…«»¿¡"
# Zero width and direction marks, soft hyphen and byte order mark.
_UNSEEN = ((0xAD, 0xAD), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0xFEFF, 0xFEFF))
# What a wrong decoding of UTF-8 leaves: C1 controls, most signs of Latin-1, A with tilde or circumflex, Y with diaeresis, the replacement sign.
_SPOILED = ((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xA2, 0xAA), (0xAC, 0xAC), (0xAE, 0xB6), (0xB8, 0xB9), (0xBC, 0xBE), (0xC2, 0xC3), (0x178, 0x178), (0xFFFD, 0xFFFD))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The class bits and the lower case of every code point of the first three planes."""
    bits, lower = np.zeros(PLANES + 1, np.uint16), np.arange(PLANES + 1, dtype=np.uint32)
    for point in range(PLANES):
        c = chr(point)
        kind = unicodedata.category(c)
        if c.isspace():
            bits[point] |= SPACE
        elif kind[0] in "LM":
            bits[point] |= LETTER
            small = c.lower()
            lower[point] = ord(small) if len(small) == 1 else point
            if unicodedata.normalize("NFD", small)[0] in "aeiouyæœøаеиоуыэюя":
                bits[point] |= VOWEL
        elif kind == "Nd":
            bits[point] |= DIGIT
        elif kind[0] != "N" and c not in _PLAIN:
            bits[point] |= SYMBOL
    for bit, points in _POINTS.items():
        for c in points:
            bits[ord(c)] |= bit | (SPACE if bit == LINE_END else 0)
    for ranges, bit in ((_UNSEEN, INVISIBLE), (_SPOILED, ODD)):
        for low, high in ranges:
            bits[low : high + 1] |= bit
    return bits, lower


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of ``values`` from each start up to its end."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def digests(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2**64 of each stretch; overlaps of stretches are not allowed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    terms = (points[at].astype(np.uint64) + np.uint64(1)) * powers[at - np.repeat(starts, lengths)]
    found = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return found ^ (found >> np.uint64(29))


def word_digest(word: str) -> int:
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    _, lower = tables()
    return int(digests(lower[np.minimum(points, PLANES)], np.array([0]), np.array([len(points)]))[0]) if len(points) else 0


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case, their class bits and the number of the text, each text with a line end behind it and without unseen marks."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    bits, lower = tables()
    points = np.minimum(points, PLANES)
    marks, of = bits[points], np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if (marks & INVISIBLE).any():
        seen = (marks & INVISIBLE) == 0
        points, marks, of = points[seen], marks[seen], of[seen]
    return lower[points], marks, of


COUNTS = (
    "chars", "letters", "digits", "symbols", "odd", "vowels", "words", "tokens", "lines", "marked", "cells", "labels",
    "closed", "numbers", "mixed", "words_in_words", "words_in_short", "trigrams", "loops",
)
# Words of a short item at most, and tokens back in which a repeated trigram is a loop.
SHORT_ITEM, LOOP = 4, 10


def _lines(points: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(marks & LINE_END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    filled = sums((marks & SPACE) == 0, starts, ends) > 0
    return starts[filled], ends[filled]


def _cells(points: np.ndarray, marks: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Where one field of a record ends: bars, commas and semicolons without blanks, the sign between a key and its value, wide gaps."""
    alnum = (marks & (LETTER | DIGIT)) != 0
    space = (marks & SPACE) != 0
    before, after = np.zeros(len(points), bool), np.zeros(len(points), bool)
    before[1:], after[:-1] = alnum[:-1], alnum[1:]
    blank_before, blank_after = np.ones(len(points), bool), np.ones(len(points), bool)
    blank_before[1:], blank_after[:-1] = space[:-1], space[1:]
    opens = np.zeros(len(points), bool)
    opens[:-1] = points[1:] == ord("(")
    bar = (points == ord("|")) & (before | blank_before) & (after | blank_after)
    tight = ((points == ord(",")) | (points == ord(";"))) & before & after
    keyed = (points == ord("=")) & before & (after | opens)
    return bar | tight | keyed | wide


def count_runs(texts: list[str], vocabulary: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, counts, hits)`` of each run of lines that are laid out alike.

    ``vocabulary`` is a sorted array of word digests and a 0/1 matrix of the languages of each;
    ``hits`` counts the words of each language. Texts without visible characters have no run.
    """
    points, marks, of = lay_out(texts)
    starts, ends = _lines(points, marks)
    languages = vocabulary[1].shape[1]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, languages), np.int64)
    is_in = lambda bit: (marks & bit) != 0
    letter, digit, visible = is_in(LETTER), is_in(DIGIT), ~is_in(SPACE)
    t_from, t_to = stretches(visible)
    t_line = np.searchsorted(starts, t_from, "right") - 1
    tokens = np.bincount(t_line, minlength=len(starts))
    first = np.searchsorted(t_from, starts)

    # Wide gaps between tokens of a line: a tab, or three blanks or more.
    wide = np.zeros(len(points), bool)
    gap = (t_line[1:] == t_line[:-1]) & ((t_from[1:] - t_to[:-1] >= 3) | (sums(points == 9, t_to[:-1], t_from[1:]) > 0))
    wide[t_to[:-1][gap]] = True
    cell = _cells(points, marks, wide)
    cells = sums(cell, starts, ends)

    # Whether the last sign of a line, quotes and brackets left aside, ends a sentence.
    last = np.maximum.accumulate(np.where(visible & ~is_in(CLOSER), np.arange(len(points)), -1))[ends - 1]
    closed = (last >= starts) & ((marks[last] & STOP) != 0)

    # Labels: a colon behind one of the first three tokens and at most three tokens after it.
    colon = np.flatnonzero((points[:-1] == ord(":")) & (letter | digit)[np.maximum(np.arange(len(points) - 1) - 1, 0)] & ~visible[1:])
    token = np.searchsorted(t_from, colon, "right") - 1
    rest = first[t_line[token]] + tokens[t_line[token]] - 1 - token
    label = np.zeros(len(starts), bool)
    label[t_line[token][(token - first[t_line[token]] < 3) & (rest >= 1) & (rest <= 3)]] = True
    label &= ~closed

    # Item marks: a short first token that is neither a word nor a number.
    f_from, f_to = t_from[first], t_to[first]
    size, letters_in, digits_in = f_to - f_from, sums(letter, f_from, f_to), sums(digit, f_from, f_to)
    other = size - letters_in - digits_in
    marked = (size <= 5) & (tokens >= 2) & (letters_in <= 1) & ((other > 0) & ~digit[f_to - 1] | (letters_in == 1) & (digits_in > 0))

    chars = sums(visible, starts, ends)
    digits = sums(digit, starts, ends)
    layout = np.where((cells > 0.15 * (tokens + cells)) | label | (digits > 0.6 * chars), 1, np.where(marked, 2, 0))
    text = of[starts]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (layout[1:] != layout[:-1])])
    run, r_from = np.cumsum(new) - 1, np.flatnonzero(new)
    runs = len(r_from)
    per_run = lambda v: np.add.reduceat(np.asarray(v, np.int64), r_from)

    # Lines broken at a width are one piece of text: all that do not end a sentence nearly reach the widest.
    seen_to = np.maximum.accumulate(np.where(visible, np.arange(len(points)), -1))[ends - 1]
    width = seen_to - f_from + 1
    widest = np.maximum.reduceat(width, r_from)
    goes_on = np.concatenate([~new[1:], [False]]) & ~closed
    fits = goes_on & (width + 1 + np.concatenate([size[1:], [0]]) > widest[run] - 1)
    wrapped = (per_run(goes_on) > 0) & (per_run(fits) >= 0.7 * per_run(goes_on)) & (widest >= 24) & (widest <= 90) & (layout[r_from] == 0)

    # Segments: words with no pause, bullet, wide gap, wordless token or unwrapped line end between them.
    w_from, w_to = stretches(letter)
    w_line = np.searchsorted(starts, w_from, "right") - 1
    pause = np.zeros(len(points), bool)
    pause[:-1] = is_in(PAUSE)[:-1] & ~visible[1:]
    wordless = sums(letter | digit, t_from, t_to) == 0
    pause[t_from[wordless]] = True
    breaks = pause | is_in(BULLET) | wide
    w_run = run[w_line]
    cut = np.ones(len(w_from), bool)
    cut[1:] = (sums(breaks, w_to[:-1], w_from[1:]) > 0) | (w_run[1:] != w_run[:-1]) | (w_line[1:] != w_line[:-1]) & ~wrapped[w_run[1:]]
    held = np.bincount(np.cumsum(cut) - 1, minlength=1) if len(w_from) else np.zeros(0, np.int64)
    s_run = w_run[cut]

    words = digests(points, w_from, w_to)
    known, languages_of = vocabulary
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    hits = np.zeros((runs, languages), np.int64)
    if len(known):
        hit = known[at] == words
        for k in range(languages):
            hits[:, k] = np.bincount(w_run[hit], weights=languages_of[at[hit], k], minlength=runs)

    # Loops: trigrams of tokens that stood there a few tokens before.
    token_digests, t_run = digests(points, t_from, t_to), run[t_line]
    whole = t_run[2:] == t_run[:-2] if len(t_run) > 2 else np.zeros(0, bool)
    grams = (token_digests[:-2] * np.uint64(0x9E3779B97F4A7C15) + token_digests[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + token_digests[2:] if len(t_run) > 2 else token_digests[:0]
    places = np.flatnonzero(whole)
    order = places[np.argsort(grams[places], kind="stable")]
    again = (grams[order][1:] == grams[order][:-1]) & (t_run[order][1:] == t_run[order][:-1]) & (np.diff(order) <= LOOP)
    loops = np.bincount(t_run[order[1:][again]], minlength=runs)

    # Tokens that are numbers, and tokens in which letters and digits touch, item marks left aside.
    t_digits, t_letters = sums(digit, t_from, t_to), sums(letter, t_from, t_to)
    switch = np.zeros(len(points), bool)
    switch[1:] = letter[1:] & digit[:-1] | digit[1:] & letter[:-1]
    mixed = sums(switch, t_from, t_to) > 0
    mixed[first[marked]] = False
    by_line = {
        "chars": chars, "letters": sums(letter, starts, ends), "digits": digits, "symbols": sums(is_in(SYMBOL), starts, ends), "odd": sums(is_in(ODD), starts, ends),
        "vowels": sums(is_in(VOWEL), starts, ends), "words": np.bincount(w_line, minlength=len(starts)), "tokens": tokens, "lines": np.ones(len(starts)),
        "marked": marked, "cells": cells, "labels": label, "closed": closed,
        "numbers": np.bincount(t_line[(t_digits > 0) & (t_letters == 0)], minlength=len(starts)), "mixed": np.bincount(t_line[mixed], minlength=len(starts)),
    }
    by_run = {
        "words_in_words": np.bincount(s_run, weights=held.astype(float) ** 2, minlength=runs), "words_in_short": np.bincount(s_run, weights=np.where((held <= SHORT_ITEM) & (layout[r_from][s_run] != 1), held, 0), minlength=runs),
        "trigrams": np.bincount(t_run[:-2][whole], minlength=runs) if len(t_run) > 2 else np.zeros(runs), "loops": loops,
    }
    counts = np.stack([per_run(by_line[c]) if c in by_line else np.asarray(by_run[c], np.int64) for c in COUNTS], 1)
    return text[r_from], counts, hits
