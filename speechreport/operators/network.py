"""Word transition networks: transcripts of one recording, aligned progressively.

A network is a list of columns, each with one entry for each transcript so far: its word there, or 0 for none. The
first transcript gives a column for each of its words. Each further one is aligned to the whole network: standing in
a column costs nothing if some transcript has the same word there, passing over a column nothing if some has no word
there, and every other step, a new column included, costs 1.

Words that occur once in the transcript and in one column only, in the longest chain that has the same order on both
sides, are anchors; what lies between two anchors is aligned in the same way, and a part of at most DIRECT cells by its
cheapest path. So long transcripts take time near their length. A part without anchors whose trace would pass
TRACE bytes is cut in half where the costs of both halves are least, which bounds memory.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import count

import numpy as np

#: Cells of a part that is aligned by its cheapest path at once, and bytes of trace that are held.
DIRECT, TRACE = 4096, 1 << 25
#: A word of a transcript in a column, a column that it passes, a word in a new column.
PAIR, PASS, NEW = 0, 1, 2


def _rows(columns: np.ndarray, words: np.ndarray, trace: np.ndarray | None) -> np.ndarray:
    """Costs of aligning all columns with each prefix of words; fills the trace. A pair comes before a pass and that before a new column."""
    k = np.arange(len(words) + 1)
    cost = k.copy()
    passed = (columns != 0).all(axis=1).astype(np.int64)
    if trace is not None:
        trace[0] = NEW
    for i, column in enumerate(columns):
        other = np.ones(len(words), bool)
        for w in column[column != 0]:
            other &= words != w
        gone = cost + passed[i]
        pair = np.append(1 << 40, cost[:-1] + other)
        cost = np.minimum.accumulate(np.minimum(gone, pair) - k) + k
        if trace is not None:
            trace[i + 1] = np.where(cost == pair, PAIR, np.where(cost == gone, PASS, NEW))
    return cost


#: Words of a part up to which plain lists are faster than array calls.
FEW = 40


def _short(columns: list[list[int]], words: list[int]) -> list[tuple[int, int]]:
    """cheapest() for parts of few words."""
    # a last column that all transcripts have, with the last word: a pair there is as cheap as any step
    n, m, ends = len(columns), len(words), []
    while n and m and words[m - 1] in columns[n - 1] and 0 not in columns[n - 1]:
        n, m = n - 1, m - 1
        ends.append((n, m))
    if not n or not m:
        return [*[(i, -1) for i in range(n)], *[(-1, j) for j in range(m)], *ends[::-1]]
    cost, trace = list(range(m + 1)), [[NEW] * (m + 1)]
    for column in columns[:n]:
        passed = 0 if 0 in column else 1
        before = cost[0]
        left = before + passed
        now, kinds = [left], [PASS]
        for j in range(m):
            pair = before if words[j] in column else before + 1
            before = cost[j + 1]
            gone, left = before + passed, left + 1
            if pair <= gone and pair <= left:
                left, kind = pair, PAIR
            elif gone <= left:
                left, kind = gone, PASS
            else:
                kind = NEW
            now.append(left)
            kinds.append(kind)
        cost = now
        trace.append(kinds)
    while n or m:
        step = trace[n][m]
        n, m = n - (step != NEW), m - (step != PASS)
        ends.append((n if step != NEW else -1, m if step != PASS else -1))
    return ends[::-1]


def cheapest(columns: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """(column, word) steps of a cheapest alignment, -1 for none on that side."""
    n, m = len(columns), len(words)
    if not n or not m:
        return [(i, -1) for i in range(n)] or [(-1, j) for j in range(m)]
    if m <= FEW and (n + 1) * (m + 1) <= min(DIRECT, TRACE):
        return _short(columns.tolist(), words.tolist())
    if n > 1 and (n + 1) * (m + 1) > TRACE:
        half = n // 2
        cut = int(np.argmin(_rows(columns[:half], words, None) + _rows(columns[half:][::-1], words[::-1], None)[::-1]))
        rest = cheapest(columns[half:], words[cut:])
        return cheapest(columns[:half], words[:cut]) + [(i + half if i >= 0 else -1, j + cut if j >= 0 else -1) for i, j in rest]
    trace = np.zeros((n + 1, m + 1), np.int8)
    _rows(columns, words, trace)
    i, j, steps = n, m, []
    while i or j:
        step = trace[i, j] if i else NEW
        steps.append((i - 1 if step != NEW else -1, j - 1 if step != PASS else -1))
        i, j = i - (step != NEW), j - (step != PASS)
    return steps[::-1]


def _chain(columns: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest chain of columns and words of words that occur once on both sides."""
    # a word counts once in a column
    own = columns.copy()
    for k in range(1, own.shape[1]):
        own[(columns[:, :k] == columns[:, k : k + 1]).any(axis=1), k] = 0
    size = int(max(own.max(initial=0), words.max(initial=0))) + 1
    once = (np.bincount(words, minlength=size) == 1) & (np.bincount(own.ravel(), minlength=size) == 1)
    once[0] = False
    at = np.zeros(size, np.int64)
    at[words] = np.arange(len(words))
    i, k = np.nonzero(once[own])
    j = at[own[i, k]]
    if (np.diff(i) > 0).all() and (np.diff(j) > 0).all():
        return i, j
    # of words of one column at most one is taken: they are looked at from the last place on
    order = np.lexsort((-j, i))
    i, j = i[order], j[order]
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(i)
    for k, x in enumerate(j.tolist()):
        p = bisect_left(tails, x)
        tails[p : p + 1], ends[p : p + 1] = [x], [k]
        before[k] = ends[p - 1] if p else -1
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    return i[chain[::-1]], j[chain[::-1]]


def anchors(columns: list[list[int]], words: list[int]) -> list[tuple[int, int]]:
    """The longest chain of (column, word) of words that occur once on both sides."""
    return list(zip(*(x.tolist() for x in _chain(np.array(columns), np.array(words))), strict=True))


def _differing(columns: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first column, end, first word, end) of the parts between the anchors (i, j) that don't agree word by word.

    One column and one word are a pair in any case.
    """
    c0, c1, w0, w1 = np.append(0, i + 1), np.append(i, len(columns)), np.append(0, j + 1), np.append(j, len(words))
    part = np.repeat(np.arange(len(c0)), np.append(i, len(columns) - 1) - c0 + 1)
    beside = np.clip(np.arange(len(columns)) + (w0 - c0)[part], 0, len(words) - 1)
    agree = (columns == words[beside][:, None]).any(axis=1)
    bad = (c1 - c0 != w1 - w0) | ((c1 - c0 > 1) & (np.bincount(part[~agree], minlength=len(c0)) > 0))
    return list(zip(*(x[bad].tolist() for x in (c0, c1, w0, w1)), strict=True))


def align(columns: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a transcript along a network as places of columns and of words, -1 for none on that side.

    What agrees word by word between two anchors is taken as it stands, as pairs come first on a cheapest path.
    """
    at: list[int] = []
    of: list[int] = []
    none = np.zeros(0, np.int64)
    held, said = columns.tolist(), words.tolist()
    parts = [(0, len(columns), 0, len(words), False)]
    while parts:
        c0, c1, w0, w1, same = parts.pop()
        n, m = c1 - c0, w1 - w0
        if same:
            at += range(c0, c1)
            of += range(w0, w1)
            continue
        if not n or not m:
            at += [*range(c0, c1), *[-1] * m]
            of += [*[-1] * n, *range(w0, w1)]
            continue
        i, j = _chain(columns[c0:c1], words[w0:w1]) if n * m > DIRECT else (none, none)
        # the parts of an earlier part are known to differ
        if len(i) or (n == m and not at and not parts):
            found = _differing(columns[c0:c1], words[w0:w1], i, j)
            if len(i) or not found:
                inner, c, w = [], c0, w0
                for a, b, x, y in found:
                    inner += [(c, c0 + a, w, w0 + x, True), (c0 + a, c0 + b, w0 + x, w0 + y, False)]
                    c, w = c0 + b, w0 + y
                inner.append((c, c1, w, w1, True))
                parts += reversed(inner)
                continue
        if m <= FEW and (n + 1) * (m + 1) <= min(DIRECT, TRACE):
            steps = _short(held[c0:c1], said[w0:w1])
        else:
            steps = cheapest(columns[c0:c1], words[w0:w1])
        at += [i + c0 if i >= 0 else -1 for i, _ in steps]
        of += [j + w0 if j >= 0 else -1 for _, j in steps]
    return np.array(at, np.int64), np.array(of, np.int64)


def coded(transcripts: list[list]) -> tuple[list, list[np.ndarray]]:
    """Words by number, 0 for none, and the numbers of each transcript: a word's number is its first place among all words."""
    names: list = [None]
    numbers: dict = {}
    told = []
    for ws in transcripts:
        told.append(np.fromiter(map(numbers.setdefault, ws, count(len(names))), np.int64, len(ws)))
        names += ws
    return names, told


def columns_of(told: list[np.ndarray]) -> np.ndarray:
    """The network of numbered transcripts: a row for each column, an entry for each transcript."""
    columns = told[0][:, None] if told else np.zeros((0, 0), np.int64)
    for words in told[1:]:
        at, of = align(columns, words)
        # -1 takes the row or word of none that is put last
        columns = np.concatenate([np.pad(columns, ((0, 1), (0, 0)))[at], np.append(words, 0)[of][:, None]], axis=1)
    return columns


def winners(columns: np.ndarray) -> np.ndarray:
    """The entry of most transcripts in each column, ties to the first of them, without columns in which none wins."""
    if not columns.shape[1]:
        return np.zeros(0, np.int64)
    votes = np.stack([(columns == columns[:, k : k + 1]).sum(axis=1) for k in range(columns.shape[1])], axis=1)
    won = np.take_along_axis(columns, votes.argmax(axis=1)[:, None], axis=1)[:, 0]
    return won[won > 0]


def runs_of(columns: np.ndarray) -> list[tuple[int, int, int]]:
    """(words of the first transcript before it, first column, end) for each run of neighbouring columns that differ."""
    if not columns.size:
        return []
    differs = (columns != columns[:, :1]).any(axis=1).astype(np.int8)
    edge = np.diff(np.concatenate([[0], differs, [0]]))
    starts = np.flatnonzero(edge == 1)
    place = np.append(0, np.cumsum(columns[:, 0] > 0))
    return list(zip(place[starts].tolist(), starts.tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def network(transcripts: list[list[str]]) -> list[list[str]]:
    """Columns of words, '' for none, of transcripts in their order."""
    names, told = coded(transcripts)
    names[0] = ""
    return [[names[w] for w in column] for column in columns_of(told).tolist()]


def majority(columns: list[list[str]]) -> list[str]:
    """The entry of most transcripts in each column, ties to the first of them; columns in which none wins are left out."""
    won = (c[0] if c.count(c[0]) == len(c) else max(c, key=c.count) for c in columns)
    return [w for w in won if w]


def spans(columns: list[list[str]]) -> list[tuple[int, list[list[str]]]]:
    """(words of the first transcript before it, words of each transcript) for each run of neighbouring columns that differ."""
    numbers = {"": 0}
    own = np.array([[numbers.setdefault(w, len(numbers)) for w in c] for c in columns], np.int64)
    return [(at, [[w for w in ws if w] for ws in zip(*columns[a:b], strict=True)]) for at, a, b in (runs_of(own) if columns else [])]
