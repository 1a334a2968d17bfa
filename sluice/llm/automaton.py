"""A generalised suffix automaton in flat arrays, and matching of many texts at once.

An automaton's states are the classes of word sequences that end at the same places of
the items. Edges are sorted by (state, word), so that a step is a binary search, for all
texts of a batch together.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a run of known word pairs is cut into, besides those of a window that may lie across the cut.
STEP = 64

#: Lower-cases A-Z; every other ASCII character but a-z and 0-9 becomes a space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


class _Builder:
    """Grows an automaton word by word. Edges of a state are a chain; a table finds the edge of a word."""

    def __init__(self, n_words: int) -> None:
        self.n = n_words
        self.first, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [0])
        self.source, self.word, self.to, self.after = (array("i") for _ in range(4))
        self.edge: dict[int, int] = {}

    def state(self, length: int) -> int:
        self.first.append(-1)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def join(self, p: int, w: int, q: int) -> None:
        self.edge[p * self.n + w] = len(self.to)
        self.source.append(p)
        self.word.append(w)
        self.to.append(q)
        self.after.append(self.first[p])
        self.first[p] = len(self.to) - 1

    def extend(self, last: int, w: int) -> int:
        """The state of the sequence of `last` and w; an item begins at state 0."""
        edge, to, length = self.edge, self.to, self.length
        e = edge.get(last * self.n + w)
        if e is not None:
            return self.whole(last, w, to[e])
        new, p = self.state(length[last] + 1), last
        while p != -1 and (e := edge.get(p * self.n + w)) is None:
            self.join(p, w, new)
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self.whole(p, w, to[e])
        return new

    def whole(self, p: int, w: int, q: int) -> int:
        """q, if the longest sequence of p goes to its longest; else a state that is split from q for it."""
        if self.length[q] == self.length[p] + 1:
            return q
        new, e = self.state(self.length[p] + 1), self.first[q]
        while e != -1:
            self.join(new, self.word[e], self.to[e])
            e = self.after[e]
        self.link[new], self.link[q] = self.link[q], new
        while p != -1 and (e := self.edge.get(p * self.n + w)) is not None and self.to[e] == q:
            self.to[e] = new
            p = self.link[p]
        return new


def _settled(to: np.ndarray) -> np.ndarray:
    """Where each entry ends that follows `to` until it stays."""
    while not np.array_equal(further := to[to], to):
        to = further
    return to


def built(items: list[tuple[str | None, bytes]], window: int) -> dict[str, np.ndarray]:
    """The arrays of an automaton over (name, text).

    A window is `window` consecutive words of an item; an item of fewer words is one
    window as a whole, and one without words has none.
    """
    number: dict[bytes, int] = {}
    table = FOLD.tobytes()
    sequences = [[number.setdefault(w, len(number)) for w in text.translate(table).split()] for _, text in items]
    grown, n = _Builder(max(len(number), 1)), max(len(number), 1)
    at, of, size = array("i"), array("i"), array("i")  # the states at the ends of windows, their items, their words
    for k, words in enumerate(sequences):
        state = 0
        for i, w in enumerate(words, 1):
            state = grown.extend(state, w)
            if i >= window or i == len(words):
                at.append(state)
                of.append(k)
                size.append(min(window, i))
    link, length = np.maximum(np.array(grown.link, np.int32), 0), np.array(grown.length, np.int32)
    # A state of window words and more stands for the class of its last window; one of a short item for itself.
    here = np.arange(len(link), dtype=np.int32)
    top = _settled(np.where(length[link] >= window, link, here))
    at, of, size = (np.array(x, np.int32) for x in (at, of, size))
    marked, place = np.unique(np.where(size >= window, top[at], at), return_inverse=True)
    pairs = np.unique(place.astype(np.int64) * max(len(items), 1) + of)
    words = np.full(len(marked), window, np.int32)
    words[place] = size
    short = np.zeros(len(link), bool)
    short[marked[words < window]] = True
    key = np.array(grown.source, np.int64) * n + np.array(grown.word, np.int64)
    order = np.argsort(key)
    two = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(s[:-1], np.int64) * n + s[1:] for s in sequences if len(s) > 1)]))
    names = [(name or "").encode() for name, _ in items]
    text = lambda x: {"ends": np.cumsum([0, *map(len, x)], dtype=np.int64), "bytes": np.frombuffer(b"".join(x), np.uint8)}
    out = {
        "key": key[order], "to": np.array(grown.to, np.int32)[order], "link": link, "length": length, "top": top, "pairs_of_words": two,
        "marked": marked.astype(np.int32), "words": words, "items_at": np.searchsorted(pairs // max(len(items), 1), np.arange(len(marked) + 1)), "items": (pairs % max(len(items), 1)).astype(np.int32),
        "window": np.array([window, min([window, *size.tolist()])], np.int32), "nameless": np.array([name is None for name, _ in items], bool),
        **{f"word_{k}": v for k, v in text(list(number)).items()}, **{f"name_{k}": v for k, v in text(names).items()},
    }
    if short.any():
        out["near"] = _settled(np.where(short, here, link))
    return out


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    head, body, at = [], [], 0
    for name, x in arrays.items():
        head.append((name, x.dtype.str, len(x), at))
        raw = x.tobytes() + b"\0" * (-x.nbytes % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Automaton:
    """An automaton as `packed` wrote it; its arrays are views of those bytes."""

    def __init__(self, data: bytes) -> None:
        n = int.from_bytes(data[:8], "little")
        self.a = {name: np.frombuffer(data, kind, count, 8 + n + at) for name, kind, count, at in json.loads(data[8 : 8 + n])}
        a = self.a
        self.words, self.names = _strings(a["word_ends"], a["word_bytes"]), _strings(a["name_ends"], a["name_bytes"]).cast(pa.large_string())
        self.n, (self.window, self.least) = max(len(self.words), 1), a["window"].tolist()

    def _has(self, sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
        return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)

    def found(self, distinct: pa.Array, number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, words, mark) of each occurrence of a window: its last word's place, its length, and its place in `marked`.

        The texts' words are distinct[number], those of a text next to each other; row: the text.
        """
        ids = np.asarray(pc.index_in(distinct, value_set=self.words).fill_null(-1)).astype(np.int64)[number]
        known = ids >= 0
        on = np.zeros(len(ids), bool)  # the word before and this one stand so in an item
        both = np.flatnonzero(known[1:] & known[:-1] & (row[1:] == row[:-1])) + 1
        on[both] = self._has(self.a["pairs_of_words"], ids[both - 1] * self.n + ids[both])[1]
        # Elsewhere the longest match is one word at most, so matching goes by runs.
        first = np.flatnonzero(known & ~on)
        size = np.diff(np.flatnonzero(np.append(~on, True)))[known[~on]] if len(first) else first
        first, size = first[size >= self.least], size[size >= self.least]
        over = self.window - 1
        n = np.maximum(1, -(-(size - over) // STEP))
        begin = np.repeat(first, n) + STEP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(np.repeat(first + size, n) - begin, STEP + over)
        return self._walked(ids, begin, length)

    def _walked(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Stream the words of all runs through the automaton, one word of each at a time."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        key, to, link, length, top = (self.a[k] for k in ("key", "to", "link", "length", "top"))
        near, marked, words = self.a.get("near"), self.a["marked"], self.a["words"]
        state, matched = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        ends, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in range(size[0] if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))  # runs with more than t words
            s, m, w = state[:n], matched[:n], ids[begin[:n] + t]
            at, there = self._has(key, s * self.n + w)
            while not there.all():  # shorter endings of what is matched; state 0 has every word
                away = np.flatnonzero(~there)
                s[away] = link[s[away]]
                m[away] = length[s[away]]
                at[away], there[away] = self._has(key, s[away] * self.n + w[away])
            state[:n], matched[:n] = to[at], m + 1
            s, m = state[:n], matched[:n]
            whole = np.flatnonzero(m >= self.window)
            ends.append(begin[whole] + t)
            marks.append(np.searchsorted(marked, top[s[whole]]))
            if near is not None:
                who, on = np.arange(n), near[s]
                while (go := on > 0).any():
                    who, on = who[go], on[go]
                    mark = np.searchsorted(marked, on)
                    fits = words[mark] <= m[who]
                    ends.append(begin[who[fits]] + t)
                    marks.append(mark[fits])
                    on = near[link[on]]
        end, mark = np.concatenate(ends), np.concatenate(marks)
        return end, words[mark].astype(np.int64), mark

    def items_of(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of each window: the place in `mark`, and the item."""
        at, items = self.a["items_at"], self.a["items"]
        n = at[mark + 1] - at[mark]
        return np.repeat(np.arange(len(mark)), n), items[np.repeat(at[mark] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
