"""Values that stand beside or below labels, for many arrays of elements at once.

A batch's elements are flat columns; what a text says of labels is worked out once for each distinct text, and each key is
looked for in all scopes of the batch together. A scope is a range of elements in reading order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts that begin no label of a date or a name.
NOT_A_NAME = ("LOAN", "ACCOUNT", "REPORT", "DETAILS", "ENQUIRY", "SUMMARY", "HISTORY", "FACTOR", "INFORMATION", "TYPE", "BALANCE", "AMOUNT", "DATE", "STATUS")
NOT_A_DATE = ("DATE OPENED", "DATE CLOSED", "REPORT DATE")
#: Elements that are worked on together, about.
ELEMENTS = 1 << 18

_SPACED = str.maketrans("\n\r-:", "    ")


class Elements:
    """The elements of a batch's arrays as flat columns, with what their distinct texts say."""

    def __init__(self, arrays: pa.ListArray):
        lengths = pc.fill_null(pc.list_value_length(arrays), 0)
        self.ends = np.r_[0, np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))]
        flat = arrays.flatten()
        column = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
        self.x0, self.y0, self.x1, self.y1 = (column[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x0", "y0", "x1", "y1"))
        self.nowhere = np.isnan(self.x0) | np.isnan(self.y0) | np.isnan(self.y1)
        self.unnumbered = column["seq"].is_null().to_numpy(zero_copy_only=False)
        self.seq = pc.fill_null(column["seq"], np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        self.silent = column["text"].is_null().to_numpy(zero_copy_only=False)
        encoded = pc.fill_null(column["text"], "").dictionary_encode()
        self.text = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts: list[str] = encoded.dictionary.to_pylist()
        self.rank = np.empty(len(self.texts), np.int64)
        self.rank[pc.sort_indices(encoded.dictionary).to_numpy()] = np.arange(len(self.texts))
        self.octets = pc.binary_length(encoded.dictionary.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
        self.clean = [t.upper().translate(_SPACED) for t in self.texts]
        trimmed = [t.strip(" ") for t in self.texts]
        self.trimmed, self.value = np.array(trimmed, object), np.array([t.lstrip(":").strip(" ") for t in trimmed], object)
        self.mark = np.array([t in (":", "|") for t in trimmed], bool)
        self._words: dict[str, np.ndarray] = {}

    def holding(self, word: str) -> np.ndarray:
        """Which distinct texts hold a word."""
        if word not in self._words:
            self._words[word] = np.fromiter((word in c for c in self.clean), bool, len(self.clean))
        return self._words[word]

    def any_of(self, words: Sequence[str]) -> np.ndarray:
        return np.logical_or.reduce([self.holding(w) for w in words])

    def behind_colon(self, text: int) -> str | None:
        """What stands behind the first colon of a distinct text, if it can be a value."""
        _, colon, rest = self.texts[text].partition(":")
        rest = rest.strip(" ")
        return rest if colon and rest and len(rest.encode()) < 80 and "ACCOUNT" not in rest.upper() else None


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every member of groups of these sizes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)


def _labels(e: Elements, key: str, words: list[str], hits: np.ndarray, scope: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each scope's best label: (scope, loss, members, their labels' places), members in order.

    ``hits`` are the elements that hold words of the key, with their scopes in ``scope``; ``said`` has the words as bits.
    """
    begins = np.ones(len(e.texts), bool)
    if key == "DATE":
        begins &= ~e.any_of(NOT_A_DATE)
    if re.search("CONSUMER|NAME", key):
        begins &= ~e.any_of(NOT_A_NAME)
    begin = _starts(scope)
    size = np.diff(np.r_[begin, len(scope)])
    group = np.repeat(np.arange(len(begin)), size)
    chosen = np.flatnonzero(begins[e.text[hits]])
    start, first, count = hits[chosen], begin[group[chosen]], size[group[chosen]]
    top, bottom = e.y0[start].copy(), e.y1[start].copy()
    owners, members, later = [np.arange(len(start))], [start], [np.zeros(len(start), np.int8)]
    live = np.flatnonzero(~e.unnumbered[start])
    for place in range(int(count.max(initial=0))):
        live = live[count[live] > place]
        a, b = start[live], hits[first[live] + place]
        near = (e.seq[a] != e.seq[b]) & ~e.unnumbered[b] & (e.y0[b] >= e.y0[a] - 2) & (np.abs(e.x0[b] - e.x0[a]) < 15) & (e.y1[b] >= top[live] - 25) & (e.y0[b] <= bottom[live] + 25)
        own, b = live[near], b[near]
        top[own], bottom[own] = np.minimum(top[own], e.y0[b]), np.maximum(bottom[own], e.y1[b])
        owners.append(own)
        members.append(b)
        later.append(np.ones(len(own), np.int8))
    owner, member, late = np.concatenate(owners), np.concatenate(members), np.concatenate(later)
    order = np.lexsort((e.rank[e.text[member]], e.y1[member], e.x1[member], e.x0[member], e.seq[member], late, e.y0[member], owner))
    owner, member = owner[order], member[order]
    # A member stays if it adds a word to those above it.
    at = _starts(owner)
    sizes = np.diff(np.r_[at, len(owner)])
    held, stays = np.zeros(len(start), np.uint64), np.zeros(len(owner), bool)
    live = np.arange(len(start))
    for place in range(int(sizes.max(initial=0))):
        live = live[sizes[live] > place]
        more = said[e.text[member[at[live] + place]]]
        fresh = (more & ~held[live]) > 0
        stays[at[live] + place] = fresh | (place == 0)
        held[live] |= more
    owner, member = owner[stays], member[stays]
    at = _starts(owner)
    low, high = np.minimum.reduceat(e.y0[member], at), np.maximum.reduceat(e.y1[member], at)
    length = np.add.reduceat(e.octets[e.text[member]], at)
    loss = -(np.bitwise_count(held) * 100.0 - (high - low) * 0.1 - np.maximum(length - len(key), 0) * 0.5)
    lead = member[at]
    order = np.lexsort((e.rank[e.text[lead]], e.y1[lead], e.x1[lead], e.x0[lead], e.seq[lead], e.y0[lead], e.seq[start], loss, group[chosen]))
    best = order[_starts(group[chosen][order])]
    best = best[loss[best] <= -50]
    sizes = np.diff(np.r_[at, len(owner)])[best]
    of, place = _each(sizes)
    return scope[chosen[best]], loss[best], member[at[best][of] + place], np.r_[0, np.cumsum(sizes)]


def align(e: Elements, inside: np.ndarray, ends: np.ndarray, asked: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, str, list[str], np.ndarray]]:
    """(scopes, key, values, confidences) of each key: the value that stands beside or below its label in a scope.

    ``inside`` are the elements of scopes, ``ends`` their bounds, and ``asked`` has for each key the scopes to look in. See
    ``reports.aligned_values`` for what a label and its value are.
    """
    inside_scope = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    keep = ~e.nowhere[inside]
    inside, inside_scope = inside[keep], inside_scope[keep]
    ends = np.searchsorted(inside_scope, np.arange(len(ends)))
    for key, scopes in asked.items():
        words = list(dict.fromkeys(w for w in re.split(r"[ \t\n\v\f\r]+", re.sub("[-:]", " ", key)) if w))
        if len(words) > 64:
            raise ValueError("a key of more than 64 words")
        said = np.zeros(len(e.texts), np.uint64)
        for bit, word in enumerate(words):
            said |= e.holding(word).astype(np.uint64) << np.uint64(bit)
        wanted = np.zeros(len(ends) - 1, bool)
        wanted[scopes] = True
        found = np.flatnonzero((said > 0)[e.text[inside]] & wanted[inside_scope])
        if not len(found):
            continue
        scope, loss, member, at = _labels(e, key, words, inside[found], inside_scope[found], said)
        if not len(scope):
            continue
        label = member[at[:-1]]
        own = [e.behind_colon(t) for t in e.text[label].tolist()]
        right, top, bottom = np.fmax.reduceat(e.x1[member], at[:-1]), np.minimum.reduceat(e.y0[member], at[:-1]), np.maximum.reduceat(e.y1[member], at[:-1])
        # Only labels without a value of their own look around.
        looks = np.flatnonzero(np.fromiter((o is None for o in own), bool, len(own)))
        of, place = _each((ends[scope[looks] + 1] - ends[scope[looks]]))
        other, of = inside[ends[scope[looks]][of] + place], looks[of]
        x0, y0, x1, y1 = e.x0[other], e.y0[other], e.x1[other], e.y1[other]
        level = (np.minimum(y1, bottom[of]) - np.maximum(y0, top[of]) > 0) | ((y0 >= top[of]) & (y1 <= bottom[of]))
        beside = (x0 >= right[of] - 5) & level & ~e.mark[e.text[other]] & ~e.silent[other] & ~e.unnumbered[other]
        for k in range(int(np.diff(at).max())):
            has = at[of] + k < at[of + 1]
            used = member[np.minimum(at[of] + k, len(member) - 1)]
            beside &= ~(has & ((e.seq[used] == e.seq[other]) | e.unnumbered[used]))
        values: list[str | None] = list(own)
        share = np.full(len(own), 0.98)
        rows, cells = of[beside], other[beside]
        if len(rows):
            edges = np.full(len(own), np.inf)
            np.minimum.at(edges, rows, e.x0[cells])
            near = e.x0[cells] - edges[rows] < 30
            rows, cells = rows[near], cells[near]
            order = np.lexsort((e.rank[e.text[cells]], e.seq[cells], e.x0[cells], e.y0[cells], rows))
            rows, cells = rows[order], cells[order]
            begin = _starts(rows)
            heads = e.value[e.text[cells[begin]]].tolist()
            for i, (row, head, a, b) in enumerate(zip(rows[begin].tolist(), heads, begin.tolist(), np.r_[begin[1:], len(rows)].tolist(), strict=True)):
                if b - a > 1:
                    heads[i] = head = " ".join(t for t in (head, *e.trimmed[e.text[cells[a + 1 : b]]]) if t)
                if head:
                    values[row] = head
            share[rows[begin]] = np.minimum(np.maximum(-loss[rows[begin]] / (len(words) * 100.0), 0.5), 0.99)
        tag = label[of]
        under = (y0 >= e.y1[tag]) & (y0 <= e.y1[tag] + 15) & (x0 < e.x1[tag]) & (x1 > e.x0[tag]) & (y1 - y0 < (e.y1[tag] - e.y0[tag]) * 2.2)
        rows, cells = of[under], other[under]
        begin = _starts(rows)
        for row, below in zip(rows[begin].tolist(), e.value[e.text[cells[begin]]].tolist(), strict=True):
            if values[row] is None and below:
                values[row], share[row] = below, 0.85
        known = np.fromiter((v is not None for v in values), bool, len(values))
        yield scope[known], key, [v for v in values if v is not None], share[known]


def parts(batch: pa.RecordBatch, name: str = "elements", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose arrays have about ``most`` elements together."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(lengths) - lengths) // (most or ELEMENTS)
    bounds = np.r_[_starts(piece), len(piece)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)
