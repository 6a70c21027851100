"""Benchmark decontamination by CGK embeddings and bit-sampling LSH (operator 7).

A random walk copies a string into a longer one: at each step the current symbol is written and
a random bit, drawn for the pair (step, symbol), says whether to move on.  Strings at a small
edit distance fall back into step after each edit, so their embeddings differ in few places:
edit distance has become Hamming distance.  Tables that sample places of the embedding then
bring windows of the documents together with the items of like size.  They are repeated until
mutated copies (AIM edits) of a size class's own items reach the target recall, and each pair that
they bring up is decided by its exact edit distance (the item against any part of the window).  A
class that reports that it can't reach the target with TABLES tables is handed to an exact join on
Q-grams as well: all places where a text and an item share a quarter of the grams that EDITS must
leave (``shared``), so no occurrence within EDITS is lost there where EDITS leave a gram at all.

Windows start at words and wherever an item gram found in the text puts the item's start (its place
less its offset in the item), whatever precedes it: texts without spaces, markup, glued prefixes.
There is one window for each size class of items; it is embedded where it holds at least ``need``
grams of items, and that filter counts in the recall that the tables must reach.  Items under
LEAST_ITEM bytes are too short for either and are matched exactly, at word bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, slices, stage, worker_cache
from pagefold.llm.shingles import _LOWER, _SPACE, column_bytes, mix, powers

#: Edits (share of an item's length) of which the gram join loses nothing, for which the recall of the
#: tables is set, and up to which a match counts.
EDITS, AIM, ACCEPT, RECALL = 0.08, 0.12, 0.2, 0.97
#: Bytes of a gram; least bytes of an item that is looked for with edits (shorter ones: exactly);
#: ratio of the size classes; places that a table samples, and the stretch of the walk they come
#: from (strings in step at one place mostly are at the next, so near places cost little recall);
#: tables at most; walks; mutated copies of a size class.
Q, LEAST_ITEM, CLASS, SAMPLED, STRETCH, TABLES, WALKS, COPIES = 10, 24, 1.25, 8, 16, 128, 2, 200
#: Bytes of items held against the documents at a time; more items take further passes.
BLOCK_BYTES = 8 << 20
_BASE = 0xA24BAED4963EE407
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(31).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(32).integers(1 << 62, 1 << 63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Letters, digits and all bytes beyond ASCII.
_WORD = np.array([chr(c).isalnum() or c > 127 for c in range(256)])


def grams(raw: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the ``q`` bytes at each position."""
    if len(raw) < q:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers(_BASE, len(raw)), dtype=np.uint64)))
    return mix((sums[q:] - sums[:-q]) * powers(_INVERSE, len(raw) - q + 1))


def _short(raw: np.ndarray, q: int) -> np.ndarray:
    """Each gram of ``q`` bytes as a number of 16 bits (different grams may have the same)."""
    out = np.zeros(max(0, len(raw) - q + 1), np.uint32)
    for i in range(q):
        out = out * np.uint32(0x9E3779B1) + raw[i:i + len(out)] + np.uint32(1)
    return out * np.uint32(0x85EBCA6B) >> np.uint32(16)


def walk(strings: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embedding of the rows (zeros behind their ends) in ``steps`` symbols."""
    moves = np.random.default_rng(seed).integers(0, 2, (steps, 256), dtype=np.int64)
    n, width = strings.shape
    at = np.arange(n) * width
    last = at + width - 1
    flat = strings.ravel()
    out = np.empty((steps, n), np.uint8)
    for t in range(steps):
        np.take(flat, at, out=out[t], mode="clip")
        at += np.take(moves[t], out[t])
        if t >= width - 2:  # no walk leaves its string before
            np.minimum(at, last, out=at)
    return out


def edit_distance(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text`` and where the first such part ends
    (bit-parallel over the item); ``most + 1`` where it is more than ``most``."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    has: dict[int, int] = {}
    for i, c in enumerate(item):
        has[c] = has.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)  # against no text at all
    for j, c in enumerate(text):
        eq = has.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(h | up)), up & h
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(x | ph)), ph & x
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Items of like size with their LSH tables.

    ``tables`` (a number, or one for each size class) and ``joined`` (whether a class takes the gram join
    too) are measured where they are not given."""

    def __init__(self, items: list[tuple[int, bytes]], tables: int | list[int] | None = None, joined: list[bool] | None = None) -> None:
        ordered = sorted(((i, bytes(_LOWER[np.frombuffer(t, np.uint8)])) for i, t in items), key=lambda x: (len(x[1]), x[0]))
        self.items = items = [x for x in ordered if len(x[1]) >= LEAST_ITEM]
        #: short items by length: hashes in order, and which items have each
        self.brief_items = [x for x in ordered if len(x[1]) < LEAST_ITEM and _WORD[np.frombuffer(x[1], np.uint8)].any()]
        self.brief: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in sorted({len(t) for _, t in self.brief_items}):
            table: dict[int, list[int]] = {}
            for i, (_, t) in enumerate(self.brief_items):
                if len(t) == size:
                    table.setdefault(int(grams(np.frombuffer(t, np.uint8), size)[0]), []).append(i)
            self.brief[size] = np.array(sorted(table), np.uint64), [table[k] for k in sorted(table)]
        raws = [np.frombuffer(t, np.uint8) for _, t in items]
        self.bits = 16
        known = np.concatenate([grams(r) for r in raws]) if raws else np.zeros(0, np.uint64)
        while 1 << self.bits < 32 * len(known):
            self.bits += 1
        self.gram = np.zeros(1 << self.bits, bool)
        self.gram[(known >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        # where each gram stands in the items: ``holder`` and ``offset`` at ``first[g]:first[g + 1]`` for the g-th gram
        holder = np.repeat(np.arange(len(raws)), [max(0, len(r) - Q + 1) for r in raws])
        offset = np.concatenate([np.arange(max(0, len(r) - Q + 1)) for r in raws]) if raws else np.zeros(0, np.int64)
        order = np.argsort(known, kind="stable")
        self.known, first = np.unique(known[order], return_index=True)
        self.first, self.holder, self.offset = np.append(first, len(known)), holder[order], offset[order]
        #: all (item, gram) in one number; per item the grams that a window must share with it
        self.held = np.unique(self.holder * len(self.known) + np.repeat(np.arange(len(self.known)), np.diff(self.first)))
        self.maybe_held = np.zeros(1 << 22, bool)
        self.maybe_held[self._cell(self.held)] = True
        several = np.bincount(self.held // max(1, len(self.known)), minlength=len(raws))
        self.enough = np.minimum([self.need(len(r)) for r in raws], several) if raws else several
        #: per item: grams that a place of the join must share with it, and the width of a band of diagonals
        self.shared = np.array([-(-max(1, len(r) - Q + 1 - Q * int(EDITS * len(r))) // 4) for r in raws], np.int64)
        self.band = np.array([max(1, 2 * int(ACCEPT * len(r))) for r in raws], np.int64)
        sizes = np.array([len(t) for _, t in items], np.int64)
        self.classes = []
        a = 0
        while a < len(items):
            b = int(np.searchsorted(sizes, int(sizes[a] * CLASS), "right"))
            self.classes.append((a, b, int(sizes[a]), int(sizes[b - 1])))
            a = b
        #: by size class
        self.tables, self.joined = [tables] * len(self.classes) if isinstance(tables, int) else tables, joined
        if self.tables is None or joined is None:
            first = self._first()
            self.tables = self.tables or [next((n for n in (8, 16, 32, 64) if np.mean(f < n) >= RECALL), TABLES) for f in first]
            self.joined = [bool(np.mean(f < n) < RECALL) for f, n in zip(first, self.tables)]
        self.item_joined = np.repeat(np.array(self.joined, bool), [b - a for a, b, _, _ in self.classes])
        self.lookup = []
        for (a, b, least, most), count in zip(self.classes, self.tables):
            keys = self.keys(self._rows(raws[a:b], most), least, count)
            table = {}
            for i in range(keys.shape[1]):
                for t in range(keys.shape[0]):
                    table.setdefault(int(keys[t, i]), []).append(a + i)
            held, known = [table[k] for k in sorted(table)], np.array(sorted(table), np.uint64)
            # most sampled keys are no item's: their first bits tell
            bits = min(22, (64 * len(known)).bit_length())
            mark = np.zeros(1 << bits, bool)
            mark[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.lookup.append((mark, known, np.cumsum([0, *map(len, held)]), np.array([i for x in held for i in x], np.int64)))

    @staticmethod
    def _rows(raws: list[np.ndarray], width: int) -> np.ndarray:
        out = np.zeros((len(raws), width + 1), np.uint8)
        for i, r in enumerate(raws):
            out[i, :min(width, len(r))] = r[:width]
        return out

    @staticmethod
    def _cell(code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * _FACTORS[0] >> np.uint64(42)).astype(np.int64)

    @staticmethod
    def need(size: int) -> int:
        """Item grams that a window must hold to be embedded, and share with an item of this size to be compared."""
        return max(1, (size - Q + 1) // 12)

    def keys(self, strings: np.ndarray, least: int, tables: int) -> np.ndarray:
        """Table keys (tables x rows): samples of places that the walk writes before the shortest item ends."""
        steps = max(STRETCH, int(1.6 * least))
        out = np.empty((tables, strings.shape[0]), np.uint64)
        sample = np.empty((strings.shape[0], SAMPLED), np.uint8)
        row = 0
        for w in range(WALKS):
            written = walk(strings, steps, 1000 + w)
            rng = np.random.default_rng(2000 + w)
            for t in range(w, tables, WALKS):
                for k, p in enumerate(rng.integers(0, steps - STRETCH + 1) + rng.choice(STRETCH, SAMPLED, replace=False)):
                    sample[:, k] = written[p]
                # the sampled bytes as one number, spread by another odd factor for each table
                np.multiply(sample.view(np.uint64)[:, 0], _FACTORS[t], out=out[row])
                row += 1
        return out

    def _first(self) -> list[np.ndarray]:
        """By size class, for each of COPIES mutated copies (AIM edits, spread at random) of its items the first
        table that brings the copy together with its item; TABLES where none does or too few grams are left."""
        rng = np.random.default_rng(9)
        out = []
        for a, b, least, most in self.classes:
            which = list(range(a, b, max(1, (b - a) // COPIES)))
            which *= -(-COPIES // len(which))
            own = [np.frombuffer(self.items[i][1], np.uint8) for i in which]
            copies = []
            for r in own:
                x = r.tolist()
                for _ in range(int(AIM * len(r))):
                    i, kind = int(rng.integers(0, len(x))), rng.integers(0, 3)
                    if kind == 0:
                        x[i] = int(r[rng.integers(0, len(r))])
                    elif kind == 1:
                        del x[i]
                    else:
                        x.insert(i, int(r[rng.integers(0, len(r))]))
                copies.append(np.array(x, np.uint8))
            same = self.keys(self._rows(own, most), least, TABLES) == self.keys(self._rows(copies, most), least, TABLES)
            enough = [len(np.intersect1d(grams(r), grams(c))) >= self.enough[i] for i, r, c in zip(which, own, copies)]
            same &= np.array(enough)
            # ``keys`` gives the tables walk by walk; table t of walk t % WALKS
            number = np.concatenate([np.arange(w, TABLES, WALKS) for w in range(WALKS)])
            out.append(np.array([int(number[c].min()) if c.any() else TABLES for c in same.T]))
        return out

    def alike(self, items: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which of the pairs of an item and the stretch of text from ``low`` to ``high`` share enough different grams
        (what chance brings up mostly has fewer), by the item grams (``slot``) at the places ``at``; an item of few
        different grams needs no more than these."""
        a, b = np.searchsorted(at, low), np.searchsorted(at, np.maximum(low, high))
        out = np.zeros(len(items), bool)
        for part in np.array_split(np.arange(len(items)), max(1, int((b - a).sum()) >> 20)):
            n = (b - a)[part]
            pair = np.repeat(part, n)
            gram = slot[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[part], n)]
            code = items[pair] * len(self.known) + gram
            own = self.maybe_held[self._cell(code)]
            own[own] = self.held[np.minimum(np.searchsorted(self.held, code[own]), len(self.held) - 1)] == code[own]
            share = np.unique(pair[own] * len(self.known) + gram[own]) // len(self.known)
            out[part] = np.bincount(share, minlength=len(items))[part] >= self.enough[items[part]]
        return out

    def starts(self, g: np.ndarray, hits: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Mark in ``begin`` where the items of the grams at ``hits`` would start (at a text's start, if before).

        Returns ``(text, item, from, to)`` for the items of joined classes: the starts around which a text shares
        enough grams with them."""
        slot = np.minimum(np.searchsorted(self.known, g[hits]), len(self.known) - 1)
        real = self.known[slot] == g[hits]
        hits, slot = hits[real], slot[real]
        text = np.searchsorted(ends, hits, "right") - 1
        several = self.first[slot + 1] - self.first[slot]
        total = np.cumsum(several)
        # cells of (text, item, band of diagonals), counted piece by piece
        ahead, n_items = max(len(t) for _, t in self.items), len(self.items)
        cells, counts, firsts, lasts = ([np.zeros(0, np.int64)] for _ in range(4))
        a = 0
        while a < len(hits):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 20), "right")))
            n = several[a:b]
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[slot[a:b]], n)
            of, item = np.repeat(text[a:b], n), self.holder[which]
            start = np.repeat(hits[a:b], n) - self.offset[which]
            begin[np.maximum(start, ends[of])] = True
            a = b
            use = self.item_joined[item]
            if not use.any():
                continue
            of, item, start = of[use], item[use], start[use]
            cell = (of * n_items + item) << 30 | (start - ends[of] + ahead) // self.band[item]
            order = np.argsort(cell, kind="stable")
            cell, at, count = np.unique(cell[order], return_index=True, return_counts=True)
            cells.append(cell)
            counts.append(count)
            firsts.append(np.minimum.reduceat(start[order], at))
            lasts.append(np.maximum.reduceat(start[order], at))
        cell = np.concatenate(cells)
        if not len(cell):
            return []
        order = np.argsort(cell, kind="stable")
        cell, at = np.unique(cell[order], return_index=True)
        both = np.add.reduceat(np.concatenate(counts)[order], at)
        low = np.minimum.reduceat(np.concatenate(firsts)[order], at)
        high = np.maximum.reduceat(np.concatenate(lasts)[order], at)
        next_one = np.flatnonzero(cell[1:] == cell[:-1] + 1)
        both[next_one], high[next_one] = both[next_one] + both[next_one + 1], high[next_one + 1]
        item = (cell >> 30) % n_items
        enough = both >= self.shared[item]
        return list(zip(*(x[enough].tolist() for x in ((cell >> 30) // n_items, item, low, high))))

    def decide(self, raw: np.ndarray, ends: np.ndarray, d: int, i: int, low: int, high: int, found: dict) -> None:
        """Put the best occurrence of item ``i`` that starts about ``low`` to ``high`` in text ``d`` into ``found``, if
        it is within ACCEPT and better than what is there."""
        item, best = self.items[i][1], found.get((d, i))
        limit = int(ACCEPT * len(item))
        lo, hi = max(int(ends[d]), low - limit), min(int(ends[d + 1]), high + len(item) + limit)
        region = raw[lo:hi].tobytes()
        if (exact := region.find(item)) >= 0:
            if not best or (0, lo + exact) < (best[2], best[0]):
                found[d, i] = (lo + exact, lo + exact + len(item), 0)
            return
        # as few grams of three or four bytes as these can't be an occurrence
        for q in (4, 3):
            mark = np.zeros(1 << 16, bool)
            mark[_short(raw[lo:hi], q)] = True
            if mark[_short(np.frombuffer(item, np.uint8), q)].sum() < len(item) - q + 1 - q * limit:
                return
        distance, end = edit_distance(item, region, limit)
        if distance <= limit and (not best or distance < best[2]):
            back, length = edit_distance(item[::-1], raw[lo:lo + end][::-1].tobytes(), limit)
            found[d, i] = (lo + end - length, lo + end, distance)

    def matches(self, raw: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, start, end, distance)``: per text and item the best occurrence found."""
        raw = _LOWER[raw]
        out = self.exact(raw, ends) if self.brief else []
        g = grams(raw)
        if len(g) and self.items:
            out += self.edited(raw, ends, g)
        return sorted(out)

    def exact(self, raw: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """First occurrence of each short item between word bounds: neither end cuts through a word."""
        inside = np.zeros(len(raw) + 1, bool)
        inside[1:-1] = _WORD[raw[1:]] & _WORD[raw[:-1]]
        inside[ends] = False
        found: dict[tuple[int, int], int] = {}
        for size, (keys, lists) in self.brief.items():
            g = grams(raw, size)
            slot = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            at = np.flatnonzero((keys[slot] == g) & ~inside[:len(g)] & ~inside[size:size + len(g)])
            text = np.searchsorted(ends, at, "right") - 1
            whole = at + size <= ends[text + 1]
            for p, d in zip(at[whole].tolist(), text[whole].tolist()):
                for i in lists[slot[p]]:
                    if raw[p:p + size].tobytes() == self.brief_items[i][1]:
                        found.setdefault((d, i), p)
        return [(d, self.brief_items[i][0], p - int(ends[d]), p - int(ends[d]) + len(self.brief_items[i][1]), 0) for (d, i), p in found.items()]

    def edited(self, raw: np.ndarray, ends: np.ndarray, g: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``matches`` of the items of LEAST_ITEM bytes and more."""
        maybe = np.flatnonzero(self.gram[(g >> np.uint64(64 - self.bits)).astype(np.int64)])
        slot_of = np.minimum(np.searchsorted(self.known, g[maybe]), len(self.known) - 1)
        maybe, slot_of = maybe[self.known[slot_of] == g[maybe]], slot_of[self.known[slot_of] == g[maybe]]
        hit = np.zeros(len(raw) + 1, np.int32)
        hit[maybe + 1] = 1
        count = np.cumsum(hit, dtype=np.int32)
        space = _SPACE[raw]
        begin = ~space
        begin[1:] &= space[:-1]
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True
        begin |= first[:-1]
        # only grams that have as many others around them as a window must hold
        reach = max(most + int(ACCEPT * most) for _, _, _, most in self.classes)
        asked = min(self.need(least) for _, _, least, _ in self.classes)
        if self.item_joined.any():
            asked = min(asked, int(self.shared[self.item_joined].min()))
        at = np.flatnonzero(hit[1:])
        dense = count[np.minimum(at + reach + 1, len(raw))] - count[np.maximum(at - reach, 0)] >= asked
        places = self.starts(g, at[dense], ends, begin)
        begin = np.flatnonzero(begin)
        text = np.searchsorted(ends, begin, "right") - 1
        stop = ends[text + 1]
        padded = np.concatenate((raw, np.zeros(self.classes[-1][3] + 1, np.uint8)))
        sizes = np.array([len(t) for _, t in self.items], np.int64)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        # the last start that was looked at, and all stretches of starts
        done: dict[tuple[int, int], int] = {}
        looked: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (a, b, least, most), count_tables, (mark, keys, offsets, lists) in zip(self.classes, self.tables, self.lookup):
            slack = int(ACCEPT * most)
            room = np.minimum(begin + most + slack - Q + 1, np.maximum(begin, stop - Q + 1))
            need = self.need(least)
            # a start of the item that was edited away moves the first word start back or forth a little
            starts = np.flatnonzero((count[room] - count[begin] >= need) & (stop - begin >= least - int(ACCEPT * least)))
            for part in np.array_split(starts, max(1, len(starts) // 4096)):
                if not len(part):
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(padded, most + 1)[begin[part]]
                windows[:, most] = 0
                room_in = stop[part] - begin[part]
                ended = np.flatnonzero(room_in < most)
                windows[ended] *= np.arange(most + 1) < room_in[ended, None]
                sampled = self.keys(windows, least, count_tables)
                t, w = np.nonzero(mark[(sampled >> np.uint64(65 - len(mark).bit_length())).astype(np.int64)])
                lists_at = np.minimum(np.searchsorted(keys, sampled[t, w]), len(keys) - 1)
                real = keys[lists_at] == sampled[t, w]
                w, lists_at = w[real], lists_at[real]
                if not len(w):
                    continue
                several = offsets[lists_at + 1] - offsets[lists_at]
                which = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several) + np.repeat(offsets[lists_at], several)
                pair = np.unique(np.repeat(part[w], several) * len(self.items) + lists[which])
                x, of = pair // len(self.items), pair % len(self.items)
                reach_of = np.minimum(stop[x], begin[x] + sizes[of] + (ACCEPT * sizes[of]).astype(np.int64)) - Q + 1
                good = self.alike(of, begin[x], reach_of, maybe, slot_of)
                for x, i in zip(x[good].tolist(), of[good].tolist()):
                    d, at, item = int(text[x]), int(begin[x]), self.items[i][1]
                    best = found.get((d, i))
                    if best and best[2] == 0 or at <= done.get((d, i), -1):
                        continue
                    limit = int(ACCEPT * len(item))
                    self.decide(raw, ends, d, i, at, at + limit, found)
                    done[d, i] = at + limit
                    looked.setdefault((d, i), []).append((at, at + limit))
        for d, i, low, high in places:
            seen = looked.setdefault((d, i), [])
            if any(x <= low and high <= y for x, y in seen):
                continue
            seen.append((low, high))
            best = found.get((d, i))
            if not best or best[2] or best[0] > low:
                self.decide(raw, ends, d, i, low, high, found)
        return [(d, self.items[i][0], s - int(ends[d]), e - int(ends[d]), k) for (d, i), (s, e, k) in sorted(found.items())]


def item_blocks(items: DataFrame) -> list[list[tuple[int, bytes]]]:
    """Distinct items of one byte or more in blocks of BLOCK_BYTES, read through the driver one block at a time."""
    rows = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
            .filter(F.octet_length("text") > 0).groupBy("text").agg(F.min("item_id").alias("item_id")))
    block, size = [], 0
    for r in rows.orderBy("item_id").toLocalIterator():
        block.append((r.item_id, bytes(r.text)))
        size += len(r.text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, end, distance)``: for each document and item the best occurrence found
    within ACCEPT edits, as byte offsets in the text (letters A-Z count as a-z).

    Null and empty texts and items hold and match nothing; equal items count under their smallest
    id; items under LEAST_ITEM bytes count where they stand as they are between word bounds (never, if they
    hold no letter or digit); repeated documents are each searched; texts
    of any length are searched whole; of equal distances the first occurrence counts.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start long, end long, distance int"
    out = spark.createDataFrame([], schema)
    for number, block in enumerate(item_blocks(items)):
        # how many tables, and for which classes the join, is settled here, once; tasks build the tables from the items
        index = Index(block)
        shared = spark.sparkContext.broadcast((block, index.tables, index.joined))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            # a worker holds the index of one block at a time
            held, key = worker_cache("cgk", dict), (number, hash(tuple(shared.value[0])))
            if key not in held:
                held.clear()
                held[key] = Index(*shared.value)
            index = held[key]
            for batch in batches:
                for part in slices(batch, "text", 2 << 20):
                    ids = part.column("doc_id").to_pylist()
                    rows = index.matches(*column_bytes(part.column("text")))
                    if rows:
                        d, i, s, e, k = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[x] for x in d], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64()),
                             pa.array(e, pa.int64()), pa.array(k, pa.int32())], ["doc_id", "item_id", "start", "end", "distance"])

        found = docs.mapInArrow(frugal(run), schema)
        out = found if number == 0 else out.unionAll(found)
    return out


def clean(docs: DataFrame, items: DataFrame, least: int = LEAST_ITEM) -> DataFrame:
    """``docs`` without the documents in which an item of ``least`` bytes or more was found; all columns as they
    were.  Shorter items ("yes", "in 1848") are reported by ``find``, but a document that holds one is not leaked."""
    hit = stage(find(docs, items.filter(F.octet_length(F.col("text").cast("binary")) >= least)).select("doc_id").distinct(), "decontaminate-hits")
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)
