"""Held-out items that stand, wholly or partly, in documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.folding import BREAK, DROP, folded_codes, repaired, words
from millrace.tables import spread, written

#: Letters in a q-gram; spaces don't count, so broken lines and words don't matter.
Q = 8
#: Diagonals in a band; neighbouring bands overlap by half.
BAND = 64
#: Common q-grams that a band must hold. Words wholly in runs of them: so many in a stretch of a band with no more than so many words between runs, and in all
#: for a document and an item to be aligned.
LEAST_BAND, BAND_WORDS, STRETCH_GAP, PAIR_WORDS = 16, 6, 8, 18
#: Counters of bands, one for each if there are enough, else by hash (a shared one only lets more through), and hits looked at in one go.
COUNTERS, SLICE = 1 << 22, 4_000_000
#: Words of an item that a document must repeat, and words that one passage must have to count.
LEAST_WORDS, LEAST_PASSAGE = 25, 8
#: Between passages shorter than LEAST_WORDS: runs of FORMULA words that stand alone in different texts, as many as this share of the documents (and 5), are formulas.
FORMULA, FORMULA_SHARE, FORMULA_DOCS = (7, 20), 0.0005, 5
#: Items in one index; more of them go through the documents in several blocks.
BLOCK = 5_000
#: Characters folded at a time.
CHUNK = 400_000

_P = np.uint64(0x9E3779B97F4A7C15)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of Q codes, by doubling."""
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * _P
        n, factor = 1, _P
        while n < Q:
            h = h[:-n] * factor + h[n:]
            factor = factor * factor
            n *= 2
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


assert Q & (Q - 1) == 0, "windows are built by doubling"


class ItemIndex:
    """The q-grams of the items: sorted hashes, found by their upper bits, with their (item, letter) places."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words(t or "") for _, t in items]
        letters = ["".join(w) for w in self.words]
        hashes, of, at = [], [], []
        for k, s in enumerate(letters):
            if len(s) >= Q:
                h = _qgrams(np.frombuffer(s.encode("utf-32-le"), np.uint32))
                hashes.append(h)
                of.append(np.full(len(h), k))
                at.append(np.arange(len(h)))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.array([], t)
        h, of, at = join(hashes, np.uint64), join(of, np.int32), join(at, np.int32)
        order = np.argsort(h, kind="stable")
        self.item, self.at = of[order], at[order]
        self.hash, self.start = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(h)))
        # where the hashes with the same upper bits begin
        self.bits = max(16, min(24, int(np.log2(max(1, len(self.hash)))) + 4))
        upper = np.bincount((self.hash >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.most = int(upper.max())
        self.bucket = np.append(0, np.cumsum(upper)).astype(np.int32)
        # word number of each letter, and the letter each word starts at
        self.starts = [np.cumsum([0, *map(len, w)]) for w in self.words]
        # per place in an item: the first word that starts there or later, and the words that end there or before
        places = [np.arange(x[-1] + 1) for x in self.starts]
        self.base = np.cumsum([0, *map(len, places)])
        self.first_word = join([np.searchsorted(x, p, side="left") for x, p in zip(self.starts, places, strict=True)], np.int64)
        self.last_word = join([np.searchsorted(x, p, side="right") - 1 for x, p in zip(self.starts, places, strict=True)], np.int64)
        # item and place in one number; 2**32 keeps the diagonal above 0
        self.key = (self.item.astype(np.uint64) << np.uint64(36)) - self.at.astype(np.uint64) + np.uint64(1 << 32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``hashes`` that are q-grams of an item, and their numbers."""
        if not len(self.hash):
            return np.array([], np.int64), np.array([], np.int64)
        upper = (hashes >> np.uint64(64 - self.bits)).view(np.int64)
        number, end = self.bucket[upper], self.bucket[upper + 1]
        at = np.flatnonzero(number < end)
        number, end, own = number[at], end[at], hashes[at]
        ok = self.hash[number] == own
        for _ in range(1, self.most):  # of the few that share their upper bits
            rest = np.flatnonzero(~ok & (number + 1 < end))
            if not len(rest):
                break
            number[rest] += 1
            ok[rest] = self.hash[number[rest]] == own[rest]
        return at[ok], number[ok]


def aligned_words(item: list[str], doc: list[str], diagonal: int, band: int) -> list[tuple[int, int]]:
    """Banded alignment, local in both: the (item, document) places of equal words on the best path whose diagonal (document minus item place) stays within ``band`` of
    ``diagonal``. A match gives 2, an edit (a word left out, put in or changed) costs 1.

    It doesn't matter where the document breaks words or runs them together: where it may do so the item's words are laid on its letters, else on its words, which gives the same and is faster."""
    if not item or not doc:
        return []
    return _on_letters(item, doc, diagonal, band) if _broken(item, doc) else _on_words(item, doc, diagonal, band)


def _broken(item: list[str], doc: list[str]) -> bool:
    """Whether the document may hold words of the item in pieces or run together: a strange word of it that, alone or with a neighbour, is several words of the item together; two
    neighbours that are a word of the item together; or, with a strange one, the beginning of one (which has more pieces)."""
    known, letters = set(item), "".join(item)
    borders: set[int] = set()

    def whole(x: str, begins: bool) -> bool:
        """Whether ``x`` stands in the item's letters from the start of a word to the end of one, or ``begins`` a word."""
        at = letters.find(x)
        while at >= 0:
            if not borders:
                borders.update(accumulate(map(len, item), initial=0))
            if at in borders and (at + len(x) in borders or (begins and not any(at < k < at + len(x) for k in borders))):
                return True
            at = letters.find(x, at + 1)
        return False

    before, strange_before = None, False
    for w in doc:
        strange = w not in known
        if before is not None:
            both = before + w
            if both in known or ((strange or strange_before) and both in letters and whole(both, True)):
                return True
        if strange and len(w) > 3 and w in letters and whole(w, False):
            return True
        before, strange_before = w, strange
    return False


def _on_words(item: list[str], doc: list[str], diagonal: int, band: int) -> list[tuple[int, int]]:
    """The alignment over the places where a word of the item is one of the document. Each takes the best of those before it in both; one that follows on its diagonal is always the best."""
    places: dict[str, list[int]] = {}
    for k, w in enumerate(doc):
        places.setdefault(w, []).append(k)
    score: dict[tuple[int, int], tuple[int, tuple[int, int] | None]] = {}
    rows: list[tuple[int, list[tuple[int, int]], int]] = []  # with the best score up to there
    best, best_at = 0, None
    for i, w in enumerate(item):
        row = []
        for k in places.get(w, ()):
            if not -band <= k - i - diagonal <= band:
                continue
            if follows := score.get((i - 1, k - 1)):
                top, came = follows[0], (i - 1, k - 1)
            else:
                top, came = 0, None
                for j, earlier, upto in reversed(rows):
                    skipped = i - j - 1
                    if upto - skipped <= top:  # no path to there or farther back is worth more
                        break
                    for at, s in earlier:
                        if at < k and s - max(skipped, k - at - 1) > top:
                            top, came = s - max(skipped, k - at - 1), (j, at)
            score[(i, k)] = top + 2, came
            row.append((k, top + 2))
            if top + 2 > best:
                best, best_at = top + 2, (i, k)
        if row:
            rows.append((i, row, best))
    out = []
    while best_at is not None:
        out.append(best_at)
        best_at = score[best_at][1]
    return out[::-1]


def _on_letters(item: list[str], doc: list[str], diagonal: int, band: int) -> list[tuple[int, int]]:
    """The alignment over the document's letters: a match starts where a word of the document starts or the item's word before matches, and ends likewise; its place is that of the word in which it starts."""
    letters = np.frombuffer("".join(doc).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *map(len, doc)])
    n = len(letters)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    of = np.cumsum(edge) - 1
    of[-1] = len(doc)
    # skipping from one letter to another costs the words that start between them
    skipped = np.append(0, np.cumsum(edge[:-1]))
    text = letters.tobytes().decode("utf-32-le")
    found: dict[str, np.ndarray] = {}
    for w in item:
        if w not in found:
            at, k = [], text.find(w)
            while k >= 0:
                at.append(k)
                k = text.find(w, k + 1)
            found[w] = np.array(at, np.int64)
    none = np.array([], np.int64)
    matches = []
    for i, w in enumerate(item):
        at = found[w]
        if len(at):
            begins, ends = edge[at], edge[at + len(w)]
            if i and len(found[item[i - 1]]) and not begins.all():
                begins = begins | np.isin(at, found[item[i - 1]] + len(item[i - 1]))
            if i + 1 < len(item) and not ends.all():
                ends = ends | np.isin(at + len(w), found[item[i + 1]])
            at = at[begins & ends & (np.abs(of[at] - i - diagonal) <= band)]
        matches.append(at if len(at) else none)
    # per item word the scores at each letter, before and after skipping words of the document
    score, rows = np.zeros(n + 1, np.int64), []
    best, best_at = 0, (-1, 0)
    for i, w in enumerate(item):
        row = score - 1
        row[starts[1:]] = np.maximum(row[starts[1:]], score[starts[:-1]] - 1)
        at = matches[i]
        if len(at):
            row[at + len(w)] = np.maximum(row[at + len(w)], score[at] + 2)
        after = np.maximum(np.maximum.accumulate(row + skipped) - skipped, 0)
        if len(at) and (top := int(after[at + len(w)].max())) > best:
            best, best_at = top, (i, int(at[np.argmax(after[at + len(w)])]) + len(w))
        rows.append((score, row))
        score = after
    out = []
    i, k = best_at
    while i >= 0:
        before, row = rows[i]
        value = int(np.max(row[: k + 1] + skipped[: k + 1]) - skipped[k])
        if value <= 0:
            break
        k = int(np.flatnonzero(row[: k + 1] + skipped[: k + 1] - skipped[k] == value)[-1])
        w, at = item[i], k - len(item[i])
        if at >= 0 and row[k] == before[at] + 2 and at in matches[i]:
            out.append((i, int(of[at])))
            k = at
        elif row[k] != before[k] - 1:  # one word for another
            k = int(starts[of[k] - 1])
        i -= 1
    return out[::-1]


def passages(item: list[str], doc: list[str], regions: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Passages (first and last item word, words equal) in the item's order, from regions (first and last item word, document words from, to) that
    the filter kept. Each region is aligned in its band; of passages over the same item words the longest stays. None at all where they can't have LEAST_WORDS together:
    a region has no more equal words than item words that its part of the document holds."""
    windows = []
    for a, b, c, d in regions:
        a, b = max(0, a - 6), min(len(item), b + 7)
        c, d = max(0, c - 8), min(len(doc), d + 9)
        own = set(doc[c:d])
        most = sum(w in own for w in item[a:b])
        if most < b - a and _broken(item[a:b], doc[c:d]):
            most = b - a
        if most >= LEAST_PASSAGE:
            windows.append((most, a, b, c, d))
    ahead, found = sum(w[0] for w in windows), []
    for most, a, b, c, d in sorted(windows, reverse=True):
        if sum(f[2] for f in found) + ahead < LEAST_WORDS:
            return []
        ahead -= most
        pairs = aligned_words(item[a:b], doc[c:d], 0, max(8, abs((d - c) - (b - a)) + 4) + BAND // 4)
        run: list[tuple[int, int]] = []
        for p in [*pairs, (1 << 30, 1 << 30)]:
            if run and (p[0] - run[-1][0] > 4 or p[1] - run[-1][1] > 24):
                if len(run) >= LEAST_PASSAGE:
                    found.append((a + run[0][0], a + run[-1][0], len(run), c + run[0][1], c + run[-1][1]))
                run = []
            run.append(p)
    found.sort(key=lambda x: -x[2])
    kept: list[tuple[int, int, int, int, int]] = []
    for p in found:
        if all((p[1] < k[0] and p[4] <= k[3]) or (p[0] > k[1] and p[3] >= k[4]) for k in kept):
            kept.append(p)
    return [k[:3] for k in sorted(kept)]


def _marks(hashes: np.ndarray, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number per text from the least of its q-grams under two orders: equal for copies, mostly equal for corrected reissues, and for
    other texts only by what they share of both."""
    with np.errstate(over="ignore"):
        across = np.zeros(len(hashes), bool)  # q-grams over the end of a text
        over = np.flatnonzero(letters == BREAK)[:, None] - np.arange(Q)
        across[over[(over >= 0) & (over < len(hashes))]] = True
        own = np.minimum(first, len(hashes) - 1)
        a, b = (np.minimum.reduceat(np.where(across, ~np.uint64(0), hashes * np.uint64(k)), own) for k in (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
        return (a * _P ^ b).view(np.int64)


def _reached(group: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of intervals ordered by group and start: how far those before reach (far below 0 if a group starts), and how much each adds to them."""
    lift = group.astype(np.int64) << 32
    reach = np.append(-(1 << 31), np.maximum.accumulate(lift + end)[:-1])[: len(lift)] - lift
    return reach, np.maximum(0, end - np.maximum(first, reach))


class Scanner:
    """Candidates of one partition, and the short runs of item words that stood alone, with marks of the texts they stood in."""

    def __init__(self, index: ItemIndex):
        self.index = index
        self.alone: list[tuple[int, int, int, int]] = []
        self.docs = 0

    def chunk(self, ids: list[int], texts: list[str]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        self.docs += len(ids)
        whole = [repaired(t) for t in texts]
        gap = "\n" * Q
        codes = folded_codes(gap.join(whole))
        # letters only; between two documents one break, which no q-gram of an item holds
        lengths = np.array([len(t) for t in whole])
        bounds = np.cumsum(lengths + Q) - Q
        is_letter = codes > DROP
        is_letter[bounds[:-1]] = True
        kept = np.flatnonzero(is_letter)
        letters = codes[kept]
        if len(letters) < Q:
            return []
        hashes = _qgrams(letters)
        at, number = self.index.places(hashes)
        if not len(at):
            return []
        item, diagonal, place = self._dense(at, number, len(letters))
        if not len(place):
            return []
        starts = np.append(0, bounds[:-1] + Q)
        # the document of each letter, by number; the order is that of item, diagonal and place
        upto = np.append(np.searchsorted(kept, starts), len(kept))
        doc = np.repeat(np.arange(len(starts)), np.diff(upto))[diagonal + place]
        # runs on one diagonal
        new = np.ones(len(place), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] - place[:-1] > Q)
        s = np.flatnonzero(new)
        size = np.diff(np.append(s, len(place)))
        r_doc, r_item, r_from, r_diag = doc[s], item[s], place[s], diagonal[s]
        r_to = place[s + size - 1] + Q
        # the words of each run; then the different words of each stretch of runs, for both bands that hold a diagonal
        w_from = self.index.first_word[self.index.base[r_item] + r_from]
        w_to = self.index.last_word[self.index.base[r_item] + r_to]
        ok = w_to > w_from
        r_doc, r_item, r_from, r_to, r_diag, w_from, w_to = (x[ok] for x in (r_doc, r_item, r_from, r_to, r_diag, w_from, w_to))
        pair = r_doc * len(self.index.ids) + r_item
        band = np.floor_divide(r_diag, BAND // 2)
        hits = np.zeros(len(pair), np.int64)
        for shift in (0, -1):
            key = pair * (1 << 30) + np.floor_divide(band + shift, 2) * 2 - shift + (1 << 28)
            order = np.lexsort((w_from, key))
            reach, new_words = _reached(np.cumsum(np.append(False, np.diff(key[order]) > 0)), w_from[order], w_to[order])
            stretch = np.cumsum(w_from[order] - reach > STRETCH_GAP)
            hits[order] = np.maximum(hits[order], np.bincount(stretch, new_words)[stretch].astype(np.int64))
        ok = hits >= BAND_WORDS
        r_item, r_from, r_to, r_diag, pair, w_from, w_to = (x[ok] for x in (r_item, r_from, r_to, r_diag, pair, w_from, w_to))
        # a pair stays if its bands together hold enough different words of the item
        u, inverse = np.unique(pair, return_inverse=True)
        by_pair = np.lexsort((w_from, inverse))
        _, new_words = _reached(inverse[by_pair], w_from[by_pair], w_to[by_pair])
        good = np.bincount(inverse[by_pair], new_words, len(u)) >= PAIR_WORDS
        out, tokens = [], {}
        edges = np.append(0, np.cumsum(np.bincount(inverse, minlength=len(u))))
        alone = np.ones(len(u), bool)
        for p in np.flatnonzero(good).tolist():
            rows = by_pair[edges[p] : edges[p + 1]]
            d, i = divmod(int(u[p]), len(self.index.ids))
            if d not in tokens:
                tokens[d] = self._tokens(letters, kept, codes, int(starts[d]), int(starts[d] + lengths[d]))
            found = self._verify(i, tokens[d], r_from[rows], r_to[rows], r_diag[rows])
            if sum(x[2] for x in found) >= LEAST_WORDS:
                out.append((ids[d], self.index.ids[i], found))
                alone[p] = False
        apart = alone[inverse]
        if apart.any():
            marks = _marks(hashes, letters, upto[:-1])
            self._keep_alone(r_item[apart], r_from[apart], r_to[apart], marks[pair[apart] // len(self.index.ids)])
        return out

    def _dense(self, at, number, letters):
        """Item, diagonal and place per hit in a band of some hits, whatever document it is in, in order."""
        index = self.index
        n = index.count[number]
        ends = np.cumsum(n)
        edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], SLICE), side="right"), len(at)))
        edges[0] = 0
        bits = max(16, min(int(np.log2(COUNTERS)), int(ends[-1]).bit_length() + 1))
        shift, half = np.uint64(64 - bits), np.uint64(int(np.log2(BAND // 2)))

        most = int(index.at.max())
        # half bands of an item, with one to spare at either end, in multiples that keep the borders of bands
        lift = -(-most // (BAND // 2)) * (BAND // 2) + BAND // 2
        halves = (letters + lift) // (BAND // 2) + 2
        direct = halves * len(index.ids) <= COUNTERS
        base = index.item.astype(np.int64) * (halves * (BAND // 2)) - index.at + lift if direct else index.key

        def slices():
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                m = n[i:j]
                upto = np.cumsum(m)
                first = np.arange(upto[-1])
                first += np.repeat(index.start[number[i:j]] - (upto - m), m)
                letter = np.repeat(at[i:j], m)
                # item and half band in one number, spread; neighbouring bands differ by _P
                key = base[first]
                key += letter.view(key.dtype)
                if direct:
                    key >>= int(half)
                else:
                    key >>= half
                    key *= _P
                yield first, letter, key

        slot = lambda x: x if direct else (x >> shift).view(np.int64)
        kept = [] if len(edges) > 2 else list(slices())
        counters = np.zeros(halves * len(index.ids) if direct else 1 << bits, np.int32)
        for _, _, key in kept or slices():
            np.add.at(counters, slot(key), np.int32(1))
        few = np.minimum(counters, np.int32(63), out=np.empty(len(counters), np.int8), casting="unsafe")  # fits the cache; LEAST_BAND is less
        del counters
        if direct:
            dense = np.append(np.append(False, few[1:-1] + np.maximum(few[:-2], few[2:]) >= LEAST_BAND), False)
        place_bits, diagonal_bits = most.bit_length(), (letters + most).bit_length()
        out = []
        for first, letter, key in kept or slices():
            ok = np.flatnonzero(dense[key] if direct else few[slot(key)] + np.maximum(few[slot(key - _P)], few[slot(key + _P)]) >= LEAST_BAND)
            first, letter = first[ok], letter[ok]
            place = index.at[first].astype(np.int64)
            out.append((((index.item[first].astype(np.int64) << diagonal_bits) + letter - place + most) << place_bits) + place)
        out = np.sort(np.concatenate(out))
        return out >> (diagonal_bits + place_bits), ((out >> place_bits) & ((1 << diagonal_bits) - 1)) - most, out & ((1 << place_bits) - 1)

    def _keep_alone(self, item, first, last, mark):
        """Keeps short runs, with the mark of their text, of pairs that share no more."""
        a, b = self.index.first_word[self.index.base[item] + first], self.index.last_word[self.index.base[item] + last]
        ok = (b - a >= FORMULA[0]) & (b - a <= FORMULA[1])
        self.alone += zip(np.asarray(self.index.ids)[item[ok]].tolist(), a[ok].tolist(), b[ok].tolist(), mark[ok].tolist(), strict=True)

    def _tokens(self, letters, kept, codes, a, b):
        """The words of a document and, per word, the number of its first letter in the chunk's letters."""
        lo, hi = np.searchsorted(kept, [a, b])
        where = kept[lo:hi]
        breaks = np.cumsum(codes[a:b] == BREAK)[where - a]
        new = np.flatnonzero(np.append(True, np.diff(breaks) > 0)) if hi > lo else np.array([], int)
        s = letters[lo:hi].astype(np.uint32).tobytes().decode("utf-32-le")
        ends = np.append(new[1:], len(s)).astype(int)
        return [s[i:j] for i, j in zip(new.tolist(), ends.tolist(), strict=True)], new + lo

    def _verify(self, i, tokens, first, last, diagonal):
        doc, doc_at = tokens
        starts = self.index.starts[i]
        order = np.argsort(first, kind="stable")
        regions: list[list[int]] = []
        for a, b, d in zip(first[order].tolist(), last[order].tolist(), diagonal[order].tolist(), strict=True):
            # the words that hold the first and the last letter, as words between edits may be short of whole q-grams
            wa, wb = int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, b, side="left")) - 1
            da, db = max(0, int(np.searchsorted(doc_at, a + d, side="right")) - 1), int(np.searchsorted(doc_at, b + d, side="left")) - 1
            for r in regions:  # the same band, a few words on
                if abs(d - r[4]) <= BAND and wa - r[1] <= 12 and -4 <= da - r[3] <= 40:
                    r[1], r[3], r[4] = max(r[1], wb), max(r[3], db), d
                    break
            else:
                regions.append([wa, wb, da, db, d])
        return passages(self.index.words[i], doc, [tuple(r[:4]) for r in regions])


_SCAN = "doc_id bigint, item_id bigint, first array<int>, last array<int>, words array<int>, word int, end int, mark bigint, docs bigint"


def _scan(documents: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    # one index for all tasks: about 20 kB an item, of which there are at most a block
    index = documents.sparkSession.sparkContext.broadcast(ItemIndex(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(index.value)
        names = [x.split()[0] for x in _SCAN.split(", ")]
        ints = pa.list_(pa.int32())
        types = [pa.int64(), pa.int64(), ints, ints, ints, pa.int32(), pa.int32(), pa.int64(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            ids, texts, held, rows = [], [], 0, []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and held + len(t) > CHUNK:
                    rows += scanner.chunk(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
            if ids:
                rows += scanner.chunk(ids, texts)
            if rows:
                yield batch([(d, i, [p[0] for p in ps], [p[1] for p in ps], [p[2] for p in ps], None, None, None, None) for d, i, ps in rows])
            if scanner.alone:  # copies in one batch once
                yield batch([(None, i, None, None, None, a, z, m, None) for i, a, z, m in sorted(set(scanner.alone))])
                scanner.alone = []
        yield batch([(None,) * 8 + (scanner.docs,)])

    return spread(documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")).mapInArrow(run, _SCAN)


def _counted(found: DataFrame, formula: dict[int, set[int]]) -> DataFrame:
    """Words per (document, item), those of formulas left out where they make up a passage shorter than LEAST_WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for item, first, last, words_ in zip(*[b.column(k).to_pylist() for k in range(1, 5)], strict=True):
                marked, total = formula.get(item, set()), 0
                for a, z, w in zip(first, last, words_, strict=True):
                    own = sum(k not in marked for k in range(a, z + 1))
                    total += w if w >= LEAST_WORDS or own >= LEAST_PASSAGE else min(w, own)
                n.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array([len(x) for x in b.column(2).to_pylist()], pa.int32())], ["doc_id", "item_id", "words", "passages"])

    return found.mapInArrow(run, "doc_id bigint, item_id bigint, words int, passages int")


def leaked_items(documents: DataFrame, eval_item: DataFrame, block: int = BLOCK, formula_share: float = FORMULA_SHARE, formula_docs: int = FORMULA_DOCS) -> DataFrame:
    """Documents that repeat at least LEAST_WORDS words of an item in its order, in one passage or several of LEAST_PASSAGE words or more: doc_id, item_id, words, passages.

    Both texts are folded to letters and digits without case, accents, punctuation and spacing. The documents are read
    once per ``block`` items: their q-grams are looked up in the items' index, all counted in overlapping diagonal bands, and a (document, item) pair whose bands
    hold stretches of words in common is verified by banded alignment of its words: runs of three words between edits still hold q-grams. Words of
    procedural formulas (short runs that stand alone in many different texts, counted over all documents, copies and most corrected reissues once) count only inside a longer passage. What is common
    is a matter of the corpus, so this rule depends on it: ``formula_share`` of all documents, and ``formula_docs`` at least; with a share over 1 there are no formulas.

    Only the items are sent to the tasks, ``block`` of them at a time, and only candidates and the short runs, a few numbers each, come back: no text
    is shuffled. Null ids and texts find nothing; items of under LEAST_WORDS words can't leak; equal items are found each; an empty table on either side gives no rows.
    """
    items = eval_item.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").dropDuplicates(["item_id"])
    blocks = max(1, -(-items.count() // block))
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        scan = written(_scan(documents, [tuple(r) for r in own.collect()]), "leak-scan")
        n = scan.where(F.col("doc_id").isNull() & F.col("item_id").isNull()).agg(F.sum("docs")).first()[0] or 0
        short = scan.where(F.col("word").isNotNull()).select("item_id", F.explode(F.sequence("word", F.col("end") - 1)).alias("word"), "mark").distinct()
        common = short.groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= max(formula_docs, formula_share * n))
        formula: dict[int, set[int]] = {}
        for item, word in common.select("item_id", "word").collect():  # at most the words of a block of items
            formula.setdefault(item, set()).add(word)
        found = scan.where(F.col("doc_id").isNotNull()).select("doc_id", "item_id", "first", "last", "words")
        parts.append(_counted(found, formula).where(F.col("words") >= LEAST_WORDS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
