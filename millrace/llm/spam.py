"""Pages of repeated keywords, links or product tags, told by the perplexity of their word classes under a model of prose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.folding import BREAK, DROP, folded_points, repaired
from millrace.tables import spread, written

#: The commonest words of prose stand for themselves; others are classes.
FUNCTION_WORDS = 300
#: A word of prose is known to the model as such if it comes so often as against the commonest, which by Zipf's law some thousands do, and has this share of all words, so never more than its inverse do.
LEAST_RATE, LEAST_SHARE = 5e-4, 1e-6
#: Trigrams of which the model keeps the count: those with this share of all tokens, so never more than its inverse. All pairs of classes are kept.
TRIGRAM_SHARE = 2e-7
#: Weight of what the order below says.
LOWER = 5.0
#: Words that a sentence has to have to count as prose, and the share of them that must be function words.
PROSE_WORDS, FUNCTION_SHARE = 6, 0.15
#: Sentences whose mean bits lie between these multiples of the first model's mean train the second one.
USUAL = 0.7, 1.3
#: Tokens on either side that a token's perplexity is averaged over, near and far.
WINDOWS = 12, 60
#: Perplexities beyond those of all but this share of the tokens of prose are abnormal, on either side, near or far.
TAIL = 0.07
#: Abnormal text counts where so many of the words around, within so many tokens to either side, are keywords, links or tags.
EVIDENCE, AROUND = 0.24, 30
#: A keyword comes so often in a document's abnormal text, makes up so much of its words, and so many times its share in prose; the commonest words of prose never are.
#: Where all words repeated so make up this much of it together, none needs a share of its own.
KEYWORD_TIMES, KEYWORD_SHARE, KEYWORD_RATIO, NEVER = 4, 0.03, 10, 50
KEYWORDS_TOGETHER = 0.5
#: A short sentence that comes so often in a page, with a function word in it, is a call or an opening; it has at most so many words.
CALL_TIMES, CALL_WORDS = 4, 5
#: A link counts as a word per so many characters; more than so much of a page must be stuffed text, hence so much abnormal for it to be looked at.
LINK_WORD, PAGE = 6, 0.5
#: The first words of a sentence, and how many it has to have, in which a word must come again for it to be a keyword.
OPENING = 6, 9
#: A word of the lexicon stands in stuffed text of so many documents (this share of all, but at least so many), and so many times as many as those candidates where it stands elsewhere.
LEXICON = 5e-5, 2, 2
CHUNK = 500_000

# Classes of tokens; signs and then function words follow.
LINK, RARE, WORD, NUMBER, LINE, OTHER = range(6)
_PUNCTUATION = ".,;:!?()[]{}<>\"'-–—•·*|/#+=%&@_~€$£«»“”„’‘…"
_FIRST = OTHER + 1 + len(_PUNCTUATION)
_CLASSES = _FIRST + FUNCTION_WORDS
_KIND = np.full(0x3000, OTHER, np.uint16)
_KIND[[ord(c) for c in _PUNCTUATION]] = OTHER + 1 + np.arange(len(_PUNCTUATION))
_SIGN = {c: OTHER + 1 + i for i, c in enumerate(_PUNCTUATION)}
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_CASE = np.array([1 if chr(c).islower() else 2 if chr(c).isupper() else 0 for c in range(0x3000)], np.uint8)
_STOP = np.zeros(_FIRST, bool)
_STOP[[LINE, _SIGN["."], _SIGN["!"], _SIGN["?"]]] = True
_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_kept_powers: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2**64, and their inverses."""
    if not _kept_powers or len(_kept_powers[0]) < n:
        m = max(n, CHUNK + CHUNK // 4)
        _kept_powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(m, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _kept_powers[0], _kept_powers[1]


class Tokens:
    """The tokens of a chunk of texts, as arrays: document, kind (of words: WORD or NUMBER), hash of the folded word, characters
    other than spaces, the number of the sentence (sentences end at line ends and after . ! ?; line ends within a sentence are left out), whether it is glued to the one
    before, and whether it is an odd word (a capital after a small letter in it, or a digit after a letter)."""

    def __init__(self, texts: list[str]):
        whole = [repaired(t) for t in texts]
        joined = "\n".join(whole) + "\n"
        n = len(joined)
        cps = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(cps, 0x2FFF).astype(np.intp)
        codes = folded_points(cps, low)
        ends = np.cumsum([len(t) + 1 for t in whole])
        letter = codes > DROP
        soft = codes == DROP
        blank = _SPACE[low] | (cps >= 0x3000)
        link = np.zeros(n, bool)
        for i, j in self._links(cps, letter, blank):
            link[i:j] = True
        # a token starts at each letter after none, at each link, at each sign and line end
        inside = letter | soft
        begins = ~blank & ~soft
        begins[1:] &= ~(letter[1:] & inside[:-1])
        line = cps == 10
        begins |= line
        if link.any():
            begins &= ~link
            begins[1:] |= link[1:] & ~link[:-1]
            begins[0] |= link[0]
            begins[1:] |= link[:-1] & letter[1:] & ~link[1:]
        at = np.flatnonzero(begins)
        last = np.append(at[1:], n)
        # hash of each word: a polynomial in its letters, from running sums of the whole
        with np.errstate(over="ignore"):
            powers, inverse = _powers(n)
            total = np.zeros(n + 1, np.uint64)
            np.multiply(codes, powers[:n], out=total[1:])
            total[1:][soft] = 0
            np.cumsum(total, out=total)
            h = (total[last] - total[at]) * inverse[at]
            h = (h ^ (h >> np.uint64(32))) * _M
        self.hash = h ^ (h >> np.uint64(29))
        first = cps[at]
        kind = _KIND[np.minimum(first, 0x2FFF)]
        is_word = letter[at]
        kind[is_word] = WORD
        kind[is_word & (codes[at] >= 48) & (codes[at] <= 57) & (codes[last - 1 - (last - 1 - at) // 2] < 58)] = NUMBER
        kind[line[at]] = LINE
        kind[link[at]] = LINK
        self.kind = kind
        case = _CASE[low]
        shift = np.flatnonzero(((case[:-1] == 1) & (case[1:] == 2)) | ((case[:-1] > 0) & (codes[1:] >= 48) & (codes[1:] <= 57))) + 1
        within = np.searchsorted(at, shift, side="right") - 1
        within = within[(within >= 0) & (at[within] < shift)]
        self.odd = np.zeros(len(at), bool)
        self.odd[within] = is_word[within] & ~link[at[within]]
        self.glued = np.append(False, ~blank[at[1:] - 1]) if len(at) else np.array([], bool)
        solid = np.zeros(n + 1, np.int32)
        np.cumsum(~blank, dtype=np.int32, out=solid[1:])
        self.size = (solid[last] - solid[at]).astype(np.int64)
        self.solid = np.diff(np.append(0, solid[ends].astype(np.int64)))
        self.doc = np.repeat(np.arange(len(ends)), np.diff(np.append(0, np.searchsorted(at, ends))))
        soft = self._soft(kind, self.doc, case[at])
        if soft.any():
            # of a word broken there by a hyphen the first piece stands for the whole
            line = np.flatnonzero(soft)
            line = line[line > 1]
            line = line[(kind[line - 1] == _SIGN["-"]) & self.glued[line - 1] & (kind[line - 2] == WORD) & (self.doc[line - 2] == self.doc[line])]
            np.add.at(self.size, line - 2, self.size[line - 1] + self.size[line + 1])
            soft[line - 1] = soft[line + 1] = True
            self.kind, self.hash, self.odd, self.glued, self.size, self.doc = (x[~soft] for x in (kind, self.hash, self.odd, self.glued, self.size, self.doc))
            kind = self.kind
        stop = _STOP[kind]
        new = np.append(True, stop[:-1] & ~stop[1:])
        new[1:] |= np.diff(self.doc) > 0
        self.sentence = np.cumsum(new) - 1
        self.sentences = int(self.sentence[-1]) + 1 if len(self.doc) else 0
        self.n = len(texts)

    @staticmethod
    def _soft(kind: np.ndarray, doc: np.ndarray, case: np.ndarray) -> np.ndarray:
        """Which line ends break a sentence only for the page's width: behind no line end and no sign that ends a sentence, and before a small letter."""
        out = np.zeros(len(kind), bool)
        if len(kind) > 2:
            out[1:-1] = (kind[1:-1] == LINE) & ~_STOP[kind[:-2]] & (kind[2:] == WORD) & (case[2:] == 1) & (doc[:-2] == doc[1:-1]) & (doc[2:] == doc[1:-1])
        return out

    @staticmethod
    def _links(cps, letter, blank) -> Iterator[tuple[int, int]]:
        """Pieces between spaces that hold ://, www. or a dot between letters with a slash after it."""
        slash = np.flatnonzero(cps == 47)
        marks = [slash[(slash > 0) & (cps[np.maximum(slash - 1, 0)] == 58)]]
        dot = np.flatnonzero(cps == 46)
        dot = dot[(dot > 2) & (dot + 1 < len(cps))]
        dot = dot[letter[dot - 1] & letter[np.minimum(dot + 1, len(cps) - 1)]]
        lower = cps[dot[:, None] + np.array([[-1, -2, -3]])] | 32 if len(dot) else np.zeros((0, 3), np.uint32)
        marks.append(dot[(lower == 119).all(1)])
        spaces = np.append(np.flatnonzero(blank), len(cps))
        piece = lambda x: np.searchsorted(spaces, x)
        both = np.intersect1d(piece(dot), piece(slash))
        for p in np.union1d(np.unique(piece(np.concatenate(marks))), both).tolist():
            yield (int(spaces[p - 1]) + 1 if p else 0), int(spaces[p])

    def classes(self, vocabulary: Vocabulary) -> np.ndarray:
        """Class per token: function words have their own, other common words of prose are WORD, the rest RARE."""
        out = self.kind.astype(np.int64)
        w = np.flatnonzero(self.kind == WORD)
        k = vocabulary.find(self.hash[w])
        out[w] = np.where(k < 0, RARE, np.where(k < FUNCTION_WORDS, _FIRST + k, WORD))
        return out

    def per_sentence(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence[which], minlength=self.sentences)

    def prose(self) -> np.ndarray:
        """Which tokens belong to sentences like those of prose: ended by . ! or ?, of PROSE_WORDS words or more, without links and with no longer word twice."""
        word = self.kind == WORD
        end = (self.kind == _SIGN["."]) | (self.kind == _SIGN["!"]) | (self.kind == _SIGN["?"])
        ok = (self.per_sentence(word) >= PROSE_WORDS) & (self.per_sentence(end) > 0) & (self.per_sentence(self.kind == LINK) == 0)
        long_ = np.flatnonzero(word & (self.size >= 4) & ok[self.sentence])
        key = self.hash[long_] ^ (self.sentence[long_].astype(np.uint64) * _M)
        order = np.argsort(key)
        key = key[order]
        again = order[1:][key[1:] == key[:-1]]
        ok[self.sentence[long_[again]]] = False
        return ok[self.sentence]


def _hash_of(word: str) -> int:
    t = Tokens([word])
    return int(t.hash[0])


class Vocabulary:
    """The commonest words of prose: hashes by rank, and how often each comes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.order = np.append(np.argsort(hashes), -1)
        self.sorted = np.append(hashes[self.order[:-1]], np.uint64(0))
        # where the hashes with the same upper 16 bits begin
        upper = np.bincount((self.sorted[:-1] >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        self.most, self.bucket = int(upper.max()), np.append(0, np.cumsum(upper)).astype(np.int32)
        self.rates = counts / max(1, counts.sum())

    def rate(self, h: np.ndarray) -> np.ndarray:
        """Share of each word in prose, 0 if it isn't among them; the very commonest are taken for all of it, so that none of them is a keyword."""
        k = self.find(h)
        return np.where(k < 0, 0.0, np.where(k < NEVER, 1.0, self.rates[np.maximum(k, 0)] if len(self.rates) else 0.0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 if it isn't among them."""
        upper = (h >> np.uint64(48)).view(np.int64)
        at, end = self.bucket[upper], self.bucket[upper + 1]
        ok = (at < end) & (self.sorted[at] == h)
        for _ in range(1, self.most):
            rest = np.flatnonzero(~ok & (at + 1 < end))
            if not len(rest):
                break
            at[rest] += 1
            ok[rest] = self.sorted[at[rest]] == h[rest]
        return np.where(ok, self.order[at], -1)


def _contexts(classes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the class before it, and both before it as one number. Before a document's start stands class _CLASSES."""
    before = []
    for back in (1, 2):
        c = np.full(len(classes), _CLASSES)
        c[back:] = np.where(doc[back:] == doc[:-back], classes[:-back], _CLASSES)
        before.append(c)
    return before[0], before[1] * (_CLASSES + 1) + before[0]


class Model:
    """An interpolated trigram model of classes: exact counts of single classes and pairs, and of the trigrams that aren't very rare."""

    def __init__(self, vocabulary: Vocabulary, single: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, trigrams: np.ndarray, counts: np.ndarray):
        self.vocabulary = vocabulary
        one = (single + 0.5) / (single.sum() + 0.5 * len(single))
        pairs = pairs.reshape(_CLASSES + 1, _CLASSES)
        self.two = ((pairs + LOWER * one) / (pairs.sum(1, keepdims=True) + LOWER)).astype(np.float32).ravel()
        self.contexts = contexts.astype(np.float32)
        h = self._spread(trigrams)
        order = np.argsort(h)
        self.keys, self.counts = np.append(trigrams[order], -1), np.append(counts[order], 0).astype(np.float32)
        self.width = max(10, int(np.log2(max(1, len(trigrams)))) + 3)
        upper = np.bincount(h >> np.uint64(64 - self.width), minlength=1 << self.width) if len(h) else np.zeros(1 << self.width, int)
        self.most = int(upper.max())
        self.bucket = np.append(0, np.cumsum(upper)).astype(np.int32)
        # mean bits of what the model was trained on
        bits = -np.log2(np.maximum(self._three(trigrams, counts), 1e-9))
        self.entropy = float((bits * counts).sum() / max(1, counts.sum()))

    @staticmethod
    def _spread(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.astype(np.uint64) * _M
            return (h ^ (h >> np.uint64(32))) * _M

    def _three(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        context, c = np.divmod(keys, _CLASSES)
        return (counts + LOWER * self.two[(context % (_CLASSES + 1)) * _CLASSES + c]) / (self.contexts[context] + LOWER)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The counts of trigrams, 0 of those that aren't kept."""
        upper = (self._spread(keys) >> np.uint64(64 - self.width)).view(np.int64)
        at, end = self.bucket[upper], self.bucket[upper + 1]
        out = np.where((at < end) & (self.keys[at] == keys), self.counts[at], 0)
        for k in range(1, self.most):
            rest = np.flatnonzero(at + k < end)
            if not len(rest):
                break
            rest = rest[self.keys[at[rest] + k] == keys[rest]]
            out[rest] = self.counts[at[rest] + k]
        return out

    def bits(self, classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Bits of each token given the two before it."""
        keys = _contexts(classes, doc)[1] * _CLASSES + classes
        return np.maximum(-np.log2(self._three(keys, self._found(keys))), 0).astype(np.float64)

    def perplexity(self, t: Tokens, classes: np.ndarray, bits: np.ndarray | None = None) -> list[np.ndarray]:
        """Mean bits over the tokens near, and those far around each token (the logarithm of their perplexity)."""
        bits = self.bits(classes, t.doc) if bits is None else bits
        return [smooth(bits, t.kind != LINE, t.doc, w) for w in WINDOWS]


def beyond(mean: list[np.ndarray], limits: list[tuple[float, float]]) -> np.ndarray:
    """Which tokens stand in text of abnormal perplexity, near or far."""
    return np.logical_or.reduce([(m < low) | (m > high) for m, (low, high) in zip(mean, limits, strict=True)])


def smooth(x: np.ndarray, weight: np.ndarray, doc: np.ndarray, window: int = WINDOWS[0]) -> np.ndarray:
    """Weighted mean over ``window`` tokens to either side within the document."""
    n = len(x)
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    length = np.diff(np.append(edge, n))
    first, last = np.repeat(edge, length), np.repeat(edge + length, length)
    i = np.arange(n)
    a, b = np.maximum(i - window, first), np.minimum(i + window + 1, last)
    s, w = np.append(0, np.cumsum(x * weight)), np.append(0, np.cumsum(weight))
    return (s[b] - s[a]) / np.maximum(w[b] - w[a], 1e-9)


def _in_document(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number per document and word."""
    with np.errstate(over="ignore"):
        return hashes ^ ((doc.astype(np.uint64) + np.uint64(1)) * _M)


def calls(t: Tokens, classes: np.ndarray) -> np.ndarray:
    """Which tokens stand in short sentences that their document has CALL_TIMES times or more, word by word, with a function word in them."""
    word = np.flatnonzero(t.kind == WORD)
    short = t.per_sentence(t.kind == WORD) <= CALL_WORDS
    if not len(word):
        return np.zeros(len(t.kind), bool)
    start = np.searchsorted(t.sentence, np.arange(t.sentences))
    with np.errstate(over="ignore"):
        place = 2 * (word - start[t.sentence[word]]).astype(np.uint64) + np.uint64(1)
        whole = np.zeros(t.sentences, np.uint64)
        np.add.at(whole, t.sentence[word], t.hash[word] * place)
        whole ^= (t.doc[start].astype(np.uint64) + np.uint64(1)) * _M
    _, inverse, n = np.unique(whole, return_inverse=True, return_counts=True)
    return (short & (n[inverse] >= CALL_TIMES) & (t.per_sentence(classes >= _FIRST) > 0))[t.sentence]


def tagged(t: Tokens, classes: np.ndarray, abnormal: np.ndarray, vocabulary: Vocabulary, lexicon: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which tokens are links, tags or keywords: links; words written as tags (behind #, or with a capital or a digit inside); words that make up much of their document's abnormal
    text, alone or all together, and far more than of prose, but for calls of one or two words that end in an exclamation mark, repeated short sentences, the first words in a bracket
    and those that come only where sentences open; and words of the lexicon (documents and words, those of each document)."""
    kind = t.kind
    is_word = kind == WORD
    word = np.flatnonzero(is_word & abnormal)
    out = kind == LINK
    if len(word):
        words = np.bincount(t.doc[word], minlength=t.n)
        _, inverse, n = np.unique(t.hash[word] ^ (t.doc[word].astype(np.uint64) * _M), return_inverse=True, return_counts=True)
        usual = vocabulary.rate(t.hash[word])
        own = words[t.doc[word]]
        again = n[inverse] >= np.maximum(KEYWORD_TIMES, KEYWORD_RATIO * usual * own)
        together = np.bincount(t.doc[word], again, t.n)[t.doc[word]] >= KEYWORDS_TOGETHER * own
        out[word] = again & (together | (n[inverse] >= KEYWORD_SHARE * own))
    if lexicon is not None and len(lexicon[0]):
        rare = np.flatnonzero(classes == RARE)
        out[rare] |= np.isin(_in_document(t.doc[rare], t.hash[rare]), _in_document(*lexicon))
    out &= ~is_word | (t.size > 1)
    back = lambda x, k=1: np.append(np.zeros(k, x.dtype), x[:-k]) if len(x) > k else np.zeros(len(x), x.dtype)
    opened = back(kind == _SIGN["("])
    for _ in range(2):
        opened |= back(opened & is_word)
    out[opened & is_word] = False  # a name in brackets behind what it goes with
    if len(word):  # how sentences open, even if they all open alike
        order = np.cumsum(is_word)
        start = np.flatnonzero(np.append(True, t.sentence[1:] != t.sentence[:-1]))
        nth = order - (order[start] - is_word[start])[t.sentence]
        _, inverse, n = np.unique(t.hash[word] ^ (t.sentence[word].astype(np.uint64) * _M), return_inverse=True, return_counts=True)
        long_ = t.per_sentence(is_word)[t.sentence[word]] >= OPENING[1]
        opens = (nth[word] <= OPENING[0]) & long_ & (n[inverse] == 1)
        _, inverse = np.unique(t.hash[word] ^ (t.doc[word].astype(np.uint64) * _M), return_inverse=True)
        elsewhere = np.bincount(inverse, ~opens)[inverse]
        out[word[opens & (elsewhere < KEYWORD_TIMES)]] = False
    called = (t.per_sentence(is_word) <= 2) & (t.per_sentence(kind == _SIGN["!"]) > 0)
    out[called[t.sentence] | calls(t, classes)] = False
    return out | t.odd | (t.glued & (is_word | (kind == NUMBER)) & back(kind == _SIGN["#"]))


def stuffed(t: Tokens, classes: np.ndarray, mean: list[np.ndarray], limits: list[tuple[float, float]], vocabulary: Vocabulary, lexicon: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which tokens stand in text of abnormal perplexity that is made of keywords, links or tags."""
    abnormal = beyond(mean, limits)
    tags = tagged(t, classes, abnormal, vocabulary, lexicon)
    weight = np.where(t.kind == LINK, t.size / LINK_WORD, ((t.kind == WORD) & (t.size > 1)) | tags)
    return abnormal & (smooth(tags, weight, t.doc, AROUND) >= EVIDENCE)


def share(t: Tokens, which: np.ndarray) -> np.ndarray:
    """Per document the share of its characters (spaces don't count) that these tokens have."""
    return np.bincount(t.doc, np.where(which, t.size, 0), t.n) / np.maximum(t.solid, 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about CHUNK characters at a time."""
    for b in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and held + len(t) > CHUNK:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
        if ids:
            yield ids, texts


def _count_rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


_COUNTS = "kind int, key bigint, n bigint"


class Counts:
    """Counts by key: keys are gathered, and counted and given out once there are HELD of them. What is given out of one key more than once is added up before the shuffle."""

    HELD = 4_000_000

    def __init__(self, kind: int):
        self.kind, self.keys, self.n = kind, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.n += len(keys)
        if self.n >= self.HELD:
            yield self.rest()

    def rest(self) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(self.keys or [np.array([], np.int64)]), return_counts=True)
        self.keys, self.n = [], 0
        return _count_rows(self.kind, keys, n)


def prose_vocabulary(texts: DataFrame) -> Vocabulary:
    """The words that come often in sentences of prose, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Counts(0)
        for _, part in _chunks(batches):
            t = Tokens(part)
            yield from words.add(t.hash[t.prose() & (t.kind == WORD)].view(np.int64))
        yield words.rest()

    counted = written(texts.mapInArrow(run, _COUNTS).groupBy("key").agg(F.sum("n").alias("n")), "prose-words")
    most, total = counted.agg(F.max("n"), F.sum("n")).first()
    rows = counted.where(F.col("n") >= max(LEAST_RATE * (most or 0), LEAST_SHARE * (total or 0))).orderBy(F.desc("n"), "key").toArrow()
    return Vocabulary(rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy())


def clean_prose(t: Tokens, classes: np.ndarray) -> np.ndarray:
    """Which tokens belong to sentences of prose with their share of function words: pages of keywords have some that look like sentences, but not that."""
    share_ = t.per_sentence(classes >= _FIRST) / np.maximum(t.per_sentence(t.kind == WORD), 1)
    return t.prose() & (share_ >= FUNCTION_SHARE)[t.sentence]


#: Steps of a bit in the counts of prose perplexities.
_STEP = 50
_SINGLE, _PAIR, _CONTEXT, _TRIGRAM, _BITS = 0, 1, 2, 3, 4


def train(texts: DataFrame, vocabulary: Vocabulary, first=None) -> tuple[Model, list[tuple[float, float]]]:
    """The model of the classes of prose, counted over all texts. With the broadcast model of a ``first`` round only sentences that are usual under it train
    the second, and the limits come out beyond which perplexity is abnormal, near and far: those that all but TAIL of the tokens of such sentences keep, on either side.

    A task holds the counts of classes and their pairs, and four million trigrams to be counted at most; the driver gets the trigrams with TRIGRAM_SHARE of the tokens, so no more than its inverse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pair, context = (np.zeros(n, np.int64) for n in (_CLASSES, (_CLASSES + 1) * _CLASSES, (_CLASSES + 1) ** 2))
        bits = np.zeros((len(WINDOWS), 64 * _STEP), np.int64)
        trigrams = Counts(_TRIGRAM)
        known = first.value.vocabulary if first else vocabulary
        for _, part in _chunks(batches):
            t = Tokens(part)
            c = t.classes(known)
            ok = clean_prose(t, c)
            if first:
                own = first.value.bits(c, t.doc)
                mean = np.bincount(t.sentence, own, t.sentences) / np.maximum(np.bincount(t.sentence, minlength=t.sentences), 1)
                ok &= ((mean >= USUAL[0] * first.value.entropy) & (mean <= USUAL[1] * first.value.entropy))[t.sentence]
                for k, m in enumerate(first.value.perplexity(t, c, own)):
                    bits[k] += np.bincount(np.minimum(m[ok] * _STEP, bits.shape[1] - 1).astype(int), minlength=bits.shape[1])
            before, both = _contexts(c, t.doc)
            c, before, both = c[ok], before[ok], both[ok]
            single += np.bincount(c, minlength=len(single))
            pair += np.bincount(before * _CLASSES + c, minlength=len(pair))
            context += np.bincount(both, minlength=len(context))
            yield from trigrams.add((both * _CLASSES + c).astype(np.int32))
        yield trigrams.rest()
        for kind, n in ((_SINGLE, single), (_PAIR, pair), (_CONTEXT, context), *((_BITS + k, n) for k, n in enumerate(bits))):
            yield _count_rows(kind, np.flatnonzero(n), n[n > 0])

    counted = written(texts.mapInArrow(run, _COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n")), "class-counts")
    tokens = counted.where(F.col("kind") == _SINGLE).agg(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("kind") != _TRIGRAM) | (F.col("n") >= TRIGRAM_SHARE * tokens)).toArrow()
    kind, key, n = (rows.column(i).to_numpy() for i in range(3))

    def dense(k: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[key[kind == k]] = n[kind == k]
        return out

    kept = kind == _TRIGRAM
    model = Model(vocabulary, dense(_SINGLE, _CLASSES), dense(_PAIR, (_CLASSES + 1) * _CLASSES), dense(_CONTEXT, (_CLASSES + 1) ** 2), key[kept].astype(np.int64), n[kept].astype(np.int64))
    limits = []
    for k in range(len(WINDOWS)):
        upto = np.cumsum(dense(_BITS + k, 64 * _STEP))
        low, high = (int(np.searchsorted(upto, share_ * upto[-1])) for share_ in (TAIL, 1 - TAIL))
        limits.append((low / _STEP, (high + 1) / _STEP))
    return model, limits


def prose_model(texts: DataFrame) -> tuple[Model, list[tuple[float, float]]]:
    """The model of prose and the limits of usual perplexity, in two rounds."""
    vocabulary = prose_vocabulary(texts)
    first = texts.sparkSession.sparkContext.broadcast(train(texts, vocabulary)[0])
    return train(texts, vocabulary, first)


def abnormal_pages(texts: DataFrame, model, limits: list[tuple[float, float]], least: float) -> DataFrame:
    """Documents of whose characters at least ``least`` stand in text of abnormal perplexity, with their texts. ``least`` must be no more than PAGE, so that no page that may yet be judged stuffed is left out."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in _chunks(batches):
            t = Tokens(part)
            mean = model.value.perplexity(t, t.classes(model.value.vocabulary))
            at = np.flatnonzero(share(t, beyond(mean, limits)) >= least)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([part[i] for i in at], pa.string())], ["doc_id", "text"])

    return texts.mapInArrow(score, "doc_id bigint, text string")


def spam_pages(documents: DataFrame) -> DataFrame:
    """Pages more than half of which is text that only repeats keywords, or lists of links, or product tags: doc_id, spam_share.

    Function words and word classes of all texts are scored under a trigram model trained on the sentences of prose among them, first on those with
    their share of function words, then on those that are usual under that. Pages with much text of abnormally high or low perplexity are flagged. Lists of names, tables
    and order papers are abnormal too, so of the flagged ones only text counts whose words are largely links, tags or keywords; keywords are words that a page repeats, or that over all flagged pages stand mostly in such text.

    Texts are passed by four times: words of prose, two rounds of n-grams, scores; of all texts only counts are shuffled; the flagged texts and their rare words are written and joined, with no
    limit to the words that are learnt. The model's size is bounded by its classes. Null and empty texts and null ids give no row, an empty table none at all.
    """
    texts = spread(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text"))
    sc = documents.sparkSession.sparkContext
    trained, limits = prose_model(texts)
    model = sc.broadcast(trained)
    candidates = written(abnormal_pages(texts, model, limits, PAGE), "abnormal-pages")
    total = texts.count()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in _chunks(batches):
            t = Tokens(part)
            c = t.classes(model.value.vocabulary)
            bad = stuffed(t, c, model.value.perplexity(t, c), limits, model.value.vocabulary)
            w = np.flatnonzero(c == RARE)
            _, first, at = np.unique(_in_document(t.doc[w], t.hash[w]), return_index=True, return_inverse=True)
            n = (np.bincount(at, x, len(first)) > 0 for x in (bad[w], ~bad[w]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in t.doc[w[first]].tolist()], pa.int64()), pa.array(t.hash[w[first]].view(np.int64)), *map(pa.array, n)], ["doc_id", "key", "stuffed", "other"])

    words = written(candidates.mapInArrow(learn, "doc_id bigint, key bigint, stuffed boolean, other boolean"), "candidate-words")
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    lexicon = words.groupBy("key").agg(n("stuffed"), n("other")).where((F.col("stuffed") >= max(LEXICON[1], LEXICON[0] * total)) & (F.col("stuffed") >= LEXICON[2] * F.col("other")))
    own = words.select("doc_id", "key").join(lexicon.select("key"), "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    pages = candidates.join(own, "doc_id", "left").select("doc_id", "text", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for ids, part in _chunks([b]):
                keys = b.column(2).slice(done, len(ids))
                done += len(ids)
                t = Tokens(part)
                c = t.classes(model.value.vocabulary)
                known = np.repeat(np.arange(len(ids)), pc.list_value_length(keys).to_numpy()), keys.flatten().to_numpy().view(np.uint64)
                s = share(t, stuffed(t, c, model.value.perplexity(t, c), limits, model.value.vocabulary, known))
                at = np.flatnonzero(s > PAGE)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array(s[at])], ["doc_id", "spam_share"])

    return pages.mapInArrow(judge, "doc_id bigint, spam_share double")
