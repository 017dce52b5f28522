"""Exact byte-pair encoding by prefix dynamic programming, and longest-match counts by trie.

A public vocabulary is read from a file of ``base64 rank`` lines whose path is a parameter. Three facts
carry this module:

* Two tokens may stand next to each other in an encoding exactly if encoding their joined bytes gives
  the two back (``BytePairs.fits``). A row of tokens in which all neighbours fit is *the* encoding.
* Hence every byte prefix has one valid last token. ``PrefixTable`` stores it for each prefix: text can
  be appended without looking back, and after an edit only the prefixes from there on are redone, until
  they meet the old ones again.
* The longest-match segmentation, found in linear time by a trie with failure links and precomputed
  emissions (``LongestMatch``), is exact wherever its neighbours fit; most words are of that kind.

Texts are cut into words by the vocabulary's pattern first, so both run once per distinct word of a
worker, and a text costs one split and one dictionary look-up a word.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import deque

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that belongs to the public vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text, in terms that the standard library's faster engine knows.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words remembered by a worker; the memory is emptied when full, which changes nothing but time.
REMEMBERED = 400_000
NEVER = 1 << 60


class BytePairs:
    """A ranked vocabulary: which tokens split into which, and which may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._spines: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self._fits: dict[int, bool] = {}

    def merged(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """Plain merging of ``piece`` with the ranks under ``below``; quadratic, for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The tokens along the left and the right edge of a token's merge tree, from the top down."""
        if (known := self._spines.get(token)) is None:
            piece = self.bytes_of[token]
            if len(piece) == 1:
                known = ((token,), (token,))
            else:
                left, right = (self.ranks[p] for p in self.merged(piece, token))
                known = ((token, *self.spines(left)[0]), (token, *self.spines(right)[1]))
            self._spines[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens.

        The states that the border between them goes through are walked backwards, from the finished
        tokens to single bytes. Whatever formed last is undone first (of equals, the right one). If a
        merge across the border would have come before the next merge on either side, they do not fit.
        """
        key = left << 32 | right
        if (known := self._fits.get(key)) is not None:
            return known
        a, b = self.spines(left)[1], self.spines(right)[0]
        i = j = 0
        ends_a = ends_b = NEVER
        fit = True
        while True:
            x, y = a[i], b[j]
            across = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], NEVER)
            if across < ends_a and across <= ends_b and across != NEVER:
                fit = False
                break
            more_a, more_b = i + 1 < len(a), j + 1 < len(b)
            if not (more_a or more_b):
                break
            if more_b and (not more_a or y >= x):
                ends_b, j = y, j + 1
            else:
                ends_a, i = x, i + 1
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        self._fits[key] = fit
        return fit


@functools.cache
def byte_pairs(path: str = VOCABULARY) -> BytePairs:
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@functools.cache
def suffix_automaton(path: str = VOCABULARY):
    """An Aho-Corasick automaton that names, at every byte, all tokens that end there, longest first."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, token in byte_pairs(path).ranks.items():
        automaton.add_word(piece.decode("latin-1"), (len(piece), token))
    automaton.make_automaton()
    return automaton


class PrefixTable:
    """The valid last token of every byte prefix of one word or text without word borders.

    ``append`` extends it and ``edit`` replaces a range; both leave what lies before untouched.
    """

    def __init__(self, piece: bytes = b"", path: str = VOCABULARY):
        self.pairs, self.path = byte_pairs(path), path
        self.piece = b""
        self.last: list[int] = []
        self.append(piece)

    def _extend(self, piece: bytes, start: int, old: list[int] | None = None, shift: int = 0, settled: int = 0) -> None:
        """Fill the prefixes of ``piece`` longer than ``start``.

        With ``old``, prefixes from ``settled`` on have the same bytes behind the edit as before it; once
        as many in a row as the longest token agree with the old ones, so do all the rest.
        """
        pairs, last = self.pairs, self.last
        first = max(0, start - pairs.longest + 1)
        agree = 0
        for end, (size, token) in suffix_automaton(self.path).iter(piece[first:].decode("latin-1")):
            n = first + end + 1
            if n <= len(last):
                continue
            at = n - size
            if at < 0 or at > len(last) or (at and not pairs.fits(last[at - 1], token)):
                continue
            last.append(token)
            if old is not None and n > settled:
                before = n - shift - 1
                agree = agree + 1 if before < len(old) and old[before] == token else 0
                if agree > pairs.longest:
                    last.extend(old[before + 1 :])
                    return

    def append(self, more: bytes) -> None:
        self.piece += more
        self._extend(self.piece, len(self.piece) - len(more))

    def edit(self, start: int, end: int, new: bytes) -> None:
        old, self.piece = self.last, self.piece[:start] + new + self.piece[end:]
        self.last = old[:start]
        self._extend(self.piece, start, old, len(new) - (end - start), start + len(new))

    def ids(self) -> list[int]:
        found, at = [], len(self.piece)
        while at:
            token = self.last[at - 1]
            found.append(token)
            at -= len(self.pairs.bytes_of[token])
        return found[::-1]


class LongestMatch:
    """Longest-match segmentation by a trie with failure links and precomputed emissions.

    When no child fits the next byte, the node's emissions (the tokens that greedy matching is by then
    certain of) are output, and the search goes on at the failure link, without reading a byte again.
    Every byte is a token here, so nothing is ever unknown.
    """

    def __init__(self, ranks: dict[bytes, int]):
        child: dict[int, int] = {}
        token: list[int] = [-1]
        for piece, rank in ranks.items():
            node = 0
            for byte in piece:
                step = node << 8 | byte
                if (after := child.get(step)) is None:
                    after = child[step] = len(token)
                    token.append(-1)
                node = after
            token[node] = rank
        edges: dict[int, list[tuple[int, int]]] = {}
        for step, after in child.items():
            edges.setdefault(step >> 8, []).append((step & 255, after))
        fail = [-1] * len(token)
        emit: list[tuple[int, ...]] = [()] * len(token)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, after in edges.get(node, ()):
                if token[after] >= 0:
                    fail[after], emit[after] = 0, (token[after],)
                else:
                    at, said = fail[node], list(emit[node])
                    while at >= 0 and at << 8 | byte not in child:
                        said += emit[at]
                        at = fail[at]
                    if at >= 0:
                        fail[after], emit[after] = child[at << 8 | byte], tuple(said)
                queue.append(after)
        self.child, self.fail, self.emit = child, fail, emit

    def tokens(self, piece: bytes) -> list[int]:
        child, fail, emit = self.child, self.fail, self.emit
        out: list[int] = []
        node = 0
        for byte in piece:
            while (after := child.get(node << 8 | byte)) is None:
                out += emit[node]
                node = fail[node]
            node = after
        while node > 0:
            out += emit[node]
            node = fail[node]
        return out


@functools.cache
def longest_match(path: str = VOCABULARY) -> LongestMatch:
    return LongestMatch(byte_pairs(path).ranks)


@functools.cache
def _patterns():
    import regex

    return regex.compile(WORDS), re.compile(ASCII_WORDS)


def words(text: str) -> list[str]:
    """The words of a text; joined they are the text again."""
    general, ascii_only = _patterns()
    return ascii_only.findall(text) if text.isascii() else general.findall(text)


class Encoder:
    """Ids of whole texts by the prefix tables of their words."""

    def __init__(self, path: str = VOCABULARY):
        self.path, self.pairs = path, byte_pairs(path)
        self._known: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        piece = word.encode()
        token = self.pairs.ranks.get(piece)
        ids = [token] if token is not None else PrefixTable(piece, self.path).ids()
        if len(word) <= 64:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[word] = ids
        return ids

    def ids(self, text: str | None) -> list[int]:
        """No text and the empty text have no ids."""
        out: list[int] = []
        if text:
            known = self._known
            for word in words(text):
                found = known.get(word)
                out += self._word(word) if found is None else found
        return out


class Counter:
    """Exact token counts of whole texts: longest match where it is the encoding, else a prefix table."""

    def __init__(self, path: str = VOCABULARY):
        self.path, self.pairs, self.greedy = path, byte_pairs(path), longest_match(path)
        self._known: dict[str, int] = {}

    def word(self, word: str) -> int:
        found = self._known.get(word)
        if found is None:
            piece = word.encode()
            if piece in self.pairs.ranks:
                found = 1
            else:
                ids = self.greedy.tokens(piece)
                fits = self.pairs.fits
                if not all(fits(a, b) for a, b in zip(ids, ids[1:])):
                    ids = PrefixTable(piece, self.path).ids()
                found = len(ids)
            if len(word) <= 64:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[word] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self._known, 0
        for word in words(text):
            found = known.get(word)
            total += self.word(word) if found is None else found
        return total


@functools.cache
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


@functools.cache
def counter(path: str = VOCABULARY) -> Counter:
    return Counter(path)
