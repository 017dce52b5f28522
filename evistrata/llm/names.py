"""Linking variant spellings of typed names to known organisations (problem 1).

Spelling variants share most of the letter pairs of their words. So the words of all distinct mentions
and the words of the dictionary are sets of q-grams, and a prefix-filtered set-similarity join finds the
pairs of words that look alike: of two sets with a Jaccard index of t or more, the rarest few grams of
both must meet, and only those are compared. A mention is then compared with those organisations of which
it holds a similar word, by soft weighted word similarity: words are aligned one to one, similar words
count by their similarity, and each word weighs the more the rarer it is in the dictionary.

The dictionary is a list of bounded size, so its index of prefixes goes to the tasks, and the mentions'
words are looked up where they are: no gram is shuffled, and none is a hot key.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Q = 2
#: Jaccard index of the padded q-gram sets from which two words are compared further.
ALIKE = 0.25
#: The same for words written apart or together, which must be closer; single words from LONG letters on may be such.
ALIKE_JOINED, LONG = 0.4, 10
#: Words whose look-alikes a worker remembers.
REMEMBERED = 200_000
#: Score from which a mention is linked, and the lead over the next organisation.
ACCEPT, LEAD = 0.86, 0.02
#: A dictionary word of so many organisations is a common one, which may be abbreviated.
COMMON = 6
#: The dictionary travels with the tasks up to this many strings; it is a hand-kept list.
DICTIONARY_BOUND = 200_000

#: Legal forms, with dots and blanks removed.
LEGAL = frozenset(
    "inc incorporated corp corporation co company ltd limited llc llp lp plc ag gmbh sa nv kk bv ab oy spa srl sarl sas kg kgaa se pty pte holdings holding".split()
)
#: Words around a name that do not belong to it.
AROUND = frozenset("the of messrs messr group its and subsidiaries subsidiary affiliates formerly listed previously".split())
#: Words by which an author means itself.
SELF = frozenset("we us our ours ourselves company registrant group it they".split())
#: Short forms that do not begin like the word.
SHORT = {"intl": "international", "int l": "international", "mfg": "manufacturing", "utd": "united", "pkg": "packaging"}


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c))


def plain_words(name: str) -> list[str]:
    """The words of a typed name: accents, case, possessives, dots and separators removed, joined words
    split at a capital, legal forms and words around the name dropped unless nothing else is there."""
    text = re.sub(r"(?<=[a-zà-ÿ]{2})(?=[A-Z][a-zà-ÿ])", " ", name)
    text = _fold(text).lower()
    text = re.sub(r"\[[^\]]*\]", " ", text)
    text = re.sub(r"['’`´]s\b", " ", text)
    text = re.sub(r"\band its subsidiaries\b|\band subsidiaries\b", " ", text)
    text = re.sub(r"['’`´]", "", text)
    text = re.sub(r"\b((?:\w\.)+\w?)(?!\w)\.?", lambda m: m[0].replace(".", ""), text)
    words = re.findall(r"[^\W_]+", text)
    joined: list[str] = []
    run: list[str] = []
    for w in [*words, ""]:  # letters typed apart, s-y-r-n
        if len(w) == 1 and w.isalpha():
            run.append(w)
            continue
        if len(run) >= 3:
            joined.append("".join(run))
        else:
            joined += run
        run = []
        if w:
            joined.append(w)
    words = joined
    if len(words) > 2 and words[-2:] in (["k", "k"], ["s", "a"], ["n", "v"], ["a", "g"]):
        words = words[:-2]
    kept = [w for w in words if w not in LEGAL and w not in AROUND]
    return kept or [w for w in words if w not in AROUND] or words


def readings(name: str) -> list[list[str]]:
    """The name as a whole and, where it holds brackets, without them and inside them."""
    found = [plain_words(re.sub(r"\([^)]*\)", " ", name))]
    found += [plain_words(m) for m in re.findall(r"\(([^)]*)\)", name)]
    found.append(plain_words(name))
    return [w for i, w in enumerate(found) if w and w not in found[:i]]


@functools.lru_cache(REMEMBERED)
def sight(word: str) -> str:
    """A word as the eye may read it: look-alike letters and digits made one."""
    for a, b in (("0", "o"), ("1", "l"), ("5", "s"), ("rn", "m"), ("vv", "w"), ("cl", "d")):
        word = word.replace(a, b)
    return word


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return sorted({padded[i : i + Q] for i in range(len(padded) - Q + 1)})


@functools.lru_cache(REMEMBERED)
def letters(word: str) -> int:
    """The letters of a word as bits; letters that share a bit count as the same."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # An edit brings in, or takes away, one letter at most.
    x, y = letters(a), letters(b)
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def short_for(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: same first letter, its letters in order, and shorter."""
    if SHORT.get(short) == word:
        return True
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    rest = iter(word)
    if not all(c in rest for c in short):
        bare = short[:-1] if short.endswith("s") else ""
        return len(bare) > 1 and word.startswith(bare)
    return True


@functools.lru_cache(200_000)
def word_similarity(typed: str, known: str, common: bool) -> float:
    """1 for the same word, less for typos and abbreviations, 0 for another word."""
    if typed == known:
        return 1.0
    a, b = sight(typed), sight(known)
    if a == b:
        return 0.98
    if common and short_for(typed, known):
        return 0.97
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 6 else 2 if n < 10 else 3
    d = edits(a, b, most)
    if d <= most:
        return 1 - 0.6 * d / n if d < 3 else 1 - 0.8 * d / n
    if common and len(typed) >= 5 and typed[0] == known[0]:  # an abbreviation with a slip
        for k in range(max(4, len(typed) - 1), min(len(known), len(typed) + 2)):
            if edits(typed, known[:k], 1) <= 1:
                return 0.85
    return 0.0


class Dictionary:
    """The known organisations: their names and aliases as word lists, and the weight of each word."""

    def __init__(self, rows: list[tuple[int, str | None, list[str] | None]]):
        self.forms: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.texts: dict[str, set[int]] = defaultdict(set)
        heads: dict[str, set[int]] = defaultdict(set)
        known: dict[int, set[str]] = defaultdict(set)
        for entity, name, aliases in rows:
            for text in [name, *(aliases or [])]:
                if text and text.strip():
                    self.texts[trimmed(text)].add(entity)
                    words = tuple(plain_words(text))
                    self.forms[words].add(entity)
                    known[entity].update(words)
        self.entities = {e for e in known}
        self.df = Counter(w for words in known.values() for w in words)
        n = max(1, len(self.entities))
        self.common = {w for w, k in self.df.items() if k >= max(COMMON, n // 60)}
        for entity, name, _ in rows:  # the one rare word of a full name names its owner, if it has one owner
            if name:
                rare = [w for w in plain_words(name) if w not in self.common]
                for w in rare[:1]:
                    heads[w].add(entity)
        for w, owners in heads.items():
            if len(owners) == 1 and self.df[w] == 1 and len(w) >= 4:
                self.forms[(w,)] |= owners
        self.rarest = math.log(1 + n)
        self.weight = {w: math.log(1 + n / k) for w, k in self.df.items()}
        self.by_word: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for form in self.forms:  # a form is found by its rare words; by common ones only if it has no other
            rare = {w for w in form if w not in self.common}
            for w in rare or set(form):
                self.by_word[w].append(form)
        self.joined = {"".join(f): f for f in self.forms}

        self.alone = Lookup(sorted(self.by_word), ALIKE)
        self.any = Lookup(sorted(set(self.by_word) | {j for j, f in self.joined.items() if len(f) > 1}), ALIKE_JOINED)
        self.near = functools.lru_cache(REMEMBERED)(self._near)

    def _near(self, unit: str, single: bool) -> frozenset[str]:
        """Dictionary words, and joined forms, that look like a word or joined words of a mention."""
        found = set(self.alone.similar(unit)) if single else set()
        if not single or len(unit) >= LONG:
            found.update(self.any.similar(unit))
        if unit in self.any.place:
            found.add(unit)
        return frozenset(found)

    def score(self, typed: list[str], form: tuple[str, ...]) -> float:
        """Soft weighted similarity of a typed word list and a known form."""
        pairs = []
        for j, known in enumerate(form):
            common = known in self.common
            for i, t in enumerate(typed):
                if (s := word_similarity(t, known, common)) > 0:
                    pairs.append((s, -abs(i - j), i, i + 1, j))
                if i + 1 < len(typed):
                    pair = t + typed[i + 1]
                    if (s := word_similarity(pair, known, common and len(pair) > 5)) > 0.9:
                        pairs.append((s, -abs(i - j), i, i + 2, j))
        pairs.sort(key=lambda p: (p[0] + 0.02 * (p[3] - p[2]), *p), reverse=True)
        taken_t: set[int] = set()
        taken_k: set[int] = set()
        gained = lost = 0.0
        for s, _, i, e, j in pairs:
            if j in taken_k or taken_t & set(range(i, e)):
                continue
            taken_k.add(j)
            taken_t |= set(range(i, e))
            w = self.weight[form[j]]
            gained += w * s
            lost += w * (1 - s)
        missing = sum(self.weight[k] for j, k in enumerate(form) if j not in taken_k)
        foreign = sum(self.weight.get(t, self.rarest) for i, t in enumerate(typed) if i not in taken_t)
        total = gained + lost + max(missing, foreign) + 0.5 * min(missing, foreign)
        return gained / total if total else 0.0

    def link(self, text: str) -> int | None:
        """The organisation a mention names, or None."""
        exact = self.texts.get(trimmed(text))
        if exact and len(exact) == 1:
            return next(iter(exact))
        best: dict[int, float] = {}
        for reading in readings(text):
            if not any(len(w) > 1 for w in reading) or all(w in SELF for w in reading):
                continue
            same = self.forms.get(tuple(reading))
            if same and len(same) == 1:
                return next(iter(same))
            forms: set[tuple[str, ...]] = set()
            for unit, single in units(reading):
                for known in self.near(unit, single):
                    forms.update(self.by_word.get(known, ()))
                    if known in self.joined:
                        forms.add(self.joined[known])
            whole = sight("".join(reading))
            for form in forms:
                if len(form) == 1 and len(form[0]) <= 4:
                    continue  # initials are taken as they stand or not at all
                s = self.score(reading, form)
                flat = "".join(form)
                if s < ACCEPT and len(flat) >= 8 and len(form) > 1:
                    d = edits(whole, sight(flat), len(flat) // 7)
                    if d <= len(flat) // 7:
                        s = max(s, 1 - d / len(flat))
                for e in self.forms[form]:
                    best[e] = max(best.get(e, 0.0), s)
        ranked = sorted(((s, e) for e, s in best.items()), reverse=True)
        if not ranked or ranked[0][0] < ACCEPT:
            return None
        if len(ranked) > 1 and ranked[0][0] - ranked[1][0] < LEAD:
            return None
        return ranked[0][1]


class Lookup:
    """Known words by q-grams: those whose sets have a Jaccard index of ``least`` or more with that of a word.

    A prefix-filtered set-similarity join with a list of bounded size. Grams are ordered from rare to frequent
    by their count among the known words, then by text; of a set of n grams the first n - ceil(least * n) + 1
    are its prefix, and sets that are similar enough share a gram of their prefixes. Only words that do, and
    whose sizes allow the index, are compared.
    """

    def __init__(self, known: list[str], least: float):
        self.known, self.least = known, least
        self.place = {w: i for i, w in enumerate(known)}
        sets = [grams(sight(w)) for w in known]
        self.counts = Counter(g for s in sets for g in s)
        self.code = {g: i for i, g in enumerate(sorted(self.counts, key=lambda g: (self.counts[g], g)))}
        self.sizes = np.array([len(s) for s in sets], np.int32)
        coded = [sorted(self.code[g] for g in s) for s in sets]
        first: list[list[int]] = [[] for _ in self.code]
        for i, s in enumerate(coded):
            for g in s[: self._prefix(len(s))]:
                first[g].append(i)
        self.first = [np.array(x, np.int32) for x in first]
        # The grams of each word in a row, filled up with a code that no gram has.
        self.rows = np.full((len(known), max(map(len, sets), default=1)), len(self.code), np.int32)
        for i, s in enumerate(coded):
            self.rows[i, : len(s)] = s

    def _prefix(self, n: int) -> int:
        return n - math.ceil(self.least * n - 1e-9) + 1

    def similar(self, word: str) -> list[str]:
        mine = grams(sight(word))
        n = len(mine)
        coded = sorted(self.code[g] for g in mine if g in self.code)
        # Grams that no known word has are the rarest: they come first in the prefix and meet nothing.
        ahead = self._prefix(n) - (n - len(coded))
        if ahead <= 0:
            return []
        met = np.unique(np.concatenate([self.first[g] for g in coded[:ahead]]))
        met = met[(self.sizes[met] >= self.least * n - 1e-9) & (n >= self.least * self.sizes[met] - 1e-9)]
        if not len(met):
            return []
        mine_coded = np.zeros(len(self.code) + 1, bool)
        mine_coded[coded] = True
        shared = mine_coded[self.rows[met]].sum(1)
        good = shared >= self.least * (n + self.sizes[met] - shared) - 1e-9
        return [self.known[i] for i in met[good]]


def units(words: list[str]) -> set[tuple[str, bool]]:
    """What of a name is compared with dictionary words: single words (True), neighbours joined, and the whole joined."""
    joined = {*(a + b for a, b in zip(words, words[1:])), "".join(words)} - set(words)
    return {(w, single) for found, single in ((words, True), (joined, False)) for w in found if len(w) > 1}


def dictionary_rows(entities: DataFrame) -> list[tuple[int, str, list[str]]]:
    """The dictionary on the driver; refused if it is no list of bounded size."""
    size = entities.count()
    if size > DICTIONARY_BOUND:
        raise ValueError(f"a dictionary of {size} names exceeds the bound of {DICTIONARY_BOUND}")
    rows = entities.where(F.col("entity_id").isNotNull()).select("entity_id", "name", "aliases").distinct().collect()
    return sorted(((r[0], r[1], sorted(a for a in (r[2] or []) if a)) for r in rows), key=lambda r: (r[0], r[1] or "", r[2]))


def mentions(extractions: DataFrame) -> DataFrame:
    """``record_no, rel_pos, side, text`` of both sides of every relation."""
    side = F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("r.source_entity").alias("text")), F.struct(F.lit("target").alias("side"), F.col("r.target_entity").alias("text"))))
    return (
        extractions.select("record_no", F.posexplode("relations").alias("rel_pos", "r"))
        .select("record_no", "rel_pos", side.alias("s"))
        .select("record_no", "rel_pos", "s.side", "s.text")
    )


def link_names(names: DataFrame, entities: DataFrame, *, text: str = "text") -> DataFrame:
    """The distinct texts of ``names``: the ``entity_id`` of the organisation each names or null, and whether
    the text, trimmed and lower-cased, is a name or alias as it stands (``is_exact``).

    Defined cases: null and blank texts, and self-references, name none; a text that fits two
    organisations equally well names none; an alias given to two organisations decides nothing by itself;
    an empty dictionary links nothing. Very long texts and words are compared whole.
    """
    spark = names.sparkSession
    shipped, token = spark.sparkContext.broadcast(dictionary_rows(entities)), uuid.uuid4().hex
    # Few bytes, much thought: a set number of tasks keeps adaptive execution from packing them into one.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = names.where(F.trim(F.col(text)) != "").select(F.col(text).alias("text")).distinct().repartition(tasks, F.xxhash64("text"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _dictionary(token, shipped)
        for batch in batches:
            values = batch["text"]
            yield pd.DataFrame({"text": values, "entity_id": pd.Series([known.link(v) for v in values], dtype="Int64"), "is_exact": [trimmed(v) in known.texts for v in values]})

    # Not a column expression: filters on its results would have it computed again for each.
    return distinct.mapInPandas(link, "text string, entity_id long, is_exact boolean")


_built: dict[str, Dictionary] = {}


def _dictionary(token: str, shipped) -> Dictionary:
    """The worker's dictionary for a call of ``link_names``; one is kept."""
    if token not in _built:
        _built.clear()
        _built[token] = Dictionary(shipped.value)
    return _built[token]


def linked_mentions(extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """Every mention with its text, the ``entity_id`` it names or null, and whether its trimmed and
    lower-cased text is a name or alias as it stands (``is_exact``). Repeated records count."""
    all_mentions = mentions(extractions)
    return all_mentions.join(link_names(all_mentions, entities), "text", "left")


def trimmed(text: str) -> str:
    return text.strip().lower()
