"""SentencePiece BPE models: exact encoding, decoding and token counts, without merging whole texts.

The model's normaliser must be the identity with a dummy prefix, and no vocabulary string may hold
a space mark after another character; then no merge crosses from a word into the space before the
next one, and a text falls into chunks: a space mark and the word after it. A character outside
the vocabulary (such as a line feed) never merges, so a chunk also starts at each line feed.

``Backtracker`` encodes a chunk: Aho-Corasick gives the longest vocabulary string at each place; the
encoder takes the longest first and goes on to shorter ones, and back to the token before, wherever
two neighbours are incompatible, that is, merging their joint text anew does not give these two.
A bitfield marks the places from which no encoding was found. A sequence all of whose neighbours are
compatible is the merge result, and it is unique.

``Counter`` counts tokens: vocabulary strings proven to encode alone are one token without merging;
other chunks are merged once and remembered.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import sentencepiece

MARK = "▁"
#: Chunks remembered in each of a worker's two generations: when the young one is full it becomes the old one, and
#: what is asked for again moves from the old to the young, so frequent chunks stay.
MEMORY = 300_000


class Model:
    """The vocabulary of a BPE model file, and merging as the reference algorithm states it."""

    def __init__(self, path: str):
        self.path = path
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(sp.get_piece_size())
        self.piece = [sp.id_to_piece(i) for i in kinds]
        self.plain = [i for i in kinds if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {self.piece[i]: i for i in self.plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in self.plain}
        self.byte = {int(self.piece[i][1:-1], 16): i for i in kinds if sp.is_byte(i)}
        self.of_byte = {v: k for k, v in self.byte.items()}
        self.end = sp.eos_id()
        #: What each id stands for in UTF-8.
        self.raw = [bytes([self.of_byte[i]]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a vocabulary string holds a space mark after another character")
        if len(self.byte) != 256:
            raise ValueError("the model must fall back to bytes")
        if sp.encode("a  b ", out_type=str)[0][0] != MARK or sp.decode(sp.encode("  ﬁ \tİ")) != "  ﬁ \tİ":
            raise ValueError("the model must have a dummy prefix and leave texts as they are")

    def merge(self, text: str) -> list[str]:
        """Tokens of a chunk: always the best-scored pair of neighbours next, the leftmost of equals."""
        parts = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a], b, parts[b]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, x, b, y = heapq.heappop(heap)
            if parts[a] != x or parts[b] != y or right[a] != b:
                continue
            parts[a], parts[b] = x + y, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def to_ids(self, tokens: Iterable[str]) -> list[int]:
        out: list[int] = []
        for t in tokens:
            i = self.ids.get(t)
            out += [self.byte[x] for x in t.encode()] if i is None else [i]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: space marks become spaces, the dummy prefix goes, wrong bytes become U+FFFD."""
        ids = list(ids)
        try:
            text = b"".join([self.raw[i] for i in ids]).decode()
        except UnicodeDecodeError:  # some run of byte pieces is no character
            out, run = [], bytearray()
            for i in ids:
                if i in self.of_byte:
                    run.append(self.of_byte[i])
                else:
                    out += [_lenient(bytes(run)), self.raw[i].decode()]
                    run.clear()
            text = "".join([*out, _lenient(bytes(run))])
        return text[1:] if text.startswith(" ") else text


def _lenient(run: bytes) -> str:
    """UTF-8 where valid; each other byte is one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


class Backtracker:
    """Encodes chunks by longest matches, compatibility of neighbours and a bitfield of failed places."""

    def __init__(self, m: Model):
        self.m = m
        # Strings of two marks or more all have the lowest score; such runs merge last and by themselves, see encode.
        words = [p for p in m.ids if MARK * 2 not in p and m.merge(p) == [p]]
        self.alone = set(words)
        self.tree = ahocorasick.Automaton()
        for p in words:
            self.tree.add_word(p, p)
        self.tree.make_automaton()
        # The next shorter vocabulary string at the same place.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.alone), p[0] if len(p) > 1 else None) for p in words}
        self.fits: dict[tuple[str, str], bool] = {}
        self.packed = np.empty(0, np.int64)

    def pack(self) -> None:
        """Neighbours of the vocabulary become a number for each pair until fit() is asked again; others are forgotten."""
        if self.fits:
            ids = ((self.m.ids.get(a), self.m.ids.get(b), ok) for (a, b), ok in self.fits.items())
            self.packed = np.array([a << 32 | b << 1 | ok for a, b, ok in ids if a is not None and b is not None], np.int64)
            self.fits = {}

    def _unpack(self) -> None:
        a, b, ok = self.packed >> 32, self.packed >> 1 & 0x7FFFFFFF, self.packed & 1 > 0
        piece = self.m.piece
        self.fits = {(piece[i], piece[j]): v for i, j, v in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True)}
        self.packed = self.packed[:0].copy()

    def fit(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b."""
        known = self.fits.get((a, b))
        if known is None and len(self.packed):
            self._unpack()
            known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMORY:
                self.fits.clear()
            known = self.fits[a, b] = self.m.merge(a + b) == [a, b]
        return known

    def encode(self, chunk: str) -> list[str]:
        """Tokens of a chunk that holds space marks at its start only, after at most one line feed."""
        if chunk in self.alone:
            return [chunk]
        if chunk[:2] == MARK * 2:
            word = chunk.lstrip(MARK)
            marks = len(chunk) - len(word)
            tail = self.encode(MARK + word) if word else [MARK]
            run = MARK * (marks - 1)
            if tail[0] == MARK:  # the last mark didn't join the word, so it is part of the run
                run, tail = run + MARK, tail[1:]
            return self.m.merge(run) + tail
        n = len(chunk)
        longest = list(chunk)
        for end, p in self.tree.iter(chunk):  # at one start, longer strings end later
            longest[end - len(p) + 1] = p
        tokens: list[str] = []
        failed = 0  # bit i: from place i on, no encoding fits what may stand before
        at, token = 0, longest[0] if n else None
        while at < n:
            while True:
                end = at + len(token)
                if not failed >> end & 1 and (not tokens or self.fit(tokens[-1], token)):
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    break
                shorter = self.shorter.get(token)
                if shorter is not None:
                    token = shorter
                    continue
                # Nothing fits here: the token before was wrong.
                failed |= 1 << at
                token = tokens.pop()
                at -= len(token)
                token = self.shorter.get(token)
                while token is None:
                    failed |= 1 << at
                    token = tokens.pop()
                    at -= len(token)
                    token = self.shorter.get(token)
        return tokens


def grouped(items: list[str]) -> Iterator[str]:
    """Keys of items with empty ones among them: runs of marks join the item they stand before."""
    marks = ""
    for x in items:
        if x[:1] == "\n":
            if marks:
                yield marks
            marks = ""
            yield x
        elif x:
            yield marks + MARK + x if marks else x
            marks = ""
        else:
            marks += MARK
    if marks:
        yield marks


def keys(text: str) -> list[str]:
    """The chunks of a text, by short keys: a plain word stands for a mark and itself; what opens with a line feed or a
    mark stands for itself. A text's own marks count as spaces, as in the model; an empty text has no chunk."""
    if not text:
        return []
    items = text.replace(MARK, " ").replace("\n", " \n").split(" ")
    return list(grouped(items)) if "" in items else items


def chunk(key: str) -> str:
    return key if key[0] == "\n" or key[0] == MARK else MARK + key


class Encoder(dict):
    """Key to its ids as text, encoded when first asked for; then it is decoded too and compared."""

    def __init__(self, path: str):
        self.m = model(path)
        self.by = Backtracker(self.m)
        self.old: dict[str, str] = {}
        #: Keys that don't decode to their own chunk, and what they decode to.
        self.other: dict[str, str] = {}

    def __missing__(self, key: str) -> str:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            tokens = self.by.encode(chunk(key))
            ids = list(map(self.m.ids.get, tokens))
            if None in ids:  # some characters fall back to bytes
                ids = self.m.to_ids(tokens)
            # The dummy prefix goes from the whole text's start only, so here one more is given.
            text = self.m.decode([self.m.ids[MARK], *ids])
            if text != chunk(key).replace(MARK, " "):
                self.other[key] = text
            found = " ".join(map(str, ids))
        self[key] = found
        return found

    def both(self, text: str) -> tuple[str, str]:
        """(ids as text, the end id last; the text that the ids decode to)."""
        own = keys(text)
        ids = " ".join([*map(self.__getitem__, own), str(self.m.end)])
        if self.other:
            back = "".join([self.other.get(k) or chunk(k).replace(MARK, " ") for k in own])
            return ids, back[1:] if back.startswith(" ") else back
        return ids, text.replace(MARK, " ")  # every chunk was seen to decode to itself

    def encode(self, text: str) -> list[int]:
        """Ids, the end id last."""
        return [int(i) for i in self.both(text)[0].split()]


def forget(path: str) -> None:
    """At a task's end: chunks go and neighbours are packed, so an idle worker holds little more than the model."""
    code = encoder(path)
    code.clear()
    code.old, code.other = {}, {}
    code.by.pack()


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process, used by all its tasks."""
    return Encoder(path)


class Counter(dict):
    """Key to its number of tokens; vocabulary strings proven to encode alone are there from the start."""

    def __init__(self, path: str):
        self.m = m = model(path)
        self.proven = [p[1:] or MARK for p in m.ids if p[0] == MARK and p[:2] != MARK * 2 and m.merge(p) == [p]]
        self._start()

    def _start(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.proven, 1))

    def count(self, own: list[str]) -> int:
        """Tokens of a text's keys."""
        try:
            return sum(map(self.__getitem__, own))
        except KeyError:
            self.learn(own)
            return sum(map(self.__getitem__, own))

    def learn(self, own: list[str]) -> None:
        """Merges those unknown, all in one call of the library, which puts a dummy prefix before each."""
        if len(self) > MEMORY * 2:
            self._start()
        rest = {k for k in own if k not in self}
        rest = list(rest)
        # A chunk without mark opens with a line feed, with which the prefix can't merge: it is one token more.
        given = [k[1:].replace(MARK, " ") if k[0] == MARK else k for k in rest]
        for k, ids in zip(rest, self.m.lib.encode(given, num_threads=1), strict=True):
            self[k] = len(ids) - (k[0] == "\n")


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)
