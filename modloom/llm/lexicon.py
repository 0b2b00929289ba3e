"""Byte-level BPE through a minimal acyclic transducer of frequent words.

Words (what the vocabulary's pattern cuts out of a text) are counted over the whole corpus, summed
inside the tasks before they meet. The ``SIZE`` most frequent ones become a minimal acyclic
automaton that shares prefixes and suffixes; its arcs carry numbers whose sum along a word is the
word's rank, under which its ids stand. The arrays are one file in the shared folder that Spark
hands to every executor, and tasks map it into memory. A task cuts a block of texts into words
at once, from the classes of its code points, and looks the distinct ones up in lockstep, one
byte of all of them at a time; words outside are merged exactly, pair by pair. So the size of
the lexicon changes the speed, never an id.

Defined results: a null or empty text has no ids and decodes to the empty text; added tokens in a
text become their ids, as the library does; repeated rows each appear; a text of any length is
split in blocks; an empty table gives no rows; other columns of the input take no part.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.llm.tables import cut_lineage, text_of
from modloom.sources.storage import own_scratch, scratch_path

#: Words of the lexicon, and bytes of its longest word; all others are merged.
SIZE, LONGEST = 1 << 17, 48
#: Steps in which a number of occurrences doubles, to find the most frequent words.
STEPS = 8
#: Code points that are split at a time, and fields whose words are remembered where the library splits.
BLOCK, FIELDS = 1 << 20, 1 << 16
#: Distinct words that a task counts before it hands them on; words whose ids it remembers.
COUNTED, KEPT = 1 << 17, 1 << 16
#: Tokens that are decoded at a time.
TOKENS = 1 << 16
#: Bytes of a word up to which its pairs are searched one by one, and short words merged in lockstep.
SHORT, LOCKSTEP = 64, 1 << 12
#: Bytes of ids or text in one Arrow batch.
BATCH = 1 << 22


def gather(flat: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` with these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - lengths), lengths)]


def running(lengths: np.ndarray) -> np.ndarray:
    """The sum of the lengths before each, and of all at the end."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


# --- the vocabulary -----------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next from U+0100."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        ids, alphabet = whole["model"]["vocab"], byte_alphabet()
        self.added = {token["content"]: token["id"] for token in whole["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, number in ids.items():
            self.bytes_of[number] = bytes(alphabet[c] for c in token)
        for token, number in self.added.items():
            self.bytes_of[number] = token.encode()
        #: The same bytes in one array, and where each token's begin.
        self.flat, self.widths = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.array([len(b) for b in self.bytes_of])
        self.starts = running(self.widths)
        self.first = [0] * 256
        for char, byte in alphabet.items():
            self.first[byte] = ids[char]
        #: (left, right) -> (rank, merged)
        self.merges = {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(whole["model"]["merges"])
        }
        pairs = sorted((a * len(self.bytes_of) + b, rank, merged) for (a, b), (rank, merged) in self.merges.items())
        #: The same merges as arrays: left times tokens plus right in order, rank, merged.
        self.pairs, self.ranks, self.merged = np.array(pairs, np.int64).reshape(-1, 3).T.copy()
        self.by_rank = np.empty(len(self.ranks), np.int32)
        self.by_rank[self.ranks] = self.merged
        bytes_ = np.array(self.first)
        #: The rank of every pair of bytes.
        self.byte_ranks = self._ranks_of(np.repeat(bytes_, 256), np.tile(bytes_, 256)).reshape(256, 256)
        names = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.added_pattern = re.compile(f"({'|'.join(names)})") if names else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of lowest rank, the leftmost of equal ones, is merged."""
        ids = [self.first[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word; short ones are merged in lockstep, those of like length together."""
        found = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        short = order[: np.searchsorted(lengths[order], SHORT, side="right")]
        for at in order[len(short) :].tolist():
            found[at] = packed(self._merge_long([self.first[b] for b in words[at]]))
        for first in range(0, len(short), LOCKSTEP):
            rows = short[first : first + LOCKSTEP]
            ids, ends = self._merge_rows([words[i] for i in rows.tolist()], lengths[rows])
            whole = ids.astype("<u4").tobytes()
            edges = (4 * ends).tolist()
            for at, a, b in zip(rows.tolist(), [0, *edges], edges, strict=False):
                found[at] = whole[a:b]
        return found

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges if it has none."""
        if not len(self.pairs):
            return np.zeros(len(left), np.int32)
        wanted = left.astype(np.int64) * len(self.bytes_of) + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], len(self.pairs)).astype(np.int32)

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, where each word's end)."""
        n, width, none = len(words), int(lengths.max()), len(self.pairs)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, np.int32)
        raw = np.zeros((n, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids[inside] = np.array(self.first, np.int32)[raw[inside]]
        # a place's rank is that of its token and the next one; a token stands where it begins
        ranks = np.full((n, width), none, np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.byte_ranks[raw[:, :-1][pair], raw[:, 1:][pair]]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        after[np.arange(n), lengths - 1] = width
        active = np.arange(n)
        while len(active):
            best = ranks[active].argmin(axis=1)
            rank = ranks[active, best]
            going = rank < none
            active, best, rank = active[going], best[going], rank[going]
            gone = after[active, best]
            following = after[active, gone]
            ids[active, best] = self.by_rank[rank]
            ids[active, gone] = -1
            ranks[active, gone] = none
            after[active, best] = following
            ranks[active, best] = none
            on = np.flatnonzero(following < width)
            rows, here, there = active[on], best[on], following[on]
            before[rows, there] = here
            ranks[rows, here] = self._ranks_of(ids[rows, here], ids[rows, there])
            earlier = before[active, best]
            on = np.flatnonzero(earlier >= 0)
            rows, here, there = active[on], earlier[on], best[on]
            ranks[rows, here] = self._ranks_of(ids[rows, here], ids[rows, there])
        kept = ids >= 0
        return ids[kept], np.cumsum(kept.sum(axis=1))

    def _merge_short(self, ids: list[int]) -> list[int]:
        merges, none = self.merges, (len(self.merges), -1)
        ranks = [merges.get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same from a heap of pairs, in about n log n steps."""
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        merges = self.merges
        pairs = enumerate(zip(ids, ids[1:], strict=False))
        waiting = [(merges[pair][0], i, merges[pair][1]) for i, pair in pairs if pair in merges]
        heapq.heapify(waiting)

        def push(i: int) -> None:
            found = merges.get((ids[i], ids[after[i]]))
            if found is not None:
                heapq.heappush(waiting, (found[0], i, found[1]))

        while waiting:
            _, i, merged = heapq.heappop(waiting)
            j = after[i]
            # a pair that has changed since it was pushed is left
            if ids[i] < 0 or j < 0 or merges.get((ids[i], ids[j]), (0, -1))[1] != merged:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Blocks of tokens at a time, so that the places of a long text's bytes are never all in memory."""
        ids = np.asarray(ids, np.int64)
        blocks = (ids[i : i + TOKENS] for i in range(0, len(ids), TOKENS))
        found = [gather(self.flat, self.starts[own], self.widths[own]).tobytes() for own in blocks]
        return b"".join(found).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- words --------------------------------------------------------------------------------

#: Code points that this library and the tokenizers library put in the same classes.
AGREED = re.compile("[\0-՗ -⁯₠-₿　-ゖァ-ヾ一-龥가-힣]*")
#: No word spans the place before such a space, so what lies between is split on its own.
FIELD = re.compile(r" (?=\S)")
#: The same holds for a line's end before a word, so long texts are cut there, too.
CUT = re.compile(r"[ \n](?=\S)")
#: Marks that are words of their own after letters.
ENDS = frozenset(".,;:!?)")
#: A space that is no such place; without one, every space is.
WIDE = re.compile(r" (?:\s|\Z)")
#: What the pattern cuts off behind a quote: letters that it takes with it.
TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, WHITE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The pattern's class of each code point below U+10000; of use where the libraries agree."""
    found = np.full(1 << 16, OTHER, np.uint8)
    agreed = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))) if AGREED.fullmatch(c))
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found[[ord(c) for c in regex.findall(name, agreed)]] = kind
    return found


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin in texts that follow one another; ``first`` is true where a text begins.

    A word is a run of one class with a space before it, if there is one. Of a run of white space the
    last one stands alone, or before the next word, unless the text ends there. A quote that begins
    a word takes one of TAILS with it.
    """
    kinds = classes()[points if points.dtype == np.uint8 else np.minimum(points, 0xFFFF)]
    white, inside = kinds == WHITE, ~first[1:]
    starts = first.copy()
    starts[1:] |= (kinds[1:] != kinds[:-1]) & (white[1:] | (points[:-1] != ord(" ")))
    starts[:-1] |= white[:-1] & ~white[1:] & inside
    quotes = np.flatnonzero(starts & (points == ord("'")))
    for tail in TAILS:
        at = quotes[quotes + len(tail) < len(points)]
        for step, letter in enumerate(tail, 1):
            at = at[(points[at + step] == ord(letter)) & ~first[at + step]]
        starts[at + 1] = False
        behind = at + 1 + len(tail)
        starts[behind[behind < len(points)]] = True
    return starts


class Splitter:
    """Texts in the vocabulary's words; in fields, which follow one another in a space, where the libraries may differ."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, regex.compile(pattern)
        self.original = None
        #: How long the words of fields are that hold code points of which the libraries may differ.
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        """Parts of BLOCK code points or a little more, between words."""
        start = 0
        while start < len(text):
            cut = CUT.search(text, start + BLOCK) if len(text) - start > BLOCK else None
            stop = cut.start() if cut else len(text)
            yield text[start:stop]
            start = stop

    @classmethod
    def blocks(cls, text: str) -> Iterator[tuple[str, list[str]]]:
        """(first field, the others without their space) of each of these parts."""
        for part in cls.pieces(text):
            first, *others = FIELD.split(part) if WIDE.search(part) else part.split(" ")
            yield first, others

    def cut(self, pieces: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(words of all pieces one after the other, how many each piece has); no piece is empty."""
        whole = "".join(pieces)
        raw = whole.encode()
        edges = running(np.array([len(piece) for piece in pieces], np.int64))
        first = np.zeros(len(whole), bool)
        first[edges[:-1]] = True
        plain = len(raw) == len(whole)
        points = np.frombuffer(raw, np.uint8) if plain else np.frombuffer(whole.encode("utf-32-le"), "<u4")
        starts = word_starts(points, first)
        for piece, edge in zip([] if plain else pieces, edges.tolist(), strict=False):
            if not (piece.isascii() or AGREED.fullmatch(piece)):
                starts[edge : edge + len(piece)] = False
                starts[edge + running(self._lengths(piece))[:-1]] = True
        at = np.flatnonzero(starts)
        places = np.append(at, len(whole))
        if not plain:
            widths = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000) + np.uint8(1)
            places = running(np.add.reduceat(widths, at, dtype=np.int64))
        buffers = [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)]
        words = pa.Array.from_buffers(pa.large_binary(), len(at), buffers)
        return words, np.diff(np.searchsorted(at, edges))

    def _lengths(self, piece: str) -> np.ndarray:
        """The code points of each word, field by field."""
        found = []
        for first, others in self.blocks(piece):
            found.extend(map(len, self.words(first)))
            for field in others:
                if field not in self.known:
                    if len(self.known) >= FIELDS:
                        self.known.clear()
                    self.known[field] = [len(word) for word in self.words(" " + field)]
                found.extend(self.known[field])
        return np.array(found, np.int64)

    def words(self, field: str) -> list[str]:
        if not (field.isascii() or AGREED.fullmatch(field)):
            return self._by_library(field)
        if field[:1] == " " and field[-1] in ENDS and field[1:-1].isalpha():
            return [field[:-1], field[-1]]
        one = field[1:].isalpha() and field[0] == " "
        return [field] if one else self.pattern.findall(field)

    def _by_library(self, text: str) -> list[str]:
        if self.original is None:
            from tokenizers import Tokenizer

            self.original = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.original.pre_tokenize_str(text)]


class Encoding:
    """Where the vocabulary file lies and how words are cut; small, so tasks get it whole."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    @property
    def vocabulary(self) -> Vocabulary:
        return vocabulary(self.path)

    def splitter(self) -> Splitter:
        return Splitter(self.path, self.pattern)

    def parts(self, text: str) -> list[str]:
        """Plain text at even places, added tokens between."""
        pattern = self.vocabulary.added_pattern
        return pattern.split(text) if pattern else [text]


def public_encoding() -> Encoding:
    import public_tokenizers

    return Encoding(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


# --- the lexicon --------------------------------------------------------------------------


class State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, State] = {}
        self.final = False
        self.number = -1
        self.words = 0


def minimal_automaton(words: list[bytes]) -> State:
    """The start of the smallest acyclic automaton of ``words``, which are sorted and distinct.

    Each word adds a path below the prefix it shares with the one before; what that one leaves
    behind can change no more, so its states are replaced by equal ones that exist already.
    """
    start, known = State(), {}
    #: (parent, byte, child) along the last word, from the place where states are still open
    path: list[tuple[State, int, State]] = []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            kind = (child.final, *((b, id(s)) for b, s in child.arcs.items()))
            parent.arcs[byte] = known.setdefault(kind, child)

    last = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        close(shared)
        state = path[-1][2] if path else start
        for byte in word[shared:]:
            child = state.arcs[byte] = State()
            path.append((state, byte, child))
            state = child
        state.final = True
        last = word
    close(0)
    return start


class Lexicon:
    """Arrays of the transducer: arcs by (state, byte), and the ids under each word's rank."""

    ARRAYS = ("keys", "targets", "outputs", "final", "places", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.targets, self.outputs, self.final, self.places, self.ids = (arrays[n] for n in self.ARRAYS)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(w for w in entries if w)
        start = minimal_automaton(words)
        states, waiting = [], [start]
        # children first: every state is numbered after all that it reaches
        while waiting:
            state = waiting[-1]
            todo = [s for s in state.arcs.values() if s.number < 0]
            if todo:
                waiting.extend(todo)
                continue
            waiting.pop()
            if state.number < 0:
                state.number = len(states)
                state.words = state.final + sum(s.words for s in state.arcs.values())
                states.append(state)
        keys, targets, outputs = [], [], []
        for state in states:
            before = int(state.final)
            for byte, child in sorted(state.arcs.items()):
                keys.append(state.number * 256 + byte)
                targets.append(child.number)
                outputs.append(before)
                before += child.words
        lengths = [len(entries[w]) for w in words]
        return cls(
            {
                "keys": np.array(keys, np.int32),
                "targets": np.array(targets, np.int32),
                "outputs": np.array(outputs, np.int32),
                "final": np.array([s.final for s in states], np.int32),
                "places": np.cumsum([0, *lengths], dtype=np.int32),
                "ids": np.array([x for w in words for x in entries[w]], np.int32),
            }
        )

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, name).astype("<i4") for name in self.ARRAYS]
        return b"".join(a.tobytes() for a in [np.array([len(a) for a in arrays], "<i4"), *arrays])

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The lexicon in a file, mapped into memory."""
        whole = np.memmap(path, dtype="<i4", mode="r")
        count = len(cls.ARRAYS)
        edges = count + np.cumsum([0, *whole[:count]])
        return cls({n: whole[a:b] for n, a, b in zip(cls.ARRAYS, edges[:-1], edges[1:], strict=True)})

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those that are not in the lexicon."""
        return self.ranks_of(np.frombuffer(b"".join(words), np.uint8), running(np.array([len(w) for w in words], np.int64)))

    def ranks_of(self, flat: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The same for words that lie one after the other in ``flat``, each between two of ``places``."""
        starts, lengths = places[:-1], np.diff(places)
        keys = np.asarray(self.keys)
        rank, state = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.final) - 1)
        alive = np.flatnonzero((lengths > 0) & (len(self.keys) > 0))
        rank[lengths == 0] = -1
        if not len(self.keys):
            return np.full(len(starts), -1)
        for step in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > step]
            if not len(alive):
                break
            # of the keys' own type, or each search copies all of them
            wanted = (state[alive] * 256 + flat[starts[alive] + step]).astype(keys.dtype)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            rank[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            rank[alive] += self.outputs[at]
        rank[(rank >= 0) & (self.final[state] == 0)] = -1
        return rank

    def packed_at(self, rank: int) -> bytes:
        """The ids of the word with this rank, as they stand in the file."""
        return self.ids[self.places[rank] : self.places[rank + 1]].tobytes()

    def packed_all(self, ranks: np.ndarray) -> list[bytes]:
        """The same for each rank; no ids where it is negative."""
        # plain views: slices of a memmap object cost several times as much
        places, view = np.asarray(self.places), memoryview(np.asarray(self.ids)).cast("B")
        firsts, ends = np.zeros((2, len(ranks)), np.int64)
        inside = ranks >= 0
        firsts[inside], ends[inside] = places[ranks[inside]], places[ranks[inside] + 1]
        return [bytes(view[a:b]) for a, b in zip((4 * firsts).tolist(), (4 * ends).tolist(), strict=True)]


# --- Spark --------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], encoding: Encoding, splitter: Splitter) -> Iterator[pa.Array]:
    """The words of the texts, BLOCK code points of them or a little more at a time."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            for part in encoding.parts(text.as_py())[::2]:
                for piece in splitter.pieces(part):
                    held.append(piece)
                    size += len(piece)
                    if size >= BLOCK:
                        yield splitter.cut(held)[0]
                        held, size = [], 0
    if held:
        yield splitter.cut(held)[0]


def word_counts(docs: DataFrame, encoding: Encoding) -> DataFrame:
    """(word, n) over all texts, for words of at most LONGEST bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held, size = encoding.splitter(), [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])

        def emptied() -> Iterator[pa.RecordBatch]:
            for batch in summed().to_batches():
                yield pa.record_batch({"word": batch.column("word").cast(pa.string()), "n": batch.column("n_sum")})

        for words in _blocks(batches, encoding, splitter):
            found = pc.value_counts(words.filter(pc.less_equal(pc.binary_length(words), LONGEST)))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            size += len(found)
            if size > 2 * COUNTED:
                held = [summed().rename_columns({"n_sum": "n"})]
                size = held[0].num_rows
                if size > COUNTED:
                    yield from emptied()
                    held, size = [], 0
        if held:
            yield from emptied()

    partial = docs.select(text_of().alias("text")).mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> DataFrame:
    """The rows of ``counts`` (word, n) with the most frequent words, ``size`` at most.

    The cut is a number of occurrences from a short histogram, so no task and not the driver
    gets more than that; words as frequent as the cut come all or none.
    """
    step = F.floor(F.log2("n") * STEPS).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, total = 64 * STEPS, 0
    for row in sorted(steps, reverse=True):
        total += row.words
        if total > size:
            break
        least = row.step
    return counts.filter(step >= least)


def fit_lexicon(docs: DataFrame, encoding: Encoding, size: int = SIZE) -> Lexicon:
    """The lexicon of the most frequent words; no more than these, ``size`` at most, reach the driver."""

    def make() -> Callable[[pa.Array], pa.Array]:
        merge_all = encoding.vocabulary.merge_all
        return lambda words: pa.array(merge_all([w.encode() for w in words.to_pylist()]), pa.binary())

    with own_scratch(docs.sparkSession):
        top = frequent_words(cut_lineage(word_counts(docs, encoding), "words"), size)
        made = _through(top.select(F.col("word").alias("key"), "word"), "word", T.StructField("ids", T.BinaryType()), make)
        return Lexicon.compile({r.key.encode(): np.frombuffer(r.ids, "<i4").tolist() for r in made.collect()})


def publish(spark: SparkSession, lexicon: Lexicon) -> str:
    """Writes the lexicon to the shared folder and has Spark hand it to every executor."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lexicon')}/{name}")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(lexicon.to_bytes())
    finally:
        out.close()
    spark.sparkContext.addFile(where.toString())
    return name


class Encoder:
    """What a task needs to turn texts into ids."""

    def __init__(self, encoding: Encoding, lexicon: Lexicon):
        self.encoding, self.lexicon, self.splitter = encoding, lexicon, encoding.splitter()
        #: The words seen last, their ids one after the other, and where each word's begin.
        self.known, self.ids, self.places = pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words one after the other, how many each has): remembered, from the lexicon, or merged."""
        at = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy()
        fresh = np.flatnonzero(at < 0)
        unknown = words.take(fresh)
        flat, places = _raw(unknown)
        ranks = self.lexicon.ranks_of(flat, places)
        outside = np.flatnonzero(ranks < 0)
        merged = self.encoding.vocabulary.merge_all(unknown.take(outside).to_pylist())
        lengths = [np.diff(self.places), np.diff(self.lexicon.places), np.array([len(ids) // 4 for ids in merged], np.int64)]
        # the three sources as one: each word's place among them
        place = at.astype(np.int64)
        place[fresh] = len(self.known) + ranks
        place[fresh[outside]] = len(lengths[0]) + len(lengths[1]) + np.arange(len(outside))
        whole = np.concatenate([self.ids, self.lexicon.ids, np.frombuffer(b"".join(merged), "<i4")])
        lengths = np.concatenate(lengths)
        ids, sizes = gather(whole, running(lengths)[place], lengths[place]), lengths[place]
        self._remember(words, ids, sizes, at[at >= 0])
        return ids, sizes

    def _remember(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray, met: np.ndarray) -> None:
        """Keeps these words, but no long ones, then those longest unmet go first."""
        rest = np.ones(len(self.known), bool)
        rest[met] = False
        own = np.flatnonzero(np.diff(_raw(words)[1]) <= LONGEST)[:KEPT]
        rest = np.flatnonzero(rest)[: KEPT - len(own)]
        lengths = np.diff(self.places)
        self.known = pa.concat_arrays([words.take(own), self.known.take(rest)])
        self.ids = np.concatenate(
            [gather(ids, running(sizes)[own], sizes[own]), gather(self.ids, self.places[rest], lengths[rest])]
        )
        self.places = running(np.concatenate([sizes[own], lengths[rest]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        added = self.encoding.vocabulary.added
        found: list[list[bytes]] = [[] for _ in texts]
        #: Pieces of texts that wait, and where their ids go.
        held: list[tuple[int, int, str]] = []
        size = 0

        def release() -> None:
            words, counts = self.splitter.cut([piece for _, _, piece in held])
            coded = words.dictionary_encode()
            ids, sizes = self.look_up(coded.dictionary)
            codes = coded.indices.to_numpy()
            lengths = sizes[codes]
            whole = gather(ids, running(sizes)[codes], lengths).astype("<u4", copy=False).tobytes()
            edges = (4 * running(lengths)[running(counts)]).tolist()
            for (row, place, _), a, b in zip(held, edges, edges[1:], strict=False):
                found[row][place] = whole[a:b]

        for row, text in enumerate(texts):
            for i, part in enumerate(self.encoding.parts(text)):
                if i % 2:
                    found[row].append(packed([added[part]]))
                    continue
                for piece in self.splitter.pieces(part):
                    held.append((row, len(found[row]), piece))
                    found[row].append(b"")
                    size += len(piece)
                    if size >= BLOCK:
                        release()
                        held, size = [], 0
        if held:
            release()
        return [b"".join(parts) for parts in found]


def _raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, places in them between which the words lie one after the other)."""
    _, places, flat = words.buffers()
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(flat or b"", np.uint8), np.frombuffer(places, np.int64)[words.offset :][: len(words) + 1]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _slices(column: pa.Array, limit: int = BATCH) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a text or binary column, each of about ``limit`` bytes or one row."""
    first, size = 0, 0
    for i, length in enumerate(pa.compute.binary_length(column).to_pylist()):
        size += length
        if size >= limit:
            yield first, column.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < len(column):
        yield first, column.slice(first)


def _through(df: DataFrame, column: str, added: T.StructField, make: Callable) -> DataFrame:
    """``df`` with ``column``, its last one, replaced by ``added``; ``make()`` gives a task's function of arrays."""

    def alone() -> Callable[[pa.Array], list[pa.Array]]:
        function = make()
        return lambda values: [function(values)]

    return _through_all(df, column, [added], alone)


def _through_all(df: DataFrame, column: str, added: list[T.StructField], make: Callable) -> DataFrame:
    """The same with several columns in place of one; the function gives a list of arrays."""
    schema = T.StructType([*df.drop(column).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for first, part in _slices(batch.column(batch.num_columns - 1)):
                own = [c.slice(first, len(part)) for c in batch.columns[:-1]]
                yield pa.record_batch([*own, *function(part)], names=schema.names)

    return df.mapInArrow(run, schema)


IDS, DECODED = T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())


def _encoder(encoding: Encoding, name: str) -> Callable[[pa.Array], pa.Array]:
    """A task's function from texts to packed ids; ``name`` is that of the published lexicon."""
    encoder = Encoder(encoding, Lexicon.mapped(SparkFiles.get(name)))
    return lambda texts: pa.array(encoder.encode(texts.to_pylist()), pa.binary())


def _decoder(encoding: Encoding) -> Callable[[pa.Array], pa.Array]:
    """A task's function from packed ids to texts."""
    own = encoding.vocabulary
    return lambda packed: pa.array([own.decode(np.frombuffer(x, "<u4")) for x in packed.to_pylist()], pa.string())


def _texts(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`"), text_of().alias("bpe_text"))


def encode(
    docs: DataFrame, id_column: str = "doc_id", encoding: Encoding | None = None, lexicon: Lexicon | None = None
) -> DataFrame:
    """(id, ids) per row; ``ids`` packs the text's ids as little-endian 32-bit numbers.

    ``unpacked`` turns them into an array. Without a lexicon, one is fitted on all of ``docs``.
    """
    encoding = encoding or public_encoding()
    name = publish(docs.sparkSession, lexicon or fit_lexicon(docs, encoding))
    return _through(_texts(docs, id_column), "bpe_text", IDS, lambda: _encoder(encoding, name))


def round_trip(
    docs: DataFrame, id_column: str = "doc_id", encoding: Encoding | None = None, lexicon: Lexicon | None = None
) -> DataFrame:
    """(id, ids, decoded): ``decode`` of ``encode`` in one pass.

    Two steps in a row would keep two Python workers a task, each with a vocabulary of its own.
    """
    encoding = encoding or public_encoding()
    name = publish(docs.sparkSession, lexicon or fit_lexicon(docs, encoding))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        to_ids, to_text = _encoder(encoding, name), _decoder(encoding)

        def both(texts: pa.Array) -> list[pa.Array]:
            ids = to_ids(texts)
            return [ids, to_text(ids)]

        return both

    return _through_all(_texts(docs, id_column), "bpe_text", [IDS, DECODED], make)


def unpacked(encoded: DataFrame) -> DataFrame:
    """``ids`` as array<int>."""

    def make() -> Callable[[pa.Array], pa.Array]:
        def arrays(packed: pa.Array) -> pa.Array:
            found = [np.frombuffer(x, "<i4") for x in packed.to_pylist()]
            return pa.array(found, pa.list_(pa.int32()))

        return arrays

    others = [c for c in encoded.columns if c != "ids"]
    return _through(encoded.select(*others, "ids"), "ids", T.StructField("ids", T.ArrayType(T.IntegerType())), make)


def decode(encoded: DataFrame, encoding: Encoding | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its packed ``ids``."""
    encoding = encoding or public_encoding()
    rows = encoded.withColumn("bpe_ids", F.col("ids"))
    return _through(rows, "bpe_ids", DECODED, lambda: _decoder(encoding))


def encoding_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return round_trip(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
