"""Byte-level BPE with a lexicon of frequent words, compiled into a minimal transducer."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import map_rows, settled

# Unicode's white space, and the pattern that cuts a text into words.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_SPACE_THEN_SPACE = re.compile(rf"\x20[{SPACE}]|\x20\Z")
_LONE_SPACE = re.compile(rf"\x20(?=[^{SPACE}])")

LEXICON_WORDS = 200_000
MAX_CACHED_PIECES = 500_000
SCANNED_BYTES = 64
MAX_PIECE = 40  # longer pieces are neither in the lexicon nor kept for later texts
HEAD_BYTES, MAX_HEADS = 4, 100_000  # beginnings of words whose state in the lexicon is remembered
LEVELS = 8
ENDS = frozenset(",.;:!?")
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 60


@dataclass(frozen=True)
class Vocabulary:
    """A public byte-level BPE vocabulary: tokens as bytes, merges by rank, special tokens."""

    tokens: dict[int, bytes]
    merges: dict[tuple[int, int], int]  # pair of ids -> rank << ID_BITS | id of both together
    bytes_to_id: list[int]
    special: dict[str, int]


def visible_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes.

    Printable bytes stand for themselves, the others for 256, 257, ... in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in printable]
    return ({chr(byte): byte for byte in printable}
            | {chr(256 + place): byte for place, byte in enumerate(rest)})


def load_vocabulary(path: str) -> Vocabulary:
    """A vocabulary from the JSON file of a public tokenizer; the driver reads it."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    byte_of = visible_bytes()
    ids = stored["model"]["vocab"]
    special = {token["content"]: token["id"] for token in stored["added_tokens"]}
    tokens = {number: bytes(byte_of[char] for char in token)
              for token, number in ids.items() if token not in special}
    tokens |= {number: token.encode() for token, number in special.items()}
    merges = {}
    for rank, pair in enumerate(stored["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[ids[left], ids[right]] = rank << ID_BITS | ids[left + right]
    singles = {byte: ids[char] for char, byte in byte_of.items()}
    return Vocabulary(tokens, merges, [singles[byte] for byte in range(256)], special)


def merge(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one word: always the pair of least rank is merged, the leftmost first."""
    if len(word) > SCANNED_BYTES:
        return _merge_long(word, vocabulary)
    get, ids = vocabulary.merges.get, list(map(vocabulary.bytes_to_id.__getitem__, word))
    ranks = list(map(get, zip(ids, ids[1:]), repeat(NO_MERGE)))
    while ranks:
        best = min(ranks)
        if best == NO_MERGE:
            break
        at = ranks.index(best)
        ids[at] = new = best & ID_MASK
        del ids[at + 1], ranks[at]
        if at:
            ranks[at - 1] = get((ids[at - 1], new), NO_MERGE)
        if at < len(ranks):
            ranks[at] = get((new, ids[at + 1]), NO_MERGE)
    return ids


def _merge_long(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The same with a heap over linked places: a word of n bytes takes n log n steps."""
    ids = [vocabulary.bytes_to_id[byte] for byte in word]
    merges = vocabulary.merges
    n = len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(found, at, ids[at], ids[at + 1]) for at in range(n - 1)
            if (found := merges.get((ids[at], ids[at + 1])))]
    heapq.heapify(heap)
    while heap:
        found, at, left, right = heapq.heappop(heap)
        follower = after[at]
        if ids[at] != left or follower >= n or ids[follower] != right:
            continue  # one of the two has been merged since
        new = found & ID_MASK
        ids[at], ids[follower] = new, -1
        after[at] = after[follower]
        if after[at] < n:
            before[after[at]] = at
            if found := merges.get((new, ids[after[at]])):
                heapq.heappush(heap, (found, at, new, ids[after[at]]))
        if (previous := before[at]) >= 0:
            if found := merges.get((ids[previous], new)):
                heapq.heappush(heap, (found, previous, ids[previous], new))
    return [number for number in ids if number >= 0]


class Lexicon:
    """Words with ids in a minimal acyclic transducer, laid out to be memory-mapped.

    Words that end alike share states.  Each edge adds a number, and the sum
    along a word's path is its rank among the words, which finds its ids.  The
    image has the lengths of its parts, then parts of 32-bit integers: first edge
    and finality of each state, targets and numbers of the edges, where each word's
    ids begin, and the ids; then the edges' bytes.
    """

    PARTS = 7

    def __init__(self, image: mmap.mmap):
        lengths = memoryview(image)[:4 * self.PARTS].cast("i").tolist()
        parts, at = [], 4 * self.PARTS
        for length in lengths[:-1]:
            parts.append(memoryview(image)[at:at + 4 * length].cast("i"))
            at += 4 * length
        self.image, self.labels = image, at
        self.first, self.final, self.target, self.add, self.begin, self.ids = parts
        self.ids_at = self.labels - 4 * lengths[-2]
        self.heads: dict[bytes, tuple[int, int] | None] = {}

    def get(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, None where the lexicon doesn't have it."""
        found = self.stored(word)
        return None if found is None else memoryview(found).cast("i").tolist()

    def stored(self, word: bytes) -> bytes | None:
        """The ids of ``word`` as the image has them, 32 bits each.

        Many words begin alike, so where their first bytes lead to is remembered.
        """
        head = word[:HEAD_BYTES]
        if head in self.heads:
            reached = self.heads[head]
        else:
            reached = self._walk(head, 0, 0)
            if len(self.heads) < MAX_HEADS:
                self.heads[head] = reached
        if reached and len(word) > HEAD_BYTES:
            reached = self._walk(word[HEAD_BYTES:], *reached)
        if not reached or not self.final[reached[0]]:
            return None
        begin, at = self.begin, self.ids_at
        return self.image[at + 4 * begin[reached[1]]:at + 4 * begin[reached[1] + 1]]

    def _walk(self, word: bytes, state: int, rank: int) -> tuple[int, int] | None:
        """The state behind ``word`` from a state on, and the sum along the way."""
        first, target, add, labels, find = (
            self.first, self.target, self.add, self.labels, self.image.find)
        for place in range(len(word)):
            edge = find(
                word[place:place + 1], labels + first[state], labels + first[state + 1]) - labels
            if edge < 0:
                return None
            rank += add[edge]
            state = target[edge]
        return state, rank


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The image of a lexicon: states are made minimal while words are added in order."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # states on the path of the last word: final, edges

    def close(depth: int) -> None:
        """Settle the path below ``depth``: equal states become one."""
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last = b""
    for word in sorted(words):
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    below = []  # words that a state accepts; its targets were settled before it
    for final, edges in states:
        below.append(final + sum(below[target] for _, target in edges))
    order = len(states) - 1  # the start becomes state 0
    first, final, target, add = (array("i") for _ in range(4))
    label = bytearray()
    for state in range(order, -1, -1):
        ends, edges = states[state]
        first.append(len(label))
        final.append(ends)
        passed = int(ends)
        for byte, to in edges:
            label.append(byte)
            target.append(order - to)
            add.append(passed)
            passed += below[to]
    first.append(len(label))
    begin, ids = array("i", [0]), array("i")
    for word in sorted(words):
        ids.extend(words[word])
        begin.append(len(ids))
    parts = (first, final, target, add, begin, ids, label)
    return b"".join(map(bytes, (array("i", map(len, parts)), *parts)))


def mapped(image: bytes) -> mmap.mmap:
    """The image in a memory map of its own, outside the heap, which goes with its process."""
    region = mmap.mmap(-1, len(image))
    region.write(image)
    return region


def pieces(text: str) -> Iterator[str]:
    """A text cut before each space that is followed by something else than white space.

    No word crosses such a place and no cut looks beyond it, so the words of the
    pieces are the words of the text.
    """
    at = 0
    for cut in _LONE_SPACE.finditer(text):
        if cut.start() > at:
            yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


class Codec:
    """Encodes texts to ids, as little-endian 32-bit integers, and back."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.plain = _Pieces(self, "")
        self.spaced = _Pieces(self, " ")
        self.marks: dict[str, bytes] = {}  # words that are not letters

    def ids_of(self, word: str) -> bytes:
        data = word.encode("utf-8", "replace")
        ids = self.lexicon.stored(data)
        return array("I", merge(data, self.vocabulary)).tobytes() if ids is None else ids

    def word(self, word: str) -> bytes:
        """The ids of one word of a piece that has several, by what was met before."""
        if word.isalpha():
            return self.plain[word]
        if word[0] == " " and word[1:].isalpha():
            return self.spaced[word[1:]]
        ids = self.marks.get(word)
        if ids is None:
            ids = self.ids_of(word)
            if len(word) <= MAX_PIECE:
                self.marks[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special is None:
            return self._encode(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out.append(self._encode(text[at:found.start()]))
            out.append(self.vocabulary.special[found[0]].to_bytes(4, "little"))
            at = found.end()
        return b"".join([*out, self._encode(text[at:])])

    def _encode(self, text: str) -> bytes:
        for cache in (self.plain, self.spaced, self.marks):
            if len(cache) > MAX_CACHED_PIECES:
                cache.clear()
        if _SPACE_THEN_SPACE.search(text):
            return b"".join([self.plain[piece] for piece in pieces(text)])
        head, *rest = text.split(" ")  # the same pieces, without their spaces
        return self.plain[head] + b"".join([self.spaced[piece] for piece in rest])

    def decode(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.vocabulary.tokens.__getitem__, numbers)).decode("utf-8", "replace")


class _Pieces(dict):
    """Ids of pieces met before; all begin with the same prefix, which is not in the key."""

    def __init__(self, codec: Codec, prefix: str):
        super().__init__()
        self.codec, self.prefix = codec, prefix

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():  # letters are one word
            ids = self.codec.ids_of(self.prefix + piece)
        elif piece[:-1].isalpha() and piece[-1] in ENDS:  # such a mark is one after letters
            ids = self[piece[:-1]] + self.codec.plain[piece[-1]]
        else:
            ids = b"".join(map(self.codec.word, WORDS.findall(self.prefix + piece)))
        if len(piece) <= MAX_PIECE:  # so the number kept bounds their bytes
            self[piece] = ids
        return ids


def frequent_pieces(docs: DataFrame, size: int = LEXICON_WORDS, text: str = "text") -> DataFrame:
    """The most frequent pieces between spaces over all texts, at most ``size``.

    Pieces are counted in the JVM.  Counts are put on a scale of ``LEVELS`` steps
    to a doubling, a few hundred at most, and pieces are taken from the top step
    on while they are no more than ``size``: nothing is sorted, and the driver
    sees the scale only.  Pieces that stand once are no gain and left out.
    """
    pieces = docs.select(F.explode(F.split(text, " ", -1)).alias("piece"))
    level = F.floor(F.log2("count") * LEVELS).alias("level")
    counted = settled(
        pieces.groupBy("piece").count().filter(
            (F.col("count") > 1) & (F.length("piece") <= MAX_PIECE)).select("piece", level),
        "pieces")
    sizes = {row["level"]: row["count"] for row in counted.groupBy("level").count().collect()}
    least, total = LEVELS * 64, 0
    for found in sorted(sizes, reverse=True):
        total += sizes[found]
        if total > size:
            break
        least = found
    return counted.filter(F.col("level") >= least).select("piece")


def build_lexicon(
    docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS, text: str = "text",
) -> bytes:
    """The image of a lexicon of the words in the ``size`` most frequent pieces.

    Only the chosen pieces reach the driver, and what executors get of them is
    bounded by ``size`` too.
    """
    words = {word.encode("utf-8", "replace")
             for row in frequent_pieces(docs, size, text).collect()
             for word in WORDS.findall(" " + row["piece"])}
    return compile_lexicon({word: merge(word, vocabulary) for word in words})


# The codec of a Python worker, by its lexicon: later tasks use the pieces met before.
_CODECS: dict[str, Codec] = {}


def encode(
    docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``ids``, little-endian 32-bit integers, and ``decoded``.

    ``decoded`` is the text made again of the ids.  Words of the lexicon are looked up,
    all others merged, with the same ids.  A null text counts as empty and has no
    ids; repeated rows give repeated rows; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    lexicon = build_lexicon(docs, vocabulary, size, text)
    image = spark.sparkContext.broadcast(lexicon)
    name = hashlib.sha256(lexicon).hexdigest()
    kind = docs.schema[id_column].dataType.simpleString()

    def per_task():
        if name not in _CODECS:
            _CODECS.clear()
            _CODECS[name] = Codec(shared.value, Lexicon(mapped(image.value)))
        codec = _CODECS[name]

        def of(key, value):
            ids = codec.encode(value or "")
            return key, ids, codec.decode(ids)

        return of

    return map_rows(
        docs.select(id_column, text), per_task, f"`{id_column}` {kind}, ids binary, decoded string")
