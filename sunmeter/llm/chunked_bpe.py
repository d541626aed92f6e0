"""Byte-level BPE by ranks: overlapping chunks cut into pieces in parallel, stitched, encoded."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmeter.llm.bpe import SPACE
from sunmeter.llm.common import flat_map_rows, held, map_rows, settled

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512  # of a chunk with the next one
LOOK_AHEAD = 16  # code points behind a piece that it may depend on, at most
SCANNED_BYTES = 64  # longer pieces are merged with a heap
KEPT_CHARS = 32  # longer pieces are not kept for later texts
KEPT_PIECES = 300_000  # of a Python worker, in each of two generations
BLOCK_PIECES = 65_536  # pieces of a text that are held at a time
NO_RANK = 1 << 31


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with their ranks, which are the ids, and the pattern that cuts a text into pieces."""

    ranks: dict[bytes, int]
    pattern: str

    @cached_property
    def name(self) -> str:
        digest = hashlib.sha256(self.pattern.encode())
        for token, rank in self.ranks.items():
            digest.update(b"%d:%d:%b" % (rank, len(token), token))
        return digest.hexdigest()


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A vocabulary from a file of ranks (token in base64, rank); the driver reads it."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in rows}, pattern)


def compiled(pattern: str) -> regex.Pattern:
    """The pattern, white space being Unicode's own: ``regex`` counts four controls more.

    Pieces must follow each other without gaps, and must not depend on what lies before
    them, so the pattern may look ahead only.
    """
    if "(?<" in pattern or "^" in pattern.replace("[^", "") or r"\b" in pattern:
        raise ValueError("the pattern looks behind")
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(
        r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """The rank of every two bytes, at 256 times the first plus the second."""
    return [ranks.get(bytes((one, two)), NO_RANK) for one in range(256) for two in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], two: list[int]) -> list[int]:
    """The ids of one piece: always the pair of least rank is merged, the leftmost first.

    ``two`` are the ranks of ``byte_pairs``, with which every piece begins.
    """
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SCANNED_BYTES:
        return _merge_long(piece, ranks)
    get = ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [two[one << 8 | other] for one, other in zip(piece, piece[1:])]
    while pairs and (best := min(pairs)) != NO_RANK:
        at = pairs.index(best)
        del pairs[at], cuts[at + 1]
        if at:
            pairs[at - 1] = get(piece[cuts[at - 1]:cuts[at + 1]], NO_RANK)
        if at < len(pairs):
            pairs[at] = get(piece[cuts[at]:cuts[at + 2]], NO_RANK)
    return [ranks[piece[begin:end]] for begin, end in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over places: a piece of n bytes takes n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at a place; 0 if none does
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        """The pair of the part at ``at`` and the next, if it has a rank."""
        if at >= 0 and end[at] < n:
            past = end[end[at]]
            rank = ranks.get(piece[at:past])
            if rank is not None:
                heapq.heappush(heap, (rank, at, past))

    for place in range(n - 1):
        offer(place)
    while heap:
        _, at, past = heapq.heappop(heap)
        follower = end[at]
        if not follower or follower >= n or end[follower] != past:
            continue  # one of the two has been merged since
        end[at], end[follower] = past, 0
        if past < n:
            before[past] = at
        offer(at)
        offer(before[at])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return ids


class _Pieces(dict):
    """Ids of pieces met before, as little-endian 32-bit integers.

    There are two generations: when this one is full it becomes the older one, and a
    piece that is met again comes back from there.  So pieces that are frequent
    stay, and those that stand once or twice go.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.two = ranks, byte_pairs(ranks)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            ids = array("I", merge(data, self.ranks, self.two)).tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes texts piece by piece, and decodes ids by putting their bytes together."""

    def __init__(self, vocabulary: Vocabulary):
        self.pattern = compiled(vocabulary.pattern)
        self.pieces = _Pieces(vocabulary.ranks)
        self.tokens = {rank: token for token, rank in vocabulary.ranks.items()}

    def ends(self, text: str) -> array:
        """Where the pieces of a chunk end."""
        return array("I", [found.end() for found in self.pattern.finditer(text)])

    def encode(self, text: str) -> bytes:
        if len(text) <= BLOCK_PIECES:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        found, out = (match[0] for match in self.pattern.finditer(text)), bytearray()
        while some := list(islice(found, BLOCK_PIECES)):
            out += b"".join(map(self.pieces.__getitem__, some))
        return bytes(out)

    def encode_cut(self, text: str, ends: array) -> bytes:
        """The ids of pieces that are known: from each of ``ends`` to the next."""
        return b"".join([self.pieces[text[a:b]] for a, b in zip(ends, ends[1:])])

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.tokens.__getitem__, numbers))


# The codec of a Python worker, by its vocabulary: later tasks use the pieces met before.
_CODECS: dict[str, Codec] = {}


def _with_codec(vocabulary, name: str, make: Callable[[Codec], Callable]) -> Callable:
    """``per_task`` of ``map_rows``: a function that uses the worker's codec."""
    def per_task():
        if name not in _CODECS:
            _CODECS.clear()
            _CODECS[name] = Codec(vocabulary.value)
        return make(_CODECS[name])

    return per_task


def _packed(ends: array) -> bytes:
    """Ends as the lengths of pieces, which are small numbers."""
    return array("H", [b - a for a, b in zip([0, *ends], ends)]).tobytes()


def _unpacked(lengths: bytes) -> array:
    """Where pieces begin and end, from their lengths."""
    found, at = array("I", [0]), 0
    for length in memoryview(lengths).cast("H"):
        at += length
        found.append(at)
    return found


@dataclass(frozen=True)
class Cut:
    """How texts are cut: a chunk has ``chars``, and ``overlap`` more that the next one has too."""

    chars: int = CHUNK_CHARS
    overlap: int = OVERLAP_CHARS

    def __post_init__(self):
        if not LOOK_AHEAD < self.overlap < self.chars <= 0xFFFF - self.overlap:
            raise ValueError("chunks and overlaps of such lengths can't be stitched")

    def chunks(self, digest: str, text: str) -> Iterator[tuple]:
        """(digest, place, last, text) of a text's chunks."""
        last = max(0, len(text) - self.overlap - 1) // self.chars
        for place in range(last + 1):
            begin = place * self.chars
            yield digest, place, place == last, text[begin:begin + self.chars + self.overlap]

    def near_seams(self, ends: array, size: int, last: bool) -> tuple[list[int], list[int]]:
        """The ends of a chunk of ``size`` within its overlaps, before and behind.

        Each list counts from where the later of the two chunks begins.  Ends so near to
        the end of a chunk that the next one may change them are left out.
        """
        known = size if last else size - LOOK_AHEAD
        head = [0, *(end for end in islice(ends, self.overlap) if end <= min(self.overlap, known))]
        tail = [end - self.chars for end in ends[-self.overlap - 1:] if self.chars <= end <= known]
        return head, tail


def chunks(texts: DataFrame, vocabulary, name: str, cut: Cut) -> DataFrame:
    """The chunks of ``texts`` (digest, text), each text once, cut into pieces by themselves.

    All chunks are dealt out over the tasks, those of one text too.  A chunk's pieces
    begin as if the text began there, and are given by their ``lengths``; ``head`` and
    ``tail`` are where pieces end within its overlaps.
    """
    dealt = flat_map_rows(
        texts.select("digest", "text"), lambda: cut.chunks,
        "digest string, place int, last boolean, text string")

    def make(codec: Codec):
        def pieces(digest, place, last, text):
            ends = codec.ends(text)
            return digest, place, last, text, _packed(ends), *cut.near_seams(ends, len(text), last)

        return pieces

    return map_rows(
        dealt.dropDuplicates(["digest", "place"]), _with_codec(vocabulary, name, make),
        "digest string, place int, last boolean, text string, lengths binary, "
        "head array<int>, tail array<int>")


def seams(found: DataFrame, cut: Cut) -> DataFrame:
    """(digest, place, begin, end, stitched): which part of each chunk's pieces are the text's.

    Pieces depend on what follows only.  So where an end in the tail of a chunk is an
    end in the head of the next as well, both go on alike from there: the first such
    place is the seam.  ``stitched`` is false for all chunks of a text that lacks a seam
    anywhere, as where one piece fills an overlap.  Only the ends near the seams are moved.
    """
    of_text = Window.partitionBy("digest")
    in_order = of_text.orderBy("place")
    seam = F.array_min(F.array_intersect("tail", F.lead("head").over(in_order)))
    rows = found.select("digest", "place", "last", seam.alias("seam"))
    return rows.select(
        "digest", "place", F.coalesce(F.lag("seam").over(in_order), F.lit(0)).alias("begin"),
        (F.col("seam") + cut.chars).alias("end"),
        F.min(F.col("last") | F.col("seam").isNotNull()).over(of_text).alias("stitched"))


def _joined_bytes(parts: str, name: str) -> Column:
    """The bytes of all parts in order, in time proportional to their length."""
    return F.unhex(F.array_join(F.transform(
        F.array_sort(parts), lambda part: F.hex(part[name])), ""))


def encode_long(texts: DataFrame, vocabulary, name: str, cut: Cut) -> DataFrame:
    """(digest, ids, decoded) of each of ``texts`` (digest, text), by overlapping chunks."""
    found = settled(chunks(texts, vocabulary, name, cut), "bpe-chunks")
    sewn = settled(seams(found, cut), "bpe-seams")

    def of_part(codec: Codec):
        def encode(digest, place, text, lengths, begin, end):
            known = _unpacked(lengths)
            last = len(known) - 1 if end is None else known.index(end)
            ids = codec.encode_cut(text, known[known.index(begin):last + 1])
            return digest, place, ids, codec.decode(ids)

        return encode

    placed = found.join(sewn.filter("stitched"), ["digest", "place"])
    parts = map_rows(
        placed.select("digest", "place", "text", "lengths", "begin", "end"),
        _with_codec(vocabulary, name, of_part),
        "digest string, place int, ids binary, decoded binary")
    parts = parts.groupBy("digest").agg(
        F.collect_list(F.struct("place", "ids", "decoded")).alias("parts"))
    stitched = parts.select("digest", *[
        _joined_bytes("parts", part).alias(part) for part in ("ids", "decoded")])

    def of_text(codec: Codec):
        def encode(digest, text):
            ids = codec.encode(text)
            return digest, ids, codec.decode(ids)

        return encode

    own = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, cut.chars))
    whole = found.join(sewn.filter("not stitched").select("digest", "place"), ["digest", "place"])
    whole = whole.groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct("place", own.alias("text")))).alias("parts"))
    whole = whole.select("digest", F.array_join(F.col("parts.text"), "").alias("text"))
    return stitched.unionByName(map_rows(
        whole, _with_codec(vocabulary, name, of_text), "digest string, ids binary, decoded binary"))


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text: str = "text",
    cut: Cut = Cut(),
) -> DataFrame:
    """One row per document: id, ``ids``, little-endian 32-bit integers, and ``decoded`` bytes.

    A text of one chunk is cut into pieces and encoded where it is.  Longer ones
    are cut into chunks that overlap, each text once however often it stands;
    the chunks are cut into pieces in parallel, stitched where both sides of an overlap
    agree on an end, and encoded in parallel.  A text in which some overlap has no such
    place, because a piece fills it, is cut from its beginning instead.  Decoding puts
    together the bytes of the tokens, part by part.

    A null text counts as empty and has no ids; null ids stay; repeated rows give repeated
    rows; an empty table stays empty; other columns are not read.  An id column named
    like a result is refused.
    """
    if id_column in ("ids", "decoded"):
        raise ValueError("the id column must not be named ids or decoded")
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.name
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") > cut.chars + cut.overlap
    kind = docs.schema[id_column].dataType.simpleString()

    def of_text(codec: Codec):
        def encode(key, value):
            ids = codec.encode(value)
            return key, ids, codec.decode(ids)

        return encode

    short = map_rows(
        rows.filter(~is_long), _with_codec(shared, name, of_text),
        f"id {kind}, ids binary, decoded binary")
    long = held(rows.filter(is_long), "id", "text", digest=F.sha2("text", 256))
    encoded = encode_long(long, shared, name, cut)
    # Keys that are new to Spark, so that both sides are dealt out and hot texts are split.
    left = long.select("id", F.reverse("digest").alias("key"))
    right = encoded.select(F.reverse("digest").alias("key"), "ids", "decoded")
    both = short.unionByName(left.join(right, "key").drop("key"))
    return both.withColumnRenamed("id", id_column)
