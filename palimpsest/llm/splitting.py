"""Splitting oversized items at natural boundaries by packing a structure tree.

A text is parsed into a tree: MIME parts, sections nested by the depth of their headings,
paragraphs, lists nested by their indentation, markup blocks, lines, sentences, words,
characters. Only a node that is too large by itself is descended into. From the bottom up,
sibling subtrees are merged while they fit the limit, so what is left over of a large child
is joined with its next sibling; a piece too small to stand alone takes in a part of its
neighbour, cut at the strongest boundary within reach. Consecutive pieces share `overlap`
tokens, a token being one byte of UTF-8; where that would cut a character the shared part
begins with the whole character.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = re.compile(rb"^--[^\s-][^\r\n]*$", re.M)
HEADING = re.compile(rb"^(?:(#{1,6})[ \t]+\S|<h([1-6])\b|[^\s\r\n][^\r\n]*\r?\n(={3,}|-{3,})[ \t]*\r?$)", re.M | re.I)
PARAGRAPH = re.compile(rb"\n[ \t\r]*\n[\r\n]*")
ITEM = re.compile(rb"^([ \t>]*)(?:[-*+]|\xe2\x80\xa2|\d{1,3}[.)])[ \t]+\S", re.M)
MARKUP = re.compile(rb"</?(?:p|div|li|ul|ol|tr|table|br|blockquote|section|article)\b", re.I)
LINE = re.compile(rb"\n")
SENTENCE = re.compile(rb"[.!?;:]['\")\]]*[ \t]+|\xe3\x80\x82|\xef\xbc[\x81\x9f]")
WORD = re.compile(rb"[ \t\r\x0b\x0c]+|\xe3\x80\x80")
#: Depths of headings, and of list items by the columns they are indented.
DEPTHS, INDENTS = 6, (1, 3, 7)
#: A character of UTF-8 has at most this many bytes after its first.
TAIL = 3
#: A piece below this part of the limit, unless it is the last, takes in a part of the next one.
LEAST = 8


def _whole(data: bytes, at: int) -> int:
    """The largest start of a character that is not after `at`."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Outline:
    """The boundaries of a text by level, strongest first; those below list items are looked for inside a node only."""

    def __init__(self, data: bytes):
        self.data = data
        parts = [m.start() for m in PART.finditer(data)]
        sections: list[list[int]] = [[] for _ in range(DEPTHS)]
        for m in HEADING.finditer(data):
            depth = len(m[1]) if m[1] else int(m[2]) if m[2] else 1 if m[3][:1] == b"=" else 2
            sections[depth - 1].append(m.start())
        items: list[list[int]] = [[] for _ in range(len(INDENTS) + 1)]
        for m in ITEM.finditer(data):
            items[bisect_left(INDENTS, len(m[1]))].append(m.start())
        self.known = [parts, *sections, None, *items]
        self.sought = {1 + DEPTHS: (PARAGRAPH, False)}
        first = len(self.known)
        self.sought |= {first + i: p for i, p in enumerate(((MARKUP, True), (LINE, False), (SENTENCE, False), (WORD, False)))}
        self.levels = first + 4

    def cuts(self, start: int, end: int, level: int) -> list[int]:
        """Boundaries of a level strictly inside a span."""
        if level in self.sought:
            pattern, before = self.sought[level]
            found = [m.start() if before else m.end() for m in pattern.finditer(self.data, start, end)]
            return [c for c in found if start < c < end]
        known = self.known[level]
        return known[bisect_right(known, start) : bisect_left(known, end)]


class Node:
    """A span of the tree with its children; a node that fits has none."""

    __slots__ = ("start", "end", "children")

    def __init__(self, outline: Outline, start: int, end: int, room: int, level: int = 0):
        self.start, self.end, self.children = start, end, []
        if end - start <= room:
            return
        cuts: list[int] = []
        while level < outline.levels and not cuts:
            cuts = outline.cuts(start, end, level)
            level += 1
        if not cuts:  # no boundary is left: characters
            at = start
            while end - at > room:
                cuts.append(at := max(_whole(outline.data, at + room), at + 1))
        edges = [start, *cuts, end]
        self.children = [Node(outline, a, b, room, level) for a, b in zip(edges, edges[1:])]


def merged(node: Node, room: int) -> list[tuple[int, int]]:
    """Spans of at most `room` bytes, from the bottom up: those of the children, siblings joined while they fit."""
    if not node.children:
        return [(node.start, node.end)]
    out: list[tuple[int, int]] = []
    for child in node.children:
        for a, b in merged(child, room):
            if out and b - out[-1][0] <= room:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def _boundary(outline: Outline, low: int, high: int) -> int:
    """The last boundary of the strongest level in low..high; where there is none, the last whole character."""
    for level in range(outline.levels):
        cuts = outline.cuts(low - 1, high + 1, level)
        if cuts:
            return cuts[-1]
    return max(_whole(outline.data, high), low)


def spans(data: bytes, room: int) -> list[tuple[int, int]]:
    """Consecutive spans of at most `room` bytes that cover a text, none but the last below room / LEAST if it can be helped."""
    if not data:
        return []
    outline = Outline(data)
    cut = merged(Node(outline, 0, len(data), room), room)
    least = room // LEAST
    i = 0
    while i < len(cut) - 1:
        start, end = cut[i][0], cut[i + 1][1]
        if cut[i][1] - start < least:
            at = _boundary(outline, max(start + least, end - room), min(start + room, max(end - least, start + least)))
            cut[i], cut[i + 1] = (start, at), (at, end)
        i += 1
    return [s for s in cut if s[1] > s[0]]


def pieces(data: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte spans of the pieces of a text; one that fits the limit stays whole.

    Each piece after the first begins `overlap` bytes before the end of the one before, or up to
    TAIL bytes earlier at the start of a character. A limit that leaves no room beyond the overlap
    gets the largest overlap that it leaves room for, and a piece is one character at least.
    """
    if len(data) <= limit:
        return [(0, len(data))]
    overlap = max(0, min(overlap, limit - TAIL - 4))
    room = max(limit - overlap - TAIL if overlap else limit, 4)
    cut = spans(data, room)
    while len(cut) > 1 and cut[0][1] < overlap:  # too short to share its end; with no part shared before it, it takes the next one in
        cut[:2] = [(0, cut[1][1])]
    return [(_whole(data, max(a - overlap, 0)) if a else 0, b) for a, b in cut]


def split(docs: DataFrame, limits: Iterable[tuple[str, int, int]]) -> DataFrame:
    """(profile, doc_id, piece, start, end): the pieces of every document above a profile's limit.

    limits has (profile, piece_limit, overlap_size). start and end are places in the bytes of the
    text, piece counts from 0. Documents that fit, null texts and null ids give no rows. Documents
    are taken whole whatever their length, and none is moved between tasks.
    """
    limits = [(str(p), int(n), int(o or 0)) for p, n, o in limits if p is not None and n is not None and n > 0]
    schema = "profile string, doc_id long, piece int, start long, end long"
    if not limits:
        return docs.sparkSession.createDataFrame([], schema)
    smallest = min(n for _, n, _ in limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                data = text.as_buffer().to_pybytes()
                for profile, limit, overlap in limits:
                    if len(data) > limit:
                        for i, (s, e) in enumerate(pieces(data, limit, overlap)):
                            for c, v in zip(cols, (profile, doc_id, i, s, e)):
                                c.append(v)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["profile", "doc_id", "piece", "start", "end"])

    large = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") > smallest))
    return large.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def with_text(cut: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the text of each piece."""
    data = F.encode("text", "UTF-8")
    body = F.decode(F.substring(F.col("data"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return cut.join(docs.select("doc_id", data.alias("data")), "doc_id").withColumn("text", body).drop("data")


def audit(cut: DataFrame, docs: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per profile with pieces that shows whether the splitting keeps its promises.

    documents, tokens: what the pieces cover, shared parts once. over_limit: pieces above the limit. gaps: pieces that
    do not begin inside or at the end of the one before, and texts not covered to their ends. wrong_overlap: shared
    parts shorter than overlap_size or longer by more than TAIL. small: pieces but the last below a tenth of the limit.
    """
    size = docs.filter("doc_id is not null").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    own = limits.select("profile", "piece_limit", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size"))
    w = Window.partitionBy("profile", "doc_id").orderBy("piece")
    x = cut.withColumn("before", F.lag("end").over(w)).withColumn("last", F.lead("piece").over(w).isNull()).join(F.broadcast(own), "profile")
    x = x.join(size, "doc_id").withColumn("shared", F.coalesce(F.col("before") - F.col("start"), F.lit(0)))
    gap = (F.col("before").isNull() & (F.col("start") != 0)) | (F.col("shared") < 0) | (F.col("last") & (F.col("end") != F.col("size")))
    off = F.col("before").isNotNull() & ((F.col("shared") < F.col("overlap_size")) | (F.col("shared") > F.col("overlap_size") + TAIL))
    n = lambda c: F.count(F.when(c, 1))
    length = F.col("end") - F.col("start")
    return x.groupBy("profile").agg(
        F.count_distinct("doc_id").alias("documents"), F.sum(length - F.col("shared")).cast("long").alias("tokens"), n(length > F.col("piece_limit")).alias("over_limit"),
        n(gap).alias("gaps"), n(off).alias("wrong_overlap"), n(~F.col("last") & (length * 10 < F.col("piece_limit"))).alias("small"),
    )
