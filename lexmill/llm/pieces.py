"""Splitting oversized items at natural boundaries (problem 2).

``cut_item`` cuts one text by a hierarchy of boundaries: section, paragraph,
line, sentence, word, character. A text is first cut at the strongest
boundaries; only a part that is still longer than the limit is cut at the next
weaker ones, down to single characters. The parts are then packed greedily:
a piece takes parts while it stays within the limit, and the piece after it
begins with the last characters of the piece before (the overlap). With
``full`` every overlap is as long as wanted (or all of the text before it, if
that is shorter): parts are cut to what fits behind an overlap. Without, it is
shortened where the next part would not fit behind it. The pieces of
``split_oversized`` have full overlaps. A cut counts as forced only in a stretch
longer than the limit itself.

Joined without their overlaps the pieces are the text again, character by
character. Defined results: null, empty and blank items within the limit give
one piece or, if null or empty, none; lengths are Unicode code points; texts of
any length are treated whole, in time linear in their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak; each pattern matches the end of a part.
SECTION = re.compile(r"(?:\r\n|[\n\r])+(?=#{1,6}[ \t]|<h[1-6]\b|第[ \t]*[0-9一二三四五六七八九十百]+[ \t]*[章節部]|Chapter[ \t]+[0-9])")
PARAGRAPH = re.compile(r"(?:\r\n|[\n\r])[ \t　]*(?:\r\n|[\n\r])+")
LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
SENTENCE = re.compile(r"[。！？；!?;]|\.(?=\s)")
WORD = re.compile(r"\s+|[，、：,:）)\]】」』/|→>]")
NATURAL = (SECTION, PARAGRAPH, LINE, SENTENCE)
#: Between these levels a cut is natural; below them it is forced.
LEVELS = (*NATURAL, WORD)


def _character_cuts(text: str, start: int, end: int, longest: int) -> list[int]:
    """Cuts every ``longest`` characters, or before the letter whose combining marks would be cut off."""
    cuts: list[int] = []
    at = start + longest
    while at < end:
        cut = at
        while cut > start + 1 and unicodedata.combining(text[cut]):
            cut -= 1
        start = cut if not unicodedata.combining(text[cut]) else at
        cuts.append(start)
        at = start + longest
    return cuts


def parts_of(text: str, limit: int, longest: int) -> list[tuple[int, int, bool]]:
    """start, end and whether a forced cut ends it, of parts no longer than ``longest``; cuts in stretches within ``limit`` aren't forced."""
    done: list[tuple[int, int, bool]] = []
    todo = [(0, len(text), 0, False, False)]
    while todo:
        start, end, level, forced, inner = todo.pop()
        if end - start <= longest:
            done.append((start, end, forced))
            continue
        if level == len(NATURAL):
            inner = end - start > limit
        if level == len(LEVELS):
            cuts = _character_cuts(text, start, end, longest)
        else:
            cuts = [m.end() for m in LEVELS[level].finditer(text, start, end) if start < m.end() < end]
        edges = [start, *cuts, end]
        if len(edges) == 2:
            todo.append((start, end, level + 1, forced, inner))
            continue
        todo += reversed([(a, b, level + 1, inner if b < end else forced, inner) for a, b in zip(edges, edges[1:])])
    return done


def cut_item(text: str, limit: int, overlap: int, full: bool = False) -> list[tuple[int, int, int, bool]]:
    """start with overlap, own start, end, and whether a forced cut ends the piece."""
    if full and not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    parts = parts_of(text, limit, limit - overlap if full else limit) if text else []
    pieces: list[tuple[int, int, int, bool]] = []
    i = 0
    while i < len(parts):
        own = parts[i][0]
        room = limit - (parts[i][1] - own)
        shared = min(overlap, room, own)
        end, forced = parts[i][1], parts[i][2]
        i += 1
        while i < len(parts) and parts[i][1] - own + shared <= limit:
            end, forced = parts[i][1], parts[i][2]
            i += 1
        pieces.append((own - shared, own, end, forced))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """item_id, piece_no, start, shared, piece, stretch_cut of every item longer than ``limit``.

    ``start`` is the piece's place in the item (code points), ``shared`` the
    overlap it has with the piece before, ``stretch_cut`` says that a stretch
    without natural boundary had to be cut in it or at its end. Rows equal in
    key and text count once, other columns are put aside before.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = False
                for n, (a, own, b, forced) in enumerate(cut_item(t, limit, overlap, full=True)):
                    for column, value in zip(rows, (item, n, a, own - a, t[a:b], forced or before)):
                        column.append(value)
                    before = forced
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
            names = ["item_id", "piece_no", "start", "shared", "piece", "stretch_cut"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    long = df.select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("text")).where(F.char_length("text") > limit)
    schema = "item_id string, piece_no int, start bigint, shared int, piece string, stretch_cut boolean"
    return long.distinct().mapInArrow(cut, schema)


def cuts_found(pieces: DataFrame) -> DataFrame:
    """item_id, cut: ``forced`` if a stretch of the item had to be cut, else ``natural``."""
    return pieces.groupBy("item_id").agg(F.when(F.max("stretch_cut"), "forced").otherwise("natural").alias("cut"))


def procedure_text(df: DataFrame) -> DataFrame:
    """``df`` with item_text: heading and text joined by a line break, or the one that is there."""
    head, body = F.nullif("heading", F.lit("")), F.nullif("text", F.lit(""))
    return df.withColumn("item_text", F.concat_ws("\n", head, body))
