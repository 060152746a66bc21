"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of n words may differ from a document's passage by an edit budget of k words. Cut into k + 1 pieces,
one piece at least must occur unchanged; an Aho-Corasick automaton of all pieces finds these places, and Myers'
bit-parallel edit distance over words verifies them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of benchmark text in one automaton; a larger benchmark is taken in so many blocks.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")


#: For texts that are ASCII only, which need no pattern: what is no letter, digit or underscore parts words.
_PARTS = bytes(c if chr(c).isalnum() or c == ord("_") else 32 for c in range(128)) + bytes(128)


def words_of(text: str | None) -> list[str]:
    """``\\w+`` of the text in lower case."""
    text = (text or "").lower()
    return text.encode().translate(_PARTS).decode().split() if text.isascii() else _WORD.findall(text)


def best_match(item: list[str], masks: dict[str, int], text: list[str], anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of ``item`` to any passage of ``text``, and the end of the last such passage.

    ``masks`` has the positions of each word of the item as bits. ``anchored`` passages begin where the text does."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, first = full, 0, n, (n, 0), int(anchored)
    for j, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(xh | plus) & full), plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | first) & full, (down << 1) & full
        plus, minus = down | (~(xv | up) & full), up & xv
        if score <= best[0]:
            best = (score, j)
    return best


def bits_of(item: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


class Matcher:
    """The pieces of a block of items as one automaton."""

    def __init__(self, items: Iterable[tuple[object, str]], errors: float, least_words: int):
        self.items, self.pieces = [], {}
        for item_id, text in items:
            words = words_of(text)
            if len(words) < least_words:
                continue
            k, n = int(errors * len(words)), len(words)
            self.items.append((item_id, words, bits_of(words), bits_of(words[::-1]), k))
            cuts = [i * n // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(" " + " ".join(words[a:b]) + " ", []).append((len(self.items) - 1, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if self.pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[object, int, int, int, int]]:
        """``item_id, start, end, distance, words`` of the best passage for each item within its budget, in words of the text."""
        if not self.pieces or not text:
            return []
        words = words_of(text)
        joined = " " + " ".join(words) + " "
        hits = list(self.automaton.iter(joined))
        if not hits:
            return []
        starts = np.cumsum([1, *(len(w) + 1 for w in words)])
        places: dict[int, set[int]] = {}
        for end, (length, owners) in hits:
            at = int(np.searchsorted(starts, end - length + 2))
            for item, offset in owners:
                places.setdefault(item, set()).add(at - offset)
        out = []
        for item, begins in places.items():
            item_id, own, masks, backward, k = self.items[item]
            # a piece near the text's start may call for a passage that begins up to the item's length before it
            best, done = (k + 1, 0, 0), -len(own) - 1
            for begin in sorted(begins):
                if begin <= done:
                    continue
                # places close by share one window
                done = begin + k
                low, high = max(0, begin - k), min(len(words), done + len(own) + k)
                distance, end = best_match(own, masks, words[low:high])
                if distance < best[0] or distance == best[0] <= k and low + end > best[2]:
                    _, back = best_match(own[::-1], backward, words[low : low + end][::-1][: len(own) + k], anchored=True)
                    best = (distance, low + end - back, low + end)
            if best[0] <= k:
                out.append((item_id, best[1], best[2], best[0], len(own)))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, errors: float = 0.2, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start_word, end_word, distance, item_words``: the best passage for each document and item.

    Words are ``\\w+`` in lower case; a passage may differ from the item by ``errors`` of the item's words, rounded
    down. Items with fewer than ``least_words`` words, and null or empty texts on either side, match nothing. Of
    equally good passages that with the last end counts, and of those the longest. Repeated documents and items each get rows. Clean documents have none;
    empty tables give no rows. Texts are read whole, however long. Ids of either side may be null and of any type.
    Other columns are ignored. The benchmark is the query set: it goes to the executors in blocks of BLOCK_CHARS at
    most (or of one item, if that is longer).
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    item_type = benchmark.select("item_id").schema[0].dataType.simpleString()
    for own in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            items = own.value
            matcher = Matcher(enumerate(items.column(1).to_pylist()), errors, least_words)
            for batch in batches:
                out = [(i, *m) for i, t in enumerate(batch.column(1)) for m in matcher.matches(t.as_py())]
                at, item, *columns = zip(*out, strict=True) if out else [()] * 6
                ids = pa.array(items.column(0).take(pa.array(item, pa.int64())).to_pylist(), items.schema[0].type)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ids, *(pa.array(c, pa.int32()) for c in columns)], names=["doc_id", "item_id", "start_word", "end_word", "distance", "item_words"])

        part = slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, item_id {item_type}, start_word int, end_word int, distance int, item_words int")
        found = part if found is None else found.union(part)
    return found


def _blocks(benchmark: DataFrame) -> Iterator[Broadcast[pa.Table]]:
    """``item_id, text`` of the items in broadcast blocks; one block at least."""
    items = benchmark.select("item_id", F.col("text").alias("text")).where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for block in range(blocks):
        yield benchmark.sparkSession.sparkContext.broadcast(items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow())


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, errors: float = 0.2, least_words: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any passage that ``contaminated`` would report, with all their columns.

    Each row is judged by its own text, so ids may be null or repeated; null and empty texts stay."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    for own in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(enumerate(own.value.column(1).to_pylist()), errors, least_words)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t.as_py()) for t in batch.column(1)], pa.bool_()))

        row = row.mapInArrow(run, row.schema)
    return row.select("row.*")
