"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``rate`` times its length of
character edits. It is cut into one piece more than that budget, so at least
one piece occurs unchanged; all pieces of all items are looked for at once
(Aho-Corasick). A hit is verified by Myers' bit-parallel distance on ever
larger parts of the item: pieces are the leaves of a tree in which a part with
p pieces may have p - 1 edits. If an item occurs within its budget, then along
some path from a piece to the whole item every part occurs within its own, so
climbing loses nothing and chance hits end at the first step.

Both sides are compared in lower case with every run of other than letters and
digits as one space.

Defined results: null and empty items, and those without a letter or digit,
match nothing; items too short for an edit must occur exactly, as whole words;
null and empty documents match nothing; repeated rows are reported each;
documents are searched to their end. Items are sent to the workers in blocks of
at most BLOCK_CHARS characters, one pass over the documents a block, so what is
broadcast is bounded however many items there are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RATE = 0.1
BLOCK_CHARS = 2_000_000
_OTHER, _WORD = re.compile(r"[\W_]+"), re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(peq: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Myers: the smallest distance of the pattern to a part of text, and where
    the first such part ends. Python's integers hold patterns of any length."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, where = size, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        diagonal = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(across | up)) & full, up & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1, less << 1
        up, down = (less | ~(diagonal | more)) & full, more & diagonal
        if score < best:
            best, where = score, at
    return best, where


class Item:
    """A test item with the tree of its parts: (from, to, budget, parent)."""

    def __init__(self, key, text: str, rate: float):
        self.key, self.text = key, text
        self.budget = int(len(text) * rate)
        pieces = self.budget + 1
        cuts = [len(text) * i // pieces for i in range(pieces + 1)]
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves: list[int] = []
        todo = [(0, pieces, -1)]
        while todo:
            a, b, parent = todo.pop()
            self.nodes.append((cuts[a], cuts[b], b - a - 1, parent))
            if b - a == 1:
                self.leaves.append(len(self.nodes) - 1)
            else:
                half = (a + b + 1) // 2
                todo += [(a, half, len(self.nodes) - 1), (half, b, len(self.nodes) - 1)]
        self._masks: dict[int, dict[str, int]] = {}

    def part(self, node: int) -> tuple[dict[str, int], int]:
        a, b = self.nodes[node][:2]
        if node not in self._masks:
            self._masks[node] = masks(self.text[a:b])
        return self._masks[node], b - a

    def climb(self, leaf: int, text: str, at: int) -> tuple[int, int, int] | None:
        """(distance, from, to) of the item around a piece that occurs at at."""
        offset, node = self.nodes[leaf][0], self.nodes[leaf][3]
        while node >= 0:
            a, b, budget, parent = self.nodes[node]
            low = max(0, at - (offset - a) - budget)
            window = text[low : at + (b - offset) + budget]
            peq, size = self.part(node)
            distance, end = best_end(peq, size, window)
            if distance > budget:
                return None
            if parent < 0:
                back, length = best_end(masks(self.text[::-1]), size, window[:end][::-1][: size + budget])
                return distance, low + end - length, low + end
            node = parent
        end = at + len(self.text)
        whole = (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " ")
        return (0, at, end) if whole else None


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for key, text in items:
            item = Item(key, text, rate)
            for leaf in item.leaves:
                a, b = item.nodes[leaf][:2]
                piece = text[a:b]
                if piece not in self.automaton:
                    self.automaton.add_word(piece, (len(piece), []))
                self.automaton.get(piece)[1].append((item, leaf))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str, first: bool = False) -> dict:
        """Per item its best occurrence (distance, from, to), the first of
        equals; with first, any one occurrence of any item."""
        found: dict[int, tuple[Item, tuple[int, int, int]]] = {}
        if not text or not len(self.automaton):
            return {}
        for end, (size, owners) in self.automaton.iter(text):
            for item, leaf in owners:
                known = found.get(id(item))
                if known and (known[1][0] == 0 or known[1][1] <= end < known[1][2]):
                    continue
                hit = item.climb(leaf, text, end + 1 - size)
                if hit and (not known or hit < known[1]):
                    found[id(item)] = (item, hit)
                    if first:
                        return {item.key: hit}
        return {item.key: hit for item, hit in found.values()}


def _spans(text: str, hits: dict) -> list[tuple]:
    """Occurrences by their place in the (lower-cased) original."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    at, starts = 0, []
    for a, b in spans:
        starts.append(at)
        at += b - a + 1
    out = []
    for key, (distance, a, b) in hits.items():
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
        out.append((key, distance, min(spans[i][0] + a - starts[i], spans[i][1]), min(spans[j][0] + b - starts[j], spans[j][1])))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Normalised items in blocks, fetched partition by partition."""
    held, size = [], 0
    for key, text in items.select(id_col, text_col).toLocalIterator():
        if text := normal(text):
            held.append((key, text))
            size += len(text)
            if size >= block_chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def contaminated(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end): a row for each document and
    item that occurs in it, with its best occurrence."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    key, batch_key = items.schema[item_id].dataType.simpleString(), to_arrow_type(items.schema[item_id].dataType)
    schema = f"doc_id {docs.schema[0].dataType.simpleString()}, item_id {key}, distance int, start int, end int"
    out = None
    for block in item_blocks(items, item_id, item_text):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                rows = []
                for i, value in enumerate(batch.column(1)):
                    text = value.as_py()
                    if hits := matcher.find(normal(text)):
                        rows += [(i, *hit) for hit in _spans(text, hits)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                keys = pa.array(columns[1], batch_key)
                yield pa.RecordBatch.from_arrays([ids, keys, *(pa.array(c, pa.int32()) for c in columns[2:])], names=["doc_id", "item_id", "distance", "start", "end"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def drop_contaminated(df: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str, rate: float = RATE) -> DataFrame:
    """The rows of df in which no item occurs, in place: nothing is shuffled."""
    at = df.columns.index(text_col)
    for block in item_blocks(items, item_id, item_text):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py()), first=True) for t in batch.column(at)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
