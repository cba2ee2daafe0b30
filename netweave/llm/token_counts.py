"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, so its count is that of the tokenizer
on the whole text. The tokens' character spans are then joined to the spans of
its sections (lines) or fields, and each token goes to exactly one of them:

* ``first``: the section that holds the token's first character; a token that
  starts in a separator goes to the section before it;
* ``most``: the section that holds most of the token's bytes, the earlier one
  if equal; without any such byte, as with ``first``.

Either way the sections' counts add up to the document's.

Defined results: null and empty texts have no tokens and no sections; an empty
line is a section and may hold the separators after it; repeated rows are
counted each; a text without a line break is one section. Texts are encoded to
their end, whatever their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that byte-level BPE vocabularies of this family split text by.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Encoder:
    """Token ids and byte lengths of whole texts."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        pairs = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})
        self._lengths = np.zeros(max(pairs.values()) + 1, np.int64)
        for token, rank in pairs.items():
            self._lengths[rank] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """Where the tokens end, in bytes; the first starts at 0."""
        return np.cumsum(self._lengths[np.asarray(self._encoding.encode_ordinary(text), np.int64)])


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines in the bytes of a text."""
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))
    if len(starts) > 1 and starts[-1] == len(raw):
        starts, ends = starts[:-1], ends[:-1]
    return starts, ends


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens reach over a boundary."""
    token_starts = np.concatenate(([0], token_ends[:-1]))
    first = np.maximum(np.searchsorted(starts, token_starts, "right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, token_ends, "left") - 1, 0)
    crossing = last > first
    owner = first
    if rule == "most":
        owner = first.copy()
        for i in np.flatnonzero(crossing):
            held = [min(token_ends[i], ends[s]) - max(token_starts[i], starts[s]) for s in range(first[i], last[i] + 1)]
            if max(held) > 0:
                owner[i] = first[i] + int(np.argmax(held))
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(owner, minlength=len(starts)), int(crossing.sum())


def _count(df: DataFrame, id_col: str, columns: Sequence[str], separator: str | None, ranks_path: str, pattern: str, rule: str) -> DataFrame:
    """separator: None takes lines of the one column as sections, else the
    columns are the sections of a document that joins them."""
    ranks = df.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # a vocabulary file: about a megabyte
    fields = df.select(id_col, *columns)
    id_type = fields.schema[0].dataType.simpleString()
    between = (separator or "").encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, pattern)
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i) for i in range(1, batch.num_columns)), strict=True):
                parts = [value.as_py() for value in row]
                text = (separator or "").join(p or "" for p in parts)
                raw = np.frombuffer(text.encode(), np.uint8)
                if not len(raw):
                    out.append((0, 0, 0, 0, []))
                    continue
                if separator is None:
                    starts, ends = line_spans(raw)
                else:
                    sizes = np.array([len((p or "").encode()) for p in parts])
                    ends = np.cumsum(sizes + len(between)) - len(between)
                    starts = ends - sizes
                tokens = encode.spans(text)
                counts, crossing = attribute(tokens, starts, ends, rule)
                out.append((len(text), len(tokens), len(starts), crossing, counts))
            columns_out = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns_out, types, strict=True))], names=[id_col, "n_chars", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return fields.mapInArrow(run, f"`{id_col}` {id_type}, n_chars long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def count_sections(df: DataFrame, id_col: str, text_col: str, ranks_path: str = DEFAULT_RANKS, pattern: str = PATTERN, rule: str = "first") -> DataFrame:
    """Per row its characters, tokens, lines, tokens that reach over a line's
    end, and the tokens of each line in order."""
    return _count(df, id_col, [text_col], None, ranks_path, pattern, rule)


def count_fields(df: DataFrame, id_col: str, columns: Sequence[str], separator: str = "\n", ranks_path: str = DEFAULT_RANKS, pattern: str = PATTERN, rule: str = "first") -> DataFrame:
    """As count_sections, of a document that joins columns by a separator; a
    null field is an empty one. ``section_tokens`` has the fields in order."""
    return _count(df.select(id_col, *[F.col(c).cast("string").alias(c) for c in columns]), id_col, columns, separator, ranks_path, pattern, rule)
