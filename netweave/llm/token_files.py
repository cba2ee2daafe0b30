"""Token ids in files: one zstandard dictionary, one frame a document.

Texts are encoded and their ids written to shards in ascending order of the
document's id. A dictionary trained on serialized id arrays is shared by all
shards of a folder; each document is a frame of its own, so that a short one is
read without its neighbours. A shard is

    header   magic, version, bytes an id (2 or 4), SHA-256 of the dictionary
    frames   one zstandard frame a document: its ids, little-endian unsigned
    index    for each document: id, whether it is null, where its frame ends, its number of ids
    footer   where the index starts, how many documents, magic

Beside the shards lie ``dictionary`` and ``manifest``, a Parquet table of the
shards (path, documents, ids, ids before it, least and greatest id). A task that
is run again writes a shard of another name; the manifest names the one that
counts, so lost executors leave nothing but an unread file.

White space never takes part in a token of the vocabularies meant here (words
with ends, lower case) and parts what comes before it from what comes after, so a
worker encodes each distinct word once, and the ids of a text are those of its
words, in order (``by_words``). Vocabularies without these properties take
``by_words=False``.

Defined results: null texts are empty and hold the end id alone; rows that
repeat are kept, each; rows with one id follow each other by their ids' hash;
null ids come first; an empty table has no shards. Texts are encoded to their
end, whatever their length. The dictionary is trained on at most
``TRAIN_DOCUMENTS`` documents, the first by hash, and at most ``TRAIN_BYTES`` of
each, from a place by hash; it changes the size of files, never what is read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.shared_files import opened
from netweave.session import cut, stored

MAGIC, VERSION = b"NWTOKENS", 1
HEADER, FOOTER = "<8sII32s", "<QQ8s"
BEGIN, CLOSE = struct.calcsize(HEADER), struct.calcsize(FOOTER)
INDEX = np.dtype([("id", "<i8"), ("null", "?"), ("end", "<u8"), ("n_tokens", "<u8")])
TRAIN_DOCUMENTS, TRAIN_BYTES, DICTIONARY_BYTES = 2048, 4096, 65536
#: Ids in a shard, about; words that a worker remembers; bytes read at a time.
SHARD_IDS, REMEMBERED, READ = 16_000_000, 600_000, 4 << 20
#: Bytes of text encoded at once; compression level.
PART, LEVEL = 4 << 20, 3
#: Words that are looked up by their stem, and how they end.
_LETTERS, _MARKS = "À-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN, STEM_TAIL = f"^[!-~{_LETTERS}]+$", f"^(?P<stem>.*[a-z0-9à-öø-ÿ])(?P<tail>[{_MARKS}]+)$"


class WordEncoder:
    """Ids of texts by those of their words.

    A word of letters, digits and marks of ASCII and Latin-1 is looked up in lower
    case, without the marks at its end, which are words of their own: the
    vocabulary folds case, and parts letters and digits from marks that are no
    apostrophes."""

    def __init__(self, tokenizer: str, by_words: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.tokenizer, self.by_words = Tokenizer.from_str(tokenizer), by_words
        self._forget()

    def _forget(self) -> None:
        """Nothing is known: where the ids of a known word start in the pool, and
        how many they are."""
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _places(self, words: list[str]) -> np.ndarray:
        """The words' numbers among those known; new ones are encoded, once each."""
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if (at < 0).any():
            new = list(dict.fromkeys(words[i] for i in np.flatnonzero(at < 0)))
            if len(self.known) + len(new) > REMEMBERED and self.known:
                self._forget()
                return self._places(words)
            found = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(sizes) - sizes))
            self.sizes, self.pool = np.concatenate((self.sizes, sizes)), np.concatenate((self.pool, np.array(found.ids, np.uint32)))
            at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        return at

    def _pieces(self, words: pa.Array) -> np.ndarray:
        """For each word the numbers of its stem and of the marks at its end."""
        if not self.by_words:
            return self._places(words.to_pylist())[:, None]
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        lower = pc.if_else(plain, pc.utf8_lower(words), words)
        parts = pc.if_else(plain, pc.extract_regex(lower, STEM_TAIL), None)
        stems, tails = pc.coalesce(pc.struct_field(parts, "stem"), lower), pc.fill_null(pc.struct_field(parts, "tail"), "")
        pieces = np.empty((len(words), 2), np.int64)
        coded = [x.dictionary_encode() for x in (stems, tails)]
        distinct = [x.dictionary.to_pylist() for x in coded]
        places = self._places([w for words in distinct for w in words])
        pieces[:, 0] = places[coded[0].indices.to_numpy()]
        pieces[:, 1] = places[len(distinct[0]) + coded[1].indices.to_numpy()]
        return pieces

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and how many ids
        each text has, the end included."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        words = pc.ascii_split_whitespace(texts) if self.by_words else pa.LargeListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int64()), texts)
        coded = words.flatten().dictionary_encode()
        pieces = self._pieces(coded.dictionary)
        chosen = pieces[coded.indices.to_numpy()].ravel() if len(pieces) else np.zeros(0, np.int64)
        lengths = self.sizes[chosen]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.starts[chosen] - (ends - lengths), lengths) + np.arange(len(ends) and ends[-1])]
        last = np.cumsum(words.value_lengths().to_numpy()) * pieces.shape[1]
        counts = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], last))])
        closing = np.cumsum(counts + 1) - 1
        out = np.full(len(flat) + len(counts), end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[closing] = False
        out[inside] = flat
        return out, counts + 1


@lru_cache(maxsize=2)
def encoder(tokenizer: str, by_words: bool) -> WordEncoder:
    return WordEncoder(tokenizer, by_words)


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end: int, width: int, by_words: bool) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, serialized."""
    sent = df.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary file, a few megabytes
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(sent.value, by_words)
        for batch in batches:
            for part in _by_size(batch):
                ids, counts = encoded(part.column(1), end)
                raw = ids.astype(kind)
                ends = np.concatenate(([0], np.cumsum(counts))) * width
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column(0), column.cast(pa.binary())], names=["doc_id", "ids"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def _by_size(batch: pa.RecordBatch, most: int = PART) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text, of one row at least."""
    parts = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()) // most
    for part in np.unique(parts):
        at = np.flatnonzero(parts == part)
        yield batch.slice(at[0], len(at))


def dictionary(encoded: DataFrame) -> bytes:
    """A zstandard dictionary for documents like these; raw content where there
    are too few of them to train one."""
    import zstandard

    place = F.pmod(F.xxhash64("ids", F.lit(1)), F.greatest(F.length("ids") - TRAIN_BYTES, F.lit(0)) + 1)
    part = F.expr(f"substring(ids, 4 * cast(place / 4 AS int) + 1, {TRAIN_BYTES})")
    share = min(1.0, 2 * TRAIN_DOCUMENTS / max(encoded.count(), 1))  # about twice as many by hash, then the first of these
    drawn = encoded.withColumn("k", F.pmod(F.xxhash64("nr"), F.lit(1 << 30))).filter(F.col("k") < share * (1 << 30))
    keyed = drawn.select("k", place.cast("int").alias("place"), "ids").select("k", part.alias("part"))
    samples = [bytes(row["part"]) for row in keyed.orderBy("k", "part").limit(TRAIN_DOCUMENTS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary_of(content: bytes) -> object:
    import zstandard

    return zstandard.ZstdCompressionDict(content)


def write(df: DataFrame, id_col: str, text_col: str, folder: str, tokenizer_path: str, end: int, by_words: bool = True, shard_ids: int = SHARD_IDS) -> None:
    """Encode the rows' texts and write them to a new folder."""
    from pathlib import Path

    from tokenizers import Tokenizer

    spark = df.sparkSession
    tokenizer = Path(tokenizer_path).read_text()
    width = 2 if max(Tokenizer.from_str(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    encoded = encode(df, id_col, text_col, tokenizer, end, width, by_words).withColumn("nr", F.monotonically_increasing_id())
    encoded = stored(encoded, "ids")
    content = dictionary(encoded)
    files, inside = opened(folder)
    files.create_dir(inside, recursive=True)
    with files.open_output_stream(f"{inside}/dictionary", compression=None) as out:
        out.write(content)
    total = encoded.agg(F.sum(F.length("ids"))).first()[0] or 0
    shards = max(1, -(-total // (width * shard_ids)))
    order = ["doc_id", F.xxhash64("ids").alias("k"), "nr"]
    ranged = encoded.repartitionByRange(int(max(shards, spark.sparkContext.defaultParallelism)), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    sent = spark.sparkContext.broadcast(content)  # DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary_of(sent.value), write_content_size=True)
        files, inside = opened(folder)
        index: list[np.ndarray] = []
        at = BEGIN
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = files.open_output_stream(f"{inside}/{name}", compression=None)
                out.write(struct.pack(HEADER, MAGIC, VERSION, width, hashlib.sha256(sent.value).digest()))
            rows = np.empty(batch.num_rows, INDEX)
            rows["id"], rows["null"] = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, value in enumerate(batch.column(1)):
                raw = value.as_buffer()
                frame = made.compress(raw)
                out.write(frame)
                at += len(frame)
                rows[i]["end"], rows[i]["n_tokens"] = at, raw.size // width
            index.append(rows)
        if out is not None:
            rows = np.concatenate(index)
            out.write(rows.tobytes())
            out.write(struct.pack(FOOTER, at, len(rows), MAGIC))
            out.close()
            held = rows["id"][~rows["null"]]
            ids = [int(held[0]), int(held[-1])] if len(held) else [None, None]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": len(rows), "n_ids": int(rows["n_tokens"].sum()), "first_id": ids[0], "last_id": ids[1], "nulls": bool(rows["null"].any())}], schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("nulls", pa.bool_())]))

    written = cut(ranged.mapInArrow(run, "shard long, name string, n_docs long, n_ids long, first_id long, last_id long, nulls boolean"))
    before, rows = 0, []
    for row in written.orderBy("shard").collect():  # a row for each shard
        rows.append((*row, before))
        before += row["n_ids"]
    manifest = spark.createDataFrame(rows, "shard long, name string, n_docs long, n_ids long, first_id long, last_id long, nulls boolean, before long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")


class Shard:
    """One shard, open for reading: its index, and documents one by one."""

    def __init__(self, folder: str, name: str, content: bytes):
        import zstandard

        files, inside = opened(folder)
        self.file = files.open_input_file(f"{inside}/{name}")
        magic, version, self.width, digest = struct.unpack(HEADER, self.file.read_at(BEGIN, 0))
        end = self.file.size()
        at, count, closing = struct.unpack(FOOTER, self.file.read_at(CLOSE, end - CLOSE))
        if (magic, version, closing) != (MAGIC, VERSION, MAGIC):
            raise ValueError(f"{name} is no shard of token ids, or is cut off")
        if digest != hashlib.sha256(content).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, at), INDEX)
        self.starts = np.concatenate(([BEGIN], self.index["end"][:-1])).astype(np.int64)
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary_of(content))

    def _ids(self, frame: bytes, i: int) -> np.ndarray:
        ids = np.frombuffer(self.reader.decompress(frame), f"<u{self.width}")
        if len(ids) != self.index["n_tokens"][i]:
            raise ValueError("a frame does not hold as many ids as its index says")
        return ids

    def document(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document of that id, by one short read."""
        held = int(np.count_nonzero(self.index["null"]))  # null ids come first
        i = held + int(np.searchsorted(self.index["id"][held:], doc_id))
        if i >= len(self.index) or self.index["id"][i] != doc_id:
            return None
        return self._ids(self.file.read_at(int(self.index["end"][i]) - int(self.starts[i]), int(self.starts[i])), i)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, read in large pieces."""
        first = 0
        while first < len(self.index):
            last = max(first + 1, int(np.searchsorted(self.index["end"], self.starts[first] + READ, "right")))
            base = int(self.starts[first])
            piece = memoryview(self.file.read_at(int(self.index["end"][last - 1]) - base, base))
            for i in range(first, last):
                yield i, self._ids(piece[int(self.starts[i]) - base : int(self.index["end"][i]) - base], i)
            first = last


def _content(folder: str) -> bytes:
    files, inside = opened(folder)
    with files.open_input_stream(f"{inside}/dictionary", compression=None) as found:
        return found.read()


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document as its frame has
    it, and its ids if asked; start counts the ids before it in the folder. A task
    reads whole shards, a document at a time."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    sent = spark.sparkContext.broadcast(_content(folder))
    shards = manifest.select("name", "before").repartition(max(1, spark.sparkContext.defaultParallelism, manifest.count() // 4), "name")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * ids]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start in (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            shard, found, size = Shard(folder, name, sent.value), [], 0
            for i, values in shard.documents():
                at = shard.index[i]
                row = (None if at["null"] else int(at["id"]), start, len(values), zlib.crc32(values.astype("<u4")))
                found.append((*row, values) if ids else row)
                start, size = start + len(values), size + (len(values) if ids else 1)
                if size >= 65536:
                    yield batch(found)
                    found, size = [], 0
            if found:
                yield batch(found)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of single documents: the manifest says which shards may hold them."""
    content, out = _content(folder), {}
    manifest = spark.read.parquet(f"{folder}/manifest")
    for doc_id in doc_ids:
        for row in manifest.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard").collect():
            found = Shard(folder, row["name"], content).document(doc_id)
            if found is not None:
                out.setdefault(doc_id, found)
    return out
