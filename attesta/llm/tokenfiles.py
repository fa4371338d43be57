"""Token ids in Arrow stream files of fixed-size-list batches.

Documents, ascending by id, form one stream of ids: each document's, then the end id. A task takes a range of about
``SHARD`` documents and writes it to files one after another: a file ends with the document that brings it to
``FILE_IDS`` ids, so it has less than that many and one document's more, however long documents are. A file is an Arrow
IPC stream without compression whose batches hold ``ROWS`` sequences of ``LENGTH`` ids (16 bits where the vocabulary
allows) and their masks; the last sequence is filled up with masked zeros. All full batches take the same number of
bytes, so that ``TokenFile`` maps the file and cuts sequence i out at a computed place, without copying. A second stream
beside it, the index, holds (doc_id, start in the file, n_tokens).

Encoding runs the tokenizers library over the distinct space-separated chunks of texts of about ``SLICE`` characters
together and keeps their ids in a cache that is bounded in chunks and in characters. Chunks are joined by a special token of the tokenizer, at which the library splits before anything else,
so one call encodes many and its id tells them apart; words of ASCII letters are joined by spaces, as the tokens that end
a word tell them apart. That gives the ids of the whole text only for a tokenizer that drops white space and merges within
words; for others, pass ``chunked=False``.

Edge cases: null texts are empty and keep their end id; texts of any length are encoded whole; null ids come first;
rows that repeat an id are documents of their own in the order of the input, and may be spread over files; an empty
table makes no files; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .common import scratch, short_batches, table, written

LENGTH = 2048  #: ids in a sequence
ROWS = 64  #: sequences in a batch
SHARD, SHARE = 32_768, 1024  #: documents that a task takes; small corpora still share cores by the second
FILE_IDS = 1 << 26  #: ids that end a file: 128 MB where ids have 16 bits
SLICE = 2_000_000  #: characters of texts that are split into chunks together
CACHE, CACHE_CHARS = 800_000, 16_000_000  #: chunks whose ids a worker keeps, and their characters


class Encoder:
    """Ids of texts as bytes of ``dtype``."""

    def __init__(self, path: str, chunked: bool = True):
        """``chunked``: see above; needs a special token."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunked = chunked
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.marks = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special), reverse=True)
        self.cache: dict[str, bytes] = {}
        self.cached = 0  # characters

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that hold no special token."""
        mark = self.marks[0]
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        raw, width = ids.tobytes(), self.dtype.itemsize
        ends = [*np.flatnonzero(ids == self.tokenizer.token_to_id(mark)).tolist(), len(ids)]
        if len(ends) != len(chunks):
            raise ValueError("a chunk holds a special token")
        return [raw[a * width : b * width] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]

    def _encode_spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words of ASCII letters, each of which has one token that ends a word: its last."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._encode_joined(words)  # a tokenizer of another kind
        raw, width = ids.tobytes(), self.dtype.itemsize
        return [raw[a * width : b * width] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            out += self._encode_chunks(texts[at:end]) if self.chunked else self._encode(texts[at:end])
            at = end
        return out

    def _encode_chunks(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.cache) > CACHE or self.cached > CACHE_CHARS:
            self.cache.clear()
            self.cached = 0
        missing = list(set().union(*split).difference(self.cache))
        every = "\n".join(missing)  # no chunk holds a line end
        self.cached += len(every)
        marked = [c for c in missing if any(m in c for m in self.marks)] if any(m in every for m in self.marks) else []
        self.cache.update(zip(marked, self._encode(marked), strict=True))
        missing = list(set(missing).difference(marked)) if marked else missing
        words: list[str] = []
        others: list[str] = []
        for c in missing:
            (words if c.isalpha() and c.isascii() else others).append(c)
        for chunks, encode in ((words, self._encode_spaced), (others, self._encode_joined)):
            for at in range(0, len(chunks), 2048):
                part = chunks[at : at + 2048]
                self.cache.update(zip(part, encode(part), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, chunked: bool = True) -> Encoder:
    """One for each worker process and file."""
    if (path, chunked) not in _encoders:
        _encoders[path, chunked] = Encoder(path, chunked)
    return _encoders[path, chunked]


def schema(dtype: np.dtype, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Cuts a stream of ids into sequences."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.dtype, self.length, self.rows = dtype, length, rows
        self.sink = files.create(uri)
        self.out = pa.ipc.new_stream(self.sink, schema(dtype, length))
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        full = self.rows * self.length * self.dtype.itemsize
        if self.n_held >= full:
            data = b"".join(self.held)
            cut = len(data) - len(data) % full
            for at in range(0, cut, full):
                self._put(data[at : at + full])
            self.held, self.n_held = [data[cut:]], len(data) - cut

    def _put(self, data: bytes) -> None:
        ids = np.frombuffer(data, self.dtype)
        n = len(ids)
        size = -(-n // self.length) * self.length
        mask = np.zeros(size, bool)
        mask[:n] = True
        if size > n:
            ids = np.concatenate([ids, np.zeros(size - n, self.dtype)])
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(cols, schema=schema(self.dtype, self.length)))
        self.total += n

    def close(self) -> int:
        if self.n_held:
            self._put(b"".join(self.held))
        self.out.close()
        self.sink.close()
        return self.total


class TokenFile:
    """Random access to the sequences of a file, without copies."""

    def __init__(self, uri: str):
        where, path = files.opened(uri)
        self.file = pa.memory_map(path) if where.type_name == "local" else where.open_input_file(path)
        head = pa.ipc.read_message(self.file)
        self.schema = pa.ipc.read_schema(head)
        self.first = self.file.tell()
        self.length = self.schema.field("ids").type.list_size
        self.rows = self.stride = 0
        message = self._message(self.first)
        if message is not None:
            self.stride = self.file.tell() - self.first
            self.rows = pa.ipc.read_record_batch(message, self.schema).num_rows

    def _message(self, at: int) -> pa.Message | None:
        self.file.seek(at)
        try:
            return pa.ipc.read_message(self.file)
        except EOFError:
            return None

    def batch(self, k: int) -> pa.RecordBatch:
        message = self._message(self.first + k * self.stride) if self.stride else None
        if message is None:
            raise IndexError(k)
        return pa.ipc.read_record_batch(message, self.schema)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i."""
        if not self.rows:
            raise IndexError(i)
        b, at = self.batch(i // self.rows), i % self.rows
        if at >= b.num_rows:
            raise IndexError(i)
        ids = b.column(0).values.to_numpy(zero_copy_only=True)
        return ids[at * self.length : (at + 1) * self.length], b.column(1)[at].values

    def ids(self) -> Iterator[np.ndarray]:
        """All unmasked ids, by batch."""
        self.file.seek(0)
        for b in pa.ipc.open_stream(self.file):
            n = b.column(1).values.true_count
            yield b.column(0).values.to_numpy(zero_copy_only=True)[:n]


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _File:
    """A file of sequences and its index."""

    def __init__(self, path: str, dtype: np.dtype, length: int):
        self.path, self.n_docs, self.n_ids = path, 0, 0
        self.out, self.sink = _Writer(path, dtype, length), files.create(path + ".index")
        self.index = pa.ipc.new_stream(self.sink, INDEX)

    def add(self, ids: pa.Array, coded: list[bytes], sizes: np.ndarray) -> None:
        """``coded`` with their end ids."""
        for c in coded:
            self.out.add(c)
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.record_batch([ids, pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.n_docs, self.n_ids = self.n_docs + len(ids), self.n_ids + int(sizes.sum())

    def close(self, shard: int, part: int) -> pa.RecordBatch:
        self.index.close()
        self.sink.close()
        if self.out.close() != self.n_ids:
            raise ValueError("the index and the file differ")
        return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "path": [self.path], "n_docs": [self.n_docs], "n_tokens": [self.n_ids]})


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, chunked: bool = True, length: int = LENGTH, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes (doc_id, text) rows; a row for each file: shard, part (its place in the shard), path, n_docs, n_tokens."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    total = docs.count()
    n = max(1, -(-total // SHARD), min(8 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // SHARE)))
    rows = rows.repartitionByRange(int(n), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, part, file = encoder(tokenizer, chunked), TaskContext.get().partitionId(), 0, None
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            coded = [c + end for c in enc(b.column(1).to_pylist())]
            sizes = np.array([len(c) // enc.dtype.itemsize for c in coded], np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(coded):
                if file is None:
                    file = _File(f"{folder}/{files.attempt_name()}.arrows", enc.dtype, length)
                before = int(ends[at] - sizes[at])
                to = min(int(np.searchsorted(ends, before + file_ids - file.n_ids)) + 1, len(coded))
                file.add(b.column(0)[at:to], coded[at:to], sizes[at:to])
                at = to
                if file.n_ids >= file_ids:
                    yield file.close(shard, part)
                    file, part = None, part + 1
        if file is not None:
            yield file.close(shard, part)

    return rows.mapInArrow(run, "shard long, part long, path string, n_docs long, n_tokens long")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of ``manifest``; the manifest has one row for each file."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                blocks = TokenFile(row["path"]).ids()
                block, at = np.zeros(0, np.uint16), 0
                with files.source(row["path"] + ".index") as f:
                    for ib in pa.ipc.open_stream(f):
                        sums = []
                        for n in ib.column("n_tokens").to_pylist():
                            crc = 0
                            while n:
                                if at == len(block):
                                    block, at = next(blocks), 0
                                part = block[at : at + n]
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                                at, n = at + len(part), n - len(part)
                            sums.append(crc)
                        start = pa.array(ib.column("start").to_numpy() + row["base"])
                        yield pa.RecordBatch.from_arrays([ib.column("doc_id"), start, ib.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(8, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    spread = manifest.select("path", before.alias("base")).repartition(n, "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    return read(written(write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 1), "token-manifest"))
