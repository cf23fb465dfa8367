"""Operator 13: token-ID files with a shared zstandard dictionary.

A dictionary is trained on serialized id arrays of a bounded sample of documents; every document's
ids are compressed by it on their own, so that any document can be read alone. Documents stand in
ascending order of doc_id in files (shards) that Spark writes and commits:

    header     magic, bytes of an id, SHA-256 of the dictionary, number of the shard
    frames     one compressed id array per document
    index      an Arrow table doc_id, offset, length, n_tokens
    trailer    length of the index, magic

Each record is followed by a line break (Spark's text writer puts it there); offsets count it. A
folder holds `shards`, `dictionary` (one row) and `manifest`: one row per shard with its file, its
first and last doc_id, the number of its documents and ids, and the ids before it. Readers refuse
shards whose dictionary hash is not that of the dictionary at hand.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import Scratch, letters, shared_folder, table, worker_state

MAGIC = b"IDS1"
HEADER, TRAILER = "<4sB32sQ", "<Q4s"


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set from the first to the last of each range."""
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


_LETTER = _bytes((0x41, 0x5A), (0x61, 0x7A))
_INK = _bytes((0x21, 0x7E))
#: Second bytes of the letters U+00C0 to U+00FF (U+00D7 and U+00F7 are signs).
_LATIN = _bytes((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: Bytes that begin something that is surely no white space: not those of U+0085, U+1680, U+2000, U+3000, U+FEFF.
_SOLID = _bytes((0x21, 0x7E), (0xC3, 0xDF), (0xE0, 0xE0), (0xE4, 0xEE), (0xF0, 0xF4))
_SOLID_BYTES = _SOLID.tolist()


def piece_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the UTF-8 bytes of texts that follow each other can be cut, always where a match of the tokenizer's
    pattern begins: at the begin of a text, at a space before something else, behind a letter before a sign or
    digit, and at a line break behind something else. Where that is not sure from a few bytes, there is no cut."""
    after, before, second = (np.zeros(len(data), np.uint8) for _ in range(3))
    after[:-1], before[1:], second[2:] = data[1:], data[:-1], data[:-2]
    some = starts < ends
    starts, ends = starts[some], ends[some]
    after[ends - 1] = before[starts] = second[starts] = 0
    second[(starts + 1)[starts + 1 < ends]] = 0
    letter = _LETTER[before] | ((second == 0xC3) & _LATIN[before])
    cut = (data == 0x20) & _SOLID[after]
    cut |= letter & _INK[data] & ~_LETTER[data]
    cut |= (data == 0x0A) & (letter | _INK[before])
    cut[starts] = True
    return np.flatnonzero(cut)


class WordEncoder:
    """Ids of texts by a tokenizers file, as little-endian integers of `width` bytes.

    Texts are cut where a match of the file's pattern begins, whatever stands around (`piece_starts`), so
    that the pieces can be encoded apart without a change of the ids. Equal pieces of a batch are told by
    Arrow's dictionary encoding; those seen before are looked up, new ones are encoded many in one
    call: tokens that begin with a space show where each begins. At most 2 * most pieces are kept."""

    def __init__(self, path: str, width: int, most: int = 150_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind, self.most = f"<u{width}", most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _words(self, words: list[bytes], most: int = 2000) -> Iterator[bytes]:
        """Ids of pieces that begin with a space."""
        for i in range(0, len(words), most):
            some = words[i : i + most]
            (all_,) = self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)
            ids = np.array(all_.ids, self.kind)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(some):
                data, ends = ids.tobytes(), [*(at * ids.itemsize).tolist(), ids.nbytes]
                yield from (data[a:b] for a, b in zip(ends, ends[1:]))
            else:  # one holds more spaces
                yield from self._ids(some)

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        places = [i for i, known in enumerate(out) if known is None]
        found = [old.get(pieces[i]) for i in places]
        young.update((pieces[i], known) for i, known in zip(places, found) if known is not None)
        new = [pieces[i] for i, known in zip(places, found) if known is None]
        # Only words, with no white space behind their space, can stand behind another piece.
        word = [len(p) > 1 and p[0] == 0x20 and _SOLID_BYTES[p[1]] for p in new]
        words, others = [p for p, w in zip(new, word) if w], [p for p, w in zip(new, word) if not w]
        young.update(zip(words, self._words(words)))
        young.update(zip(others, self._ids(others)))
        for i in places:
            out[i] = young[pieces[i]]
        for p in new:
            if len(p) > 64:
                del young[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        texts = [t.encode() for t in texts]
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate(([0], ends[:-1]))
        if not joined:
            return [b""] * len(texts)
        at = piece_starts(np.frombuffer(joined, np.uint8), starts, ends)
        offsets = np.append(at, len(joined)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        known = self._known(pieces.dictionary.to_pylist())
        every = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int32, len(known)) // every.itemsize
        # Each piece's ids, one piece after the other.
        n = size[which]
        to = np.cumsum(n, dtype=np.int32)
        shift = (np.cumsum(size, dtype=np.int32) - size)[which] - (to - n)
        out = every[np.repeat(shift, n) + np.arange(to[-1], dtype=np.int32)].tobytes()
        to = np.concatenate(([0], to.astype(np.int64))) * every.itemsize
        a, b = to[np.searchsorted(at, starts)].tolist(), to[np.searchsorted(at, ends)].tolist()
        return [out[i:j] for i, j in zip(a, b)]


def _texts(texts: list[str], letters: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about so many letters together, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= letters:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def width_of(path: str) -> int:
    """Bytes that an id of the tokenizer needs."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def trained_dictionary(docs: DataFrame, path: str, end: int, train_documents: int = 1000, train_chars: int = 2000, size: int = 1 << 16) -> bytes:
    """A dictionary from the id arrays of at most train_documents documents drawn from all, of each
    at most train_chars code points: the sample (some megabytes) is all that comes to the driver.
    It sets how well documents are compressed, not what is read back. Samples too small to train
    on serve as the dictionary themselves."""
    share = min(1.0, 1.5 * train_documents / max(1, docs.count()))
    rows = docs.select(F.substring(letters(), 1, train_chars).alias("t")).sample(share, seed=1)
    texts = [r.t for r in rows.limit(train_documents).collect()]
    width = width_of(path)
    encoder = WordEncoder(path, width)
    last = end.to_bytes(width, "little")
    samples = [b + last for at, to in _texts(texts) for b in encoder.encode(texts[at:to])]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] + last * 8


def compressed(docs: DataFrame, path: str, end: int, dictionary: bytes, level: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens (the end id counted), frame binary."""
    width, key = width_of(path), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    last = end.to_bytes(width, "little")

    def make():
        return WordEncoder(path, width), zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = worker_state(key, make)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts, counts, frames = batch.column(1).to_pylist(), [], []
            for at, to in _texts(texts):
                for ids in encoder.encode(texts[at:to]):
                    counts.append(len(ids) // width + 1)
                    frames.append(press.compress(ids + last))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "frame": pa.array(frames, pa.binary())})

    return docs.select("doc_id", letters().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, frame binary")


def _as_shard(width: int, digest: bytes):
    """A partition's rows doc_id, n_tokens, frame, in order, to the records of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = lambda values: pa.RecordBatch.from_pydict({"value": pa.array(values, pa.binary())})
        offset, index = 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not index:
                header = struct.pack(HEADER, MAGIC, width, digest, TaskContext.get().partitionId())
                offset = len(header) + 1
                yield record([header])
            frames = batch.column(2).to_pylist()
            lengths = np.array([len(f) for f in frames], np.int64)
            starts = offset + np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
            offset = int(starts[-1] + lengths[-1] + 1)
            index.append(pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "offset": pa.array(starts), "length": pa.array(lengths), "n_tokens": batch.column(1)}))
            yield record(frames)
        if index:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, index[0].schema) as writer:
                for b in index:
                    writer.write_batch(b)
            body = sink.getvalue().to_pybytes()
            yield record([body + struct.pack(TRAILER, len(body), MAGIC)])

    return run


class Shard:
    """The bytes of one file: number and index at once, documents by their places in it."""

    def __init__(self, data: bytes, dictionary: zstandard.ZstdCompressionDict | None = None) -> None:
        magic, self.width, self.digest, self.number = struct.unpack_from(HEADER, data)
        n, again = struct.unpack_from(TRAILER, data, len(data) - 1 - struct.calcsize(TRAILER))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("no token-id file")
        if dictionary is not None and hashlib.sha256(dictionary.as_bytes()).digest() != self.digest:
            raise ValueError(f"shard {self.number} was written with another dictionary")
        end = len(data) - 1 - struct.calcsize(TRAILER)
        self.data, self.index = data, pa.ipc.open_stream(pa.py_buffer(data[end - n : end])).read_all()
        self.press = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary is not None else None

    def ids(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self.press.decompress(self.data[offset : offset + length]), f"<u{self.width}")


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("_metadata.file_name").alias("file"), "content")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int = 2, level: int = 3, **training: int) -> None:
    """Write docs(doc_id, text, ...) to a new folder, each text's ids and then `end`.

    Null texts count as empty: the end id alone. Null doc_ids come first; rows of one doc_id
    follow each other in the order of a hash of their ids. Every row of the input is a document,
    repeated ones too; an empty table gives a manifest without rows. Other columns are not read.

    The ids are encoded once, into a table in the shared folder that is removed afterwards; only
    the compressed frames are shuffled, by ranges of doc_id, hash and row number, so that many rows
    of one doc_id are dealt over several shards."""
    spark = docs.sparkSession
    dictionary = trained_dictionary(docs, tokenizer_path, end, **training)
    width = width_of(tokenizer_path)
    tmp = Scratch(spark)
    frames = tmp.write(compressed(docs, tokenizer_path, end, dictionary, level))
    keys = ["doc_id", "tie", "row"]
    dealt = frames.withColumns({"tie": F.xxhash64("frame"), "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    records = dealt.select("doc_id", "n_tokens", "frame").mapInArrow(_as_shard(width, hashlib.sha256(dictionary).digest()), "value binary")
    records.select(F.col("value").cast("string")).write.option("compression", "none").text(f"{folder}/shards")
    tmp.drop()
    schema = "hash string, dictionary binary"
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], schema).coalesce(1).write.parquet(f"{folder}/dictionary")
    kind = dict(docs.dtypes)["doc_id"]

    def totals(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                if not data:
                    continue
                shard = Shard(data)
                ids, n = shard.index.column("doc_id"), len(shard.index)
                total = int(np.sum(shard.index.column("n_tokens").to_numpy()))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard.number], pa.int64()), "file": pa.array([file.as_py()]), "first": ids.slice(0, 1).combine_chunks(), "last": ids.slice(n - 1, 1).combine_chunks(), "documents": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

    # One row a file, as in a listing of the folder.
    columns = f"shard long, file string, first {kind}, last {kind}, documents long, ids long"
    found = sorted(_contents(spark, [f"{folder}/shards"]).mapInArrow(totals, columns).collect())
    rows, start = [], 0
    for r in found:
        rows.append((*r, start))
        start += r.ids
    spark.createDataFrame(rows, f"{columns}, start long").coalesce(1).write.parquet(f"{folder}/manifest")


def _decoded(spark: SparkSession, folder: str, contents: DataFrame, manifest: DataFrame, wanted: frozenset | None) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    shared = spark.sparkContext.broadcast(stored.dictionary)
    kind = dict(manifest.dtypes)["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = zstandard.ZstdCompressionDict(shared.value)
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if not data:
                    continue
                shard = Shard(data, dictionary)
                n = shard.index.column("n_tokens").to_numpy()
                before = np.cumsum(n) - n
                ids = shard.index.column("doc_id")
                at = np.arange(len(n)) if wanted is None else np.array([i for i, d in enumerate(ids.to_pylist()) if d in wanted], np.int64)
                offset, length = (shard.index.column(c).to_numpy() for c in ("offset", "length"))
                for i in range(0, len(at), 256):
                    some = at[i : i + 256]
                    arrays = [shard.ids(offset[k], length[k]).astype("<u4").tobytes() for k in some]
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(some)).combine_chunks(), "shard": pa.array([shard.number] * len(some), pa.int64()), "before": pa.array(before[some]), "n_tokens": pa.array([len(a) // 4 for a in arrays], pa.int64()), "ids": pa.array(arrays, pa.binary())})

    found = contents.select("content").mapInArrow(run, f"doc_id {kind}, shard long, before long, n_tokens long, ids binary")
    found = found.join(manifest.select("shard", "start"), "shard")
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (the end id counted), ids (binary,
    little-endian unsigned 32-bit integers) of every document of a folder."""
    return _decoded(spark, folder, _contents(spark, [f"{folder}/shards"]), spark.read.parquet(f"{folder}/manifest"), None)


def read_documents(spark: SparkSession, folder: str, doc_ids: list) -> DataFrame:
    """The same of a few documents: only shards whose range holds one of them are opened, and
    only their frames are decompressed. Unknown ids give no row; null is no id."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    wanted = frozenset(d for d in doc_ids if d is not None)
    inside = F.lit(False)
    for d in sorted(wanted):
        inside = inside | ((F.coalesce("first", F.lit(d)) <= d) & (F.col("last") >= d))
    files = [r.file for r in manifest.where(inside).select("file").collect()]
    if not files:
        return _decoded(spark, folder, spark.createDataFrame([], "file string, content binary"), manifest, wanted)
    return _decoded(spark, folder, _contents(spark, [f"{folder}/shards/{f}" for f in files]), manifest, wanted)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
