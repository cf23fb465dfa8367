"""Operator 6: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding: the token t
ending there such that t may stand beside the last token of the prefix before it, i.e. merging
by rank would never join across their border. Storing that token for each prefix gives

* encoding: walk back from the end;
* exact appends: the stored prefixes stay valid, only new positions are computed;
* re-encoding near edits: prefixes before the edit stay; behind it the computation stops as soon
  as as many consecutive prefixes as the longest token has bytes end in the tokens they ended in
  before, since later ones then depend on equal inputs.

Texts are split by the tokenizer's pattern and each match is encoded separately; a match that
is itself a token is that token. Vocabulary files are public and fixed; nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from os.path import commonprefix
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import table, worker_state


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of 'base64 rank' lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of several bytes the two tokens whose merge makes it; tokens that merging
    never makes are absent (they encode only a piece equal to them)."""
    out = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class PrefixEncoder:
    """Encodes byte strings (pieces) by their prefixes' last tokens."""

    def __init__(self, ranks: dict[bytes, int], made_of: dict[int, tuple[int, int]]) -> None:
        self.ranks, self.made_of = ranks, made_of
        self.token = [b""] * (max(ranks.values()) + 1)
        # Every ending of a usable token: the token's rank, or -1 if it is only an ending.
        self.ends: dict[bytes, int] = {}
        self.longest = 1
        for t, r in ranks.items():
            self.token[r] = t
            if len(t) == 1 or r in made_of:
                self.ends[t] = r
                self.longest = max(self.longest, len(t))
                for i in range(1, len(t)):
                    self.ends.setdefault(t[i:], -1)
        self.merged = {pair: r for r, pair in made_of.items()}
        # For each right token, the left ones that are known to (not) stand beside it.
        self.beside: list[dict[int, bool]] = [{} for _ in self.token]
        self.known = 0

    def may_stand(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between these tokens: take them apart in
        reverse order of the merges and look for a pair at the border that would have merged
        first. The answer is kept for the next time."""
        if self.known > 300_000:
            self.known = 0
            for lefts in self.beside:
                lefts.clear()
        self.known += 1
        ok = self.beside[right][left] = self._may_stand(left, right)
        return ok

    def _may_stand(self, left: int, right: int) -> bool:
        # The merge that made a half happened at time (rank, side): of equal ranks the left one
        # comes first, so a pair at the border merges before the right token but not before an
        # equal-ranked left one.
        made, merged = self.made_of, self.merged
        limit = (len(self.token), 0)
        while True:
            r = merged.get((left, right))
            if r is not None and (r, 1) < limit:
                return False
            l_parts, r_parts = made.get(left), made.get(right)
            if l_parts is None and r_parts is None:
                return True
            if r_parts is None or (l_parts is not None and left > right):
                limit, left = (left, 1), l_parts[1]
            else:
                limit, right = (right, 2), r_parts[0]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """last holds the last tokens of data's first len(last) prefixes; adds the others. Of the
        tokens that end at a place only one may stand there, so the search goes back from it and
        stops at the first that may: as many steps as the token has bytes."""
        ends, beside = self.ends.get, self.beside
        for end in range(len(last) + 1, len(data) + 1):
            start = end - 1
            t = ends(data[start:end])
            while start:
                if t >= 0:
                    left = last[start - 1]
                    ok = beside[t].get(left)
                    if self.may_stand(left, t) if ok is None else ok:
                        break
                start -= 1
                t = ends(data[start:end])
            last.append(t)
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the whole, from its prefixes' last tokens."""
        out, at = [], len(last)
        while at:
            t = last[at - 1]
            out.append(t)
            at -= len(self.token[t])
        return out[::-1]

    def edited(self, old: bytes, last: list[int], start: int, end: int, put: bytes) -> tuple[bytes, list[int]]:
        """The bytes and last tokens after old[start:end] has been replaced by put."""
        data = old[:start] + put + old[end:]
        new, shift, same = last[:start], len(put) - (end - start), 0
        while len(new) < len(data):
            self.extend(data[: len(new) + 1], new)
            was = len(new) - 1 - shift
            same = same + 1 if was >= end and last[was] == new[-1] else 0
            if same >= self.longest:
                new += last[was + 1 :]
        return data, new

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.extend(data, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Packed:
    """Piece -> its ids as little-endian unsigned 32-bit integers. Keeps the pieces of the last
    most to 2 * most look-ups of new ones: when the young half is full it becomes the old one."""

    def __init__(self, encoder: PrefixEncoder, most: int) -> None:
        self.encoder, self.most = encoder, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def blobs(self, found: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces. New pieces are encoded in sorted order, so that the
        last tokens of the prefix that two neighbours share are computed once."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new, long = [], []
        for p in set().union(*found).difference(young):
            known = old.get(p)
            if known is not None:
                young[p] = known
            else:
                new.append(p.encode())
                if len(p) > 64:
                    long.append(p)
        before, last = b"", []
        for data in sorted(new):
            whole = self.encoder.ranks.get(data)
            if whole is not None:
                ids = [whole]
            else:
                same = len(commonprefix((before, data)))
                before, last = data, self.encoder.extend(data, last[:same])
                ids = self.encoder.walk(last)
            young[data.decode()] = pack(f"<{len(ids)}I", *ids)
        out = [b"".join(map(young.__getitem__, pieces)) for pieces in found]
        for p in long:
            del young[p]
        return out


def _portions(texts: list[str], letters: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about so many letters together, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= letters:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, cache_pieces: int = 100_000, keep_ids: bool = True
) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids array<int> (where keep_ids), ids_sha256,
    decoded_sha256, one row per input row.

    Null texts count as empty: no tokens, the hashes of nothing. Other columns are not read, so
    names in them cannot clash. Repeated rows give repeated rows. The vocabulary (a fixed public
    file of about a megabyte, read on the driver) is the only thing broadcast; a worker keeps at
    most 2 * cache_pieces encoded pieces and those of the texts at hand.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, halves(ranks)))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, split = worker_state(
            key, lambda: (_Packed(PrefixEncoder(*shared.value), cache_pieces), regex.compile(pattern))
        )
        token = packed.encoder.token
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            counts, arrays, id_hash, text_hash = [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, end in _portions(texts, 1 << 19):
                for blob in packed.blobs(list(map(split.findall, texts[at:end]))):
                    ids = np.frombuffer(blob, "<u4")
                    counts.append(len(ids))
                    if keep_ids:
                        arrays.append(ids.astype(np.int32))
                    id_hash.append(hashlib.sha256(blob).hexdigest())
                    text_hash.append(hashlib.sha256(b"".join(map(token.__getitem__, ids.tolist()))).hexdigest())
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64())}
            if keep_ids:
                out["ids"] = pa.array(arrays, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(
                out | {"ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, {'ids array<int>, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, text; bytes that are no UTF-8 become U+FFFD. Null ids give
    null."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value
        for batch in batches:
            texts = [
                None if ids is None else b"".join(token[i] for i in ids).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op6_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep_ids=False,
    ).select("doc_id", F.col("n_tokens").cast("long"), "ids_sha256", "decoded_sha256")
