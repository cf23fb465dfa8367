"""Operator 9: removal of repeated passages by a hash-compared suffix sort.

A byte is removed if a string of `length` bytes that covers it also starts in a document of
smaller doc_id. All strings of all documents are too many to shuffle, so they are first gathered
around anchors: the anchor of a string is its k-byte piece of smallest hash. Equal strings have
equal anchors at equal places, and neighbouring strings mostly share theirs, so about one
position in fifteen is an anchor.

1. Blocks of documents send their distinct anchor hashes, packed, to buckets by hash; buckets
   answer which ones occur in several documents. 32 bits of a hash are told apart in a bucket: two
   hashes taken for one only bring in contexts that nothing shares.
2. Blocks send the distinct contexts of those anchors (the strings around one anchor, as one
   piece of text of less than 2 * length bytes) with their smallest doc_id.
3. A bucket sorts the suffixes of its contexts: suffixes that share an anchor at the same place
   are merge-sorted; two suffixes are compared by their longest common extension, found by
   binary search over polynomial prefix hashes. Neighbours in that order are verified byte by
   byte, and runs of equal strings get their smallest doc_id.
4. Blocks get these back and remove what is covered.

A passage that a third of all documents share reaches its bucket once from each block. Exact
copies of whole documents are settled beforehand by their digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelgraph.llm.common import U64, POWERS, checkpointed, letters, mix64, prefix_hash, substring_hash, table

_A, _B, _C = (U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def piece_hashes(data: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte piece (8 <= k <= 24), from three overlapping words."""
    n = len(data) - k + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    x = word[:n] * _A + word[(k - 8) // 2 : (k - 8) // 2 + n] * _B + word[k - 8 : k - 8 + n] * _C
    x ^= x >> U64(29)
    x *= _B
    x ^= x >> U64(32)
    return x


def anchors(data: bytes, length: int, k: int):
    """(hash, first string, last string, place) of each anchor: the strings data[p:p+length]
    with p from first to last have their leftmost piece of smallest hash at place."""
    h = piece_hashes(data, k)
    low, place, span, wide = h, np.arange(len(h), dtype=np.int32), 1, length - k + 1
    while span < wide:
        step = min(span, wide - span)
        left, right = low[: len(low) - step], low[step:]
        take = left <= right
        low, place = np.where(take, left, right), np.where(take, place[: len(place) - step], place[step:])
        span += step
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(low)])) - 1
    return low[first], first, last, place[first]


def short_keys(key: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket above 32 further bits of each hash: equal hashes have equal short keys."""
    return ((key % U64(buckets)) << U64(32)) | (key >> U64(32))


def context_keys(data: bytes, key: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """A hash of each anchor with its context data[first:last + length]."""
    p = prefix_hash(np.frombuffer(data, np.uint8))
    return mix64(substring_hash(p, first, last + length) ^ key ^ (last - first).astype(U64))


class Suffixes:
    """Suffixes of a text, compared on their first `length` bytes by prefix hashes."""

    def __init__(self, text: bytes, length: int) -> None:
        self.text, self.length = np.frombuffer(text, np.uint8), length
        self.prefix = prefix_hash(self.text)
        self.down = POWERS.upto(len(self.prefix))[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extensions: in a binary search, equal hashes lengthen them."""
        p, got = self.prefix, np.zeros(len(a), np.int64)
        pa, pb, da, db = p[a], p[b], self.down[a], self.down[b]
        step = 1 << (self.length.bit_length() - 1)
        while step:
            to = got + step
            ok = to <= self.length
            to = np.minimum(to, self.length)
            ok &= (p[a + to] - pa) * da == (p[b + to] - pb) * db
            got = np.where(ok, to, got)
            step >>= 1
        return got

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        same = n == self.length
        at = np.minimum(n, self.length - 1)
        return np.where(same, or_equal, self.text[a + at] < self.text[b + at])

    def strings(self, at: np.ndarray) -> np.ndarray:
        return self.text[at[:, None] + np.arange(self.length)]

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes at within groups (equal groups lie together): bottom-up merge sort
        of all groups at once. An element's place in a merged run is its place in its own run
        plus the number of smaller ones in the other, found by binary search."""
        n = len(at)
        order = np.arange(n)
        if not n:
            return order
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((head, [n])))
        start, size = np.repeat(head, size), np.repeat(size, size)
        local, width = np.arange(n) - start, 1
        live = np.flatnonzero(size > 1)
        while len(live):
            run = local[live] // width
            second = run % 2 == 1
            other = np.where(second, run - 1, run + 1) * width
            lo = np.minimum(other, size[live])
            hi = np.minimum(other + width, size[live])
            base, mine = start[live], at[order[live]]
            begin = lo.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                w = np.flatnonzero(open_)
                theirs = at[order[base[w] + mid[w]]]
                # Equal elements of the first run stay before those of the second.
                smaller = self.less(theirs, mine[w], second[w])
                lo[w] = np.where(smaller, mid[w] + 1, lo[w])
                hi[w] = np.where(smaller, hi[w], mid[w])
            place = base + np.minimum(run, np.where(second, run - 1, run)) * width + (local[live] - run * width) + (lo - begin)
            new = order.copy()
            new[place] = order[live]
            order = new
            width *= 2
            live = live[size[live] > width]
        return order

    def equal_runs(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, class): suffixes in order, numbered by runs of equal strings in a group. The
        order is verified on the bytes; should hashes have collided, bytes decide instead."""
        order = self.sort(at, group)
        new = self._steps(at[order], group)
        if new is None:
            rows = self.strings(at)
            order = np.lexsort((*rows.T[::-1], group))
            new = self._steps(at[order], group)
        return order, np.cumsum(new) - 1

    def _steps(self, at: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """Where a new run begins; None if the order is wrong."""
        new = np.ones(len(at), bool)
        for i in range(1, len(at), 65536):
            j = min(len(at), i + 65536)
            rows = self.strings(at[i - 1 : j])
            differ = rows[1:] != rows[:-1]
            some = differ.any(1)
            column = differ.argmax(1)
            k = np.arange(j - i)
            here = group[i:j] == group[i - 1 : j - 1]
            if (here & some & (rows[1:][k, column] < rows[:-1][k, column])).any():
                return None
            new[i:j] = some | ~here
        return new


def _anchors_of_block(length: int, k: int, buckets: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, owner = [], []
        for number, text in zip(pd.factorize(pdf["doc_id"])[0], pdf["text"]):
            data = text.encode()
            if len(data) >= length:
                found = np.unique(short_keys(anchors(data, length, k)[0], buckets))
                keys.append(found)
                owner.append(np.full(len(found), number, np.int32))
        if not keys:
            return pd.DataFrame({"bucket": [], "block": [], "keys": [], "several": []})
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        # Owners of a key lie in ascending order: several if the last is another than the first.
        several = owner[np.concatenate((head[1:], [len(keys)])) - 1] != owner[head]
        keys = keys[head]
        low = keys.astype(np.uint32)  # the bits below the bucket
        cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=U64) << U64(32))
        at = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        parts = [slice(cut[i], cut[i + 1]) for i in at]
        return pd.DataFrame({"bucket": at, "block": key[0], "keys": [low[p].tobytes() for p in parts], "several": [np.packbits(several[p]).tobytes() for p in parts]})

    return run


def _shared_keys(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block its keys that occur in several documents."""
    keys = [np.frombuffer(x, np.uint32) for x in pdf["keys"]]
    flag = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(pdf["several"], keys)]
    every, flags = np.concatenate(keys), np.concatenate(flag)
    order = np.argsort(every)
    every, flags = every[order], flags[order]
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], every[flags]]))
    got = [(int(b), n[np.isin(n, shared, assume_unique=True)]) for b, n in zip(pdf["block"], keys)]
    got = [(b, n) for b, n in got if len(n)]
    return pd.DataFrame({"bucket": key[0], "block": [b for b, _ in got], "keys": [n.tobytes() for _, n in got]})


def _contexts_of_block(length: int, k: int, buckets: int):
    def run(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = [(U64(b) << U64(32)) | np.frombuffer(x, np.uint32).astype(U64) for b, x in zip(replies["bucket"], replies["keys"])]
        shared = np.sort(np.concatenate(parts or [np.zeros(0, U64)]))
        seen: dict[int, list] = {}  # context key -> [anchor key, number of strings, smallest doc_id, place, bytes]
        for doc_id, text in zip(docs["doc_id"], docs["text"]) if len(shared) else ():
            data = text.encode()
            if len(data) < length:
                continue
            h, first, last, place = anchors(data, length, k)
            short = short_keys(h, buckets)
            at = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
            at = np.flatnonzero(shared[at] == short)
            if not len(at):
                continue
            names = context_keys(data, h[at], first[at], last[at], length).tolist()
            for name, anchor, a, b, q in zip(names, h[at].tolist(), first[at].tolist(), last[at].tolist(), place[at].tolist()):
                x = seen.get(name)
                if x is None:
                    seen[name] = [anchor, b - a + 1, doc_id, q - a, data[a : b + length]]
                elif doc_id < x[2]:
                    x[2] = doc_id
        rows: list[list] = [[] for _ in range(buckets)]
        for name, x in seen.items():
            rows[x[0] % buckets].append((name, *x))
        at = [i for i in range(buckets) if rows[i]]
        cols = lambda i, j, kind: np.array([r[j] for r in rows[i]], kind).tobytes()
        return pd.DataFrame(
            {
                "bucket": at, "block": key[0], "names": [cols(i, 0, U64) for i in at], "anchors": [cols(i, 1, U64) for i in at],
                "strings": [cols(i, 2, np.uint8) for i in at], "docs": [cols(i, 3, np.int64) for i in at],
                "places": [cols(i, 4, np.uint8) for i in at], "texts": [b"".join(r[5] for r in rows[i]) for i in at],
            }
        )

    return run


def _first_documents(length: int):
    """In a bucket: for each block's contexts the smallest doc_id of each of their strings."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}  # distinct contexts by their bytes
        anchor, count, low, piece, ids = [], [], [], [], []
        for r in pdf.itertuples(index=False):
            at, mine = 0, []
            strings = np.frombuffer(r.strings, np.uint8).tolist()
            for a, n, d, q in zip(np.frombuffer(r.anchors, U64).tolist(), strings, np.frombuffer(r.docs, np.int64).tolist(), r.places):
                text = r.texts[at : at + n + length - 1]
                at += len(text)
                i = number.setdefault(text, len(anchor))
                if i == len(anchor):
                    anchor.append(a)
                    count.append(n)
                    low.append(d)
                    piece.append(q)
                elif d < low[i]:
                    low[i] = d
                mine.append(i)
            ids.append(np.array(mine, np.int64))
        texts = list(number)
        anchor, count, low = np.array(anchor, U64), np.array(count, np.int64), np.array(low, np.int64)
        # The strings of contexts that share their anchor with another context are sorted.
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        multi = np.zeros(len(anchor), bool)
        multi[order[1:][same]] = multi[order[:-1][same]] = True
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        best = np.repeat(low, count)
        chosen_ = order[multi[order]]
        if len(chosen_):
            joined = b"".join(texts[i] for i in chosen_)
            width = count[chosen_] + length - 1
            offset = np.concatenate(([0], np.cumsum(width)))[:-1]
            inside = np.arange(count[chosen_].sum()) - np.repeat(np.cumsum(count[chosen_]) - count[chosen_], count[chosen_])
            at = np.repeat(offset, count[chosen_]) + inside
            back = np.repeat(np.array(piece, np.int64)[chosen_], count[chosen_]) - inside
            slot = np.repeat(first[chosen_], count[chosen_]) + inside
            _, group = np.unique(np.repeat(anchor[chosen_], count[chosen_]), return_inverse=True)
            group = group * (2 * length) + back
            by = np.argsort(group, kind="stable")
            at, slot, group = at[by], slot[by], group[by]
            sorted_, run_ = Suffixes(joined, length).equal_runs(at, group)
            slot = slot[sorted_]
            smallest = np.full(run_[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, run_, best[slot])
            best[slot] = smallest[run_]
        names, values = [], []
        for r, mine in zip(pdf.itertuples(index=False), ids):
            n = count[mine]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            names.append(r.names)
            values.append(best[np.repeat(first[mine], n) + inside].tobytes())
        return pd.DataFrame({"block": pdf["block"], "names": names, "strings": pdf["strings"], "lows": values})

    return run


#: Bytes of an anchor's piece.
_K = 24


def _cut_block(length: int, k: int, keep: bool):
    def run(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        names = np.concatenate([np.frombuffer(x, U64) for x in replies["names"]] or [np.zeros(0, U64)])
        count = np.concatenate([np.frombuffer(x, np.uint8).astype(np.int64) for x in replies["strings"]] or [np.zeros(0, np.int64)])
        lows = np.concatenate([np.frombuffer(x, np.int64) for x in replies["lows"]] or [np.zeros(0, np.int64)])
        first_low = np.cumsum(count) - count
        by = np.argsort(names)
        names, first_low = names[by], first_low[by]
        out = []
        for doc_id, text in zip(docs["doc_id"], docs["text"]):
            data = text.encode()
            covered = np.zeros(len(data) + 1, np.int32)
            if len(data) >= length and len(names):
                h, first, last, _ = anchors(data, length, k)
                mine = context_keys(data, h, first, last, length)
                at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                hit = np.flatnonzero(names[at] == mine)
                n = last[hit] - first[hit] + 1
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                older = lows[np.repeat(first_low[at[hit]], n) + inside] < doc_id
                start = (np.repeat(first[hit], n) + inside)[older]
                covered[start] += 1
                np.add.at(covered, start + length, -1)
            gone = np.cumsum(covered[:-1]) > 0
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(data) else 0
            out.append((doc_id, len(data), int(gone.sum()), spans, rest, hashlib.sha256(rest).hexdigest()))
        got = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        return got if keep else got.drop(columns="kept")

    return run


def remove_repeats(docs: DataFrame, length: int = 50, block_mb: float = 2, keep: bool = True) -> DataFrame:
    """docs(doc_id long, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept binary (the
    remaining bytes, where keep), kept_sha256, one row per input row.

    Texts are taken as UTF-8 bytes, null as empty. A byte is removed if a string of length
    (32 to 120) bytes that covers it also starts in a document of smaller doc_id; strings are
    judged on the input. n_spans counts maximal removed runs. Documents of null doc_id and those
    shorter than length are left whole and remove nothing. Rows of equal doc_id don't remove
    each other's strings. Other columns are not read. Blocks are of about block_mb megabytes of
    text and buckets of twice that, never fewer than 64, so a task holds only a few of them."""
    assert 32 <= length <= 120
    rows = docs.select("doc_id", letters().alias("text"))
    size = F.octet_length("text").cast("long")
    digests = checkpointed(rows.where("doc_id is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("d"), size.alias("n")))
    total = digests.agg(F.sum("n")).first()[0] or 0
    blocks, buckets = max(64, int(total / (block_mb * 1e6))), max(64, int(total / (2 * block_mb * 1e6)))
    # Copies of whole documents lose everything. A doc_id with several texts is not a copy.
    firsts = digests.where(F.col("n") >= length).groupBy("d").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    copies = digests.join(checkpointed(firsts.select("d", "lo")), "d").where("doc_id > lo").select("doc_id", "n")
    mixed = digests.groupBy("doc_id").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").select("doc_id")
    copies = checkpointed(copies.join(checkpointed(mixed), "doc_id", "left_anti"))

    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    # Copies are marked by rows of their own and left out within blocks, so that one exchange of the
    # texts serves this and all that follows (a join by doc_id would need another).
    marks = copies.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("gone"))
    marked = rows.where("doc_id is not null").withColumn("gone", F.lit(False)).unionByName(marks)
    marked = marked.withColumn("block", block).repartition("block")
    main = marked.withColumn("gone", F.max("gone").over(Window.partitionBy("block", "doc_id"))).where("not gone").select("block", "doc_id", "text")
    by_block = main.groupBy("block")
    sent = by_block.applyInPandas(_anchors_of_block(length, _K, buckets), "bucket int, block int, keys binary, several binary")
    shared = sent.groupBy("bucket").applyInPandas(_shared_keys, "bucket int, block int, keys binary")
    sent = by_block.cogroup(shared.groupBy("block")).applyInPandas(
        _contexts_of_block(length, _K, buckets), "bucket int, block int, names binary, anchors binary, strings binary, docs binary, places binary, texts binary"
    )
    lows = sent.groupBy("bucket").applyInPandas(_first_documents(length), "block int, names binary, strings binary, lows binary")
    kept = ", kept binary" if keep else ""
    cut = by_block.cogroup(lows.groupBy("block")).applyInPandas(_cut_block(length, _K, keep), f"doc_id long, n_bytes long, n_removed long, n_spans long{kept}, kept_sha256 string")

    empty = hashlib.sha256(b"").hexdigest()
    all_gone = copies.select("doc_id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), F.lit(empty).alias("kept_sha256"))
    zero = F.lit(0).cast("long")
    nameless = rows.where("doc_id is null").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.sha2("text", 256).alias("kept_sha256"))
    return cut.unionByName(all_gone.select(*cut.columns)).unionByName(nameless.select(*cut.columns))


def op9_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep=False)
