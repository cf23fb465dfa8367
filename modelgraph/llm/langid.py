"""Operator 7: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all its segmentations into pieces of the product of
their probabilities, summed by a forward algorithm; a text's is the product over its words. The
piece probabilities are learned by expectation maximisation (forward-backward counts) on a
bounded sample of labelled texts; the vocabulary itself is never trained.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelgraph.llm.common import checkpointed, letters, table, worker_state

_LETTERS = regex.compile(r"\p{L}+")


def read_pieces(path: str) -> list[str]:
    """Letter pieces of a sentencepiece vocabulary, lower-cased; a leading U+2581 marks a word's
    start. Every single letter that occurs later and is no piece shares one more piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and regex.fullmatch(r"▁?\p{L}*", piece):
            found.add(piece)
    return sorted(found)


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Unigrams:
    """Piece probabilities p[piece, language]; row 0 is the piece of unknown letters."""

    def __init__(self, pieces: list[str], p: np.ndarray) -> None:
        self.id = {piece: i + 1 for i, piece in enumerate(pieces)}
        self.p = p
        self.longest = max(map(len, pieces), default=1)

    def lattice(self, group: list[str], back: bool = False):
        """For marked words of equal length: (start, end, piece ids of each word, 0 for none and
        for an unknown letter) of all places with a piece, by end; back: the last end first."""
        get, n = self.id.get, len(group[0])
        for end in range(n, 0, -1) if back else range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                ids = np.array([get(w[start:end], 0) for w in group])
                if end - start == 1 or ids.any():
                    yield start, end, ids

    def weights(self, start: int, end: int, ids: np.ndarray, lang: np.ndarray | None = None) -> np.ndarray:
        p = self.p[ids] if lang is None else self.p[ids, lang][:, None]
        if end - start > 1:
            p[ids == 0] = 0
        return p

    def forward(self, group: list[str], lang: np.ndarray | None = None):
        """log probabilities [word, language] of words of equal length. Rows are rescaled at
        each position, so long words don't underflow; only as many positions as the longest
        piece has letters are kept, so they take no more memory. lang (one for each word): of that language alone, and with
        all positions, which backward needs."""
        group = ["▁" + w for w in group]
        n, k = len(group[0]), self.p.shape[1] if lang is None else 1
        size = (min(n, self.longest) if lang is None else n) + 1
        alpha = np.zeros((size, len(group), k))
        alpha[0] = 1
        scale = np.zeros((size, len(group), k))
        at = 0
        for start, end, ids in self.lattice(group):
            i, j = start % size, end % size
            if end != at:
                self._close(alpha, scale, at % size)
                at = end
                alpha[j] = 0
                scale[j] = scale[(end - 1) % size]
            alpha[j] += alpha[i] * self.weights(start, end, ids, lang) * np.exp(scale[i] - scale[j])
        self._close(alpha, scale, at % size)
        logs = np.log(alpha[n % size]) + scale[n % size]
        return logs if lang is None else (logs, alpha, scale)

    @staticmethod
    def _close(alpha, scale, at):
        m = np.maximum(alpha[at], 1e-280)
        alpha[at] = alpha[at] / m
        scale[at] += np.log(m)

    def expected(self, group: list[str], count: np.ndarray, lang: np.ndarray, into: dict) -> None:
        """Adds the expected piece counts of words (count times each, in language lang)."""
        logs, alpha, scale = self.forward(group, lang)
        n, total = len(group[0]) + 1, logs[:, 0]
        beta = np.full((n + 1, len(group)), -np.inf)
        beta[n] = 0
        la = np.log(np.maximum(alpha[:, :, 0], 1e-300)) + scale[:, :, 0]
        for start, end, ids in self.lattice(["▁" + w for w in group], back=True):
            with np.errstate(divide="ignore"):
                arc = np.log(self.weights(start, end, ids, lang)[:, 0]) + beta[end]
            beta[start] = np.logaddexp(beta[start], arc)
            post = np.exp(la[start] + arc - total) * count
            for i in np.flatnonzero(post > 1e-12):
                into[int(lang[i]), int(ids[i])] += post[i]


def group_size(letters: int) -> int:
    """How many words of so many letters are put together, one at least."""
    return max(1, 4096 // max(1, letters // 16))


def by_length(found: list[str]) -> list[list[str]]:
    groups = defaultdict(list)
    for w in found:
        groups[len(w)].append(w)
    return [g[i : i + group_size(n)] for n, g in groups.items() for i in range(0, len(g), group_size(n))]


def fit(
    labelled: DataFrame, pieces: list[str], docs_per_language: int = 400, iterations: int = 2, smooth: float = 0.01
) -> tuple[list[str], np.ndarray]:
    """labelled(doc_id, text, lang) -> languages (sorted), probabilities [piece, language].

    Learns from at most docs_per_language texts of each language, the first by a hash of doc_id;
    rows with a null among the three are left out. Word counts and expected counts are summed by Spark;
    the driver gets one number for each piece and language."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    # Only ids are ranked, first within slices of a language, so that no task gets all of one; the
    # few chosen ones are bounded, so they are broadcast to the scan of the texts.
    by = F.xxhash64("doc_id"), F.col("doc_id")
    slices = Window.partitionBy("lang", F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(256))).orderBy(*by)
    first = Window.partitionBy("lang").orderBy(*by)
    picked = rows.select("lang", "doc_id").distinct().withColumn("r", F.row_number().over(slices)).where(F.col("r") <= docs_per_language)
    picked = picked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= docs_per_language).select("lang", "doc_id")
    sample = rows.select("lang", "doc_id", "text").join(F.broadcast(picked), ["lang", "doc_id"], "left_semi").select("lang", "text")

    def count(batches):
        for batch in batches:
            seen = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(words(text))
            flat = [(la, w, n) for la, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in flat], pa.string()), "word": pa.array([x[1] for x in flat], pa.string()), "n": pa.array([x[2] for x in flat], pa.int64())})

    counts = sample.repartition("text").mapInArrow(count, "lang string, word string, n long")
    counts = checkpointed(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    p = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    for _ in range(iterations if langs else 0):
        shared = spark.sparkContext.broadcast((pieces, p, langs))

        def expect(batches, shared=shared):
            names, probs, order = shared.value
            model, number = Unigrams(names, probs), {x: i for i, x in enumerate(order)}
            into = defaultdict(float)
            for batch in batches:
                lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                word, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                groups = defaultdict(list)
                for i, w in enumerate(word):
                    groups[len(w)].append(i)
                for length, g in groups.items():
                    size = min(2048, group_size(length))
                    for i in range(0, len(g), size):
                        part = np.array(g[i : i + size])
                        model.expected([word[j] for j in part], n[part], lang[part], into)
            keys = list(into)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([a for a, _ in keys], pa.int32()), "piece": pa.array([b for _, b in keys], pa.int32()), "n": pa.array([into[x] for x in keys], pa.float64())})

        sums = counts.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        p = np.full(p.shape, smooth)
        for r in sums.collect():
            p[r.piece, r.lang] += r.n
        p /= p.sum(0)
    return langs, p


class _Rows(dict):
    """Word -> row of its log probabilities; filled for many words at once."""

    def __init__(self, model: Unigrams, most: int) -> None:
        self.model, self.most = model, most
        self.values = np.zeros((0, model.p.shape[1]), np.float32)

    def add(self, found: set[str]) -> None:
        if len(self) + len(found) > self.most:
            self.clear()
            self.values = self.values[:0]
        new, logs = [], []
        for group in by_length(sorted(found - self.keys())):
            new += group
            logs.append(self.model.forward(group))
        if new:
            self.update(zip(new, range(len(self.values), len(self.values) + len(new))))
            self.values = np.concatenate([self.values, *logs]).astype(np.float32)


def identify(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, cache_words: int = 400_000) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score, one row per input row.

    lang_pred is the language of greatest probability (ties: the first by name) and score its
    posterior under equal priors; null texts, texts without a letter and an empty model give
    'und' and 0. The broadcast model has a number for each piece and language. A worker keeps
    the last cache_words words' rows at most, and those of the texts at hand."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, langs, p))
    key = uuid.uuid4().hex

    def run(batches):
        names, order, probs = shared.value
        rows = worker_state(key, lambda: _Rows(Unigrams(names, probs), cache_words))
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                split = [words(t) for t in batch.column(1).to_pylist()]
                rows.add(set().union(*split) if order else set())
                lang, score = [], []
                for found in split:
                    if not found or not order:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    at = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
                    total = rows.values[at].sum(0, dtype=np.float64)
                    best = int(total.argmax())
                    lang.append(order[best])
                    score.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", letters().alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op7_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    langs, p = fit(docs.where(~held_out()), pieces)
    found = identify(docs, pieces, langs, p)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
