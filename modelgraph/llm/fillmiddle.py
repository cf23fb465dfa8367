"""Operator 11: fill-in-middle transformation by secondary-sort assembly.

Every text is cut into pieces of at most `chunk` code points, each keyed by its document and its
place in the output. repartitionAndSortWithinPartitions brings a document's pieces together in
that order, and they stream one by one into its output (or into the output's digest, so that no
whole document is held). What the stream shows (the marks and what stands between them) is
keyed again, by the place in the document, and sorted again for the restoration. The second sort
has the first one's partitioner, so Spark adds no second exchange.

Keys hold a hash of the row and the number of the partition that it was read in, so repeated rows
and rows without an id are spread; only the pieces of one row have to meet.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgraph.llm.common import letters, table

#: Marks of prefix, middle and suffix, in the order of the document's parts.
MARKS = ("<P>", "<M>", "<S>")
#: The parts in the order of each form's output.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


def cuts(docs: DataFrame, seed: int = 1, transformed: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, text, n (code points), form, a, b (ends of prefix and middle). All follow from the
    hash of seed and doc_id: `transformed` of a hundred texts don't stay plain, `suffix_first` of a
    hundred of these begin with the suffix. Texts that are empty or hold a mark stay plain."""
    rows = docs.select("doc_id", letters().alias("text")).withColumn("n", F.length("text").cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains("text", F.lit(MARKS[0])) | F.contains("text", F.lit(MARKS[1])) | F.contains("text", F.lit(MARKS[2]))
    plain = (F.col("n") == 0) | marked | (h[2] % 100 >= transformed)
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    return rows.withColumn("digest", digest).select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))


class Digest:
    """Takes pieces and keeps only their SHA-256."""

    def __init__(self) -> None:
        self.state = hashlib.sha256()
        self.add = self.state.update

    def result(self) -> str:
        return self.state.hexdigest()


class Text:
    """Takes pieces and keeps their text."""

    def __init__(self) -> None:
        self.data = bytearray()
        self.add = self.data.extend

    def result(self) -> str:
        return self.data.decode()


def _chunks(text: str, chunk: int) -> Iterator[bytes]:
    for i in range(0, len(text), chunk):
        yield text[i : i + chunk].encode()


# A record is (key, value); its key (hash of the row, partition that it was read in, number in
# that, part, place). The first record of a row has part 0 and holds what is known of the row.


def _row(key: tuple) -> int:
    """Partitioner: by row, whatever the order of its pieces. One function for both sorts, by
    which Spark sees that the second needs no exchange."""
    return key[0] + key[1]


def _sorted(records: RDD, partitions: int) -> RDD:
    return records.repartitionAndSortWithinPartitions(partitions, _row)


def _placed(cut: DataFrame, chunk: int) -> RDD:
    """The pieces of each output, keyed by their places in it."""

    def run(index, rows):
        for number, (h, doc_id, text, n, form, a, b) in enumerate(rows):
            plain = form == "plain"
            yield (h, index, number, 0, 0), (doc_id, n, form, None if plain else a, None if plain else b - a)
            if plain:
                pieces = _chunks(text, chunk)
            else:
                parts = (text[:a], text[a:b], text[b:])
                pieces = (p for k in ORDERS[form] for p in (MARKS[k].encode(), *_chunks(parts[k], chunk)))
            for place, piece in enumerate(pieces):
                yield (h, index, number, 1, place), piece

    return cut.select(F.xxhash64("doc_id", "text"), "doc_id", "text", "n", "form", "a", "b").rdd.mapPartitionsWithIndex(run)


def _written(sink: type):
    """Pieces in the order of the output -> the same by parts of the document; what is known of a
    row is extended by what sink makes of its output."""
    parts = {m.encode(): 1 + k for k, m in enumerate(MARKS)}

    def run(records):
        known = out = key = None
        for (*row, part, place), value in records:
            if not part:
                if known is not None:
                    yield (*key, 0, 0), (*known, out.result())
                known, out, key, plain, to = value, sink(), row, value[2] == "plain", 1
            else:
                out.add(value)
                if not plain and value in parts:
                    to = parts[value]
                else:
                    yield (*row, to, place), value
        if known is not None:
            yield (*key, 0, 0), (*known, out.result())

    return run


def _gathered(sink: type):
    """Pieces in order -> a tuple a row: what is known of it and what sink makes of its pieces."""

    def run(records):
        known = out = None
        for (*_, part, _), value in records:
            if not part:
                if known is not None:
                    yield (*known, out.result())
                known, out = value, sink()
            else:
                out.add(value)
        if known is not None:
            yield (*known, out.result())

    return run


def _partitions(texts: DataFrame, column: str, partition_bytes: int = 32 << 20) -> int:
    """How many partitions to sort in: at least the session's number, and so many that one holds
    about partition_bytes of text. Spark doesn't fit this number to the data for RDDs."""
    total = texts.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes))


def assembled(docs: DataFrame, sink: type = Text, chunk: int = 16_384, **settings: int) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n long, form, prefix_chars, middle_chars long (null if
    plain), output, restored string, one row per input row. With the sink Text output and restored
    are texts, with Digest their lowercase SHA-256, and no whole text is held behind the cut.

    Null and empty texts give an empty output; a null doc_id counts as an empty number. Repeated
    rows give equal rows. Only doc_id and text are read, so other columns cannot clash."""
    partitions = _partitions(docs, "text")
    output = _sorted(_placed(cuts(docs, **settings), chunk), partitions)
    again = _sorted(output.mapPartitions(_written(sink), preservesPartitioning=True), partitions)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    return docs.sparkSession.createDataFrame(again.mapPartitions(_gathered(sink)), schema, verifySchema=False)


def restored(outputs: DataFrame, chunk: int = 16_384) -> DataFrame:
    """outputs(doc_id, form, output, ...) -> doc_id, text, one row per input row, from outputs that
    were written elsewhere; a null output gives an empty text, a form other than psm and spm the
    output as it is."""
    mark = re.compile("(" + "|".join(map(re.escape, MARKS)) + ")")

    def run(index, rows):
        for number, (h, doc_id, form, output) in enumerate(rows):
            yield (h, index, number, 0, 0), (doc_id,)
            part, place = 1, 0
            for text in mark.split(output) if form in ORDERS else [output]:
                if form in ORDERS and text in MARKS:
                    part = 1 + MARKS.index(text)
                else:
                    for piece in _chunks(text, chunk):
                        yield (h, index, number, part, place), piece
                        place += 1

    rows = outputs.select(F.xxhash64("doc_id", "output"), "doc_id", "form", letters("output"))
    pieces = _sorted(rows.rdd.mapPartitionsWithIndex(run), _partitions(outputs, "output"))
    return outputs.sparkSession.createDataFrame(pieces.mapPartitions(_gathered(Text)), f"doc_id {dict(outputs.dtypes)['doc_id']}, text string", verifySchema=False)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(table(spark, sf_dir, "documents"), Digest).withColumnsRenamed({"output": "output_sha256", "restored": "restored_sha256"})


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
