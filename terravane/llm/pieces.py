"""SentencePiece encoding and decoding by a table of distinct chunks.

A text is cut in front of every run of whitespace markers. Where no piece of the model holds a marker after another
sign, no piece and no merge reaches over such a cut, so a chunk has the same ids wherever it stands. A table of
distinct chunks holds the ids of each, segmented once; those of a text are joined from it by position.

The table has two parts. Chunks that recur are counted over the corpus; the most frequent of them, as many as fit a
bound, are segmented once for all tasks and broadcast. The many that hardly recur are segmented once for each slice of
texts that holds them. No occurrence of a chunk and no text is shuffled.
"""

import functools
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import cut

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: The chunks that are broadcast take at most so many bytes in a worker.
HOT_BYTES = 1 << 26
#: What a dictionary entry takes besides the text and the ids.
ENTRY_BYTES = 160
#: Distinct chunks a task counts before it hands on those met more than once.
COUNTED = 1 << 17
#: Bytes of text that are looked at together.
SLICE = 1 << 20


def chunks(text: str) -> list[str]:
    """The text with the leading marker the library adds, cut in front of every run of markers."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class Model:
    """A model file, sent to the workers as bytes once; its size is that of the vocabulary."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read()
        check(sentencepiece.SentencePieceProcessor(model_proto=content))
        self.content = spark.sparkContext.broadcast(content)


def check(sp: sentencepiece.SentencePieceProcessor) -> None:
    """Raise ``ValueError`` for a model whose chunks cannot be segmented apart, or that changes texts before it cuts them."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(crossing.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model reach over whitespace markers")
    if sp.normalize("  ＡÅ  b ") != f"{MARK * 3}ＡÅ{MARK * 2}b{MARK}":
        raise ValueError("this model normalises texts")


def segment(sp: sentencepiece.SentencePieceProcessor, wanted: list[str]) -> dict[str, bytes]:
    """The ids of chunks, four bytes each. The library puts a marker before a text; a lone marker is what a blank adds to a text."""
    found = {c: np.array(ids, "<i4").tobytes() for c, ids in zip(wanted, sp.encode([c[1:].replace(MARK, " ") for c in wanted]))}
    if MARK in found:
        found[MARK] = np.array(sp.encode("a ")[len(sp.encode("a")) :], "<i4").tobytes()
    return found


def _slices(batch: pa.RecordBatch):
    """The rows of a batch in order, some at a time: about ``SLICE`` bytes of text, which is the last column."""
    ends = pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy().cumsum()
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
        yield batch.slice(at, to - at)
        at = to


def _count(batches):
    counted: Counter = Counter()
    for batch in batches:
        for some in _slices(batch):
            for text in some.column(0).to_pylist():
                counted.update(chunks(text or ""))
            if len(counted) > COUNTED:
                yield _again(counted)
                counted = Counter()
    yield _again(counted)


def _again(counted: Counter) -> pa.RecordBatch:
    again = [c for c, n in counted.items() if n > 1]
    return pa.RecordBatch.from_arrays([pa.array(again, pa.string()), pa.array([counted[c] for c in again], pa.int64())], ["chunk", "n"])


def recurring(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(chunk, n)`` for chunks that recur in what a task counts together, written to the shared folder.

    ``n`` adds up these counts. Null and empty texts have no chunks.
    """
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_count, "chunk string, n long")
    return cut(counted.groupBy("chunk").agg(F.sum("n").alias("n")))


def frequent(table: DataFrame, limit: int) -> DataFrame:
    """The chunks met more often than a power of two, the lowest with which they fit ``limit`` bytes."""
    level = F.floor(F.log2("n"))
    # A sign has at most four bytes, each of them an id of four bytes at most.
    size = 5 * F.octet_length("chunk") + ENTRY_BYTES
    levels = {r["level"]: r["bytes"] for r in table.groupBy(level.alias("level")).agg(F.sum(size).alias("bytes")).collect()}
    lowest, total = 63, 0
    while lowest and total + levels.get(lowest, 0) <= limit:
        total += levels.get(lowest, 0)
        lowest -= 1
    return table.where(level > lowest)


def encode(docs: DataFrame, model: Model, text_col: str = "text", into: str = "ids", decoded: str | None = None, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs`` and a column ``into`` with the ids the library gives each whole text, without begin or end ids.

    With ``decoded`` another column holds what the library decodes these ids to. Null and empty texts have an empty
    array and decode to the empty text. Columns that are already called so are replaced; all others stay, and so do
    all rows, repeated ones too. At most ``hot_bytes`` are broadcast, whatever the corpus; that decides how often a rare
    chunk is segmented, not what its ids are.
    """
    content = model.content

    @F.arrow_udf("binary")
    def segmented(column: pa.Array) -> pa.Array:
        wanted = column.to_pylist()
        table = segment(processor(content.value), wanted)
        return pa.array([table[c] for c in wanted], pa.binary())

    hot = frequent(recurring(docs, text_col), hot_bytes).withColumn("ids", segmented("chunk")).toArrow()
    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((hot.column("chunk").combine_chunks(), hot.column("ids").combine_chunks()))

    def run(batches):
        table, sp = known(name, sent), processor(content.value)
        for batch in batches:
            for some in _slices(batch):
                cuts = [chunks(t or "") for t in some.column(1).to_pylist()]
                rare = segment(sp, list(set().union(*cuts).difference(table)))
                packed = [b"".join([table.get(c) or rare[c] for c in one]) for one in cuts]
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]])
                flat = np.frombuffer(b"".join(packed), "<i4")
                back = [sp.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(ends, ends[1:])] if decoded else [None] * len(packed)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*some.columns, ids, pa.array(back, pa.string())], ["row", "text", "ids", "back"])

    kept = [c for c in docs.columns if c != text_col]
    row = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, StructType([*rows.schema, StructField("ids", ArrayType(IntegerType())), StructField("back", StringType())]))
    made = {text_col: F.col("text"), into: F.col("ids")} | ({decoded: F.col("back")} if decoded else {})
    return found.select(*[made.pop(c, F.col("row")[c] if c in kept else None).alias(c) for c in docs.columns], *[v.alias(c) for c, v in made.items()])


def decode(ids: Column | str, model: Model) -> Column:
    """The text that the library decodes an array of ids to; null and empty arrays give the empty text."""
    content = model.content

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        sp = processor(content.value)
        values, ends = column.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(column).fill_null(0).to_pylist()])
        return pa.array([sp.decode(values[a:b].tolist()) if b > a else "" for a, b in zip(ends, ends[1:])], pa.string())

    return text(ids)


@functools.lru_cache(maxsize=1)
def processor(content: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=content)


#: The broadcast table of this worker as a dictionary, under the name of the call it belongs to.
_known: dict[str, dict[str, bytes]] = {}


def known(name: str, sent: Broadcast) -> dict[str, bytes]:
    if name not in _known:
        _known.clear()
        keys, ids = sent.value
        _known[name] = dict(zip(keys.to_pylist(), ids.to_pylist()))
    return _known[name]
