"""Large JSON files of one array, or of one object with an array in it, read by many tasks.

Spark cuts a text file by byte ranges, and with an opening brace for the end of a line every row is what stands between
two braces, whole, in one range. What a range begins with depends on what comes before: it may lie inside of a text, or
deep in a record. A first pass finds for each range how it changes that, whichever it is; the driver, which has a row
for each range, follows these changes from the start of the file. A second pass cuts the records out, knowing where
it starts; of records that reach over ranges it returns pieces, which are put together.
"""

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TOKEN = re.compile(r'"|\\.|[\[\]{}]', re.DOTALL)
KEYS = ("features", "places")
PIECES = "file string, start long, seq long, kind int, text string"


def _rows(batches: Iterator[pa.RecordBatch]):
    """The text of each range, piece by piece, with the braces put back."""
    last = None
    for batch in batches:
        for file, start, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            # Only what comes before the first brace of a file has none in front of it.
            yield (file, start), text if start == 0 and last != (file, start) else "{" + text
            last = (file, start)


class _Change:
    """What a range does to the state before it: whether a text is open, how deep we are, what was last opened how deep."""

    def __init__(self):
        self.inside, self.first = 0, None
        self.depth, self.opened = [0, 0], [{}, {}]
        self.key = None

    def add(self, text: str) -> None:
        if self.first is None and text.strip():
            self.first = text.strip()[0]
        quote = None
        for m in TOKEN.finditer(text):
            c = m.group()
            if c == '"':
                self.inside ^= 1
                self.key, quote = (text[quote + 1 : m.start()] if quote is not None else None), m.start()
            elif c[0] == "\\":
                continue
            elif c in "[{":
                # Of the two cases, text open before or not, the one in which this sign is none of a text.
                at = self.depth[self.inside]
                if at <= 2:
                    self.opened[self.inside][at] = (c, self.key)
                self.depth[self.inside] = at + 1
            else:
                self.depth[self.inside] -= 1

    def as_text(self) -> str:
        return json.dumps([self.inside, self.first, self.depth, [list(o.items()) for o in self.opened]])


def _changes(batches):
    found = {}
    for at, text in _rows(batches):
        found.setdefault(at, _Change()).add(text)
    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64()), pa.array([c.as_text() for c in found.values()], pa.string())], ["file", "start", "change"])


def _states(changes: list) -> dict:
    """Where each range starts: is a text open, how deep, what was opened at depth one and two, and at which depth records begin."""
    out, last = {}, None
    for row in sorted(changes, key=lambda r: (r["file"], r["start"])):
        inside, first, depth, opened = json.loads(row["change"])
        if row["file"] != last:
            _end(last, out)
            last, state = row["file"], (0, 0, None, None, 1 if first == "[" else 2)
        out[row["file"], row["start"]] = state
        was, deep, one, two, records = state
        held = {deep + rel: tuple(v) for rel, v in opened[was]}
        state = (was ^ inside, deep + depth[was], held.get(1, one), held.get(2, two), records)
        out[last] = state
    _end(last, out)
    return out


def _end(file: str | None, states: dict) -> None:
    if file is not None and states.pop(file)[:2] != (0, 0):
        raise ValueError(f"{file} ends within a value")


class _Cutter:
    def __init__(self, state: tuple):
        self.inside, self.depth, self.second, third, self.records = state
        self.key, self.seq = None, 0
        # Pieces of the record that is open; the range may begin within one.
        holder = self.second if self.records == 1 else third
        self.open = [] if self.depth > self.records and self._wanted() and holder[0] == "{" else None
        self.begun = False

    def _wanted(self) -> bool:
        return self.records == 1 or (self.second is not None and self.second[0] == "[" and self.second[1] in KEYS)

    def cut(self, text: str):
        """Finished records, as (kind, text): 0 whole, 1 the end of one that began in an earlier range."""
        at, quote = 0, None
        for m in TOKEN.finditer(text):
            c = m.group()
            if c == '"':
                self.inside ^= 1
                self.key, quote = (text[quote + 1 : m.start()] if quote is not None else None), m.start()
            elif self.inside or c[0] == "\\":
                continue
            elif c in "[{":
                if self.depth == 1:
                    self.second = (c, self.key)
                if self.depth == self.records and c == "{" and self._wanted():
                    self.open, self.begun, at = [], True, m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if self.open is not None and self.depth == self.records:
                    self.open.append(text[at : m.end()])
                    yield 0 if self.begun else 1, "".join(self.open)
                    self.open = None
        if self.open is not None:
            self.open.append(text[at:])

    def rest(self):
        """What is left of a record at the end of a range: 2 begun here, 1 neither begun nor ended."""
        if self.open:
            yield 2 if self.begun else 1, "".join(self.open)


def _cut(states: dict):
    def run(batches):
        now, cutter, out, size = None, None, [], 0

        def put(at, found):
            for kind, text in found:
                out.append((*at, cutter.seq, kind, text))
                cutter.seq += 1

        for at, text in _rows(batches):
            if at != now:
                if cutter:
                    put(now, cutter.rest())
                now, cutter = at, _Cutter(states[at])
            put(at, cutter.cut(text))
            size += len(text)
            if size > 1 << 22:
                yield _pieces(out)
                size = 0
                out.clear()
        if cutter:
            put(now, cutter.rest())
        yield _pieces(out)

    return run


def _pieces(out: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], ["file", "start", "seq", "kind", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, seq, text``: the objects of an array, or of the array under one of ``KEYS`` in an object (SRC-02).

    ``start`` and ``seq`` order the records of a file. Any number of tasks read a file; the rows are the same for all.
    A file that ends within a value fails. Other values of the array, and objects elsewhere, are passed over.
    """
    raw = spark.read.option("lineSep", "{").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    states = _states(raw.mapInArrow(_changes, "file string, start long, change string").collect())
    found = raw.mapInArrow(_cut(states), PIECES)
    whole = found.where("kind = 0").select("file", "start", "seq", "text")
    # At most two pieces a range: one that ends there what has begun before, one that begins there.
    order = W.partitionBy("file").orderBy("start", "seq")
    pieces = found.where("kind > 0").withColumn("record", F.count_if(F.col("kind") == 2).over(order))
    joined = pieces.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda p: p["text"]), "").alias("text"), F.min(F.struct("start", "seq")).alias("at"))
    return whole.unionByName(joined.select("file", "at.start", "at.seq", "text"))
