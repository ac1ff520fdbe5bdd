"""Large files whose meaning depends on what stands before: JSON documents and dumps of several tables, read in splits.

A split of such a file cannot tell by itself where it begins: inside a string, at what depth of brackets, in which table.
So each split first says what it does to every state it may begin in, which is a short answer; put together in the order
of the splits, these give the state at the start of each one. Then all splits are read at the same time.

Splits are those of Spark's text reader, so files may lie in any store it reads. A task holds about WINDOW bytes at a time;
no value is larger than a line of a dump, or a record of a document.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from fablens.operators.skew import lookup_join
from fablens.session import stored
from fablens.sources.files import dump_rows, parse_json_logs

WINDOW = 4 << 20
# Bytes of small splits that one task reads.
TASK_BYTES = 64 << 20


def _splits(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(file, start, value): pieces of text between separators; those of a split stand in one task, in order.

    Splits much smaller than TASK_BYTES share a task, as starting one costs more than reading such a split.
    """
    text = spark.read.option("lineSep", separator).text(path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    return pieces.coalesce(tasks)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches, cut where a split ends, each with its (file, start)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column(1).to_numpy()
        files = batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(files) != 0)) + 1
        for low, high in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            part = batch.slice(low, high - low)
            yield (part.column(0)[0].as_py(), part.column(1)[0].as_py()), part


# ---- dumps of several tables -------------------------------------------------------------------------------

_HEADER = r"(?i)^COPY\s+(\S+)\s*\(([^)]*)\)\s+FROM\s+stdin[^;]*;\s*$"
_BLOCK_END = "\\."
_OUTSIDE = ""


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers and block ends of the splits -> (file, start, outside, inside): where a split ends that began outside of a
    block, or inside: the header it ends in, empty if outside; null if it ends in the block it began in."""
    found: dict[tuple[str, int], list[str | None]] = {}
    for split, part in _by_split(batches):
        state = found.setdefault(split, [_OUTSIDE, None])
        for value in part.column(2).to_pylist():
            if value == _BLOCK_END:
                state[:] = [_OUTSIDE, _OUTSIDE]
            else:  # within a block this is a line of the table
                state[:] = [value if s == _OUTSIDE else s for s in state]
    yield pa.RecordBatch.from_pylist(
        [{"file": f, "start": s, "outside": a, "inside": b} for (f, s), (a, b) in found.items()],
        schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.string()), ("inside", pa.string())]),
    )


def _headers_at_start(splits: pd.DataFrame) -> pd.DataFrame:
    """The splits of a dump with markers in them -> (dump, file, start, header): in what the next ones begin."""
    header, rows = _OUTSIDE, []
    for split in splits.sort_values(["file", "start"]).itertuples():
        header = split.outside if header == _OUTSIDE else header if split.inside is None else split.inside
        rows.append((split.dump, split.file, split.start, header))
    return pd.DataFrame(rows, columns=["dump", "file", "start", "header"])


def _dump_of(file: str, parts: bool) -> str:
    """What a file belongs to: its folder if that is a dump in parts, else the file is a dump itself."""
    return file.rsplit("/", 1)[0] if parts else file


def _lines_of(headers, table: str | None, parts: bool):
    """Rows of splits -> (table, columns, value) of the lines within blocks, of one table if it is named."""
    header = re.compile(_HEADER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split, state = headers.value, None, _OUTSIDE
        for now, part in _by_split(batches):
            if now != split:
                places, values = known.get(_dump_of(now[0], parts), ([], []))
                before = bisect_left(places, now) - 1
                split, state = now, values[before] if before >= 0 else _OUTSIDE
            lines = part.column(2)
            marks = pc.or_(pc.equal(lines, _BLOCK_END), pc.match_substring_regex(lines, _HEADER))
            low = 0
            for at in [*np.flatnonzero(marks.to_numpy(zero_copy_only=False)), len(lines)]:
                if state != _OUTSIDE:
                    ends = at == len(lines) or lines[at].as_py() == _BLOCK_END
                    high = at if ends else at + 1  # a header within a block is a line
                    match = header.match(state)
                    name = match[1].replace('"', "")
                    if high > low and table in (None, name, name.rsplit(".", 1)[-1]):
                        columns = [c.strip().strip('"') for c in match[2].split(",")]
                        n = high - low
                        yield pa.RecordBatch.from_arrays([
                            pa.array([name] * n), pa.array([columns] * n, pa.list_(pa.string())), lines.slice(low, n),
                        ], names=["table", "columns", "value"])
                    if at < len(lines) and ends:
                        state = _OUTSIDE
                elif at < len(lines) and lines[at].as_py() != _BLOCK_END:
                    state = lines[at].as_py()
                low = at + 1

    return run


def dump_blocks(spark: SparkSession, path: str | Sequence[str], table: str | None = None, parts: bool = False) -> DataFrame:
    """Lines of a dump file of several tables: table, columns and value, from each COPY ... FROM stdin block.

    With `table`, the lines of that table only (with or without its schema's name). With `parts`, the files of a folder are
    parts of one dump, cut between lines, in the order of their names. What is sent to the tasks are the headers of the
    splits with a block's beginning or end in them.
    """
    lines = _splits(spark, path, "\n")
    marks = lines.filter((F.col("value") == _BLOCK_END) | F.col("value").rlike(_HEADER))
    ends = stored(marks.mapInArrow(_block_ends, "file string, start long, outside string, inside string"), "block-ends")
    dump = F.regexp_replace("file", "/[^/]*$", "") if parts else F.col("file")
    schema = "dump string, file string, start long, header string"
    states = ends.withColumn("dump", dump).groupBy("dump").applyInPandas(_headers_at_start, schema).toArrow()
    known: dict[str, tuple[list, list]] = {}
    for whole, file, start, header in sorted(zip(*(c.to_pylist() for c in states.columns))):
        places, values = known.setdefault(whole, ([], []))
        places.append((file, start))
        values.append(header)
    sent = spark.sparkContext.broadcast(known)
    return lines.mapInArrow(_lines_of(sent, table, parts), "table string, columns array<string>, value string")


def read_dump_table(
    spark: SparkSession, path: str | Sequence[str], table: str, schema: StructType | str, parts: bool = False
) -> DataFrame:
    """One table of a dump of several, as `dump_blocks` reads it. `schema` lists its columns in the order of the block."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return dump_rows(dump_blocks(spark, path, table, parts).select("value"), fields)


# ---- JSON documents ----------------------------------------------------------------------------------------

# A document is read in pieces that end at a closing brace, which the reader leaves out.
_BRACE = "}"
_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = b'"\\,[]'
_STEPS = np.zeros(256, dtype=np.int8)
_STEPS[list(b"[{")], _STEPS[list(b"]}")] = 1, -1


def _windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple[str, int], bytes]]:
    """The text of the splits in portions of whole pieces, about `most` bytes each, braces put back."""
    split, waiting, size = None, [], 0
    for now, part in _by_split(batches):
        for value in part.column(2):
            if waiting and (now != split or size >= most):
                yield split, b"".join(waiting)
                waiting, size = [], 0
            split = now
            waiting.append(value.as_py().encode() + b"}")
            size += len(waiting[-1])
    if waiting:
        yield split, b"".join(waiting)


def _structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets and commas with the number of quotes before them, and the letters there.

    A quote counts unless an odd number of backslashes stands before it.
    """
    letters = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(letters == _QUOTE)
    if len(quotes) and _BACKSLASH in data:
        other = np.flatnonzero(letters != _BACKSLASH)
        last = np.searchsorted(other, quotes) - 1
        run = quotes - np.where(last >= 0, other[np.maximum(last, 0)], -1) - 1
        quotes = quotes[run % 2 == 0]
    places = np.flatnonzero((_STEPS[letters] != 0) | (letters == _COMMA))
    return places, np.searchsorted(quotes, places), len(quotes), letters[places]


def _effects(window: int):
    """Splits -> (file, start, quotes, outside, inside, first): what a split adds to the depth if it begins outside of a
    string, or inside; the number of quotes in it, and its first letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for split, data in _windows(batches, window):
            own = found.setdefault(split, [0, 0, 0, None])
            places, before, quotes, letters = _structure(data)
            steps = _STEPS[letters].astype(np.int64)
            even, odd = (int(steps[before % 2 == k].sum()) for k in (0, 1))
            own[1], own[2] = own[1] + (odd if own[0] % 2 else even), own[2] + (even if own[0] % 2 else odd)
            own[0] += quotes
            own[3] = own[3] or (data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1].decode("latin-1") or None)
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "start": s, "quotes": q, "outside": a, "inside": b, "first": c} for (f, s), (q, a, b, c) in found.items()],
            schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()),
                              ("inside", pa.int64()), ("first", pa.string())]),
        )

    return run


def _states(splits: pd.DataFrame) -> pd.DataFrame:
    """The splits of a file -> (file, start, in_string, depth, level, sound): the state in which each begins.

    `level` is the depth at which the list of records opens: 0 if the document is one, else 1. A sound document ends outside
    of strings and brackets; the reader's last piece may have had no brace.
    """
    in_string, depth, rows, first = 0, 0, [], None
    for split in splits.sort_values("start").itertuples():
        rows.append((split.file, split.start, in_string, depth))
        depth += split.inside if in_string else split.outside
        in_string = (in_string + split.quotes) % 2
        first = first or split.first
    frame = pd.DataFrame(rows, columns=["file", "start", "in_string", "depth"])
    frame["level"] = 0 if first == "[" else 1
    frame["sound"] = in_string == 0 and depth in (0, -1) and first in ("[", "{")
    return frame


def _depths(data: bytes, in_string: int, depth: int):
    """(places, letters, depths after them) of what stands outside of strings; the state at the end."""
    places, before, quotes, letters = _structure(data)
    outside = (before + in_string) % 2 == 0
    places, letters = places[outside], letters[outside]
    depths = depth + np.cumsum(_STEPS[letters], dtype=np.int64)
    return places, letters, depths, (in_string + quotes) % 2, int(depths[-1]) if len(depths) else depth


def _lists(states, window: int):
    """Splits -> (file, start, opens, closes, closes_after): first place where a list opens at the document's level, where
    one closes, and where one closes after the first opening; in bytes of the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        now, offset, state = None, 0, None
        for split, data in _windows(batches, window):
            if split not in states.value:
                continue
            if split != now:
                now, offset, state = split, 0, list(states.value[split])
                found[split] = [None, None, None]
            own, level = found[split], state[2]
            places, letters, depths, state[0], state[1] = _depths(data, state[0], state[1])
            opens = places[(letters == _OPEN) & (depths == level + 1)] + offset
            closes = places[(letters == _CLOSE) & (depths == level)] + offset
            own[0] = own[0] if own[0] is not None or not len(opens) else int(opens[0])
            own[1] = own[1] if own[1] is not None or not len(closes) else int(closes[0])
            if own[0] is not None and own[2] is None and len(after := closes[closes > own[0]]):
                own[2] = int(after[0])
            offset += len(data)
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "start": s, "opens": a, "closes": b, "closes_after": c} for (f, s), (a, b, c) in found.items()],
            schema=pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("start", "opens", "closes", "closes_after")]]),
        )

    return run


def _bounds(splits: pd.DataFrame) -> pd.DataFrame:
    """The splits of a file -> (file, first_split, first, last_split, last): where its list of records opens and closes."""
    rows = splits.sort_values("start")
    opening = rows[rows["opens"].notna()].head(1)
    if opening.empty:
        return pd.DataFrame([], columns=["file", "first_split", "first", "last_split", "last"])
    one = opening.iloc[0]
    if pd.notna(one["closes_after"]):
        last = one["start"], one["closes_after"]
    else:
        later = rows[(rows["start"] > one["start"]) & rows["closes"].notna()].head(1)
        last = (later.iloc[0]["start"], later.iloc[0]["closes"]) if len(later) else (one["start"], one["opens"])
    return pd.DataFrame(
        [(one["file"], one["start"], one["opens"], *last)], columns=["file", "first_split", "first", "last_split", "last"]
    )


def _fragments(states, window: int):
    """Splits -> (file, start, k, part, whole, text): what stands between the borders of records.

    k counts the borders of the split up to the fragment: 0 is the rest of a record that began in a split before. A
    fragment is whole if both its borders are in the same portion of the text, the number `part`.
    """
    names = ["file", "start", "k", "part", "whole", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, offset, state, k, part = None, 0, None, 0, 0
        for split, data in _windows(batches, window):
            if split not in states.value:
                continue
            if split != now:
                now, offset, state, k, part = split, 0, list(states.value[split]), 0, 0
            level, (first_split, first, last_split, last) = state[2], state[3]
            places, letters, depths, state[0], state[1] = _depths(data, state[0], state[1])
            start, end = offset, offset + len(data)
            low = first if split[1] == first_split else start if split[1] > first_split else end
            high = last if split[1] == last_split else end if split[1] < last_split else start
            low, high = max(low, start), min(high, end)
            borders = places[(letters == _COMMA) & (depths == level + 1)] + offset
            opens = split[1] == first_split and start <= first < end
            edge = low if opens else low - 1
            borders = borders[(borders > edge) & (borders < high)]
            if low < high or opens:
                cuts = np.r_[edge, borders, high]
                number = k + int(opens) + np.arange(len(cuts) - 1)
                texts = [data[a + 1 - offset:b - offset] for a, b in zip(cuts, cuts[1:])]
                k, n = int(number[-1]), len(texts)
                whole = np.ones(n, dtype=bool)
                whole[0] &= opens
                whole[-1] &= split[1] == last_split and last < end
                yield pa.RecordBatch.from_arrays([
                    pa.array([split[0]] * n), pa.array([split[1]] * n, pa.int64()), pa.array(number, pa.int64()),
                    pa.array([part] * n, pa.int64()), pa.array(whole), pa.array(texts, pa.binary()),
                ], names=names)
            offset, part = end, part + 1

    return run


def json_items(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, record_index, item, error): the texts of the records of JSON files of any size.

    Records are the items of the document if it is a list, else of its first list-valued member; a document without one is
    itself the record. A document with open strings or brackets is one error.
    """
    pieces, window = _splits(spark, path, _BRACE), WINDOW
    effects = stored(pieces.mapInArrow(
        _effects(window), "file string, start long, quotes long, outside long, inside long, first string"
    ), "effects")
    states = stored(effects.groupBy("file").applyInPandas(
        _states, "file string, start long, in_string int, depth long, level int, sound boolean"
    ), "states")
    context = spark.sparkContext
    sound = states.filter("sound").select("file", "start", "in_string", "depth", "level")
    files = states.groupBy("file").agg(F.first("sound").alias("sound"))
    # What is sent has one entry per split, of some ten megabytes of text each. Files without an entry are passed over.
    begins = {(r[0], r[1]): r[2:] for r in zip(*(c.to_pylist() for c in sound.toArrow().columns))}
    lists = pieces.mapInArrow(
        _lists(context.broadcast(begins), window), "file string, start long, opens long, closes long, closes_after long"
    )
    bounds = stored(lists.groupBy("file").applyInPandas(
        _bounds, "file string, first_split long, first long, last_split long, last long"
    ), "bounds")
    between = {r[0]: r[1:] for r in zip(*(c.to_pylist() for c in bounds.toArrow().columns))}
    listed = {split: (*state, between[split[0]]) for split, state in begins.items() if split[0] in between}
    cut = stored(pieces.mapInArrow(
        _fragments(context.broadcast(listed), window), "file string, start long, k long, part long, whole boolean, text binary"
    ), "fragments").coalesce(pieces.rdd.getNumPartitions())
    borders = cut.groupBy("file", "start").agg(F.max("k").alias("borders"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # splits of a file
    offsets = borders.select("file", "start", F.coalesce(F.sum("borders").over(earlier), F.lit(0)).alias("before"))
    numbered = lookup_join(cut, stored(offsets, "offsets"), ["file", "start"], "inner", spread_by=["k", "part"])
    numbered = numbered.withColumn("record_index", (F.col("before") + F.col("k") - 1).cast("int"))
    parts = numbered.filter("not whole").groupBy("file", "record_index").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "text"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda text, p: F.concat(text, p["text"]))
    every = numbered.filter("whole").select("file", "record_index", "text").unionByName(
        parts.select("file", "record_index", joined.alias("text"))
    )
    no_error = F.lit(None).cast("string").alias("error")
    items = every.select("file", "record_index", F.trim(F.col("text").cast("string"), F.lit(" \t\r\n")).alias("item"), no_error)
    items = items.filter(F.col("item") != "")
    alone = stored(files.filter("sound").join(bounds, "file", "left_anti").select("file"), "alone")
    ordered = pieces.withColumn("at", F.monotonically_increasing_id())
    single = lookup_join(ordered, alone, ["file"], "left_semi", spread_by=["at"]).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("pieces")
    ).select(
        "file", F.lit(0).alias("record_index"),
        F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), _BRACE), F.lit(_BRACE)).alias("item"), no_error,
    )
    broken = files.filter("not sound").select(
        "file", F.lit(None).cast("int").alias("record_index"), F.lit(None).cast("string").alias("item"),
        F.lit("document is not valid JSON").alias("error"),
    )
    return items.unionByName(single).unionByName(broken)


def read_json_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, record_index, raw_fields, error) of JSON files of any size, as parse_json_logs gives them.

    An item that is no JSON is an error of its own here, as the others have been read already.
    """
    items = json_items(spark, path).select("file", F.col("record_index").alias("_index"), "item", F.col("error").alias("_error"))
    good = items.filter(F.col("_error").isNull()).withColumn("_list", F.concat(F.lit("["), "item", F.lit("]")))
    parsed = parse_json_logs(good.select("file", "_index", "_list"), "_list").select(
        "file", F.col("_index").alias("record_index"), "raw_fields",
        F.when(F.col("error") == "document is not valid JSON", "item is not valid JSON").otherwise(F.col("error")).alias("error"),
    )
    bad = items.filter(F.col("_error").isNotNull()).select(
        "file", F.col("_index").alias("record_index"), F.lit(None).cast("map<string,string>").alias("raw_fields"), F.col("_error").alias("error")
    )
    return parsed.unionByName(bad)
