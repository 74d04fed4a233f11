"""Cells of raw rows by field: the first alias with a value, a batch of rows at a time.

A map column is looked up once an alias and row when it is read by expressions: some
hundred passes over each row's names. Here the names of a batch are numbered once, and
each alias that occurs in it takes its cells in one step; a number is read once for each
of its spellings. The readings are those of ``first_text`` and, for the first alias that reads as an integer, ``as_int``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from urna.functions.text import text_key
from urna.session import ship

_DROPPED = re.compile(r"[\s.]+")
_WHOLE = re.compile(r"([-+]?[0-9]+)(?:,0*)?|[-+]?,0+")


def read_int(text: str) -> int | None:
    """``as_int`` of one text cell."""
    whole = _WHOLE.fullmatch(_DROPPED.sub("", text))
    if whole is None:
        return None
    value = int(whole[1]) if whole[1] and len(whole[1].lstrip("+-0")) < 20 else 0 if whole[1] is None else 2**63
    return value if -(2**63) <= value < 2**63 else None


def _entries(maps: pa.MapArray) -> tuple[dict[str, np.ndarray], np.ndarray, pa.Array]:
    """The places of each name's cells, the row of each cell, and the cells."""
    ends = maps.offsets.to_numpy()
    names = maps.keys[ends[0] : ends[-1]].dictionary_encode()
    items = maps.items[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(maps)), np.diff(ends))
    code = names.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
    places = {name: order[edges[i] : edges[i + 1]] for i, name in enumerate(names.dictionary.to_pylist())}
    return places, row, items


def _numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spreadsheet numbers as integers, and which of them are integral and fit."""
    fits = (numbers == np.floor(numbers)) & (np.abs(numbers) <= 2.0**63)
    whole = np.where(fits & (numbers < 2.0**63), numbers, 0).astype(np.int64)
    return np.where(fits & (numbers == 2.0**63), np.int64(2**63 - 1), whole), fits


class _Batch:
    """The cells of one batch."""

    def __init__(self, payload: pa.MapArray, numbers: pa.MapArray):
        self.rows = len(payload)
        self.places, self.row, self.items = _entries(payload)
        filled = pc.fill_null(pc.not_equal(self.items, ""), False)
        self.filled = filled.to_numpy(zero_copy_only=False)
        self.number_places, self.number_row, self.number_items = _entries(numbers)

    def text(self, names: Sequence[str]) -> pa.Array:
        at = np.full(self.rows, -1)
        for name in names:
            place = self.places.get(name)
            if place is not None:
                place = place[self.filled[place]]
                place = place[at[self.row[place]] < 0]
                at[self.row[place]] = place
        return self.items.take(pa.array(at, mask=at < 0))

    def integer(self, names: Sequence[str]) -> pa.Array:
        value, known = np.zeros(self.rows, np.int64), np.zeros(self.rows, bool)
        for name in names:
            place = self.places.get(name)
            if place is None:
                continue
            place = place[~known[self.row[place]]]
            read, fits = self._read(place)
            row = self.row[place]
            if name in self.number_places:
                # A cell that was a number counts as that number, if it has a text at all.
                own = self.number_places[name]
                number = np.full(self.rows, np.nan)
                is_number = np.zeros(self.rows, bool)
                cells = self.number_items.take(pa.array(own))
                is_number[self.number_row[own]] = cells.is_valid().to_numpy(zero_copy_only=False)
                number[self.number_row[own]] = cells.fill_null(np.nan).to_numpy(zero_copy_only=False)
                given = self.items.take(pa.array(place)).is_valid().to_numpy(zero_copy_only=False)
                whole, integral = _numbers(number[row])
                read = np.where(is_number[row], whole, read)
                fits = np.where(is_number[row], integral & given, fits)
            value[row[fits]] = read[fits]
            known[row[fits]] = True
        return pa.array(value, mask=~known)

    def _read(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = self.items.take(pa.array(place)).dictionary_encode()
        read = [read_int(text) for text in cells.dictionary.to_pylist()] + [None]
        value = np.array([x or 0 for x in read], np.int64)
        fits = np.array([x is not None for x in read], bool)
        code = cells.indices.fill_null(len(read) - 1).to_numpy(zero_copy_only=False)
        return value[code], fits[code]


def _marked(names: pa.Array, pattern: re.Pattern) -> pa.Array:
    """Whether the search key of each name holds the pattern; null stays null."""
    coded = names.dictionary_encode()
    said = [bool(pattern.search(text_key(name))) for name in coded.dictionary.to_pylist()]
    return pa.array(said, pa.bool_()).take(coded.indices)


def read_cells(
    raw: DataFrame,
    carried: Sequence[str],
    texts: Mapping[str, Sequence[str]],
    integers: Mapping[str, Sequence[str]],
    marks: Mapping[str, Sequence[str]],
) -> DataFrame:
    """The ``carried`` columns, one column a field of aliases, and one a mark of file names.

    ``marks`` tell whether the search key of ``file_name`` holds one of the words.
    """
    ship(raw.sparkSession)
    kind = StructType([raw.schema[c] for c in carried])
    for name, type_ in [*((t, StringType()) for t in texts), *((i, LongType()) for i in integers), *((m, BooleanType()) for m in marks)]:
        kind = kind.add(name, type_)
    carried, texts, integers = list(carried), dict(texts), dict(integers)
    patterns = {mark: re.compile("|".join(words)) for mark, words in marks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _Batch(batch.column("payload"), batch.column("numbers"))
            columns = [batch.column(c) for c in carried]
            columns += [cells.text(aliases) for aliases in texts.values()]
            columns += [cells.integer(aliases) for aliases in integers.values()]
            columns += [_marked(batch.column("file_name"), pattern) for pattern in patterns.values()]
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return raw.select(*carried, "payload", "numbers").mapInArrow(run, kind)
