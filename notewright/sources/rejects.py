"""Rows that fail to parse: typed rows and reasoned rejects from raw delimited records.

Structural indexing: the raw records of an Arrow batch lie in one byte buffer. Numpy masks find
quotes, delimiters and backslashes in the whole buffer at once; the parity of the quotes before
a position says whether it lies inside quotes, the parity inside a run of backslashes whether a
character is escaped. From these the field ends of all records follow without a per-character
loop; count and type checks then make each record a typed row or a reject with its reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

REASONS = ("quoting", "columns", "value")
COLUMNS = ("id", "created_at", "transcription", "clinical_note")
PARSED = "struct<id:bigint,created_at:timestamp,transcription:string,clinical_note:string>"
QUOTE, COMMA, TAB, SLASH, CR, LF = (ord(c) for c in '",\t\\\r\n')
BIGINT_MAX = 2**63 - 1
#: Bytes of raw text that are indexed at once; bounds the memory of the masks.
BLOCK_BYTES = 8 << 20

_DIGITS = re.compile(r"[0-9]+")
_ISO = re.compile(
    r"(\d{4})-(\d\d)-(\d\d)(?:[ T](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,6})\d*)?)?(Z|[+-]\d\d(?::?\d\d)?)?)?", re.ASCII
)
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|[\s\S])")
#: The single-letter escapes of PostgreSQL COPY text.
_LETTERS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _unescape(value: str) -> str:
    if "\\" not in value:
        return value

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] == "x" and len(e) > 1:
            return chr(int(e[1:], 16))
        if e[0] in "01234567":
            return chr(int(e, 8) & 0xFF)
        return _LETTERS.get(e, e)

    return _ESCAPE.sub(one, value)


def parse_id(value: str | None) -> int | None:
    """A positive whole number in ASCII digits that fits bigint, else None."""
    if value is None or not _DIGITS.fullmatch(value):
        return None
    digits = value.lstrip("0")
    if not digits or len(digits) > 19:
        return None
    number = int(digits)
    return number if number <= BIGINT_MAX else None


def parse_instant(value: str) -> datetime | None:
    """A real ISO date or timestamp as UTC without zone, else None."""
    m = _ISO.fullmatch(value)
    if not m:
        return None
    y, mo, d, h, mi, s, frac, zone = m.groups()
    try:
        at = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0").ljust(6, "0")))
        if zone and zone != "Z":
            sign = 1 if zone[0] == "+" else -1
            digits = zone[1:].replace(":", "")
            at -= sign * timedelta(hours=int(digits[:2]), minutes=int(digits[2:] or 0))
        return at
    except (ValueError, OverflowError):
        return None


def _within(positions: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that lie inside a wanted record, and the record of each."""
    record = np.searchsorted(starts, positions, "right") - 1
    keep = (record >= 0) & (positions < ends[record]) & wanted[record]
    return positions[keep], record[keep]


def structure(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_csv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(broken quoting per record, position of each real delimiter, its record), delimiters in order.

    ``starts`` must not fall and records must not overlap; ``ends`` exclude the line end.
    """
    n = len(starts)
    broken = np.zeros(n, dtype=bool)
    # csv: parity of the quotes before each position of the record
    quotes, q_rec = _within(np.flatnonzero(data == QUOTE), starts, ends, is_csv)
    first = np.searchsorted(q_rec, np.arange(n))  # quotes are in order, so are their records
    inside = (np.arange(len(quotes)) - first[q_rec]) & 1 if len(quotes) else np.zeros(0, dtype=np.int64)
    opening, closing = quotes[inside == 0], quotes[inside == 1]
    o_rec, c_rec = q_rec[inside == 0], q_rec[inside == 1]
    before = data[np.maximum(opening - 1, 0)] if len(data) else data
    bad = (opening != starts[o_rec]) & (before != COMMA) & (before != QUOTE)
    broken[o_rec[bad]] = True
    after = data[np.minimum(closing + 1, len(data) - 1)] if len(data) else data
    bad = (closing + 1 != ends[c_rec]) & (after != COMMA) & (after != QUOTE)
    broken[c_rec[bad]] = True
    broken |= (np.bincount(q_rec, minlength=n) & 1).astype(bool)
    commas, k_rec = _within(np.flatnonzero(data == COMMA), starts, ends, is_csv)
    outside = ((np.searchsorted(quotes, commas) - first[k_rec]) & 1) == 0 if len(commas) else np.zeros(0, dtype=bool)
    commas, k_rec = commas[outside], k_rec[outside]
    # copy: parity inside each run of backslashes
    slashes, s_rec = _within(np.flatnonzero(data == SLASH), starts, ends, ~is_csv)
    if len(slashes):
        index = np.arange(len(slashes))
        new = np.ones(len(slashes), dtype=bool)
        new[1:] = (slashes[1:] != slashes[:-1] + 1) | (s_rec[1:] != s_rec[:-1])
        run = np.maximum.accumulate(np.where(new, index, 0))
        escaping, e_rec = slashes[(index - run) % 2 == 0], s_rec[(index - run) % 2 == 0]
    else:
        escaping, e_rec = slashes, s_rec
    broken[e_rec[escaping + 1 == ends[e_rec]]] = True
    tabs, t_rec = _within(np.flatnonzero(data == TAB), starts, ends, ~is_csv)
    real = ~np.isin(tabs - 1, escaping)
    tabs, t_rec = tabs[real], t_rec[real]
    at, rec = np.concatenate([commas, tabs]), np.concatenate([k_rec, t_rec])
    order = np.argsort(at, kind="stable")
    return broken, at[order], rec[order]


def _field(buffer: memoryview, start: int, end: int, csv: bool) -> str | None:
    text = bytes(buffer[start:end]).decode("utf-8")
    if csv:
        if text.startswith('"'):
            return text[1:-1].replace('""', '"')
        return text or None
    return None if text == "\\N" else _unescape(text)


def parse_block(raws: pa.Array, layouts: list[str | None]) -> tuple[list, list]:
    """Reasons (None for a valid record) and the typed rows of one block of raw records."""
    n = len(raws)
    parts = pc.fill_null(raws.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64)[parts.offset : parts.offset + n + 1]
    raw_buffer = parts.buffers()[2]
    data = np.frombuffer(raw_buffer, dtype=np.uint8) if raw_buffer is not None else np.zeros(0, dtype=np.uint8)
    data = data[: offsets[-1]] if n else data
    starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64).copy()
    for end_byte in (LF, CR):
        last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(n, dtype=np.uint8)
        ends -= (ends > starts) & (last == end_byte)
    is_csv = np.array([(x or "").strip().lower() != "copy" for x in layouts], dtype=bool)
    broken, at, rec = structure(data, starts, ends, is_csv)
    fields = np.bincount(rec, minlength=n) + 1
    first = np.searchsorted(rec, np.arange(n))
    null = np.asarray(raws.is_null())
    reasons: list[str | None] = [None] * n
    rows: list[dict | None] = [None] * n
    buffer = memoryview(data)
    for i in range(n):
        if broken[i]:
            reasons[i] = "quoting"
            continue
        if null[i] or fields[i] != len(COLUMNS):
            reasons[i] = "columns"
            continue
        cuts = at[first[i] : first[i] + len(COLUMNS) - 1]
        lows, highs = [starts[i], *(cuts + 1)], [*cuts, ends[i]]
        values = [_field(buffer, a, b, is_csv[i]) for a, b in zip(lows, highs)]
        number = parse_id(values[0])
        instant = None if values[1] is None else parse_instant(values[1])
        if number is None or (values[1] is not None and instant is None):
            reasons[i] = "value"
            continue
        rows[i] = {"id": number, "created_at": instant and instant.replace(tzinfo=timezone.utc), "transcription": values[2], "clinical_note": values[3]}
    return reasons, rows


_PARSED_ARROW = pa.struct(
    [("id", pa.int64()), ("created_at", pa.timestamp("us", tz="UTC")), ("transcription", pa.string()), ("clinical_note", pa.string())]
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, raw, layout = batch.columns
        sizes = np.asarray(pc.fill_null(pc.binary_length(raw), 0), dtype=np.int64)
        block = np.cumsum(sizes) // BLOCK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(sizes)] if len(sizes) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            reasons, rows = parse_block(raw.slice(a, b - a), layout.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [key.slice(a, b - a), pa.array(reasons, pa.string()), pa.array(rows, _PARSED_ARROW)],
                names=["key", "reason", "parsed"],
            )


def parse_rows(raw_rows: DataFrame, key: str = "row_id", raw: str = "raw", layout: str = "layout") -> DataFrame:
    """(key, reason, parsed): every raw record once, either typed or with a reason.

    ``reason`` is the first of ``quoting``, ``columns``, ``value`` that applies and null for a valid
    record, whose typed fields are in the struct ``parsed``. Defined cases: a null raw record and
    an empty one fail as ``columns``; a layout other than ``copy`` (null included, letter case and
    blanks ignored) reads as csv; repeated records come out once per input row; other columns of
    the input, whatever their names, are not read; an empty table gives an empty result.
    Rows are independent, so nothing is shuffled; very long records share a block with few others.
    """
    picked = raw_rows.select(F.col(key).alias("key"), F.col(raw).cast("string").alias("raw"), F.col(layout).cast("string").alias("layout"))
    schema = T.StructType([T.StructField("key", picked.schema["key"].dataType), T.StructField("reason", T.StringType())])
    schema = schema.add("parsed", T._parse_datatype_string(PARSED))
    out = picked.mapInArrow(_parse_batches, schema)
    return out.withColumnRenamed("key", key) if key not in ("reason", "parsed") else out


def valid_rows(parsed: DataFrame, key: str = "row_id") -> DataFrame:
    """The typed rows."""
    return parsed.filter("reason IS NULL").select(key, "parsed.*")


def rejects(parsed: DataFrame, key: str = "row_id") -> DataFrame:
    """The records that cannot become a row, with the reason."""
    return parsed.filter("reason IS NOT NULL").select(key, "reason")
