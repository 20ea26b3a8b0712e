"""Parsing raw records against a character-by-character reading."""

import random

import pyarrow as pa

from notewright.sources import rejects as R


def read_csv(raw):
    """(reason, fields) of one csv record by a state machine."""
    fields, value, quoted, i, was_quoted, any_text = [], "", False, 0, False, False
    while i < len(raw):
        c = raw[i]
        if quoted:
            if c == '"':
                if raw[i + 1 : i + 2] == '"':
                    value += '"'
                    i += 1
                else:
                    quoted = False
            else:
                value += c
        elif c == ",":
            fields.append(value if was_quoted or value else None)
            value, was_quoted, any_text = "", False, False
        elif c == '"':
            if was_quoted or any_text:
                return "quoting", None
            quoted = was_quoted = True
        else:
            if was_quoted:
                return "quoting", None
            value += c
            any_text = True
        i += 1
    if quoted:
        return "quoting", None
    return None, [*fields, value if was_quoted or value else None]


def read_copy(raw):
    fields, value, i, pieces = [], "", 0, []
    while i < len(raw):
        c = raw[i]
        if c == "\\":
            if i + 1 == len(raw):
                return "quoting", None
            value += raw[i : i + 2]
            i += 2
            continue
        if c == "\t":
            fields.append(value)
            value = ""
        else:
            value += c
        i += 1
    return None, [*fields, value]


def expected(raw, layout):
    body = raw[:-1] if raw.endswith("\n") else raw
    body = body[:-1] if body.endswith("\r") else body
    reason, fields = read_csv(body) if layout == "csv" else read_copy(body)
    if reason:
        return reason
    if len(fields) != 4:
        return "columns"
    if layout == "copy":
        fields = [None if f == "\\N" else R._unescape(f) for f in fields]
    ok = fields[0] and fields[0].isascii() and fields[0].isdigit() and 0 < int(fields[0]) < 2**63
    ok = ok and (fields[1] is None or R.parse_instant(fields[1]) is not None)
    return None if ok else "value"


def test_random_records_agree_with_a_state_machine():
    random.seed(4)
    pieces = ['"', '""', ",", "a", "7", "\\", "\\\\", "\t", "\\t", "\\N", "\n", "\r", "å", "2024-02-29", "2023-02-29", " "]
    raws, layouts = [], []
    for _ in range(4000):
        layout = random.choice(["csv", "copy"])
        raws.append(random.choice(["", "5,2024-01-01,", "5\t\\N\t", '"5",,"x"'][0:4]) + "".join(random.choices(pieces, k=random.randint(0, 9))))
        layouts.append(layout)
    reasons, rows = R.parse_block(pa.array(raws), layouts)
    for raw, layout, reason, row in zip(raws, layouts, reasons, rows):
        assert reason == expected(raw, layout), (raw, layout)
        assert (row is None) == (reason is not None)


def test_values():
    assert R.parse_id("007") == 7
    assert [R.parse_id(x) for x in ("0", "", None, "+5", "5.0", "1e3", "٣", str(2**63))] == [None] * 8
    assert R.parse_id(str(2**63 - 1)) == 2**63 - 1
    good = ["2024-02-29", "2024-02-29 10:11", "2024-02-29T10:11:12.5Z", "2024-02-29 10:11:12+02:00"]
    assert all(R.parse_instant(x) for x in good)
    assert R.parse_instant(good[3]).hour == 8
    assert not any(R.parse_instant(x) for x in ("2023-02-29", "", "yesterday", "2024-1-2", "2024-01-01 25:00:00", "20240101", "2024-01-01x"))


def test_defined_cases(spark):
    rows = [
        (1, "copy", "5\t2024-01-01\ta\\nb\\\tc\t\\N\r", 1),
        (2, "csv", '5,,"a ""b"", \n c",', 1),
        (3, "csv", None, 1),
        (4, None, "", 1),
        (5, " COPY ", "5\t\\N\tx\ty\\", 1),
        (6, "csv", "5,2024-01-01,x", 1),
        (7, "csv", '5,"",x,y', 1),
        (7, "csv", '5,"",x,y', 1),
        (8, "csv", "9,2024-01-01," + "x" * 300_000 + ",", 1),
    ]
    df = spark.createDataFrame(rows, "row_id long, layout string, raw string, id int")
    out = {r["row_id"]: r for r in R.parse_rows(df).collect()}
    assert {k: r["reason"] for k, r in out.items()} == {1: None, 2: None, 3: "columns", 4: "columns", 5: "quoting", 6: "columns", 7: "value", 8: None}
    assert out[1]["parsed"]["transcription"] == "a\nb\tc" and out[1]["parsed"]["clinical_note"] is None
    assert out[2]["parsed"]["transcription"] == 'a "b", \n c' and out[2]["parsed"]["created_at"] is None
    assert len(out[8]["parsed"]["transcription"]) == 300_000
    assert R.rejects(R.parse_rows(df)).count() == 6 and R.valid_rows(R.parse_rows(df)).columns[0] == "row_id"
    assert R.parse_rows(df.limit(0)).count() == 0
