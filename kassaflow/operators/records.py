"""Delimited records: minimum-cost error parse.

A record is parsed by dynamic programming over its structural pieces (quotes,
delimiters and the text between them). The parser may insert or delete quotes
and delimiters; every edit costs. A record that parses at no cost with the
right number of columns and valid values is loaded; of any other the edits of
the cheapest parse state the reason.

A quote edit costs more than all delimiter edits that the record can have, as a
record is first of all one that is, or isn't, quoted by RFC 4180.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import COLUMNS

QUOTE_COST, DELIMITER_COST = 1000.0, 1.0
_PIECES = re.compile(r'["]|,|[^",]+')
_STRICT = re.compile(r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)(?:,(?:"[^"]*(?:""[^"]*)*"|[^",]*))*')
_FIELD = re.compile(r'"([^"]*(?:""[^"]*)*)"(?:,|$)|([^",]*)(?:,|$)')

# What the columns of the five tables hold.
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_DIGITS = re.compile(r"[0-9]+")
_USER = re.compile(r"[0-9]+(?:\.0)?")
_DECIMAL = re.compile(r"-?[0-9]+(?:\.[0-9]+)?|-?\.[0-9]+|-?[0-9]+\.")
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def _whole(p: re.Pattern):
    return lambda v: p.fullmatch(v) is not None


def _within(bound: float):
    return lambda v: _DECIMAL.fullmatch(v) is not None and abs(float(v)) <= bound


def _time(v: str) -> bool:
    try:
        return _TIME.fullmatch(v) is not None and bool(datetime(int(v[:4]), int(v[5:7]), int(v[8:10]), int(v[11:13]), int(v[14:16]), int(v[17:19])))
    except ValueError:
        return False


def _date(v: str) -> bool:
    try:
        return _DATE.fullmatch(v) is not None and bool(date(int(v[:4]), int(v[5:7]), int(v[8:10])))
    except ValueError:
        return False


VALUES = {
    "transaction_id": _whole(_UUID),
    "user_id": _whole(_USER),
    **{c: _whole(_DIGITS) for c in ("store_id", "payment_method_id", "voucher_id", "item_id", "quantity")},
    **{c: _whole(_DECIMAL) for c in ("original_amount", "discount_applied", "final_amount", "unit_price", "subtotal", "price")},
    "latitude": _within(90),
    "longitude": _within(180),
    "created_at": _time,
    "registered_at": _time,
    **{c: _date for c in ("birthdate", "available_from", "available_to")},
    "is_seasonal": lambda v: v.lower() in ("true", "false"),
}
MAY_BE_EMPTY = {"voucher_id", "gender", "available_from", "available_to"}
MAY_BE_EMPTY_IN = {("transactions", "user_id")}


def invalid_column(table: str | None, values: list[str]) -> str | None:
    """The first column whose value doesn't fit the table; None if all fit.

    Outer spaces are ignored. Columns of unknown tables may hold anything.
    """
    for c, v in zip(COLUMNS.get(table or "", []), values):
        v = v.strip()
        if not v:
            if c not in MAY_BE_EMPTY and (table, c) not in MAY_BE_EMPTY_IN:
                return c
        elif (fits := VALUES.get(c)) and not fits(v):
            return c
    return None


def strict_fields(line: str) -> list[str] | None:
    """The values of a record that follows RFC 4180; None if it doesn't."""
    if '"' not in line:
        return line.split(",")
    if not _STRICT.fullmatch(line):
        return None
    out, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if at == len(line) and not line[m.start() : m.end()].endswith(","):
            return out
        if at == len(line):
            return [*out, ""]


# States between pieces: at the start of a value, inside an unquoted one,
# inside a quoted one, and behind a closing quote.
_START, _BARE, _QUOTED, _CLOSED = range(4)


def cheapest_parse(line: str, columns: int) -> tuple[float, list[str], int]:
    """(cost, edits, columns) of the cheapest parse of a record into ``columns`` values.

    Edits read ``insert_quote@7``; the number is the place in the record. The
    count of columns is followed up to one more than ``columns``; from there on
    every delimiter is a deletion, so the work is linear in the length of the
    record. ``columns`` of the result is the count before delimiters were
    inserted or deleted.
    """
    pieces = [(m.start(), m[0]) for m in _PIECES.finditer(line)]
    # every piece is one delimiter edit at most, and missing columns one each
    quote = max(QUOTE_COST, DELIMITER_COST * (len(pieces) + columns + 1))
    top = columns
    # best[(state, count)] = (cost, back pointer chain of edits); count = delimiters that stand so far
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(_START, 0): (0.0, None)}

    def put(to: dict, key: tuple[int, int], cost: float, chain: tuple | None) -> None:
        old = to.get(key)
        if old is None or cost < old[0]:
            to[key] = (cost, chain)

    def edit(chain: tuple | None, what: str, at: int) -> tuple:
        return (chain, f"{what}@{at}")

    for i, (at, x) in enumerate(pieces):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (s, n), (cost, chain) in best.items():
            one, more, cut = (n + 1, 0.0, chain) if n < top else (top, DELIMITER_COST, edit(chain, "delete_delimiter", at) if x == "," else chain)
            if x == '"':
                put(nxt, (s, n), cost + quote, edit(chain, "delete_quote", at))
                if s == _START:
                    put(nxt, (_QUOTED, n), cost, chain)
                elif s == _QUOTED:
                    put(nxt, (_CLOSED, n), cost, chain)
                elif s == _CLOSED:
                    # a doubled quote is one that stands for itself
                    if pieces[i - 1][1] == '"':
                        put(nxt, (_QUOTED, n), cost, chain)
                    put(nxt, (_QUOTED, one), cost + more + quote, edit(cut, "separate_values", at))
            elif x == ",":
                if s == _QUOTED:
                    put(nxt, (s, n), cost, chain)
                    put(nxt, (_START, one), cost + more + quote, edit(cut, "insert_quote", at))
                else:
                    put(nxt, (_START, one), cost + more, cut)
            else:
                if s in (_START, _BARE):
                    put(nxt, (_BARE, n), cost, chain)
                    if s == _START:
                        put(nxt, (_QUOTED, n), cost + quote, edit(chain, "insert_quote", at))
                elif s == _QUOTED:
                    put(nxt, (s, n), cost, chain)
                else:
                    put(nxt, (_BARE, one), cost + more + quote, edit(cut, "separate_values", at))
        best = nxt
    ends: dict[tuple[int, int], tuple[float, tuple | None]] = {}
    for (s, n), (cost, chain) in best.items():
        if s == _QUOTED:
            put(ends, (_CLOSED, n), cost + quote, edit(chain, "insert_quote", len(line)))
        else:
            put(ends, (s, n), cost, chain)
    total = lambda e: e[1][0] + DELIMITER_COST * abs(e[0][1] + 1 - columns)
    (_, n), (cost, chain) = end = min(ends.items(), key=lambda e: (total(e), e[0]))
    edits: list[str] = []
    while chain:
        edits.append(chain[1])
        chain = chain[0]
    edits.reverse()
    stood = n + 1 + sum(e.startswith("delete_delimiter") for e in edits)
    edits += ["insert_delimiter" if n + 1 < columns else "delete_delimiter"] * abs(n + 1 - columns)
    return total(end), edits, stood


def judge(table: str | None, columns: int | None, raw: str | None) -> tuple[str | None, str | None, list[str] | None]:
    """(reason, detail, values) of a record; reason ``blank`` for nothing but whitespace."""
    if raw is None or not raw.strip():
        return "blank", None, None
    line = raw[:-1] if raw.endswith("\r") else raw
    if columns is None:
        columns = len(COLUMNS.get(table or "", [])) or 1
    values = strict_fields(line)
    if values is not None and len(values) == columns:
        # a parse at no cost; only the values can be wrong
        bad = invalid_column(table, values)
        return (None, None, values) if bad is None else ("invalid_value", bad, None)
    _, edits, _ = cheapest_parse(line, columns)
    reason = "quoting" if any("quote" in e or "separate" in e for e in edits) else "column_count"
    return reason, ";".join(edits), None


PARSED = "raw_id long, data_type string, reason string, detail string, fields array<string>"


def parse_records(df: DataFrame) -> DataFrame:
    """(raw_id, data_type, reason, detail, fields) of each record of (raw_id, data_type, columns_have, raw_line).

    ``reason`` is null and ``fields`` are the values for records that load;
    else it is ``quoting``, ``column_count`` or ``invalid_value``, whichever
    holds first, ``detail`` has the edits or the column, and ``fields`` is
    null. Records of whitespace, empty and null ones come out as ``blank``:
    neither loaded nor faulty. A null columns_have means the table's own count.
    Nothing is shuffled; records are judged one by one in Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols = [None if pd.isna(c) else int(c) for c in b["columns_have"]]
            got = [judge(t, c, r) for t, c, r in zip(b["data_type"], cols, b["raw_line"])]
            yield pd.DataFrame({"raw_id": b["raw_id"], "data_type": b["data_type"], "reason": [g[0] for g in got], "detail": [g[1] for g in got], "fields": [g[2] for g in got]})

    return df.select("raw_id", "data_type", "columns_have", "raw_line").mapInPandas(run, PARSED)


def faulty(parsed: DataFrame) -> DataFrame:
    """(raw_id, reason, detail) of the records that don't load."""
    return parsed.where(F.col("reason") != "blank").select("raw_id", "reason", "detail")


def loaded(parsed: DataFrame, table: str) -> DataFrame:
    """The valid records of a table as named text columns, outer spaces cut, empty values null."""
    ok = parsed.where(F.col("reason").isNull() & (F.col("data_type") == table))
    return ok.select("raw_id", *[F.nullif(F.trim(F.get("fields", F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(COLUMNS[table])])
