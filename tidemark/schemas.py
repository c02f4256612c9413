"""The declared tables: schema, key and required columns. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _D, _F, _I = T.StringType(), T.DateType(), T.DoubleType(), T.IntegerType()

SCHEMAS: dict[str, T.StructType] = {
    "quotes": _schema(date=_D, ticker=_S, open=_F, high=_F, low=_F, close=_F, volume_shares=_F, volume_value=_F),
    "reference": _schema(ticker=_S, name=_S, sector=_S, first_seen=_D, last_seen=_D),
    "dividends": _schema(ticker=_S, ex_date=_D, amount=_F, fiscal_year=_I),
    "fundamentals": _schema(ticker=_S, date=_D, indicator=_S, value=_F),
    "external": _schema(date=_D, series=_S, value=_F),
    "ingest_log": _schema(at=T.TimestampType(), source=_S, rows=T.LongType(), message=_S),
}
#: Primary keys; the log has none and only grows.
KEYS: dict[str, tuple[str, ...]] = {
    "quotes": ("date", "ticker"), "reference": ("ticker",), "dividends": ("ticker", "ex_date"),
    "fundamentals": ("ticker", "date", "indicator"), "external": ("date", "series"), "ingest_log": (),
}
REQUIRED: dict[str, tuple[str, ...]] = {
    "quotes": ("date", "ticker", "close"), "reference": ("ticker", "name"), "dividends": ("ticker", "ex_date", "amount"),
    "fundamentals": ("ticker", "date", "indicator"), "external": ("date", "series"), "ingest_log": (),
}
#: Columns rounded to two decimals when written.
ROUNDED = {"quotes": ("open", "high", "low", "close", "volume_shares", "volume_value")}


def schema(table: str) -> T.StructType:
    if table not in SCHEMAS:
        raise ValueError(f"undeclared table: {table}")
    return SCHEMAS[table]
