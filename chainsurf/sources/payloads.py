"""Landed payloads to chain rows.

A payload is one JSON text in one of three shapes: ``header.format`` with rows of
values; an object of parallel arrays, where scalars hold for all rows; a list of
objects.  Everything else, and anything empty, gives no rows.  All values are read as
text first, so one bad value never voids its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite_or_null, norm_ticker, normalise_right, parse_ymd
from ..schemas import OHLC, OI, OI_FIELD

#: Columns and the fields of a payload that they come from.
FIELDS = {"expiration": "expiration", "strike": "strike", "right": "right", OI: OI_FIELD, "date": "date"}


def _record(at) -> Column:
    return F.struct(*[at(f).alias(c) for c, f in FIELDS.items()])


def _is_header(members: Column) -> Column:
    return F.map_contains_key(members, "header") & F.map_contains_key(members, "response")


def _header_records(members: Column) -> Column:
    """Shape 1: each non-empty row is zipped with the format, as far as both reach; of a repeated name the last place counts."""
    names = F.coalesce(F.from_json(members["header"], "struct<format:array<string>>")["format"], F.array().cast("array<string>"))
    rows = F.filter(F.from_json(members["response"], "array<array<string>>"), lambda r: F.size(r) > 0)

    def record(row: Column, backwards: Column) -> Column:
        skipped = F.greatest(F.size(backwards) - F.size(row), F.lit(0))  # names beyond the row's end, which stand first here

        def value(f: str) -> Column:
            place = F.array_position(F.slice(backwards, skipped + 1, F.size(backwards)), F.lit(f))
            return F.when(place > 0, F.get(row, (F.size(backwards) - skipped - place).cast("int")))

        return _record(value)

    # the names are turned round once for each payload, not for each row
    return F.flatten(F.transform(F.array(F.reverse(names)), lambda backwards: F.transform(rows, lambda r: record(r, backwards))))


def _columnar_records(members: Column) -> Column:
    """Shape 2: as many rows as the first array has items; a scalar repeats, a short array gives nulls."""
    is_list = lambda v: v.startswith("[")
    first = F.get(F.filter(F.map_values(members), is_list), F.lit(0))
    n = F.size(F.from_json(first, "array<string>"))
    lists = F.struct(*[F.from_json(F.when(is_list(members[f]), members[f]), "array<string>").alias(f) for f in FIELDS.values()])
    at = lambda held, i: _record(lambda f: F.when(is_list(members[f]), F.get(held[f], i)).otherwise(members[f]))
    return F.when(n > 0, F.flatten(F.transform(F.array(lists), lambda held: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(held, i)))))


def _item_records(payload: Column) -> Column:
    """Shape 3: a list of objects; other items are dropped one by one."""
    items = F.filter(F.from_json(payload, "array<string>"), lambda x: F.ltrim(x).startswith("{"))
    found = F.filter(F.transform(items, lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())
    return F.transform(found, lambda m: _record(lambda f: m[f]))


def _rows(df: DataFrame, col: str, shapes: str) -> DataFrame:
    """One pass over the payloads; each is parsed by its own shape alone, an object into its members first."""
    kept = [c for c in df.columns if c != col]
    text = F.ltrim(F.col(col))
    members, payload = F.col("_members"), F.col("_payload")
    held = df.select(*kept, F.when(text.startswith("["), text).alias("_payload"), F.from_json(F.when(text.startswith("{"), text), "map<string,string>").alias("_members"))
    found = {"header": F.when(_is_header(members), _header_records(members)), "columnar": F.when(~_is_header(members), _columnar_records(members)), "records": F.when(payload.isNotNull(), _item_records(payload))}
    return held.select(*kept, F.explode(F.coalesce(*[v for k, v in found.items() if k in shapes])).alias("_record")).select(*kept, "_record.*")


def header_rows(df: DataFrame, col: str = "payload") -> DataFrame:
    """The rows of payloads of shape 1."""
    return _rows(df, col, "header")


def columnar(df: DataFrame, col: str = "payload") -> DataFrame:
    """The rows of payloads of shape 2."""
    return _rows(df, col, "columnar")


def records(df: DataFrame, col: str = "payload") -> DataFrame:
    """The rows of payloads of shape 3."""
    return _rows(df, col, "records")


def normalise_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """Rows of all three shapes, with the text fields ``FIELDS``."""
    return _rows(df, col, "header columnar records")


def clean_chain(df: DataFrame) -> DataFrame:
    """Typed rows; unparsable expirations, unknown rights, missing or zero interest and bad numbers go."""
    typed = df.withColumns(
        {
            "expiration": parse_ymd(F.col("expiration")),
            "option_type": normalise_right(F.col("right")),
            "strike": F.col("strike").try_cast("double"),
            OI: F.col(OI).try_cast("double").try_cast("bigint"),
        }
    )
    return typed.filter(f"expiration IS NOT NULL AND option_type IS NOT NULL AND strike IS NOT NULL AND NOT isnan(strike) AND {OI} <> 0").drop("right")


def stamp_trade_date(df: DataFrame, requested: str | Column, mode: str = "history") -> DataFrame:
    """trade_date: the requested day, for history payloads and snapshots alike.

    A history payload's own date is first resolved (its date, else the requested one)
    into ``payload_date``, then overwritten; a snapshot has no date of its own.
    """
    day = F.col(requested) if isinstance(requested, str) else requested
    out = df.withColumn("trade_date", day.cast("date"))
    if mode == "history" and "date" in df.columns:
        out = out.withColumn("payload_date", F.coalesce(parse_ymd(F.col("date")), day.cast("date")))
    return out.drop("date")


KEYS = ["ticker", "trade_date", "expiration", "strike", "option_type"]


def dedupe_sum(df: DataFrame) -> DataFrame:
    """One row per contract and day (and rank, where rows have one): interest of repeated rows is summed."""
    return df.groupBy(*KEYS, *[c for c in ("rank",) if c in df.columns]).agg(F.sum(OI).alias(OI))


def dup_report(df: DataFrame) -> DataFrame:
    """(ticker, trade_date, n_raw, n_distinct, n_dropped) per day."""
    per_key = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.groupBy("ticker", "trade_date").agg(F.sum("n").alias("n_raw"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("n_dropped", F.col("n_raw") - F.col("n_distinct"))


def ingest_history(payloads: DataFrame) -> DataFrame:
    """Landed (ticker, requested_date, payload) to chain rows."""
    rows = clean_chain(normalise_payload(payloads)).withColumn("ticker", norm_ticker(F.col("ticker")))
    return dedupe_sum(stamp_trade_date(rows, "requested_date"))


def ingest_snapshot(payloads: DataFrame, calendar: DataFrame) -> DataFrame:
    """Landed (ticker, taken_on, payload) to chain rows of the last trading day on or before."""
    from ..operators.calendar import last_trading_day

    rows = clean_chain(normalise_payload(payloads)).withColumn("ticker", norm_ticker(F.col("ticker")))
    days = last_trading_day(rows.select("taken_on").distinct(), calendar, "taken_on")
    return dedupe_sum(stamp_trade_date(rows.join(days, "taken_on"), "last_trading_day", "snapshot"))


def normalise_ohlc(df: DataFrame) -> DataFrame:
    """Price rows: timestamps to dates, non-finite measures to null, volume to a whole number."""
    measures = ["open", "high", "low", "close", "adj_close", "dividends", "splits"]
    out = df.withColumns({m: finite_or_null(F.col(m).cast("double")) for m in measures})
    out = out.withColumn("volume", finite_or_null(F.col("volume").cast("double")).cast("bigint"))
    return out.withColumns({"ticker": norm_ticker(F.col("ticker")), "trade_date": F.col("trade_date").cast("date")}).select(*OHLC.names)
