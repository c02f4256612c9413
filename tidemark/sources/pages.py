"""Rows out of landed pages and payloads: HTML tables, link lists, quote histories.

Pages arrive as a table (page_id, html, ...); the only Python is the reading of ``<table>`` elements, page
by page in tasks and piece by piece of a page. All that follows (recognising columns, numbers, dates, choosing) is DataFrame code.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.operators.quality import valued
from tidemark.operators.settle import settled

TABLES = "page_id long, table_no int, row_no int, header array<string>, cells array<string>"
LINKS = "page_id long, row_no int, text string, hrefs array<string>"
#: Names under which sources publish a column; specific names come before general ones.
QUOTE_ALIASES = {
    "ticker": ["symbole", "code", "ticker"], "name": ["nom", "titre", "valeur", "societe"], "volume_shares": ["volume titres", "quantite", "volume"],
    "volume_value": ["valeur echangee", "volume fcfa", "montant"], "previous": ["cours veille", "precedent"], "open": ["ouverture"],
    "high": ["plus haut", "haut"], "low": ["plus bas", "bas"], "close": ["cloture", "dernier", "cours"], "announced": ["variation", "var"],
}
DIVIDEND_ALIASES = {
    "ex_date": ["detachement", "ex date"], "pay_date": ["paiement"], "ticker": ["symbole", "code"], "name": ["societe", "nom", "valeur"],
    "amount": ["montant", "dividende", "net"], "fiscal_year": ["exercice", "annee"], "yield": ["rendement", "rdt"],
}
HISTORY_ALIASES = {"date": ["date", "seance"], "open": ["ouverture", "open"], "high": ["plus haut", "high"], "low": ["plus bas", "low"], "close": ["cloture", "dernier", "close"], "volume": ["volume", "quantite"]}


class _Rows(HTMLParser):
    """Rows of every table of a page, in the order in which they end; a nested table's rows belong to itself.

    Only the open row and the headers of the open tables are held; the reader takes ``done`` after each piece.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, int, list[str], list[str], list[str]]] = []  # table, row (0: the header), header, cells, links
        self.tables = 0
        self.open: list[list] = []  # of each open table: number, rows so far, header
        self.row: list[list[str]] | None = None
        self.links: list[str] = []

    def end_row(self) -> None:
        if self.row is not None and self.open:
            table = self.open[-1]
            cells = [" ".join("".join(c).split()) for c in self.row]
            if not table[1]:
                table[2] = cells
            self.done.append((table[0], table[1], table[2], cells, self.links))
            table[1] += 1
        self.row, self.links = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.end_row()
            self.open.append([self.tables, 0, []])
            self.tables += 1
        elif tag == "tr" and self.open:
            self.end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append([])
        elif tag == "a" and self.row is not None and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("tr", "table"):
            self.end_row()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.row:
            self.row[-1].append(data)


def rows_of(html: str, piece: int = 1 << 16) -> Iterator[tuple[int, int, list[str], list[str], list[str]]]:
    """The rows of a page, read piece by piece: beside the page only a piece and its rows are held.

    A piece is as long as what the parser could not finish, so a page that never closes a tag is still read in linear time.
    """
    parser, at = _Rows(), 0
    while at < len(html):
        step = max(piece, len(parser.rawdata))
        parser.feed(html[at : at + step])
        at += step
        yield from parser.done
        parser.done = []
    parser.close()
    parser.end_row()
    yield from parser.done


def page_by_page(pages: DataFrame, read: Callable[[str], Iterator[tuple]], kinds: dict[str, pa.DataType], schema: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """The rows that ``read`` gives for each page (null: empty), after its ``page_id``, in batches of about ``batch_bytes``.

    One page at a time leaves its Arrow batch, and its rows go on as they come, so a task holds one page and one batch of rows.
    Pages are dealt to tasks anew: a file of small rows has few row groups, and reading a page takes far longer than moving it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.schema(list(kinds.items()))
        held, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held, strict=True), wanted.types, strict=True)], schema=wanted)
        for batch in batches:
            for page, html in zip(batch.column(0), batch.column(1), strict=True):
                for row in read(html.as_py() or ""):
                    held.append((page.as_py(), *row))
                    size += 64 + sum(len(v) + 8 for x in row if not isinstance(x, int) for v in ([x] if isinstance(x, str) else x))
                    if size >= batch_bytes:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).hint("rebalance").mapInArrow(run, schema)


def html_tables(pages: DataFrame) -> DataFrame:
    """Rows of all tables as text. The first row is the header; rows of another width are dropped, and
    tables without further rows are ignored."""

    def read(html: str) -> Iterator[tuple]:
        return ((t, r - 1, header, cells) for t, r, header, cells, _ in rows_of(html) if r and len(cells) == len(header))

    texts = pa.list_(pa.string())
    return page_by_page(pages, read, {"page_id": pa.int64(), "table_no": pa.int32(), "row_no": pa.int32(), "header": texts, "cells": texts}, TABLES)


def linked_rows(pages: DataFrame, least_cells: int = 4, cut: int = 110) -> DataFrame:
    """Table rows that carry links and have enough filled cells, as one text; rows are numbered through the page, table after table."""

    def read(html: str) -> Iterator[tuple]:
        kept, sizes = [], Counter()
        for t, r, _, cells, links in rows_of(html):
            sizes[t] += 1
            filled = [c for c in cells if c]
            if links and len(filled) >= least_cells:
                kept.append((t, r, " ".join(filled)[:cut], links))
        before = dict(zip(sorted(sizes), accumulate((sizes[t] for t in sorted(sizes)), initial=0), strict=False))
        return ((before[t] + r, text, links) for t, r, text, links in sorted(kept, key=lambda row: row[:2]))

    return page_by_page(pages, read, {"page_id": pa.int64(), "row_no": pa.int32(), "text": pa.string(), "hrefs": pa.list_(pa.string())}, LINKS)


def recognised(header: list[str], aliases: dict[str, list[str]]) -> list[int | None]:
    """For each name the first free column that equals, or else contains, one of its aliases."""
    used: set[int] = set()
    out: list[int | None] = []
    for known in aliases.values():
        tests = [lambda h, a=a: h == a for a in known] + [lambda h, a=a: a in h for a in known]
        found = next((i for test in tests for i, h in enumerate(header) if i not in used and test(h)), None)
        out.append(found)
        if found is not None:
            used.add(found)
    return out


def recognise(tables: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Adds ``at_<name>``: the column (from 0) recognised for each name, or null.

    Names are served in order and each column once; headers are compared after normalisation.
    """

    @F.pandas_udf("array<int>")
    def positions(headers: pd.Series) -> pd.Series:
        return pd.Series([recognised(list(h), aliases) for h in headers])

    each = tables.select("page_id", "table_no", "header").dropDuplicates(["page_id", "table_no"]).withColumn("_at", positions(F.transform("header", tx.normalised)))
    out = tables.join(each.select("page_id", "table_no", "_at"), ["page_id", "table_no"])
    return out.select(*tables.columns, *[F.get("_at", F.lit(i)).alias(f"at_{name}") for i, name in enumerate(aliases)])


def cell(name: str) -> Column:
    return F.when(F.col(f"at_{name}").isNotNull(), F.get("cells", F.col(f"at_{name}")))


def best_table(tables: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...]) -> DataFrame:
    """Rows of each page's table with the most recognised columns, of those that have the required ones."""
    rows = recognise(tables, aliases)
    for name in required:
        rows = rows.filter(F.col(f"at_{name}").isNotNull())
    matched = sum((F.col(f"at_{name}").isNotNull().cast("int") for name in aliases), F.lit(0))
    rows = rows.withColumn("_matched", matched)
    order = Window.partitionBy("page_id").orderBy(F.desc("_matched"), "table_no")
    best = rows.select("page_id", "table_no", "_matched").distinct().withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("page_id", "table_no")
    return rows.drop("_matched").join(best, ["page_id", "table_no"])


def session_quotes(tables: DataFrame, date: Column, order: str = "page_id") -> DataFrame:
    """Quotes of a session out of its pages: known tickers, positive closes, one row each (the first page's)."""
    rows = best_table(tables, QUOTE_ALIASES, ("ticker", "close"))
    numbers = {c: tx.number(cell(c)) for c in QUOTE_ALIASES if c not in ("ticker", "name")}
    rows = rows.select("page_id", "row_no", date.alias("date"), tx.ticker(cell("ticker")).alias("ticker"), *[v.alias(c) for c, v in numbers.items()])
    rows = rows.filter(tx.is_ticker(F.col("ticker")) & (F.col("close") > 0)).withColumn("volume_value", F.coalesce("volume_value", F.col("volume_shares") * F.col("close")))
    first = F.row_number().over(Window.partitionBy("date", "ticker").orderBy(order, "row_no"))
    return rows.withColumn("_r", first).filter("_r = 1").drop("_r", "page_id", "row_no")


def companies(tables: DataFrame) -> DataFrame:
    """(ticker, name, sector) of the company list; sector null where the list has none."""
    rows = best_table(tables, {**QUOTE_ALIASES, "sector": ["secteur", "sector"]}, ("ticker", "name"))
    rows = rows.select("page_id", "row_no", tx.ticker(cell("ticker")).alias("ticker"), tx.squeezed(cell("name")).alias("name"), tx.squeezed(cell("sector")).alias("sector"))
    rows = rows.filter(tx.is_ticker(F.col("ticker")) & (F.col("name") != ""))
    return rows.groupBy("ticker").agg(F.min_by("name", F.struct("page_id", "row_no")).alias("name"), F.min_by("sector", F.struct("page_id", "row_no")).alias("sector"))


def company_list(published: DataFrame, seed: DataFrame) -> DataFrame:
    """The published list, or the seed where that is empty."""
    return seed if published.isEmpty() else published


def sectors(pages: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sector of each ticker from per-sector pages, and the pages whose own title is another sector.

    ``pages`` is (page_id, expected, title); ``quotes`` is (page_id, ticker). The first page of a ticker counts.
    """
    right = tx.normalised(F.col("title")) == tx.normalised(F.col("expected"))
    good = quotes.join(pages.filter(right), "page_id").groupBy("ticker").agg(F.min_by("expected", "page_id").alias("sector"))
    return good, pages.filter(~F.coalesce(right, F.lit(False)))


def dividend_calendar(tables: DataFrame) -> DataFrame:
    """(page_id, ex_date, pay_date, ticker, name, amount, fiscal_year, yield) of rows with a date, an amount and a company."""
    rows = recognise(tables, DIVIDEND_ALIASES).select(
        "page_id", tx.day(cell("ex_date")).alias("ex_date"), tx.day(cell("pay_date")).alias("pay_date"), tx.ticker(cell("ticker")).alias("ticker"), tx.squeezed(cell("name")).alias("name"),
        tx.number(cell("amount")).alias("amount"), tx.fiscal_year(cell("fiscal_year")).alias("fiscal_year"), tx.number(cell("yield")).alias("yield"),
    )
    return rows.filter("ex_date is not null and amount is not null and (ticker is not null or name is not null)")


def yearly_history(tables: DataFrame) -> DataFrame:
    """A wide table ("Div. 2022", "Rend. 2022", ...) as (name, date, indicator, value); a dash is no value."""
    each = tables.select("page_id", F.get("cells", F.lit(0)).alias("name"), F.posexplode(F.arrays_zip("header", "cells")).alias("_at", "_c")).filter("_at > 0")
    head = tx.normalised(F.col("_c.header"))
    year = F.regexp_extract(head, "((?:19|20)[0-9]{2})", 1)
    kind = F.when(head.startswith("div"), "dividend").when(head.startswith("rend") | head.startswith("rdt"), "yield")
    rows = each.select("name", F.when(year != "", F.make_date(year.try_cast("int"), F.lit(12), F.lit(31))).alias("date"), kind.alias("indicator"), tx.number(F.col("_c.cells")).alias("value"))
    return rows.filter("date is not null and indicator is not null and value is not null")


def session_fundamentals(tables: DataFrame, date: Column) -> DataFrame:
    """(ticker, date, indicator, value) of a session's table; separator rows are skipped."""
    aliases = {"ticker": ["symbole", "code"], "dividend": ["dividende net", "dividende"], "yield": ["rendement net", "rendement"], "per": ["per"]}
    rows = best_table(tables, aliases, ("ticker",)).select(tx.ticker(cell("ticker")).alias("ticker"), date.alias("date"), *[tx.number(cell(c)).alias(c) for c in ("dividend", "yield", "per")])
    long = rows.filter(~F.col("ticker").startswith("SECTEUR")).unpivot(["ticker", "date"], ["dividend", "yield", "per"], "indicator", "value")
    return long.filter("value is not null").select("ticker", "date", "indicator", "value")


def page_fingerprints(tables: DataFrame) -> DataFrame:
    """(page_id, fingerprint): first 16 hex digits of the digest of a page's sorted cells."""
    cells = tables.groupBy("page_id").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    return cells.select("page_id", F.substring(F.sha2(F.concat_ws("\n", F.array_sort("cells")), 256), 1, 16).alias("fingerprint"))


def before_repetition(fingerprints: DataFrame) -> DataFrame:
    """Pages in order up to the first whose fingerprint came before."""
    seen = fingerprints.withColumn("_first", F.min("page_id").over(Window.partitionBy("fingerprint")))
    cut = seen.filter("page_id > _first").agg(F.min("page_id").alias("_cut"))
    return seen.crossJoin(F.broadcast(cut)).filter("_cut is null or page_id < _cut").select("page_id", "fingerprint")


def before_nothing_new(quotes: DataFrame) -> DataFrame:
    """Rows (page_no, ticker, ...) up to the first page that brings no new ticker."""
    first = quotes.withColumn("_first", F.min("page_no").over(Window.partitionBy("ticker")))
    new = first.groupBy("page_no").agg(F.count_if(F.col("page_no") == F.col("_first")).alias("_new")).filter("_new = 0").agg(F.min("page_no").alias("_cut"))
    return first.crossJoin(F.broadcast(new)).filter("page_no = _first and (_cut is null or page_no < _cut)").drop("_first", "_cut")


def header_years(tables: DataFrame) -> DataFrame:
    years = F.regexp_extract_all(F.concat_ws(" ", "header"), F.lit("((?:19|20)[0-9]{2})"), F.lit(1))
    return tables.select("page_id", F.explode(years).alias("year")).groupBy("page_id").agg(F.sort_array(F.collect_set("year")).alias("years"))


def symbols(menus: DataFrame, default: str, index_prefixes: Sequence[str]) -> DataFrame:
    """(ticker, country, symbol) out of menu texts such as "ABC.ci"; entries of an index and entries without a dot are skipped.

    A ticker listed more than once has its last entry: by ``page_id`` where there is one, then by place in the menu. A null menu
    is refused, and one without any share.
    """
    refuse = lambda text: F.raise_error(F.lit(text)).cast("array<string>")
    found = F.when(F.col("menu").isNull(), refuse("no menu of symbols on the page")).otherwise(F.regexp_extract_all("menu", F.lit("([A-Za-z0-9]+\\.[A-Za-z]{2})\\b"), F.lit(1)))
    index = lambda s: F.exists(F.array(*[F.lit(p.upper()) for p in index_prefixes]), lambda p: F.startswith(F.upper(s), p))
    page = F.col("page_id") if "page_id" in menus.columns else F.lit(0)
    rows = menus.select(page.alias("_page"), F.filter(found, lambda s: ~index(s)).alias("_shares"))
    rows = rows.select("_page", F.posexplode(F.when(F.size("_shares") > 0, F.col("_shares")).otherwise(refuse("no share in the menu of symbols"))).alias("_at", "_entry"))
    rows = rows.select("_page", "_at", F.upper(F.substring_index("_entry", ".", 1)).alias("ticker"), F.lower(F.substring_index("_entry", ".", -1)).alias("country"))
    last = rows.groupBy("ticker").agg(F.max_by("country", F.struct("_page", "_at")).alias("country"))
    return last.withColumn("symbol", F.concat("ticker", F.lit("."), F.coalesce("country", F.lit(default))))


def with_symbol(tickers: DataFrame, known: DataFrame, default: str) -> DataFrame:
    return tickers.join(known.select("ticker", "country"), "ticker", "left").withColumn("symbol", F.concat("ticker", F.lit("."), F.coalesce("country", F.lit(default)))).drop("country")


def tranches(ranges: DataFrame, days: int = 89) -> DataFrame:
    """Each (start, end) range in disjoint tranches of at most ``days`` days; a reversed range is refused."""
    start = F.when(F.col("start") <= F.col("end"), F.col("start")).otherwise(F.raise_error(F.lit("reversed range")).cast("date"))
    steps = F.explode(F.sequence(start, F.col("end"), F.expr(f"interval {days} days")))
    rows = ranges.withColumn("from", steps)
    return rows.withColumn("to", F.least(F.date_add("from", days - 1), "end")).drop("start", "end")


def history_payload(payloads: DataFrame) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) out of JSON ``{"lst": [...]}`` payloads of (ticker, payload).

    Fields are recognised by their normalised names. A payload whose entries have no date or no close field is refused;
    entries without a readable date or close are left out.
    """
    entries = F.from_json("payload", "lst array<map<string, string>>")["lst"]
    lists = payloads.select("ticker", entries.alias("lst"))
    has = lambda field: F.exists("lst", lambda e: F.arrays_overlap(F.transform(F.map_keys(e), lambda k: F.lower(k)), F.array(*[F.lit(a) for a in HISTORY_ALIASES[field]])))
    refused = F.raise_error(F.concat(F.lit("no date or close field in the history of "), F.coalesce("ticker", F.lit("?")))).cast("array<map<string,string>>")
    checked = F.when((F.size("lst") > 0) & ~(has("date") & has("close")), refused).otherwise(F.col("lst"))
    rows = lists.select("ticker", F.explode(checked).alias("_e")).withColumn("_e", F.transform_keys("_e", lambda k, v: F.lower(k)))
    field = lambda name: F.coalesce(*[F.try_element_at("_e", F.lit(a)) for a in HISTORY_ALIASES[name]])
    rows = rows.select("ticker", tx.day(field("date")).alias("date"), *[tx.number(field(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    return rows.filter("date is not null and close is not null")


def history_tables(tables: DataFrame, ticker: Column, expected: DataFrame | None = None) -> DataFrame:
    """The same rows out of the first table of a page that has a date and a close.

    A page of ``expected`` (page_id), by default of ``tables``, that has no such table is refused: no rows would look like no trade.
    """
    tables = settled(tables, "tables")  # pages are read once
    known = recognise(tables, HISTORY_ALIASES).filter("at_date is not null and at_close is not null")
    rows = known.withColumn("_first", F.min("table_no").over(Window.partitionBy("page_id"))).filter("table_no = _first")
    out = rows.select(ticker.alias("ticker"), tx.day(cell("date")).alias("date"), *[tx.number(cell(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    out = out.filter("date is not null and close is not null")
    lacking = (tables if expected is None else expected).select("page_id").distinct().join(known.select("page_id").distinct(), "page_id", "left_anti")
    refused = F.raise_error(F.concat(F.lit("no table with a date and a close on page "), F.col("page_id").cast("string")))
    return out.unionByName(lacking.select(*[refused.cast(f.dataType).alias(f.name) for f in out.schema]))


def retained(history: DataFrame, volume: str = "volume_shares") -> DataFrame:
    """Writable columns only: the general volume becomes shares or value, and a missing value is rebuilt."""
    out = history.withColumn(volume, F.col("volume"))
    for c in ("volume_shares", "volume_value"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return valued(out).select("date", "ticker", "open", "high", "low", "close", "volume_shares", "volume_value")
