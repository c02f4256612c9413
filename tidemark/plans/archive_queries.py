"""Queries over the archive, over pages of other kinds, and over gates that refuse input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import backtest, dividends, exogenous, learn, names, panel, quality, snapshot
from tidemark.operators.dedupe import union_by_priority
from tidemark.operators.settle import shared_folder
from tidemark.plans.fixtures import BACKTEST, EXTERNAL, FEATURES, LEARNING, RANKS, cte, load
from tidemark.plans.page_queries import CODE_SQL, french, page_date, quote_pages, table_page
from tidemark.plans.queries import FILLED, JOURNAL, SAMPLE, TRAIL, journal_of, mapping_of, panel_of, query, quotes_of, reversion_sql
from tidemark.sources import archive, pages

FUNDAMENTALS = f"WITH {cte('dividends', 'fundamentals')}, one AS (SELECT ticker, date, indicator, max(value) AS value FROM fundamentals GROUP BY 1, 2, 3)"


def fundamentals_of(spark, d):
    return load(spark, d, "fundamentals").groupBy("ticker", "date", "indicator").agg(F.max("value").alias("value"))


def exported(spark, d):
    """The fundamentals as a CSV archive in the shared folder, and the number of rows written."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    return path, archive.export_csv(fundamentals_of(spark, d), "fundamentals", path)


# -- archive ------------------------------------------------------------------------------------------------------------
@query(f"{FUNDAMENTALS} SELECT ticker, CAST(date AS VARCHAR) AS date, indicator, round(value, 6) AS value, (SELECT count(*) FROM one) AS written FROM one")
def archive_round_trip(spark, d):
    path, written = exported(spark, d)
    return archive.read_csv(spark, "fundamentals", path).withColumn("written", F.lit(written).cast("long"))


@query(f"{FUNDAMENTALS} SELECT ticker, CAST(date AS VARCHAR) AS date, indicator, round(value, 6) AS value FROM one")
def absent_archive(spark, d):
    """An archive that is not there counts as empty and changes nothing."""
    return archive.import_csv(archive.conform(fundamentals_of(spark, d), "fundamentals"), "fundamentals", f"{d}/there-is-no-such-archive")


@query(f"{FUNDAMENTALS} SELECT ticker, CAST(date AS VARCHAR) AS date, indicator, round(value, 6) AS value FROM one UNION ALL SELECT concat('X', ticker), CAST(date AS VARCHAR), indicator, -1 FROM one WHERE year(date) % 2 = 1")
def imported_archive(spark, d):
    """The archive replaces rows of its keys and leaves the others."""
    path, _ = exported(spark, d)
    known = fundamentals_of(spark, d).filter("year(date) % 2 = 1").withColumn("value", F.lit(-1.0))
    others = known.withColumn("ticker", F.concat(F.lit("X"), "ticker"))
    return archive.import_csv(archive.conform(known.unionByName(others), "fundamentals"), "fundamentals", path)


@query(f"WITH {cte('quotes')} SELECT valid, count(*) AS rows FROM (SELECT volume_shares >= 100 AS valid FROM quotes) GROUP BY 1")
def rejected_rows(spark, d):
    """Rows without a close violate the table's constraints."""
    rows = quotes_of(spark, d).withColumn("close", F.when(F.col("volume_shares") >= 100, F.col("close")))
    good, bad = archive.split_valid(archive.conform(rows, "quotes"), "quotes")
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.groupBy("valid").agg(F.count("*").alias("rows"))


@query("SELECT o_orderstatus AS serie, count(*) AS rows, count(*) FILTER (o_orderkey % 5 <> 0) AS numbers, round(sum(o_totalprice) FILTER (o_orderkey % 5 <> 0), 1) AS total FROM orders GROUP BY 1", digits=1)
def external_csv(spark, d):
    """A CSV read as text whose numbers are cast where they can be."""
    path = f"{shared_folder(spark)}/external-{uuid.uuid4().hex}"
    value = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    archive.export_rows(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("serie"), value.alias("valeur")), path)
    rows = archive.read_text_csv(spark, path, ("serie", "valeur"), ("valeur",))
    return rows.groupBy("serie").agg(F.count("*").alias("rows"), F.count("valeur").alias("numbers"), F.sum("valeur").alias("total"))


@query(f"WITH {cte('quotes')} SELECT ticker AS source, count(*) AS rows, concat('ingested ', ticker, repeat('.', 491 - length(ticker))) AS message FROM quotes GROUP BY 1")
def ingest_log(spark, d):
    """One row for each source; messages are cut at 500 characters."""
    runs = archive.log_by_source(quotes_of(spark, d), "ticker", "2024-01-02 18:00:00", "." * 600)
    named = runs.withColumn("message", F.substring(F.concat(F.lit("ingested "), "source", "message"), 1, 500))
    return archive.upsert(archive.empty(spark, "ingest_log"), named, "ingest_log").select("source", "rows", "message")


@query(f"WITH {cte('quotes')}, m AS (SELECT max(date) AS m FROM quotes) SELECT CAST(date AS VARCHAR) AS date, ticker, CASE WHEN date = m THEN floor(close) * 2 ELSE floor(close) END AS close FROM quotes, m UNION ALL SELECT CAST(m + 1 AS VARCHAR), ticker, floor(close) * 2 FROM quotes, m WHERE date = m", digits=2)
def live_overlay(spark, d):
    """A live session over the archive: its rows win, and nothing is written."""
    known = quotes_of(spark, d).select("date", "ticker", F.floor("close").cast("double").alias("close"))
    last = known.join(F.broadcast(known.agg(F.max("date").alias("date"))), "date").withColumn("close", F.col("close") * 2)
    live = last.unionByName(last.withColumn("date", F.date_add("date", 1))).withColumn("_n", F.lit(1))
    return archive.upsert(archive.conform(known, "quotes"), live, "quotes", "_n").select("date", "ticker", "close")


@query(f"WITH {cte('quotes')} SELECT CAST(date AS VARCHAR) AS date, ticker, round(CASE WHEN volume_shares > 200 THEN high ELSE low END, 6) AS close FROM quotes")
def union_last_source(spark, d):
    first = quotes_of(spark, d).select("date", "ticker", F.col("low").alias("close"))
    second = quotes_of(spark, d).filter("volume_shares > 200").select("date", "ticker", F.col("high").alias("close"))
    return union_by_priority([first, second], ("date", "ticker"), "last")


# -- pages --------------------------------------------------------------------------------------------------------------
def sector_pages(spark, d):
    """A page for each sector, and one under a wrong title."""
    known = load(spark, d, "reference").withColumn("page_id", F.substring("sector", 2, 1).cast("long"))
    right = known.select("page_id", F.col("sector").alias("expected"), F.concat(F.lit("  "), F.lower("sector"), F.lit(" !")).alias("title")).distinct()
    wrong = right.select((F.col("page_id") + 100).alias("page_id"), F.concat("expected", F.lit(" bis")).alias("expected"), "title")
    quotes = known.select("page_id", "ticker").union(known.select(F.col("page_id") + 100, "ticker"))
    return pages.sectors(right.union(wrong), quotes)


@query(f"WITH {cte('reference')} SELECT ticker, sector FROM reference")
def sectors_from_pages(spark, d):
    return sector_pages(spark, d)[0]


@query(f"WITH {cte('reference')} SELECT DISTINCT CAST(substr(sector, 2, 1) AS BIGINT) + 100 AS page_id, concat(sector, ' bis') AS expected FROM reference")
def pages_of_wrong_sector(spark, d):
    return sector_pages(spark, d)[1].select("page_id", "expected")


@query(f"WITH {cte('reference')} SELECT ticker, name FROM reference")
def company_list_or_seed(spark, d):
    """An empty published list gives way to the seed."""
    known = load(spark, d, "reference").select("ticker", "name")
    return pages.company_list(known.filter("false"), known)


@query(f"""WITH {cte("quotes")} SELECT {CODE_SQL} AS ticker, CAST(date AS VARCHAR) AS date, indicator, round(value, 2) AS value FROM
(SELECT ticker, date, unnest(['dividend', 'yield', 'per']) AS indicator, unnest([low, high, CASE WHEN volume_shares > 200 THEN volume_shares END]) AS value FROM quotes) WHERE value IS NOT NULL""", digits=2)
def fundamentals_from_pages(spark, d):
    """Net dividend, yield and price-earnings ratio of a session's table; separator rows are skipped."""
    rows = quotes_of(spark, d).withColumn("page", F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long"))
    per = F.when(F.col("volume_shares") > 200, F.format_string("%.0f", "volume_shares")).otherwise("-")
    cells = [F.expr(CODE_SQL), french(F.col("low")), french(F.col("high")), per]
    separators = rows.select("page").distinct().select(F.lit("SECTEUR - X").alias("t"), "page")
    body = rows.select("page", F.col("ticker").alias("t"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    both = body.unionByName(separators.select("page", "t", F.col("t").alias("c0"), *[F.lit("1").alias(f"c{i}") for i in (1, 2, 3)]))
    page = table_page(both, "page", ["Symbole", "Dividende net", "Rendement net", "PER"], [F.col(f"c{i}") for i in range(4)], F.col("t"))
    return pages.session_fundamentals(pages.html_tables(page), page_date())


@query(f"""WITH {cte("quotes")}, p AS (SELECT datediff('day', DATE '1990-01-01', date) AS page_id, {CODE_SQL} AS c, ticker, low, high, volume_shares FROM quotes),
g AS (SELECT page_id, count(*) AS rows FROM p GROUP BY 1) SELECT CAST(page_id AS BIGINT) AS page_id, rows FROM g WHERE page_id <= (SELECT min(page_id) + 7 * 40 FROM g)""")
def pages_before_repetition(spark, d):
    """Paging ends where a page shows what an earlier one showed: here all pages after forty weeks show the first."""
    shown = quote_pages(spark, d)
    first = shown.agg(F.min("page_id").alias("_m"), F.min_by("html", "page_id").alias("_h"))
    late = F.col("page_id") > F.col("_m") + 7 * 40
    told = shown.crossJoin(F.broadcast(first)).select("page_id", F.when(late, F.col("_h")).otherwise(F.col("html")).alias("html"))
    tables = pages.html_tables(told)
    kept = pages.before_repetition(pages.page_fingerprints(tables))
    return tables.join(kept, "page_id").groupBy("page_id").agg(F.count("*").alias("rows"))


@query(f"""WITH {cte("quotes")}, c AS (SELECT date, unnest([{CODE_SQL}, concat('Company ', ticker)]) AS cell FROM quotes),
j AS (SELECT date, string_agg(cell, chr(10) ORDER BY cell) AS t FROM c GROUP BY 1) SELECT CAST(datediff('day', DATE '1990-01-01', date) AS BIGINT) AS page_id, substr(sha256(t), 1, 16) AS fingerprint FROM j""")
def page_fingerprints(spark, d):
    rows = quotes_of(spark, d).withColumn("page", F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long"))
    page = table_page(rows, "page", ["Symbole", "Nom"], [F.expr(CODE_SQL), F.concat(F.lit("Company "), "ticker")], F.col("ticker"))
    return pages.page_fingerprints(pages.html_tables(page))


@query(f"WITH {cte('dividends')} SELECT CAST(fiscal_year AS BIGINT) AS page_id, concat(CAST(fiscal_year AS VARCHAR), ',', CAST(fiscal_year + 1 AS VARCHAR)) AS years FROM (SELECT DISTINCT fiscal_year FROM dividends)")
def years_in_headers(spark, d):
    rows = load(spark, d, "dividends")
    parts = []
    for year in [r[0] for r in rows.select("fiscal_year").distinct().collect()]:  # one table kind for each year
        own = rows.filter(F.col("fiscal_year") == year).withColumn("page", F.col("fiscal_year").cast("long"))
        parts.append(table_page(own, "page", ["Société", f"Div. {year}", f"Rend. {year + 1}"], [F.col("ticker"), french(F.col("amount")), F.lit("-")], F.col("ticker")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return pages.header_years(pages.html_tables(every)).select("page_id", F.array_join("years", ",").alias("years"))


@query("SELECT p_partkey AS page_id, substr(concat('notice ', p_name, ' ', repeat('long ', 30), ' ', p_type, ' open'), 1, 110) AS text, concat('/n/', CAST(p_partkey AS VARCHAR)) AS href FROM part".replace("repeat('long ', 30), ' ', ", "rtrim(repeat('long ', 30)), ' ', "))
def notices_with_links(spark, d):
    """Rows with a link and at least four filled cells, cut at 110 characters; shorter rows are no notices."""
    key = F.col("p_partkey").cast("string")
    row = F.concat(F.lit("<tr><td>notice</td><td>"), "p_name", F.lit("</td><td>" + ("long " * 30).strip() + "</td><td>"), "p_type", F.lit("</td><td><a href='/n/"), key, F.lit("'>open</a></td></tr>"))
    short = F.lit("<tr><td>menu</td><td></td><td><a href='/m'>entry</a></td></tr>")
    html = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<table>"), row, short, F.lit("</table>")).alias("html"))
    return pages.linked_rows(html).select("page_id", "text", F.array_join("hrefs", ",").alias("href"))


@query(f"WITH {cte('reference')} SELECT {CODE_SQL} AS ticker, concat({CODE_SQL}, CASE WHEN sector IN ('S1', 'S2') THEN '.sn' ELSE '.ci' END) AS symbol FROM reference")
def ticker_symbols(spark, d):
    """Country suffixes from a menu, the default for tickers that it does not list; indices are skipped, a ticker's last entry counts."""
    known = load(spark, d, "reference").withColumn("ticker", F.expr(CODE_SQL))
    entry = F.concat(F.lit("INDEX"), F.substring("sector", 2, 1), F.lit(".ci | HOUSE"), F.substring("sector", 2, 1), F.lit(".ml | "), "ticker", F.lit(".bj | "), "ticker", F.lit(".SN | no entry"))
    menu = known.filter("sector in ('S1', 'S2')").select(entry.alias("menu"))
    return pages.with_symbol(known.select("ticker"), pages.symbols(menu, "ci", ("index", "house")), "ci").select("ticker", "symbol")


@query(f"""WITH {cte("quotes")} SELECT CAST(date AS VARCHAR) AS date, ticker, round(volume_shares, 4) AS volume_shares, round(volume_shares * (low + high) / 2, 4) AS volume_value FROM quotes""", digits=4)
def retained_history(spark, d):
    rows = quotes_of(spark, d).select("date", "ticker", F.lit(None).cast("double").alias("open"), "high", "low", "close", F.col("volume_shares").alias("volume"), F.lit("x").alias("other"))
    return pages.retained(rows).select("date", "ticker", "volume_shares", "volume_value")


@query(f"""WITH {cte("quotes")} SELECT CAST(date AS VARCHAR) AS date, {CODE_SQL} AS ticker, round(high, 2) AS high, round(low, 2) AS low, round(low, 2) AS close, round(volume_shares, 2) AS volume FROM quotes""", digits=2)
def history_from_tables(spark, d):
    """The first table of a page with a date and a close, where the payload is gone."""
    rows = quotes_of(spark, d).withColumn("page", F.year("date") * 100 + F.substring("ticker", 7, 2).cast("long"))
    cells = [F.date_format("date", "dd/MM/yyyy"), french(F.col("low")), french(F.col("high")), french(F.col("low")), F.format_string("%.0f", "volume_shares"), F.expr(CODE_SQL)]
    body = table_page(rows, "page", ["Séance", "Clôture", "Plus haut", "Plus bas", "Volume", "Code"], cells, F.col("date"))
    html = body.select("page_id", F.concat(F.lit("<table><tr><th>Menu</th></tr><tr><td>x</td></tr></table>"), "html").alias("html"))
    code = F.concat(F.lit("BR"), F.translate((F.col("page_id") % 100).cast("string"), "0123456789", "ABCDEFGHIJ"))
    return pages.history_tables(pages.html_tables(html), code).select("date", "ticker", "high", "low", "close", "volume")


@query(f"WITH {cte('reference')}, p AS (SELECT *, (row_number() OVER (ORDER BY ticker) - 1) // 5 AS page_no FROM reference) SELECT ticker, CAST(page_no AS BIGINT) AS page_no FROM p")
def paged_tickers(spark, d):
    """Pages of five companies; behind the last one the site shows the last page again and again."""
    known = load(spark, d, "reference").select("ticker", (F.rank().over(_by_ticker()) - 1).alias("r"))
    numbered = known.select("ticker", F.floor(F.col("r") / 5).cast("int").alias("page_no"))
    top = numbered.agg(F.max("page_no").alias("top"))
    more = numbered.crossJoin(F.broadcast(top)).filter("page_no = top").select("ticker", F.explode(F.array(F.col("top") + 1, F.col("top") + 2)).alias("page_no"))
    return pages.before_nothing_new(numbered.unionByName(more)).select("ticker", "page_no")


def _by_ticker():
    from pyspark.sql import Window

    return Window.orderBy("ticker")  # over the company list, which is small by nature


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, concat(lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')) AS hour FROM orders")
def session_stamps(spark, d):
    """Date and hour of a "last update" sentence in two notations."""
    hour, minute = (F.col("o_orderkey") % 24).cast("string"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    numeric = F.concat(F.lit("Dernière mise à jour : "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" à "), hour, F.lit("h"), minute)
    month = F.element_at(F.array(*[F.lit(m) for m in tx.MONTHS]), F.month("o_orderdate"))
    spelled = F.concat(F.lit("Mise à jour le "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), month, F.lit(", "), F.year("o_orderdate").cast("string"), F.lit(" - "), hour, F.lit(":"), minute)
    date, clock = tx.session_stamp(F.when(F.col("o_orderkey") % 2 == 0, numeric).otherwise(spelled))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", date.alias("date"), clock.alias("hour"))


@query(f"WITH {cte('quotes')} SELECT CAST(date AS VARCHAR) AS date, ticker, CASE WHEN ticker < 'Brand#2' THEN 'shares' ELSE 'value' END AS unit FROM quotes")
def volume_units(spark, d):
    """Known sessions tell whether a source's volume is shares or value."""
    known = quotes_of(spark, d).select("date", "ticker", F.col("volume_shares").alias("shares"), (F.col("volume_value") + 10_000).alias("value"))
    seen = known.select("date", "ticker", (F.when(F.col("ticker") < "Brand#2", F.col("shares")).otherwise(F.col("value")) + 0.4).alias("volume"))
    return quality.witness(seen, known)


@query(f"""WITH {cte("quotes")} SELECT ticker AS source, CASE CAST(substr(ticker, 7) AS INT) % 4 WHEN 0 THEN 'shares' WHEN 1 THEN 'value' WHEN 2 THEN 'undecided' ELSE 'unavailable' END AS unit,
CASE WHEN CAST(substr(ticker, 7) AS INT) % 4 = 3 THEN 0 ELSE count(*) END AS compared FROM quotes GROUP BY ticker""")
def volume_verdicts(spark, d):
    """A source's unit, or that its sessions cannot tell it, or that none of them is known."""
    kind = F.substring("ticker", 7, 2).cast("int") % 4
    rows = quotes_of(spark, d).select("date", "ticker", F.col("volume_shares").alias("shares"), (F.col("volume_value") + 10_000).alias("value"))
    seen = rows.select("date", "ticker", F.when(kind == 0, F.col("shares")).when(kind == 1, F.col("value")).otherwise(-5.0).alias("volume"))
    return quality.witness_verdict(seen, rows.filter(kind != 3))


# -- names and dividends ------------------------------------------------------------------------------------------------
def collected(spark, d):
    known, rows = load(spark, d, "reference"), load(spark, d, "dividends")
    named = rows.join(F.broadcast(known.select("ticker", "name")), "ticker")
    first = named.filter("fiscal_year % 2 = 0").select(F.upper("name").alias("name"), "ex_date", "amount")
    second = named.select(F.concat("name", F.lit(" CI")).alias("name"), "ex_date", (F.col("amount") * 2).alias("amount"))
    lost = named.filter("fiscal_year = 1999").select(F.concat(F.lit("Lost "), "name").alias("name"), "ex_date", "amount")
    return names.collect_dividends([first, second, lost], known, spark.createDataFrame([], "alias string, ticker string"))


@query(f"WITH {cte('dividends')} SELECT ticker, CAST(ex_date AS VARCHAR) AS ex_date, round(CASE WHEN fiscal_year % 2 = 0 THEN amount ELSE amount * 2 END, 6) AS amount FROM dividends")
def collected_dividends(spark, d):
    return collected(spark, d)[0].select("ticker", "ex_date", "amount")


@query(f"WITH {cte('dividends')} SELECT DISTINCT concat('Lost Company ', ticker) AS name FROM dividends WHERE fiscal_year = 1999")
def dividends_without_ticker(spark, d):
    return collected(spark, d)[1].select("name")


@query(f"""WITH {cte("dividends")} SELECT {CODE_SQL} AS ticker, CAST(ex_date AS VARCHAR) AS ex_date, CAST(ex_date + 14 AS VARCHAR) AS pay_date, CAST(fiscal_year AS BIGINT) AS fiscal_year, round(amount, 2) AS amount FROM dividends""", digits=2)
def dividend_calendar_dates(spark, d):
    """Payment date and fiscal year of the dividend calendar."""
    rows = load(spark, d, "dividends").withColumn("amount", F.round("amount", 2))
    year = F.when(F.col("fiscal_year") % 2 == 0, F.concat("fiscal_year", F.lit(".0"))).otherwise(F.col("fiscal_year").cast("string"))
    cells = [F.expr(CODE_SQL), year, french(F.col("amount")), F.date_format("ex_date", "dd/MM/yyyy"), F.date_format(F.date_add("ex_date", 14), "dd/MM/yyyy")]
    page = table_page(rows.withColumn("page", F.year("ex_date").cast("long")), "page", ["Symbole", "Exercice", "Montant net", "Date de détachement", "Date de paiement"], cells, F.struct("ticker", "ex_date"))
    return pages.dividend_calendar(pages.html_tables(page)).select("ticker", "ex_date", "pay_date", "fiscal_year", "amount")


@query(f"WITH {cte('dividends', 'fundamentals', 'reference')}, y AS (SELECT value FROM fundamentals f JOIN reference r ON r.ticker = f.ticker WHERE indicator = 'yield' AND date = (SELECT max(date) FROM fundamentals WHERE indicator = 'yield')) SELECT count(*) AS companies, round(median(value), 6) AS median_yield FROM y")
def latest_yield_overview(spark, d):
    return snapshot.yield_overview(snapshot.latest_yields(load(spark, d, "fundamentals"), load(spark, d, "reference")))


@query(f"""WITH {TRAIL}, {cte("reference")}, {reversion_sql("trail", 30)}
SELECT ticker, round(last, 6) AS yield, round(a / theta, 6) AS equilibrium FROM ou WHERE ticker IN (SELECT ticker FROM reference WHERE sector IN ('S1', 'S2'))""")
def sector_yield_signal(spark, d):
    """The signal for companies of given sectors only."""
    chosen = load(spark, d, "reference").filter(F.col("sector").isin("S1", "S2"))
    return dividends.yield_signal(quotes_of(spark, d), load(spark, d, "dividends"), 8, chosen).select("ticker", "yield", "equilibrium")


# -- gates --------------------------------------------------------------------------------------------------------------
@query(f"WITH {cte('quotes')}, m AS (SELECT max(date) AS m FROM quotes) SELECT CAST(date AS VARCHAR) AS date, count(*) AS rows FROM quotes, m WHERE date < m GROUP BY 1")
def closed_sessions(spark, d):
    """Before closing time, the rows of the running session are refused."""
    rows = quotes_of(spark, d)
    today = rows.agg(F.max("date").alias("_today"))
    open_ = quality.closed_sessions(rows.crossJoin(F.broadcast(today)), F.col("_today"), F.lit(10), 15)
    return open_.groupBy("date").agg(F.count("*").alias("rows"))


@query("SELECT CAST(0 AS BIGINT) AS steps")
def too_short_history(spark, d):
    """A history that holds no whole step gives an empty journal."""
    rows = quotes_of(spark, d)
    early = rows.join(F.broadcast(rows.select("date").distinct().orderBy("date").limit(FEATURES.needed + BACKTEST.step)), "date", "left_semi")
    return backtest.journal(early, load(spark, d, "reference"), BACKTEST, FEATURES, RANKS).agg(F.count("*").alias("steps"))


# -- external series ----------------------------------------------------------------------------------------------------
# the calendar is part of the sample's SQL already
EXTERNAL_SQL = ", ".join([cte("external"), FILLED[FILLED.index("ser AS (") :]])
EXO = """, map AS (SELECT * FROM (VALUES ('1-URGENT', 'S1'), ('2-HIGH', 'S2')) m(series, sector)),
exo AS (SELECT v.date, r.ticker, max(CASE WHEN v.series = '1-URGENT' AND r.sector = m.sector THEN coalesce(variation, 0) ELSE 0 END) FILTER (v.series = '1-URGENT') AS urgent, max(CASE WHEN v.series = '2-HIGH' AND r.sector = m.sector THEN coalesce(variation, 0) ELSE 0 END) FILTER (v.series = '2-HIGH') AS high FROM varied v JOIN map m ON m.series = v.series CROSS JOIN reference r GROUP BY 1, 2)"""


@query(f"""WITH {SAMPLE}, {EXTERNAL_SQL}, {cte("reference")}{EXO}
SELECT CAST(s.date AS VARCHAR) AS date, s.ticker, round(forward, 6) AS forward, round(coalesce(urgent, 0), 6) AS exo_urgent, round(coalesce(e.high, 0), 6) AS exo_high FROM sample s LEFT JOIN exo e ON e.date = s.date AND e.ticker = s.ticker""")
def sample_with_external(spark, d):
    """The learning sample with the external series of the ticker's sector as further columns."""
    long = exogenous.external_features(load(spark, d, "external"), panel.calendar(quotes_of(spark, d)), load(spark, d, "reference"), mapping_of(spark), EXTERNAL)
    wide = exogenous.wide(long, ["1-URGENT", "2-HIGH"])
    rows = learn.sample(panel_of(spark, d), LEARNING.horizon, FEATURES, wide)
    return rows.select("date", "ticker", "forward", F.col("exo_1-URGENT").alias("exo_urgent"), F.col("exo_2-HIGH").alias("exo_high"))


@query(f"WITH {JOURNAL} SELECT CAST(date AS VARCHAR) AS date, 'value' AS curve, round(value, 6) AS value FROM journal UNION ALL SELECT CAST(date AS VARCHAR), 'reference_value', round(reference_value, 6) FROM journal WHERE reference_value IS NOT NULL")
def value_curves(spark, d):
    return backtest.curves(journal_of(spark, d))
