"""Queries over pages, payloads and texts that Spark writes from the given tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import names
from tidemark.plans.fixtures import cte, load
from tidemark.plans.queries import query, quotes_of
from tidemark.sources import pages

#: Tickers of one page of the yearly history, on average.
TICKERS_A_PAGE = 8
CODE_SQL = "concat('BR', translate(substr(ticker, 7), '0123456789', 'ABCDEFGHIJ'))"


def french(c):
    """A number as published: spaces between thousands, a comma before the decimals."""
    return F.translate(F.format_number(c, 2), ",.", " ,")


def table_page(rows, group: str, header: list[str], cells: list, order):
    """(page_id, html) with one table for each group."""
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>"
    body = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))), lambda x: x["r"]))
    return rows.groupBy(F.col(group).alias("page_id")).agg(F.concat(F.lit(f"<html><body><p>Cours</p><table>{head}"), body, F.lit("</table></body></html>")).alias("html"))


def quote_pages(spark, d):
    rows = quotes_of(spark, d).withColumn("page", F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long"))
    code = F.expr(CODE_SQL)
    cells = [code, F.concat(F.lit("Company "), "ticker"), french(F.col("low")), french(F.col("high")), french(F.col("high")), F.format_string("%.0f", "volume_shares"), F.lit("-")]
    return table_page(rows, "page", ["Symbole", "Nom", "Plus bas", "Plus haut", "Cours Clôture", "Volume titres", "Variation (%)"], cells, F.col("ticker"))


def page_date():
    return F.expr("date_add(DATE '1990-01-01', CAST(page_id AS INT))")


@query(f"""WITH {cte("quotes")} SELECT CAST(date AS VARCHAR) AS date, {CODE_SQL} AS ticker, round(low, 2) AS low, round(high, 2) AS close, round(volume_shares, 2) AS volume_shares, round(volume_shares * high, 2) AS volume_value FROM quotes""", digits=2)
def quotes_from_pages(spark, d):
    return pages.session_quotes(pages.html_tables(quote_pages(spark, d)), page_date()).select("date", "ticker", "low", "close", "volume_shares", "volume_value")


@query(f"WITH {cte('quotes')} SELECT DISTINCT {CODE_SQL} AS ticker, concat('Company ', ticker) AS name FROM quotes")
def companies_from_pages(spark, d):
    return pages.companies(pages.html_tables(quote_pages(spark, d))).select("ticker", "name")


@query(f"WITH {cte('quotes')} SELECT {CODE_SQL} AS ticker, CAST(date AS VARCHAR) AS date, round(low, 2) AS low, round(high, 2) AS close, round(volume_shares, 2) AS volume FROM quotes", digits=2)
def history_from_payloads(spark, d):
    entry = F.struct(F.date_format("date", "dd/MM/yyyy").alias("Date"), french(F.col("low")).alias("Low"), french(F.col("high")).alias("Close"), F.format_string("%.0f", "volume_shares").alias("Volume"))
    payloads = quotes_of(spark, d).groupBy(F.expr(CODE_SQL).alias("ticker"), F.year("date")).agg(F.to_json(F.struct(F.collect_list(entry).alias("lst"))).alias("payload"))
    return pages.history_payload(payloads).select("ticker", "date", "low", "close", "volume")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders", digits=2)
def french_numbers(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", tx.number(french(F.col("o_totalprice"))).alias("value"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def french_dates(spark, d):
    months = F.array(*[F.lit(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")])
    day = F.col("o_orderdate")
    spelled = F.concat(F.lit("Lundi, "), F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(months, F.month(day)), F.lit(" "), F.year(day).cast("string"))
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, F.date_format(day, "d/M/yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM-dd")).when(kind == 2, F.date_format(day, "dd.MM.yyyy")).otherwise(spelled)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", tx.day(written).alias("date"))


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(concat('  Société ', p_name, ' & Cie'))), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def normalised_names(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tx.normalised(F.concat(F.lit("  Société "), "p_name", F.lit(" & Cie"))).alias("name"))


@query(f"""WITH {cte("dividends")} SELECT CAST(ex_date AS VARCHAR) AS ex_date, {CODE_SQL} AS ticker, concat('Company ', ticker) AS name, round(amount, 2) AS amount FROM dividends""", digits=2)
def dividends_from_pages(spark, d):
    rows = load(spark, d, "dividends").withColumn("amount", F.round("amount", 2))
    cells = [F.date_format("ex_date", "dd/MM/yyyy"), F.expr(CODE_SQL), F.concat(F.lit("Company "), "ticker"), french(F.col("amount"))]
    page = table_page(rows.withColumn("page", F.col("fiscal_year").cast("long")), "page", ["Date de détachement", "Symbole", "Société", "Montant net"], cells, F.struct("ticker", "ex_date"))
    return pages.dividend_calendar(pages.html_tables(page)).select("ex_date", "ticker", "name", "amount")


@query(f"""WITH {cte("dividends")} SELECT ticker AS name, concat(CAST(fiscal_year AS VARCHAR), '-12-31') AS date, 'dividend' AS indicator, round(max(amount), 2) AS value FROM dividends GROUP BY ticker, fiscal_year""", digits=2)
def yearly_history_from_pages(spark, d):
    known = load(spark, d, "dividends")
    years = [r[0] for r in known.select("fiscal_year").distinct().orderBy("fiscal_year").collect()]  # one for each year
    wide = known.groupBy("ticker").pivot("fiscal_year", years).agg(F.max("amount"))
    cells = [F.col("ticker"), *[F.coalesce(french(F.col(str(y))), F.lit("-")) for y in years]]
    blocks = max(wide.count() // TICKERS_A_PAGE, 1)
    page = table_page(wide.withColumn("page", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("long")), "page", ["Société", *[f"Div. {y}" for y in years]], cells, F.col("ticker"))
    return pages.yearly_history(pages.html_tables(page))


@query(f"""WITH {cte("quotes")}, r AS (SELECT ticker, min(date) AS s, max(date) AS e FROM quotes GROUP BY 1), t AS (SELECT ticker, e, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 89 DAY)) AS DATE) AS f FROM r)
SELECT ticker, CAST(f AS VARCHAR) AS "from", CAST(least(f + 88, e) AS VARCHAR) AS "to" FROM t""")
def date_tranches(spark, d):
    return pages.tranches(quotes_of(spark, d).groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("end")))


COUNTRY_SQL = "(VALUES ('CI'), ('Sénégal'), ('bf'), ('BENIN'), ('ml'), ('NE'), ('Togo'), ('Niger'), ('Côte d''Ivoire')) c(suffix)"


@query(f"""WITH {cte("reference")} SELECT concat(name, ' ', suffix) AS name, ticker, CAST(4 AS BIGINT) AS rule FROM reference, {COUNTRY_SQL}
UNION ALL SELECT name, ticker, 3 FROM reference UNION ALL SELECT concat('Former ', ticker), ticker, 1 FROM reference
UNION ALL SELECT concat(name, ' Holding'), ticker, 5 FROM reference WHERE NOT exists(SELECT 1 FROM reference o WHERE o.ticker <> reference.ticker AND starts_with(reference.name, o.name))""")
def names_to_tickers(spark, d):
    """Every country suffix, the plain name, an alias, and a longer name; names that begin with two companies' names are refused."""
    known = load(spark, d, "reference")
    suffixes = F.explode(F.array(*[F.lit(x) for x in ("CI", "Sénégal", "bf", "BENIN", "ml", "NE", "Togo", "Niger", "Côte d'Ivoire")]))
    asked = known.select("name", suffixes.alias("s")).select(F.concat_ws(" ", "name", "s").alias("name")).union(known.select("name"))
    asked = asked.union(known.select(F.concat(F.lit("Former "), "ticker"))).union(known.select(F.concat("name", F.lit(" Holding"))))
    return names.reconcile(asked, known, known.select(F.concat(F.lit("FORMER "), "ticker").alias("alias"), "ticker"))[0]


@query(f"WITH {cte('reference')} SELECT concat('Unknown ', ticker) AS name FROM reference UNION ALL SELECT concat(name, ' Holding') FROM reference WHERE exists(SELECT 1 FROM reference o WHERE o.ticker <> reference.ticker AND starts_with(reference.name, o.name))")
def names_without_ticker(spark, d):
    known = load(spark, d, "reference")
    asked = known.select(F.concat(F.lit("Unknown "), "ticker").alias("name")).union(known.select("name")).union(known.select(F.concat("name", F.lit(" Holding"))))
    return names.reconcile(asked, known, spark.createDataFrame([], "alias string, ticker string"))[1]


@query("SELECT page_id, count(*) AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href')) FROM pages) GROUP BY 1")
def menu_entries(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    as_table = rows.select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "<nav>(.*?)</nav>", 1), "<li>", "<tr><td>"), "</li>", "</td></tr>").alias("b"))
    html = as_table.select("page_id", F.concat(F.lit("<table><tr><th>x</th></tr>"), F.regexp_replace("b", "</?ul>", ""), F.lit("</table>")).alias("html"))
    return pages.linked_rows(html, 0).groupBy("page_id").agg(F.count("*").alias("items"))
