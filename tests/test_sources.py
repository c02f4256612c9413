"""Tables on disk, texts, pages and names."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import names, quality
from tidemark.sources import archive, pages, versions


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [("20 643 040", 20643040.0), ("245,80", 245.8), ("1.234,5", 1234.5), ("-0,32 %", -0.32), ("-", None), ("--", None), ("", None), ("12.5", 12.5), ("1\xa0200 FCFA", 1200.0), (None, None)])
def test_french_numbers(spark, value, want):
    assert one(spark, value, tx.number) == want


@pytest.mark.parametrize(("value", "want"), [("04/09/2026", (2026, 9, 4)), ("4-9-2026", (2026, 9, 4)), ("2026-09-04", (2026, 9, 4)), ("04.09.2026", (2026, 9, 4)), ("04/09/26", (2026, 9, 4)), ("4 septembre 2026", (2026, 9, 4)), ("Lundi, 27 juillet, 2026", (2026, 7, 27)), ("30/02/2026", None), ("30 février 2026", None), ("soon", None), (None, None)])
def test_dates_are_read_or_null(spark, value, want):
    assert one(spark, value, tx.day) == (want and datetime.date(*want))


def test_names_lose_accents_and_country(spark):
    assert one(spark, "  Société  Générale - Côte d'Ivoire", tx.without_country) == "societe generale"
    date, hour = tx.session_stamp(F.col("x"))
    got = spark.createDataFrame([("Dernière mise à jour : Lundi, 27 juillet, 2026 à 15h05",)], "x string").select(date.alias("d"), hour.alias("h")).first()
    assert (got.d, got.h) == (datetime.date(2026, 7, 27), "15:05")


def test_upsert_replaces_by_key_last_wins_and_log_appends(spark, tmp_path):
    kind = "date date, ticker string, close double, n int"
    day = datetime.date(2024, 1, 2)
    old = archive.conform(spark.createDataFrame([(day, "AA", 1.0, 0), (day, "BB", 2.0, 0)], kind), "quotes")
    new = spark.createDataFrame([(day, "AA", 5.125, 1), (day, "AA", 6.125, 2), (day, "CC", float("nan"), 1)], kind)
    got = archive.upsert(old, new, "quotes", "n")
    assert sorted((r.ticker, r.close) for r in got.collect()) == [("AA", 6.12), ("BB", 2.0)]
    got.write.parquet(path := str(tmp_path / "one"))
    assert archive.read(spark, "quotes", path).count() == 2
    assert archive.export_csv(got, "quotes", str(tmp_path / "csv")) == 2
    assert archive.read_csv(spark, "quotes", str(tmp_path / "none")).count() == 0
    log = archive.log_rows(got, "page", "2024-01-02 10:00:00", "x" * 900)
    assert len(archive.upsert(archive.upsert(archive.empty(spark, "ingest_log"), log, "ingest_log"), log, "ingest_log").first().message) == 500
    with pytest.raises(ValueError):
        archive.read(spark, "nothing", path)
    with pytest.raises(ValueError):
        archive.conform(spark.range(1), "quotes")


def test_tables_of_a_page(spark):
    html = "<table><tr><th>Symbole</th><th>Cours Clôture</th><th>Volume</th></tr><tr><td>abcd </td><td>1 200,5</td><td>10</td></tr><tr><td>x</td></tr><tr><td>TOOLONGX</td><td>5</td><td>1</td></tr><tr><td>EFGH</td><td>0</td><td>1</td></tr></table><table><tr><th>only</th></tr></table>"
    found = pages.html_tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert found.count() == 3
    got = pages.session_quotes(found, F.lit("2024-01-02").cast("date")).collect()
    assert [(r.ticker, r.close, r.volume_value) for r in got] == [("ABCD", 1200.5, 12005.0)]
    assert len(pages.page_fingerprints(found).first().fingerprint) == 16


def rows_of_tokens(tokens):
    """What a page of these tokens holds, by the definition: (table, row, header, cells, links), all tables kept whole."""
    tables, stack, row, links = [], [], None, []

    def end_row():
        nonlocal row, links
        if row is not None and stack:
            tables[stack[-1]].append(([" ".join("".join(c).split()) for c in row], links))
        row, links = None, []

    for kind, value in tokens:
        if kind in ("table", "/table", "/tr") or (kind == "tr" and stack):
            end_row()
        if kind == "table":
            tables.append([])
            stack.append(len(tables) - 1)
        elif kind == "/table" and stack:
            stack.pop()
        elif kind == "tr" and stack:
            row = []
        elif kind == "td" and row is not None:
            row.append([])
        elif kind == "a" and row is not None:
            links.append(value)
        elif kind == "text" and row:
            row[-1].append(value)
    end_row()
    return [(t, r, rows[0][0], cells, hrefs) for t, rows in enumerate(tables) for r, (cells, hrefs) in enumerate(rows)]


def test_rows_of_random_nested_and_broken_pages(spark):
    import html
    import random

    draw, texts = random.Random(9), []
    for n in range(400):
        tokens = [(draw.choices(["table", "/table", "tr", "/tr", "td", "/td", "a", "text"], [2, 1, 5, 3, 8, 2, 1, 9])[0], draw.choice(["x", "a & b", " two  words ", "<i>", "é\n1", "&amp;", ""])) for _ in range(draw.randrange(60))]
        page = "".join(f"<a href='{html.escape(v)}'>" if k == "a" else html.escape(v) if k == "text" else f"<{k} class='c>d'>" if k[0] != "/" else f"<{k}>" for k, v in tokens)
        page = page.replace("<tr class", "<!-- <td> --><TR class") if n % 3 else page
        want = rows_of_tokens([(k, v) for k, v in tokens if k != "a" or v])
        texts.append((n, page, want))
        for piece in (1, 7, 1 << 16):
            assert sorted(pages.rows_of(page, piece)) == want, (n, piece)
    df = spark.createDataFrame([(n, page) for n, page, _ in texts] + [(None, None), (-1, "")], "page_id int, html string")
    got = sorted(tuple(r) for r in pages.html_tables(df).collect())
    assert got == sorted((n, t, r - 1, header, cells) for n, _, want in texts for t, r, header, cells, _ in want if r and len(cells) == len(header))
    linked = sorted((r.page_id, r.row_no, r.text, r.hrefs) for r in pages.linked_rows(df, 1).collect())
    assert linked == sorted((n, i, " ".join(filter(None, cells))[:110], hrefs) for n, _, want in texts for i, (_, _, _, cells, hrefs) in enumerate(want) if hrefs and any(cells))
    for broken in ("<table><tr><td>1<td>2<tr><td>3<td>4<a href='", "<table><tr><td>1<td>2<tr><td>3<td>4<!-- ", "<table><tr><td>1<td>2<tr><td>3<td>4<"):
        whole = list(pages.rows_of(broken + "x" * 500, 1 << 16))
        assert [c for *_, c, _ in whole][0] == ["1", "2"] and list(pages.rows_of(broken + "x" * 500, 3)) == whole


def test_long_pages_are_read_in_bounded_memory_and_linear_time():
    import time
    import tracemalloc

    page = "<table>" + "<tr><td>abcdefgh</td><td>12345678</td><td>1 200,5</td></tr>" * 170_000 + "</table>"
    assert len(page) > 10_000_000
    tracemalloc.start()
    n = sum(1 for _ in pages.rows_of(page))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 170_000 and peak < 4_000_000  # the page's rows take some 100 MB together
    start = time.time()
    for tail in ("<!-- ", "<a href='", "&"):
        assert len(list(pages.rows_of("<table><tr><td>1</td></tr>" + tail + "x" * 10_000_000))) == 1
    assert time.time() - start < 60


def test_rows_of_several_batches_all_arrive(spark):
    page = "<table>" + "<tr><td>abcdefgh</td><td>12345678</td></tr>" * 8000 + "</table>"  # more than a megabyte of rows
    df = spark.createDataFrame([(i, page) for i in range(3)], "page_id long, html string").coalesce(1)
    got = pages.html_tables(df).groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("row_no").alias("numbers"), F.max("row_no").alias("last")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 7999, 7999, 7998) for i in range(3)]


def test_paging_ends_where_pages_repeat_or_bring_nothing(spark):
    seen = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "page_id long, fingerprint string")
    assert sorted(r.page_id for r in pages.before_repetition(seen).collect()) == [1, 2]
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C"), (3, "A"), (4, "D")], "page_no int, ticker string")
    assert sorted(r.ticker for r in pages.before_nothing_new(rows).collect()) == ["A", "B", "C"]


def test_payloads_tranches_symbols_and_links(spark):
    rows = spark.createDataFrame([("AA", '{"lst":[{"Date":"05/01/2024","Close":"1,5","Volume":"7"},{"Date":"?","Close":"2"},{"Date":"06/01/2024"}]}')], "ticker string, payload string")
    assert [(r.close, r.volume) for r in pages.history_payload(rows).collect()] == [(1.5, 7.0)]
    parts = pages.tranches(spark.createDataFrame([(datetime.date(2024, 1, 1), datetime.date(2024, 4, 30))], "start date, end date")).orderBy("from").collect()
    assert [(r["to"] - r["from"]).days for r in parts] == [88, 31]
    with pytest.raises(Exception, match="reversed"):
        pages.tranches(spark.createDataFrame([(datetime.date(2024, 2, 1), datetime.date(2024, 1, 1))], "start date, end date")).collect()
    known = pages.symbols(spark.createDataFrame([("SNTS.sn INDEX10.ci ABC",)], "menu string"), "ci", ("index",))
    assert [r.symbol for r in pages.with_symbol(spark.createDataFrame([("SNTS",), ("ABJC",)], "ticker string"), known, "ci").orderBy("ticker").collect()] == ["ABJC.ci", "SNTS.sn"]
    html = "<table><tr><td>a</td><td>b</td><td>c</td><td><a href='x.pdf'>d</a></td></tr><tr><td>a</td></tr></table>"
    assert [(r.text, r.hrefs) for r in pages.linked_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()] == [("a b c d", ["x.pdf"])]


def test_menus_refuse_and_keep_the_last_entry(spark):
    menu = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "page_id long, menu string")
    got = pages.symbols(menu("SNTS.ci BRVM10.ci HOUSEX.bj SNTS.sn", "abj.ml SNTS.bf"), "ci", ("brvm", "house")).collect()
    assert sorted((r.ticker, r.country, r.symbol) for r in got) == [("ABJ", "ml", "ABJ.ml"), ("SNTS", "bf", "SNTS.bf")]
    for text, said in ((None, "no menu"), ("", "no share"), ("BRVM10.ci none", "no share")):
        with pytest.raises(Exception, match=said):
            pages.symbols(menu(text), "ci", ("brvm",)).collect()


def test_a_page_without_history_is_refused(spark):
    html = "<table><tr><th>Date</th><th>Clôture</th></tr><tr><td>05/01/2024</td><td>1,5</td></tr></table>"
    other = "<table><tr><th>Menu</th></tr><tr><td>x</td></tr></table>"
    read = lambda *rows: pages.html_tables(spark.createDataFrame(list(rows), "page_id long, html string"))
    assert pages.history_tables(read((1, html)), F.lit("AA")).count() == 1
    with pytest.raises(Exception, match="no table with a date and a close on page 2"):
        pages.history_tables(read((1, html), (2, other)), F.lit("AA")).collect()
    landed = spark.createDataFrame([(1, html), (3, "<p>nothing</p>")], "page_id long, html string")
    with pytest.raises(Exception, match="page 3"):
        pages.history_tables(pages.html_tables(landed), F.lit("AA"), landed).collect()


def test_a_witness_that_cannot_decide_says_so(spark):
    day = datetime.date(2024, 1, 2)
    later = datetime.date(2024, 1, 3)
    known = spark.createDataFrame([(d, t, 100.0, 5000.0) for d in (day, later) for t in "ABCD"], "date date, ticker string, shares double, value double")
    seen = spark.createDataFrame([(day, "A", 100.4), (later, "A", 99.7), (day, "B", 5000.0), (later, "B", 100.0), (day, "C", 42.0), (day, "D", 5000.2), (day, "E", 1.0)], "date date, ticker string, volume double")
    got = {r.source: (r.unit, r.compared) for r in quality.witness_verdict(seen, known).collect()}
    assert got == {"A": ("shares", 2), "B": ("undecided", 2), "C": ("undecided", 1), "D": ("value", 1), "E": ("unavailable", 0)}


def test_companies_that_begin_alike_make_no_hot_key(spark):
    known = spark.range(100_000).select(F.concat(F.lit("T"), "id").alias("ticker"), F.concat(F.lit("Banque nationale numero "), "id", F.lit(" du nord")).alias("name"))
    alias = spark.createDataFrame([], "alias string, ticker string")
    asked = spark.createDataFrame([(n,) for n in ("banque", "Banque nationale", "banque nationale numero 77 du", "banque nationale numero 8", "Banque nationale numero 99999 du nord et du sud", "ban", None)], "name string")
    got, rest = names.reconcile(asked, known, alias)
    assert {r.name: (r.ticker, r.rule) for r in got.collect()} == {"banque nationale numero 77 du": ("T77", 5), "Banque nationale numero 99999 du nord et du sud": ("T99999", 5)}
    assert {r.name for r in rest.collect()} == {"banque", "Banque nationale", "banque nationale numero 8", "ban", None}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_ambiguous_names_are_refused(spark):
    known = spark.createDataFrame([("AAAA", "Banque du Nord Sénégal"), ("BBBB", "Banque du Nord Mali"), ("CCCC", "Huilerie")], "ticker string, name string")
    alias = spark.createDataFrame([("Old Oil", "CCCC"), ("Gone", "ZZZZ")], "alias string, ticker string")
    asked = spark.createDataFrame([(n,) for n in ("banque du nord", "BANQUE DU NORD MALI", "Huil", "Old oil", "Gone", "bbbb")], "name string")
    got, rest = names.reconcile(asked, known, alias)
    assert {r.name: (r.ticker, r.rule) for r in got.collect()} == {"BANQUE DU NORD MALI": ("BBBB", 3), "Huil": ("CCCC", 5), "Old oil": ("CCCC", 1), "bbbb": ("BBBB", 2)}
    assert {r.name for r in rest.collect()} == {"banque du nord", "Gone"}


def test_stream_merges_by_key_and_month(spark, tmp_path):
    from tidemark.streaming import ingest

    january, march = datetime.date(2024, 1, 2), datetime.date(2024, 3, 5)
    land, root, state = (str(tmp_path / x) for x in ("land", "table", "state"))
    kind = "date date, ticker string, close double"
    arrive = lambda *rows: archive.conform(spark.createDataFrame(list(rows), kind), "quotes").write.mode("append").parquet(land)
    merge = lambda where=state: ingest.merge_batches(ingest.quote_stream(spark, land), root, where).awaitTermination()
    shown = lambda version=None: sorted((str(r.date)[:7], r.ticker, r.close) for r in ingest.merged_quotes(spark, root, version).collect())
    arrive((january, "AA", 1.0), (march, "AA", 5.0), (None, "CC", 9.0))
    merge()
    arrive((january, "AA", 3.0), (january, "BB", 2.0))
    merge()
    assert shown() == [("2024-01", "AA", 3.0), ("2024-01", "BB", 2.0), ("2024-03", "AA", 5.0)]
    assert shown(1) == [("2024-01", "AA", 1.0), ("2024-03", "AA", 5.0)]
    folders = lambda version: {p["part"]: p["path"] for p in versions.manifest(spark, root, version)["parts"]}
    assert folders(1)["2024-03"] == folders(2)["2024-03"] and folders(1)["2024-01"] != folders(2)["2024-01"]  # March is not rewritten
    arrive((march, "AA", 6.0))
    merge()
    assert shown() == [("2024-01", "AA", 3.0), ("2024-01", "BB", 2.0), ("2024-03", "AA", 6.0)]


def test_batches_run_twice_count_once_and_files_stay_bounded(spark, tmp_path):
    from tidemark.streaming import ingest

    land, root = str(tmp_path / "land"), str(tmp_path / "table")
    for i in range(8):
        rows = [(datetime.date(2024, 1, 2 + i), "AA", float(i)), (datetime.date(2024, 1, 1), "BB", float(i))]
        archive.conform(spark.createDataFrame(rows, "date date, ticker string, close double"), "quotes").coalesce(1).write.mode("append").parquet(land)
        ingest.merge_batches(ingest.quote_stream(spark, land), root, str(tmp_path / "state"), keep=2, least_age=0.0).awaitTermination()
    before = versions.manifest(spark, root)
    ingest.merge_batches(ingest.quote_stream(spark, land), root, str(tmp_path / "again")).awaitTermination()  # a lost checkpoint starts at batch 0
    assert versions.manifest(spark, root) == before and before["batch"] == 7
    got = {(r.date.day, r.ticker): r.close for r in ingest.merged_quotes(spark, root).collect()}
    assert got == {(1, "BB"): 7.0, **{(2 + i, "AA"): float(i) for i in range(8)}}
    assert len(list((tmp_path / "table").rglob("*.parquet"))) <= 3 and len(versions.numbers(spark, root)) == 2


def quote_rows(spark, *rows):
    return archive.conform(spark.createDataFrame([(datetime.date(*d), t, c) for d, t, c in rows], "date date, ticker string, close double"), "quotes")


def closes(spark, root, version=None):
    return sorted((str(r.date), r.ticker, r.close) for r in versions.read(spark, root, "quotes", version).collect())


def test_a_writer_that_dies_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert versions.read(spark, root, "quotes").count() == 0 and versions.history(spark, root).count() == 0
    versions.upsert(root, "quotes", quote_rows(spark, ((2024, 1, 2), "AA", 1.0), ((2024, 2, 2), "AA", 2.0)), "date")
    old = closes(spark, root)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(versions, "_commit", dies)
        versions.upsert(root, "quotes", quote_rows(spark, ((2024, 1, 2), "AA", 9.0)), "date")
    assert closes(spark, root) == old and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert versions.expire(spark, root, least_age=3600.0) == 0  # a young folder may belong to a writer
    assert versions.expire(spark, root, least_age=-1.0) == 1 and closes(spark, root) == old


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    base = versions.manifest(spark, root)
    assert versions.upsert(root, "quotes", quote_rows(spark, ((2024, 1, 2), "AA", 1.0)), "date", base=base) == 1
    with pytest.raises(versions.ConflictError):
        versions.upsert(root, "quotes", quote_rows(spark, ((2024, 1, 2), "BB", 2.0)), "date", base=base)
    assert closes(spark, root) == [("2024-01-02", "AA", 1.0)] and list((tmp_path / "t" / "drafts").glob("*.json")) == []
    assert versions.upsert(root, "quotes", quote_rows(spark, ((2024, 1, 2), "BB", 2.0)), "date") == 2
    assert len(closes(spark, root)) == 2


def test_versions_delete_compact_and_expire(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.upsert(root, "quotes", quote_rows(spark, ((2024, 1, 2), "AA", 1.0), ((2024, 2, 2), "AA", 2.0), ((2024, 2, 2), "BB", 2.5)), "date")
    versions.delete(root, "quotes", quote_rows(spark, ((2024, 1, 2), "AA", 0.0), ((2024, 2, 2), "BB", 0.0), ((2030, 1, 1), "ZZ", 0.0)))
    assert closes(spark, root) == [("2024-02-02", "AA", 2.0)] and len(closes(spark, root, 1)) == 3
    assert [(r.version, r.parts, r.rows) for r in versions.history(spark, root).collect()] == [(1, 2, 3), (2, 1, 1)]
    log = str(tmp_path / "log")
    for i in range(7):
        versions.upsert(log, "ingest_log", archive.log_rows(spark.range(i), f"s{i}", "2024-01-02 10:00:00", "m"))
    assert len(versions.manifest(spark, log)["parts"]) == 7
    assert versions.compact(spark, log, "ingest_log") == 8 and versions.compact(spark, log, "ingest_log") is None
    assert len(versions.manifest(spark, log)["parts"]) == 1
    assert versions.expire(spark, log, keep=1, least_age=-1.0) == 7
    assert sorted(r.rows for r in versions.read(spark, log, "ingest_log").collect()) == list(range(7))
    assert len(list((tmp_path / "log").rglob("*.parquet"))) == 1
    versions.upsert(str(tmp_path / "ref"), "reference", archive.conform(spark.createDataFrame([("AA", "A", 1)], "ticker string, name string, n int"), "reference").withColumn("n", F.lit(1)), "n")
    assert [p["part"] for p in versions.manifest(spark, str(tmp_path / "ref"))["parts"]] == ["all"]


def test_refreshed_features_equal_those_made_anew(spark, tmp_path):
    """Ten random revisions: rows changed, added (new tickers and sessions too) and deleted; only their look-back is read."""
    import random

    from tidemark.operators.features import rolling_features
    from tidemark.operators.panel import dense
    from tidemark.settings import FeatureSettings
    from tidemark.sources import refresh

    settings, draw = FeatureSettings(momentum=9, skip=1, volatility=4, liquidity=5, short_mean=2, long_mean=6), random.Random(6)
    quotes, kept = str(tmp_path / "quotes"), str(tmp_path / "features")
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    kind = "date date, ticker string, close double, volume_value double"
    rows = lambda places: archive.conform(spark.createDataFrame([(day(n), t, float(draw.randint(50, 150)), float(draw.randint(0, 9))) for n, t in places], kind), "quotes")
    versions.upsert(quotes, "quotes", rows({(draw.randrange(0, 700, 2), draw.choice("ABCD")) for _ in range(900)}), "date")
    assert refresh.refresh(spark, quotes, kept, settings)[0] == {p["part"] for p in versions.manifest(spark, quotes)["parts"]}
    for step in range(5):
        at = draw.randrange(650)
        places = {(at + draw.randrange(20), draw.choice("ABCDE")) for _ in range(12)}
        if step % 2:
            versions.delete(quotes, "quotes", rows(places))
        else:
            versions.upsert(quotes, "quotes", rows(places), "date")
        written, read = refresh.refresh(spark, quotes, kept, settings)
        assert written <= read and len(read) <= 7  # two months, and a month at each side for nine sessions of about 25 a month
        names = versions.DERIVED["features"].names
        anew = rolling_features(dense(versions.read(spark, quotes, "quotes")), settings).filter("close is not null").select(*names)
        assert sorted(map(str, versions.read(spark, kept, "features").collect())) == sorted(map(str, anew.collect()))
        files = versions.read_parts(spark, quotes, "quotes", read).inputFiles()
        assert {f.split("part=")[1][:7] for f in files} <= read
    assert refresh.refresh(spark, quotes, kept, settings) == (set(), set())


def test_weekly_turnover_adds_a_week(spark, tmp_path):
    from tidemark.streaming import ingest

    land = str(tmp_path / "land")
    rows = [(datetime.date(2024, 1, 4), "AA", 1.0, 10.0), (datetime.date(2024, 1, 5), "AA", 1.0, 5.0), (datetime.date(2024, 1, 5), "BB", 1.0, 2.0), (datetime.date(2024, 3, 1), "AA", 1.0, 7.0)]
    archive.conform(spark.createDataFrame(rows, "date date, ticker string, close double, volume_value double"), "quotes").write.parquet(land)
    query = ingest.weekly_turnover(ingest.quote_stream(spark, land)).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.ticker, r.turnover, r.rows) for r in spark.table("weeks").collect()) == [("AA", 7.0, 1), ("AA", 15.0, 2), ("BB", 2.0, 1)]


def test_country_suffixes_and_refused_payloads(spark):
    from tidemark.functions import text as tx

    rows = spark.createDataFrame([("BANK OF AFRICA NE",), ("Sonatel Sénégal",), ("Coris Burkina Faso",), ("Niger",)], "name string")
    assert [r[0] for r in rows.select(tx.without_country(rows["name"])).collect()] == ["bank of africa", "sonatel", "coris", "niger"]
    with pytest.raises(Exception, match="no date or close"):
        pages.history_payload(spark.createDataFrame([("AA", '{"lst":[{"Date":"05/01/2024","Volume":"7"}]}')], "ticker string, payload string")).collect()
    named = spark.createDataFrame([("AA", '{"lst":[{"seance":"2024-01-05","DERNIER":"1,5"}]}')], "ticker string, payload string")
    assert [(str(r.date), r.close) for r in pages.history_payload(named).collect()] == [("2024-01-05", 1.5)]
    with pytest.raises(ValueError, match="column"):
        archive.upsert(archive.empty(spark, "quotes"), archive.empty(spark, "quotes"), "quotes")


def test_pages_of_one_row_group_are_read_by_all_tasks(spark, tmp_path):
    """One file with one row group is one task of the scan, whatever its rows cost; copies of one page are dealt as well."""
    row = "<tr><td>a</td><td>b</td><td>c</td><td><a href='x'>d</a></td></tr>"
    spark.createDataFrame([(i % 2, f"<table>{row * 2}</table>") for i in range(400)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    landed = spark.read.parquet(f"{tmp_path}/pages.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows, n in ((pages.linked_rows(landed), 800), (pages.html_tables(landed), 400)):
            sizes = rows.groupBy(F.spark_partition_id()).count().collect()
            assert len(sizes) == 4 and sum(r[1] for r in sizes) == n and max(r[1] for r in sizes) < n / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
