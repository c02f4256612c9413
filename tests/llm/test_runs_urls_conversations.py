"""Periodic runs, URL filter and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation, periodic_runs, url_filter


# -- periodic runs ------------------------------------------------------------------------------------------------------
def plain_runs(words, least=12):
    """By the definition: every lag, every stretch of equal pairs, smallest period of each stretch."""
    found = {}
    for lag in range(1, len(words) // 2 + 1):
        i = lag
        while i < len(words):
            if words[i] != words[i - lag]:
                i += 1
                continue
            first = i
            while i < len(words) and words[i] == words[i - lag]:
                i += 1
            start, length = first - lag, i - first + lag
            if length >= max(least, 2 * lag):
                found.setdefault((start, length), lag)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_the_definition_on_both_ways():
    draw = random.Random(5)
    for n in range(400):
        words = [draw.choice("ab" if n % 3 else "abcdefgh") for _ in range(draw.randint(0, 90))]
        if n % 2 and len(words) > 4:
            a, p = draw.randrange(len(words) - 3), draw.randint(1, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else "z" for i in range(len(words))]
        want = plain_runs(words)
        assert periodic_runs.runs_of(words, dense=1e9) == want and periodic_runs.runs_of(words, dense=0) == want and periodic_runs.runs_of(words) == want


def test_runs_of_powers_and_nested_periods():
    inner = list("ababababab") + ["c"]
    words = inner * 6 + ["end"]
    assert periodic_runs.runs_of(words) == plain_runs(words)
    assert periodic_runs.runs_of(["a"] * 30) == [(0, 30, 1)]
    center = list("abababababa") + list("ababababab")  # a run of period 2 meets itself out of phase
    assert periodic_runs.runs_of(center, dense=1e9) == periodic_runs.runs_of(center, dense=0) == plain_runs(center)


def test_one_word_a_hundred_thousand_times():
    assert periodic_runs.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]


def test_runs_of_documents(spark):
    draw = random.Random(3)
    texts = [None, "", " \t\n", "a b", "Aa aa " * 20, "x\x0by\fz\r " * 30] + [" ".join(draw.choice(["é", "b", "cc"]) for _ in range(draw.choice([5, 40, 300]))) for _ in range(60)]
    texts += ["long " + " ".join(str(i % 700) for i in range(20_000))] + ["same words here " * 9] * 2
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, start int")
    got = {r.doc_id: r for r in periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        i = None if i == 3 else i
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(("" if i is None else str(i)).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(words) if n < 1000 else periodic_runs.runs_of(words, dense=0)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        kept = [w for j, w in enumerate(words) if not any(s + q <= j < s + m for s, m, q in runs)]
        row = got[i]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_no_documents_have_no_runs(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs))).count() == 0


# -- URL filter ---------------------------------------------------------------------------------------------------------
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr", "block"), ("ORG", "/fr/", "allow")]
LISTED = ["bad.example.com/", "x.org/p/q", "x.org/p", "UPPER.com/A"]


def plain_verdict(url, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = lambda h, p, path: host and (host == h or host.endswith("." + h)) and path.startswith(p)
    rules = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in RULES if fits(h.lower(), p, path)]
    listed = any(fits(u.split("/", 1)[0].lower(), "/" + u.partition("/")[2], path or "/") for u in LISTED)
    best = max(rules, default=None)
    return host, path, best and best[2], best[3] if best else "block" if listed else default


URLS = [None, "", "no scheme", "http://", "http://x.net", "http://x.net/", "https://EXAMPLE.net/en/1?u=2", "https://www.example.net/en#x", "ftp://example.com/de/a", "http://notexample.com/de/", "http://b.a.org/fr/x", "http://a.org/fr",
        "http://bad.example.com", "http://w.bad.example.com?x", "http://x.org/p/q/r", "http://x.org/", "http://xx.org/p", "http://upper.com/A", "http://upper.com/a", "http://..net/", "s://h#f://net/", "http://u@x.net:80/", "http://é.net/fr/",
        "http://" + "a." * 300 + "net/" + "p" * 5000]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_verdicts_equal_the_plain_rules(spark, broadcast):
    pages = spark.createDataFrame([(i % 40, u, "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    got = url_filter.judge_urls(pages, url_filter.entries(spark, RULES, LISTED), broadcast_entries=broadcast).collect()
    want = [(i % 40, *plain_verdict(u)) for i, u in enumerate(URLS * 2)]
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, want))


def test_filter_forgets_no_key_and_passes_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("rule h"), "id").alias("key"))
    words, blocks = url_filter.bloom_filter(keys, 20_000)
    passed = lambda frame: frame.filter(url_filter.may_hold(words.scalar(), blocks, F.col("key"))).count()
    assert passed(keys) == 20_000
    assert passed(spark.range(20_000).select(F.concat(F.lit("rule g"), "id").alias("key"))) < 200


def test_empty_list_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert url_filter.judge_urls(pages, url_filter.entries(spark, [])).first().verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0), url_filter.entries(spark, RULES)).count() == 0


def test_filter_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    plan = url_filter.judge_urls(pages, url_filter.entries(spark, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


# -- conversation repair ------------------------------------------------------------------------------------------------
def cheapest(rows):
    """Cost and edits by Dijkstra's search over (cost, edits)."""
    c, n = conversation, len(rows) // 2
    queue, best = [(0, "", 0, c.NOTHING)], {}
    while queue:
        cost, edits, i, place = heapq.heappop(queue)
        if i == n and place in (c.NOTHING, c.ASSISTANT):
            return cost, edits
        if best.get((i, place), (c.NEVER, "")) <= (cost, edits):
            continue
        best[i, place] = cost, edits
        if i < n:
            initial, fault = rows[2 * i], rows[2 * i + 1]
            heapq.heappush(queue, (cost + 4, edits + "D", i + 1, place))
            if fault not in "bd":
                heapq.heappush(queue, (cost + 3 + 3 * (fault == "t"), edits + "R", i + 1, c.NEXT[place]))
                if (initial, place) in c.KEEP:
                    heapq.heappush(queue, (cost + 3 * (fault == "t"), edits + "K", i + 1, c.KEEP[initial, place]))
        heapq.heappush(queue, (cost + 3, edits + "I", i, c.NEXT[place]))


def test_search_is_cheapest_and_least_and_blocks_chain():
    draw = random.Random(1)
    for _ in range(3000):
        n = draw.randint(0, 9)
        rows = "".join(draw.choice("ssuuuaaa?") + draw.choice("...bdt") for _ in range(n))
        want = cheapest(rows)
        assert conversation.search(rows) == want
        for k in (1, 2, 4):
            assert not n or conversation.chain([conversation.block_table(rows[2 * i : 2 * (i + k)]) for i in range(0, n, k)]) == want


def plain_repair(rows):
    """rows: (turn, role, text) in any order; the counts, cost, edits and repaired turns by plain code."""
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
    seen, codes = set(), ""
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        codes += role[:1] if role[:1] in ("s", "u", "a") else "?"
        codes += "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "."
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = codes[0::2]
    cost, edits = cheapest(codes)
    kept = [(r, t) for _, r, t in conversation.apply_edits(iter(edits), iter([(r, t) for _, r, t in rows]))]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept))
    faults = codes[1::2]
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, edits, kept


def plain_damage(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if kind == 0:
        return []
    return [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)


@pytest.mark.parametrize("block", [2, 64])
def test_repair_of_tables(spark, block):
    if block == 2:  # small partitions stay apart, so the long conversation lies in several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    draw = random.Random(7)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(draw.choice([0, 1, 2, 5, 9])):
            rows.append((conv, draw.choice([turn, turn, turn + 2, None]), draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), draw.choice(["Hello.", "ok", "why?\n", None, "", " ", "long " * 2000 + "!"])))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(400)]  # one conversation with most rows
    rows += [(1001, 5, "user", "Same.")] * 30
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, kind int")
    got = {r.conv_id: r for r in conversation.repair(conversation.damaged(table.repartition(7)), table, block).collect()}
    assert set(got) == {r[0] for r in rows}
    if block == 2:
        normal = conversation._normal(conversation.damaged(table))
        assert conversation._segments(normal, block).filter("conv_id = 1000").count() > 1
    turns = {}
    for r in conversation.repaired_turns(conversation.damaged(table), block).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for conv, row in got.items():
        *counts, edits, kept = plain_repair([x for r in rows if r[0] == conv for x in plain_damage(*r)])
        assert ([row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost], row.audit) == (counts, edits), conv
        assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        assert [(r, t) for _, r, t in sorted(turns.get(conv, []))] == kept
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversation.repair(conversation.damaged(none), none).count() == 0
