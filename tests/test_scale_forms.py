"""The forms that keep large inputs cheap give what the plain forms give."""
import json
import os
import random
import re
from difflib import SequenceMatcher
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from harrow.config import DEFAULT, TEST, USER_AGENT
from harrow.functions import staging
from harrow.functions.staging import RunScope, probable_members, staged
from harrow.functions.text import strip_removed_elements
from harrow.operators import crawl
from harrow.operators.crawl import crawl_visits
from harrow.operators.dedupe import leaders_of, may_be_similar, settled_keys
from harrow.plans.derived import derived_edges
from harrow.plans.job import run_job
from harrow.sources.pages import in_domains, match_domains
from harrow.sources.robots import robots_flag, robots_rules
from harrow.sources.sinks import read_report, write_reports
from harrow.sources.targets import clean_targets, read_targets

TARGETS = "target_idx long, name string, country string, seed_url string, allowed_domain string, notes string"


# -- crawl -------------------------------------------------------------------
@pytest.mark.parametrize("named", [1000, 0])
def test_a_level_writes_only_its_own_visits(spark, monkeypatch, named):
    monkeypatch.setattr(crawl, "NAMED_TARGETS", named)
    depth = 40 if named else 6
    # One long chain whose pages all link back, and a site that ends at once.
    pages = [(f"https://a.test/p{i:03d}", True, [f"https://a.test/p{i + 1:03d}", "https://a.test/p000", f"https://a.test/p{i // 2:03d}"]) for i in range(depth)]
    pages.append(("https://b.test/p", True, ["https://b.test/p"]))
    targets = [(0, "A", "X", "https://a.test/p000", "a.test", ""), (1, "B", "X", "https://b.test/p", "b.test", "")]
    with RunScope(spark) as scope:
        visits = crawl_visits(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(pages, "url string, is_html boolean, links array<string>"),
                              TEST.with_(max_depth=None, url_hints=["/p"]))
    got = sorted((r["target_idx"], r["visit_rank"], r["depth"], r["url"]) for r in visits.collect())
    assert got == [(0, i + 1, i, f"https://a.test/p{i:03d}") for i in range(depth + 1)] + [(1, 1, 0, "https://b.test/p")]
    folder, = (f"{scope.folder}/{f}" for f in os.listdir(scope.folder) if f.startswith("visits"))
    rows = {int(d.split("=")[1]): spark.read.parquet(f"{folder}/{d}").count() for d in os.listdir(folder) if d.startswith("depth=")}
    assert rows == {d: 1 + (d == 0) if d <= depth else 0 for d in range(depth + 2)}


def test_two_levels_of_hubs_reach_every_capture(spark):
    sizes = {"one": 1, "two": 2, "three": 3, "ten": 10, "odd": 37, "big": 130}
    rows = [(i, f"https://{s}.test/en/{s}-{i}") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    # Pages that a crawl skips don't stand in for hubs.
    rows += [(1000 + i, f"https://odd.test/{i}.png") for i in range(20)] + [(-5 - i, f"https://odd.test/first{i}.zip") for i in range(9)]
    df = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string")
    edges = {}
    for r in derived_edges(df.repartition(4)).collect():
        edges.setdefault(r["src"], set()).add(r["dst"])
    for s, n in sizes.items():
        own = [u for _, u in rows if f"//{s}.test" in u]
        seed, queued = min(own), [u for u in own if not u.endswith((".png", ".zip"))]
        step = max(1, round(len(own) ** 0.5))
        hubs = edges[seed] - {seed} | {seed}
        reached = hubs | {v for u in hubs if u in queued or u == seed for v in edges.get(u, ())}
        assert set(queued) <= reached and all(len(v) <= 2 * step + 2 for u, v in edges.items() if u in own)


def test_following_captures_are_linked_beside_the_hubs(spark):
    rows = [(i, f"https://s.test/en/{(i * 7) % 30}") for i in range(30)] + [(100 + i, f"https://t.test/en/{i}") for i in range(2)]
    df = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string").repartition(4)
    pairs = {tuple(r) for r in derived_edges(df, 3).collect()}
    chain = {(u, v) for i, u in rows for j, v in rows if u[:14] == v[:14] and 0 < j - i <= 3}
    assert pairs == chain | {tuple(r) for r in derived_edges(df).collect()} and len(chain) == 27 * 3 + 2 + 1 + 1


# -- robots --------------------------------------------------------------------
def test_many_rules_of_few_lengths_match_stdlib(spark):
    rng = random.Random(8)
    part = lambda: rng.choice(["a", "b", "é", "%41", "x y", "c?d", "*", "q=1"])
    bodies = ["User-agent: *\n" + "\n".join(f"{rng.choice(['Allow', 'Disallow'])}: /{'/'.join(part() for _ in range(rng.randrange(3)))}" for _ in range(60))
              for _ in range(6)] + ["User-agent: *\nAllow: /a\nDisallow: *", "User-agent: *\nDisallow:\nDisallow: /a", "User-agent: *\nDisallow: /a?"]
    urls = [f"https://h.test/{'/'.join(part() for _ in range(rng.randrange(4)))}" for _ in range(80)] + ["https://h.test", "https://h.test?x"]
    urls = sorted(set(urls))
    rules = robots_rules(spark.createDataFrame([(i, 200, b) for i, b in enumerate(bodies)], "target_idx long, status int, body string"), TEST)
    visits = spark.createDataFrame([(i, u) for i in range(len(bodies) + 1) for u in urls], "target_idx long, url string")
    got = {(r["target_idx"], r["url"]): r["allowed"] for r in robots_flag(visits, rules, TEST).collect()}
    assert len(got) == (len(bodies) + 1) * len(urls) and all(got[(len(bodies), u)] for u in urls)
    for i, body in enumerate(bodies):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        assert {u: got[(i, u)] for u in urls} == {u: parser.can_fetch(USER_AGENT, u) for u in urls}, i


# -- domains and bitmaps ---------------------------------------------------------
def test_hot_suffixes_and_hot_domains(spark):
    rng = random.Random(9)
    hosts = [f"h{rng.randrange(300)}.{rng.choice(['big.test'] * 6 + ['x.test', 'y.z.test', 'k.org', 'org'])}" for _ in range(3000)]
    keys = spark.createDataFrame([(i, f"{rng.choice(['https', 'http', 'ftp'])}://{rng.choice(['', 'www.'])}{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    names = ["big.test", "h1.big.test", "z.test", "k.org", "none.example", "h" * 300 + ".test"]
    domains = spark.createDataFrame([(i, d) for i, d in enumerate(names)], "target_idx long, domain string")
    want = sorted((i, t) for i, h in enumerate(hosts) for t, d in enumerate(names) if h == d or h.endswith("." + d))
    long = match_domains(keys, domains)
    short = match_domains(keys, domains.filter("length(domain) < 200"))
    assert "BroadcastHashJoin" in short._jdf.queryExecution().executedPlan().toString()
    for out in (long, short, match_domains(keys, domains, 0)):
        assert sorted((r["page_id"], r["target_idx"]) for r in out.collect()) == want
    web = {r["page_id"] for r in keys.filter("url not like 'ftp%'").collect()}
    for few in (50_000, 0):
        assert {r["page_id"] for r in in_domains(keys, domains, few).collect()} == {i for i, _ in want} & web


def test_bitmaps_lose_no_member(spark):
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    keys = df.filter("id % 50 = 3")
    for bits in (26, 16):
        kept = {r["id"] for r in probable_members(df, F.col("h"), keys, F.col("h"), bits).select("id").collect()}
        assert {i for i in range(20_000) if i % 50 == 3} <= kept and len(kept) < (410 if bits == 26 else 2000)
    assert probable_members(df, F.col("h"), keys.filter("false"), F.col("h")).count() == 0


# -- removed elements --------------------------------------------------------------
TAG = re.compile(r"(?i)</?(?:noscript|svg|form)(?![A-Za-z0-9-])[^>]*>")


def outside(markup):
    tags, texts = TAG.findall(markup), TAG.split(markup)
    open_, kept = [], texts[:1]
    for tag, text in zip(tags, texts[1:]):
        name = re.match("</?([A-Za-z]+)", tag).group(1).lower()
        if tag.startswith("</"):
            while name in open_ and open_.pop() != name:
                pass
        elif not tag.endswith("/>"):
            open_.append(name)
        if not open_:
            kept.append(text)
    return " ".join(kept) if tags else markup


def test_removed_elements_of_many_tags(spark):
    rng = random.Random(3)
    some = ["<form>", "</form>", "<svg a='b'>", "</SVG>", "<noscript>", "</noscript>", "<form/>", "x", "y ", "<p>", "<formula>"]
    rows = [(k, "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 5, 20, 300, 900])))) for k in range(200)]
    rows += [(1000, "<form>a</form>b" * 3000), (1001, "<form>a" * 3000 + "</form>" * 2999 + "in</FORM>out"), (1002, "<form><svg>" * 500 + "</form>c" * 500 + "d")]
    got = spark.createDataFrame(rows, "i int, m string").select("i", strip_removed_elements(F.col("m")).alias("o")).collect()
    for (i, m), r in zip(rows, sorted(got, key=lambda r: r["i"])):
        assert r["i"] == i and r["o"] == outside(m), i


# -- leaders -----------------------------------------------------------------------
def serial(rows, t):
    out, leaders = {}, {}
    for block, key, rep in sorted(rows, key=lambda r: r[2]):
        own = leaders.setdefault(block, [])
        hit = next((r for r, k in own if SequenceMatcher(None, key, k).ratio() >= t), None)
        if hit is None:
            own.append((rep, key))
        out[rep] = rep if hit is None else hit
    return out


@pytest.mark.parametrize("batch,tile,scan", [(256, 1024, 1 << 20), (20, 30, 1 << 20), (300, 64, 10)])
def test_leaders_of_a_large_block_are_those_of_a_scan(spark, batch, tile, scan):
    rng = random.Random(17)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    # Chains of keys each like the next, groups of near copies, and keys like no other; one block has nearly all of them.
    names = {"a" * i + "b" * (40 - i) for i in range(41)} | {"x" * 250 + "y" * i for i in range(20)}
    while len(names) < 700:
        b = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = rng.choice("abcdefghé")
        names.add("".join(b))
    names = sorted(names)
    rng.shuffle(names)
    rows = [("a" if i % 25 else "b", k, 3 * i + 1) for i, k in enumerate(names)]
    df = spark.createDataFrame([(b, "p", k, r) for b, k, r in rows], "bnet string, bpath string, key string, rep long").repartition(5)
    got = {r["rep"]: r["leader"] for r in leaders_of(df, 0.88, batch, tile, scan).collect()}
    assert got == serial(rows, 0.88)
    if scan == 10:
        assert {r["rep"]: r["leader"] for r in settled_keys(df, 0.7, tile, scan).collect()} == serial(rows, 0.7)


def test_bounds_never_exclude_a_similar_pair():
    rng = random.Random(4)
    keys = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(150)] + ["z" * 300, "z" * 290 + "y" * 10, "é" * 70_000]
    fits = may_be_similar(keys, keys, 0.8)
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            if len(a) + len(b) < 1000 and SequenceMatcher(None, a, b).ratio() >= 0.8:
                assert fits[i, j]
    assert fits[-1, -1] and not fits[-1, 0]


# -- reports and intermediate tables -------------------------------------------------
SITE = [("https://n.test", "<title>Summer School</title><a href='/summer'>s</a><p>summer program housing</p>"),
        ("https://n.test/summer", "<h1>Summer School</h1><p>Programme fee: 5. summer program</p>")]


def small_job(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE)], "page_id long, url string, html string")
    targets = clean_targets(spark.createDataFrame([(0, "N", "L", "https://n.test", "", "")], TARGETS))
    return run_job(targets, pages, DEFAULT)


def test_intermediate_tables_go_with_their_run(spark, tmp_path):
    r = small_job(spark)
    assert os.listdir(r.scope.folder)
    write_reports({"programmes": r.programmes, "run_log": r.run_log}, f"{tmp_path}/out", run=r.scope)
    assert not os.path.exists(r.scope.folder)
    assert spark.read.parquet(f"{tmp_path}/out/programmes").count() == 2 and read_report(spark, f"{tmp_path}/out", "run_log").count() == 1
    assert RunScope._current.get() is None and "run-" not in staging.scratch(spark, "x").rsplit("/", 1)[0]


def test_reports_are_committed_together(spark, tmp_path):
    out = str(tmp_path / "out")
    table = lambda v: {n: spark.createDataFrame([(v,)], "v int") for n in ("a", "b", "c", "d")}
    values = lambda: {n: read_report(spark, out, n).first()["v"] for n in ("a", "b", "c", "d")}
    with pytest.raises(ValueError, match="no written report"):
        read_report(spark, out, "a")
    write_reports(table(1), out)
    broken = table(2)
    broken["c"] = broken["c"].withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        write_reports(broken, out)
    assert values() == dict.fromkeys("abcd", 1) and spark.read.parquet(f"{out}/a").first()["v"] == 1
    write_reports(table(3), out)
    assert values() == dict.fromkeys("abcd", 3) and not os.path.exists(f"{out}/_runs")
    # A writer that was lost after the commit, with one of its tables moved.
    os.makedirs(f"{out}/_runs/r4")
    for n in "bcd":
        table(4)[n].write.parquet(f"{out}/_runs/r4/{n}")
    table(4)["a"].write.mode("overwrite").parquet(f"{out}/a")
    number = max(int(f.rsplit("-", 1)[1]) for f in os.listdir(out) if f.startswith("_manifest-"))
    with open(f"{out}/_manifest-{number + 1:010d}", "w") as f:
        json.dump({"run": "r4", "format": "parquet", "tables": list("abcd")}, f)
    assert values() == dict.fromkeys("abcd", 4)
    write_reports(table(5), out, "csv")
    assert {n: int(v) for n, v in values().items()} == dict.fromkeys("abcd", 5)


def test_targets_of_several_files_keep_their_order(spark, tmp_path):
    head = "University Name,Country,Seed URL,Allowed Domain,Notes\n"
    n = 0
    want = []
    for k, size in enumerate((3, 400, 1, 60)):
        lines = []
        for _ in range(size):
            lines.append(f'U{n:04d},C,https://u{n}.example/,,"{"x" * (9 if k != 1 else 300)}\nsecond"\n')
            want.append((n, f"U{n:04d}"))
            n += 1
        (tmp_path / f"part-{k}.csv").write_text(head + "".join(lines))
    got = [(r["target_idx"], r["name"]) for r in read_targets(spark, str(tmp_path)).orderBy("target_idx").collect()]
    assert got == want


def test_staged_tables_outside_of_a_run_stay(spark):
    df = staged(spark.range(3), "kept")
    with RunScope(spark) as scope:
        inner = staged(spark.range(2), "gone")
    scope.delete()
    assert df.count() == 3
    with pytest.raises(Exception):
        inner.count()
