import os
import random

import pytest
from pyspark.sql import functions as F

from inkweave import session as S
from inkweave.functions import urls
from inkweave.operators import graph as G
from inkweave.operators import links as L
from inkweave.operators.jobs import JOB_SCHEMA, with_scope
from inkweave.operators.ordered import numbered_by_range


def tables(spark, edges, ok, seeds):
    return (spark.createDataFrame(edges, "job_id string, src string, dst string, pos int"),
            spark.createDataFrame([(u, "ok") for u in ok], "url string, outcome string"),
            spark.createDataFrame(seeds, "job_id string, url string, max_pages int"))


def walk(spark, edges, ok, seeds, **kw):
    rows = G.crawl(*tables(spark, edges, ok, seeds), **kw).collect()
    return {(r.job_id, r.url): r for r in rows}


def test_crawl_shapes(spark):
    edges = [("j", "1", "2", 0), ("j", "1", "3", 1), ("j", "2", "4", 0), ("j", "3", "4", 0), ("j", "4", "1", 0),
             ("j", "1", "9", 2), ("k", "4", "1", 0), ("k", "1", "2", 0), ("j", "1", "1", 3)]
    got = walk(spark, edges, ["1", "2", "3", "4", "5"], [("j", "1", 100), ("k", "4", 2)])
    assert {u: (r.depth, r.queue_pos) for (j, u), r in got.items() if j == "j"} == {
        "1": (0, 1), "2": (1, 2), "3": (1, 3), "9": (1, 4), "4": (2, 5)}
    assert got["j", "4"].parent_pos == 2 and got["j", "4"].crawl_pos == 4 and got["j", "9"].state == "failed"
    # The limit is reached at page 1, whose links are not followed.
    assert {u: r.state for (j, u), r in got.items() if j == "k"} == {"4": "crawled", "1": "crawled"}


def test_limit_leaves_the_rest_queued(spark):
    edges = [("j", "0", str(n), n) for n in range(1, 9)]
    got = walk(spark, edges, [str(n) for n in range(9) if n != 2], [("j", "0", 4)])
    assert {u: r.state for (_, u), r in got.items()} == {
        "0": "crawled", "1": "crawled", "2": "failed", "3": "crawled", "4": "crawled",
        "5": "queued", "6": "queued", "7": "queued", "8": "queued"}


def test_long_chain_folds_visited(spark, monkeypatch):
    monkeypatch.setattr(G, "FOLD_EVERY", 2)
    edges = [("j", str(n), str(n + 1), 0) for n in range(5)] + [("j", "5", "0", 0)]
    got = walk(spark, edges, [str(n) for n in range(6)], [("j", "0", 100)])
    assert sorted((int(u), r.depth) for (_, u), r in got.items()) == [(n, n) for n in range(6)]


def test_reachable_and_status(spark):
    edges, nodes, seeds = tables(spark, [("j", "1", "2", 0), ("j", "2", "1", 0), ("j", "2", "9", 0), ("j", "9", "3", 0)],
                                 ["1", "2", "3"], [("j", "1", 1), ("m", "8", 1)])
    assert sorted(r.url for r in G.reachable(edges, nodes.select("url"), seeds).collect()) == ["1", "2"]
    assert {r.job_id: r.in_graph for r in G.seed_status(seeds, nodes).collect()} == {"j": True, "m": False}


def test_strict_budget(spark):
    reached = spark.createDataFrame([(j, f"u{n}") for j in ("a", "b") for n in range(10)], "job_id string, url string")
    limits = spark.createDataFrame([("a", 10), ("b", 10)], "job_id string, max_pages int")
    found = spark.createDataFrame([("a", 6), ("b", 10)], "job_id string, n_discovered int")
    rows = G.save_order(reached, found, limits).orderBy("job_id", "save_pos").collect()
    assert [(r.job_id, r.url, r.save_pos) for r in rows] == [("a", f"u{n}", n + 1) for n in range(4)]
    assert G.save_order(reached, found, limits, strict=False).count() == 20


def test_navigation_or_discovery(spark):
    nav = spark.createDataFrame([("a", 0, "n")], "job_id string, pos int, url string")
    discovery = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "job_id string, pos int, url string")
    got = sorted((r.job_id, r.url, r.source) for r in G.navigation_or_discovery(nav, discovery).collect())
    assert got == [("a", "n", "nav"), ("b", "y", "discovery")]


PAGE = """<!-- <a href="/no">c</a> --><a href="/a">A</a><NAV class=x><a href='/n1?x=1&amp;y=2'>N</a><nav><a href="/n2">N</a></nav>
<a href="/n3">N</a></NAV><a href="/b">B</a><div class="my-sidebar"><div><a href=/d1>D</a></div><a href="/d2">D</a></div>
<a>none</a><section class="big toc"><a href="#t">T</a></section><ul class="navlist"><li><a href="mailto:x@y">M</a></ul>
<a href="https://other/z">o</a><script>"<a href='/js'>"</script><a href="/a#frag">A2</a>"""


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://h/x", PAGE)], "page_id long, url string, html string")
    links = L.extract_links(pages)
    found = {r.pos: r.href for r in links.collect()}
    assert [found[k] for k in sorted(found)] == [
        "/a", "/n1?x=1&y=2", "/n2", "/n3", "/b", "/d1", "/d2", "#t", "mailto:x@y", "https://other/z", "/a#frag"]
    assert 7 not in found

    def nav(profile):
        return [r.href for r in L.navigation_links(pages, profile).orderBy("pos").collect()]

    assert nav("v2") == ["/n1?x=1&y=2", "/n2", "/n3", "/d1", "/d2", "#t", "mailto:x@y"]
    assert nav("v1") == ["/n1?x=1&y=2", "/n2", "/n3", "#t"]
    positions = {r.href: r.pos for r in L.navigation_links(pages).collect()}
    assert all(found[p] == h for h, p in positions.items())
    jobs = with_scope(spark.createDataFrame([("j", "https://h/", None, None, 9, "zip", False)], JOB_SCHEMA))
    v2 = {r.dst: r.pos for r in L.job_edges(links, jobs, "v2").collect()}
    assert set(v2) == {f"https://h{p}" for p in ("/a", "/n1?x=1&y=2", "/n2", "/n3", "/b", "/d1", "/d2", "/x")}
    assert v2["https://h/a"] == 0
    v1 = {r.dst for r in L.job_edges(links, jobs, "v1").collect()}
    assert v1 == {f"https://h{p}" for p in ("/a", "/n1?x=1&y=2", "/n2", "/n3", "/b", "/d1", "/d2")}
    broken = {r.dst for r in L.broken_links(L.job_edges(links, jobs, "v2"), pages).collect()}
    assert "https://h/x" not in broken and "https://h/a" in broken


def test_salted_join_matches_plain_join(spark):
    from inkweave.operators.joins import salted_join
    large = spark.range(1000).select("id", F.lit("hot").alias("k"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "k string, v int")
    a = large.join(small, ["k"]).select("k", "id", "v")
    b = salted_join(large, small, ["k"], F.col("id"), salts=4).select("k", "id", "v")
    assert a.count() == b.count() == 2000 and a.exceptAll(b).count() == 0


def plain_crawl(edges, ok, seeds):
    """{(job, url): (depth, queue place, crawl place, state)} by a queue."""
    out = {}
    for job, seed, limit in seeds:
        links = {}
        for j, a, b, pos in sorted(edges, key=lambda e: e[3]):
            if j == job:
                links.setdefault(a, []).append(b)
        queue, depth, crawled, at = [seed], {seed: 0}, 0, 0
        states = {}
        while at < len(queue):
            url, at = queue[at], at + 1
            if crawled >= limit:
                states[url] = (None, "queued")
                continue
            if url not in ok:
                states[url] = (None, "failed")
                continue
            crawled += 1
            states[url] = (crawled, "crawled")
            for nxt in links.get(url, []) if crawled < limit else []:
                if nxt not in depth:
                    depth[nxt] = depth[url] + 1
                    queue.append(nxt)
        out.update({(job, u): (depth[u], k + 1, *states[u]) for k, u in enumerate(queue)})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_crawl_equals_a_queue(spark, monkeypatch, seed):
    monkeypatch.setattr(G, "FOLD_EVERY", 2)
    monkeypatch.setattr(G, "FAN_IN", 2)
    monkeypatch.setattr(G, "SMALL_FRONT", (0, 3, 100)[seed])
    r = random.Random(seed)
    edges = [(j, f"{a}", f"{b}", k) for j in "ab" for a in range(40) for k, b in enumerate(dict.fromkeys(min(45, a + r.choice([-9, 1, 1, 2, 7])) for _ in range(3)))]
    ok = [f"{n}" for n in range(44) if n % 9 != 4]
    seeds = [("a", "0", 1000), ("b", "3", 14), ("c", "0", 0), ("d", "none", 5)]
    got = {key: (r.depth, r.queue_pos, r.crawl_pos, r.state) for key, r in walk(spark, edges, ok, seeds).items()}
    assert got == plain_crawl(edges, set(ok), seeds)


def test_a_round_does_not_move_visited_pages(spark):
    with G.bucket_tables(spark) as bucketed:
        visited = G.Visited(spark, bucketed.base, "v INT")
        visited.add(spark.range(100).withColumn("v", F.lit(1)))
        visited.add(spark.range(100, 150).withColumn("v", F.lit(2)))
        found = spark.range(0, 300, 3).groupBy(F.col("id")).agg(F.count("*").alias("n"))
        new = visited.unseen(found)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert sorted(r.id for r in new.collect()) == list(range(150, 300, 3))


@pytest.mark.parametrize("seed", range(3))
def test_reachable_equals_a_search(spark, seed):
    r = random.Random(seed)
    chain = [("a", f"{n}", f"{n + 1}", 0) for n in range(60)] + [("a", "30", "2", 1), ("a", "61", "62", 0), ("a", "62", "61", 0), ("a", "20", "90", 1)] + [("a", f"{n}", f"{n + 1}", 0) for n in range(90, 100)] + [("a", "100", "55", 0)]
    loose = [("b", f"{r.randrange(70)}", f"{r.randrange(70)}", k) for k in range((60, 90, 150)[seed])]
    edges = chain + list({e[1:3]: e for e in loose}.values())
    nodes = [f"{n}" for n in range(105) if n % 41 != 40]
    seeds = [("a", "0", 1), ("b", "7", 1), ("c", "40", 1)]
    want = {}
    for job, start, _ in seeds:
        level, depth = ({start} & set(nodes)), 0
        while level:
            want.update({(job, u): depth for u in level})
            level = {b for j, a, b, _ in edges if j == job and a in level and b in nodes and (job, b) not in want}
            depth += 1
    e, n, s = tables(spark, edges, nodes, seeds)
    got = {(x.job_id, x.url): x.depth for x in G.reachable(e, n.select("url"), s).collect()}
    assert got == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    for owner, name in ((G, "stage"), (G.Visited, "add")):
        monkeypatch.setattr(owner, name, lambda *a, _f=getattr(owner, name), **k: (rounds.append(1), _f(*a, **k))[1])
    edges = [("j", f"{n}", f"{n + 1}", 0) for n in range(1000)]
    e, n, s = tables(spark, edges, [f"{n}" for n in range(1001)], [("j", "0", 1)])
    got = {x.url: x.depth for x in G.reachable(e, n.select("url"), s).collect()}
    assert got == {f"{n}": n for n in range(1001)} and len(rounds) <= 14  # 12 and the writes of pages and of the result


def test_width_of_a_walk_follows_its_edges(spark):
    """A small graph must not pay for the partitions of a large session."""
    edges = spark.createDataFrame([("j", "a", "b", 0)], "job_id string, src string, dst string, pos int")
    with S.sized(spark, 64):
        assert G.round_width(edges) == min(64, spark.sparkContext.defaultParallelism)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    with G.bucket_tables(spark) as bucketed:
        table = bucketed(spark.range(0, 1000, 1, 6).withColumnRenamed("id", "src"), "src", buckets=3)
        assert len(table.inputFiles()) == 3 and table.count() == 1000


def test_merged_batches_have_a_file_a_bucket(spark):
    with G.bucket_tables(spark) as bucketed:
        visited = G.Visited(spark, bucketed.base, "depth INT")
        for start in range(0, 90, 10):
            visited.add(spark.range(start, start + 10, 1, 5).withColumn("depth", F.lit(start)))
        visited.fold()
        assert len(visited.batches) == 2 and visited.all().count() == 90
        assert len(visited.batch(visited.batches[0][1]).inputFiles()) <= visited.buckets


def test_numbers_by_range_put_small_neighbours_together(spark):
    rows = spark.createDataFrame([("j", f"u{n:03}") for n in range(300)], "job_id string, url string")
    with S.sized(spark, 64):
        got = numbered_by_range(rows, ["job_id"], ["url"], "pos")
        files = [f for f in os.listdir(newest_stage(spark)) if f.startswith("part-")]
    assert len(files) < 64
    assert [(r.url, r.pos) for r in got.orderBy("pos").collect()] == [(f"u{n:03}", n + 1) for n in range(300)]


def newest_stage(spark):
    folder = S._stages(spark).removeprefix("file:")
    return max((os.path.join(folder, n) for n in os.listdir(folder)), key=os.path.getmtime)


def test_links_are_worked_out_once(spark):
    """Filters and joins above must not repeat the patterns that take a link out of its page."""
    pages = spark.createDataFrame([(1, "https://h/a", '<a href="/b#x">b</a><a name=n>n</a><a href=c/../d>d</a>')], "page_id long, url string, html string")
    got = L.resolve(L.extract_links(pages)).where((urls.host("dst") == "h") & (F.length("dst") > 3))
    assert sorted((r.pos, r.dst) for r in got.collect()) == [(0, "https://h/b"), (2, "https://h/d")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[\s" + "\"'/])href") == 1
