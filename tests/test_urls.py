"""Reference resolution, sitemap closures, the seeds phase, and the frontier's recovery."""

import os
import random

from pyspark.sql import functions as F

from larder.operators import crawl, urls
from larder.streaming import frontier

BASE = "http://a/b/c/d;p?q"
#: RFC 3986, 5.4.1 and 5.4.2 (strict).
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}
MORE = {("http://a", "g"): "http://a/g", ("http://a?x", "?y"): "http://a?y", ("http://a", ".."): "http://a/", ("https://a/b", "//c/../d"): "https://c/d", ("http://a/b/", "../c/./d/.."): "http://a/c/", (None, "g"): None, (BASE, None): None}


def test_the_rfcs_examples(spark):
    pairs = {(BASE, r): t for r, t in RFC.items()} | MORE
    df = spark.createDataFrame(list(pairs), "base string, reference string").select("base", "reference", urls.resolve(F.col("base"), F.col("reference")).alias("t"))
    assert {(r.base, r.reference): r.t for r in df.collect()} == pairs


def test_canonical_and_links(spark):
    page = lambda href: f"<link rel='canonical' href=\"{href}\">"
    rows = [("http://h/a/b?x", page("../c")), ("http://h/a/b", page("?z")), ("http://h/a", page("//k/x")), ("http://h/a", page("https://o/p")), ("http://h/a", "<p>none</p>"), ("http://h/a", page(" /s "))]
    got = [r.c for r in spark.createDataFrame(rows, "u string, h string").coalesce(1).select(crawl.canonical_url(F.col("u"), F.col("h")).alias("c")).collect()]
    assert got == ["http://h/c", "http://h/a/b?z", "http://k/x", "https://o/p", "http://h/a", "http://h/s"]


def xml(kind, inner, locs):
    return f'<{kind} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<{inner}><loc> {u} </loc></{inner}>" for u in locs) + f"</{kind}>"


def test_seeds(spark):
    """Three levels, a circle, a missing child, a sitemap that two indexes list, another agent's rules, a host without rules."""
    index, leaf = (lambda u: xml("sitemapindex", "sitemap", u)), (lambda u: xml("urlset", "url", u))
    maps = [
        ("http://m/root", index(["http://m/a", "http://m/b", "http://m/gone"])), ("http://m/a", index(["http://m/a1", "http://m/root"])), ("http://m/b", index(["http://m/a1", "http://m/b1"])),
        ("http://m/a1", leaf(["http://x/r/1", "http://x/r/2", "http://x/private/r/3", "http://x/about"])), ("http://m/b1", leaf(["http://x/r/2", "http://y/private/r/9"])), ("http://m/other", leaf(["http://x/r/77"])),
    ]
    lines = ["User-agent: *", "Disallow: /private*", "Sitemap: http://m/root", "User-agent: else", "Disallow: /r*"]
    robots = spark.createDataFrame([("x", i, t) for i, t in enumerate(lines)], "host string, line_no int, line string")
    maps = spark.createDataFrame(maps, "url string, xml string")
    found = urls.find_seeds(robots, maps, pattern=r"/r/\d+$")
    assert sorted(r.url for r in found.seeds.collect()) == ["http://x/r/1", "http://x/r/2", "http://y/private/r/9"]
    assert {r.url: r.depth for r in found.sitemaps.collect()} == {"http://m/root": 0, "http://m/a": 1, "http://m/b": 1, "http://m/a1": 2, "http://m/b1": 2}
    assert found.stats.first().asDict() == {"sitemaps_parsed": 5, "urls_seen": 6, "urls_recipe": 5, "urls_unique": 4, "urls_allowed": 3, "disallow_patterns": 1}
    bare = urls.find_seeds(robots.filter("line_no < 2"), maps, ["http://m/other"], r"/r/\d+$")
    assert [r.url for r in bare.seeds.collect()] == ["http://x/r/77"]
    none = urls.find_seeds(robots.limit(0), maps)
    assert none.seeds.count() == 0 and none.stats.first().sitemaps_parsed == 0


# -- the frontier --------------------------------------------------------------------------------

EVENTS = "url string, kind string, source string, priority int, seq long"


def fold(events, retries=3):
    """A frontier of one machine: queues, what was seen, what was given up."""
    queue, seen, failed, tried = {}, {}, set(), {}
    for url, kind, source, priority, seq in sorted(events, key=lambda e: e[4]):
        if kind == "enqueue" and url not in seen and url not in failed:
            seen[url] = queue[url] = (source, priority, seq)
        elif kind == "take":
            queue.pop(url, None)
        elif kind == "fail":
            if url in queue:
                tried[url] = tried.get(url, 0) + 1
            if url not in queue or tried[url] > retries:
                failed.add(url)
    return queue, seen, failed, tried


def some_events(n, seed=1):
    r = random.Random(seed)
    return [(f"u{r.randint(0, 40)}", r.choice(["enqueue", "enqueue", "take", "fail", "fail"]), r.choice("abc"), r.randint(0, 2), i) for i in range(n)]


def test_transitions_are_the_folds():
    for seed in range(30):
        events = [("u", *e[1:]) for e in some_events(12, seed)]
        queue, seen, failed, tried = fold(events)
        cut = random.Random(seed).randint(0, 12)
        state, accepted = None, 0
        for part in (events[:cut], events[cut:]):
            state, more, _ = frontier.transitions([(e[4], e[1], e[2], e[3]) for e in part], state)
            accepted += more
        assert (state is not None and state[3], accepted, state is not None and state[5], state[4] if state else 0) == ("u" in queue, len(seen), "u" in failed, tried.get("u", 0))


def test_replay_gives_the_same_queue(spark, tmp_path):
    """Three batches; then the last one's commit is lost, as in a failure after it was written, and the stream starts again."""
    events = some_events(240)
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    frame = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1)
    start = lambda: frontier.run_frontier(spark.readStream.schema(EVENTS).parquet(source), out, check).awaitTermination()

    def state():
        return sorted(map(tuple, frontier.load_frontier(spark, out).collect()), key=str)

    for at in (0, 80, 160):
        frame(events[at : at + 80]).write.mode("append").parquet(source)
        start()
    once = state()
    queue, seen, failed, tried = fold(events)
    assert {u: (s, p, q) for u, s, p, q, queued, *_ in once if queued} == queue
    assert {u for u, *_, bad, _ in once if bad} == failed and {u: t for u, _, _, _, _, t, *_ in once if t} == tried
    last = max(int(x) for x in os.listdir(f"{check}/commits") if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.remove(f"{check}/commits/{name}")
    start()
    assert state() == once
    loaded = frontier.load_frontier(spark, out)
    turns = [r.url for r in frontier.next_tasks(loaded, 7).collect()]
    ready = {s: [u for u, _ in sorted(((u, v) for u, v in queue.items() if v[0] == s and u not in failed), key=lambda x: (-x[1][1], x[1][2]))] for s in "abc"}
    assert turns == [ready[s][i] for i in range(50) for s in "abc" if i < len(ready[s])][:7]
    small = frontier.load_frontier(spark, out, max_size=5)
    first = sorted(seen, key=lambda u: seen[u][2])[:5]
    assert {r.url for r in small.filter("queued").collect()} == {u for u in first if u in queue}
    counts = {r.source: (r.queued, r.failed) for r in frontier.frontier_counts(loaded).collect()}
    assert sum(q for q, _ in counts.values()) == len(queue) and sum(f for _, f in counts.values()) == len(failed)
