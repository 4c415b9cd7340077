"""Structure of pages, and enrichment from captured payloads."""

import html
import json
import random
import re

from pyspark.sql import Observation
from pyspark.sql import functions as F

from lorebase.operators import enrich as N
from lorebase.plans import catalogue
from lorebase.sources.web import BLOCKS, HIDDEN, MAIN_CHARS, VOID, outline, outline_of


def plain_outline(page):
    """Brute force: every tag found by a pattern, the parts by counting from each element on."""
    events = []
    for m in re.finditer(r"<!--.*?-->|<!doctype[^>]*>|<(/?)([a-z][a-z0-9]*)([^>]*)>|[^<]+", page, re.S | re.I):
        if m[2]:
            events.append(("end" if m[1] else "start", m[2].lower(), m[3]))
        elif not m[0].startswith("<"):
            events.append(("text", html.unescape(m[0]), ""))
    title = next((events[i + 1][1] if events[i + 1][0] == "text" else "" for i, e in enumerate(events[:-1]) if e[:2] == ("start", "title")), "")

    def shown(start, end):
        out, hidden = [], 0
        for i, (kind, name, _) in enumerate(events):
            if kind != "text" and name in HIDDEN:
                hidden += 1 if kind == "start" else -1
            elif not hidden and start <= i < end:
                out.append(re.sub(r"\s+", " ", name) if kind == "text" else "\n" if name in BLOCKS else "")
        lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    def span(test):
        for i, e in enumerate(events):
            if e[0] == "start" and test(e):
                depth = 0
                for j in range(i, len(events)):
                    depth += {"start": 1, "end": -1, "text": 0}[events[j][0]] if events[j][1] == e[1] and events[j][0] != "text" else 0
                    if depth == 0:
                        return i, j + 1
                return i, len(events)
        return None

    whole = shown(*(span(lambda e: e[1] == "body") or (0, len(events))))
    for part, test in (("article", lambda e: e[1] == "article"), ("main", lambda e: e[1] == "main"), ("role", lambda e: 'role="main"' in e[2])):
        if (s := span(test)) and len(text := shown(*s)) > MAIN_CHARS:
            return " ".join(title.split()), part, text
    return " ".join(title.split()), "body", whole


def test_outline_of_all_pages_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = pages.select("html", outline(F.col("html")).alias("o")).collect()
    assert len(got) == 250
    for r in got:
        assert (r["o"]["title"], r["o"]["part"], r["o"]["content"]) == plain_outline(r["html"])
        assert [x["url"] for x in r["o"]["links"]] == re.findall(r'<a href="([^"]*)"', r["html"])
    asked = catalogue.QUERIES["page_outline"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((x["title"], x["part"], x["content_chars"]) for x in asked) == sorted((t, p, len(c)) for t, p, c in (plain_outline(r["html"]) for r in got))


def test_outline_of_random_malformed_pages():
    r = random.Random(4)
    names = ["article", "main", "div", 'div role="main"', "p", "b", "span", "section"]
    for _ in range(300):
        page = "<html><head><title>A &amp; b</title></head><body>"
        for _ in range(r.randint(0, 40)):
            tag = r.choice(names)
            page += r.choice((f"<{tag}>", f"</{tag.split()[0]}>", "word &lt; " * r.choice((1, 30, 60)), "<br>", "<!-- <main> -->", "<script>x</script>", "\n\n"))
        title, part, content = plain_outline(page)
        got = outline_of(page)
        assert (got["title"], got["part"], got["content"]) == (title, part, content)
    assert VOID.isdisjoint(HIDDEN)


def test_outline_of_odd_pages():
    empty = {"title": "", "description": "", "part": "body", "content": "", "text": "", "links": []}
    assert outline_of(None) == outline_of("") == outline_of("<!-- only -->") == empty
    o = outline_of("<title>T &amp; x</title><meta name=description content=' D '>plain <a href=u>one <b>two<a href='v'>three")
    assert o["text"] == "T & x\n\nD\n\nplain one twothree" and o["links"] == [{"url": "u", "text": "one two"}, {"url": "v", "text": "three"}]
    long = "<article>" + "<p>word word\n word" * 50_000
    assert outline_of(long)["content"].count("\n") == 49_999


def capture(i, payload, text=""):
    return (i, f"https://x.com/a/status/{i}", text, payload if isinstance(payload, str) or payload is None else json.dumps(payload))


def test_enrich_routes_each_payload(spark, tmp_path):
    talk = [{"role": "author", "author_handle": "@a", "text": "Which one?"}, {"role": "reply", "status_url": "https://x.com/b/status/2", "text": "  this  "}, {"role": "reply", "text": "this"}]
    image = lambda n, alt="": {"url": f"https://i.example/{n}.png", "alt": alt}
    link = lambda u, text="read": {"url": u, "text": text}
    full = {"url": "https://x.com/a/status/1?s", "title": "t", "content_text": " body ", "conversation_items": talk, "media": [image(1, "cat"), image(1), image(2), {"url": "https://i.example/page"}], "outbound_links": [link("https://ok.example/a"), link("https://gone.example/"), link("https://ok.example/a"), link("https://x.example/", "Privacy"), link("https://empty.example/")]}
    rows = [
        capture(1, full, "which one?"),
        capture(2, full, "a statement"),
        capture(3, "{broken"),
        capture(4, None),
        capture(5, {"content_text": "  ", "media": [image(1, "x")]}),
        capture(6, {"content_text": "plain", "media": "no list", "conversation_items": {"a": 1}, "outbound_links": [1]}),
        capture(7, "[1]"),
    ]
    captures = spark.createDataFrame(rows, "id long, status_url string, text string, payload string")
    pages = spark.createDataFrame([("https://ok.example/a", "https://ok.example/end", "<title>P</title><p>page"), ("https://empty.example/", "https://empty.example/", "")], "requested string, url string, html string")
    seen = Observation()
    out = N.enrich(captures, pages)
    out.observe(seen, *N.counters(out)).write.parquet(f"{tmp_path}/o")
    got = {(r["id"], r["source_type"], r["source_url"]): (r["state"], r["content"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    said = "X thread/reply context\n[author] @a\nWhich one?\n\n[reply] https://x.com/b/status/2\nthis"
    want = {}
    for i in (1, 2):
        want |= {
            (i, "x-status", "https://x.com/a/status/1?s"): ("enriched", "body"),
            (i, "image-analysis", "https://i.example/1.png"): ("enriched", "cat"),
            (i, "image-analysis", "https://i.example/2.png"): ("skipped", ""),
            (i, "linked-page", "https://ok.example/end"): ("enriched", "P\n\npage"),
            (i, "linked-page", "https://gone.example/"): ("failed", ""),
            (i, "linked-page", "https://empty.example/"): ("skipped", ""),
        }
    want[1, "x-conversation", "https://x.com/a/status/1?s#conversation"] = ("enriched", said)
    want |= {(i, "x-status", f"https://x.com/a/status/{i}"): ("failed", "") for i in (3, 4, 7)}
    want[5, "x-status", "https://x.com/a/status/5"] = ("skipped", "")
    want[6, "x-status", "https://x.com/a/status/6"] = ("enriched", "plain")
    assert got == want
    assert seen.get == {"enriched": 5, "conversations": 1, "media_analyzed": 2, "skipped": 5, "failed": 5}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # captures once, pages once
    counts = lambda how: N.enrich(captures, pages, **how).where("source_type = 'x-conversation'").count()
    assert counts({"thread": "always"}) == 2 and counts({"thread": "never"}) == 0
    again = N.enrich(captures, pages, stored=out.where("state = 'enriched' AND id = 1"))
    states = {(r["id"], r["state"]): r["n"] for r in again.groupBy("id", "state").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert states[1, "skipped"] == 6 and states[1, "failed"] == 1 and states[2, "enriched"] == 3
    assert N.enrich(captures.limit(0), pages).count() == 0


def test_outlines_of_some_fields_only(spark):
    d = spark.createDataFrame([("<title>T</title><body><p>one<a href=x>two</a></body>",), (None,)], "html string")
    got = [r["o"].asDict() for r in d.select(outline(F.col("html"), "title", "text").alias("o")).collect()]
    assert got == [{"title": "T", "text": "T\n\nonetwo"}, {"title": "", "text": ""}]
