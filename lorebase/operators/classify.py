"""Classification, tags and rationale of texts with links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.functions.patterns import held
from lorebase.functions.taxonomy import DEFAULT, Taxonomy


def _rows(rows: list[tuple], names: tuple[str, ...], types: str) -> Column:
    """A literal array of structs."""
    if not rows:
        return F.array().cast(f"array<struct<{types}>>")
    return F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in rows])


POINT = "struct<place:int,weight:double,signal:string>"


def _keyword_points(low: Column, taxonomy: Taxonomy) -> Column:
    """(place, weight, signal) of every keyword found: all in one pass over the text."""
    rows = taxonomy.weights()
    kinds = (pa.int32(), pa.float64(), pa.string())
    columns = zip(*[(p, float(w), f"keyword:{k}") for p, _, k, w in rows]) if rows else ((), (), ())
    points = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["place", "weight", "signal"])
    return held(low, [k for _, _, k, _ in rows], points, POINT)


def _points(found: Column, urls: Column | None, taxonomy: Taxonomy) -> Column:
    """``found``, and a point for every domain and kind of link."""
    point = lambda p, w, signal: F.struct(F.lit(p).alias("place"), F.lit(float(w)).alias("weight"), signal.alias("signal"))
    some = lambda rows: F.filter(F.array(*rows), lambda p: p.isNotNull()) if rows else F.array().cast(f"array<{POINT}>")
    as_point = lambda k: F.struct(k["place"].alias("place"), k["weight"].alias("weight"), k["signal"].alias("signal"))
    if urls is None:
        return found
    place = {c: i for i, c in enumerate(taxonomy.categories)}
    boosts = _rows([(place[c], float(x), f"domain:{d}", d) for d, own in taxonomy.boosts.items() for c, x in own.items() if c in place], ("place", "weight", "signal", "domain"), "place:int,weight:double,signal:string,domain:string")
    by_domain = F.flatten(F.transform(urls, lambda u: X.bind(X.link_domain(u), lambda d: F.transform(F.filter(boosts, lambda b: b["domain"] == d), as_point))))
    joined = F.array_join(urls, " ")
    repo = F.regexp_extract(joined, r"github\.com/[A-Za-z0-9_-]+/([A-Za-z0-9_.-]+)", 1)
    named = repo != ""
    code = named | F.contains(joined, F.lit("/repo/"))
    extra = [("coding", code, 2.0, F.lit("github-repo")), ("open-source", code, 1.5, F.lit("github-repo")), ("papers", F.contains(joined, F.lit("arxiv.org")), 3.0, F.lit("arxiv-link")), ("coding", named, 1.0, F.concat(F.lit("repo:"), repo))]
    return F.concat(found, by_domain, some([F.when(t, point(place[c], w, n)) for c, t, w, n in extra if c in place]))


def _ranked(points: Column, taxonomy: Taxonomy) -> Column:
    """(minus score, place, slug, signals) of the categories with points, best first."""
    categories = _rows(list(enumerate(taxonomy.categories)), ("place", "slug"), "place:int,slug:string")

    def score(c: Column) -> Column:
        def of(own: Column) -> Column:
            total = F.aggregate(own, F.lit(0.0), lambda a, p: a + p["weight"])
            return F.struct((-total).alias("minus"), c["place"].alias("place"), c["slug"].alias("slug"), F.transform(own, lambda p: p["signal"]).alias("signals"))

        return X.bind(F.filter(points, lambda p: p["place"] == c["place"]), of)

    return F.array_sort(F.filter(F.transform(categories, score), lambda s: s["minus"] < 0))


def _labels(ranked: Column) -> Column:
    def shares(total: Column) -> Column:
        share = lambda s: F.round(F.least(F.lit(0.95), F.lit(0.3) + (s["minus"] / total) * F.lit(0.65)), 3)
        return F.transform(F.slice(ranked, 1, 5), lambda s: F.struct(s["slug"].alias("slug"), share(s).alias("confidence"), F.array_join(F.slice(s["signals"], 1, 3), "; ").alias("rationale")))

    return X.bind(F.aggregate(ranked, F.lit(0.0), lambda a, s: a + s["minus"]), shares)


def classify(df: DataFrame, text: str = "text", links: str | None = None, taxonomy: Taxonomy = DEFAULT) -> DataFrame:
    """``df`` with ``labels`` (the five best: slug, confidence, rationale), ``primary``,
    ``confidence`` and ``needs_review``. Equal scores keep the taxonomy's order.

    Keywords are substrings, found by one automaton. What follows is one
    expression of the row in which each step is bound once: the optimizer must
    not copy the scores into each of their uses."""
    urls = F.coalesce(F.col(links), F.array().cast("array<string>")) if links else None

    def result(labels: Column) -> Column:
        best = F.get(labels, F.lit(0))
        primary, confidence = F.coalesce(best["slug"], F.lit("misc")), F.coalesce(best["confidence"], F.lit(0.1))
        sure = F.exists(labels, lambda x: x["confidence"] > 0.4)
        return F.struct(labels.alias("labels"), primary.alias("primary"), confidence.alias("confidence"), ((primary == "misc") | (confidence < 0.45) | ~sure).alias("needs_review"))

    keywords = df.withColumn("__k", _keyword_points(F.lower(F.coalesce(F.col(text), F.lit(""))), taxonomy))
    whole = X.bind(_points(F.col("__k"), urls, taxonomy), lambda p: X.bind(_ranked(p, taxonomy), lambda r: X.bind(_labels(r), result)))
    return keywords.withColumn("__c", whole).select(*df.columns, "__c.labels", "__c.primary", "__c.confidence", "__c.needs_review")


def tags(text: Column, primary: Column, links: Column | None = None) -> Column:
    stems = F.transform(links, lambda u: F.split_part(X.link_domain(u), F.lit("."), F.lit(1))) if links is not None else F.array().cast("array<string>")
    question = F.when(X.looks_like_question(text), F.array(F.lit("question"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(primary), X.top_terms(text), F.filter(stems, lambda s: s != ""), question)
    return F.slice(F.array_sort(F.array_distinct(every)), 1, 12)


def why_it_matters(text: Column, primary: Column, links: Column | None = None) -> Column:
    domains = F.array_sort(F.array_distinct(F.filter(F.transform(links, X.link_domain), lambda d: d != ""))) if links is not None else F.array().cast("array<string>")
    # The sentences below are fixed values.
    suffix = F.when(F.size(domains) > 0, F.concat(F.lit(" Links out to "), F.array_join(F.slice(domains, 1, 3), ", "), F.lit("."))).otherwise(F.lit(""))
    return (
        F.when(X.looks_like_question(text), F.lit("This bookmark asks a question, so captured thread and reply context can turn the discussion into reusable knowledge."))
        .when(primary == "misc", F.lit("Potentially useful bookmark, but it needs manual review before it becomes durable knowledge."))
        .otherwise(F.concat(F.lit("Useful for the "), F.replace(primary, F.lit("-"), F.lit(" ")), F.lit(" knowledge area because it captures a reusable idea, tool, or reference."), suffix))
    )
