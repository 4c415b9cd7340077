"""Derived tables: clusters, project ideas, junk candidates, media, conversations, graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.functions.taxonomy import AUDIENCES, label

#: Hosts and words of junk pages, and of links that lead nowhere useful (fixed values).
JUNK_HOSTS = ("business.x.com", "help.x.com", "ads.twitter.com", "analytics.twitter.com")
JUNK_WORDS = ("cookie", "cookies", "privacy", "terms", "ads", "advertising", "troubleshooting", "login", "signup")
BLOCKED_HOSTS = ("business.x.com", "x.com", "twitter.com", "mobile.twitter.com", "help.x.com", "ads.twitter.com", "analytics.twitter.com")
BLOCKED_TEXT = ("ads", "advertising", "analytics", "cookie", "cookies", "help", "privacy", "terms")
#: Words of trouble and the texts of project ideas (fixed values).
PROBLEMS = ("pain", "hard", "difficult", "slow", "annoying", "broken", "missing", "need", "want", "wish")


def clusters(labelled: DataFrame, entities: DataFrame, min_size: int = 3, min_confidence: float = 0.4, top: int = 5) -> DataFrame:
    """(id, category, cluster, score). ``labelled``: id, primary, confidence.

    A category with fewer than ``min_size`` rows is one cluster. Others split by
    their ``top`` most frequent entities (ties by name): a row goes to the most
    frequent that it has, else to General; parts below ``min_size`` are dropped.
    Only (category, entity) counts and the top names meet again with the rows."""
    sure = labelled.where(F.col("confidence") >= min_confidence).select("id", F.col("primary").alias("category"), F.col("confidence").alias("score"))
    named = entities.select("id", F.lower("name").alias("name")).distinct().join(sure, "id")
    order = Window.partitionBy("category").orderBy(F.col("n").desc(), "name")
    leading = named.groupBy("category", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    first = named.join(leading.select("category", "name", "rank"), ["category", "name"]).groupBy("id").agg(F.min_by("name", "rank").alias("name"))
    size = sure.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    parted = sure.join(first, "id", "left").join(size, "category")
    part = F.when(F.col("size") < min_size, F.lit("")).otherwise(F.coalesce(F.initcap("name"), F.lit("General")))
    parted = parted.withColumn("part", part)
    kept = parted.groupBy("category", "part").agg(F.count(F.lit(1)).alias("members")).where((F.col("members") >= min_size) | (F.col("part") == ""))
    joined = parted.join(kept.drop("members"), ["category", "part"])
    name = X.slugify(F.concat(F.lit("cluster-"), "category", F.lit("-"), F.when(F.col("part") == "", F.col("category")).otherwise(F.col("part"))))
    return joined.select("id", "category", name.alias("cluster"), "score")


def project_ideas(members: DataFrame, entities: DataFrame, min_evidence: int = 3, domains: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """One idea for each cluster whose majority category is of high signal and has
    enough members: cluster, category, title, one_liner, problem, audience, why_now, notes, members, confidence.

    members: id, category, cluster, score. entities: id, name. domains: id, domain. texts: id, text (for
    ``problem``: the first five members by score). The majority's share gives the confidence."""
    by_category = members.groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))
    total = by_category.groupBy("cluster").agg(F.sum("n").alias("members"), F.max(F.struct("n", "category")).alias("top"))
    high = total.select("cluster", "members", F.col("top.category").alias("category"), F.col("top.n").alias("n")).where(F.col("category").isin(*AUDIENCES) & (F.col("n") >= min_evidence))

    def most(rows: DataFrame, name: str, limit: int) -> DataFrame:
        """(cluster, ``name``): the most frequent names of each cluster."""
        counts = rows.select("id", F.lower(name).alias("x")).where("x <> ''").distinct().join(members.select("id", "cluster"), "id").groupBy("cluster", "x").agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), "x"))).where(F.col("rank") <= limit)
        return ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda r: r["x"]).alias(name))

    found = high.join(most(entities, "name", 5), "cluster", "left")
    found = found.join(most(domains, "domain", 3), "cluster", "left") if domains is not None else found.withColumn("domain", F.array().cast("array<string>"))
    said = F.array().cast("array<string>")
    if texts is not None:
        first = evidence(members, 5).join(texts.select("id", "text"), "id").groupBy("cluster").agg(F.collect_list(F.substring("text", 1, 200)).alias("said"))
        found, said = found.join(first, "cluster", "left"), F.coalesce("said", said)
    title_of = lambda e: F.when(F.length(e) > 2, F.initcap(e)).otherwise(F.upper(e))
    names, hosts = F.coalesce("name", F.array().cast("array<string>")), F.coalesce("domain", F.array().cast("array<string>"))
    first, second, host = F.get(names, F.lit(0)), F.get(names, F.lit(1)), F.get(hosts, F.lit(0))
    labels = F.create_map(*[F.lit(x) for c in AUDIENCES for x in (c, label(c))])
    audience = F.create_map(*[F.lit(x) for kv in AUDIENCES.items() for x in kv])
    space = F.replace(F.col("category"), F.lit("-"), F.lit(" "))
    title = F.when(second.isNotNull(), F.concat(title_of(first), F.lit(" x "), title_of(second))).when(first.isNotNull(), F.concat(title_of(first), F.lit(" Builder"))).otherwise(F.element_at(labels, F.col("category")))
    about = F.when(second.isNotNull(), F.concat(first, F.lit(" + "), second)).otherwise(F.coalesce(first, F.lit("this space")))
    across = F.coalesce(F.concat(F.lit(" (across "), host, F.lit(")")), F.lit(""))
    gaining = F.concat(first, F.lit(" is gaining traction"))
    listing = lambda lead, a, n: F.when(F.size(a) > 0, F.concat(F.lit(lead), F.array_join(F.slice(a, 1, n), ", ")))
    return found.select(
        "cluster",
        "category",
        title.alias("title"),
        F.concat(F.lit("Build something with "), about, across, F.lit(" - found in "), F.col("members").cast("string"), F.lit(" bookmarks.")).alias("one_liner"),
        problem(said, F.col("category")).alias("problem"),
        F.element_at(audience, F.col("category")).alias("audience"),
        F.concat(F.concat_ws(". ", gaining, F.lit("Bookmark count shows sustained interest")), F.lit(".")).alias("why_now"),
        F.concat_ws("\n", listing("Key technologies: ", names, 3), listing("Reference domains: ", hosts, 2), F.concat(F.lit("Start with a minimal viable feature in the "), space, F.lit(" space"))).alias("notes"),
        "members",
        F.least(F.lit(0.9), F.lit(0.3) + F.col("n") / F.col("members") * F.lit(0.4)).alias("confidence"),
    )


def evidence(members: DataFrame, most: int = 6) -> DataFrame:
    """(cluster, id): the first members of each cluster by score, then identifier."""
    order = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "id")
    return members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("cluster", "id")


def problem(texts: Column, category: Column) -> Column:
    """The word of trouble that most of the texts hold (ties by the first text that
    holds one, then by the list's order), or an opportunity."""
    space = F.replace(category, F.lit("-"), F.lit(" "))

    def said(low: Column) -> Column:
        hold = lambda w: F.transform(low, lambda t: F.contains(t, F.lit(w)))
        holds = [hold(w) for w in PROBLEMS]
        counts = [F.struct((-F.size(F.filter(h, lambda x: x))).alias("n"), F.array_position(h, True).alias("first"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, (w, h) in enumerate(zip(PROBLEMS, holds))]
        return F.get(F.array_sort(F.filter(F.array(*counts), lambda c: c["n"] < 0)), 0)["w"]

    word = said(F.transform(texts, F.lower))
    return F.coalesce(F.concat(F.lit("The "), space, F.lit(" space lacks good solutions for: "), word, F.lit(" problems.")), F.concat(F.lit("Opportunity to improve tooling in the "), space, F.lit(" area.")))


def junk_reason(urls: Column, titles: Column, most_chars: Column, least_chars: Column, compat: bool = False) -> Column:
    """Why a row's linked pages are junk, or an empty string. Words are whole
    tokens; with ``compat`` they are substrings."""
    host = F.lit(False)
    for h in JUNK_HOSTS:
        host = host | F.contains(F.lower(urls), F.lit(h))
    blob = F.lower(F.concat_ws(" ", urls, titles))
    word = blob.rlike("|".join(JUNK_WORDS)) if compat else blob.rlike(r"(^|[^a-z0-9])(" + "|".join(JUNK_WORDS) + ")([^a-z0-9]|$)")
    return F.when(host, "x-ad/help/cookie linked page").when(word & (most_chars < 1000), "thin policy/login/subscribe page").when((least_chars > 0) & (least_chars < 250), "very thin linked content").otherwise("")


def junk_candidates(enrichments: DataFrame, compat: bool = False) -> DataFrame:
    """(id, reason) from enrichments (id, url, title, content), one aggregation."""
    # Each URL and title of an identifier once, in partial aggregations before anything is gathered.
    size = enrichments.groupBy("id").agg(F.max(F.length("content")).alias("most"), F.min(F.length("content")).alias("least"))
    said = enrichments.select("id", "url", "title").distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("url")), " ").alias("urls"), F.array_join(F.array_sort(F.collect_set("title")), " ").alias("titles"))
    g = size.join(said, "id")
    return g.select("id", junk_reason(F.col("urls"), F.col("titles"), F.col("most"), F.col("least"), compat).alias("reason")).where("reason <> ''")


def outbound_links(links: Column, most: int = 3) -> Column:
    """Useful links of array<struct<url,text>>: no blocked hosts, texts or paths; first ones first."""
    def fine(x: Column) -> Column:
        url, said = x["url"], F.lower(F.coalesce(x["text"], F.lit("")))
        path = F.lower(X.url_path(url))
        bad = F.lit(False)
        for t in BLOCKED_TEXT:
            bad = bad | F.contains(said, F.lit(t))
        for p in ("/intent/", "/share", "/privacy", "/terms"):
            bad = bad | F.contains(path, F.lit(p))
        return url.rlike("^https?://") & ~X.link_domain(url).isin(*BLOCKED_HOSTS) & ~bad

    return F.slice(F.array_distinct(F.transform(F.filter(links, fine), lambda x: x["url"])), 1, most)


def content_image(url: Column) -> Column:
    host, path = X.link_domain(url), F.lower(X.url_path(url))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    own = host.isin("pbs.twimg.com", "ton.twimg.com")
    good = ~path.rlike("/profile_images/|/emoji/") & (path.rlike("/media/") | query.rlike("format=|name="))
    return url.rlike("^https?://") & F.when(own, good).otherwise(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"))


MEDIA = "struct<media:array<struct<url:string,alt:string>>>"


def media_records(enrichments: DataFrame) -> DataFrame:
    """(id, url, alt, place): media of the metadata JSON, the first of equal URLs of an id; broken JSON has none."""
    found = enrichments.where(F.contains("metadata", F.lit('"media"'))).select("id", "captured_at", F.posexplode(F.from_json("metadata", MEDIA)["media"]).alias("place", "m")).where("m.url <> ''")
    first = Window.partitionBy("id", "m.url").orderBy("captured_at", "place")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "m.url", F.coalesce("m.alt", F.lit("")).alias("alt"), "place")


def conversation(turns: DataFrame, most_items: int = 12, most_chars: int = 6000) -> DataFrame:
    """(conv_id, items, context): turns in order, texts that repeat (by their first 140
    characters) once, formatted; conversations with fewer than two items have none."""
    t = turns.withColumn("text", X.clean_text(F.col("text"))).where("text <> ''")
    once = Window.partitionBy("conv_id", F.substring("text", 1, 140)).orderBy("turn")
    t = t.withColumn("n", F.row_number().over(once)).where("n = 1")
    # Only the first items of a conversation are gathered; of the others the number counts.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    first = t.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_items)
    g = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    size = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("items")).where("items >= 2")
    line = F.transform("a", lambda x: F.concat(F.lit("["), x["role"], F.lit("]\n"), X.truncate(x["text"], 900)))
    return g.join(size, "conv_id").select("conv_id", "items", X.truncate(F.concat(F.lit("X thread/reply context\n"), F.array_join(line, "\n\n")), most_chars).alias("context"))


def graph(items: DataFrame, labelled: DataFrame, entities: DataFrame, links: DataFrame, members: DataFrame, projects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (type, id) and edges (src_type, src_id, dst_type, dst_id, relation), each once.

    items: id, author. labelled: id, primary. entities: id, name. links: id, url. members: id, cluster, score.
    projects: cluster; each is derived from its cluster and has the cluster's first members as evidence."""
    s = lambda c: F.col(c).cast("string")

    def edge(df, a_type, a, b_type, b, relation):
        return df.select(F.lit(a_type).alias("src_type"), s(a).alias("src_id"), F.lit(b_type).alias("dst_type"), s(b).alias("dst_id"), F.lit(relation).alias("relation")).where("src_id IS NOT NULL AND dst_id IS NOT NULL AND dst_id <> ''")

    low = entities.withColumn("name", F.lower("name"))
    domains = links.withColumn("domain", X.link_domain(F.col("url")))
    edges = (
        edge(labelled, "bookmark", "id", "category", "primary", "categorized_as")
        .unionByName(edge(low, "bookmark", "id", "entity", "name", "mentions"))
        .unionByName(edge(items, "bookmark", "id", "author", "author", "authored_by"))
        .unionByName(edge(domains, "bookmark", "id", "domain", "domain", "links_to"))
        .unionByName(edge(links, "bookmark", "id", "link", "url", "references"))
        .unionByName(edge(members, "cluster", "cluster", "bookmark", "id", "contains"))
    )
    if projects is not None:
        own_projects = projects.select("cluster", F.concat(F.lit("project-"), F.col("cluster")).alias("project"))
        own_evidence = own_projects.join(evidence(members), "cluster")
        edges = edges.unionByName(edge(own_projects, "project", "project", "cluster", "cluster", "derived_from")).unionByName(edge(own_evidence, "project", "project", "bookmark", "id", "uses_as_evidence"))
    edges = edges.distinct()
    own = items.select(F.lit("bookmark").alias("type"), s("id").alias("id"))
    nodes = own.unionByName(edges.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"))).unionByName(edges.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))).distinct()
    return nodes, edges
