"""Sinks: JSON lines, CSV, notes with index pages, the interactive page's data,
the graph, media bundles and archives.

``records`` puts a row's labels, entities, links and tags together once; every
format is a projection of these records. Index pages are rows of lines, so a
page of a common topic is never gathered in memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.plans.model import written
from lorebase.sources.files import write_pages

FORMATS = ("jsonl", "csv", "markdown", "logseq", "obsidian", "spec", "archive")
#: Columns of a record, in order (fixed values); those of the CSV file are all but raw_text.
FIELDS = ("status_id", "status_url", "author_handle", "author_name", "tweet_text", "raw_text", "summary", "primary_category", "categories", "confidence", "review_state", "entities", "links", "tags", "captured_at", "created_at")
CSV_FIELDS = ("status_id", "status_url", "author_handle", "author_name", "tweet_text", "summary", "primary_category", "confidence", "review_state", "categories", "entities", "links", "tags", "captured_at", "created_at")


def records(items: DataFrame, labels: DataFrame, entities: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Live rows with all that belongs to them: the columns of ``items``, and
    primary_category, confidence, categories, entities, links and tags.

    items: id and any of ``FIELDS``. labels: id, slug, confidence, is_primary.
    entities: id, name. links: id, url. tags: id, tag. Labels are in order of
    confidence, the primary one first; the other lists are sorted."""
    own = labels.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("other"), (-F.col("confidence")).alias("minus"), "slug"))).alias("own"))
    own = own.select("id", F.transform("own", lambda x: x["slug"]).alias("categories"), F.when(~F.col("own")[0]["other"], F.col("own")[0]["slug"]).alias("first"), F.when(~F.col("own")[0]["other"], -F.col("own")[0]["minus"]).alias("sure"))
    lists = [d.groupBy("id").agg(F.array_sort(F.collect_set(c)).alias(n)) for d, c, n in ((entities, "name", "entities"), (links, "url", "links"), (tags, "tag", "tags"))]
    joined = reduce(lambda a, b: a.join(b, "id", "left"), [own, *lists], items.where(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in items.columns else items)
    none = F.array().cast("array<string>")
    filled = joined.withColumns({c: F.coalesce(c, none) for c in ("categories", "entities", "links", "tags")})
    return filled.withColumn("primary_category", F.coalesce("first", F.lit("misc"))).withColumn("confidence", F.coalesce("sure", F.lit(0.0))).drop("first", "sure")


def wanted(rows: DataFrame, include=(), exclude=(), no_review: bool = False, least: float = 0.0, primary: str = "primary_category") -> DataFrame:
    """Rows by primary category, need for review and confidence."""
    if include:
        rows = rows.where(F.col(primary).isin(*include))
    if exclude:
        rows = rows.where(~F.col(primary).isin(*exclude))
    if no_review:
        rows = rows.where(~F.col("needs_review"))
    return rows.where(F.col("confidence") >= least)


def csv_rows(rows: DataFrame) -> DataFrame:
    """Flat rows: line ends become blanks, lists are joined by ``|``."""
    flat: list[Column] = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        flat.append((F.array_join(F.transform(c, lambda x: x.cast("string")), "|") if kind.startswith("array") else F.translate(c, "\r\n", "  ") if kind == "string" else c).alias(name))
    return rows.select(*flat)


def _have(rows: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n in rows.columns]


def json_line(rows: DataFrame) -> Column:
    """A row's record as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*_have(rows, FIELDS)))


def title_of(rows: DataFrame) -> Column:
    key = F.col("status_id" if "status_id" in rows.columns else "id").cast("string")
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("summary", "tweet_text", "text") if c in rows.columns]
    return F.coalesce(*parts, key)


def note_name(rows: DataFrame) -> Column:
    key = F.col("status_id" if "status_id" in rows.columns else "id").cast("string")
    return F.concat(key, F.lit("-"), X.slugify(title_of(rows)))


def notes(rows: DataFrame, form: str = "markdown") -> DataFrame:
    """(path, note): one note for each record, with its fields in front."""
    shown = _have(rows, ("status_id", "status_url", "author_handle", "primary_category", "categories", "confidence", "review_state", "captured_at"))
    if form == "logseq":
        text = lambda n: F.array_join(F.col(n), ", ") if dict(rows.dtypes)[n].startswith("array") else F.col(n).cast("string")
        head = F.concat_ws("\n", *[F.concat(F.lit(f"{n}:: "), text(n)) for n in shown])
    else:
        value = lambda n: F.regexp_replace(F.to_json(F.struct(F.col(n).alias("x"))), r'^\{"x":(.*)\}$', "$1")
        head = F.concat(F.lit("---\n"), F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), value(n)) for n in shown]), F.lit("\n---"))
    ref = {"obsidian": lambda x: F.concat(F.lit("[["), x, F.lit("]]")), "logseq": lambda x: F.concat(F.lit("#[["), x, F.lit("]]"))}.get(form, lambda x: x)
    body = [head, F.lit(""), F.concat(F.lit("# "), title_of(rows)), F.lit("")]
    if "tweet_text" in rows.columns or "text" in rows.columns:
        body += [F.lit("## Text"), F.col("tweet_text" if "tweet_text" in rows.columns else "text"), F.lit("")]
    for name, heading, mark in (("links", "Links", lambda x: x), ("entities", "Entities", ref), ("tags", "Tags", lambda x: F.concat(F.lit("#"), x))):
        if name in rows.columns:
            listed = F.array_join(F.transform(name, (lambda m: lambda x: F.concat(F.lit("- "), m(x)))(mark)), "\n")
            body.append(F.when(F.size(name) > 0, F.concat(F.lit(f"## {heading}\n"), listed, F.lit("\n"))))
    if "primary_category" in rows.columns:
        body.append(F.concat(F.lit("Topic: "), ref(F.col("primary_category"))))
    folder = {"obsidian": "Bookmarks/", "logseq": "pages/"}.get(form, "bookmarks/")
    return rows.select(F.concat(F.lit(folder), note_name(rows), F.lit(".md")).alias("path"), F.concat_ws("\n", *body).alias("note"))


def _pages(entries: DataFrame, folder: str, count: str, form: str) -> DataFrame:
    """(path, place, line) of index pages from entries (name, title, target)."""
    path = F.concat(F.lit(folder), X.slugify(F.col("name")), F.lit(".md"))
    link = F.concat(F.lit("- [["), "target", F.lit("|"), "title", F.lit("]]")) if form == "obsidian" else F.concat(F.lit("- ["), "title", F.lit("]("), "target", F.lit(".md)"))
    # Names that share a slug share a page.
    size = entries.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    top = size.select("path", F.posexplode(F.array(F.concat(F.lit("# "), "name"), F.lit(""), F.format_string(count, "n"), F.lit(""))).alias("place", "line"))
    return top.unionByName(entries.select(path.alias("path"), F.lit(4).alias("place"), link.alias("line")))


def index_pages(rows: DataFrame, form: str = "markdown") -> DataFrame:
    """Lines of the pages of topics and (for obsidian) entities, and of ``index.md`` with totals."""
    folder = {"obsidian": "Bookmarks/", "logseq": "pages/"}.get(form, "bookmarks/")
    each = rows.select("primary_category", *_have(rows, ("entities",)), F.substring(title_of(rows), 1, 100).alias("title"), F.concat(F.lit(folder), note_name(rows)).alias("target"))
    each = written(each)  # several pages are made of it, and what it is made of may be classified texts
    topics = each.select(F.col("primary_category").alias("name"), "title", "target")
    if form == "obsidian":
        names = each.select(F.explode("entities").alias("name"), "title", "target")
        return _pages(topics, "Topics/", "%d bookmarks.", form).unionByName(_pages(names, "Entities/", "Appears in %d bookmarks.", form))
    counts = topics.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    top = total.select(F.posexplode(F.array(F.lit("# Bookmark Export"), F.lit(""), F.format_string("Total: %d bookmarks", "n"), F.lit(""), F.lit("## Topics"))).alias("place", "line"))
    listed = counts.select(F.lit(5).alias("place"), F.format_string("- [%s](topics/%s.md) (%d)", "name", X.slugify(F.col("name")), "n").alias("line"))
    index = top.unionByName(listed).select(F.lit("index.md").alias("path"), "place", "line")
    return _pages(topics, "topics/", "%d bookmarks.", form).unionByName(index)


def cluster_pages(members: DataFrame, rows: DataFrame, most: int = 20) -> DataFrame:
    """Lines of a page for each cluster with its first members by score."""
    order = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "id")
    first = members.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).join(rows.select("id", F.substring(title_of(rows), 1, 100).alias("title"), note_name(rows).alias("note")), "id")
    path = F.concat(F.lit("Clusters/"), "cluster", F.lit(".md"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    top = size.select(path.alias("path"), F.posexplode(F.array(F.concat(F.lit("# "), "cluster"), F.lit(""), F.format_string("%d members.", "n"), F.lit(""))).alias("place", "line"))
    return top.unionByName(first.select(path.alias("path"), (F.col("k") + 3).alias("place"), F.concat(F.lit("- [[Bookmarks/"), "note", F.lit("|"), "title", F.lit("]]")).alias("line")))


def project_pages(projects: DataFrame, evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines of a page for each project idea with its evidence (cluster, id)."""
    path = F.concat(F.lit("Projects/project-"), "cluster", F.lit(".md"))
    said = F.array(F.concat(F.lit("# "), "title"), F.lit(""), F.col("one_liner"), F.lit(""), F.concat(F.lit("Problem: "), "problem"), F.concat(F.lit("Audience: "), "audience"), F.concat(F.lit("Why now: "), "why_now"), F.lit(""), F.col("notes"), F.lit(""), F.lit("## Evidence"))
    top = projects.select(path.alias("path"), F.posexplode(said).alias("place", "line"))
    notes_ = rows.select("id", F.substring(title_of(rows), 1, 100).alias("name"), note_name(rows).alias("note"))
    listed = evidence.join(projects.select("cluster"), "cluster").join(notes_, "id")
    return top.unionByName(listed.select(path.alias("path"), F.lit(11).alias("place"), F.concat(F.lit("- [[Bookmarks/"), "note", F.lit("|"), "name", F.lit("]]")).alias("line")))


def script_safe(record: Column) -> Column:
    return F.replace(F.to_json(record), F.lit("</"), F.lit("<\\/"))


def spec_record(rows: DataFrame) -> DataFrame:
    """(record): JSON that is safe inside a script element; nulls are left out."""
    return rows.select(script_safe(F.struct(*_have(rows, ("id", *FIELDS)) or rows.columns)).alias("record"))


def spec_counts(rows: DataFrame, most: int = 50) -> DataFrame:
    """(kind, name, n): every category, and the ``most`` most frequent entities (ties by name)."""
    topics = rows.groupBy(F.col("primary_category").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("category").alias("kind"), "name", "n")
    names = rows.select(F.explode("entities").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
    return topics.unionByName(names.select(F.lit("entity").alias("kind"), "name", "n"))


#: The interactive page around the data: search and filters run in the browser.
PAGE = """<!doctype html><meta charset="utf-8"><title>Archive</title>
<input id="q" placeholder="search"><select id="c"><option value="">all</option></select><ul id="out"></ul>
<script src="data.js"></script><script>
const out = document.getElementById("out"), q = document.getElementById("q"), c = document.getElementById("c");
for (const x of counts.filter(x => x.kind === "category")) c.add(new Option(x.name + " (" + x.n + ")", x.name));
function show() {
  const want = q.value.toLowerCase();
  out.replaceChildren(...records.filter(r => (!c.value || r.primary_category === c.value) && JSON.stringify(r).toLowerCase().includes(want)).slice(0, 500).map(r => {
    const li = document.createElement("li"); li.textContent = r.summary || r.tweet_text || r.status_id; return li; }));
}
q.oninput = c.onchange = show; show();
</script>"""


def write_site(rows: DataFrame, folder: str) -> None:
    """``index.html`` and ``data.js`` with all records and counts."""
    page = rows.sparkSession.range(1).select(F.lit("index.html").alias("path"), F.lit(0).alias("place"), F.lit(PAGE).alias("line"))
    line = lambda d, place, text: d.select(F.lit("data.js").alias("path"), F.lit(place).alias("place"), text.alias("line"))
    one = rows.sparkSession.range(1)
    data = line(one, 0, F.lit("const records = [")).unionByName(line(spec_record(rows), 1, F.concat("record", F.lit(",")))).unionByName(line(one, 2, F.lit("]; const counts = [")))
    counts = spec_counts(rows)
    data = data.unionByName(line(counts, 3, F.concat(script_safe(F.struct(*counts.columns)), F.lit(",")))).unionByName(line(one, 4, F.lit("];")))
    write_pages(page.unionByName(data), folder)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, record): JSON of every node and edge."""
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("type", "id")).alias("record"))
    ends = F.struct(F.struct(F.col("src_type").alias("type"), F.col("src_id").alias("id")).alias("from"), F.struct(F.col("dst_type").alias("type"), F.col("dst_id").alias("id")).alias("to"), "relation")
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(ends).alias("record")))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """``nodes`` and ``edges`` as folders of JSON lines."""
    lines = graph_lines(nodes, edges)
    for kind in ("node", "edge"):
        lines.where(F.col("kind") == kind).select("record").write.mode("overwrite").text(f"{folder}/{kind}s")


def image_extension(url: Column, content_type: Column | None = None) -> Column:
    """By the query's ``format``, then the content type, then the path's suffix, else ``.jpg``."""
    known = lambda x: F.when(x.isin("jpg", "jpeg"), ".jpg").when(x.isin("png", "webp", "gif"), F.concat(F.lit("."), x))
    asked = F.lower(F.regexp_extract(url, r"[?&]format=([^&#]*)", 1))
    kind = F.lower(F.regexp_extract(content_type, r"^\s*image/([a-z]+)", 1)) if content_type is not None else F.lit("")
    return F.coalesce(known(asked), known(kind), known(F.lower(F.regexp_extract(X.url_path(url), r"\.([A-Za-z]+)$", 1))), F.lit(".jpg"))


def media_bundle(media: DataFrame, items: DataFrame) -> DataFrame:
    """The manifest, a row for each image: the item's columns, place, url, alt, file.

    media: id, url, alt, place (from 0). items: id, status_id, author_handle. Files
    are numbered newest item first, by counts of each day (or range of identifiers)."""
    rows = media.join(items, "id").withColumn("media_index", F.col("place") + 1).drop("place")
    dated = "captured_at" in items.columns
    rows = rows.withColumn("__day", F.to_date("captured_at") if dated else F.shiftright("id", 12))
    within = Window.partitionBy("__day").orderBy(*([F.desc("captured_at")] if dated else []), F.desc("id"), "media_index", "url")
    # A row for each day: their running sum needs them in one place.
    counts = rows.groupBy("__day").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(F.desc_nulls_last("__day")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__day").alias("__own"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__n", F.row_number().over(within)).join(before, F.col("__day").eqNullSafe(F.col("__own")))
    numbered = numbered.withColumn("index", (F.col("__before") + F.col("__n")).cast("int"))
    name = F.format_string("images/%04d-%s-%s-%d-%s%s", "index", X.slugify(F.col("author_handle"), "author"), X.slugify(F.col("status_id").cast("string"), "status"), "media_index", F.substring(F.sha2("url", 256), 1, 10), image_extension(F.col("url")))
    return numbered.withColumn("file", name).drop("__day", "__own", "__before", "__n")


def write_media_bundle(manifest: DataFrame, folder: str) -> None:
    """``manifest.jsonl`` with sorted keys, ``index.md`` with a table, and ``prompt.md`` for a reviewer."""
    row = lambda path, place, text, d=manifest: d.select(F.lit(path).alias("path"), place.alias("place"), text.alias("line"))
    lines = row("manifest.jsonl", F.col("index"), F.to_json(F.struct(*sorted(manifest.columns))))
    one = manifest.sparkSession.range(1)
    top = ["# Media review", "", "| File | Status | Author | Alt text |", "| --- | --- | --- | --- |"]
    cell = F.concat_ws(" | ", "file", F.col("status_id").cast("string"), "author_handle", F.translate("alt", "|\n", "/ "))
    lines = lines.unionByName(row("index.md", F.col("index"), F.concat(F.lit("| "), cell, F.lit(" |"))))
    for i, x in enumerate(top):
        lines = lines.unionByName(row("index.md", F.lit(i - len(top)), F.lit(x), one))
    lines = lines.unionByName(row("prompt.md", F.lit(0), F.lit("Describe each image of the manifest: what it shows, which text it holds, and how it bears on the post."), one))
    write_pages(lines, folder)


def export(rows: DataFrame, form: str, path: str) -> None:
    """Write records in one of ``FORMATS``. Notes are files of their own, with index pages."""
    form = form.lower()
    if form == "jsonl":
        rows.select(json_line(rows)).write.mode("overwrite").text(path)
    elif form == "csv":
        csv_rows(rows.select(*_have(rows, CSV_FIELDS))).write.mode("overwrite").csv(path, header=True, escape='"')
    elif form in ("markdown", "logseq", "obsidian"):
        lines = notes(rows, form).select("path", F.lit(0).alias("place"), F.col("note").alias("line"))
        write_pages(lines if form == "logseq" else lines.unionByName(index_pages(rows, form)), path)
    elif form == "spec":
        write_site(rows, path)
    elif form == "archive":
        # Columnar files with dictionaries, run lengths and zstd take the place of a codec of its own.
        rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unknown format {form!r}; there are {', '.join(FORMATS)}")


def restore(spark, path: str) -> DataFrame:
    """The rows of an archive."""
    return spark.read.parquet(path)
