"""Enrichment of bookmarks from captured payloads: text, thread, media and linked pages in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.operators.derive import BLOCKED_HOSTS, content_image, outbound_links
from lorebase.sources.web import outline

#: What a captured payload holds; fields of another shape are null, and others are not read.
FIELDS = {
    "url": "string",
    "source_type": "string",
    "title": "string",
    "content_text": "string",
    "media": "array<struct<url:string,alt:string>>",
    "outbound_links": "array<struct<url:string,text:string,aria:string>>",
    "conversation_items": "array<struct<role:string,author_handle:string,status_url:string,text:string>>",
}
ROW = "struct<place:int,source_type:string,state:string,source_url:string,title:string,content:string,requested:string>"
STATES = ("enriched", "skipped", "failed")


def parsed(payload: Column) -> Column:
    """The payload's fields as a struct; null where the text is no JSON object."""
    v = F.try_parse_json(payload)
    fields = [F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in FIELDS.items()]
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(*fields))


def thread_items(items: Column) -> Column:
    """Items of a thread with text, the first of those that share their first 140 characters."""
    filled = F.filter(F.coalesce(items, F.array().cast(FIELDS["conversation_items"])), lambda x: X.clean_text(x["text"]) != "")
    start = lambda x: F.substring(X.clean_text(x["text"]), 1, 140)
    starts = F.transform(filled, start)
    return F.filter(filled, lambda x, i: F.array_position(starts, start(x)) == i + 1)


def thread_text(items: Column, most_items: int = 12, most_chars: int = 6000) -> Column:
    """A thread as text: a header and up to 900 characters of each item."""

    def one(x: Column) -> Column:
        filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
        role = F.coalesce(filled(x["role"]), F.lit("context"))
        handle = F.concat(F.lit("@"), filled(F.regexp_replace(x["author_handle"], "^@+", "")))
        head = F.concat_ws(" ", F.concat(F.lit("["), role, F.lit("]")), handle, filled(x["status_url"]))
        return F.concat(head, F.lit("\n"), X.truncate(X.clean_text(x["text"]), 900))

    said = F.transform(F.slice(items, 1, most_items), one)
    return X.truncate(F.concat(F.lit("X thread/reply context\n"), F.array_join(said, "\n\n")), most_chars)


def routed(captures: DataFrame, thread: str = "auto", most_media: int = 4, most_links: int = 3, most_items: int = 12, describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, place, source_type, state, source_url, title, content, requested): a row for every output of
    a capture (id, status_url, text, payload), parsed once, in one projection.

    Place 0 is the text, 1 the thread, from 2 media, then links, which have their
    address in ``requested`` and no content or state yet. A payload that is no
    JSON object fails; one without text is skipped, and neither gives other rows.
    ``thread``: ``auto`` takes threads of questions only, ``always`` and ``never`` say it. ``describe``
    makes the content of an image of its struct (url, alt): the alternative text without one;
    null fails, an empty one is skipped."""
    if thread not in ("auto", "always", "never"):
        raise ValueError(f"thread: {thread!r}")
    describe = describe or (lambda m: F.coalesce(m["alt"], F.lit("")))
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    null = F.lit(None).cast("string")

    def row(place, kind, state, url, title, content, requested=null):
        named = zip(("place", "source_type", "state", "source_url", "title", "content", "requested"), (place, kind, state, url, title, content, requested))
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in named]).cast(ROW)

    p = captures.select("id", "status_url", "text", parsed(F.col("payload")).alias("p"))
    p = p.select("*", trimmed("p.content_text").alias("content"), F.coalesce(F.nullif("p.url", F.lit("")), "status_url").alias("url"), thread_items(F.col("p.conversation_items")).alias("items"))
    own = F.when(F.col("p").isNull(), "failed").when(F.col("content") == "", "skipped").otherwise("enriched")
    text = row(0, F.coalesce(F.nullif("p.source_type", F.lit("")), F.lit("x-status")), own, F.col("url"), F.coalesce("p.title", F.lit("")), F.col("content"))

    asked = X.looks_like_question(F.lower(F.substring(F.trim(F.regexp_replace(F.concat_ws("\n", "text", "content"), X.BLANK, " ")), 1, 500)))
    wanted = {"never": F.lit(False), "always": F.lit(True), "auto": asked}[thread] & (F.size("items") >= 2)
    talk = F.when(wanted, F.array(row(1, "x-conversation", "enriched", F.concat("url", F.lit("#conversation")), "X thread/reply context", thread_text(F.col("items"), most_items))))

    shown = F.filter("p.media", lambda m: content_image(F.trim(m["url"])))
    urls = F.transform(shown, lambda m: F.trim(m["url"]))
    once = F.slice(F.filter(shown, lambda m, i: F.array_position(urls, F.trim(m["url"])) == i + 1), 1, most_media)

    def image(m, i):
        said = describe(m)
        return row(i + 2, "image-analysis", F.when(said.isNull(), "failed").when(F.trim(said) == "", "skipped").otherwise("enriched"), F.trim(m["url"]), "Image analysis", said)

    labelled = F.transform("p.outbound_links", lambda x: F.struct(x["url"].alias("url"), F.concat_ws(" ", x["text"], x["aria"]).alias("text")))
    links = F.transform(outbound_links(labelled, most_links), lambda u, i: row(i + 2 + most_media, "linked-page", null, null, null, null, u))
    none = F.array().cast(f"array<{ROW}>")
    more = F.concat(F.coalesce(talk, none), F.coalesce(F.transform(once, image), none), F.coalesce(links, none))
    rows = F.concat(F.array(text), F.when(own == "enriched", more).otherwise(none))
    return p.select("id", F.inline(rows))


def enrich(captures: DataFrame, pages: DataFrame, stored: DataFrame | None = None, **how) -> DataFrame:
    """(id, place, source_type, state, source_url, title, content): every output of ``captures``, see ``routed``.

    Links get the outline of their page among ``pages`` (requested, url, html; ``url`` is where it
    ended): a page that is not there fails, one that is empty or ended at a blocked host is
    skipped. Of several pages of one address that with the least url and html counts.
    Captures are read once; rows without a link go by a key of their own through the join.
    ``stored`` (id, source_type, source_url, content): outputs that say the same as what
    is stored are skipped, and so is all of one output but the first place of an item."""
    one = pages.groupBy("requested").agg(F.min(F.struct("url", "html")).alias("least")).select(F.col("requested").alias("key"), F.col("least.url").alias("ended"), outline(F.col("least.html"), "title", "text").alias("o"))
    rows = routed(captures, **how).withColumn("key", F.coalesce("requested", F.concat(F.lit("\n"), F.xxhash64("id", "place", "source_url").cast("string"))))
    met = rows.join(one, "key", "left")
    link = F.col("requested").isNotNull()
    blocked = ~F.col("ended").rlike("^https?://") | X.link_domain(F.col("ended")).isin(*BLOCKED_HOSTS)
    linked = F.when(F.col("ended").isNull(), "failed").when((F.col("o.text") == "") | blocked, "skipped").otherwise("enriched")
    found = met.select(
        "id",
        "place",
        "source_type",
        F.when(link, linked).otherwise(F.col("state")).alias("state"),
        F.when(link, F.coalesce("ended", "requested")).otherwise(F.col("source_url")).alias("source_url"),
        F.when(link, F.coalesce("o.title", F.lit(""))).otherwise(F.col("title")).alias("title"),
        F.when(link, F.coalesce("o.text", F.lit(""))).otherwise(F.col("content")).alias("content"),
    )
    if stored is None:
        return found
    # What is stored comes as a hash of its content; of several rows of an output, any that says the same.
    known = stored.select("id", "source_type", "source_url", F.xxhash64("content").alias("hash"), F.length("content").alias("chars"), F.lit(True).alias("same")).distinct()
    own = found.withColumns({"hash": F.xxhash64("content"), "chars": F.length("content")}).join(known, ["id", "source_type", "source_url", "hash", "chars"], "left")
    state = F.when(F.col("same") & (F.col("state") == "enriched"), "skipped").otherwise(F.col("state"))
    return own.select("id", "place", "source_type", state.alias("state"), "source_url", "title", "content")


def counters(rows: DataFrame) -> list[Column]:
    """Aggregates over the rows of ``enrich`` by their names, for ``agg`` or for ``observe`` while rows are written."""
    saved = F.col("state") == "enriched"
    kind = F.col("source_type")
    apart = kind.isin("x-conversation", "image-analysis")
    return [
        F.count_if(saved & ~apart).alias("enriched"),
        F.count_if(saved & (kind == "x-conversation")).alias("conversations"),
        F.count_if(saved & (kind == "image-analysis")).alias("media_analyzed"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.count_if(F.col("state") == "failed").alias("failed"),
    ]
