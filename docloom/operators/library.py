"""The library of cards: grouping, pairing, tags, sorts and caps as joins, aggregates and array functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Codes that mark a translation in a file name, longest first.
CODES = ["en", "es", "fr", "de", "nl", "it", "pt", "ru", "ja", "ko", "zh"]


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def pairing_stem(path: Column) -> Column:
    """File name without its kind and without ``.code`` or ``.code-2``."""
    return F.regexp_replace(stem(path), rf"(?i)\.({'|'.join(CODES)})(-[0-9]+)?$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def origin_key() -> Column:
    return F.when(F.col("source_path") != "", F.lower("source_path")).otherwise(F.concat_ws("|", F.lower(folder(F.col("markdown_path"))), F.lower(pairing_stem(F.col("markdown_path")))))


def output_path(path: Column) -> Column:
    """``parent/stem/stem.md`` of an input file."""
    return F.concat_ws("/", folder(path), stem(path), F.concat(stem(path), F.lit(".md")))


def translation_copies(cards: DataFrame) -> DataFrame:
    """(id, path): a copy of each card in its ``lang``, ``stem.lang.md`` or ``stem.lang-2.md`` and so on in order of ids."""
    base = F.concat_ws("/", folder(F.col("markdown_path")), F.concat_ws(".", stem(F.col("markdown_path")), F.col("lang")))
    return unique_names(cards, base).select("id", F.concat("name", F.lit(".md")).alias("path"))


def is_original() -> Column:
    """Whether a card's file name has no translation code."""
    return F.lower(stem(F.col("markdown_path"))) == F.lower(pairing_stem(F.col("markdown_path")))


def groups(cards: DataFrame) -> DataFrame:
    """(origin, n, master, newest, first_tag, first): the master is the first card that is no translation,
    else that of the shortest title, then the least id; ``first`` gives the groups' order.

    All are partial aggregates, so an origin with very many cards stays spread over tasks.
    """
    k = cards.withColumns({"origin": origin_key(), "original": is_original()})
    master = F.coalesce(F.min(F.when(F.col("original"), F.col("id"))), F.min_by("id", F.struct(F.length("title"), "id")))
    tag = F.min(F.coalesce(F.array_min("tags"), F.lit("\uffff")))
    return k.groupBy("origin").agg(F.count("*").alias("n"), master.alias("master"), F.max_by("id", F.struct("added", "id")).alias("newest"), tag.alias("first_tag"), F.min("id").alias("first"))


def groups_with(cards: DataFrame, hits: DataFrame) -> DataFrame:
    """(origin) of the groups that have a card among ``hits`` (id)."""
    return cards.join(hits, "id", "left_semi").select(origin_key().alias("origin")).distinct()


def normal_path(path: Column) -> Column:
    """A path for comparison: lower case, no dot steps, single slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"/(\./)+", "/"), "/{2,}", "/")


def new_files(found: DataFrame, library: DataFrame) -> DataFrame:
    """(path) of the files that the library does not have yet; both sides have ``path``."""
    have = library.select(normal_path(F.col("path")).alias("path"))
    return found.select(normal_path(F.col("path")).alias("path")).distinct().join(have, "path", "left_anti")


def with_bookmarks(cards: DataFrame, headings: DataFrame) -> DataFrame:
    """(id, bookmarks): headings of each card's document, none where it has no outline."""
    n = headings.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    return cards.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("bookmarks"))


def watch_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, do): watches to stop and to start when the watched paths change."""
    old, new = before.select("path").distinct(), now.select("path").distinct()
    return old.join(new, "path", "left_anti").withColumn("do", F.lit("stop")).unionByName(new.join(old, "path", "left_anti").withColumn("do", F.lit("start")))


def job_counts(jobs: DataFrame, key: str) -> DataFrame:
    """Queued and failed jobs of each ``key``, whether any is running and any has ended."""
    is_ = lambda *names: F.col("status").isin(*names)
    return jobs.groupBy(key).agg(F.count_if(is_("queued")).alias("queued"), F.count_if(is_("failed")).alias("failed"), F.bool_or(is_("running")).alias("running"), F.bool_or(is_("done", "failed")).alias("recent"))


def twins(cards: DataFrame) -> DataFrame:
    """(id, master): each card of an origin with the origin's master, the master itself left out.

    A join with the groups, not of the cards with themselves: pairs within an origin are never made.
    """
    k = cards.select("id", origin_key().alias("origin"))
    return k.join(groups(cards).select("origin", "master"), "origin").where("id <> master").select("id", "master")


def tag_counts(cards: DataFrame) -> DataFrame:
    return cards.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("cards"))


def with_tags(cards: DataFrame, want: list[str]) -> DataFrame:
    """Cards that have every tag asked for."""
    return cards.where(F.size(F.array_except(F.array(*map(F.lit, want)), F.col("tags"))) == 0)


def renamed_tag(cards: DataFrame, old: str, new: str) -> DataFrame:
    return cards.withColumn("tags", F.array_distinct(F.transform("tags", lambda t: F.when(t == old, F.lit(new)).otherwise(t))))


def without_tag(cards: DataFrame, tag: str) -> DataFrame:
    return cards.withColumn("tags", F.array_remove("tags", tag))


def toggled_tag(cards: DataFrame, tag: str, most: int = 8) -> DataFrame:
    has = F.array_contains("tags", tag)
    added = F.when(F.size("tags") < most, F.array_append("tags", F.lit(tag))).otherwise(F.col("tags"))
    return cards.withColumn("tags", F.when(has, F.array_remove("tags", tag)).otherwise(added))


def victim(cards: DataFrame, cap: int = 100, *, kept: list[int] | None = None) -> DataFrame:
    """(origin): the group opened least recently, if there are more than ``cap``; groups that hold a card
    of ``kept`` (the guide, the newest) are spared."""
    spared = F.max(F.col("id").isin(kept or []).cast("int"))
    g = cards.groupBy(origin_key().alias("origin")).agg(F.max("opened").alias("opened"), spared.alias("spared"))
    one = g.agg(F.count("*").alias("n"), F.min_by(F.when(F.col("spared") == 0, F.col("origin")), F.when(F.col("spared") == 0, F.struct("opened", "origin"))).alias("origin"))
    return one.where((F.col("n") > cap) & F.col("origin").isNotNull()).select("origin")


def unique_titles(cards: DataFrame, wanted: DataFrame, title: Column) -> DataFrame:
    """(want, id): the one card with a title; titles of several cards give none."""
    one = cards.select("id", title.alias("want")).groupBy("want").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return wanted.join(one.select("want", "id"), "want", "left")


def unique_names(cards: DataFrame, base: Column) -> DataFrame:
    """(id, name): ``stem``, ``stem-2``, ``stem-3`` in order of ids.

    Places come from counts by range of ids and a rank within the range, so that one name given to very
    many cards is not numbered in one task.
    """
    k = cards.select("id", base.alias("stem")).withColumn("part", F.floor(F.col("id") / 256))
    counts = k.groupBy("stem", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("stem").orderBy("part")) - F.col("c")
    r = F.row_number().over(W.partitionBy("stem", "part").orderBy("id"))
    n = k.withColumn("r", r).join(counts.select("stem", "part", before.alias("before")), ["stem", "part"])
    at = F.col("before") + F.col("r")
    return n.select("id", F.when(at == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", at.cast("string"))).alias("name"))


# Words of a title search that say nothing.
STOP = {"the", "and", "for", "that", "this", "with", "from", "a", "an", "of", "in", "to", "el", "la", "de", "los", "las", "un", "una", "het", "een", "van"}


def title_hits(cards: DataFrame, query: str) -> DataFrame:
    """Cards whose title and source name hold the query or all its words, or one word of four letters, or
    that have a tag with the query in it. A blank query has every card."""
    q = query.strip()
    if not q:
        return cards
    words = [w for w in re.split(r"[\W_]+", q.lower()) if len(w) > 2 and w not in STOP]
    low = F.lower(F.concat_ws(" ", "title", "source_name"))
    held = [F.contains(low, F.lit(w)) for w in words]
    found = F.contains(low, F.lit(q.lower())) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q.removeprefix("#").lower())))
    if held:
        every = held[0]
        for h in held[1:]:
            every = every & h
        found = found | every
        for w, h in zip(words, held, strict=True):
            found = found | h if len(w) >= 4 else found
    return cards.where(found)


def upserted(history: DataFrame, *, keep: int = 25) -> DataFrame:
    """The newest of each (question, chapter, file), without regard to case, newest first, ``keep`` of them.

    ``history`` is (at, question, chapter, file, id). Only the newest of each key goes on to the limit.
    """
    key = [F.lower(c).alias(c) for c in ("question", "chapter", "file")]
    newest = history.groupBy(*key).agg(F.max(F.struct("at", "id", F.col("question").alias("q"))).alias("r"))
    return newest.select("r.at", "r.id", F.col("r.q").alias("question")).orderBy(F.desc("at"), F.desc("id")).limit(keep)


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """A language's label by its code; null for codes without one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.lower(code))


def sidecar(path: Column) -> Column:
    """The outline file beside a Markdown file."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".outline.json"))


def deleted_files(cards: DataFrame, gone: DataFrame) -> DataFrame:
    """(path) of what goes with the cards ``gone`` (id): their Markdown, outline and searchable copy, and a
    folder's figures where no other card is left in it."""
    told = cards.join(gone.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    own = told.where("gone").select(F.explode(F.array(F.col("markdown_path"), sidecar(F.col("markdown_path")), F.regexp_replace("markdown_path", r"\.[^./]*$", ".searchable.pdf"))).alias("path"))
    empty = told.groupBy(folder(F.col("markdown_path")).alias("f")).agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("all")).where("all")
    return own.unionByName(empty.select(F.concat("f", F.lit("/figures")).alias("path"))).distinct()
