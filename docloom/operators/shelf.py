"""The shelf: pairs of one origin, order by hand, records as JSON, jobs, margins and outlines, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import by_shuffle, written
from . import library


def same_origin(cards: DataFrame) -> DataFrame:
    """(id, key): the one or two keys that cards of one origin share: the source path, or folder and name.

    Two equal joins on ``key`` stand for a join with an OR, and pairs need not be written out.
    """
    by_source = F.when(F.col("source_path") != "", F.concat(F.lit("s|"), "source_path"))
    base = library.pairing_stem(F.col("markdown_path"))
    by_name = F.when(base != "", F.concat(F.lit("n|"), library.folder(F.col("markdown_path")), F.lit("|"), F.lower(base)))
    return cards.select("id", F.explode(F.filter(F.array(by_source, by_name), lambda k: k.isNotNull())).alias("key"))


#: Cards of a key that one task takes against all of them, and into how many tasks a key is dealt at most.
DEAL, DEALS = 20_000, 64


def origin_pairs(cards: DataFrame) -> DataFrame:
    """(id, mate): all pairs of cards of one origin, each once.

    A pair is made at the least key that both cards have, so pairs are not exchanged to find those made
    twice. Cards of a key that very many have are dealt over tasks.
    """
    own = same_origin(cards.where("id is not null")).groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    own = written(own.select("id", "keys", F.posexplode("keys").alias("at", "key")).select("id", "keys", "key", F.slice("keys", F.lit(1), F.col("at")).alias("before")), "origins")
    many = own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > DEAL).select("key", F.least(F.lit(DEALS), F.ceil(F.col("n") / DEAL)).cast("int").alias("deals"))
    dealt = own.join(by_shuffle(many), "key", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    left = dealt.select("id", "before", "key", F.pmod(F.xxhash64("id"), "deals").cast("int").alias("deal"))
    right = dealt.select(F.col("id").alias("mate"), "keys", "key", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    first = F.when(F.size("before") == 0, F.lit(True)).otherwise(~F.arrays_overlap("before", "keys"))
    return left.join(by_shuffle(right), ["key", "deal"]).where((F.col("id") != F.col("mate")) & first).select("id", "mate")


def recent_mates(cards: DataFrame) -> DataFrame:
    """(id, mate): for each card the card of its origin that was opened last, itself left out.

    The two last opened of each key are enough to know that of every card, so no group is expanded.
    """
    keyed = same_origin(cards).join(cards.select("id", "opened"), "id")
    rank = F.struct("opened", (-F.col("id")).alias("before"))
    top = keyed.groupBy("key").agg(F.max(rank).alias("a"), F.count("*").alias("n")).where("n > 1")
    second = keyed.join(top, "key").where(F.col("a.before") != -F.col("id")).groupBy("key").agg(F.max(rank).alias("b"))
    told = keyed.join(top, "key").join(second, "key")
    mate = F.when(F.col("a.before") == -F.col("id"), F.col("b")).otherwise(F.col("a"))
    best = told.select("id", mate.alias("m")).groupBy("id").agg(F.max("m").alias("m"))
    return best.select("id", (-F.col("m.before")).alias("mate"))


def newest(cards: DataFrame, guide: int) -> DataFrame:
    """(id): the card that was added last, the guide apart."""
    return cards.where(F.col("id") != guide).agg(F.max_by("id", F.struct("added", -F.col("id"))).alias("id"))


def toggled_sort(now: Column, clicked: Column) -> Column:
    """The library's sort after a click: the same kind again turns round, any other begins rising."""
    turned = {"name_asc": "name_desc", "name_desc": "name_asc", "date_new": "date_old", "date_old": "date_new", "tag_asc": "tag_desc", "tag_desc": "tag_asc", "manual": "manual"}
    other = F.create_map(*(F.lit(x) for pair in turned.items() for x in pair))
    return F.when(now == clicked, F.get(F.array(other[clicked]), F.lit(0))).otherwise(clicked)


def moved(groups: DataFrame, source: int, target: int | None) -> DataFrame:
    """(at, origin): places after a group was dropped on another, or in front of all.

    ``groups`` is (at, origin), dense from 0; places are computed one by one, so nothing is sorted.
    """
    at = F.col("at")
    closed = F.when(at > source, at - 1).otherwise(at)  # without the moved one
    to = 0 if target is None else target - (target > source)
    return groups.select(F.when(at == source, to).otherwise(F.when(closed >= to, closed + 1).otherwise(closed)).cast("long").alias("at"), "origin")


def similar_sizes(pictures: DataFrame, slack: float = 0.15) -> DataFrame:
    """(doc_id, name, other): pictures of a document whose sides differ by at most a share of the larger.

    Sides are cut in steps of a size by its logarithm, so pairs meet only in their own step and the next.
    """
    step = -F.log(F.lit(1 - slack))
    at = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / step)
    left = pictures.select("doc_id", "name", "w", "h", at("w").alias("kw"), at("h").alias("kh"))
    near = lambda c: F.explode(F.array(*(F.col(c) + F.lit(k) for k in (-1, 0, 1))))
    right = left.select("doc_id", F.col("name").alias("other"), F.col("w").alias("ow"), F.col("h").alias("oh"), near("kw").alias("kw"), "kh")
    right = right.select("doc_id", "other", "ow", "oh", "kw", near("kh").alias("kh"))
    alike = lambda a, b: F.abs(F.col(a) - F.col(b)) <= slack * F.greatest(a, b, F.lit(1))
    return left.join(right, ["doc_id", "kw", "kh"]).where((F.col("name") < F.col("other")) & alike("w", "ow") & alike("h", "oh")).select("doc_id", "name", "other")


def margin_lines(lines: DataFrame, *, band: float = 0.18, tallest: float = 0.12, share: float = 0.34) -> DataFrame:
    """(doc_id, key, pages): lines in the upper or lower margin of a third of the pages, three at least.

    ``lines`` is (doc_id, page, text, mid_y, height, box_min_y, box_height).
    """
    away = (F.col("mid_y") - F.col("box_min_y")) / F.col("box_height")
    hits = lines.where((F.col("height") > 0) & (F.col("height") <= tallest * F.col("box_height")) & ((away >= 1 - band) | (away <= band)))
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), "[0-9]+", "#")
    n = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("n")).where("n >= 3")
    counts = hits.select("doc_id", "page", key.alias("key")).where("key <> ''").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages"))
    return counts.join(n, "doc_id").where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") * share))).select("doc_id", "key", "pages")


def packed_text(text: Column, most: int, note: str) -> Column:
    """A text cut back to the line end before ``most`` characters, with a note; shorter ones as they are."""
    cut = F.left(text, F.lit(most))
    whole = F.when(F.contains(cut, F.lit("\n")), F.regexp_replace(cut, r"(?s)\n[^\n]*\z", "")).otherwise(cut)
    return F.when(F.length(text) > most, F.concat(whole, F.lit(f"\n\n_{note}_\n"))).otherwise(text)


def section_of(marks: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, ord, first, past): from an outline's entry to the next of its level or a higher one.

    ``marks`` is (doc_id, ord, level, line_no), ``ends`` (doc_id, n)."""
    later = F.collect_list(F.struct("line_no", "level")).over(W.partitionBy("doc_id").orderBy("ord").rowsBetween(1, W.unboundedFollowing))
    told = marks.withColumn("later", later).withColumn("past", F.get(F.filter("later", lambda x: x.level <= F.col("level")), F.lit(0))["line_no"])
    return told.join(ends, "doc_id").select("doc_id", "ord", F.col("line_no").alias("first"), F.coalesce("past", "n").cast("int").alias("past"))


def upserted_cards(cards: DataFrame, new: DataFrame) -> DataFrame:
    """(path, id, place): the shelf after new cards: one card a path, the newest; a translation stands after
    the original of its origin, where there is one, any other at the head.

    ``place`` orders the shelf: new heads by their age first, then the old order; equal joins only.
    """
    every = cards.select("id", "markdown_path", "source_path", F.lit(0).alias("fresh")).unionByName(new.select("id", "markdown_path", "source_path", F.lit(1).alias("fresh")))
    kept = every.groupBy("markdown_path").agg(F.max_by(F.struct("id", "source_path", "fresh"), F.struct("fresh", "id")).alias("c")).select("markdown_path", "c.*")
    kept = kept.withColumns({"origin": library.origin_key(), "original": library.is_original()})
    lead = kept.where("original").groupBy("origin").agg(F.min(F.struct((-F.col("fresh")).alias("f"), F.when(F.col("fresh") == 1, -F.col("id")).otherwise(F.col("id")).alias("k"))).alias("lead"))
    own = F.struct((-F.col("fresh")).alias("f"), F.when(F.col("fresh") == 1, -F.col("id")).otherwise(F.col("id")).alias("k"))
    told = kept.join(lead, "origin", "left").withColumn("own", own)
    follows = (F.col("fresh") == 1) & ~F.col("original") & F.col("lead").isNotNull()
    place = F.struct(F.when(follows, F.col("lead")).otherwise(F.col("own")).alias("by"), follows.cast("int").alias("after"), F.when(follows, -F.col("id")).otherwise(F.lit(0)).alias("nth"))
    return told.select(F.col("markdown_path").alias("path"), "id", place.alias("place"))


def latest_states(events: DataFrame, key: str) -> DataFrame:
    """(key, status, tries): the state that a job's events leave it in: a failed one is queued again while it
    has tries left, and nothing follows done."""
    done = F.max(F.when(F.col("event") == "done", F.struct("at", "id")))
    last = F.max_by("event", F.struct("at", "id"))
    tries = F.count_if(F.col("event") == "failed")
    g = events.groupBy(key).agg(done.alias("done"), last.alias("last"), tries.alias("tries"))
    return g.select(key, F.when(F.col("done").isNotNull(), "done").when((F.col("last") == "failed") & (F.col("tries") < 3), "queued").otherwise(F.col("last")).alias("status"), "tries")


def autosaves(sessions: DataFrame) -> DataFrame:
    """(key, at): seconds after the start of each session at which its notes are written: 60, then each 180."""
    return sessions.where("seconds >= 60").select("key", F.explode(F.sequence(F.lit(60), F.col("seconds"), F.lit(180))).alias("at"))


def moved_bookmarks(marks: DataFrame, moves: DataFrame) -> DataFrame:
    """(doc_id, ord, line_no): bookmarks after their document's line map."""
    m = moves.select("doc_id", F.col("old_line").alias("line_no"), F.col("new_line").alias("to"))
    return marks.join(m, ["doc_id", "line_no"], "left").select("doc_id", "ord", F.coalesce("to", "line_no").cast("int").alias("line_no"))


def rewritten_path(path: Column, old: str, new: str) -> Column:
    """A stored path after a folder was renamed."""
    inside = (path == old) | F.startswith(path, F.lit(f"{old}/"))
    return F.when(inside, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def wants_chapters(docs: DataFrame, headings: DataFrame, *, most: int = 80_000, few: int = 5) -> DataFrame:
    """(doc_id): texts without an outline that are short enough and have fewer than five headings."""
    n = headings.groupBy("doc_id").agg(F.count("*").alias("n"))
    small = docs.where(F.octet_length("text") < most).select("doc_id")
    return small.join(n, "doc_id", "left").where(F.coalesce("n", F.lit(0)) < few).select("doc_id")


def listed(c: Column) -> Column:
    """Names between semicolons, clean; those between commas too stand in ``keywords``."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def scrubbed_summary(c: Column) -> Column:
    return T.home_scrubbed(c)
