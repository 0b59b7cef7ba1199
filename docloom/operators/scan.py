"""Rules that depend on the lines before, as scans in two levels: a long document spans many tasks.

A rule whose memory is one of a few states turns each line into a small table, the state after it for
each state before it. Tables compose, so a chunk of lines has one, the chunks of a document are
gone through by those alone, and each chunk is then finished from the state that it begins in. Counts
and nearest values go the same way. What is exchanged of a line is its number and its table.

An edit is (doc_id, line_no, text, back): the new text of a line, or null where the line goes. A line
that goes lands on the next that stays, one with ``back`` on the last before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import by_shuffle, written

CHUNK = 512
#: White space at a line's end, line breaks among it.
ENDS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$"


def table(after: Sequence[int]) -> Column:
    """The table of a line: ``after[s]`` is the state that follows state ``s``; 15 states at most."""
    return F.lit(sum(to << (4 * s) for s, to in enumerate(after)))


def _next(step: Column, state: Column) -> Column:
    return F.call_function("shiftright", step, state * 4).bitwiseAND(F.lit(15))


def _chunked(lines: DataFrame, chunk: int) -> DataFrame:
    return lines.withColumn("chunk", F.floor(F.col("line_no") / chunk).cast("int"))


def states(lines: DataFrame, step: str, number: int, *, first: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, state): the state before each line. ``step`` names the column with each line's table."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", F.col(step).cast("bigint").alias("step"))))
    parts = _chunked(lines.select("doc_id", "line_no", step), chunk).groupBy("doc_id", "chunk").agg(rows.alias("rows"))
    same = sum(s << (4 * s) for s in range(number))

    def composed(done: Column, row: Column) -> Column:
        each = [F.call_function("shiftleft", _next(row["step"], _next(done, F.lit(s)).cast("int")), F.lit(4 * s)) for s in range(number)]
        out = each[0]
        for x in each[1:]:
            out = out.bitwiseOR(x)
        return out

    whole = parts.select("doc_id", "chunk", F.aggregate("rows", F.lit(same).cast("bigint"), composed).alias("step"))
    begun = F.array().cast("array<struct<chunk: int, state: int>>")

    def entered(acc: Column, row: Column) -> Column:
        return F.struct(_next(row["step"], acc["state"]).cast("int").alias("state"), F.array_append(acc["out"], F.struct(row["chunk"].alias("chunk"), acc["state"].alias("state"))).alias("out"))

    start = F.struct(F.lit(first).alias("state"), begun.alias("out"))
    entry = whole.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "step"))).alias("chunks"))
    entry = entry.select("doc_id", F.explode(F.aggregate("chunks", start, entered)["out"]).alias("x")).select("doc_id", "x.*")
    told = F.array().cast("array<struct<line_no: int, state: int>>")

    def passed(acc: Column, row: Column) -> Column:
        return F.struct(_next(row["step"], acc["state"]).cast("int").alias("state"), F.array_append(acc["out"], F.struct(row["line_no"].alias("line_no"), acc["state"].alias("state"))).alias("out"))

    made = parts.join(by_shuffle(entry), ["doc_id", "chunk"]).select("doc_id", F.explode(F.aggregate("rows", F.struct(F.col("state").alias("state"), told.alias("out")), passed)["out"]).alias("x"))
    return made.select("doc_id", "x.*")


def nearest(lines: DataFrame, values: dict[str, Column], *, chunk: int = CHUNK) -> DataFrame:
    """``lines`` with, for each (name, value), ``name``: the value of the nearest line before that has one, or
    after, for names that begin with ``next``."""
    own = _chunked(lines, chunk)
    for name, value in values.items():
        own = own.withColumn(f"own_{name}", value)
    ends = own.groupBy("doc_id", "chunk").agg(*(((F.min_by if n.startswith("next") else F.max_by)(f"own_{n}", F.when(F.col(f"own_{n}").isNotNull(), F.col("line_no")))).alias(n) for n in values))
    back, ahead = W.partitionBy("doc_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("doc_id").orderBy("chunk").rowsBetween(1, W.unboundedFollowing)
    pick = lambda n, b, a, c: F.first(c, ignorenulls=True).over(a) if n.startswith("next") else F.last(c, ignorenulls=True).over(b)
    ends = ends.select("doc_id", "chunk", *(pick(n, back, ahead, F.col(n)).alias(f"far_{n}") for n in values))
    inner = W.partitionBy("doc_id", "chunk").orderBy("line_no")
    near = own.withColumns({f"near_{n}": pick(n, inner.rowsBetween(W.unboundedPreceding, -1), inner.rowsBetween(1, W.unboundedFollowing), F.col(f"own_{n}")) for n in values})
    out = near.join(by_shuffle(ends), ["doc_id", "chunk"])
    return out.select(*lines.columns, *(F.coalesce(f"near_{n}", f"far_{n}").alias(n) for n in values))


def as_of(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, section, page): the title that each line stands under, its own counted, and the page at or
    above it; a document's lines may lie in many tasks."""
    title = T.heading_text(F.col("text"))
    told = lines.select("doc_id", "line_no", title.alias("title"), T.page_comment(F.col("text")).alias("mark"))
    told = written(told.withColumn("title", F.when(~T.page_like(F.col("title")), F.col("title"))), "as-of")
    near = nearest(told, {"section": F.col("title"), "page": F.col("mark")}, chunk=chunk)
    return near.select("doc_id", "line_no", F.coalesce("title", "section").alias("section"), F.coalesce("mark", "page").alias("page"))


def line_map(lines: DataFrame, edits: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, old_line, new_line) under ``edits``, by counts of the lines that stay."""
    gone = edits.where("text is null").select("doc_id", "line_no", "back", F.lit(0).alias("stays"))
    both = lines.select("doc_id", "line_no").join(by_shuffle(gone), ["doc_id", "line_no"], "left")
    own = _chunked(both.withColumn("stays", F.coalesce("stays", F.lit(1))), chunk)
    sums = own.groupBy("doc_id", "chunk").agg(F.sum("stays").alias("sum"))
    by_chunk = W.partitionBy("doc_id").orderBy("chunk")
    sums = sums.select("doc_id", "chunk", (F.sum("sum").over(by_chunk) - F.col("sum")).alias("base"), F.sum("sum").over(W.partitionBy("doc_id")).alias("total"))
    inner = W.partitionBy("doc_id", "chunk").orderBy("line_no")
    before = F.col("base") + F.sum("stays").over(inner) - F.col("stays")
    made = own.join(by_shuffle(sums), ["doc_id", "chunk"]).withColumn("before", before)
    to = F.when(F.col("stays") == 1, F.col("before")).when(F.col("back"), F.col("before") - 1).otherwise(F.least(F.col("before"), F.col("total") - 1))
    return made.select("doc_id", F.col("line_no").alias("old_line"), F.greatest(F.lit(0), to).cast("int").alias("new_line"))


def renumbered(asked: DataFrame, edits: DataFrame) -> DataFrame:
    """``asked`` (doc_id, line_no, ..), lines that stay, with ``line``: their numbers under ``edits``. No other lines are
    read: a number falls by the lines before that go."""
    gone = edits.where("text is null").select("doc_id", "line_no", F.lit(1).alias("gone"))
    both = asked.withColumn("gone", F.lit(0)).unionByName(gone, allowMissingColumns=True)
    before = F.sum("gone").over(W.partitionBy("doc_id").orderBy("line_no"))
    return both.withColumn("line", (F.col("line_no") - before).cast("int")).where("gone = 0").drop("gone")


def is_fence(t: Column) -> Column:
    return t.rlike("^(```|~~~)")


def with_free(told: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``told``, what a rule needs of each line, with ``free`` in place of ``fence``: whether a line stands outside
    fences and is none. Texts are read once: what is needed of them is written, and steps go on from there."""
    held = written(told, "told")
    inside = states(held.select("doc_id", "line_no", F.when(F.col("fence"), table([1, 0])).otherwise(table([0, 1])).alias("step")), "step", 2, chunk=chunk)
    return held.join(by_shuffle(inside), ["doc_id", "line_no"]).withColumn("free", (F.col("state") == 0) & ~F.col("fence")).drop("state", "fence")


def free(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, free): whether a line stands outside fences and is no fence."""
    return with_free(lines.select("doc_id", "line_no", is_fence(T.trim(F.col("text"))).alias("fence")), chunk)


def _edit(df: DataFrame, text: Column, back: Column | None = None) -> DataFrame:
    return df.select("doc_id", "line_no", text.cast("string").alias("text"), (F.lit(False) if back is None else back).alias("back"))


def hyphens(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Edits: words broken at line ends put together, through as many lines as break."""
    t = F.regexp_replace(F.col("text"), ENDS, "")
    told = lines.select("doc_id", "line_no", (t.rlike(r"\p{L}[-\x{ad}\x{2010}]$") & T.heading_text(F.col("text")).isNull()).alias("breaks"), T.trim(F.col("text")).rlike(r"^\p{L}").alias("goes_on"), is_fence(T.trim(F.col("text"))).alias("fence"))
    told = written(with_free(told, chunk).where("free"), "breaks")
    at = told.where("breaks").select("doc_id", (F.col("line_no") + 1).alias("line_no")).withColumn("above", F.lit(True))
    joins = told.where("goes_on").join(by_shuffle(at), ["doc_id", "line_no"]).select("doc_id", "line_no")
    # Lines that join one another follow without a gap, so their number less their rank is one for each group.
    group = joins.withColumn("run", F.col("line_no") - F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")))
    group = group.select("doc_id", "line_no", (F.min("line_no").over(W.partitionBy("doc_id", "run")) - 1).alias("head"))
    heads = group.select("doc_id", F.col("head").alias("line_no"), "head").distinct()
    parts = lines.select("doc_id", "line_no", "text").join(by_shuffle(group.unionByName(heads)), ["doc_id", "line_no"])
    made = parts.groupBy("doc_id", "head").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    body = lambda x, i: F.when(i == 0, x["text"]).otherwise(T.trim(x["text"]))
    said = F.transform("rows", lambda x, i: F.when(i == F.size("rows") - 1, body(x, i)).otherwise(F.regexp_replace(F.regexp_replace(body(x, i), ENDS, ""), r"(?s).$", "")))
    return _edit(made.withColumn("line_no", F.col("head")), F.array_join(said, "")).unionByName(_edit(joins, F.lit(None)))


def repeated_marks(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Edits: page marks met before go, and so does a page's first line if it repeats an earlier heading."""
    t = F.col("t")
    told = lines.select("doc_id", "line_no", T.trim(F.col("text")).alias("t"))
    told = told.select("doc_id", "line_no", "t", T.page_comment(t).alias("mark"), T.heading_text(t).alias("title"))
    said, short = F.col("mark").isNull() & (t != ""), F.length(F.coalesce("title", "t")) <= 80
    key = F.when(said & (short | F.col("title").isNotNull()), T.folded(F.coalesce("title", "t")))
    told = told.select("doc_id", "line_no", "mark", said.alias("said"), is_fence(t).alias("fence"), key.alias("key"), (short & ~t.rlike(r"^(!\[|\||>)") & ~T.contents_line(t)).alias("top"), F.col("title").isNotNull().alias("head"))
    told = told.select("doc_id", "line_no", "mark", "said", "fence", F.col("fence").alias("is_fence"), F.when(F.col("top") & (F.length("key") >= 2), F.col("key")).alias("key"), F.when(F.col("head"), F.col("key")).alias("head"))
    told = with_free(told, chunk)
    told = written(told.select("doc_id", "line_no", F.col("is_fence").alias("fence"), *(F.when(F.col("free"), F.col(c)).alias(c) for c in ("mark", "said", "key", "head"))), "marks")
    first = told.where("mark is not null").groupBy("doc_id", "mark").agg(F.min("line_no").alias("line_no")).withColumn("new", F.lit(True))
    marked = told.join(by_shuffle(first.select("doc_id", "line_no", "new")), ["doc_id", "line_no"], "left")
    step = F.when(F.col("new"), table([1, 1])).when(F.col("said") | F.col("fence"), table([0, 0])).otherwise(table([0, 1]))
    fresh = states(marked.withColumn("step", step), "step", 2, chunk=chunk).where("state = 1").select("doc_id", "line_no")
    core = F.regexp_replace("head", r"^[0-9]+(\.[0-9]+)*\s+", "")
    heads = told.where("head is not null").select("doc_id", "line_no", F.explode(F.array("head", F.when(core.rlike(r"^\p{L}"), core))).alias("key")).where("key is not null")
    heads = heads.groupBy("doc_id", "key").agg(F.min("line_no").alias("first"))
    again = told.where("key is not null").join(by_shuffle(fresh), ["doc_id", "line_no"]).join(by_shuffle(heads), ["doc_id", "key"]).where("first < line_no").select("doc_id", "line_no")
    old = told.where("mark is not null").select("doc_id", "line_no").join(by_shuffle(first), ["doc_id", "line_no"], "left_anti")
    return _edit(again.unionByName(old), F.lit(None))


def ends_sentence(t: Column) -> Column:
    return t.rlike("[.!?…][\"”’')\\]}»]*$")


def blank_runs(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Edits: one blank line between paragraphs, none within a sentence or at the ends."""
    t = F.col("t")
    told = lines.select("doc_id", "line_no", T.trim(F.col("text")).alias("t"))
    mark = t.rlike(r"^(#|<!--|!\[|\||>)") | (t == "---")
    told = told.select("doc_id", "line_no", F.struct((t != "").alias("said"), mark.alias("mark"), ends_sentence(t).alias("ends"), t.rlike(r"^\p{L}").alias("letter")).alias("value"), is_fence(t).alias("fence"))
    blank = ~F.col("value.said") & F.col("free")
    told = written(with_free(told, chunk).select("doc_id", "line_no", blank.alias("blank"), F.when(~blank, F.col("value")).alias("value")), "blanks")
    near = nearest(told, {"last": F.col("value"), "next": F.when(F.col("value")["said"], F.col("value"))}, chunk=chunk)
    near = nearest(near, {"above": F.struct("blank", "line_no")}, chunk=chunk).where("blank")
    goes_on = ~F.col("last.mark") & ~F.col("next.mark") & F.col("next.letter") & ~F.col("last.ends")
    kept = F.coalesce(F.col("last.said") & F.col("next").isNotNull() & ~goes_on, F.lit(False))
    first = ~F.coalesce("above.blank", F.lit(False))
    return _edit(near, F.when(kept & first, F.lit("")), F.col("last").isNotNull())


# Words that a title does not end with, and the form of a citation.
DANGLING = ["and", "or", "the", "of", "a", "an", "as", "to", "for", "which", "where", "through", "but", "not", "yet"]
_CITE = r"(?:[1-3]\s+)?[A-Za-z][A-Za-z'’]*(?:\s+[A-Za-z][A-Za-z'’]*){0,3}\s+\d{1,3}\s*:\s*\d{1,3}(?:\s*[–—-]\s*\d{1,3})?"


def citation(t: Column) -> Column:
    """Whether a trimmed line, or the title that it is, has citations of a chapter and verse alone."""
    bare = F.btrim(F.coalesce(T.heading_text(t), t), F.lit("()[]“”\"'."))
    return F.length(bare).between(3, 80) & bare.rlike(rf"^{_CITE}(?:\s*;\s*{_CITE})*$")


def short_title(t: Column) -> Column:
    """Whether a trimmed line is a heading or could be one."""
    plain = (t != "") & ~T.roman(t) & ~t.rlike(r"^(<!--|!\[|\||•|- |\* )") & (F.length(t) <= 60) & ~t.rlike("[.!?]$") & F.size(T.title_words(t)).between(1, 10)
    return T.heading_text(t).isNotNull() | plain


def joined_headings(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Edits: a heading that ends in a word such as ``of`` takes the short line after it, which takes none then."""
    t = T.trim(F.col("text"))
    told = lines.select("doc_id", "line_no", t.alias("t"), T.heading_text(F.col("text")).alias("title"))
    told = told.withColumn("words", F.when(F.col("title").isNotNull(), T.title_words(F.col("title"))))
    open_ = F.coalesce(F.element_at("words", -1).isin(DANGLING), F.lit(False))
    told = told.select("doc_id", "line_no", (F.col("t") != "").alias("said"), (open_ & (F.size("words") > 0)).alias("open"), F.when(short_title(F.col("t")), F.coalesce("title", "t")).alias("short"), F.length(F.regexp_extract("t", "^(#*)", 1)).alias("marks"), F.when(open_, F.col("title")).alias("title"))
    near = nearest(written(told, "titles"), {"next": F.when(F.col("said"), F.struct("line_no", "short"))}, chunk=chunk)
    near = written(near.withColumn("takes", F.col("open") & F.col("next.short").isNotNull()), "headings")
    step = F.when(F.col("takes"), table([1, 0])).when(F.col("said"), table([0, 0])).otherwise(table([0, 1]))
    at = near.join(by_shuffle(states(near.withColumn("step", step), "step", 2, chunk=chunk)), ["doc_id", "line_no"])
    made = F.concat(F.expr("repeat('#', marks)"), F.lit(" "), F.col("title"), F.lit(" "), F.col("next.short"))
    taken = at.where("state = 1")
    return _edit(at.where("state = 0 and takes"), made).unionByName(_edit(taken, F.lit(None), F.lit(True)))


def subheadings(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Edits: titles in the body become headings, one level below the heading before them, to the third; a title
    right after a promoted one goes by that one's level.

    States: 0, a finished paragraph, a comment or nothing before; 1, a line that is not finished; 1 + n, a
    heading of level n.
    """
    t = F.col("t")
    told = lines.select("doc_id", "line_no", T.trim(F.col("text")).alias("t"))
    marks = F.length(F.regexp_extract(t, "^(#{1,6}) ", 1))
    form = t.rlike(r"^\p{Lu}") & ~ends_sentence(t) & ~t.rlike("[,;:]$") & F.length(t).between(8, 80) & F.size(F.filter(F.split(t, r"[\s\x{85}\p{Z}]+"), lambda w: w != "")).between(2, 14)
    told = told.select("doc_id", "line_no", (t != "").alias("said"), marks.alias("level"), (ends_sentence(t) | t.rlike("^<!--")).alias("told"), ((marks == 0) & form & ~citation(t) & ~T.contents_line(t) & ~t.rlike(r"^(<!--|!\[|\||>|- |\* |•)")).alias("form"), t.rlike(r"^\p{Lu}").alias("capital"), F.substring(t, 1, 80).alias("t"), is_fence(t).alias("fence"))
    told = written(with_free(told.withColumn("t", F.when(F.col("form"), F.col("t"))), chunk), "titles")
    near = nearest(told, {"next": F.when(F.col("said"), F.col("capital"))}, chunk=chunk)
    near = near.withColumn("form", F.col("form") & F.col("free") & F.coalesce("next", F.lit(False)))
    kind = F.when(F.col("level") > 0, F.col("level") + 1).when(F.col("told"), F.lit(0)).otherwise(F.lit(1))
    steady = sum((F.call_function("shiftleft", kind.cast("bigint"), F.lit(4 * s)) for s in range(1, 8)), kind.cast("bigint"))
    rise = [3, 1, *(min(3, n + 1) + 1 for n in range(1, 7))]
    near = written(near.withColumn("step", F.when(~F.col("said"), table(range(8))).when(F.col("form"), table(rise)).otherwise(steady)), "titles")
    at = near.where("form").join(by_shuffle(states(near, "step", 8, chunk=chunk)), ["doc_id", "line_no"]).where("state <> 1")
    level = F.when(F.col("state") == 0, F.lit(2)).otherwise(F.least(F.lit(3), F.col("state")))
    return _edit(at, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t))


def applied(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): the lines after ``edits``, with the numbers that they had."""
    both = lines.select("doc_id", "line_no", "text").join(edits.select("doc_id", "line_no", F.col("text").alias("new"), F.lit(True).alias("edited")), ["doc_id", "line_no"], "left")
    return both.where("edited is null or new is not null").select("doc_id", "line_no", F.when(F.col("edited"), F.col("new")).otherwise(F.col("text")).alias("text"))
