"""Operators on ordered lines and chunks: state machines as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions import text as X

ARTICLE_LINE = "^\\s*(第[一二三四五六七八九十百千万〇零0-9]+条)\\s*([^\\n]{0,80})"


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of each text, numbered from 1; null texts give none, an empty one gives one empty line."""
    return documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(X.newline_form(F.col(text)), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


#: Places of a group's order that one task takes; a group may hold a large part of all rows.
STRETCH = 4096


def counted(rows: DataFrame, group: str, order: str, **flags: Column) -> DataFrame:
    """`rows` with the count of each flag's rows of their group up to their place, as a column of the flag's name.

    A group is counted in stretches of its order, each shifted by the counts of those before it, so no task sees a whole group.
    """
    told = rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH)).withColumns({f"_flag_{n}": F.coalesce(c, F.lit(False)).cast("int") for n, c in flags.items()})
    before = Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = told.groupBy(group, "_stretch").agg(*[F.sum(f"_flag_{n}").alias(f"_flag_{n}") for n in flags])
    shifts = sizes.select(group, "_stretch", *[F.coalesce(F.sum(f"_flag_{n}").over(before), F.lit(0)).alias(f"_shift_{n}") for n in flags])
    inside = Window.partitionBy(group, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = told.withColumns({n: F.sum(f"_flag_{n}").over(inside) for n in flags}).drop(*[f"_flag_{n}" for n in flags])
    out = local.join(shifts, [group, "_stretch"]).withColumns({n: (F.col(n) + F.col(f"_shift_{n}")).cast("bigint") for n in flags})
    return out.drop("_stretch", *[f"_shift_{n}" for n in flags])


def articles(documents: DataFrame, key: str, text: str, at_least: int = 20) -> DataFrame:
    """(key, seq, clause_no, clause_title, clause_text): a text cut at the lines that begin with an article number.

    What stands before the first article is left out, and so are articles of fewer than `at_least` characters; a text without articles gives none.
    """
    grouped = counted(lines(documents, key, text), key, "line_no", part=F.col("line").rlike(ARTICLE_LINE)).where("part > 0")
    whole = grouped.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    body = X.stripped(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    head = F.col("ls")[0]["line"]
    no = F.regexp_extract(head, ARTICLE_LINE, 1)
    title = F.regexp_replace(F.regexp_extract(head, ARTICLE_LINE, 2), "^[ ：:;；\\t]+|[ ：:;；\\t]+$", "")
    out = whole.select(key, "part", no.alias("clause_no"), F.when(title == "", no).otherwise(F.substring(title, 1, 255)).alias("clause_title"), body.alias("clause_text"))
    return numbered_within(out.where(F.char_length("clause_text") >= at_least), key, "part", "seq", tie="part").select(key, "seq", "clause_no", "clause_title", "clause_text")


def packed_paragraphs(documents: DataFrame, key: str, text: str, budget: int = 1200, at_least: int = 20) -> DataFrame:
    """(key, seq, clause_no, clause_title, clause_text): paragraphs packed in order while their lengths stay within `budget`.

    Paragraphs are parted by blank lines; those under `at_least` characters are left out unless nothing else is there. A longer one stands alone.
    """
    whole = X.newline_form(F.col(text))
    kept = F.filter(F.transform(F.split(whole, "\\n{2,}"), X.stripped), lambda p: F.char_length(p) >= at_least)
    paragraphs = F.when(F.size(kept) > 0, kept).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    packs = F.aggregate(
        paragraphs,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size")),
        lambda s, p: F.when(s["size"] == 0, F.struct(s["done"].alias("done"), p.alias("open"), F.char_length(p).alias("size")))
        .when(s["size"] + F.char_length(p) <= budget, F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit("\n\n"), p).alias("open"), (s["size"] + F.char_length(p)).alias("size")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), p.alias("open"), F.char_length(p).alias("size"))),
        lambda s: F.when(s["size"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]),
    )
    out = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(packs).alias("p", "clause_text"))
    first = X.first_sentence(F.col("clause_text"), 36)
    seq = F.col("p") + 1
    return out.select(key, seq.alias("seq"), F.format_string("AUTO-%03d", seq).alias("clause_no"), F.when(first == "", F.concat(F.lit("自动条款"), seq.cast("string"))).otherwise(first).alias("clause_title"), "clause_text")


def nearest_before(rows: DataFrame, group: str, order: str, anchor: Column, value: Column, within: int) -> DataFrame:
    """`rows` with `nearest`: the value of the last earlier anchor row of the group, '' if there is none or it is more than `within` away.

    A group is taken in stretches of its order, each with a copy of the anchors up to `within` before it, so no task sees a whole group. Rows need an `id`.
    """
    size = max(STRETCH, within)
    told = rows.withColumn("_anchor", F.coalesce(anchor, F.lit(False))).withColumn("_part", F.floor(F.col(order) / size)).withColumn("_copy", F.lit(False))
    tail = told.where(F.col("_anchor") & (F.col(order) % size >= size - within)).withColumn("_part", F.col("_part") + 1).withColumn("_copy", F.lit(True))
    w = Window.partitionBy(group, "_part").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)
    both = told.unionByName(tail)
    last = F.last(F.when(F.col("_anchor"), F.struct(F.col(order).alias("at"), value.alias("v"))), ignorenulls=True).over(w)
    near = both.withColumn("_last", last).where(~F.col("_copy"))
    found = F.when(F.col(order) - F.col("_last.at") <= within, F.col("_last.v"))
    return near.withColumn("nearest", F.coalesce(found, F.lit(""))).drop("_last", "_anchor", "_part", "_copy")


def numbered_within(rows: DataFrame, group: str, order: str, name: str, tie: str = "id") -> DataFrame:
    """`rows` with their number from 1 in their group by `order`, then `tie`: counted in stretches, each shifted by the rows of those before it."""
    told = rows.withColumn("_part", F.floor(F.col(order) / STRETCH))
    sizes = told.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order, tie))
    return told.withColumn("_i", inside).join(shifts, [group, "_part"]).withColumn(name, (F.col("_i") + F.col("_shift")).cast("int")).drop("_part", "_i", "_shift")


def merged_wraps(chunks: DataFrame) -> DataFrame:
    """Chunks whose continuation rows (section 'base.p…' directly behind the base section's row) are joined to them, numbered anew.

    A base is joined if it is an article, short, or does not end a sentence; else its rows stay as they are. Rows without a base stay too.
    A base and its rows share the base's section; those of one section that stand together make a group, however large the document is.
    """
    sec = X.stripped(F.col("section_no"))
    title = X.is_title(F.col("content"), F.col("section_title"), F.col("subsection_title")) == 1
    told = numbered_within(chunks, "document_id", "chunk_no", "_at").withColumn("_sec", sec).withColumn("_title", title)
    told = told.withColumn("_key", F.when(F.col("_title") | (F.col("_sec") == ""), F.concat(F.lit("#"), F.col("_at").cast("string"))).otherwise(F.regexp_replace("_sec", "\\.p.*$", "")))
    # only sections that have continuation rows are looked at closer
    wrapped = told.where(F.col("_sec").contains(".p")).select("document_id", "_key").distinct()
    others = told.join(wrapped, ["document_id", "_key"], "left_anti").select(*chunks.columns)
    told = told.join(wrapped, ["document_id", "_key"], "left_semi")
    together = Window.partitionBy("document_id", "_key").orderBy("_at")
    told = told.withColumn("_island", F.col("_at") - F.row_number().over(together))
    inside = Window.partitionBy("document_id", "_key", "_island").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    base = (~F.col("_title")) & (F.col("_sec") != "") & (~F.col("_sec").contains(".p"))
    told = told.withColumn("_run", F.sum(base.cast("int")).over(inside)).withColumn("_base", base)
    text = X.collapsed(F.col("content"))
    whole = told.groupBy("document_id", "_key", "_island", "_run").agg(
        F.min_by(F.struct(*chunks.columns), "_at").alias("first"),
        F.max("_base").alias("based"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", text.alias("t")))), lambda x: x["t"]), "").alias("joined"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("_at", F.struct(*chunks.columns).alias("row")))).alias("all"),
    )
    start = X.collapsed(F.col("first.content"))
    worth = (start != "") & (X.stripped(F.col("first.section_no")).rlike("^第[\\u4e00-\\u9fa5\\d]+条$") | (F.char_length(start) <= 32) | (~start.rlike("[。！？；.!?;]$")))
    join = F.col("based") & (F.col("n") > 1) & worth
    one = F.array(F.col("first").withField("content", F.when(join, F.col("joined")).otherwise(F.col("first.content"))))
    rows = whole.select(F.explode(F.when(join, one).otherwise(F.transform("all", lambda x: x["row"]))).alias("r")).select("r.*")
    return numbered_within(rows.unionByName(others), "document_id", "chunk_no", "_new").withColumn("chunk_no", F.col("_new")).drop("_new").select(*chunks.columns)


def chunks_of_lines(numbered: DataFrame, key: str) -> DataFrame:
    """(key, chunk_no, section_no, subsection_no, content) of ordered (key, line_no, line): chapters and articles open sections and chunks.

    A chapter line opens a section, an article line a chunk whose text begins after its number; other lines go
    on with what is open. What stands before the first chapter or article counts only if there is neither. Empty chunks are left out.
    """
    chapter = X.numeral_value(F.regexp_extract("line", f"^\\s*第\\s*([{X.NUMERAL}]+)\\s*章", 1))
    article = X.numeral_value(F.regexp_extract("line", f"^\\s*第\\s*([{X.NUMERAL}]+)\\s*条", 1))
    rest = F.regexp_replace("line", f"^\\s*第\\s*[{X.NUMERAL}]+\\s*条[\\s　]*", "")
    told = numbered.withColumn("c", F.when(chapter > 0, chapter)).withColumn("a", F.when(article > 0, article))
    body = F.when(F.col("c").isNotNull(), "").when(F.col("a").isNotNull(), rest).otherwise(F.col("line"))
    parts = opened_parts(told.withColumn("body", X.stripped(body)), key, {"article": F.max("a")})
    parts = parts.where(~X.is_empty_body(F.col("content")))
    return numbered_within(parts, key, "part", "chunk_no", tie="part").select(key, "chunk_no", F.coalesce(F.col("section"), F.lit(1)).cast("string").alias("section_no"), F.col("article").cast("string").alias("subsection_no"), "content")


def opened_parts(told: DataFrame, key: str, more: dict[str, Column]) -> DataFrame:
    """(key, part, section, content, more...) of lines (key, line_no, c, a, body) that a chapter `c` or an article `a` opens; those before the first count only if there is none."""
    told = counted(told, key, "line_no", part=F.col("c").isNotNull() | F.col("a").isNotNull(), chapters=F.col("c").isNotNull())
    chapters = told.where("c is not null").select(key, "chapters", F.col("c").alias("section"))
    structured = told.where("part > 0").select(key).distinct().withColumn("_any", F.lit(True))
    kept = told.join(structured, key, "left").where("part > 0 or _any is null")
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), lambda x: x != ""), "\n")
    parts = kept.groupBy(key, "part").agg(F.max("chapters").alias("chapters"), text.alias("content"), *[c.alias(n) for n, c in more.items()])
    return parts.join(chapters, [key, "chapters"], "left").drop("chapters")


def is_title_line(line: Column, title: Column) -> Column:
    """Whether a line repeats its document's title, whole or for the most part; a chapter's or article's heading never does."""
    x, t = X.comparison_form(line), X.comparison_form(title)
    heading = line.rlike(f"^第\\s*[{X.NUMERAL}]+\\s*[章条]")
    return ~heading & (x != "") & (t != "") & ((x == t) | ((F.char_length(x) >= 6) & (t.contains(x) | x.contains(t))))


def chunk_confidence(confidence: Column, section: Column, subsection: Column, content: Column) -> Column:
    """How sure a chunk is: that of its lines, less without a section, with an article's number in the text, or without a text; from 0 to 1."""
    less = F.when(X.first_digits(section) == "", 0.35).otherwise(0.0) + F.when((X.first_digits(subsection) == "") & content.rlike(f"^第\\s*[{X.NUMERAL}]+\\s*条"), 0.25).otherwise(0.0) + F.when(X.is_empty_body(content), 0.45).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.7)) - less))


def page_chunks(lines_of_pages: DataFrame, key: str) -> DataFrame:
    """(key, chunk_no, section_no, section_title, subsection_no, subsection_title, content, page_no, confidence) of lines (key, title, page_no, line_no, line) in order.

    As `chunks_of_lines`; lines that repeat the document's title are left out, a chunk is on the page of its first line and as sure as its least sure one.
    """
    line = X.collapsed(F.col("line"))
    number = lambda kind: X.numeral_value(F.regexp_extract("line", f"^第\\s*([{X.NUMERAL}]+)\\s*{kind}", 1))
    rest = lambda kind: X.stripped(F.regexp_replace("line", f"^第\\s*[{X.NUMERAL}]+\\s*{kind}[：:\\s、．.]*", ""))
    told = lines_of_pages.withColumn("line", line).where("line <> ''").withColumn("c", F.when(number("章") > 0, number("章"))).withColumn("a", F.when(F.col("c").isNull() & (number("条") > 0), number("条")))
    # a heading in brackets at the head of an article is no part of it
    said = F.regexp_replace(rest("条"), "^[（(【\\[《][^）)】\\]》]{1,24}[）)】\\]》][：:、，,\\s]*", "")
    body = F.when(F.col("c").isNotNull(), "").when(F.col("a").isNotNull(), F.when(is_title_line(said, F.col("title")), "").otherwise(said)).when(is_title_line(F.col("line"), F.col("title")), "").otherwise(F.col("line"))
    told = told.withColumn("body", body).withColumn("tail", F.when(F.col("c").isNotNull(), rest("章")))
    tails = counted(told, key, "line_no", chapters=F.col("c").isNotNull()).where("c is not null").select(key, F.col("chapters").alias("_nth"), "tail")
    counted_lines = counted(told, key, "line_no", before=F.col("c").isNotNull() | F.col("a").isNotNull()).withColumn("sure", F.when(F.col("body") == "", F.lit(None)).when(F.col("a").isNotNull(), 0.92).when(F.col("before") == 0, 0.84).otherwise(0.88)).drop("before")
    whole = {"article": F.max("a"), "page": F.min_by("page_no", F.when(F.col("body") != "", F.col("line_no"))), "sure": F.min("sure"), "_nth": F.max("chapters")}
    parts = opened_parts(counted_lines, key, whole).where(~X.is_empty_body(F.col("content"))).join(tails, [key, "_nth"], "left")
    section = F.coalesce(F.col("section"), F.lit(1).cast("bigint"))
    title = F.concat(F.lit("第"), X.numeral_text(section), F.lit("章"), F.when(F.coalesce("tail", F.lit("")) != "", F.concat(F.lit(" "), F.col("tail"))).otherwise(""))
    sub = F.col("article").cast("string")
    out = numbered_within(parts, key, "part", "chunk_no", tie="part").select(
        key, "chunk_no", section.cast("string").alias("section_no"), title.alias("section_title"), sub.alias("subsection_no"),
        F.when(F.col("article").isNotNull(), F.concat(F.lit("第"), X.numeral_text(F.col("article")), F.lit("条"))).alias("subsection_title"), X.collapsed(F.col("content")).alias("content"), F.col("page").alias("page_no"), "sure",
    )
    return out.withColumn("confidence", F.round(chunk_confidence(F.col("sure"), F.col("section_no"), F.col("subsection_no"), F.col("content")), 2)).drop("sure")


def backfilled_parents(chunks: DataFrame, article: Column, item: Column, name: Column, within: int = 24) -> DataFrame:
    """(id, parent) of the item rows without a parent of their own, from the last article row up to `within` places before them in their document.

    This is the dry run; `with_parents_filled` puts them in.
    """
    near = nearest_before(chunks, "document_id", "chunk_no", article, name, within)
    own = X.parent_section(F.col("section_no"), F.col("subsection_no"))
    return near.where(item & ~F.coalesce(article, F.lit(False)) & (own == "") & (F.col("nearest") != "")).select("id", F.col("nearest").alias("parent"))


def with_parents_filled(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """`chunks` with `parent_section`: their own, else the one found for them."""
    own = X.parent_section(F.col("section_no"), F.col("subsection_no"))
    return chunks.join(parents, "id", "left").withColumn("parent_section", F.when(own != "", own).otherwise(F.coalesce("parent", F.lit("")))).drop("parent")


#: An article's number, a list item's mark, what a text that announces a list holds, and what a continuing title opens with or holds (fixed values).
ARTICLE = "^第[\\u4e00-\\u9fa5\\d]+条$"
LIST_ITEM = "^(?:[（(][\\u4e00-\\u9fa5\\d]{1,4}[）)]|[\\u4e00-\\u9fa5\\d]{1,4}[.、])"
LEADS, GOES_ON = "以下|如下|原则|要点|路径|程序|职责", "^用，|主要|履行|职责|[以如]下|^原则"


def _list_item(section: Column) -> Column:
    return (section != "") & F.regexp_replace(section, "\\.[ps].*$", "").rlike(LIST_ITEM)


def leads(text: Column) -> Column:
    """Whether a text announces what follows it."""
    return (text != "") & (text.rlike("[：:]$") | ((F.char_length(text) <= 80) & text.rlike(LEADS)))


def _goes_on(text: Column) -> Column:
    """Whether a title continues the chunk before it."""
    return (text != "") & (F.char_length(text) <= 36) & text.rlike(GOES_ON)


def effective_contents(chunks: DataFrame, titles_within: int = 6, items_within: int = 20, most: int = 12, budget: int = 1500) -> DataFrame:
    """(id, effective) of the chunks that stand for more than their own content.

    An article takes up to two continuing titles behind it; a content that announces a list takes the list's items behind it, different ones, until another
    section begins, there are `most`, or they have `budget` characters; a chunk without content takes its section's first six children. Chunk numbers must be
    unique in a document; only chunks that may take something look at those behind them, by their numbers.
    """
    rows = chunks.select(
        "id", "document_id", "chunk_no",
        X.stripped(F.col("section_no")).alias("sec"),
        X.parent_section(F.col("section_no"), F.col("subsection_no")).alias("parent"),
        (X.is_title(F.col("content"), F.col("section_title"), F.col("subsection_title")) == 1).alias("title"),
        X.stripped(F.col("content")).alias("own"),
        X.collapsed(F.col("content")).alias("text"),
        X.collapsed(F.coalesce("section_title", "content")).alias("heading"),
    )
    empty = X.is_empty_body(F.col("own"))
    article = F.col("sec").rlike(ARTICLE)
    may = rows.where(~empty & (article | leads(F.col("text"))))
    behind = rows.select("document_id", F.col("chunk_no").alias("at"), F.struct("chunk_no", "sec", "parent", "title", "text", "heading").alias("row"))
    reach = may.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(items_within)), lambda k: F.col("chunk_no") + k)))
    met = reach.join(behind, ["document_id", "at"]).groupBy("id", "document_id", "chunk_no", "sec", "own", "text").agg(F.array_sort(F.collect_list("row")).alias("next"))

    state = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("stop"))
    near = F.filter("next", lambda r: r["chunk_no"] - F.col("chunk_no") <= titles_within)

    def title_step(s: Column, r: Column) -> Column:
        said = ~X.is_empty_body(r["heading"])
        same, over = s, F.struct(s["parts"].alias("parts"), F.lit(True).alias("stop"))
        more = F.struct(F.concat(s["parts"], F.array(r["heading"])).alias("parts"), (F.size(s["parts"]) + 1 >= 2).alias("stop"))
        return F.when(s["stop"], same).when(~r["title"], F.when(F.size(s["parts"]) > 0, over).otherwise(same)).when(~said, same).when(_goes_on(r["heading"]), more).otherwise(over)

    continued = F.when(F.col("sec").rlike(ARTICLE), F.aggregate(near, state, title_step)["parts"]).otherwise(F.array().cast("array<string>"))
    lead = F.when(F.size(continued) > 0, F.concat(F.col("own"), F.lit(" "), F.array_join(continued, " "))).otherwise(F.col("own"))
    told = met.withColumn("lead", lead)

    items = F.struct(F.array().cast("array<string>").alias("parts"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("size"), F.lit(False).alias("stop"))

    def item_step(s: Column, r: Column) -> Column:
        over = s.withField("stop", F.lit(True))
        base = F.regexp_replace(r["sec"], "\\.[ps].*$", "")
        listed = _list_item(r["sec"])
        inside = (r["parent"] == F.col("sec")) | listed | _list_item(r["parent"]) | ((r["parent"] != "") & F.array_contains(s["seen"], r["parent"]))
        seen = F.when((r["parent"] != F.col("sec")) & listed, F.concat(s["seen"], F.array(base))).otherwise(s["seen"])
        size = s["size"] + F.char_length(r["text"])
        more = F.struct(F.concat(s["parts"], F.array(r["text"])).alias("parts"), seen.alias("seen"), size.alias("size"), ((F.size(s["parts"]) + 1 >= most) | (size >= budget)).alias("stop"))
        started = F.size(s["parts"]) > 0
        return (
            F.when(s["stop"], s)
            .when(r["title"], F.when(~started & _goes_on(r["heading"]), s).otherwise(over))
            .when(r["sec"].rlike(ARTICLE), over)
            .when(~inside, F.when(started, over).otherwise(s))
            .when(X.is_empty_body(r["text"]), s.withField("seen", seen))
            .otherwise(more)
        )

    listed = F.when(leads(X.collapsed(F.col("lead"))), F.aggregate("next", items, item_step)["parts"]).otherwise(F.array().cast("array<string>"))
    different = F.aggregate(
        listed,
        F.struct(F.array().cast("array<string>").alias("parts"), F.array(X.comparison_form(F.col("lead"))).alias("norms")),
        lambda s, t: F.when((X.comparison_form(t) == "") | F.array_contains(s["norms"], X.comparison_form(t)), s).otherwise(F.struct(F.concat(s["parts"], F.array(t)).alias("parts"), F.concat(s["norms"], F.array(X.comparison_form(t))).alias("norms"))),
    )["parts"]
    stitched = told.withColumn("items", different).select("id", F.array_join(F.concat(F.array("lead"), F.col("items")), " ").alias("effective"), "own").where("effective <> own").select("id", "effective")

    children = rows.where(~empty & (F.col("parent") != "")).withColumn("n", F.row_number().over(Window.partitionBy("document_id", "parent").orderBy("chunk_no", "id"))).where("n <= 6")
    joined = children.groupBy("document_id", F.col("parent").alias("sec")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("effective"))
    return stitched.unionByName(rows.where(empty & (F.col("sec") != "")).join(joined, ["document_id", "sec"]).select("id", "effective"))
