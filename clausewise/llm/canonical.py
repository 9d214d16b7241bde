"""One form for text that reads the same.

Every text is exploded to positioned code points, a batch of texts at a time and as columns, not as rows: these meet a
broadcast table, which decomposes them, folds them to the usual look-alike or removes them; combining marks are then ordered by
class behind their base, composed with it where a single code point exists, and the strings built again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.operators.durable import durable
from clausewise.operators.skew import spread

#: Look-alike letters (fixed values): Greek and Cyrillic letters with the shape of a Latin one.
LOOK_ALIKE = {
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    **dict(zip("οϲϳν", "ocjv")),
    **dict(zip("АВЕЅІЈКМНОРСТУХԚԜҮ", "ABESIJKMHOPCTYXQWY")),
    **dict(zip("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl")),
    "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ⅴ": "v", "ⅹ": "x", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ꓲ": "I", "‧": "·", "・": "·", "∙": "·", "⋅": "·", "･": "·",
}
#: Dashes that are not of the category of dashes.
MORE_DASHES = "−⁃˗"
#: Compatibility decompositions that keep the reading: the tags of width, breaking and font, and single equivalents.
READING_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
def reading(ch: str, depth: int = 0) -> str:
    """What a code point reads as, decomposed; '' for one that is invisible."""
    if ch in LOOK_ALIKE and LOOK_ALIKE[ch] != ch:
        return reading(LOOK_ALIKE[ch], depth + 1)
    category, cp = unicodedata.category(ch), ord(ch)
    if category == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x034F):
        return ""
    if category == "Zs" or ch == "\t":
        return " "
    if category == "Pd" or ch in MORE_DASHES:
        return "-"
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0][0] == "<":
        single = parts[0] == "<compat>" and (len(parts) == 2 or 0xFB00 <= cp <= 0xFB06)
        parts = parts[1:] if parts[0] in READING_TAGS or single else []
    if not parts or 0xAC00 <= cp <= 0xD7A3 or depth > 8:
        return ch
    return "".join(reading(chr(int(x, 16)), depth + 1) for x in parts)


#: Code points taken at a time; a longer text is taken by itself.
PORTION = 1_000_000
#: Rows of one form that meet in one task.
FORM_PART = 1_000


class Table(NamedTuple):
    """What each code point becomes, by rule from the Unicode tables of Python: some 10 MB, whatever the data."""

    #: How many code points come out of each, and where they stand in `pool`; -1 for one that stays.
    size: np.ndarray
    offset: np.ndarray
    pool: np.ndarray
    #: Combining class of each code point, 0 for a base.
    order: np.ndarray
    #: What two code points compose to.
    pairs: dict[tuple[int, int], int]


def mapping() -> Table:
    size, offset, order = np.ones(0x110000, dtype=np.uint8), np.full(0x110000, -1, dtype=np.int32), np.zeros(0x110000, dtype=np.uint8)
    pool: list[int] = []
    pairs: dict[tuple[int, int], int] = {}
    for cp in (*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        order[cp] = unicodedata.combining(ch)
        r = reading(ch)
        if r != ch:
            size[cp], offset[cp] = len(r), len(pool)
            pool += map(ord, r)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch)) == ch:
            pairs[int(parts[0], 16), int(parts[1], 16)] = cp
    return Table(size, offset, np.array(pool, dtype=np.uint32), order, pairs)


def composed(cluster: list[int], table: Table) -> list[int]:
    """A base and its ordered marks, with the marks that compose with it taken in; one that another of its class stands before does not."""
    base, rest, last = cluster[0], [], 0
    for mark in cluster[1:]:
        cls = int(table.order[mark])
        both = table.pairs.get((base, mark)) if not rest or last < cls else None
        if both is None:
            rest.append(mark)
            last = cls
        else:
            base = both
    return [base, *rest]


def rebuilt(texts: list[str], table: Table) -> list[str]:
    """The forms of some texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    # every position meets the table; what comes out of it keeps the position's place
    size, offset = table.size[codes].astype(np.int64), table.offset[codes]
    if offset.max(initial=-1) >= 0:
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at, stays, row = np.repeat(offset, size), np.repeat(codes, size), np.repeat(row, size)
        codes = np.where(at < 0, stays, table.pool[np.minimum(at.clip(0) + nth, len(table.pool) - 1)])
    order = table.order[codes]
    if order.any():
        # a cluster is a base and the marks behind it; marks of one class keep their order
        first = (order == 0) | np.r_[True, row[1:] != row[:-1]]
        cluster = np.cumsum(first)
        codes = codes[np.lexsort((order, cluster))]
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], len(codes)]
        kept = np.ones(len(codes), dtype=bool)
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            new = composed(codes[a:b].tolist(), table)
            codes[a : a + len(new)] = new
            kept[a + len(new) : b] = False
        codes, row = codes[kept], row[kept]
    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))
    return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def portions(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def canonical_forms(rows: DataFrame) -> DataFrame:
    """`rows` (text and any others) with `form`: equal forms read the same.

    Width, invisible characters, kind of blank or dash, way of composing and look-alike code
    points make no difference; letters, digits, words and line breaks do.  A null text has a null form, an empty one, or one of
    nothing but invisible characters, the empty form.
    """
    shared = rows.sparkSession.sparkContext.broadcast(mapping())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            forms = iter([f for part in portions([t for t in texts if t is not None]) for f in rebuilt(part, shared.value)])
            made = pa.array([None if t is None else next(forms) for t in texts], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "form"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, form string")


def keyed(rows: DataFrame) -> DataFrame:
    """`rows` with 128-bit hashes in the place of their text and form: `text_key`, `form_key`."""
    hashed = lambda c: F.unhex(F.md5(c))
    return canonical_forms(rows).withColumn("text_key", hashed("text")).withColumn("form_key", hashed("form")).drop("text", "form")


def reading_classes(keys: DataFrame, group: list[str]) -> DataFrame:
    """(group..., form_key, class, texts, rows) of each form that several different texts have: its smallest id, how many they are and in how many rows."""
    # a text of many rows is counted where they are first
    texts = keys.groupBy(*group, "form_key", "text_key").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("rows"))
    return texts.groupBy(*group, "form_key").agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("rows")).where("texts > 1")


def same_reading(keys: DataFrame, classes: DataFrame, group: list[str]) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the rows (group..., id, text_key, form_key) of one class whose texts differ.

    Rows of a form of many meet in parts, so none of its tasks has all its pairs.
    """
    parts = F.ceil(F.col("rows") / FORM_PART)
    several = keys.join(classes.select(*group, "form_key", parts.alias("parts")), [*group, "form_key"])
    a = several.select(*group, "form_key", F.col("id").alias("id_a"), F.col("text_key").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    b = several.select(*group, "form_key", F.col("id").alias("id_b"), F.col("text_key").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return a.join(b, [*group, "form_key", "part"]).where("id_a < id_b and a <> b").select("id_a", "id_b")


def clause_texts(chunks: DataFrame) -> DataFrame:
    """(field, id, text) of the contents and section titles of all chunks."""
    pick = lambda c: chunks.select(F.lit(f"kb_chunk.{c}").alias("field"), F.col("id").cast("bigint").alias("id"), F.col(c).alias("text"))
    return pick("content").unionByName(pick("section_title"))


def clause_forms(chunks: DataFrame) -> DataFrame:
    """(field, id, form): the contents and section titles of all chunks in one consistent form; null stays null."""
    return canonical_forms(spread(clause_texts(chunks), "id")).select("field", "id", "form")


def clause_keys(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents (id, text_key, form_key) by rows, and titles (document_id, id, text_key, form_key) by documents, in which a title goes by the smallest id that carries it.

    Null fields and the contents of title rows ('.' and '') are no cases.
    """
    chunks = spread(chunks, "id")
    contents = chunks.where("content is not null and content not in ('', '.')").select(F.col("id").cast("bigint").alias("id"), F.col("content").alias("text"))
    titles = chunks.where("section_title is not null and document_id is not null").groupBy("document_id", F.col("section_title").alias("text")).agg(F.min("id").cast("bigint").alias("id"))
    return durable(keyed(contents)), durable(keyed(titles))


def clause_classes(chunks: DataFrame) -> DataFrame:
    """(field, document_id, class, texts, rows) of the contents that read the same, and of the titles that do within a document, where their strings differ."""
    contents, titles = clause_keys(chunks)
    c = reading_classes(contents, []).select(F.lit("kb_chunk.content").alias("field"), F.lit(None).cast("bigint").alias("document_id"), "class", "texts", "rows")
    t = reading_classes(titles, ["document_id"]).select(F.lit("kb_chunk.section_title").alias("field"), "document_id", "class", "texts", "rows")
    return c.unionByName(t)


def equal_clauses(chunks: DataFrame) -> DataFrame:
    """(field, id_a, id_b) of kb_chunk rows: contents that read the same, and section titles that do within a document.

    Contents are compared row by row; a title stands for all rows of its document that carry it
    and goes by the smallest chunk id among them.
    """
    contents, titles = clause_keys(chunks)
    c = same_reading(contents, reading_classes(contents, []), []).select(F.lit("kb_chunk.content").alias("field"), "id_a", "id_b")
    t = same_reading(titles, reading_classes(titles, ["document_id"]), ["document_id"]).select(F.lit("kb_chunk.section_title").alias("field"), "id_a", "id_b")
    return c.unionByName(t)
