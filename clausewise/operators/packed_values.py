"""Several values packed in one field: one row per value, with its position.

The delimiter is inferred per source (the field a value comes from).  Every value is cut at
every candidate delimiter; values without any candidate teach which piece types the source
has, and where they explain too few of the pieces, the candidates' own pieces do; each candidate is then scored over the
source's rows by piece type regularity and by
piece-count consistency, and the pieces of a row are put together again at the
candidates where a cut would leave a piece of no known type.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.operators.durable import durable

OPEN, CLOSE = "（(〔[【", "）)〕]】"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』"}
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳㉑㉒㉓㉔㉕㉖㉗㉘㉙㉚㉛㉜㉝㉞㉟㊱㊲㊳㊴㊵㊶㊷㊸㊹㊺㊻㊼㊽㊾㊿"
#: Candidate delimiters: kind -> pattern.  Order matters where one begins like another.
CANDIDATES = [
    ("line", r"[\r\n]+"),
    ("tab", r"\t"),
    ("bar", r"[|｜]"),
    ("slash", r"\s/\s|/\s*$"),
    ("semicolon", r"[;；]"),
    ("enumeration", r"、"),
    ("comma", r"[,，]"),
    ("circled", rf"[{CIRCLED}]"),
    ("numbered", r"[（(]\d{1,3}[）)]|(?<![^\s;；,，、|])\d{1,3}(?:[、．]|\.(?!\d)|[）)])"),
    ("conjunction", r"以及|及|和"),
]
DELIMITER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in CANDIDATES))
LIST = re.compile(r"""^\s*\[\s*(["'].*["'])\s*\]\s*$""", re.S)
REMARK = re.compile(r"[（(][^（()）]*[）)]$")
LATIN = re.compile(r"^[\x20-\x7eÀ-ɏ]+$")
HANZI = re.compile(r"^[一-鿿·]+$")
#: A piece type counts as known from this share of a source's single values on, so a source has at most 1 / TYPE_SHARE types.
TYPE_SHARE = 0.002
#: Candidates whose source-wide score is lower are not cut at, unless the pieces on both sides are quoted.
DELIMITER_SCORE = 0.05

#: Where single values explain a smaller share of the pieces, types are learned from the candidates' own pieces: those that make up so
#: much of a candidate's pieces each, if together they make up nearly all.
EXPLAINED, OWN_SHARE, OWN_REGULAR = 0.5, 0.1, 0.8

ATOMS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("gap", T.StringType()), T.StructField("piece", T.StringType())]))


def atoms(text: str | None) -> list[tuple[str, str, str]]:
    """(kind of the delimiter before, that delimiter verbatim, piece) for the finest cut outside quotes and brackets."""
    if text is None or not text.strip():
        return []
    if m := LIST.match(text):
        text = m[1]
    out: list[tuple[str, str, str]] = []
    kind, gap, start, i, n = "", "", 0, 0, len(text)
    closed, opened = {}, []
    for j, ch in enumerate(text):
        if ch in OPEN:
            opened.append(j)
        elif ch in CLOSE and opened:
            closed[opened.pop()] = j

    def close(end: int) -> None:
        nonlocal kind, gap
        piece = text[start:end]
        if piece.strip():
            out.append((kind or "start", gap, piece))
            kind, gap = "", ""
        else:
            gap += piece

    while i < n:
        ch = text[i]
        if ch in QUOTES and not text[start:i].strip() and (j := text.find(QUOTES[ch], i + 1)) > 0:
            close(i)
            out.append(("quote" if not kind and out else kind or "start", gap, text[i : j + 1]))
            kind, gap, start, i = "", "", j + 1, j + 1
            continue
        m = DELIMITER.match(text, i)
        if m:
            if m.lastgroup == "conjunction" and not (text[start:i].strip() or out):
                m = None
        if m:
            close(i)
            kind = m.lastgroup if kind in ("", "numbered") or m.lastgroup != "numbered" else kind
            gap += m[0]
            start = i = m.end()
            continue
        i = closed.get(i, i) + 1
    close(n)
    return out


def bare(piece: str) -> str:
    """The piece without surrounding blanks and quotes."""
    piece = piece.strip()
    while len(piece) > 1 and QUOTES.get(piece[0]) == piece[-1]:
        piece = piece[1:-1].strip()
    return piece


def piece_type(piece: str) -> str:
    """What kind of thing a piece looks like: its length if it is a short name, else how it begins and ends."""
    s = bare(piece)
    if (m := REMARK.search(s)) and m.start() > 0:
        s = s[: m.start()].strip()
    if not s:
        return "empty"
    if HANZI.match(s) and len(s) <= 4:
        return f"name{len(s)}"
    if LATIN.match(s):
        return f"latin{min(2, len(s.split()))}"
    head = "bracket" if s[0] in OPEN else "hanzi" if HANZI.match(s[0]) else "latin" if s[0].isalpha() else "other"
    tail = re.sub(r"之[一二三四五六七八九十]+$", "", s)[-1:]
    return f"{head}-{tail}"


_TALLY = "一二三四五六七八九十"
#: A value of so many characters or more, remark and blanks off, has its type by its ends alone.
BY_ENDS = 9


def head_of(s: str) -> str:
    """What kind of character a value begins with."""
    return "bracket" if s[0] in OPEN else "hanzi" if HANZI.match(s[0]) else "latin" if s[0].isalpha() else "other"


def groups(parts: list[tuple[str, str, str]], types: dict[str, float], kinds: dict[str, float]) -> list[str]:
    """The pieces joined again where a cut leaves something of no known type: the best segmentation, more values first among equals.

    Values of some length have their type by their ends, so of all their beginnings only the best of each kind of first character counts, and
    the work grows with the pieces.
    """
    n = len(parts)
    if n < 2:
        return [x for x in (bare(p) for _, _, p in parts) if x]
    flat = "".join((g if i else "") + p for i, (_, g, p) in enumerate(parts))
    starts, ends, at = [], [], 0
    for i, (_, g, p) in enumerate(parts):
        at += len(g) if i else 0
        starts.append(at)
        at += len(p)
        ends.append(at)
    # characters up to each place that are not Latin, and that are blank
    foreign, blank = [0], [0]
    for ch in flat:
        foreign.append(foreign[-1] + (not LATIN.match(ch)))
        blank.append(blank[-1] + ch.isspace())
    before = [foreign[x] for x in starts]
    lead = [x + len(p) - len(p.lstrip()) for x, (_, _, p) in zip(starts, parts)]
    cost = [0.0] + [0.5 * k if (k := kinds.get(kind, 0.0)) >= DELIMITER_SCORE else -3.0 for kind, _, _ in parts[1:]]
    gain = max(cost)
    heads = [head_of(bare(p)) if bare(p) else "other" for _, _, p in parts]
    best: list[tuple[float, int]] = [(0.0, 0)]
    # of the beginnings up to each: the best of all, and of each kind of first character
    top: list[float] = []
    by_head: list[dict[str, tuple[float, int]]] = []
    for end in range(1, n + 1):
        b = end - 1
        worth = best[b][0] + cost[b]
        top.append(max(best[b][0], top[-1] if top else -math.inf))
        now = dict(by_head[-1]) if by_head else {}
        for h in (heads[b], ""):
            if h not in now or worth >= now[h][0] - 1e-9:
                now[h] = (worth, b)
        by_head.append(now)

        stop = ends[b]
        value = flat[starts[b] : stop].rstrip()
        stop = starts[b] + len(value)
        if (m := REMARK.search(value)) and m.start() > 0:
            stop = starts[b] + len(value[: m.start()].rstrip())
        found, begin = (-math.inf, 0), b
        # beginnings from here on make a Latin value
        run = bisect_left(before, foreign[stop])
        while begin >= 0:
            if begin < b:
                if top[begin] + gain <= found[0]:
                    begin = -1
                    break
                latin = f"latin{1 + (blank[stop] > blank[lead[begin]])}" if begin >= run else ""
                if stop - starts[begin] >= BY_ENDS and not latin or latin and latin not in types and (latin == "latin2" or "latin2" not in types):
                    break
                score = best[begin][0] + (0.0 if (latin or piece_type(flat[starts[begin] : ends[b]])) in types else -3.0) + cost[begin]
            else:
                piece = parts[b][2]
                quoted = bare(piece) != piece.strip()
                score = best[b][0] + (0.0 if quoted or piece_type(piece) in types else -3.0) + (0.5 if quoted and b else 0.0 if quoted else cost[b])
            if score > found[0] + 1e-9:
                found = (score, begin)
            begin -= 1
        if begin >= 0:
            tail = flat[max(0, stop - 40) : stop]
            short = tail.rstrip(_TALLY)
            tail = short[:-1] if short.endswith("之") and short != tail else tail
            # Latin values that come here have no known type
            far = by_head[min(begin, run - 1)] if run else {}
            some = [by_head[begin][""]] + [far[h] for h in far if h and f"{h}-{tail[-1:]}" in types]
            for (score, start), known in zip(some, [False, *[True] * len(some)]):
                score -= 0.0 if known else 3.0
                if score > found[0] + 1e-9 or score > found[0] - 1e-9 and found[1] < start:
                    found = (score, start)
        best.append(found)
    out, end = [], n
    while end:
        begin = best[end][1]
        out.append(bare(flat[starts[begin] : ends[end - 1]]))
        end = begin
    return [x for x in reversed(out) if x]


@F.pandas_udf(ATOMS)
def _atoms(values: pd.Series) -> pd.Series:
    return values.map(atoms)


@F.pandas_udf(T.StringType())
def _type(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else piece_type(v))


def long_form(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(field, id, text) of the named fields: tuples of field name, table, id column, text column."""
    out = None
    for field, df, key, column in tables:
        one = df.select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("id"), F.col(column).cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def piece_types(cut: DataFrame) -> DataFrame:
    """(field, type, share) of the types that different single values have, from TYPE_SHARE on.

    Counting different values keeps the few placeholders that many rows repeat from making a type.
    """
    single = cut.where(F.size("atoms") == 1).select("field", F.col("atoms")[0]["piece"].alias("piece")).distinct()
    counts = single.groupBy("field", _type("piece").alias("type")).count()
    totals = counts.groupBy("field").agg(F.sum("count").alias("total"))
    return counts.join(totals, "field").select("field", "type", (F.col("count") / F.col("total")).alias("share")).where(F.col("share") >= TYPE_SHARE)


def delimiter_scores(cut: DataFrame, types: dict[str, dict[str, float]]) -> DataFrame:
    """(field, kind, regularity, consistency, score) of each candidate over all rows of a source that have it.

    regularity: share of the pieces beside a cut at this candidate that have a known type;
    consistency: share of the rows in which all cuts at the candidate agree, so that the piece count equals the count of known pieces.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("cuts", T.IntegerType()), T.StructField("good", T.IntegerType())])))
    def tally(field: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for f, row in zip(field, parts):
            known, seen = types.get(f, {}), {}
            kinds_here = [(p["kind"], piece_type(p["piece"]) in known) for p in row]
            for (_, left), (kind, right) in zip(kinds_here, kinds_here[1:]):
                c = seen.setdefault(kind, [0, 0])
                c[0] += 1
                c[1] += left and right
            out.append([(k, c, g) for k, (c, g) in seen.items()])
        return pd.Series(out)

    rows = cut.where(F.size("atoms") > 1).select("field", F.explode(tally("field", "atoms")).alias("t")).select("field", "t.*")
    return rows.groupBy("field", "kind").agg(
        (F.sum("good") / F.sum("cuts")).alias("regularity"),
        F.avg((F.col("good") == F.col("cuts")).cast("double")).alias("consistency"),
    ).withColumn("score", (F.col("regularity") + F.col("consistency")) / 2)


def own_types(cut: DataFrame, types: dict[str, dict[str, float]]) -> DataFrame:
    """(field, type, share) of the types that the candidates' own pieces have, in sources whose single values explain too few of the pieces.

    A candidate's own pieces are those between its cuts alone. Its types count if the regular ones make up nearly all of its pieces.
    """
    own = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("type", T.StringType())]))

    def pieces(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            told = []
            for kind in {p["kind"] for p in row[1:]}:
                text = [row[0]["piece"]]
                for p in row[1:]:
                    if p["kind"] == kind:
                        told.append((kind, piece_type("".join(text))))
                        text = [p["piece"]]
                    else:
                        text += [p["gap"], p["piece"]]
                told.append((kind, piece_type("".join(text))))
            out.append(told)
        return pd.Series(out)

    known = F.pandas_udf(lambda f, rows: pd.Series([sum(piece_type(p["piece"]) in types.get(x, ()) for p in row) for x, row in zip(f, rows)], dtype="int64"), T.LongType())
    several = cut.where(F.size("atoms") > 1)
    told = several.groupBy("field").agg(F.sum(known("field", "atoms")).alias("known"), F.sum(F.size("atoms")).alias("pieces"))
    unknown = told.where(F.col("known") < F.col("pieces") * EXPLAINED).select("field")
    # one row for each field
    found = several.join(F.broadcast(unknown), "field", "left_semi").select("field", F.explode(F.pandas_udf(pieces, own)("atoms")).alias("p")).groupBy("field", "p.kind", "p.type").count()
    share = found.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("field", "kind")))
    regular = share.where(F.col("share") >= OWN_SHARE).withColumn("all", F.sum("share").over(Window.partitionBy("field", "kind")))
    return regular.where(F.col("all") >= OWN_REGULAR).groupBy("field", "type").agg(F.max("share").alias("share"))


def split_fields(texts: DataFrame) -> DataFrame:
    """(field, id, values array) of each non-blank (field, id, text).

    What reaches the driver is bounded: at most 1 / TYPE_SHARE types, 1 / OWN_SHARE of each candidate, and one score per candidate for each field.
    """
    cut = durable(texts.where(F.col("text").isNotNull()).select("field", "id", _atoms("text").alias("atoms")))
    types: dict[str, dict[str, float]] = {}
    for r in piece_types(cut).collect():
        types.setdefault(r["field"], {})[r["type"]] = r["share"]
    for r in own_types(cut, types).collect():
        types.setdefault(r["field"], {}).setdefault(r["type"], r["share"])
    kinds: dict[str, dict[str, float]] = {}
    for r in delimiter_scores(cut, types).collect():
        kinds.setdefault(r["field"], {})[r["kind"]] = r["score"]

    def split(field: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([groups([(p["kind"], p["gap"], p["piece"]) for p in row], types.get(f, {}), kinds.get(f, {})) if len(row) else [] for f, row in zip(field, parts)])

    # not to be evaluated a second time in a filter on its own result
    once = F.pandas_udf(split, T.ArrayType(T.StringType())).asNondeterministic()
    return cut.select("field", "id", once("field", "atoms").alias("values"))


def unpack(texts: DataFrame, at_least: int = 1) -> DataFrame:
    """(field, id, pos, value) for each value of each (field, id, text), `pos` from 1, of the fields with `at_least` so many values.

    Null, empty and blank texts give no row; a text with one value gives that one with `pos` 1;
    empty pieces do not count; remarks in brackets belong to their value.  Repeated rows are
    treated one by one.  Other columns of `texts` are ignored.
    """
    return (
        split_fields(texts)
        .where(F.size("values") >= at_least)
        .select("field", "id", F.posexplode("values").alias("p", "value"))
        .select("field", "id", (F.col("p") + 1).cast("int").alias("pos"), "value")
    )
