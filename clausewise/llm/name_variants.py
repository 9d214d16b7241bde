"""Spellings of names that stand for one person, company or firm.

Names are brought to a few parts (what kind of name, place, core, trade) with dictionaries that the
names themselves teach.  Suffixes of the parts' words index the names; suffixes that too many names
have count only together with another part, and are dropped if they still are too common, for every
pair of names that may be one meets under an exact key too.  Names that meet are compared by the longest common subsequence of their cores, the other
parts deciding what may differ; the classes of linked names are the entities.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.llm.canonical import reading
from clausewise.operators.components import connected
from clausewise.operators.durable import durable

#: Shortest suffix of a word of ideographs and of letters; names under one suffix from which on it is too common; the same with another part added.
HAN_SUFFIX, LATIN_SUFFIX, COMMON, COMMON_REFINED = 1, 4, 40, 200
#: Least ratio of the longest common subsequence to the longer core.
LCS_RATIO = 0.66
#: Spellings of one class that meet in one task.
CLASS_PART = 1_000
#: Dictionaries keep what this share of the names has, so they have at most so many entries: 1 / share.
PLACE_SHARE, TRADE_SHARE = 1 / 2000, 1 / 500

NOTE = re.compile(r"[（(](?:盖章|公章|签章|签字|本人|男|女|签名|印)[）)]$|(?:先生|女士|小姐)$")
BRACKET = re.compile(r"[（(]([一-鿿]{2,4})[）)]")
CITY = re.compile(r"^([一-鿿]{2,3})市(?=[一-鿿]{3})")
COMPANY = re.compile(r"(?:集团|控股)?(?:股份)?(?:有[限线]责?任?)?(?:公司|公)$|集团$")
FIRM = re.compile(r"(?:律师|法律)(?:[事亊]?[务物]?所)|律所$|所$")
FULL_COMPANY = re.compile(r"有限(?:责任)?公司$")
#: Legal forms of companies in Latin script, as words without dots (fixed values).
FORMS = frozenset("inc incorporated ltd limited llc llp gmbh sa ag co company corp corporation plc pte private holdings holding the societe anonyme société bv nv".split())
TITLES = frozenset("mr mrs ms miss dr prof sir madam".split())
#: Short forms of given names (fixed values, common English usage).
NICKNAMES = """abigail:abby,gail alexander:alex,al,sandy,xander benjamin:ben,benny,benji christopher:chris,kit,topher edward:ed,eddie,ned,ted,teddy elizabeth:liz,beth,betty,eliza,lizzie,betsy,libby
frederick:fred,freddie,freddy,rick josephine:jo,josie,josey,fina katherine:kate,kathy,katie,kit,kat,kitty leonard:leo,len,lenny margaret:meg,peggy,maggie,marge,margie,greta,rita nathaniel:nat,nate,nathan
philippa:pip,pippa,phil rebecca:becky,becca,reba richard:dick,rich,rick,ricky,richie robert:bob,rob,bobby,robbie,bert susannah:sue,susan,susie,suzy,sanna theodore:ted,theo,teddy,tad victoria:vicky,tori,vic,vickie
william:bill,will,billy,willy,liam james:jim,jimmy,jamie john:jack,johnny thomas:tom,tommy michael:mike,mick,mickey joseph:joe,joey charles:charlie,chuck david:dave,davy daniel:dan,danny matthew:matt anthony:tony andrew:andy,drew
samuel:sam,sammy patricia:pat,patty,trish jennifer:jen,jenny catherine:cathy,kate,cat dorothy:dot,dolly,dottie helen:nell,nellie henry:harry,hank,hal george:georgie francis:frank,fran peter:pete stephen:steve,steven timothy:tim kenneth:ken gregory:greg"""
SHORT = {s: {k for k, v in (x.split(":") for x in NICKNAMES.split()) if s in v.split(",")} for x in NICKNAMES.split() for s in x.split(":")[1].split(",")}


class _Readings(dict):
    def __missing__(self, cp: int) -> str:
        r = self[cp] = reading(chr(cp))
        return r


_READINGS = _Readings()


def has_han(s: str) -> bool:
    return any("㐀" <= c <= "鿿" for c in s)


def stripped(name: str) -> str:
    """A Chinese name without blanks and notes."""
    s = re.sub(r"\s+", "", name.translate(_READINGS))
    while m := NOTE.search(s):
        s = s[: m.start()]
    return s


def place_of(name: str) -> str | None:
    """The place that the form of a name gives away: before 市, or in brackets."""
    if not has_han(name):
        return None
    s = stripped(name)
    m = CITY.match(s) or BRACKET.search(s) or re.search(r"所([一-鿿]{2,4})办公室$", s)
    return m[1] if m else None


def body_of(s: str) -> str:
    """A Chinese name without brackets and legal form."""
    s = BRACKET.sub("", s)
    s = re.sub(r"^(?:律师事务所|法律事务所)[:：]", "", s)
    s = re.sub(r"办公室$", "", s)
    s = FIRM.sub("", s)
    while (m := COMPANY.search(s)) and m.start() >= 2:
        s = s[: m.start()]
    return s


def trade_of(name: str) -> str | None:
    """The last two ideographs before the full legal form of a company, which may be its trade."""
    s = stripped(name)
    if not FULL_COMPANY.search(s):
        return None
    b = CITY.sub("", body_of(s))
    return b[-2:] if len(b) >= 4 else None


def parts(name: str, places: set[str], trades: set[str]) -> tuple[str, str, str, str]:
    """(kind, place, core, trade) of a name; the core of a Latin name is its words in order of the alphabet."""
    if has_han(name):
        s = stripped(name)
        firm = bool(FIRM.search(s)) and not COMPANY.search(s)
        place = place_of(name) or ""
        b = body_of(s)
        if m := CITY.match(b):
            b = b[m.end() :]
        elif place and b.startswith(place) and len(b) > len(place) + 1:
            b = b[len(place) :]
        elif not place:
            for k in (2, 3, 4):
                if b[:k] in places and len(b) >= k + 2:
                    place, b = b[:k], b[k:]
                    break
        if place and firm and b.endswith(place) and len(b) > len(place) + 1:
            b = b[: -len(place)]
        trade = ""
        if len(b) >= 4 and not firm:
            for t, rest in ((b[-2:], b[:-2]), (b[:2], b[2:])):
                if t in trades or t[::-1] in trades:
                    trade, b = (t if t in trades else t[::-1]), rest
                    break
        return ("firm" if firm else "han"), place, b, trade
    s = name.translate(_READINGS)
    surname_first = re.match(r"^\s*([A-Za-z'’\-]+)\s*,\s*([A-Za-z][^,]*)$", s)
    words = [w for w in re.split(r"[\s,()\-/]+", s) if w]
    low = [re.sub(r"[^a-z]", "", unaccented(w.lower())) for w in words]
    form = [w for w in low if w in FORMS]
    if form and not surname_first:
        core = [w + ("." if o.endswith(".") and len(w) <= 4 else "") for w, o in zip(low, words) if w and w not in FORMS]
        return "latin_org", "", " ".join(sorted(core)), ""
    spread: list[str] = []
    for w, o in zip(low, words):
        if w and w not in TITLES and w not in FORMS:
            # initials written together
            spread += list(w) if "." in o and len(w) <= 3 and o.upper() == o else [w]
    return "latin", "", " ".join(sorted(spread)), ""


def unaccented(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one addition of whole numbers for each letter of `b`."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & where.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return lcs(a, b) / max(len(a), len(b), 1)


def slip(a: str, b: str) -> bool:
    """Whether two words differ by one letter more or less, or by one that stands at another place."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) != len(b):
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(short) >= 4 and long[i + 1 :] == short[i:]
    j = next(k for k in range(len(a) - 1, -1, -1) if a[k] != b[k])
    turned = a[i] == b[j] and a[j] == b[i] and a[i + 1 : j] == b[i + 1 : j]
    return turned and (a[i + 1 : j + 1] == b[i:j] or a[i:j] == b[i + 1 : j + 1])


def same_given(a: str, b: str) -> bool:
    if a == b:
        return True
    if 1 in (len(a), len(b)):
        return bool({w[0] for w in SHORT.get(a, set()) | {a}} & {w[0] for w in SHORT.get(b, set()) | {b}})
    return bool((SHORT.get(a, set()) | {a}) & (SHORT.get(b, set()) | {b})) or slip(a, b)


def same_latin(a: str, b: str) -> bool:
    """Two persons' names in Latin script: one long word in common, the other words compatible."""
    x, y = a.split(), b.split()
    for s in x:
        for t in y:
            if len(s) < 4 or len(t) < 4 or not slip(s, t) or ratio(s, t) < LCS_RATIO:
                continue
            left, right = list(x), list(y)
            left.remove(s)
            right.remove(t)
            if not left or not right:
                continue
            used_slip = s != t
            full_l, full_r = [w for w in left if len(w) > 1], [w for w in right if len(w) > 1]
            if full_l and full_r:
                if len(full_l) == len(full_r) == 1 and same_given(full_l[0], full_r[0]) and not (used_slip and full_l[0] != full_r[0] and slip(full_l[0], full_r[0])):
                    return True
            elif full_l or full_r:
                initials, full = (right, full_l) if full_l else (left, full_r)
                if any(same_given(full[0], w) for w in initials):
                    return True
            elif {w[0] for w in left} & {w[0] for w in right}:
                return True
    return False


def same_org(a: str, b: str) -> bool:
    """Two companies' names in Latin script without legal forms: the same words, one slip or abbreviation allowed."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return False
    off = 0
    rest = list(y)
    for w in x:
        if w in rest:
            rest.remove(w)
            continue
        near = [v for v in rest if slip(w, v) or abbreviates(w, v) or abbreviates(v, w)]
        if not near:
            return False
        rest.remove(near[0])
        off += 1
    return off <= 1 and ratio(a, b) >= 0.5


def abbreviates(short: str, full: str) -> bool:
    return short.endswith(".") and len(short) >= 3 and full.startswith(short[:-1]) and len(full) > len(short)


class Hashed:
    """Hashes of a word, of its beginnings and ends, and of what one letter less or another makes of it, each made of those of its parts."""

    BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def __init__(self, word: str) -> None:
        self.codes = [c * c + c + 1 for c in map(ord, word)]
        n = len(word)
        self.begins, self.ends, self.power = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
        for i, c in enumerate(self.codes):
            self.begins[i + 1] = (self.begins[i] * self.BASE + c) & self.MASK
            self.power[i + 1] = self.power[i] * self.BASE & self.MASK
        for k in range(1, n + 1):
            # of the last k letters
            self.ends[k] = (self.codes[n - k] * self.power[k - 1] + self.ends[k - 1]) & self.MASK

    def whole(self) -> int:
        return self.begins[-1]

    def without(self, i: int) -> int:
        k = len(self.codes) - i - 1
        return (self.begins[i] * self.power[k] + self.ends[k]) & self.MASK

    def replaced(self, i: int, letter: str) -> int:
        k, c = len(self.codes) - i - 1, ord(letter)
        return ((self.begins[i] * self.BASE + c * c + c + 1) * self.power[k] + self.ends[k]) & self.MASK

    def deleted(self) -> set[int]:
        """Of the word and of what one letter less makes of it; words that differ by a slip have one of these in common."""
        return {self.whole()} | {self.without(i) for i in range(len(self.codes))}


def suffix_keys(kind: str, core: str, trade: str, place: str) -> list[tuple[str, str]]:
    """(suffix by its length and hash, what refines it) of a name's words, read from either end."""
    out: list[tuple[str, str]] = []
    if kind in ("han", "firm"):
        for word, others in ((core, (place or trade, "")), (core + trade, (core[:1],))) if trade else ((core, (place, "")),):
            for w, mark in ((word, ""), (word[::-1], "<")):
                ends = Hashed(w).ends
                for k in range(HAN_SUFFIX, len(w) + 1):
                    # the other end of the word refines a suffix too, and alone the shortest one
                    out += [(f"{mark}{k}:{ends[k]}", o) for o in {(o or f"^{w[0]}") if k > 1 else f"^{w[0]}" for o in others}]
        return list(dict.fromkeys(out))
    words = core.split()
    for i, w in enumerate(words):
        others = "".join(sorted(v[0] for j, v in enumerate(words) if j != i))
        w = w.rstrip(".")
        for v, mark in ((w, ""), (w[::-1], "<")):
            ends = Hashed(v).ends
            out += [(f"{mark}{k}:{ends[k]}", others[:2]) for k in range(LATIN_SUFFIX, len(v) + 1)]
    return list(dict.fromkeys(out))


def exact_keys(kind: str, place: str, core: str, trade: str, right: dict[str, set[str]]) -> list[str]:
    """Keys of which any two names that `compare` may link have one in common; `right`: what stands for a mistyped ideograph."""
    out: set[str] = set()
    if kind in ("han", "firm"):
        head = kind + "|"
        of = lambda w: Hashed(w).whole()
        for lead in {"", place}:
            h = Hashed(lead + core)
            out.add(f"{head}={h.whole()}")
            if len(core) > 1:
                out.add(f"{head}~{lead}{of(''.join(sorted(core)))}")
                out |= {f"{head}={h.replaced(len(lead) + i, r)}" for i, c in enumerate(core) for r in right.get(c, ())}
        if not place:
            # a place, or something else, that the other name may not have before its core
            out |= {f"{head}~{core[:j]}{of(''.join(sorted(core[j:])))}" for j in (2, 3, 4) if j + 1 < len(core)}
            out |= {f"{head}={of(core[j:])}" for j in (2, 3, 4) if len(core) - j >= 3}
        if place and trade and len(core) > 1:
            h = Hashed(core)
            out |= {f"{head}_{i}_{h.without(i)}|{place}|{trade}" for i in range(len(core))}
        return sorted(out)
    words = core.split()
    hashes = [Hashed(w) for w in words]
    total = sum(h.whole() for h in hashes)
    for i, (w, h) in enumerate(zip(words, hashes)):
        rest = f"o|{len(words)}|{(total - h.whole()) & Hashed.MASK}|"
        out |= {f"{rest}{x}" for x in h.deleted()}
        # a short form, and what it may be short for
        out |= {f"{rest}^{h.begins[len(w.rstrip('.'))]}"} | {f"{rest}^{h.begins[k]}" for k in range(2, len(w))}
        if len(w) >= 4 and kind == "latin":
            initials = {c for j, v in enumerate(words) if j != i for x in SHORT.get(v, set()) | {v} for c in x[:2]}
            out |= {f"p|{x}|{c}" for x in h.deleted() for c in initials}
    return sorted(out)


def exact_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: node numbers that meet under an exact key and whose places and trades may be one.

    Names with another place or trade never meet; those without one, of which a core has as many as
    there are places and trades, are held against all.
    """
    keys = F.pandas_udf(lambda k, p, c, t, r: pd.Series([exact_keys(*x[:4], rights(x[4])) for x in zip(k, p, c, t, r)]), T.ArrayType(T.StringType()))
    keyed = nodes.select("name_group", "place", "trade", "node", F.col("kind").startswith("latin").alias("latin"), F.explode(keys("kind", "place", "core", "trade", "rights")).alias("k"))
    keyed = keyed.select("name_group", "place", "trade", "node", "latin", F.xxhash64("k").alias("key"))
    met = keyed.join(keyed.groupBy("name_group", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), ["name_group", "key"])
    a, b = (met.select("name_group", "key", F.col("place").alias(f"place_{x}"), F.col("trade").alias(f"trade_{x}"), F.col("node").alias(x), "latin") for x in "ab")
    alike = a.join(b.withColumnRenamed("place_b", "place_a").withColumnRenamed("trade_b", "trade_a").drop("latin"), ["name_group", "key", "place_a", "trade_a"])
    fits = "(place_a = '' or place_b = '' or place_a = place_b) and (trade_a = '' or trade_b = '' or trade_a = trade_b) and (place_a <> place_b or trade_a <> trade_b)"
    some = a.where("not latin and (place_a = '' or trade_a = '')").drop("latin").join(b.drop("latin"), ["name_group", "key"]).where(fits)
    both = alike.select("a", "b").unionByName(some.select("a", "b")).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def rights(pairs) -> dict[str, set[str]]:
    """What may be meant for each mistyped ideograph of one core, from its (wrong, right) pairs."""
    out: dict[str, set[str]] = {}
    for p in pairs if pairs is not None else ():
        out.setdefault(p["wrong"], set()).add(p["right"])
    return out


PARTS = T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "place", "core", "trade")])
KEYS = T.ArrayType(T.StructType([T.StructField("suffix", T.StringType()), T.StructField("other", T.StringType())]))


def named_parts(names: DataFrame) -> DataFrame:
    """(name_group, name, kind, place, core, trade) of distinct (name_group, name).

    The dictionaries of places and trades are bounded by the shares from which on a word gets in.
    """
    hints = F.pandas_udf(lambda s: s.map(place_of), T.StringType())
    trade = F.pandas_udf(lambda s: s.map(trade_of), T.StringType())

    def frequent(column, share: float, least: int) -> dict[str, int]:
        found = names.select(column.alias("w")).where("w is not null")
        counts = found.groupBy("w").count()
        total = found.count()
        return {r["w"]: r["count"] for r in counts.where(F.col("count") >= max(least, total * share)).collect()}

    places = set(frequent(hints("name"), PLACE_SHARE, 1))
    counted = frequent(trade("name"), TRADE_SHARE, 1)
    trades = {t for t, n in counted.items() if counted.get(t[::-1], 0) < n * 2}
    split = F.pandas_udf(lambda s: pd.DataFrame([parts(n, places, trades) for n in s], columns=["kind", "place", "core", "trade"]), PARTS)
    return names.withColumn("p", split("name")).select("name_group", "name", "p.*")


def misspelled_characters(nodes: DataFrame) -> DataFrame:
    """(wrong, right): an ideograph that is rare in cores and mostly stands where another core has a usual one.

    Cores meet under their text with one character left out. A key and a character make a core, so no more cores meet
    under a key than there are ideographs, however many names there are.
    """
    cores = nodes.where("kind in ('han', 'firm') and length(core) > 1").select("core").distinct()
    without = F.pandas_udf(lambda s: s.map(spots_of), SPOTS)
    spots = cores.select("core", F.explode(without("core")).alias("s")).select("core", "s.ch", "s.key")
    totals = spots.groupBy("ch").agg(F.count_distinct("core").alias("n"))
    rare = totals.select(F.col("ch").alias("wrong"), F.col("n").alias("nw"))
    usual = totals.select(F.col("ch").alias("right"), F.col("n").alias("nr"))
    a = spots.select("key", F.col("ch").alias("wrong")).join(rare, "wrong")
    b = spots.select("key", F.col("ch").alias("right")).join(usual, "right")
    met = a.join(b, "key").where("wrong <> right and nw * 4 <= nr").groupBy("wrong", "right", "nw").agg(F.count_distinct("key").alias("met"))
    return met.where("met >= nw * 0.5").select("wrong", "right")


def spots_of(core: str) -> list[dict[str, str]]:
    """Each character of a core with the place and the rest of it as its key."""
    h = Hashed(core)
    return [{"ch": c, "key": f"{i}|{h.without(i)}"} for i, c in enumerate(core)]


SPOTS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("ch", "key")]))


def with_rights(nodes: DataFrame) -> DataFrame:
    """`nodes` with `rights`: for the characters of its own core, what the corpus shows to be meant by them."""
    wrong = durable(misspelled_characters(nodes))
    chars = nodes.where("kind in ('han', 'firm')").select("node", F.explode(F.array_distinct(F.split("core", ""))).alias("wrong"))
    own = chars.join(wrong, "wrong").groupBy("node").agg(F.collect_list(F.struct("wrong", "right")).alias("rights"))
    return durable(nodes.join(own, "node", "left"))


def weighed(a: str, b: str, same: set[tuple[str, str]]) -> float:
    """The ratio of the longest common subsequence to the longer core, where pairs of characters that `same` has count as one."""
    if same and len(a) == len(b):
        b = "".join(x if (x, y) in same else y for x, y in zip(a, b))
    return ratio(a, b)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """Whether two names are one by the ratio of the longest common subsequence of their cores, weighed by what the corpus and the other parts say of the characters that differ."""
    out = []
    columns = ("kind", "place", "core", "trade", "spelled", "trades", "rights")
    for ka, pa_, ca, ta, ra, oa, wa, kb, pb, cb, tb, rb, ob, wb in zip(*(a[c] for c in columns), *(b[c] for c in columns)):
        if ka.startswith("latin"):
            org = "latin_org" in (ka, kb)
            out.append(same_org(ca, cb) if org else same_latin(ca, cb))
            continue
        # a place that only the other name tells apart from the core
        if pa_ and not pb and cb.startswith(pa_) and len(cb) > len(pa_) + 1:
            pb, cb = pa_, cb[len(pa_) :]
        elif pb and not pa_ and ca.startswith(pb) and len(ca) > len(pb) + 1:
            pa_, ca = pb, ca[len(pb) :]
        elif not (pa_ and pb) and len(ca) != len(cb) and min(len(ca), len(cb)) >= 3 and 2 <= abs(len(ca) - len(cb)) <= 4 and (ca.endswith(cb) if len(ca) > len(cb) and not pa_ else cb.endswith(ca) and not pb):
            ca = cb = min(ca, cb, key=len)
        if (ka == "firm") != (kb == "firm") or pa_ and pb and pa_ != pb:
            out.append(False)
            continue
        if ta != tb and (ta and tb or max(oa, ob) > 1):
            # another trade, or a name without one whose core has several
            out.append(False)
            continue
        if ca == cb or len(ca) != len(cb) or len(ca) < 2:
            out.append(ca == cb)
            continue
        off = [(x, y) for x, y in zip(ca, cb) if x != y]
        # the evidence: two that changed places; one that the corpus shows to be mistyped; one in a core that only one or two
        # strings have, beside a company of its place and trade that more have
        turned = len(off) == 2 and sorted(ca) == sorted(cb)
        typed = len(off) == 1 and (off[0][1] in rights(wa).get(off[0][0], ()) or off[0][0] in rights(wb).get(off[0][1], ()))
        lonely = len(off) == 1 and bool(ta) and ta == tb and bool(pa_) and pa_ == pb and min(ra, rb) <= 2 and max(ra, rb) >= 3
        least = LCS_RATIO - 0.17 * (len(ca) == 2)
        out.append(ratio(ca, cb) >= least and weighed(ca, cb, set(off) if turned or typed or lonely else set()) == 1.0)
    return pd.Series(out, dtype=bool)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): node numbers of (name_group, node, kind, place, core, trade, spelled, trades) that name one entity."""
    nodes = with_rights(nodes)
    keys = F.pandas_udf(lambda k, c, t, p: pd.Series([suffix_keys(*x) for x in zip(k, c, t, p)]), KEYS)
    indexed = nodes.withColumn("family", F.when(F.col("kind").startswith("latin"), "latin").otherwise("han")).select("name_group", "family", "node", F.explode(keys("kind", "core", "trade", "place")).alias("k")).select("name_group", "family", "node", "k.*")
    index = ["name_group", "family", "suffix"]
    sizes = indexed.groupBy(*index).agg(F.count(F.lit(1)).alias("n"))
    sized = indexed.join(sizes, index)
    plain = sized.where(F.col("n") <= COMMON).where("n > 1").select(*index, F.lit("").alias("other"), "node")
    refined = sized.where((F.col("n") > COMMON) & (F.col("other") != "")).select(*index, "other", "node")
    fine = refined.groupBy(*index, "other").agg(F.count(F.lit(1)).alias("m")).where(F.col("m").between(2, COMMON_REFINED)).select(*index, "other")
    blocks = plain.unionByName(refined.join(fine, [*index, "other"], "left_semi"))
    a, b = blocks.withColumnRenamed("node", "a"), blocks.withColumnRenamed("node", "b")
    pairs = a.join(b, [*index, "other"]).where("a < b").select("a", "b").unionByName(exact_pairs(nodes)).distinct()
    told = nodes.select("node", F.struct("kind", "place", "core", "trade", "spelled", "trades", "rights").alias("s"))
    both = pairs.join(told.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(told.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    same = F.pandas_udf(compare, T.BooleanType())
    return both.where(same("sa", "sb")).select("a", "b")


def name_classes(names: DataFrame) -> DataFrame:
    """(name_group, name, class, spellings) of each different (name_group, name): the entity it names, by its smallest spelling, and how many spellings that has.

    Null, empty and blank names name nothing and are left out, as are names of nothing but a legal form or title. Repeated names count once.
    """
    distinct = names.where("name is not null and trim(name) <> ''").select("name_group", "name").distinct()
    told = durable(named_parts(durable(distinct)).where("core <> ''"))
    what = ["name_group", "kind", "place", "core", "trade"]
    by_core = told.groupBy("name_group", "core").agg(F.count(F.lit(1)).alias("spelled"), F.count_distinct(F.when(F.col("trade") != "", F.col("trade"))).alias("trades"))
    nodes = durable(told.select(*what).distinct().join(by_core, ["name_group", "core"]).withColumn("node", F.xxhash64(*what)))
    classes = connected(links(nodes))
    entity = nodes.join(classes, "node", "left").select(*what, F.coalesce("class", "node").alias("entity"))
    member = durable(told.join(entity, what).select("name_group", "name", "entity"))
    whole = member.groupBy("name_group", "entity").agg(F.min("name").alias("class"), F.count(F.lit(1)).alias("spellings"))
    return member.join(whole, ["name_group", "entity"]).select("name_group", "name", "class", "spellings")


def same_names(names: DataFrame) -> DataFrame:
    """(name_group, name_a, name_b), name_a < name_b, of different spellings of one entity among (name_group, name).

    A name alone gives no row. Spellings of a class of many meet in parts, so none of its tasks has all its pairs.
    """
    member = durable(name_classes(names).where("spellings > 1"))
    parts = F.ceil(F.col("spellings") / CLASS_PART)
    a = member.select("name_group", "class", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), parts).alias("part"))
    b = member.select("name_group", "class", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    return a.join(b, ["name_group", "class", "part"]).where("name_a < name_b").select("name_group", "name_a", "name_b")


def firm_and_party_names(opinions: DataFrame, complaints: DataFrame) -> DataFrame:
    """(name_group, name) of the names of problem 3."""
    firm = opinions.select(F.lit("law_firm").alias("name_group"), F.col("issuing_law_firm").alias("name"))
    return firm.unionByName(opinions.select(F.lit("party").alias("name_group"), F.col("client_name").alias("name"))).unionByName(complaints.select(F.lit("party").alias("name_group"), F.col("plaintiff_names").alias("name")))
