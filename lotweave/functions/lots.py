"""Column functions over lot numbers, parcel keys and ledger text. All built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns of ledger text.
DOT = "ㆍ"
MOUNTAIN = "산"
APT_MARK = "Ⓐ"
LOT = r"^산?\d[\d~\-ㆍ]*$"
LOT_OR_MOUNTAIN_RANGE = r"^산?\d[\d~\-ㆍ산]*$"
DISTRICT = r"^([가-힣]{1,4}[동리])\s*(.*)$"
GRADES = ("지번오류의심", "블록분리", "과대확장의심")
#: The most lots of a range, and where an open range of sub numbers ends.
MOST, OPEN_END = 2000, 199

_NONE = "array<string>"


def normalize_text(s: Column) -> Column:
    """One kind of tilde, middle dot, comma and blank; no blanks around tildes and dots; no zero-width blanks."""
    s = F.translate(s, "\uff5e\u301c\u223c\u00b7\uff0c\u3000\u200b", "~~~\u318d, ")
    return F.regexp_replace(F.regexp_replace(s, r"\s*~\s*", "~"), r"\s*ㆍ\s*", DOT)


def mark_parentheses(s: Column) -> Column:
    """Drops '(sub lots included)' and turns any other parenthesis into a mark, so that commas inside don't split."""
    return F.regexp_replace(F.regexp_replace(s, r"\(\s*부번지?\s*포함\s*\)", " "), r"\([^)]*\)", f" {APT_MARK} ")


def clean_word(w: Column) -> Column:
    """Up to an open parenthesis, without commas and stops around and without a final 번지."""
    return F.regexp_replace(F.btrim(F.split_part(w, F.lit("("), F.lit(1)), F.lit(",.")), "번지$", "")


def _number(s: Column) -> Column:
    return s.try_cast("bigint")


def _range(prefix: Column, low: Column, high: Column) -> Column:
    """prefix & low .. prefix & high; empty if low > high; cut a little over the cap, which is then refused."""
    top = F.least(high, low + MOST + 1)
    return F.when(low <= top, F.transform(F.sequence(low, top), lambda n: F.concat(prefix, n.cast("string")))).otherwise(F.array().cast(_NONE))


def only_if(a: Column, good) -> Column:
    """a if it is good, else null; a is evaluated once, also inside other functions' lambdas."""
    return F.get(F.filter(F.array(a), good), F.lit(0))


def expand_part(p: Column, mode: str = "current") -> Column:
    """Lots of a spec without middle dots; null if it can't be read, empty for a range that runs backwards.

    mode, for comparisons with earlier readings: older leaves backward ranges of main numbers empty and takes a range across main
    numbers as its two ends and what lies between; oldest can't read a range with two sub numbers and refuses no
    long one (it lists as many as just exceed the cap).
    """
    shape = r"^(\d+)(?:-(\d+))?~(\d+)(?:-(\d+))?$"
    a, sub_a, b, sub_b = (F.regexp_extract(p, shape, k) for k in (1, 2, 3, 4))
    na, nb, nsa, nsb = map(_number, (a, b, sub_a, sub_b))
    bare = F.lit("")
    one = lambda x: F.array(x)
    same = _range(F.concat(a, F.lit("-")), nsa, nsb)
    first = F.when(nsa <= 1, one(a)).otherwise(_range(F.concat(a, F.lit("-")), nsa, F.lit(OPEN_END).cast("bigint")))
    across = F.concat(first, _range(bare, na + 1, nb - 1), _range(F.concat(b, F.lit("-")), F.lit(1).cast("bigint"), nsb))
    backwards = one(F.concat(a, F.lit("-"), b)) if mode == "current" else F.array().cast(_NONE)
    both = F.when(a == b, same).otherwise(across)
    if mode == "older":
        ends = F.array(F.concat(a, F.lit("-"), sub_a), F.concat(b, F.lit("-"), sub_b))
        both = F.when(a == b, same).otherwise(F.concat(ends, _range(bare, na + 1, nb - 1)))
    elif mode == "oldest":
        both = F.lit(None).cast(_NONE)
    out = (
        F.when((sub_a != "") & (sub_b == ""), _range(F.concat(a, F.lit("-")), nsa, nb))
        .when((sub_a == "") & (sub_b == ""), F.when(na > nb, backwards).otherwise(_range(bare, na, nb)))
        .when(sub_a == "", F.concat(_range(bare, na, nb), one(F.concat(b, F.lit("-"), sub_b))))
        .otherwise(both)
    )
    if mode == "oldest":
        return F.when(~p.contains("~"), one(p)).when(p.rlike(shape), out)
    return F.when(~p.contains("~"), one(p)).when(p.rlike(shape), only_if(out, lambda x: F.size(x) <= MOST))


def expand_spec(core: Column, mountain: Column, mode: str = "current") -> Column:
    """Lots of a spec such as 169-35~40 or 256-1ㆍ2ㆍ3; null if it can't be read, empty for nothing.

    After a middle dot, parts without a hyphen take the main number of the first part.
    """
    parts = F.filter(F.split(core, DOT), lambda p: p != "")
    base = F.split_part(F.get(parts, F.lit(0)), F.lit("-"), F.lit(1))
    hyphen = F.get(parts, F.lit(0)).contains("-")
    full = F.transform(F.arrays_zip(parts.alias("p"), F.transform(parts, lambda _: base).alias("b"), F.transform(parts, lambda _: hyphen).alias("h")), lambda x: F.when(x["h"] & ~x["p"].contains("-"), F.concat(x["b"], F.lit("-"), x["p"])).otherwise(x["p"]))
    lots = F.transform(full, lambda p: expand_part(p, mode))
    many = F.flatten(only_if(lots, lambda parts: ~F.exists(parts, lambda x: x.isNull())))
    out = F.when(core == "", F.array().cast(_NONE)).when(core.contains(DOT), many).otherwise(expand_part(core, mode))
    return F.when(mountain, F.transform(out, lambda x: F.concat(F.lit(MOUNTAIN), x))).otherwise(out)


def expand_mountain_range(word: Column) -> Column:
    """Lots of a range whose right end says 산: sub numbers of one main number, or main numbers and both ends; empty if unreadable."""
    core = F.btrim(F.replace(word, F.lit(MOUNTAIN), F.lit("")), F.lit("-~ㆍ"))
    shape = r"^(\d+)(?:-(\d+))?~(\d+)(?:-(\d+))?$"
    a, sub_a, b, sub_b = (F.regexp_extract(core, shape, k) for k in (1, 2, 3, 4))
    na, nb = _number(a), _number(b)
    low, high = F.coalesce(_number(sub_a), F.lit(0).cast("bigint")), F.coalesce(_number(sub_b), F.lit(0).cast("bigint"))
    name = lambda n: F.concat(F.lit(MOUNTAIN), n.cast("string"))
    subs = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.when(k == 0, name(na)).otherwise(F.concat(name(na), F.lit("-"), k.cast("string"))))).otherwise(F.array().cast(_NONE))
    end = lambda x, sub: F.when(sub != "", F.array(F.concat(F.lit(MOUNTAIN), x, F.lit("-"), sub))).otherwise(F.array().cast(_NONE))
    bons = F.concat(F.transform(F.sequence(na, nb), name), end(a, sub_a), end(b, sub_b))
    out = F.when(na == nb, subs).when((nb - na > 0) & (nb - na < MOST), bons)
    return F.coalesce(F.when(core.rlike(shape), out), F.array().cast(_NONE))


def pnu_district(pnu: Column) -> Column:
    """The ten digits of the legal district; null unless the key starts with 19 digits."""
    return F.when(F.btrim(pnu).rlike(r"^\d{19}"), F.substring(F.btrim(pnu), 1, 10))


def pnu_lot(pnu: Column) -> Column:
    """The lot of a 19-digit parcel key: 산 if the eleventh digit is 2, main number, and sub number unless it is 0."""
    p = F.btrim(pnu)
    bon, bu = (F.substring(p, k, 4).try_cast("int") for k in (12, 16))
    lot = F.concat(F.when(F.substring(p, 11, 1) == "2", MOUNTAIN).otherwise(""), bon.cast("string"), F.when(bu > 0, F.concat(F.lit("-"), bu.cast("string"))).otherwise(""))
    return F.when(p.rlike(r"^\d{19}"), lot)


def jibun_lot(s: Column) -> Column:
    """The lot in free text: its first number or pair of numbers, a sub number of 0 left out, 산 if the text says so."""
    bon, bu = (F.regexp_extract(s, r"(\d+)(?:-(\d+))?", k).try_cast("bigint") for k in (1, 2))
    lot = F.concat(F.when(s.contains(MOUNTAIN), MOUNTAIN).otherwise(""), bon.cast("string"), F.when(bu > 0, F.concat(F.lit("-"), bu.cast("string"))).otherwise(""))
    return F.when(s.rlike(r"\d"), lot)


def land_category(s: Column, mode: str = "hangul") -> Column:
    """The land category behind a lot number.

    hangul: Hangul at the end; stripped: what follows the last digit, without blanks; raw: the same with blanks.
    """
    if mode == "hangul":
        return F.regexp_extract(s, r"([가-힣]+)\s*$", 1)
    tail = F.regexp_extract(s, r"(\D*)$", 1)
    return F.btrim(tail) if mode == "stripped" else tail


def main_number(lot: Column) -> Column:
    """What stands before the first hyphen, 산 with it."""
    return F.split_part(lot, F.lit("-"), F.lit(1))


def without_zero_sub(lot: Column) -> Column:
    """12-0 is 12."""
    return F.regexp_replace(lot, "-0$", "")


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def grade(n: Column) -> Column:
    """How badly a unit is torn, by the number of its torn parcels."""
    return F.when(n <= 10, GRADES[0]).when(n <= 60, GRADES[1]).otherwise(GRADES[2])


def circular_distance(a: Column, b: Column, slots: int = 12) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(slots))
    return F.least(d, slots - d)


def range_artifact(lot: Column) -> Column:
    """Whether a lot looks like a range that was read as main and sub number: the right side has 3 digits and is larger."""
    a, b = (F.regexp_extract(lot, r"^(\d+)-(\d+)$", k) for k in (1, 2))
    return F.when(lot.rlike(r"^\d+-\d+$"), (F.length(b) >= 3) & (b.try_cast("bigint") > a.try_cast("bigint"))).otherwise(F.lit(False))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Twice the bigrams of a (with repeats) that b has, over a's bigrams and b's different ones; 1 if equal, 0 if either is short."""

    def bigrams(s):
        return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast(_NONE))

    left, right = bigrams(a), F.array_distinct(bigrams(b))
    shared = F.aggregate(left, F.lit(0), lambda n, x: n + F.when(F.array_contains(right, x), 1).otherwise(0))
    return (
        F.when(F.coalesce(F.length(a), F.lit(0)) == 0, 0.0)
        .when(F.coalesce(F.length(b), F.lit(0)) == 0, 0.0)
        .when(a == b, 1.0)
        .when((F.length(a) < 2) | (F.length(b) < 2), 0.0)
        .otherwise(2.0 * shared / (F.size(left) + F.size(right)))
    )


def contains_either_way(a: Column, b: Column, least: int = 4) -> Column:
    return (F.length(a) >= least) & (a != b) & (a.contains(b) | b.contains(a))


def search_name(s: Column) -> Column:
    """A complex's name for matching: no blanks, lower case, without the words for apartment, one spelling of e-/이편한세상."""
    s = F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", ""))
    s = F.regexp_replace(s, "아파트|ⓐ|ａ", "")
    return F.replace(F.replace(s, F.lit("ｅ"), F.lit("e")), F.lit("e편한세상"), F.lit("이편한세상"))


#: Hangul letters that number buildings, in their order.
BUILDING_LETTERS = "가나다라마바사아자차카타파하"


def buildings(s: Column) -> Column:
    """All buildings named in a text, sorted: numbers and ranges of numbers (spans under 40), Hangul letters and A-Z with ranges."""
    letters = f"[{BUILDING_LETTERS}]"
    edge = r"(?:^|[\s(（])"
    dash = r"\s*동?\s*[~～\-]\s*"
    every = lambda p, k: F.regexp_extract_all(s, F.lit(p), F.lit(k))
    numbers = r"(\d+)" + dash + r"(\d+)\s*동"
    span = F.zip_with(every(numbers, 1), every(numbers, 2), lambda a, b: F.struct(a.try_cast("bigint").alias("a"), b.try_cast("bigint").alias("b")))
    span = F.filter(span, lambda x: (x["b"] - x["a"] > 0) & (x["b"] - x["a"] < 40))
    out = F.flatten(F.transform(span, lambda x: F.transform(F.sequence(x["a"], x["b"]), lambda n: n.cast("string"))))
    out = F.concat(out, every(r"(\d+)\s*동", 1), every(edge + f"({letters})동", 1), every(edge + r"([A-Za-z])동", 1))
    hangul = edge + f"({letters})" + dash + f"({letters})" + r"\s*동"
    place = lambda c: F.position(c, F.lit(BUILDING_LETTERS))
    ends = F.zip_with(every(hangul, 1), every(hangul, 2), lambda a, b: F.struct(place(a).alias("a"), place(b).alias("b")))
    ends = F.filter(ends, lambda x: x["a"] <= x["b"])
    out = F.concat(out, F.flatten(F.transform(ends, lambda x: F.transform(F.sequence(x["a"], x["b"]), lambda n: F.substring(F.lit(BUILDING_LETTERS), n, F.lit(1))))))
    latin = edge + "([A-Za-z])" + dash + r"([A-Za-z])\s*동"
    ends = F.zip_with(every(latin, 1), every(latin, 2), lambda a, b: F.struct(F.ascii(F.upper(a)).alias("a"), F.ascii(F.upper(b)).alias("b")))
    ends = F.filter(ends, lambda x: x["a"] <= x["b"])
    out = F.concat(out, F.flatten(F.transform(ends, lambda x: F.transform(F.sequence(x["a"], x["b"]), lambda n: F.chr(n)))))
    return F.array_sort(F.array_distinct(out))


# The first lot of a text with its district, and what isn't part of a complex's name.
FIRST_LOT = r"([가-힣]{2,4}[동리])\s*(산?\d+(?:-\d+)?)"
NOT_OF_NAME = ("[()（）]", " "), (r"^[가-힣]{2,4}[동리]\s*", ""), (r"\d+동.*$", ""), (r"\d+호.*$", ""), (r"산?\d[\d\-~ㆍ]*", ""), ("상가|아파트|유치원|,", "")
NICE = (50, 100, 200, 300, 500, 1000, 2000, 3000, 5000)


def first_lot(s: Column, districts: list[str]) -> Column:
    """struct(legal, lot) of the first lot in a text, if its district is known."""
    found = F.struct(F.regexp_extract(s, FIRST_LOT, 1).alias("legal"), F.regexp_extract(s, FIRST_LOT, 2).alias("lot"))
    return F.when(found["legal"].isin(districts), found)


def all_lots(s: Column, districts: list[str]) -> Column:
    """All lots of a text with known districts, as structs."""
    every = F.zip_with(F.regexp_extract_all(s, F.lit(FIRST_LOT), F.lit(1)), F.regexp_extract_all(s, F.lit(FIRST_LOT), F.lit(2)), lambda a, b: F.struct(a.alias("legal"), b.alias("lot")))
    return F.filter(every, lambda x: x["legal"].isin(districts))


def cluster_name(s: Column) -> Column:
    """What identifies a complex in a ledger text, without district, buildings, units, lots, blanks and a final 차."""
    for pattern, to in NOT_OF_NAME:
        s = F.regexp_replace(s, pattern, to)
    return F.regexp_replace(F.trim(s), r"[\s·~（）]|시흥장현|차$", "")


def nice_number(v: Column) -> Column:
    """The round length closest to v, the smaller on ties."""
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(float(x)) - v).alias("d"), F.lit(x).alias("v")) for x in NICE]))["v"]


def territory_pairs(s: Column) -> Column:
    """structs (legal, lot) of a territory text: parentheses go, a district needs a blank before its lots and holds until the next."""
    text = F.regexp_replace(normalize_text(s), r"\([^)]*\)", "")
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    pattern = r"^([가-힣]{2,4}[동리])\s+(.+)$"
    start = F.struct(F.lit("").alias("legal"), F.array().cast("array<struct<legal:string,spec:string>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        legal = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(acc["legal"])
        spec = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 2)).otherwise(t)
        entry = F.array(F.struct(legal.alias("legal"), F.btrim(spec, F.lit(" ,")).alias("spec")))
        return F.struct(legal.alias("legal"), F.when(legal != "", F.concat(acc["out"], entry)).otherwise(acc["out"]).alias("out"))

    specs = F.aggregate(tokens, start, step, lambda acc: acc["out"])
    none = F.array().cast("array<struct<legal:string,lot:string>>")

    def lots_of(x: Column) -> Column:
        mountain = x["spec"].startswith(MOUNTAIN)
        core = F.trim(F.when(mountain, F.substr(x["spec"], F.lit(2))).otherwise(x["spec"]))
        zipped = F.transform(F.coalesce(expand_spec(core, mountain), F.array().cast(_NONE)), lambda lot: F.struct(x["legal"].alias("legal"), lot.alias("lot")))
        return F.coalesce(zipped, none)

    return F.flatten(F.transform(specs, lots_of))
