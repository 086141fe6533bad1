"""Cleaning and derived columns: every function takes and returns a Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .schema import AREA_HIGH, AREA_LOW, AREA_PER_ROOM, ROOMS_HIGH, UNKNOWN

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Col) -> Column:
    """A double; what is no finite number is null. NaN is beyond infinity in order."""
    d = _c(c).try_cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def parse_number(c: Col) -> Column:
    """The first decimal number of a text without thousands separators and the shekel sign."""
    return F.regexp_extract(F.translate(_c(c).cast("string"), ",₪", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def parse_date(c: Col, *formats: str) -> Column:
    """The first of the formats that fits; by default ISO, then day first with dots, then slashes."""
    return F.coalesce(*[F.try_to_date(_c(c), f) for f in formats or ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")])


def clean_text(c: Col) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


def city_name(c: Col, aliases: dict[str, str]) -> Column:
    """The common name of a city; ``aliases`` is a short list."""
    name = clean_text(c)
    if not aliases:
        return name
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def gush_of(code: Col) -> Column:
    return F.regexp_extract(_c(code), r"^\s*([0-9]+)", 1).try_cast("double")


def address_of(street: Col, city: Col) -> Column:
    joined = F.concat(F.coalesce(clean_text(street), F.lit("")), F.lit(", "), F.coalesce(clean_text(city), F.lit("")))
    return F.nullif(F.regexp_replace(joined, r"^[ ,]+|[ ,]+$", ""), F.lit(""))


def roof_flag(kind: Col, text: Col, floor: Col, high_floor: Col, build_floors: Col, roof_types: list[str], roof_word: str) -> Column:
    """A roof apartment by its type, its text, or being on the last floor."""
    no = F.lit(False)
    return (F.coalesce(_c(kind).isin(roof_types), no) | F.coalesce(_c(text).contains(roof_word), no)
            | F.coalesce(_c(floor) == _c(build_floors), no) | F.coalesce(_c(high_floor) == _c(build_floors), no))


def new_project_flag(flag: Col, build_year: Col, deal_year: Col) -> Column:
    new = F.coalesce(_c(flag).isin("1", "true", "TRUE", "כן"), F.lit(False)) | F.coalesce(_c(build_year) >= _c(deal_year), F.lit(False))
    return F.when(new, "New Project").otherwise("2nd hand")


def building_age(deal_year: Col, build_year: Col, year_built: Col | None = None) -> Column:
    built = _c(build_year) if year_built is None else F.coalesce(_c(build_year), _c(year_built))
    return _c(deal_year) - built


def source_key(resource: Col, row: Col) -> Column:
    return F.nullif(F.concat(F.coalesce(_c(resource), F.lit("")), F.lit(":"), F.coalesce(_c(row).cast("string"), F.lit(""))), F.lit(":"))


def story(**fields: Col) -> Column:
    """One ``name: value`` line for each field; a dash for null, whole numbers without decimals."""
    lines = []
    for name, c in fields.items():
        text = F.regexp_replace(_c(c).cast("string"), r"\.0$", "")
        lines.append(F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("-"))))
    return F.concat_ws("\n", *lines)


def cadastral_key(code: Col) -> Column:
    """``block-parcel-unit`` without leading zeros, or null unless all three are positive integers."""
    plain = F.regexp_replace(_c(code), r"\s|\.0*(?=-|$)", "")
    return F.when(F.regexp_like(plain, F.lit("^0*[1-9][0-9]*(?:-0*[1-9][0-9]*){2}$")), F.regexp_replace(plain, "(?<![0-9])0+", ""))


def quality_flags(**missing: Col) -> Column:
    """The names of those columns that are null or blank, joined by semicolons."""
    return F.concat_ws(";", *[F.when(F.coalesce(F.trim(_c(c).cast("string")), F.lit("")) == "", name) for name, c in missing.items()])


def plausible_area(area: Col = "area", rooms: Col = "rooms") -> Column:
    a, r = num(area), num(rooms)
    crowded = (r > 0) & (r < ROOMS_HIGH) & (a < r * AREA_PER_ROOM)
    return F.coalesce(a.between(AREA_LOW, AREA_HIGH), F.lit(False)) & ~F.coalesce(crowded, F.lit(False))


def price_metric(kind: str = "price") -> Column:
    """``price`` in millions, ``per_m2`` in thousands, or ``per_room`` in millions."""
    price, area, rooms = num("price_millions"), num("area"), num("rooms")
    if kind == "price":
        return price
    if kind == "per_m2":
        return F.when(plausible_area(), price * 1000 / area)
    if kind == "per_room":
        return F.when((rooms > 0) & (rooms != UNKNOWN), price / rooms)
    raise ValueError(f"no such price metric: {kind}")


def price_ils(amount: Col = "deal_amount", millions: Col = "price_millions") -> Column:
    return F.coalesce(num(amount), num(millions) * 1e6)


def display_address(full: Col = "full_address", street: Col = "street", city: Col = "city") -> Column:
    return F.coalesce(clean_text(full), F.nullif(F.concat_ws(", ", clean_text(street), clean_text(city)), F.lit("")))


def compact(c: Col, places: int = 3) -> Column:
    """Rounded to three decimals, halves of the scaled double to even; what rounds to nothing keeps its sign."""
    x, by = _c(c).cast("double"), float(10**places)
    return F.when(F.abs(x * by) < float("inf"), F.rint(x * by) / by).otherwise(x)


def text_key(c: Col) -> Column:
    return F.lower(F.trim(_c(c).cast("string")))


def gush_key(c: Col) -> Column:
    """One key for a block number written as a number or as a text."""
    n = num(_c(c).cast("string"))
    return F.coalesce(F.when(n % 1 == 0, n.cast("long").cast("string")), text_key(c))


#: What a roof column may say, lower case.
YES = ["true", "yes", "1", "1.0", "כן"]
NO = ["false", "no", "0", "0.0", "לא"]


def tri_state(c: Col) -> Column:
    t = text_key(c)
    return F.when(t.isin(YES), True).when(t.isin(NO), False)


def place_key(c: Col) -> Column:
    """A place name without case, spaces, hyphens, quotes and their typographic forms."""
    return F.regexp_replace(F.lower(F.trim(_c(c))), "[\\s\\-'\"־׳״–—‘’“”`]", "")


def suspect_flags(snapshot_year: int) -> Column:
    r, a, b = num("rooms"), num("area"), num("build_year")
    return F.array_compact(F.array(
        F.when((r < 1) | (r > 20) | (r * 2 % 1 != 0), "rooms"), F.when((a <= 0) | (a > 1000), "area"), F.when((b < 1800) | (b > snapshot_year + 10), "build_year"),
    ))


#: Floors in words.
FLOORS = {
    "מרתף": -1, "מרתף שני": -1, "מרתף \u200e-1\u200f": -1,
    "קרקע": 0, "הקרקע": 0, "קרקע תחתונה": 0, "קרקע עליונה": 0, "ראשונה (קרקע)": 0, "קרקע וראשונה": 0, "קרקע + ראשונה": 0, "קרקע+ראשונה": 0,
    "קרקע ראשונה": 0, "קרקע, ראשונה": 0, "קרקע,ראשונה": 0, "מרתף+קרקע": 0, "מרתף + קרקע": 0, "מרתף וקרקע": 0, "מרתף, קרקע": 0, "מרתף+קרקע+ראשונה": 0,
    "מרתף + קרקע + ראשונה": 0, "מרתף קרקע ראשונה": 0, "ראשונה+קרקע": 0,
    "ראשונה": 1, "א": 1, "א'": 1, "עמודים": 1, "ראשונה+שניה": 1, "ראשונה + שניה": 1, "ראשונה +שניה": 1, "ראשונה, שניה": 1, "ראשונה שניה": 1,
    "קרקע ראשונה ושניה": 1, "קרקע+ראשונה+שניה": 1, "קרקע + ראשונה + שניה": 1, "קרקע, ראשונה, שניה": 1, "קרקע,ראשונה,שניה": 1, "קרקע ראשונה שניה": 1,
    "שניה+קרקע": 1,
    "שנייה": 2, "שניה": 2, "ב": 2, "ב'": 2, "שניה ושלישית": 2, "שניה+שלישית": 2, "שניה + שלישית": 2, "שניה, שלישית": 2, "שניה שלישית": 2,
    "שניה+גג": 2, "שניה וגג": 2,
    "שלישית": 3, "ג": 3, "ג'": 3, "שלישית ורביעית": 3, "שלישית+רביעית": 3, "שלישית + רביעית": 3, "שלישית רביעית": 3, "שלישית, רביעית": 3,
    "שלישית+גג": 3, "שלישית + גג": 3, "שלישית וגג": 3,
    "רביעית": 4, "ד": 4, "ד'": 4, "רביעית+חמישית": 4, "רביעית + חמישית": 4, "רביעית וחמישית": 4, "רביעית, חמישית": 4, "רביעית חמישית": 4,
    "רביעית+גג": 4, "רביעית + גג": 4, "רביעית וגג": 4,
    "חמישית": 5, "ה": 5, "חמישית+שישית": 5, "חמישית + שישית": 5, "חמישית ושישית": 5, "חמישית, שישית": 5, "חמישית שישית": 5, "חמישית+גג": 5,
    "חמישית + גג": 5, "חמישית וגג": 5,
    "שישית": 6, "ו": 6, "שישית+שביעית": 6, "שישית + שביעית": 6, "שישית ושביעית": 6, "שישית, שביעית": 6, "שישית+גג": 6, "שישית + גג": 6,
    "שביעית": 7, "שביעית+שמינית": 7, "שביעית + שמינית": 7, "שביעית, שמינית": 7, "שביעית ושמינית": 7, "שביעית שמינית": 7,
    "שמינית": 8, "שמינית+תשיעית": 8, "שמינית + תשיעית": 8, "שמינית, תשיעית": 8, "שמינית ותשיעית": 8,
    "תשיעית": 9, "תשיעית+עשירית": 9, "תשיעית + עשירית": 9, "תשיעית, עשירית": 9, "תשיעית ועשירית": 9,
    "עשירית": 10,
    "אחת עשרה": 11,
    "שתים עשרה": 12,
    "שלוש עשרה": 13,
    "ארבע עשרה": 14,
    "חמש עשרה": 15,
    "שש עשרה": 16,
    "שבע עשרה": 17,
    "שמונה עשרה": 18,
    "תשע עשרה": 19,
    "עשרים": 20,
    "עשרים ואחת": 21,
    "עשרים ושתיים": 22, "עשרים ושתים": 22,
    "עשרים ושלוש": 23,
    "עשרים וארבע": 24,
    "עשרים וחמש": 25,
    "עשרים ושש": 26,
    "עשרים ושבע": 27,
    "עשרים ושמונה": 28,
    "עשרים ותשע": 29,
    "שלושים": 30,
    "שלושים ואחת": 31,
    "שלושים ושתיים": 32,
    "שלושים ושלוש": 33,
    "שלושים וארבע": 34,
    "שלושים וחמש": 35,
    "שלושים ושבע": 37,
}
#: The top floor of phrases that name several.
HIGH_FLOORS = {
    "קרקע וראשונה": 1, "קרקע + ראשונה": 1, "קרקע+ראשונה": 1, "קרקע ראשונה": 1, "קרקע, ראשונה": 1, "קרקע,ראשונה": 1, "מרתף+קרקע+ראשונה": 1,
    "מרתף + קרקע + ראשונה": 1, "מרתף קרקע ראשונה": 1,
    "ראשונה+שניה": 2, "ראשונה + שניה": 2, "ראשונה +שניה": 2, "ראשונה, שניה": 2, "ראשונה שניה": 2, "קרקע ראשונה ושניה": 2, "קרקע+ראשונה+שניה": 2,
    "קרקע + ראשונה + שניה": 2, "קרקע, ראשונה, שניה": 2, "קרקע,ראשונה,שניה": 2, "קרקע ראשונה שניה": 2,
    "שניה ושלישית": 3, "שניה+שלישית": 3, "שניה + שלישית": 3, "שניה, שלישית": 3, "שניה שלישית": 3,
    "שלישית ורביעית": 4, "שלישית+רביעית": 4, "שלישית + רביעית": 4, "שלישית רביעית": 4, "שלישית, רביעית": 4,
    "רביעית+חמישית": 5, "רביעית + חמישית": 5, "רביעית וחמישית": 5, "רביעית, חמישית": 5, "רביעית חמישית": 5,
    "חמישית+שישית": 6, "חמישית + שישית": 6, "חמישית ושישית": 6, "חמישית, שישית": 6, "חמישית שישית": 6,
    "שישית+שביעית": 7, "שישית + שביעית": 7, "שישית ושביעית": 7, "שישית, שביעית": 7,
    "שביעית+שמינית": 8, "שביעית + שמינית": 8, "שביעית, שמינית": 8, "שביעית ושמינית": 8, "שביעית שמינית": 8,
    "שמינית+תשיעית": 9, "שמינית + תשיעית": 9, "שמינית, תשיעית": 9, "שמינית ותשיעית": 9,
    "תשיעית+עשירית": 10, "תשיעית + עשירית": 10, "תשיעית, עשירית": 10, "תשיעית ועשירית": 10,
}
FLOOR_WORD = "קומה"


def floor_words() -> dict[str, float]:
    """Floors in words, a phrase of several as its lowest."""
    return dict(FLOORS)


def _floor_text(text: Col) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), "[\\u200e\\u200f\\u202a-\\u202e\\u00a0]", " "), "\\s+", " "))


def _looked_up(text: Column, words: dict[str, float]) -> Column:
    if not words:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(x) for w, n in words.items() for x in (w, float(n))]), text)


def floor_number(text: Col, words: dict[str, float], word: str = FLOOR_WORD) -> Column:
    """A floor text as a number: a known phrase, a whole number, or the number beside ``word``."""
    t = _floor_text(text)
    beside = F.coalesce(F.nullif(F.regexp_extract(t, rf"^{word}\s*(-?[0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"^(-?[0-9]+)\s*{word}", 1), F.lit("")))
    return F.coalesce(_looked_up(t, words), F.regexp_extract(t, r"^(-?[0-9]+)$", 1).try_cast("double"), beside.try_cast("double"))


def high_floor(text: Col, phrases: dict[str, float], floor: Col) -> Column:
    """The top floor of a known phrase that names several, else ``floor``."""
    return F.coalesce(_looked_up(_floor_text(text), phrases), _c(floor))


#: Points of Hebrew and quotes, which an address search leaves out.
UNSAID = "[\u0591-\u05bd\u05bf-\u05c7'\"׳״‘’“”]"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def cased_address(c: Col) -> Column:
    """An address for token search: NFKC, lower case, without points of Hebrew and quotes.

    Only texts beyond ASCII and Hebrew letters, which NFKC leaves as they are, go to Python.
    """
    text = _c(c).cast("string")
    other = F.when(text.rlike(r"[^\x00-\x7f\u05d0-\u05ea]"), text)
    return F.regexp_replace(F.lower(F.coalesce(_nfkc(other), text)), UNSAID, "")


#: Words that say nothing in an address.
ADDRESS_STOP = ("רחוב", "רח", "מספר")


def tokens(query: str, stop: tuple[str, ...] = (), most: int = 160) -> list[str]:
    """The letter and digit runs of a query, NFKC, lower case, without stop words."""
    import re
    import unicodedata

    if len(query) > most:
        raise ValueError(f"a query has at most {most} characters")
    plain = re.sub(UNSAID, "", unicodedata.normalize("NFKC", query).lower())
    return [t for t in re.findall(r"[^\W_]+", plain) if t not in stop]
