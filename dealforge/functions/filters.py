"""Predicates over deals, and one specification that combines them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from .clean import ADDRESS_STOP, cased_address, clean_text, gush_key, num, price_metric, text_key, tokens, tri_state
from .schema import FIRST_BUILD_YEAR, LAST_BUILDING_AGE, UNKNOWN

Range = tuple[float | None, float | None]


def in_text(c: str, values: list[str]) -> Column | None:
    """The column is one of the values, compared without case and outer blanks; no values: no filter."""
    keys = sorted({v.strip().lower() for v in values})
    return text_key(c).isin(keys) if keys else None


def in_gush(values: list, c: str = "gush") -> Column | None:
    keys = sorted({str(int(float(v))) if _number(v) and float(v) % 1 == 0 else str(v).strip().lower() for v in values})
    return gush_key(c).isin(keys) if keys else None


def _number(v) -> bool:
    try:
        float(v)
    except (TypeError, ValueError):
        return False
    return True


def in_range(c: Column | str, bounds: Range | None) -> Column | None:
    """Inclusive on both sides; null fails; without bounds no filter."""
    if bounds is None or bounds == (None, None):
        return None
    v = c if isinstance(c, Column) else num(c)
    ok = v.isNotNull()
    if bounds[0] is not None:
        ok &= v >= bounds[0]
    if bounds[1] is not None:
        ok &= v <= bounds[1]
    return ok


def _with_unknown(known: Column, c: Column, bounds: Range | None, unknown: bool) -> Column | None:
    """In range if known; unknown values stay unless switched off, which holds without a range too."""
    inside = in_range(c, bounds)
    known = F.coalesce(known, F.lit(False))
    if inside is None:
        return None if unknown else known
    return (known & inside) | (~known if unknown else F.lit(False))


def floor_ok(bounds: Range | None, unknown: bool = True, c: str = "floor") -> Column | None:
    return _with_unknown(num(c) != UNKNOWN, num(c), bounds, unknown)


def rooms_ok(values: list[float] | None, unknown: bool = True) -> Column | None:
    """Rooms rounded to halves, halves of halves to even, are among the values."""
    r = num("rooms")
    known = F.coalesce(r != UNKNOWN, F.lit(False))
    if not values:
        return None if unknown else known
    chosen = (F.bround(r * 2) / 2).isin([float(v) for v in values])
    return (known & chosen) | (~known if unknown else F.lit(False))


def ppm_ok(bounds: Range | None) -> Column | None:
    return in_range(price_metric("per_m2"), bounds)


def build_year_ok(bounds: Range | None, unknown: bool = True) -> Column | None:
    return _with_unknown(num("build_year") >= FIRST_BUILD_YEAR, num("build_year"), bounds, unknown)


def age_ok(bounds: Range | None, unknown: bool = True) -> Column | None:
    return _with_unknown(num("building_age") <= LAST_BUILDING_AGE, num("building_age"), bounds, unknown)


def build_floors_ok(bounds: Range | None, unknown: bool = True) -> Column | None:
    return floor_ok(bounds, unknown, "build_floors")


def _choice(value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")


def roof_ok(choice: str) -> Column | None:
    _choice(choice, ("both", "yes", "no"))
    return None if choice == "both" else F.coalesce(tri_state("roof") == (choice == "yes"), F.lit(False))


def project_ok(choice: str | list[str]) -> Column | None:
    if isinstance(choice, list):
        return in_text("new_project", choice)
    _choice(choice, ("both", "yes", "no"))
    return None if choice == "both" else text_key("new_project") == ("new project" if choice == "yes" else "2nd hand")


def address_ok(query: str, c: str = "full_address", stop: tuple[str, ...] = ADDRESS_STOP) -> Column:
    """Every token of the query occurs, numbers as whole numbers; a query without tokens has no rows."""
    found = tokens(query, stop)
    text = F.coalesce(cased_address(c), F.lit(""))
    ok = F.lit(bool(found))
    for t in found:
        ok &= F.regexp_like(text, F.lit(rf"(?<![0-9]){t}(?![0-9])")) if t.isdigit() else text.contains(t)
    return ok


def basis_ok(choice: str) -> Column | None:
    _choice(choice, ("all", "verified"))
    return None if choice == "all" else F.col("location_basis") == "strict_transaction"


def share_ok(choice: str) -> Column | None:
    _choice(choice, ("all", "full", "partial", "unknown"))
    p = num("sale_portion")
    if choice == "all":
        return None
    known = {"full": p == 1, "partial": (p > 0) & (p < 1), "unknown": p.isNull() | (p <= 0) | (p > 1)}[choice]
    return F.coalesce(known, F.lit(False))


def complete_ok(choice: str) -> Column | None:
    _choice(choice, ("all", "address", "floor", "both"))
    address = clean_text("full_address").isNotNull()
    floor = F.coalesce(num("floor") != UNKNOWN, F.lit(False))
    return {"all": None, "address": address, "floor": floor, "both": address & floor}[choice]


@dataclass(frozen=True)
class FilterSpec:
    """What to keep; a field at its default keeps everything."""

    cities: tuple[str, ...] = ()
    streets: tuple[str, ...] = ()
    gushes: tuple = ()
    address: str | None = None
    basis: str = "all"
    share: str | None = None
    complete: str = "all"
    types: tuple[str, ...] = ()
    years: Range | None = None
    price: Range | None = None
    area: Range | None = None
    per_m2: Range | None = None
    floor: Range | None = None
    unknown_floor: bool = True
    rooms: tuple[float, ...] = ()
    unknown_rooms: bool = True
    build_year: Range | None = None
    unknown_build_year: bool = True
    age: Range | None = None
    unknown_age: bool = True
    build_floors: Range | None = None
    unknown_build_floors: bool = True
    roof: str = "both"
    project: str | tuple[str, ...] = "both"

    def location(self) -> FilterSpec:
        """The choice of place alone."""
        return FilterSpec(cities=self.cities, streets=self.streets, gushes=self.gushes, address=self.address)

    def rest(self) -> FilterSpec:
        """Everything but the choice of place."""
        return replace(self, cities=(), streets=(), gushes=(), address=None)

    def without_address(self) -> FilterSpec:
        return replace(self, address=None)

    def column(self) -> Column:
        project = list(self.project) if isinstance(self.project, tuple) else self.project
        parts = [
            in_text("city", list(self.cities)), in_text("street", list(self.streets)), in_gush(list(self.gushes)),
            None if self.address is None else address_ok(self.address), basis_ok(self.basis),
            None if self.share is None else share_ok(self.share), complete_ok(self.complete), in_text("apt_type", list(self.types)),
            in_range("deal_year", self.years), in_range("price_millions", self.price), in_range("area", self.area), ppm_ok(self.per_m2),
            floor_ok(self.floor, self.unknown_floor), rooms_ok(list(self.rooms), self.unknown_rooms), build_year_ok(self.build_year, self.unknown_build_year),
            age_ok(self.age, self.unknown_age), build_floors_ok(self.build_floors, self.unknown_build_floors), roof_ok(self.roof), project_ok(project),
        ]
        out = F.lit(True)
        for p in parts:
            if p is not None:
                out &= p
        return out


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """The rows that meet the specification, in one condition.

    Where the table knows shares of sales and none is chosen, only full sales count.
    """
    if spec.share is None and "sale_portion" in df.columns:
        spec = replace(spec, share="full")
    return df.where(spec.column())


def exclude_years(df: DataFrame, years: list[int]) -> DataFrame:
    return df.where(F.col("deal_year").isNull() | ~F.col("deal_year").isin([float(y) for y in years]))


def import_valid(df: DataFrame, cutoff: str, types: list[str]) -> DataFrame:
    """Residential, dated up to the cutoff, with a positive amount."""
    return df.where(F.col("apt_type").isin(types) & (F.col("deal_date") <= F.lit(cutoff).cast("date")) & (num("deal_amount") > 0))


def keep_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur in ``groups``."""
    return df.join(groups.select(*keys).distinct(), keys, "left_semi")


def search_rows(df: DataFrame, text: str = "", contains: dict[str, str] | None = None, ranges: dict[str, Range] | None = None, order: list | None = None) -> DataFrame:
    """Rows in which one column holds every word of ``text``, with column filters and an order.

    Words are those of an address search: numbers are whole numbers, stop words do not count. A
    text without any word asks for nothing.
    """
    out = df
    if tokens(text, ADDRESS_STOP):
        held = F.lit(False)
        for c in df.columns:
            held |= address_ok(text, c)
        out = out.where(held)
    for c, part in (contains or {}).items():
        out = out.where(F.lower(F.col(c).cast("string")).contains(part.lower()))
    for c, bounds in (ranges or {}).items():
        ok = in_range(c, bounds)
        out = out if ok is None else out.where(ok)
    return out.orderBy(*order) if order else out
