"""Columns, sentinels and bands of the deals table."""

from pyspark.sql import types as T

#: Fixed value: stands for an unknown number of rooms, floor or floors.
UNKNOWN = 999.0
#: Plausible areas, the least area for each room, the first year of building and the highest age.
AREA_LOW, AREA_HIGH, AREA_PER_ROOM, ROOMS_HIGH = 15.0, 1000.0, 8.0, 20.0
FIRST_BUILD_YEAR, LAST_BUILDING_AGE = 1900.0, 150.0

DEALS = T.StructType([
    T.StructField("city", T.StringType()), T.StructField("street", T.StringType()), T.StructField("gush", T.DoubleType()),
    T.StructField("gush_code", T.StringType()), T.StructField("full_address", T.StringType()), T.StructField("deal_date", T.DateType()),
    T.StructField("deal_year", T.DoubleType()), T.StructField("price_millions", T.DoubleType()), T.StructField("area", T.DoubleType()),
    T.StructField("rooms", T.DoubleType()), T.StructField("floor", T.DoubleType()), T.StructField("build_floors", T.DoubleType()),
    T.StructField("roof", T.StringType()), T.StructField("apt_type", T.StringType()), T.StructField("new_project", T.StringType()),
    T.StructField("build_year", T.DoubleType()), T.StructField("building_age", T.DoubleType()), T.StructField("story", T.StringType()),
])

#: Half-open bands of each attribute: column, then (low, high, label).
BANDS = {
    "rooms": ("rooms", [(1, 2, "1-1.5"), (2, 3, "2-2.5"), (3, 4, "3-3.5"), (4, 5, "4-4.5"), (5, 6, "5-5.5"), (6, 13, "6+")]),
    "floor": ("floor", [(-10, 1, "ground or below"), (1, 3, "1-2"), (3, 6, "3-5"), (6, 11, "6-10"), (11, 100, "11+")]),
    "age": ("building_age", [(-5, 3, "new"), (3, 11, "3-10"), (11, 26, "11-25"), (26, 51, "26-50"), (51, 150, "51+")]),
    "area": ("area", [(15, 50, "to 50"), (50, 75, "50-75"), (75, 100, "75-100"), (100, 130, "100-130"), (130, 1000, "130+")]),
}
#: Fixed value: types with a band of their own.
TOP_TYPES = 6
