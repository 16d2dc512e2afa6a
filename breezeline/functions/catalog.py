"""The city catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.functions.text import city_slug, hyphen_alias, warehouse_slug

# The home-country cities as name, latitude, longitude.
INDIA_CITIES = (
    ("Delhi", 28.6139, 77.2090),
    ("Mumbai", 19.0760, 72.8777),
    ("Bengaluru", 12.9716, 77.5946),
    ("Hyderabad", 17.3850, 78.4867),
    ("Chennai", 13.0827, 80.2707),
    ("Kolkata", 22.5726, 88.3639),
    ("Pune", 18.5204, 73.8567),
    ("Ahmedabad", 23.0225, 72.5714),
    ("Jaipur", 26.9124, 75.7873),
    ("Lucknow", 26.8467, 80.9462),
    ("Surat", 21.1702, 72.8311),
    ("Kanpur", 26.4499, 80.3319),
    ("Nagpur", 21.1458, 79.0882),
    ("Bhopal", 23.2599, 77.4126),
    ("Visakhapatnam", 17.6868, 83.2185),
)
# The other cities as name, latitude, longitude, country, country code.
GLOBAL_CITIES = (
    ("New York City", 40.7128, -74.0060, "United States", "US"),
    ("Los Angeles", 34.0522, -118.2437, "United States", "US"),
    ("Chicago", 41.8781, -87.6298, "United States", "US"),
    ("Houston", 29.7604, -95.3698, "United States", "US"),
    ("San Francisco", 37.7749, -122.4194, "United States", "US"),
    ("London", 51.5074, -0.1278, "United Kingdom", "GB"),
    ("Manchester", 53.4808, -2.2426, "United Kingdom", "GB"),
    ("Birmingham", 52.4862, -1.8904, "United Kingdom", "GB"),
    ("Toronto", 43.6532, -79.3832, "Canada", "CA"),
    ("Vancouver", 49.2827, -123.1207, "Canada", "CA"),
    ("Paris", 48.8566, 2.3522, "France", "FR"),
    ("Berlin", 52.5200, 13.4050, "Germany", "DE"),
    ("Amsterdam", 52.3676, 4.9041, "Netherlands", "NL"),
    ("Dubai", 25.2048, 55.2708, "United Arab Emirates", "AE"),
    ("Singapore", 1.3521, 103.8198, "Singapore", "SG"),
    ("Tokyo", 35.6762, 139.6503, "Japan", "JP"),
    ("Seoul", 37.5665, 126.9780, "South Korea", "KR"),
    ("Sydney", -33.8688, 151.2093, "Australia", "AU"),
    ("Melbourne", -37.8136, 144.9631, "Australia", "AU"),
    ("Lagos", 6.5244, 3.3792, "Nigeria", "NG"),
    ("Cape Town", -33.9249, 18.4241, "South Africa", "ZA"),
)


def city_catalog(spark: SparkSession) -> DataFrame:
    """Union of both lists with slugs; 36 rows, so always fit to broadcast."""
    home = spark.createDataFrame(
        [(*row, "India", "IN") for row in INDIA_CITIES],
        "name string, latitude double, longitude double, country string, country_code string",
    )
    world = spark.createDataFrame(list(GLOBAL_CITIES), home.schema)
    return with_slugs(home.union(world).withColumn("aqi_standard", F.lit("US AQI")))


def with_slugs(cities: DataFrame, name: str = "name") -> DataFrame:
    return cities.withColumn("city_slug", city_slug(name))


def aliases(cities: DataFrame, slug: str = "city_slug", name: str = "name") -> DataFrame:
    """Every token a city may be asked for by: slug, hyphen slug, warehouse slug, lower
    case name.  One row per (alias, city)."""
    return (
        cities.select(
            F.col(slug).alias("city_slug"),
            F.explode(
                F.array_distinct(
                    F.array(
                        F.col(slug), hyphen_alias(slug), warehouse_slug(name), F.lower(F.trim(F.col(name)))
                    )
                )
            ).alias("alias"),
        )
    )
