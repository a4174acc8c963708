"""Seed dimensions and the fixed values used to resolve countries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import schemas

# Country name given to clubs and competitions without a usable one.
OTHER_COUNTRY = "Other"

# Clubs that play in another country's league system.
CLUB_COUNTRY_OVERRIDES = {
    "Swansea City": "England",
    "Cardiff City": "England",
    "Newport County": "England",
    "Wrexham": "England",
    "AS Monaco": "France",
    "FC Vaduz": "Switzerland",
}

# Country names of the raw data that differ from the stored ones.
# The United Kingdom is ambiguous here and goes to the catch-all country.
COUNTRY_ALIASES = {
    "United Kingdom": OTHER_COUNTRY,
    "Korea, South": "South Korea",
    "Côte d'Ivoire": "Ivory Coast",
    "Cote d'Ivoire": "Ivory Coast",
}

# Seeded countries (id, name, ISO code, latitude, longitude, in scope).
SEED_COUNTRIES = [
    (1, "England", "ENG", 52.3555, -1.1743, True),
    (2, "Scotland", "SCO", 56.4907, -4.2026, True),
    (3, "Spain", "ESP", 40.4637, -3.7492, True),
    (4, "Germany", "DEU", 51.1657, 10.4515, True),
    (5, "Italy", "ITA", 41.8719, 12.5674, True),
    (6, "France", "FRA", 46.2276, 2.2137, True),
    (7, "Portugal", "PRT", 39.3999, -8.2245, True),
    (8, "Netherlands", "NLD", 52.1326, 5.2913, True),
    (9, "Belgium", "BEL", 50.5039, 4.4699, True),
    (10, "Turkey", "TUR", 38.9637, 35.2433, True),
    (11, "Argentina", "ARG", -38.4161, -63.6167, True),
    (12, "Brazil", "BRA", -14.2350, -51.9253, True),
    (13, "Other", "OTH", 0.0, 0.0, False),
]

# Seeded leagues (id, name, country id, tier).
SEED_LEAGUES = [
    (1, "Premier League", 1, 1),
    (2, "Championship", 1, 2),
    (3, "La Liga", 3, 1),
    (4, "Segunda División", 3, 2),
    (5, "Bundesliga", 4, 1),
    (6, "2. Bundesliga", 4, 2),
    (7, "Serie A", 5, 1),
    (8, "Ligue 1", 6, 1),
    (9, "Primeira Liga", 7, 1),
    (10, "Eredivisie", 8, 1),
    (11, "Pro League", 9, 1),
    (12, "Süper Lig", 10, 1),
    (13, "Premiership", 2, 1),
    (14, "Primera División", 11, 1),
    (15, "Série A", 12, 1),
]


def seed_countries(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        SEED_COUNTRIES,
        "id int, name string, iso_code string, latitude double, longitude double, in_scope boolean",
    )
    return schemas.conform(rows, schemas.COUNTRIES)


def seed_leagues(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SEED_LEAGUES, "id int, name string, country_id int, tier int")
    return schemas.conform(
        rows.withColumn("transfermarkt_id", F.lit(None).cast("string")), schemas.LEAGUES
    )
