"""The small tables that operator tests use."""

from datetime import datetime as dt

# The inputs that the known results belong to.
PERSON_SCHEMA = "id int, name string, age int, height int, eyeColor string, countryId int, birthDate string, lastChangedTime timestamp_ntz"
PERSON = [
    (0, "A", 17, 160, "brown", 1, "2010-12-09", dt(2015, 12, 19, 12, 0, 1)),
    (1, "B", 8, 190, None, 1, "2011-02-01", dt(2015, 12, 19, 13, 2, 0)),
    (2, "C", 27, 170, "green", 2, "2014-01-21", dt(2015, 11, 21, 17, 11, 58)),
    (3, "D", 39, 160, "fake", None, "2018.07.11", dt(2017, 8, 1, 4, 9, 1)),
    (4, "E", -3, 160, None, 1, None, dt(2019, 1, 1, 23, 59, 59)),
    (5, "A", 11, 140, None, None, "2013-05-15", dt(2018, 1, 1, 0, 0, 0)),
    (6, "fake", None, 140, None, 5, "2018-01-09", None),
]
COUNTRY = [(1, "Hungary", "HU", "HUN"), (2, "United States of America", "US", "USA"), (3, "Spain", "ES", "ESP"), (4, "Mexico", "MX", "MEX")]
COUNTRY_SCHEMA = "id int, name string, abbreviation2 string, abbreviation3 string"
EYES = [(0, 0, "yellow"), (1, 0, "red"), (2, 0, "green"), (3, 1, "blue"), (4, 1, "yellow"), (5, 2, "black"), (6, 100, "fake")]
EYES_SCHEMA = "id int, personId int, color string"
ROLES = [(0, "A", "AAA", None, None), (1, "B", None, "BBB", None), (2, "C", None, None, "CCC"), (3, "D", None, None, "DDD"), (4, "E", None, "EEE", None), (5, "F", None, "FFF", None)]
ROLES_SCHEMA = "id int, code string, level1 string, level2 string, level3 string"
ASSETS = [(1, "A", 1, 1, 2), (None, "C", 2, 1, 3), (3, "D", None, 1, 3), (4, "E", 6, 1, 3)]
ASSETS_SCHEMA = "id int, personName string, cars int, houses int, kids int"


def person(spark):
    return spark.createDataFrame(PERSON, PERSON_SCHEMA)


def country(spark):
    return spark.createDataFrame(COUNTRY, COUNTRY_SCHEMA)


def eyes(spark):
    return spark.createDataFrame(EYES, EYES_SCHEMA)
