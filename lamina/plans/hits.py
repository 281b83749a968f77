"""The catalogue over a ``hits`` table that an expression makes from ``events``, for tests against SQL; and that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.plans.catalog import CATALOG, COUNTER, REFERER_HASH, URL_HASH, USER
from lamina.sources import tables

#: Columns that the catalogue reads, as SQL that Spark and DuckDB both take.
COLUMNS = {
    "WatchID": "event_id",
    "Title": "CASE WHEN event_id % 4 = 0 THEN 'Google ' || event_type WHEN event_id % 4 = 1 THEN '' ELSE event_type END",
    "EventTime": "ts",
    "EventDate": "DATE '2013-07-01' + CAST(event_id % 40 AS INT)",
    "CounterID": f"CAST(CASE WHEN event_id % 3 = 0 THEN {COUNTER} ELSE event_id % 11 END AS INT)",
    "ClientIP": "CAST(user_id % 1000 AS INT)",
    "RegionID": "CAST(user_id % 50 AS INT)",
    "UserID": f"CASE WHEN event_id % 997 = 5 THEN CAST({USER} AS BIGINT) ELSE user_id END",
    "URL": "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'http://www.google.com/q' || CAST(user_id % 30 AS STRING) WHEN event_id % 5 = 0 THEN 'https://site' || CAST(user_id % 9 AS STRING) || '.example/google_100%' ELSE 'http://site' || CAST(event_id % 60 AS STRING) || '.example/a/b' END",
    "Referer": "CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'https://www.ref' || CAST(user_id % 8 AS STRING) || '.example/é/' || event_type ELSE 'ref' || CAST(user_id % 5 AS STRING) || '.example' END",
    "IsRefresh": "CAST(CASE WHEN event_id % 10 = 7 THEN 1 ELSE 0 END AS SMALLINT)",
    "ResolutionWidth": "CAST(800 + user_id % 1200 AS SMALLINT)",
    "MobilePhone": "CAST(user_id % 4 AS SMALLINT)",
    "MobilePhoneModel": "CASE WHEN user_id % 3 = 0 THEN '' ELSE 'model ' || CAST(user_id % 12 AS STRING) END",
    "TraficSourceID": "CAST(event_id % 9 - 1 AS SMALLINT)",
    "SearchEngineID": "CAST(event_id % 5 AS SMALLINT)",
    "SearchPhrase": "CASE WHEN event_id % 3 = 1 THEN '' ELSE event_type || ' ' || CAST(user_id % 70 AS STRING) END",
    "AdvEngineID": "CAST(CASE WHEN event_id % 8 < 5 THEN 0 ELSE event_id % 8 END AS SMALLINT)",
    "WindowClientWidth": "CAST(user_id % 37 AS SMALLINT)",
    "WindowClientHeight": "CAST(event_id % 23 AS SMALLINT)",
    "IsLink": "CAST(event_id % 2 AS SMALLINT)",
    "IsDownload": "CAST(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS SMALLINT)",
    "DontCountHits": "CAST(CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS SMALLINT)",
    "RefererHash": f"CASE WHEN event_id % 2 = 0 THEN CAST({REFERER_HASH} AS BIGINT) ELSE event_id END",
    "URLHash": f"CASE WHEN event_id % 3 = 0 AND event_id % 4 > 0 THEN CAST({URL_HASH} AS BIGINT) ELSE event_id % 100 END",
}

JULY = f"CounterID = {COUNTER} AND EventDate >= DATE '2013-07-01' AND EventDate <= DATE '2013-07-31' AND IsRefresh = 0"
CLICKS = "count(*) AS c, CAST(sum(IsRefresh) AS BIGINT) AS s, avg(ResolutionWidth) AS a"

#: Smaller thresholds and offsets than the catalogue's, for a smaller table.
SMALLER = {28: {"least": 100}, 29: {"least": 100}, 39: {"offset": 5}, 41: {"offset": 10}, 42: {"offset": 20}, 43: {"offset": 10}}

SQL = {
    1: "SELECT count(*) AS c FROM hits",
    2: "SELECT count(*) AS c FROM hits WHERE AdvEngineID <> 0",
    3: "SELECT CAST(sum(AdvEngineID) AS BIGINT) AS s, count(*) AS c, avg(ResolutionWidth) AS a FROM hits",
    4: "SELECT avg(UserID) AS a FROM hits",
    5: "SELECT count(DISTINCT UserID) AS u FROM hits",
    6: "SELECT count(DISTINCT SearchPhrase) AS u FROM hits",
    7: "SELECT min(EventDate) AS mn, max(EventDate) AS mx FROM hits",
    8: "SELECT AdvEngineID, count(*) AS c FROM hits WHERE AdvEngineID <> 0 GROUP BY 1 ORDER BY c DESC, 1",
    9: "SELECT RegionID, count(DISTINCT UserID) AS u FROM hits GROUP BY 1 ORDER BY u DESC, 1 LIMIT 10",
    10: "SELECT RegionID, CAST(sum(AdvEngineID) AS BIGINT) AS s, count(*) AS c, avg(ResolutionWidth) AS a, count(DISTINCT UserID) AS u FROM hits GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    11: "SELECT MobilePhoneModel, count(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' GROUP BY 1 ORDER BY u DESC, 1 LIMIT 10",
    12: "SELECT MobilePhone, MobilePhoneModel, count(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' GROUP BY 1, 2 ORDER BY u DESC, 1, 2 LIMIT 10",
    13: "SELECT SearchPhrase, count(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    14: "SELECT SearchPhrase, count(DISTINCT UserID) AS u FROM hits WHERE SearchPhrase <> '' GROUP BY 1 ORDER BY u DESC, 1 LIMIT 10",
    15: "SELECT SearchEngineID, SearchPhrase, count(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10",
    16: "SELECT UserID, count(*) AS c FROM hits GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    17: "SELECT UserID, SearchPhrase, count(*) AS c FROM hits GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10",
    18: "SELECT UserID, SearchPhrase, count(*) AS c FROM hits GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10",
    19: "SELECT UserID, CAST(extract(minute FROM EventTime) AS BIGINT) AS m, SearchPhrase, count(*) AS c FROM hits GROUP BY 1, 2, 3 ORDER BY c DESC, 1, 2, 3 LIMIT 10",
    20: f"SELECT UserID FROM hits WHERE UserID = {USER}",
    21: "SELECT count(*) AS c FROM hits WHERE contains(URL, 'google')",
    22: "SELECT SearchPhrase, min(URL) AS mn, count(*) AS c FROM hits WHERE contains(URL, 'google') AND SearchPhrase <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    23: "SELECT SearchPhrase, min(URL) AS mn, min(Title) AS mt, count(*) AS c, count(DISTINCT UserID) AS u FROM hits WHERE contains(Title, 'Google') AND NOT contains(URL, '.google.') AND SearchPhrase <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    24: "SELECT * FROM hits WHERE contains(URL, 'google') ORDER BY EventTime, WatchID LIMIT 10",
    25: "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime, WatchID LIMIT 10",
    26: "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY SearchPhrase LIMIT 10",
    27: "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime, SearchPhrase LIMIT 10",
    28: "SELECT CounterID, avg(strlen(URL)) AS l, count(*) AS c FROM hits WHERE URL <> '' GROUP BY 1 HAVING count(*) > 100 ORDER BY l DESC, 1 LIMIT 25",
    29: r"SELECT regexp_extract(Referer, '^(?:https?://)?(?:www\.)?([^/]*)', 1) AS h, avg(strlen(Referer)) AS l, count(*) AS c, min(Referer) AS mn FROM hits WHERE Referer <> '' GROUP BY 1 HAVING count(*) > 100 ORDER BY l DESC, 1 LIMIT 25",
    30: "SELECT " + ", ".join(f"CAST(sum(CAST(ResolutionWidth AS BIGINT) + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM hits",
    31: f"SELECT SearchEngineID, ClientIP, {CLICKS} FROM hits WHERE SearchPhrase <> '' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10",
    32: f"SELECT WatchID, ClientIP, {CLICKS} FROM hits WHERE SearchPhrase <> '' GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10",
    33: f"SELECT WatchID, ClientIP, {CLICKS} FROM hits GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10",
    34: "SELECT URL, count(*) AS c FROM hits GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    35: "SELECT URL, count(*) AS c, 1 AS one FROM hits GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    36: "SELECT ClientIP, count(*) AS c, CAST(ClientIP AS BIGINT) - 1 AS less1, CAST(ClientIP AS BIGINT) - 2 AS less2, CAST(ClientIP AS BIGINT) - 3 AS less3 FROM hits GROUP BY ClientIP ORDER BY c DESC, ClientIP LIMIT 10",
    37: f"SELECT URL, count(*) AS c FROM hits WHERE {JULY} AND DontCountHits = 0 AND URL <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    38: f"SELECT Title, count(*) AS c FROM hits WHERE {JULY} AND DontCountHits = 0 AND Title <> '' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
    39: f"SELECT URL, count(*) AS c FROM hits WHERE {JULY} AND IsLink <> 0 AND IsDownload = 0 GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10 OFFSET 5",
    41: f"SELECT URLHash, EventDate, count(*) AS c FROM hits WHERE {JULY} AND (TraficSourceID = -1 OR TraficSourceID = 6) AND RefererHash = {REFERER_HASH} GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10 OFFSET 10",
    42: f"SELECT WindowClientWidth, WindowClientHeight, count(*) AS c FROM hits WHERE {JULY} AND DontCountHits = 0 AND URLHash = {URL_HASH} GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10 OFFSET 20",
    43: f"SELECT date_trunc('minute', EventTime) AS m, count(*) AS c FROM hits WHERE {JULY.replace('07-01', '07-14').replace('07-31', '07-15')} AND DontCountHits = 0 GROUP BY 1 ORDER BY m LIMIT 10 OFFSET 10",
}

WITH = "WITH hits AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + " FROM events) "


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "events").select(*[F.expr(sql).alias(name) for name, sql in COLUMNS.items()])


def _query(k: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: CATALOG[k](hits(spark, sf_dir), **SMALLER.get(k, {}))


QUERIES = {f"hits_q{k:02}": _query(k) for k in CATALOG}
ORACLE = {f"hits_q{k:02}": WITH + SQL[k] for k in CATALOG}
