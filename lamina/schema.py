"""Column types and schemas. There are seven types; a table's columns are never null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "String": T.StringType(),
    "Double": T.DoubleType(),
    "Date": T.DateType(),
    "Timestamp": T.TimestampNTZType(),
}


def schema(columns: Iterable[tuple[str, str]]) -> T.StructType:
    """A schema from (name, type) pairs. Repeated names and unknown types raise ValueError."""
    pairs = list(columns)
    names = [n for n, _ in pairs]
    if repeated := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"repeated column names: {sorted(repeated)}")
    if unknown := {t for _, t in pairs} - TYPES.keys():
        raise ValueError(f"unknown types: {sorted(unknown)}")
    return T.StructType([T.StructField(n, TYPES[t], nullable=False) for n, t in pairs])


def bind(names: list[str], types: list[str]) -> T.StructType:
    """A schema from a header's names and as many types."""
    if len(names) != len(types):
        raise ValueError(f"{len(names)} columns, {len(types)} types")
    return schema(zip(names, types, strict=True))


def tags(kind: T.StructType) -> list[tuple[str, str]]:
    """(name, type) pairs of a schema: the inverse of :func:`schema`. Types beyond the seven have Spark's names."""
    back = {v: k for k, v in TYPES.items()}
    return [(f.name, back.get(f.dataType, f.dataType.simpleString())) for f in kind.fields]


# Names and types of the web-analytics table, in the order of its file, which has no header.
HITS_COLUMNS: list[tuple[str, str]] = [
    ("WatchID", "Int64"),
    ("JavaEnable", "Int16"),
    ("Title", "String"),
    ("GoodEvent", "Int16"),
    ("EventTime", "Timestamp"),
    ("EventDate", "Date"),
    ("CounterID", "Int32"),
    ("ClientIP", "Int32"),
    ("RegionID", "Int32"),
    ("UserID", "Int64"),
    ("CounterClass", "Int16"),
    ("OS", "Int16"),
    ("UserAgent", "Int16"),
    ("URL", "String"),
    ("Referer", "String"),
    ("IsRefresh", "Int16"),
    ("RefererCategoryID", "Int16"),
    ("RefererRegionID", "Int32"),
    ("URLCategoryID", "Int16"),
    ("URLRegionID", "Int32"),
    ("ResolutionWidth", "Int16"),
    ("ResolutionHeight", "Int16"),
    ("ResolutionDepth", "Int16"),
    ("FlashMajor", "Int16"),
    ("FlashMinor", "Int16"),
    ("FlashMinor2", "String"),
    ("NetMajor", "Int16"),
    ("NetMinor", "Int16"),
    ("UserAgentMajor", "Int16"),
    ("UserAgentMinor", "String"),
    ("CookieEnable", "Int16"),
    ("JavascriptEnable", "Int16"),
    ("IsMobile", "Int16"),
    ("MobilePhone", "Int16"),
    ("MobilePhoneModel", "String"),
    ("Params", "String"),
    ("IPNetworkID", "Int32"),
    ("TraficSourceID", "Int16"),
    ("SearchEngineID", "Int16"),
    ("SearchPhrase", "String"),
    ("AdvEngineID", "Int16"),
    ("IsArtifical", "Int16"),
    ("WindowClientWidth", "Int16"),
    ("WindowClientHeight", "Int16"),
    ("ClientTimeZone", "Int16"),
    ("ClientEventTime", "Timestamp"),
    ("SilverlightVersion1", "Int16"),
    ("SilverlightVersion2", "Int16"),
    ("SilverlightVersion3", "Int32"),
    ("SilverlightVersion4", "Int16"),
    ("PageCharset", "String"),
    ("CodeVersion", "Int32"),
    ("IsLink", "Int16"),
    ("IsDownload", "Int16"),
    ("IsNotBounce", "Int16"),
    ("FUniqID", "Int64"),
    ("OriginalURL", "String"),
    ("HID", "Int32"),
    ("IsOldCounter", "Int16"),
    ("IsEvent", "Int16"),
    ("IsParameter", "Int16"),
    ("DontCountHits", "Int16"),
    ("WithHash", "Int16"),
    ("HitColor", "String"),
    ("LocalEventTime", "Timestamp"),
    ("Age", "Int16"),
    ("Sex", "Int16"),
    ("Income", "Int16"),
    ("Interests", "Int16"),
    ("Robotness", "Int16"),
    ("RemoteIP", "Int32"),
    ("WindowName", "Int32"),
    ("OpenerName", "Int32"),
    ("HistoryLength", "Int16"),
    ("BrowserLanguage", "String"),
    ("BrowserCountry", "String"),
    ("SocialNetwork", "String"),
    ("SocialAction", "String"),
    ("HTTPError", "Int16"),
    ("SendTiming", "Int32"),
    ("DNSTiming", "Int32"),
    ("ConnectTiming", "Int32"),
    ("ResponseStartTiming", "Int32"),
    ("ResponseEndTiming", "Int32"),
    ("FetchTiming", "Int32"),
    ("SocialSourceNetworkID", "Int16"),
    ("SocialSourcePage", "String"),
    ("ParamPrice", "Int64"),
    ("ParamOrderID", "String"),
    ("ParamCurrency", "String"),
    ("ParamCurrencyID", "Int16"),
    ("OpenstatServiceName", "String"),
    ("OpenstatCampaignID", "String"),
    ("OpenstatAdID", "String"),
    ("OpenstatSourceID", "String"),
    ("UTMSource", "String"),
    ("UTMMedium", "String"),
    ("UTMCampaign", "String"),
    ("UTMContent", "String"),
    ("UTMTerm", "String"),
    ("FromTag", "String"),
    ("HasGCLID", "Int16"),
    ("RefererHash", "Int64"),
    ("URLHash", "Int64"),
    ("CLID", "Int32"),
]

HITS = schema(HITS_COLUMNS)
