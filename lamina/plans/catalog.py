"""The catalogue of 42 queries over the web-analytics table ``hits``. Number 40 is not defined.

Each takes the table and returns a DataFrame; every ranked query ends in the group's keys, so ties have one order.
Thresholds, page offsets and the constants looked for are parameters with the catalogue's values as defaults.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.aggregates import avg, count, count_distinct, exact_avg, max_, min_, sum_
from lamina.functions.predicates import all_of, any_of, contains, eq, ge, gt, le, ne, not_
from lamina.functions.scalars import byte_len, minute_of, plus, trunc_minute, url_host
from lamina.operators import aggregate, group_by, order, page, project, top_k, where

# What the catalogue looks for.
COUNTER, USER = 62, 435090932899640449
REFERER_HASH, URL_HASH = 3594120000172545465, 2868770270353813622
JULY = (dt.date(2013, 7, 1), dt.date(2013, 7, 31))
MID_JULY = (dt.date(2013, 7, 14), dt.date(2013, 7, 15))


def _some(rows: DataFrame, column: str) -> DataFrame:
    return where(rows, ne(column, ""))


def _top(rows: DataFrame, keys: list[str], by: str = "c", k: int = 10, **aggregates) -> DataFrame:
    return top_k(group_by(rows, keys, **aggregates), k, by, then=tuple(keys))


def _visits(rows: DataFrame, days: tuple[dt.date, dt.date], *more) -> DataFrame:
    """One counter's rows of some days that are no reloads."""
    return where(rows, all_of(eq("CounterID", COUNTER), ge("EventDate", F.lit(days[0])), le("EventDate", F.lit(days[1])), eq("IsRefresh", 0), *more))


def q1(hits: DataFrame) -> DataFrame:
    return aggregate(hits, c=count())


def q2(hits: DataFrame) -> DataFrame:
    return aggregate(where(hits, ne("AdvEngineID", 0)), c=count())


def q3(hits: DataFrame) -> DataFrame:
    return aggregate(hits, s=sum_("AdvEngineID"), c=count(), a=avg("ResolutionWidth"))


def q4(hits: DataFrame) -> DataFrame:
    return aggregate(hits, a=exact_avg("UserID"))


def q5(hits: DataFrame) -> DataFrame:
    return aggregate(hits, u=count_distinct("UserID"))


def q6(hits: DataFrame) -> DataFrame:
    return aggregate(hits, u=count_distinct("SearchPhrase"))


def q7(hits: DataFrame) -> DataFrame:
    return aggregate(hits, mn=min_("EventDate"), mx=max_("EventDate"))


def q8(hits: DataFrame) -> DataFrame:
    return order(group_by(where(hits, ne("AdvEngineID", 0)), ["AdvEngineID"], c=count()), "c", desc=True, then=("AdvEngineID",))


def q9(hits: DataFrame) -> DataFrame:
    return _top(hits, ["RegionID"], "u", u=count_distinct("UserID"))


def q10(hits: DataFrame) -> DataFrame:
    return _top(hits, ["RegionID"], s=sum_("AdvEngineID"), c=count(), a=avg("ResolutionWidth"), u=count_distinct("UserID"))


def q11(hits: DataFrame) -> DataFrame:
    return _top(_some(hits, "MobilePhoneModel"), ["MobilePhoneModel"], "u", u=count_distinct("UserID"))


def q12(hits: DataFrame) -> DataFrame:
    return _top(_some(hits, "MobilePhoneModel"), ["MobilePhone", "MobilePhoneModel"], "u", u=count_distinct("UserID"))


def q13(hits: DataFrame) -> DataFrame:
    return _top(_some(hits, "SearchPhrase"), ["SearchPhrase"], c=count())


def q14(hits: DataFrame) -> DataFrame:
    return _top(_some(hits, "SearchPhrase"), ["SearchPhrase"], "u", u=count_distinct("UserID"))


def q15(hits: DataFrame) -> DataFrame:
    return _top(_some(hits, "SearchPhrase"), ["SearchEngineID", "SearchPhrase"], c=count())


def q16(hits: DataFrame) -> DataFrame:
    return _top(hits, ["UserID"], c=count())


def q17(hits: DataFrame) -> DataFrame:
    return _top(hits, ["UserID", "SearchPhrase"], c=count())


def q18(hits: DataFrame) -> DataFrame:
    """Any ten groups will do; these are the first by key."""
    return top_k(group_by(hits, ["UserID", "SearchPhrase"], c=count()), 10, "UserID", "SearchPhrase", desc=False)


def q19(hits: DataFrame) -> DataFrame:
    groups = group_by(hits, {"UserID": "UserID", "m": minute_of("EventTime"), "SearchPhrase": "SearchPhrase"}, c=count())
    return top_k(groups, 10, "c", then=("UserID", "m", "SearchPhrase"))


def q20(hits: DataFrame, user: int = USER) -> DataFrame:
    return project(where(hits, eq("UserID", user)), "UserID")


def q21(hits: DataFrame) -> DataFrame:
    return aggregate(where(hits, contains("URL", "google")), c=count())


def q22(hits: DataFrame) -> DataFrame:
    return _top(where(hits, all_of(contains("URL", "google"), ne("SearchPhrase", ""))), ["SearchPhrase"], mn=min_("URL"), c=count())


def q23(hits: DataFrame) -> DataFrame:
    found = where(hits, all_of(contains("Title", "Google"), not_(contains("URL", ".google.")), ne("SearchPhrase", "")))
    return _top(found, ["SearchPhrase"], mn=min_("URL"), mt=min_("Title"), c=count(), u=count_distinct("UserID"))


def q24(hits: DataFrame) -> DataFrame:
    return top_k(where(hits, contains("URL", "google")), 10, "EventTime", desc=False, then=("WatchID",))


def q25(hits: DataFrame) -> DataFrame:
    return project(top_k(_some(hits, "SearchPhrase"), 10, "EventTime", desc=False, then=("WatchID",)), "SearchPhrase")


def q26(hits: DataFrame) -> DataFrame:
    return project(top_k(_some(hits, "SearchPhrase"), 10, "SearchPhrase", desc=False), "SearchPhrase")


def q27(hits: DataFrame) -> DataFrame:
    return project(top_k(_some(hits, "SearchPhrase"), 10, "EventTime", "SearchPhrase", desc=False), "SearchPhrase")


def q28(hits: DataFrame, least: int = 100_000) -> DataFrame:
    groups = group_by(_some(hits, "URL"), ["CounterID"], l=avg(byte_len("URL")), c=count())
    return top_k(where(groups, gt("c", least)), 25, "l", then=("CounterID",))


def q29(hits: DataFrame, least: int = 100_000) -> DataFrame:
    groups = group_by(_some(hits, "Referer"), {"h": url_host("Referer")}, l=avg(byte_len("Referer")), c=count(), mn=min_("Referer"))
    return top_k(where(groups, gt("c", least)), 25, "l", then=("h",))


def q30(hits: DataFrame) -> DataFrame:
    return aggregate(hits, **{f"s{k}": sum_(plus("ResolutionWidth", k)) for k in range(90)})


def _clicks(rows: DataFrame, key: str) -> DataFrame:
    return _top(rows, [key, "ClientIP"], c=count(), s=sum_("IsRefresh"), a=avg("ResolutionWidth"))


def q31(hits: DataFrame) -> DataFrame:
    return _clicks(_some(hits, "SearchPhrase"), "SearchEngineID")


def q32(hits: DataFrame) -> DataFrame:
    return _clicks(_some(hits, "SearchPhrase"), "WatchID")


def q33(hits: DataFrame) -> DataFrame:
    return _clicks(hits, "WatchID")


def q34(hits: DataFrame) -> DataFrame:
    return _top(hits, ["URL"], c=count())


def q35(hits: DataFrame) -> DataFrame:
    return project(q34(hits), "URL", "c", one=F.lit(1))


def q36(hits: DataFrame) -> DataFrame:
    return project(_top(hits, ["ClientIP"], c=count()), "ClientIP", "c", **{f"less{k}": plus("ClientIP", -k) for k in (1, 2, 3)})


def q37(hits: DataFrame) -> DataFrame:
    return _top(_visits(hits, JULY, eq("DontCountHits", 0), ne("URL", "")), ["URL"], c=count())


def q38(hits: DataFrame) -> DataFrame:
    return _top(_visits(hits, JULY, eq("DontCountHits", 0), ne("Title", "")), ["Title"], c=count())


def q39(hits: DataFrame, offset: int = 1000) -> DataFrame:
    groups = group_by(_visits(hits, JULY, ne("IsLink", 0), eq("IsDownload", 0)), ["URL"], c=count())
    return page(groups, offset, 10, "c", then=("URL",))


def q41(hits: DataFrame, offset: int = 100, referer: int = REFERER_HASH) -> DataFrame:
    rows = _visits(hits, JULY, any_of(eq("TraficSourceID", -1), eq("TraficSourceID", 6)), eq("RefererHash", referer))
    return page(group_by(rows, ["URLHash", "EventDate"], c=count()), offset, 10, "c", then=("URLHash", "EventDate"))


def q42(hits: DataFrame, offset: int = 10_000, url: int = URL_HASH) -> DataFrame:
    rows = _visits(hits, JULY, eq("DontCountHits", 0), eq("URLHash", url))
    return page(group_by(rows, ["WindowClientWidth", "WindowClientHeight"], c=count()), offset, 10, "c", then=("WindowClientWidth", "WindowClientHeight"))


def q43(hits: DataFrame, offset: int = 1000) -> DataFrame:
    rows = _visits(hits, MID_JULY, eq("DontCountHits", 0))
    return page(group_by(rows, {"m": trunc_minute("EventTime")}, c=count()), offset, 10, "m", desc=False)


CATALOG = {k: f for k in range(1, 44) if (f := globals().get(f"q{k}"))}
