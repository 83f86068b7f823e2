"""Date properties and methods by name: function(column, *args) -> (Column, kind)."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

L = F.lit
#: Strftime codes and the Java patterns that print the same.
CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "y": "yy",
         "H": "HH", "M": "mm", "S": "ss", "%": "'%'"}


def _long(c):
    return c.cast("long")


def _strftime(c, pattern):
    parts, k = [], 0
    while k < len(pattern):
        if pattern[k] == "%" and k + 1 < len(pattern):
            code = pattern[k + 1]
            if code not in CODES:
                def run(values: pd.Series) -> pd.Series:
                    return values.map(lambda v: None if v is None else v.strftime(pattern))

                return F.pandas_udf(run, "string")(c), str
            parts.append(CODES[code])
            k += 2
        else:
            parts.append("''" if pattern[k] == "'" else f"'{pattern[k]}'")
            k += 1
    return F.date_format(c, "".join(parts)), str


def _replace(c, year=None, month=None, day=None):
    pick = lambda given, own: own if given is None else L(given)
    return F.make_date(pick(year, F.year(c)), pick(month, F.month(c)), pick(day, F.dayofmonth(c))), dt.date


def _ctime(c):
    day = F.lpad(F.dayofmonth(c).cast("string"), 2, " ")
    return F.concat(F.date_format(c, "EEE MMM "), day, F.date_format(c, " '00:00:00' yyyy")), str


def _isocalendar(c):
    return F.array(F.extract(L("YEAROFWEEK"), c).cast("long"), _long(F.weekofyear(c)), _long(F.weekday(c) + 1)), list


def _timetuple(c):
    parts = [F.year(c), F.month(c), F.dayofmonth(c), L(0), L(0), L(0), F.weekday(c), F.dayofyear(c), L(-1)]
    return F.when(c.isNotNull(), F.array(*map(_long, parts))), list


PROPERTIES = {
    "year": lambda c: (_long(F.year(c)), int),
    "month": lambda c: (_long(F.month(c)), int),
    "day": lambda c: (_long(F.dayofmonth(c)), int),
}
METHODS = {
    "ctime": _ctime,
    "isocalendar": lambda c: (F.when(c.isNotNull(), _isocalendar(c)[0]), list),
    "isoformat": lambda c: (F.date_format(c, "yyyy-MM-dd"), str),
    "isoweekday": lambda c: (_long(F.weekday(c) + 1), int),
    "replace": _replace,
    "strftime": _strftime,
    "timetuple": _timetuple,
    "toordinal": lambda c: (_long(F.unix_date(c) + 719163), int),
    "weekday": lambda c: (_long(F.weekday(c)), int),
    "eomonth": lambda c: (F.last_day(c), dt.date),
}
