"""Date and time functions. Values are real dates and timestamps (UTC); text is made only where a function's result is text."""

from __future__ import annotations

import re

from . import builtin, define

#: Fixed value: the day number of 1970-01-01 in TO_DAYS.
EPOCH_DAYS = 2440588

#: Date format codes and Spark's patterns for them.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "j": "DDD", "H": "HH", "k": "H",
    "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "p": "a", "f": "SSSSSS", "W": "EEEE", "a": "EEE", "r": "hh:mm:ss a", "T": "HH:mm:ss",
}

#: GET_FORMAT.
FORMATS = {
    "date": {"usa": "%m.%d.%Y", "jis": "%Y-%m-%d", "iso": "%Y-%m-%d", "eur": "%d.%m.%Y", "internal": "%Y%m%d"},
    "datetime": {"usa": "%Y-%m-%d %H.%i.%s", "jis": "%Y-%m-%d %H:%i:%s", "iso": "%Y-%m-%d %H:%i:%s", "eur": "%Y-%m-%d %H.%i.%s", "internal": "%Y%m%d%H%i%s"},
    "time": {"usa": "%h:%i:%s %p", "jis": "%H:%i:%s", "iso": "%H:%i:%s", "eur": "%H.%i.%s", "internal": "%H%i%s"},
}
FORMATS["timestamp"] = FORMATS["datetime"]

builtin("last_day")


def ts(x):
    return f"try_cast({x} as timestamp)"


def day(x):
    return f"try_cast({x} as date)"


def text(literal):
    """The value of a plain string literal, or None."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", literal.strip())
    return re.sub(r"\\(.)", r"\1", m[1]) if m else None


def moment(x):
    """A literal date as DATE, another literal as TIMESTAMP, anything else as it is."""
    value = text(x)
    if value is None:
        return x
    return day(x) if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", value) else ts(x)


for _name, _fn in {"year": "year", "month": "month", "day": "dayofmonth", "dayofmonth": "dayofmonth", "dayofweek": "dayofweek", "dayofyear": "dayofyear", "weekday": "weekday", "quarter": "quarter", "weekofyear": "weekofyear"}.items():
    define(_name)(lambda x, f=_fn: f"{f}({day(x)})")


def seconds_of(x):
    """Seconds of a time text ([-]H:MM[:SS], hours beyond 24 too) or of a moment's time of day."""
    t = f"cast({x} as string)"
    part = lambda i: f"cast(split(regexp_extract({t}, '([0-9]+:[0-9]+(:[0-9]+)?)', 1), ':')[{i}] as bigint)"
    return f"if({t} rlike '[0-9]:[0-9]', if({t} like '-%', -1, 1) * ({part(0)} * 3600 + {part(1)} * 60 + coalesce(try_element_at(transform(split(regexp_extract({t}, '([0-9]+:[0-9]+(:[0-9]+)?)', 1), ':'), p -> try_cast(p as bigint)), 3), 0)), if({ts(x)} is null, null, 0))"


def clock(seconds):
    """'[-]HH:MM:SS' of a number of seconds."""
    a = f"abs({seconds})"
    return f"if({seconds} is null, null, concat(if({seconds} < 0, '-', ''), lpad(cast({a} div 3600 as string), greatest(2, length(cast({a} div 3600 as string))), '0'), ':', lpad(cast(({a} div 60) % 60 as string), 2, '0'), ':', lpad(cast({a} % 60 as string), 2, '0')))"


@define("to_days")
def to_days(d):
    return f"(unix_date({day(d)}) + {EPOCH_DAYS})"


@define("to_seconds")
def to_seconds(d):
    return f"(unix_seconds({ts(d)}) + {EPOCH_DAYS} * 86400L)"


@define("from_days")
def from_days(n):
    return f"date_from_unix_date(cast({n} - {EPOCH_DAYS} as int))"


@define("datediff")
def datediff(a, b):
    return f"datediff({day(a)}, {day(b)})"


@define("timediff")
def timediff(a, b):
    far = lambda x: f"if(cast({x} as string) rlike '^[0-9]{{4}}-', unix_seconds({ts(x)}), {seconds_of(x)})"
    return clock(f"({far(a)} - {far(b)})")


def _shifted(a, t, sign):
    moved = f"cast({ts(a)} {sign} make_dt_interval(0, 0, 0, {seconds_of(t)}) as string)"
    return f"if(cast({a} as string) rlike '^[0-9]{{4}}-', {moved}, {clock(f'({seconds_of(a)} {sign} {seconds_of(t)})')})"


@define("addtime")
def addtime(a, t):
    return _shifted(a, t, "+")


@define("subtime")
def subtime(a, t):
    return _shifted(a, t, "-")


@define("timestampdiff")
def timestampdiff(unit, a, b):
    unit = unit.strip("'").replace("sql_tsi_", "").replace("frac_second", "second")
    return f"timestampdiff({unit.upper()}, {ts(a)}, {ts(b)})"


@define("timestampadd")
def timestampadd(unit, n, x):
    return shifted(moment(x), n, unit.strip("'").replace("sql_tsi_", ""), 1)


#: The fields of compound units, largest first.
COMPOUND = {
    "year_month": ("year", "month"), "day_hour": ("day", "hour"), "day_minute": ("day", "hour", "minute"), "day_second": ("day", "hour", "minute", "second"), "hour_minute": ("hour", "minute"), "hour_second": ("hour", "minute", "second"), "minute_second": ("minute", "second"),
    "second_microsecond": ("second", "microsecond"), "minute_microsecond": ("minute", "second", "microsecond"), "hour_microsecond": ("hour", "minute", "second", "microsecond"), "day_microsecond": ("day", "hour", "minute", "second", "microsecond"),
}


def made_interval(n, unit, sign):
    """make_interval() of a number (or, for compound units, a literal) of units."""
    parts = {k: "0" for k in ("year", "month", "week", "day", "hour", "minute", "second")}
    if unit in COMPOUND:
        value = text(n) if text(n) is not None else n
        found = re.findall(r"\d+", value)
        names = COMPOUND[unit][-len(found) :] if found else ()
        minus = -sign if value.strip().startswith("-") else sign
        for name, v in zip(names, found[-len(names) :] if names else ()):
            if name == "microsecond":
                parts["second"] = f"{parts['second']} + {minus} * {int(v.ljust(6, '0')[:6])} / 1000000"
            else:
                parts[name] = f"{minus} * {v}"
    elif unit == "quarter":
        parts["month"] = f"cast({sign} * 3 * ({n}) as int)"
    elif unit == "microsecond":
        parts["second"] = f"cast({sign} * ({n}) as decimal(18, 0)) / 1000000"
    elif unit == "second":
        parts["second"] = f"{sign} * ({n})"
    else:
        parts[unit] = f"cast({sign} * ({n}) as int)"
    year, month, week, d, hour, minute, second = parts.values()
    return f"make_interval({year}, {month}, {week}, {d}, {hour}, {minute}, cast({second} as decimal(18, 6)))"


def shifted(x, n, unit, sign):
    timed = any(u in unit for u in ("hour", "minute", "second"))
    subject = f"cast({x} as timestamp)" if timed else x
    return f"({subject} + {made_interval(n, unit, sign)})"


def _added(sign):
    def run(d, interval):
        if interval.startswith("INTERVAL|"):
            _, n, unit = interval.split("|")
        else:
            n, unit = interval, "day"
        return shifted(moment(d), n, unit, sign)

    return run


define("date_add", "adddate")(_added(1))
define("date_sub", "subdate")(_added(-1))


def week_number(d, mode, year_too=False):
    """WEEK(d, mode). A week belongs to the year of its anchor: its first day (modes 0, 2, 5, 7: week 1 is the first that begins in the year) or its fourth (1, 3, 4, 6: it has four days or more in the year). Weeks run from Monday in odd modes. Modes with 0 give 0 before the year's first week, and count on after its last; the others name the year's last or first week of the neighbour."""
    x = day(d)
    start = f"date_sub({x}, {'weekday' if mode % 2 else 'dayofweek'}({x}){'' if mode % 2 else ' - 1'})"
    anchor = start if mode in (0, 2, 5, 7) else f"date_add({start}, 3)"
    number = f"((dayofyear({anchor}) - 1) div 7 + 1)"
    if year_too:
        return f"(year({anchor}) * 100 + {number})"
    if mode in (2, 3, 6, 7):
        return f"cast({number} as int)"
    return f"cast(case when year({anchor}) < year({x}) then 0 when year({anchor}) > year({x}) then (dayofyear(date_sub({anchor}, 7)) - 1) div 7 + 2 else {number} end as int)"


@define("week")
def week(d, mode="0"):
    return week_number(d, int(mode) % 8)


@define("yearweek")
def yearweek(d, mode="0"):
    """The modes that name a year: 2 for 0, 3 for 1, 6 for 4, 7 for 5."""
    m = int(mode) % 8
    return week_number(d, m | 2, True)


def pieces(fmt):
    """A format text as pairs (is code, text)."""
    return [(True, m[1]) if m[1] else (False, m[2]) for m in re.finditer(r"%(.)|([^%]+|%$)", fmt, re.S)]


def formatted(x, fmt):
    value = text(fmt)
    if value is None:
        raise ValueError("a date format has to be a literal")
    special = {
        "D": f"concat(cast(dayofmonth({x}) as string), case when dayofmonth({x}) between 11 and 13 then 'th' when dayofmonth({x}) % 10 = 1 then 'st' when dayofmonth({x}) % 10 = 2 then 'nd' when dayofmonth({x}) % 10 = 3 then 'rd' else 'th' end)",
        "w": f"cast(dayofweek({x}) - 1 as string)",
        "X": f"lpad(cast({week_number(x, 2, True)} div 100 as string), 4, '0')",
        "x": f"lpad(cast({week_number(x, 3, True)} div 100 as string), 4, '0')",
        **{c: f"lpad(cast({week_number(x, m)} as string), 2, '0')" for c, m in (("U", 0), ("u", 1), ("V", 2), ("v", 3))},
    }
    out = []
    for code, part in pieces(value):
        if code and part in CODES:
            out.append(f"date_format({x}, '{CODES[part]}')")
        elif code and part in special:
            out.append(special[part])
        else:
            plain = (part if part == "%" else "%" + part if code and part.isalpha() else part).replace("\\", "\\\\").replace("'", "\\'")
            out.append(f"'{plain}'")
    return f"concat({', '.join(out)})" if out else f"if({x} is null, null, '')"


@define("date_format")
def date_format(d, fmt):
    return formatted(ts(d), fmt)


@define("time_format")
def time_format(t, fmt):
    return formatted(f"timestamp_seconds(pmod({seconds_of(t)}, 86400))", fmt)


@define("str_to_date")
def str_to_date(s, fmt):
    """A date, a time text or a timestamp by the parts that the format names."""
    value = text(fmt)
    if value is None:
        raise ValueError("a date format has to be a literal")
    pattern, codes = "", []
    loose = {"Y": "yyyy", "m": "M", "d": "d", "e": "d", "H": "H", "k": "H", "h": "h", "I": "h", "i": "m", "s": "s", "S": "s"}
    for code, part in pieces(value):
        if code and part in CODES:
            pattern += loose.get(part, CODES[part])
            codes.append(part)
        else:
            pattern += "".join("''" if c == "'" else f"'{c}'" if c.isalpha() else c for c in part)
    parsed = f"try_to_timestamp({s}, '" + pattern.replace("'", "\\'") + "')"
    has_date, has_time = any(c in "YymcMbdej" for c in codes), any(c in "HkhIlisSfprT" for c in codes)
    return parsed if has_date and has_time else f"date_format({parsed}, 'HH:mm:ss')" if has_time else f"cast({parsed} as date)"


@define("get_format")
def get_format(kind, standard):
    value = FORMATS.get((text(kind) or "").lower(), {}).get((text(standard) or "").lower())
    return "NULL" if value is None else f"'{value}'"


@define("from_unixtime")
def from_unixtime(n, fmt=None):
    at = f"timestamp_seconds({n})"
    return formatted(at, fmt) if fmt else f"date_format({at}, 'yyyy-MM-dd HH:mm:ss')"


@define("unix_timestamp")
def unix_timestamp(d=None):
    return f"unix_seconds({ts(d)})" if d else "unix_seconds(current_timestamp())"


@define("convert_tz")
def convert_tz(d, a, b):
    """Offsets, UTC, GMT and SYSTEM (UTC); other names give null."""
    zone = lambda z: f"case when upper({z}) in ('UTC', 'GMT', 'SYSTEM') then 'UTC' when {z} rlike '^[+-][0-9]{{2}}:[0-9]{{2}}$' then {z} end"
    return f"convert_timezone({zone(a)}, {zone(b)}, try_cast({d} as timestamp_ntz))"


@define("hour")
def hour(t):
    return f"cast({seconds_of(t)} div 3600 as int)"


@define("minute")
def minute(t):
    return f"cast(abs({seconds_of(t)}) div 60 % 60 as int)"


@define("second")
def second(t):
    return f"cast(abs({seconds_of(t)}) % 60 as int)"


@define("microsecond")
def microsecond(t):
    return f"cast(unix_micros({ts(t)}) % 1000000 as int)"


@define("dayname")
def dayname(d):
    return f"date_format({day(d)}, 'EEEE')"


@define("monthname")
def monthname(d):
    return f"date_format({day(d)}, 'MMMM')"


@define("extract")
def extract(unit, d):
    """Simple and compound fields; WEEK is WEEK(d, 0)."""
    unit = unit.lower()
    if unit in COMPOUND:
        x = ts(d)
        width = {"month": 100, "hour": 100, "minute": 100, "second": 100, "microsecond": 1_000_000}
        out = ""
        for f in COMPOUND[unit]:
            value = f"cast(unix_micros({x}) % 1000000 as bigint)" if f == "microsecond" else f"cast(extract({f} from {x}) as bigint)"
            out = value if not out else f"({out} * {width[f]} + {value})"
        return out
    if unit == "week":
        return week_number(d, 0)
    if unit == "microsecond":
        return microsecond(d)
    if unit == "second":
        return second(d)
    return f"cast(extract({unit} from {ts(d)}) as int)"


@define("makedate")
def makedate(y, n):
    return f"if({n} < 1, null, date_add(make_date({y}, 1, 1), cast({n} as int) - 1))"


@define("maketime")
def maketime(h, m, s):
    return f"format_string('%02d:%02d:%02d', cast({h} as bigint), cast({m} as bigint), cast({s} as bigint))"


@define("sec_to_time")
def sec_to_time(n):
    return clock(f"cast({n} as bigint)")


@define("time_to_sec")
def time_to_sec(t):
    return seconds_of(t)


def _months(p):
    return f"(cast({p} as bigint) div 100 * 12 + cast({p} as bigint) % 100 - 1)"


@define("period_add")
def period_add(p, n):
    at = f"({_months(p)} + {n})"
    return f"({at} div 12 * 100 + {at} % 12 + 1)"


@define("period_diff")
def period_diff(a, b):
    return f"({_months(a)} - {_months(b)})"


@define("date")
def date(x):
    return day(x)


@define("time")
def time(x):
    return f"date_format({ts(x)}, 'HH:mm:ss')"


for _name in ("curdate", "current_date", "utc_date"):
    define(_name)(lambda: "current_date()")
for _name in ("now", "current_timestamp", "sysdate", "localtime", "localtimestamp", "utc_timestamp"):
    define(_name)(lambda precision=None: "current_timestamp()")
for _name in ("curtime", "current_time", "utc_time"):
    define(_name)(lambda precision=None: "date_format(current_timestamp(), 'HH:mm:ss')")
