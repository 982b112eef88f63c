"""Scalar column functions: parsing, names, status and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import CFB_ALIASES, NFL_CODES, NFL_TEAMS, PARTICLES


def parse_price(c: Column) -> Column:
    """Text as a double; empty or unparsable text is null. A trailing type letter isn't a number."""
    return F.when(~c.rlike("[0-9.][dDfF]$"), c.try_cast("double"))


def parse_ts(c: Column) -> Column:
    """ISO text as a timestamp; text without an offset is UTC, whatever the session's zone; bad text is null."""
    plain = (F.length(c) == 20) & F.endswith(c, F.lit("Z")) & (F.substring(c, 11, 1) == "T") & F.substring(c, 12, 1).between("0", "9")  # the usual form needs no pattern
    day, zoned = c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), c.rlike(r"[T ]\d.*([A-Za-z]|[+-]\d\d?(:?\d\d)?)\s*$")
    return F.try_to_timestamp(F.nullif(F.when(plain, c).when(day, F.concat(F.trim(c), F.lit("T00:00:00Z"))).when(zoned, c).otherwise(F.concat(F.rtrim(c), F.lit("Z"))), F.lit("Z")))


def _utc(ts: Column) -> Column:
    """A timestamp's date and time in UTC to the second, whatever the session's zone: 2024-01-01 10:00:00. ts is used once, as Spark would
    compute it again for each use."""
    return F.timestamp_add("SECOND", F.unix_seconds(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string")


def iso_utc(ts: Column) -> Column:
    return F.concat(F.replace(_utc(ts), F.lit(" "), F.lit("T")), F.lit("Z"))


def parse_game_date(c: Column) -> Column:
    """The first ten characters as an ISO date, else null."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def local_date(c: Column) -> Column:
    """The date in the text's own offset, where the text is a timestamp."""
    return F.when(parse_ts(c).isNotNull(), parse_game_date(c))


def json_array(c: Column) -> Column:
    """A JSON array (also one encoded as a string) as an array of strings; anything else is null. Plain strings, with nothing escaped, lie
    between every other pair of quotes and need no parser."""
    plain = c.rlike(r'^\["[^"\\\x00-\x1F]*"(?:, ?"[^"\\\x00-\x1F]*")*\]\z')
    return F.when(plain, F.filter(F.split(c, '"'), lambda x, i: i % 2 == 1)).otherwise(F.from_json(c, "array<string>"))


def truthy(c: Column) -> Column:
    """Empty text as null, so that coalesce() takes the next one."""
    return F.nullif(c, F.lit(""))


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("string").isin("1", "true", "True").cast("int"), F.lit(0))


def game_status(live: Column, ended: Column) -> Column:
    return F.when(flag(live) == 1, "live").when(flag(ended) == 1, "ended").when(live.isNull() & ended.isNull(), "unknown").otherwise("pregame")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def nfl_team(c: Column) -> Column:
    raw = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))
    spaced = F.regexp_replace(raw, r"\s+", " ")
    table = F.create_map(*[F.lit(x) for kv in NFL_TEAMS.items() for x in kv])
    return F.coalesce(table[raw], table[spaced], table[F.replace(spaced, F.lit(" "), F.lit(""))])


def cfb_team(c: Column) -> Column:
    raw = F.replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit("st."), F.lit(" state "))
    raw = F.trim(F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9 ]+", " "), r"\s+", " "))
    return F.nullif(F.coalesce(_lookup(CFB_ALIASES, raw), raw), F.lit(""))


def player_id(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))


def team_id(sport: Column, c: Column) -> Column:
    return F.when(sport == "nfl", nfl_team(c)).when(sport == "tennis", player_id(c)).otherwise(cfb_team(c))


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: ~t.isin(*PARTICLES) & (t != ""))


def name_keys(c: Column, first: bool) -> Column:
    """Block keys of a name on the first or on the second side of a join: names that are equal by names_equal share one.

    The last name, and for containment the first three letters of the contained name against all runs of up to three letters of the
    other; either side may be the contained one."""
    c = player_id(c)
    holder, held = ("<", ">") if first else (">", "<")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(holder), F.substring(c, i, F.lit(n))))
    keys = F.concat(runs(1), runs(2), runs(3), F.array(F.concat(F.lit(held), F.substring(c, 1, 3)), F.concat(F.lit("last "), F.coalesce(F.try_element_at(name_tokens(c), F.lit(-1)), F.lit("")))))
    return F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))


def names_equal(a: Column, b: Column) -> Column:
    """The same player: equal or contained ids, or equal last names (over two letters) and first initials."""
    a, b = player_id(a), player_id(b)
    ta, tb = name_tokens(a), name_tokens(b)
    last = F.try_element_at(ta, F.lit(-1))
    close = (last == F.try_element_at(tb, F.lit(-1))) & (F.length(last) > 2) & (F.substring(F.get(ta, F.lit(0)), 1, 1) == F.substring(F.get(tb, F.lit(0)), 1, 1))
    return F.coalesce(F.contains(a, b) | F.contains(b, a) | close, F.lit(False))


def tour_level(slug: Column, title: Column) -> Column:
    s, t = F.lower(F.coalesce(slug, F.lit(""))), F.coalesce(title, F.lit(""))
    skip = r"(?i)\b(juniors?|doubles)\b"
    blob = F.lower(F.concat_ws(" ", s, t))
    return (
        F.when(s.isin("atp-doubles", "wta-doubles") | t.rlike(skip) | s.rlike(skip), F.lit(None))
        .when(F.contains(blob, F.lit("challenger")) | F.contains(blob, F.lit("wta 125")) | F.contains(blob, F.lit("125k")), "challenger")
        .when(s.isin("atp", "wta", "itf"), s)
    )


def parse_event_ticker(c: Column) -> Column:
    """struct(date, teams) of an NFL event ticker: its date, and team codes read greedily up to the first gap; else null."""
    pattern = r"^KXNFLGAME-(\d{2}[A-Z]{3}\d{2})([A-Z]+)$"
    codes = F.regexp_extract_all(F.regexp_extract(c, pattern, 2), F.lit(r"\G(" + "|".join(NFL_CODES) + ")"), F.lit(1))
    return F.when(c.rlike(pattern), F.struct(_short_date(F.regexp_extract(c, pattern, 1)).alias("date"), F.transform(codes, nfl_team).alias("teams")))


def _short_date(c: Column) -> Column:
    """25SEP07 as a date, else null. Years from 69 on are of the last century."""
    date = F.try_to_date(F.concat(F.substring(c, 1, 2), F.initcap(F.substring(c, 3, 3)), F.substring(c, 6, 2)), "yyMMMdd")
    return F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)


def ticker_date(c: Column) -> Column:
    return _short_date(F.nullif(F.regexp_extract(c, r"^[A-Z0-9]+-(\d{2}[A-Z]{3}\d{2})", 1), F.lit("")))


def slug_date(slug: Column, close: Column) -> Column:
    """The date at the end of a slug, else the closing date; ISO text."""
    return F.coalesce(truthy(F.regexp_extract(slug, r"(\d{4}-\d{2}-\d{2})$", 1)), local_date(close).cast("string"))


def kalshi_closed(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).isin("", "active", "open", "initialized")


def poly_closed(closed: Column, active: Column) -> Column:
    shut = ~F.lower(F.coalesce(closed, F.lit(""))).isin("", "false", "0", "null")
    return shut | (F.lower(F.coalesce(active, F.lit(""))) == "false")


def fmt_duration(sec: Column) -> Column:
    total = F.bround(F.greatest(sec, F.lit(0.0))).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return (
        F.when(sec.isNull(), "n/a")
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def fmt_cents(edge: Column) -> Column:
    return F.when(edge.isNull(), "n/a").otherwise(F.format_string("%.2fc", edge * 100))


def fmt_ts(ts: Column) -> Column:
    return F.when(ts.isNull(), "n/a").otherwise(F.concat(_utc(ts), F.lit(" UTC")))


def fmt_dollars(v: Column) -> Column:
    return F.when(v.isNull(), "n/a").otherwise(F.format_string("$%,.2f", v))


def fmt_qty(v: Column) -> Column:
    return F.when(v.isNull(), "n/a").when(F.abs(v - F.bround(v)) < 1e-6, F.format_string("%,d", F.bround(v).cast("long"))).otherwise(F.format_string("%,.1f", v))


def price_cents(price: Column) -> Column:
    cents = price * 100
    return F.when(F.abs(cents - F.bround(cents)) < 0.05, F.format_string("%dc", F.bround(cents).cast("long"))).otherwise(F.format_string("%.1fc", cents))


def fmt_size(qty: Column) -> Column:
    return F.when(F.abs(qty - F.bround(qty)) < 1e-6, F.bround(qty).cast("long").cast("string")).otherwise(F.format_string("%.2f", qty))


def sport_label(sport: Column, level: Column) -> Column:
    return F.when((sport == "tennis") & truthy(level).isNotNull(), F.concat(F.lit("tennis/"), level)).otherwise(F.coalesce(truthy(sport), F.lit("?")))


def game_label(sport: Column, level: Column, game_date: Column, team_a: Column, team_b: Column) -> Column:
    return F.format_string("[%s] %s %s vs %s", sport_label(sport, level), F.coalesce(truthy(game_date), F.lit("?")), team_a, team_b)
