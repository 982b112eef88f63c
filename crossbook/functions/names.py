"""The names under which the venues list teams. They must equal what the feeds use."""

from __future__ import annotations

#: The names and codes of NFL teams, and the team that each means. Fixed values.
NFL_TEAMS = {
    "ari": "cardinals",
    "arizona": "cardinals",
    "cardinals": "cardinals",
    "atl": "falcons",
    "atlanta": "falcons",
    "falcons": "falcons",
    "bal": "ravens",
    "baltimore": "ravens",
    "ravens": "ravens",
    "buf": "bills",
    "buffalo": "bills",
    "bills": "bills",
    "car": "panthers",
    "carolina": "panthers",
    "panthers": "panthers",
    "chi": "bears",
    "chicago": "bears",
    "bears": "bears",
    "cin": "bengals",
    "cincinnati": "bengals",
    "bengals": "bengals",
    "cle": "browns",
    "cleveland": "browns",
    "browns": "browns",
    "dal": "cowboys",
    "dallas": "cowboys",
    "cowboys": "cowboys",
    "den": "broncos",
    "denver": "broncos",
    "broncos": "broncos",
    "det": "lions",
    "detroit": "lions",
    "lions": "lions",
    "gb": "packers",
    "gnb": "packers",
    "green bay": "packers",
    "packers": "packers",
    "hou": "texans",
    "houston": "texans",
    "texans": "texans",
    "ind": "colts",
    "indianapolis": "colts",
    "colts": "colts",
    "jac": "jaguars",
    "jax": "jaguars",
    "jacksonville": "jaguars",
    "jaguars": "jaguars",
    "kc": "chiefs",
    "kan": "chiefs",
    "kansas city": "chiefs",
    "chiefs": "chiefs",
    "lv": "raiders",
    "lvr": "raiders",
    "las vegas": "raiders",
    "oakland": "raiders",
    "raiders": "raiders",
    "lac": "chargers",
    "chargers": "chargers",
    "los angeles chargers": "chargers",
    "lar": "rams",
    "rams": "rams",
    "los angeles rams": "rams",
    "los angeles r": "rams",
    "mia": "dolphins",
    "miami": "dolphins",
    "dolphins": "dolphins",
    "min": "vikings",
    "minnesota": "vikings",
    "vikings": "vikings",
    "ne": "patriots",
    "nwe": "patriots",
    "new england": "patriots",
    "patriots": "patriots",
    "no": "saints",
    "nor": "saints",
    "new orleans": "saints",
    "saints": "saints",
    "nyg": "giants",
    "new york g": "giants",
    "new york giants": "giants",
    "giants": "giants",
    "nyj": "jets",
    "new york j": "jets",
    "new york jets": "jets",
    "jets": "jets",
    "phi": "eagles",
    "philadelphia": "eagles",
    "eagles": "eagles",
    "pit": "steelers",
    "pittsburgh": "steelers",
    "steelers": "steelers",
    "sea": "seahawks",
    "seattle": "seahawks",
    "seahawks": "seahawks",
    "sf": "49ers",
    "sfo": "49ers",
    "san francisco": "49ers",
    "49ers": "49ers",
    "niners": "49ers",
    "tb": "buccaneers",
    "tam": "buccaneers",
    "tampa": "buccaneers",
    "tampa bay": "buccaneers",
    "buccaneers": "buccaneers",
    "bucs": "buccaneers",
    "ten": "titans",
    "tennessee": "titans",
    "titans": "titans",
    "was": "commanders",
    "wsh": "commanders",
    "washington": "commanders",
    "commanders": "commanders",
}
#: Codes in event tickers: the aliases of two or three letters, longer ones first.
NFL_CODES = sorted({a.upper() for a in NFL_TEAMS if a.isalpha() and len(a) in (2, 3)}, key=lambda a: (-len(a), a))

#: Other names of college teams, and the team that each means; a name without an entry stands for itself. Fixed values.
CFB_ALIASES = {
    "university at albany": "albany",
    "ualbany": "albany",
    "app state": "appalachian state",
    "appalachian st": "appalachian state",
    "cal": "california",
    "central florida": "ucf",
    "connecticut": "uconn",
    "florida a and m": "florida am",
    "florida a m": "florida am",
    "fau": "florida atlantic",
    "florida international": "fiu",
    "miami florida": "miami fl",
    "miami ohio": "miami oh",
    "nc state": "north carolina state",
    "n c state": "north carolina state",
    "ole miss": "mississippi",
    "pitt": "pittsburgh",
    "southern cal": "usc",
    "southern california": "usc",
    "south florida": "usf",
    "southern mississippi": "southern miss",
    "texas a and m": "texas am",
    "texas a m": "texas am",
}

#: Words that aren't part of a player's last name. Fixed values.
PARTICLES = ("de", "da", "das", "dos", "del", "van", "von", "la", "le", "di", "du")
#: Orders of report sections. Fixed values.
STATUS_ORDER = ("live", "pregame", "ended", "unknown")
SPORT_ORDER = ("nfl", "cfb", "tennis")
TENNIS_LEVELS = ("atp", "wta", "itf", "challenger")
