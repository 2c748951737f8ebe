"""Wide price files: one row a match, one column a book, market, outcome and phase.

Files are read as lines, so a row of another width than its header is seen and not shifted into wrong columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two layouts' column names.
LAYOUTS = {
    "main": {"home": "HomeTeam", "away": "AwayTeam", "home_goals": "FTHG", "away_goals": "FTAG", "result": "FTR", "division": "Div", "season": None},
    "extra": {"home": "Home", "away": "Away", "home_goals": "HG", "away_goals": "AG", "result": "Res", "division": None, "season": "Season"},
}
OUTCOMES = ("H", "D", "A")


#: A cell: in quotes (doubled ones within are part of it) or up to the next comma.
_CELL = r'(?:^|,)(\s*"(?:[^"]|"")*"[^,]*|[^,]*)'


def _cells(line: Column) -> Column:
    plain = F.transform(F.split(line, ",", -1), lambda v: F.trim(v))
    bare = lambda v: F.replace(F.regexp_replace(v, '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    quoted = F.transform(F.regexp_extract_all(line, F.lit(_CELL), 1), lambda v: F.trim(bare(F.trim(v))))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, width, cells map<string,string>, fits): lines of CSV files with the header's names as keys.

    A file that isn't UTF-8 throughout is read as Latin-1. Cells may be quoted, but hold no line breaks. Of columns with
    the same name the first counts. A line longer than its header is trimmed if what is left over is blank; any other
    width doesn't fit. A header is found by its place, the file's first line."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("utf8"))
    first = raw.groupBy("file").agg(F.min_by("raw", F.struct("block", "at")).alias("top_raw"), F.min(F.struct("block", "at")).alias("top"), F.bool_and("utf8").alias("all_utf8"))
    x = raw.join(first, "file").where(F.struct("block", "at") > F.col("top"))
    text = lambda c: F.regexp_replace(F.when(F.col("all_utf8"), F.decode(c, "UTF-8")).otherwise(F.decode(c, "ISO-8859-1")), "^\\uFEFF|^\u00ef\u00bb\u00bf|\\r$", "")
    x = x.select("file", "at", text("raw").alias("value"), text("top_raw").alias("header")).where("value <> ''")
    x = x.select("file", F.col("at").alias("line"), _cells(F.col("value")).alias("c"), _cells(F.col("header")).alias("h"))
    fits = (F.size("c") == F.size("h")) | ((F.size("c") > F.size("h")) & (F.array_join(F.slice("c", F.size("h") + 1, F.size("c")), "") == ""))
    pairs = F.filter(F.transform("h", lambda n, i: F.struct(n.alias("key"), F.get("c", i).alias("value"), i.alias("i"))), lambda p: (p["key"] != "") & (F.array_position("h", p["key"]) == p["i"] + 1))
    return x.select("file", "line", F.size("c").alias("width"), F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], p["value"]))).alias("cells"), fits.alias("fits"))


def season_of_path(file: Column) -> Column:
    """The season that a file's folder names."""
    return F.regexp_extract(file, r"/(?:[a-z]+=)?(\d{4})/", 1)


def parse_date(text: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy, years from 69 in the last century; null for others and for days that don't exist."""
    y = F.regexp_extract(text, r"^\d{2}/\d{2}/(\d{4}|\d{2})$", 1)
    full = F.when(F.length(y) == 4, y).when(y >= "69", F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
    return F.when(y != "", F.try_to_date(F.concat(full, F.substring(text, 4, 2), F.substring(text, 1, 2)), "yyyyMMdd"))


def first_reason(cells: Column, fits: Column, layout: str, league: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """The first rule a row breaks, in a fixed order; null for a good row."""
    names = LAYOUTS[layout]
    cell = lambda key: F.coalesce(cells[names.get(key) or key], F.lit(""))
    day, clock = parse_date(cell("Date")), cell("Time")
    count = lambda key: cell(key).rlike(r"^\d+$")
    h, a = cell("home_goals").try_cast("int"), cell("away_goals").try_cast("int")
    won = F.when(h > a, "H").when(h < a, "A").otherwise("D")
    rules = [("width", ~fits)]
    if names["division"]:
        rules.append(("division", cell("division") != F.lit(league)))
    rules.append(("date", day.isNull()))
    if start:
        rules.append(("window", ~day.between(start, end)))
    rules += [("time", (clock != "") & ~clock.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")), ("team", (cell("home") == "") | (cell("away") == "")), ("goals", ~(count("home_goals") & count("away_goals"))), ("result", cell("result") != won)]
    if names["season"]:
        rules += [("season", cell("season") == ""), ("season_format", ~cell("season").rlike(r"^(20\d{2}|2100)(/(20\d{2}|2100))?$"))]
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def odds_columns(books: tuple[str, ...]) -> list[tuple[str, str, str, str]]:
    """(column, book, outcome, phase) of the three-way market: closing columns have a C between book and outcome."""
    return [(f"{b}{'C' if ph else ''}{o}", b, o, "closing" if ph else "pre") for b in books for ph in (0, 1) for o in OUTCOMES]


def unpivot_odds(rows: DataFrame, keys: list[str], books: tuple[str, ...]) -> DataFrame:
    """(keys, book, outcome, phase, price, valid): every filled price cell; an invalid one (not finite, or 1 at most)
    has no price and is counted by the caller."""
    entries = F.array(*[F.struct(F.lit(b).alias("book"), F.lit(o).alias("outcome"), F.lit(ph).alias("phase"), F.col("cells")[c].alias("text")) for c, b, o, ph in odds_columns(books)])
    x = rows.select(*keys, F.inline(F.filter(entries, lambda e: F.coalesce(e["text"], F.lit("")) != "")))
    price = F.col("text").try_cast("double")
    ok = F.coalesce((price > 1) & (price < float("inf")) & ~F.isnan(price), F.lit(False))
    return x.select(*keys, "book", "outcome", "phase", F.when(ok, price).alias("price"), ok.alias("valid"))


def stats(cells: Column, names: tuple[str, ...]) -> Column:
    """Map of the named cells that hold whole numbers."""
    kept = F.map_filter(cells, lambda k, v: k.isin(*names) & v.rlike(r"^\d+$"))
    return F.transform_values(kept, lambda k, v: v.cast("int"))
