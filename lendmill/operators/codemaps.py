"""Code maps of fonts: map texts parsed to a table of intervals, bytes decoded by the longest code that the map knows.

An entry of a map is an interval of codes with a text, or with a first code point that counts on. Where intervals overlap
the later entry holds (all single entries count as earlier than all ranges). Intervals are repeated for each block of 256
codes that they touch, so codes meet them in an equi-join on (font, block), and only codes of two bytes can be asked for.

At every byte the two-byte code is tried first. Which bytes begin a code follows from the ones before, as a greedy pick
along the string (``chains.picked``): a byte that no two-byte code before it covers begins one.

Cases: a font without any entry reads its bytes as UTF-8; an unknown code is the byte's Latin-1 character; entries with
bad numbers, surrogates or ranges turned around map nothing; a range's list may be longer than the range; an empty string
is an empty text, a null one null; rows that repeat an id have to be told apart by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions.coerce import code_point
from lendmill.operators.chains import picked

# Fixed value: codes that a range may hold, one less.
LONGEST = 65_536
_TOKEN = r"(?s)\[(?:<[^>]*>?|[^\]<])*\]?|<[^>]*>?"


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[<>]", "")


def _number(token: Column) -> Column:
    """The number of hexadecimal digits between marks; null for any other token."""
    digits = _digits(token)
    fits = token.startswith("<") & digits.rlike("^0*[0-9A-Fa-f]{1,8}$")
    return F.when(fits, F.conv(digits, 16, 10).cast("long"))


def _text(digits: Column) -> Column:
    """The text of groups of four digits; a surrogate or what is no number has none; null if nothing is left."""
    units = F.regexp_extract_all(digits, F.lit("(?s).{1,4}"), F.lit(0))
    shown = F.array_join(F.transform(units, lambda u: F.when(u.rlike("^[0-9A-Fa-f]+$"), code_point(F.conv(u, 16, 10).cast("long")))), "")
    return F.when(shown != "", shown)


def _every(tokens: Column, n: int, i: int) -> Column:
    """Each n-th token from the i-th on."""
    return F.filter(tokens, lambda _, at: at % n == i)


def intervals(maps: DataFrame) -> DataFrame:
    """(font, low, high, base, text, turn) of (font, map): ``base`` is the first code point of a range that counts on."""
    c = F.col

    def groups(name: str, n: int) -> DataFrame:
        blocks = F.regexp_extract_all(c("map"), F.lit(f"(?s)begin{name}(.*?)end{name}"), F.lit(1))
        tokens = maps.select("font", F.posexplode(blocks).alias("block", "body")).select("font", "block", F.regexp_extract_all("body", F.lit(_TOKEN), F.lit(0)).alias("t"))
        parts = F.arrays_zip(*(_every(c("t"), n, i).alias(f"t{i}") for i in range(n)))
        return tokens.select("font", "block", F.posexplode(parts).alias("at", "p")).select("font", "block", "at", "p.*")

    turn = lambda kind, item: F.struct(F.lit(kind).alias("kind"), "block", "at", item.alias("item"))
    single = groups("bfchar", 2).filter(c("t1").startswith("<"))
    code = _number(c("t0"))
    single = single.select("font", code.alias("low"), code.alias("high"), F.lit(None).cast("long").alias("base"), _text(_digits(c("t1"))).alias("text"), turn(0, F.lit(0)).alias("turn"))
    ranges = groups("bfrange", 3).withColumns({"low": _number(c("t0")), "high": _number(c("t1"))})
    bad = c("low").isNull() | c("high").isNull() | c("t2").isNull()
    # What follows a range that cannot be read is not read at all.
    whole = Window.partitionBy("font", "block")
    ranges = ranges.withColumn("stop", F.min(F.when(bad, c("at"))).over(whole)).filter("stop is null or at < stop")
    counted = ranges.filter(c("t2").startswith("<") & (c("high") >= c("low")) & (c("high") - c("low") < LONGEST))
    counted = counted.select("font", "low", "high", _number(c("t2")).alias("base"), F.lit(None).cast("string").alias("text"), turn(1, F.lit(0)).alias("turn"))
    items = F.regexp_extract_all("t2", F.lit("(?s)<[^>]*>?"), F.lit(0))
    listed = ranges.filter(c("t2").startswith("[")).select("font", "low", "block", "at", F.posexplode(items).alias("i", "item"))
    place = c("low") + c("i")
    listed = listed.select("font", place.alias("low"), place.alias("high"), F.lit(None).cast("long").alias("base"), _text(_digits(c("item"))).alias("text"), turn(1, c("i")).alias("turn"))
    found = single.unionByName(counted).unionByName(listed)
    return found.filter("low is not null and (base is not null or text is not null)")


def known_codes(codes: DataFrame, found: DataFrame) -> DataFrame:
    """(font, code, shown) of those (font, code), codes below 65,536, that an interval holds; the latest one counts."""
    c = F.col
    blocks = F.sequence(F.shiftright("low", 8), F.shiftright(F.least("high", F.lit(0xFFFF)), 8))
    spread = found.filter("low <= 65535").withColumn("block", F.explode(blocks))
    met = codes.distinct().withColumn("block", F.shiftright("code", 8)).join(spread, ["font", "block"]).filter("code between low and high")
    shown = F.coalesce(c("text"), code_point(c("base") + c("code") - c("low")))
    return met.withColumn("shown", shown).filter("shown is not null").groupBy("font", "code").agg(F.max_by("shown", "turn").alias("shown"))


def decoded(strings: DataFrame, maps: DataFrame) -> DataFrame:
    """(id, text) of (id, font, data) by the maps (font, map) of the fonts."""
    c = F.col
    found = intervals(maps)
    mapped = found.select("font").distinct().withColumn("mapped", F.lit(True))
    rows = strings.join(mapped, "font", "left")
    plain = rows.filter("mapped is null or data is null or octet_length(data) = 0")
    plain = plain.select("id", F.expr("make_valid_utf8(cast(data as string))").alias("text"))
    digits = rows.filter("mapped and octet_length(data) > 0").select("id", "font", F.hex("data").alias("h"))
    at = digits.select("id", "font", "h", F.explode(F.expr("sequence(0, int(length(h) div 2) - 1)")).alias("place"))
    number = lambda n: F.conv(F.substr("h", (c("place") * 2 + 1).cast("int"), F.lit(n)), 16, 10).cast("long")
    at = at.select("id", "font", c("place").cast("long").alias("place"), number(2).alias("one"), F.when(c("place") * 2 + 4 <= F.length("h"), number(4)).alias("two"))
    codes = at.select("font", c("one").alias("code")).unionByName(at.select("font", c("two").alias("code"))).filter("code is not null")
    known = known_codes(codes, found)
    own = lambda name: known.select("font", c("code").alias(name), c("shown").alias(f"{name}_shown"))
    at = at.join(own("one"), ["font", "one"], "left").join(own("two"), ["font", "two"], "left")
    at = at.withColumn("limit", c("place") + F.when(c("two_shown").isNotNull(), 2).otherwise(1))
    begun = picked(at.select("id", "place", c("place").alias("start"), "limit"), ["id"], "start", "limit")
    piece = F.coalesce("two_shown", "one_shown", code_point(c("one")))
    shown = at.join(begun, ["id", "place"]).select("id", "place", piece.alias("piece"))
    return shown.groupBy("id").agg(F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY place)").alias("text")).unionByName(plain)
