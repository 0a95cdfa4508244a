"""Masking inside JSON records of any depth: strings are told apart by their quotation marks, masked, and put back in place.

A record is split at its quotation marks; one behind an odd number of backslashes is escaped and joins what it has parted.
The running count of the other marks numbers the pieces: odd ones are strings, even ones what stands between, whose first and last marks say what a string is: a name
(a colon follows), a member's value (a colon precedes, its name is the string before) or an element of a list. So every
string is judged by its own neighbours, however deep it lies, and everything else comes back as it was. Windows and
aggregates are over one record; a record is shuffled once.

Cases: null stays null; an empty record is empty; text that is no JSON is masked string by string all the same, and what
a missing quotation mark leaves open counts as a string; escapes are read before masking and written again after it; names
that are masked alike both stay; numbers, true, false and null stay under any name; repeated ids have to be told apart by
the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions import pii

#: A mask gets the string, its name (null in a list) and whether it is a name itself; null keeps the string as it is.
Mask = Callable[[Column, Column, Column], Column]


def _read(raw: Column) -> Column:
    """A string without its escapes; null if they are broken. One without escapes and control characters is as it stands."""
    return F.when(raw.rlike(r"[\x00-\x1F\\]"), F.get_json_object(F.concat(F.lit('["'), raw, F.lit('"]')), "$[0]")).otherwise(raw)


def _written(text: Column) -> Column:
    """A string with escapes and quotation marks."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def pieces(records: DataFrame, many: int | None = None) -> DataFrame:
    """(id, n, raw, is_string, is_name, name) of (id, json): the pieces of a record in order; the odd ones are strings.

    With ``many`` records are dealt into so many; without it Spark joins small ones by bytes, which pieces outgrow.
    """
    c = F.col
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # Records are dealt before they are exploded: their pieces keep that partitioning for the windows and aggregates.
    rows = records.filter("json <> ''")
    rows = rows.repartition("id") if many is None else rows.repartition(many, "id")
    rows = rows.withColumn("parts", F.split("json", '"')).select("id", F.size("parts").alias("size"), F.posexplode("parts").alias("pos", "token"))
    slashes = F.length("token") - F.length(F.rtrim(c("token"), F.lit("\\")))
    rows = rows.withColumn("open", (slashes % 2 == 1) & (c("pos") < c("size") - 1))
    rows = rows.withColumn("n", F.coalesce(F.sum((~c("open")).cast("long")).over(before), F.lit(0))).withColumn("token", F.when(c("open"), F.concat("token", F.lit('"'))).otherwise(c("token")))
    found = rows.groupBy("id", "n").agg(F.expr("listagg(token, '') WITHIN GROUP (ORDER BY pos)").alias("raw"))
    order = Window.partitionBy("id").orderBy("n")
    string = c("n") % 2 == 1
    found = found.withColumns({"after": F.lead("raw").over(order), "before": F.lag("raw").over(order), "last": F.lag("raw", 2).over(order), "is_string": string})
    named = F.trim("before") == ":"
    return found.select("id", "n", "raw", "is_string", (string & c("after").rlike(r"^\s*:")).alias("is_name"), F.when(string & named, _read(c("last"))).alias("name"))


def masked(records: DataFrame, mask: Mask, many: int | None = None) -> DataFrame:
    """(id, json) with every string as the mask gives it back."""
    c = F.col
    # Columns of their own: a string is read and masked once, however often the next step looks at it.
    rows = pieces(records, many).withColumn("text", F.when(c("is_string"), _read(c("raw"))))
    rows = rows.withColumn("new", F.when(c("is_string"), mask(c("text"), c("name"), c("is_name"))))
    shown = F.when(~c("is_string"), c("raw")).when(c("new").isNull() | (c("new") == c("text")), F.concat(F.lit('"'), "raw", F.lit('"'))).otherwise(_written(c("new")))
    whole = rows.select("id", "n", shown.alias("shown")).groupBy("id").agg(F.expr("listagg(shown, '') WITHIN GROUP (ORDER BY n)").alias("json"))
    empty = records.filter("json is null or json = ''").select("id", "json")
    return whole.unionByName(empty)


def by_name(text: Column, name: Column, is_name: Column) -> Column:
    """Members whose name holds ``pan``, ``dob`` or ``aadhaar`` are masked, strings of lists by what they hold, others stay."""
    low = F.lower(name)
    member = F.when(low.contains("pan"), pii.mask_pan(text)).when(low.contains("dob"), pii.mask_dob(text)).when(low.contains("aadhaar"), pii.mask_aadhaar(text))
    return F.when(is_name, F.lit(None)).when(name.isNotNull(), member).otherwise(pii.mask_text(text))


def everywhere(text: Column, name: Column, is_name: Column) -> Column:
    """Every string, names too, without the identifiers that it holds."""
    return pii.redact_text(text)


def everywhere_strict(text: Column, name: Column, is_name: Column) -> Column:
    """As ``everywhere``, but of numbers of twelve digits only those whose checksum holds."""
    return pii.redact_other(pii.redact_strict(text))
