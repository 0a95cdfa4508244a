"""Operator 3, URL filters, native: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list has canonical URLs (host, path), rules among them with a verdict of their own; the other entries block. An entry
fits its host, all of its subdomains, and every path that starts with its path. URLs that repeat are judged once. For
each the candidates are its host's suffixes of as many labels as some listed host has, with those beginnings of its path
that are as long as some path listed for a host of so many labels. A candidate is looked up in a blocked Bloom filter
(one 64-bit block a key, three bits in it, made by ``bit_or``); possible hits meet the list in an exact hash join, which
removes false positives. The longest rule wins; where no rule fits, a listed URL is blocked and any other allowed. Only
DataFrame functions are used.

The filter has a fixed largest size and is broadcast. The list is broadcast up to ``BROADCAST_ROWS`` rows; a longer one
is joined by a shuffle in which listed rows are repeated for ``SALTS`` parts, so that a host that most URLs share is
spread out. Verdicts come back to the pages by (host, path); one that at least ``LEAST`` pages and a ``HOT``-th of all
have is spread over ``SALTS`` parts too (at most ``HOT`` such, which bounds their broadcast), and pages without a host
stay where they are.

Cases: a null URL, and one without ``://``, has an empty host and path and fits no entry; so does an empty host; a URL of
any length is cut as a whole, and its candidates are bounded by the list's label counts and path lengths, not by its own;
equal rows are judged alike and each returned; of equally long entries the first in text order wins; an empty list
allows all; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter at most (8 bytes each), and keys that share a block at the design size.
MOST_BLOCKS, KEYS_A_BLOCK = 1 << 20, 6
BROADCAST_ROWS, SALTS, HOT, LEAST = 100_000, 64, 10_000, 1000

# The rules that the query applies, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Listed hosts; each stands for all of its pages.
LISTED = [("spam-farm.example.org", "/"), ("cheap-pills.example.com", "/")]
ENTRIES = [(h, p, v, True) for h, p, v in RULES] + [(h, p, "block", False) for h, p in LISTED]
ENTRY_SCHEMA = "host string, path string, verdict string, is_rule boolean"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _bits(key: Column) -> Column:
    """Three bits of a 64-bit block, from other parts of the key than the block's number."""
    one = F.lit(1).cast("long")
    bit = lambda shift: F.call_function("shiftleft", one, F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(63)).cast("int"))
    return bit(24).bitwiseOR(bit(32)).bitwiseOR(bit(40))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, mask) of the filter over (host, path): at most ``blocks`` rows."""
    key = _key(F.col("host"), F.col("path"))
    return listed.groupBy(F.pmod(key, F.lit(blocks)).alias("block")).agg(F.bit_or(_bits(key)).alias("mask"))


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url) by ``listed`` (host, path, verdict, is_rule).

    ``rule`` is the rule that decided (host and path in one string), else null; then a listed URL's verdict holds, else
    ``default``. ``listed`` is the entry that the filter found, rule or not.
    """
    listed = listed.filter("host is not null and path is not null and host <> ''").groupBy("host", "path", "is_rule").agg(F.min("verdict").alias("verdict"))
    count = lambda host: F.size(F.split(host, r"\."))
    size, most = listed.agg(F.count("*"), F.max(count(F.col("host")))).first()
    blocks = min(MOST_BLOCKS, max(1, 1 << (size // KEYS_A_BLOCK).bit_length()))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not size:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("listed"))

    # The shapes of the list: path lengths by label count (at most as many rows as the longest host has labels).
    shapes = listed.groupBy(count(F.col("host")).alias("labels")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    distinct = urls.filter("host <> ''").groupBy("host", "path").agg(F.count("*").alias("pages"))
    suffix = F.expr("substring_index(host, '.', -labels)")
    heads = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    own = distinct.withColumn("labels", F.explode(F.sequence(F.lit(1), F.least(count(F.col("host")), F.lit(most)))))
    tried = own.join(F.broadcast(shapes), "labels").select("host", "path", "pages", suffix.alias("h"), F.explode(heads).alias("p"))
    key = _key(F.col("h"), F.col("p"))
    tried = tried.withColumn("block", F.pmod(key, F.lit(blocks))).withColumn("bits", _bits(key))
    possible = tried.join(F.broadcast(bloom_blocks(listed, blocks)), "block").filter(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits")).select("host", "path", "pages", "h", "p")
    entries = listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict", "is_rule")
    if size <= BROADCAST_ROWS:
        hits = possible.join(F.broadcast(entries), ["h", "p"])
    else:
        spread = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = possible.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(spread.hint("shuffle_hash"), ["h", "p", "salt"])
    rule = F.concat("h", "p")
    rank = F.struct((~F.col("is_rule")).alias("other"), (-F.length(rule)).alias("shorter"), rule.alias("entry"), F.col("verdict"))
    decided = hits.groupBy("host", "path", "pages").agg(F.min(rank).alias("best")).select("host", "path", "pages", "best.*")
    # The verdicts of URLs that very many pages share are repeated for all parts, and their pages dealt over these.
    hot = F.col("pages") >= max(LEAST, pages.count() / HOT)
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = decided.withColumn("part", F.explode(parts)).drop("pages")
    many = distinct.filter(hot).select("host", "path", F.lit(True).alias("many"))
    dealt = urls.filter("host <> ''").join(F.broadcast(many), ["host", "path"], "left")
    dealt = dealt.withColumn("part", F.when(F.col("many"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("many")
    found = dealt.join(spread, ["host", "path", "part"], "left").drop("part")
    found = found.unionByName(urls.filter("host = ''"), allowMissingColumns=True)
    return found.select("page_id", "host", "path", F.when(~F.col("other"), F.col("entry")).alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"), F.col("entry").alias("listed"))


#: The same rows in DuckDB's SQL.
SQL = """
WITH listed(h, p, v, r) AS (VALUES {values}),
urls AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
best AS (
    SELECT host, path, arg_min((h || p, v, r), (NOT r, -length(h || p), h || p)) AS b
    FROM (SELECT DISTINCT host, path FROM urls) u JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY host, path
)
SELECT page_id, u.host, u.path, CASE WHEN b[3] THEN b[1] END AS rule, coalesce(b[2], 'allow') AS verdict, b[1] AS listed
FROM urls u LEFT JOIN best ON u.host = best.host AND u.path = best.path
""".format(values=", ".join(f"('{h}', '{p}', '{v}', {r})" for h, p, v, r in ENTRIES))
