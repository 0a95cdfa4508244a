"""Queries of money, years, dates, identifiers and duplicate documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.functions import coerce, money, pii
from lendmill.operators import bureau, income
from lendmill.operators.duplicates import file_identity, first_wins
from lendmill.registry import query
from lendmill.sources.tables import select_sql, shared_folder, table, texts
from lendmill.streaming.duplicates import DuplicateIndex

_P = "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)"
_VARIANTS = ("{p}", "{p}.5", "{p}.755", "({p})", "-{p}", "{p} DR", "Rs. {p}", "Rs {p}", "1,{p}.00 CR", "1.{p}.3", "Tax on {p}", "", "99999999999999999{p}", "+{p}/", "Cess @ 4.00% {p}", "year 2024 no {p}, ok", "₹ 12,{p}", "(.)")
AMOUNTS = {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "text": f"CASE (l_partkey + l_linenumber) % {len(_VARIANTS)} " + " ".join("WHEN {} THEN concat({})".format(i, ", ".join(["''", *(_P if x == "{p}" else f"'{x}'" for x in v.replace("{p}", "\0{p}\0").split("\0") if x)])) for i, v in enumerate(_VARIANTS)) + " END",
}
AMOUNTS_SQL = f"amounts AS ({select_sql(AMOUNTS, 'lineitem')})"


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in AMOUNTS.items()))


def _paise_sql(digits: str) -> str:
    decimals = f"coalesce(nullif(split_part({digits}, '.', 2), ''), '')"
    cents = f"(CASE length({decimals}) WHEN 0 THEN 0 WHEN 1 THEN CAST({decimals} AS INT) * 10 ELSE CAST(left({decimals}, 2) AS INT) END)"
    value = f"(TRY_CAST(split_part({digits}, '.', 1) AS BIGINT)::HUGEINT * 100 + {cents})"
    return f"(CASE WHEN len(string_split({digits}, '.')) <= 2 AND {value} <= 9223372036854775807 THEN {value}::BIGINT END)"


MONEY_SQL = f"""SELECT text, CASE WHEN regexp_matches(regexp_replace(upper(trim(text)), 'INR|RS\\.|RS|CR|DR', ' ', 'g'), '^[0-9.,()+\\- /₹\\x{{A0}}]*$') AND regexp_matches(text, '[0-9]')
THEN CASE WHEN text LIKE '(%)' OR text LIKE '-%' OR upper(text) LIKE '%DR' THEN -1 ELSE 1 END * {_paise_sql("regexp_replace(trim(text), '[^0-9.]', '', 'g')")} END AS paise, count(*) AS lines FROM amounts GROUP BY ALL"""


def _found_sql(pattern: str, place: str) -> str:
    likely = f"list_filter(regexp_extract_all(text, '{pattern}'), lambda c: regexp_matches(c, '[,.]') OR length(c) >= 4)"
    return f"list_filter(list_transform({likely}, lambda c: {_paise_sql(chr(114) + 'eplace(c, ' + chr(39) + ',' + chr(39) + ', ' + chr(39) * 2 + ')')}), lambda x: x IS NOT NULL)[{place}]"


@query("money_parse", f"WITH {AMOUNTS_SQL} {MONEY_SQL}")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).groupBy("text").agg(F.count("*").alias("lines")).select("text", money.money(F.col("text")).alias("paise"), "lines")


@query("money_find_first", f"WITH {AMOUNTS_SQL} SELECT DISTINCT text, {_found_sql('[0-9](?:[0-9,.]*[0-9])?', '1')} AS paise FROM amounts")
def money_find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("text").distinct().select("text", money.first_money(F.col("text")).alias("paise"))


@query("money_find_last", f"WITH {AMOUNTS_SQL} SELECT DISTINCT text, {_found_sql('[0-9,.]*[0-9]', '-1')} AS paise FROM amounts")
def money_find_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("text").distinct().select("text", money.last_money(F.col("text")).alias("paise"))


@query(
    "amount_coercions",
    f"""WITH {AMOUNTS_SQL} SELECT DISTINCT text, TRY_CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT) AS digits,
CASE WHEN regexp_matches(trim(replace(text, ',', '')), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN CAST(trim(replace(text, ',', '')) AS DOUBLE) ELSE 0 END AS amount FROM amounts""",
)
def amount_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("text").distinct().select("text", coerce.amount_digits(F.col("text")).alias("digits"), coerce.amount_or_zero(F.col("text")).alias("amount"))


_Y = "CAST(year(o_orderdate) AS STRING)"
_N = "CAST(year(o_orderdate) + 1 AS STRING)"
_YEARS = (f"concat('FY ', {_Y}, '-', right({_N}, 2))", f"concat({_Y}, '/', {_N})", f"concat('A.Y. ', {_Y}, ' - ', {_Y})", f"concat('12 ', {_Y}, ' ', right({_N}, 2), ' x')", "'1999-00'", "'no year'", f"concat({_Y}, '-', {_N}, '-', CAST(year(o_orderdate) + 2 AS STRING))", "'2099-2100'", "'1989-90'", "'123-24 2024-26'")
YEARS_TEXT = f"CASE o_orderkey % {len(_YEARS)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_YEARS)) + " END"
_PAIR = "list_filter(list_transform(range(1, len(g)), lambda i: struct_pack(a := g[i], b := g[i + 1])), lambda p: length(p.a) = 4 AND CAST(p.a AS INT) BETWEEN 1990 AND 2100 AND (length(p.b) = 4 AND CAST(p.b AS INT) = CAST(p.a AS INT) + 1 OR length(p.b) = 2 AND (CAST(p.a AS INT) + 1) % 100 = CAST(p.b AS INT)))[1].a"


@query(
    "year_parse",
    f"""WITH y AS (SELECT {YEARS_TEXT} AS text FROM orders), g AS (SELECT text, count(*) AS orders, regexp_extract_all(text, '[0-9]+') AS g FROM y GROUP BY text), f AS (SELECT text, orders, CAST({_PAIR} AS INT) AS start FROM g)
SELECT text, orders, start, start || '-' || lpad(CAST((start + 1) % 100 AS VARCHAR), 2, '0') AS label, (start - 1) || '-' || lpad(CAST(start % 100 AS VARCHAR), 2, '0') AS financial_year FROM f""",
)
def year_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").selectExpr(f"{YEARS_TEXT} AS text").groupBy("text").agg(F.count("*").alias("orders"))
    found = counted.withColumn("start", money.year_range(F.col("text")))
    return found.withColumns({"label": money.year_label(F.col("start")), "financial_year": money.year_label(F.col("start") - 1)})


_DATES = "CASE o_orderkey % 5 WHEN 0 THEN '31/02/2023' WHEN 1 THEN '5-1-2024' WHEN 2 THEN '2024/13/01' WHEN 3 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '.', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', CAST(year(o_orderdate) AS STRING)) ELSE concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) END"


@query(
    "date_coercions",
    f"""WITH d AS (SELECT DISTINCT {_DATES} AS text, CAST(o_orderdate AS DATE) AS born FROM orders)
SELECT text, born::VARCHAR AS born, (CASE WHEN regexp_matches(text, '^[0-9]+[/-][0-9]+[/-][0-9]+$') AND CAST(regexp_extract(text, '^([0-9]+)', 1) AS INT) BETWEEN 1 AND 31 AND CAST(regexp_extract(text, '^[0-9]+[/-]([0-9]+)', 1) AS INT) BETWEEN 1 AND 12
THEN make_date(CAST(regexp_extract(text, '([0-9]+)$', 1) AS INT), CAST(regexp_extract(text, '^[0-9]+[/-]([0-9]+)', 1) AS INT), 1) + (CAST(regexp_extract(text, '^([0-9]+)', 1) AS INT) - 1) END)::DATE::VARCHAR AS civil,
regexp_replace(text, '^([0-9]{{2}})[/.-]([0-9]{{2}})[/.-]([0-9]{{4}})$', '\\3-\\2-\\1') AS iso,
greatest(2025 - year(born) - CASE WHEN (month(born), day(born)) > (6, 15) THEN 1 ELSE 0 END, 0)::INT AS age FROM d""",
)
def date_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(f"{_DATES} AS text", "CAST(o_orderdate AS DATE) AS born").distinct()
    text, born = F.col("text"), F.col("born")
    not_yet = (F.month(born) * 100 + F.dayofmonth(born) > 615).cast("int")
    civil = F.when(~text.contains("."), bureau.civil_date(text))
    return rows.select("text", F.col("born").cast("string").alias("born"), civil.cast("string").alias("civil"), F.regexp_replace(text, r"^([0-9]{2})[/.-]([0-9]{2})[/.-]([0-9]{4})$", "$3-$2-$1").alias("iso"), F.greatest(2025 - F.year(born) - not_yet, F.lit(0)).alias("age"))


#: Identifiers made from the id stand before each document's own text.
_PII = "concat('pan abcpk', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), 'f dob 19', lpad(CAST(doc_id % 90 + 10 AS STRING), 2, '0'), '-05-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), ' id ', lpad(CAST(doc_id % 7919 AS STRING), 4, '2'), '-4567-', lpad(CAST(doc_id % 9973 AS STRING), 4, '0'), ' num 9', lpad(CAST(doc_id % 1000000 AS STRING), 9, '8'), ' PAN ABCPK1234F mail u', CAST(doc_id AS STRING), '@mail.example. ', coalesce(text, ''))"
_CUSTOMER = {
    "k": "c_custkey",
    "pan": "CASE c_custkey % 5 WHEN 0 THEN concat(' abcpk', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'f ') WHEN 1 THEN concat('ABCDE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'Z') WHEN 2 THEN 'SHORT' WHEN 3 THEN NULL ELSE concat('XYZTA', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'K') END",
    "dob": "concat('19', lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0'), '-05-11')",
    "aadhaar": "concat(CAST(c_custkey % 10 AS STRING), lpad(CAST((c_custkey * 7919) % 100000000000 AS STRING), 11, '3'))",
    "company_name": "c_name",
    "control_number": "CASE c_custkey % 4 WHEN 0 THEN '0000' WHEN 1 THEN '' ELSE CAST(c_custkey AS STRING) END",
    "score": "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 700 END",
    "name": "CASE c_custkey % 6 WHEN 0 THEN 'UNKNOWN' WHEN 3 THEN ' ' ELSE c_name END",
    "phone": "concat(CAST(c_custkey % 10 AS STRING), lpad(CAST(c_custkey AS STRING), 9, '7'))",
    "mail": "CASE c_custkey % 3 WHEN 0 THEN concat('user', CAST(c_custkey AS STRING), '@mail.example') WHEN 1 THEN 'nomail' ELSE 'a@' END",
}
PEOPLE_SQL = f"people AS ({select_sql(_CUSTOMER, 'customer')})"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in _CUSTOMER.items()))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PII} AS text")


@query(
    "pii_mask_by_key",
    f"""WITH {PEOPLE_SQL} SELECT k, CASE WHEN pan IS NULL THEN NULL WHEN length(pan) >= 10 THEN left(pan, 2) || '******' || right(pan, 2) ELSE '****' END AS pan, '****-**-' || right(dob, 2) AS dob,
'****-****-' || right(aadhaar, 4) AS aadhaar, CASE WHEN length(company_name) >= 10 THEN left(company_name, 2) || '******' || right(company_name, 2) ELSE '****' END AS company_name, phone FROM people""",
)
def pii_mask_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("k", *pii.mask_fields(["pan", "dob", "aadhaar", "company_name", "phone"]))


@query(
    "pii_mask_text",
    f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace({_PII}, '(?i)\\b([A-Z]{{2}})[A-Z]{{3}}[0-9]{{3}}([0-9][A-Z])\\b', '\\1******\\2', 'g'), '\\b([0-9]{{4}}-[0-9]{{2}}-)([0-9]{{2}})\\b', '****-**-\\2', 'g'),
'\\b[0-9]{{4}}[-\\s]?[0-9]{{4}}[-\\s]?([0-9]{{4}})\\b', '****-****-\\1', 'g')) AS masked_sha256 FROM documents""",
)
def pii_mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("doc_id", F.sha2(pii.mask_text(F.col("text")), 256).alias("masked_sha256"))


@query("pii_simple_redact", f"SELECT doc_id, sha256(regexp_replace({_PII}, '\\b[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}\\b', '[Aadhaar Redacted]', 'g')) AS redacted_sha256 FROM documents")
def pii_simple_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("doc_id", F.sha2(pii.redact_simple(F.col("text")), 256).alias("redacted_sha256"))


@query("pii_redact_lookaround")
def pii_redact_lookaround(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with identifiers masked by their neighbours; DuckDB has no lookbehind, so the tests hold it to a model."""
    return _letters(spark, sf_dir).select("doc_id", pii.redact_text(F.col("text")).alias("redacted"))


@query("pii_strict_redact")
def pii_strict_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("doc_id", pii.redact_strict(F.col("text")).alias("redacted"))


@query("pii_leak_count")
def pii_leak_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _letters(spark, sf_dir).select("doc_id", pii.leaks(text).alias("before"), pii.leaks(pii.redact_text(text)).alias("after"))


def _verhoeff_sql() -> str:
    check = "0"
    for i in range(12):
        check = f"list_extract(d, {check} * 10 + list_extract(p, {i % 8 * 10 + 1} + CAST(aadhaar[{12 - i}] AS INT)) + 1)"
    return f"SELECT k, CASE WHEN regexp_matches(aadhaar, '^[2-9][0-9]{{11}}$') THEN {check} = 0 ELSE false END AS valid FROM (SELECT k, aadhaar, {list(pii.GROUP)} AS d, {list(pii.PLACES)} AS p FROM people)"


@query("pii_verhoeff_flag", f"WITH {PEOPLE_SQL} {_verhoeff_sql()}")
def pii_verhoeff_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("k", pii.verhoeff_valid(F.col("aadhaar")).alias("valid"))


@query(
    "id_pan_verdict",
    f"""WITH {PEOPLE_SQL} SELECT k, CASE WHEN pan IS NULL OR NOT regexp_matches(upper(trim(pan)), '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') THEN 'BadShape' WHEN regexp_matches(upper(trim(pan))[4], '[ABCFGHJLPTK]') THEN 'Valid' ELSE 'UnknownEntityCode' END AS verdict FROM people""",
)
def id_pan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("k", pii.pan_verdict(F.col("pan")).alias("verdict"))


_IDENTITY = {
    "sheet_id": "doc_id",
    "pan": "CASE doc_id % 5 WHEN 0 THEN concat(' abcpk', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), 'f ') WHEN 1 THEN concat('ABCDE', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), 'Z') WHEN 2 THEN 'SHORT' WHEN 4 THEN 'XYZTA1234K' END",
    "aadhaar": "CASE WHEN doc_id % 2 = 0 THEN '[Aadhaar Redacted]' END",
    "serialized": "CASE doc_id % 4 WHEN 0 THEN 'id 2345 6789 0123, 234567890123' WHEN 1 THEN '1234 5678 9012 and 42345678901234' WHEN 2 THEN 'x2345-6789-0123' ELSE '2345678901.23' END",
}


@query(
    "id_pan_findings",
    """SELECT doc_id AS sheet_id, 'PAN_STRUCTURE' AS rule, CASE doc_id % 5 WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'skipped' END AS severity,
CASE doc_id % 5 WHEN 0 THEN 'PAN well-formed, entity code ''P''' WHEN 1 THEN 'PAN 4th character ''D'' is not a known entity code'
     WHEN 2 THEN 'PAN does not match AAAAA9999A' WHEN 3 THEN 'no PAN found' ELSE 'PAN well-formed, entity code ''T''' END AS message FROM documents
UNION ALL SELECT doc_id, 'AADHAAR_REDACTED', CASE WHEN doc_id % 4 IN (0, 2) THEN 'error' ELSE 'skipped' END,
CASE WHEN doc_id % 4 = 0 THEN '2 Aadhaar-shaped value(s) survived redaction in the output' WHEN doc_id % 4 = 2 THEN '1 Aadhaar-shaped value(s) survived redaction in the output'
     ELSE 'no Aadhaar present' END FROM documents""",
)
def id_pan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the tax number and of left-over numbers for a sheet made of each document."""
    return income.identifier_findings(table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _IDENTITY.items())))


@query(
    "id_regex_flags",
    f"""WITH {PEOPLE_SQL} SELECT k, coalesce(regexp_full_match(pan, '[A-Z]{{5}}[0-9]{{4}}[A-Z]'), false) AS pan, regexp_full_match(phone, '[6-9][0-9]{{9}}') AS phone, regexp_full_match(dob, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS dob,
regexp_full_match(mail, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}') AS mail, regexp_full_match(control_number, '[1-9][0-9]{{5}}') AS pincode FROM people""",
)
def id_regex_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _people(spark, sf_dir).select("k", F.coalesce(c("pan").rlike(pii.PAN), F.lit(False)).alias("pan"), c("phone").rlike(pii.PHONE).alias("phone"), c("dob").rlike(pii.DOB).alias("dob"), c("mail").rlike(pii.EMAIL).alias("mail"), c("control_number").rlike(pii.PINCODE).alias("pincode"))


@query(
    "otp_mask",
    f"""WITH {PEOPLE_SQL} SELECT k, '******' || right(phone, 4) AS phone, CASE WHEN contains(mail, '@') AND split_part(mail, '@', 2) <> '' THEN left(split_part(mail, '@', 1), 2) || '***@' || split_part(mail, '@', 2) ELSE '***' END AS mail FROM people""",
)
def otp_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("k", pii.mask_target(F.lit("mobile"), F.col("phone")).alias("phone"), pii.mask_target(F.lit("email"), F.col("mail")).alias("mail"))


@query(
    "gate_unknown_consumer",
    f"""WITH {PEOPLE_SQL} SELECT k, array_to_string(list_filter([CASE WHEN lower(trim(name)) IN ('', 'unknown') THEN 'name' END, CASE WHEN length(trim(coalesce(pan, ''))) < 10 THEN 'PAN' END,
CASE WHEN regexp_full_match(trim(control_number), '0*') THEN 'control number' END, CASE WHEN score = 0 THEN 'CIBIL score' END], lambda x: x IS NOT NULL), ',') AS missing,
lower(trim(name)) IN ('', 'unknown') AND length(trim(coalesce(pan, ''))) < 10 AND regexp_full_match(trim(control_number), '0*') AND score = 0 AS unknown FROM people""",
)
def gate_unknown_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = pii.missing_identifiers(F.col("name"), F.col("pan"), F.col("control_number"), F.col("score"))
    return _people(spark, sf_dir).select("k", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 4).alias("unknown"))


@query(
    "dedupe_fingerprint_first_wins",
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) >= 200
THEN sha256(upper(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'SS'))) END AS content FROM documents),
f AS (SELECT *, first_value(doc_id) OVER w AS original_id, first_value(sha) OVER w AS first_sha FROM h WINDOW w AS (PARTITION BY coalesce('c:' || content, 's:' || sha) ORDER BY doc_id))
SELECT doc_id, original_id, CASE WHEN doc_id = original_id THEN 'New' WHEN sha = first_sha THEN 'Exact' ELSE 'Content' END AS kind FROM f""",
)
def dedupe_fingerprint_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(texts(spark, sf_dir, "documents"))


@query(
    "dedupe_index_batches",
    """WITH h AS (SELECT doc_id, doc_id % 3 AS batch, sha256(coalesce(text, '')) AS sha, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g')) >= 200
THEN sha256(upper(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'SS'))) END AS content FROM documents),
f AS (SELECT *, first_value(doc_id) OVER w AS original_id, first_value(sha) OVER w AS first_sha FROM h WINDOW w AS (PARTITION BY coalesce('c:' || content, 's:' || sha) ORDER BY batch, doc_id))
SELECT doc_id, original_id, CASE WHEN doc_id = original_id THEN 'New' WHEN sha = first_sha THEN 'Exact' ELSE 'Content' END AS kind FROM f""",
)
def dedupe_index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in three batches by a duplicate index that each batch reads and extends; compacted before the last."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    index = DuplicateIndex(spark, f"{shared_folder(spark)}/duplicates-{uuid.uuid4().hex}")
    parts = []
    for number in range(3):
        if number == 2:
            index.compact()
        parts.append(index.add(docs.filter(F.col("doc_id") % 3 == number), number))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FILES = "SELECT DISTINCT p_partkey // 3 AS file_id FROM part"


@query(
    "fingerprint_image_rule",
    f"""WITH files AS ({_FILES}), parts AS (SELECT p_partkey // 3 AS file_id, p_partkey % 3 AS no, lpad(format('{{:X}}', strlen(p_name)), 2, '0') || '00000000000000' || hex(p_name) AS part FROM part WHERE p_partkey % 7 <> 0),
images AS (SELECT file_id, sha256(unhex(string_agg(part, '' ORDER BY no) || '0' || count(*) || '00000000000000')) AS image_hash FROM parts GROUP BY file_id)
SELECT file_id, CASE WHEN file_id % 2 = 0 THEN sha256(repeat('A', 250) || file_id) END AS content, CASE WHEN file_id % 2 <> 0 THEN image_hash END AS image_hash FROM files LEFT JOIN images USING (file_id)""",
)
def fingerprint_image_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and image hashes of files; letterheads repeat, so an image hash counts for files without text only."""
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 3).alias("file_id"), (F.col("p_partkey") % 3).alias("object_no"), F.col("p_name").cast("binary").alias("data"), "p_partkey")
    text = F.when(F.col("file_id") % 2 == 0, F.concat(F.repeat(F.lit("a"), 250), F.col("file_id").cast("string"))).otherwise("scan")
    return file_identity(parts.select("file_id").distinct().withColumn("text", text), parts.filter("p_partkey % 7 <> 0"))
