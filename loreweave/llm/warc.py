"""Not-modified revisits of web captures, resolved to the response they stand for.

A revisit record has no body. It is joined, as of its date, to the latest earlier
full response of the same canonical URL; the validators of the two must agree,
and headers that a not-modified answer may renew are taken from the revisit. WARC
files are read as text that is cut where a record may begin, so plain files are read
in parallel and compressed ones as a stream; no file is one value. A record is as
long as its Content-Length says: cuts within it are none, whatever its body holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

# Headers that a 304 response may renew, query keys that don't name a page.
RENEWABLE = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
MARK, GAP = "WARC/", "\r\n\r\n"
VERSION = f"{MARK}1.1\r\n"
#: Records of a URL from which its time is cut into slices of about as many.
ROWS_PER_SLICE = 50_000


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www., default port, fragment, tracking parameters and closing slash; host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), rf"(^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def latest_before(rows: DataFrame, keys: list[str], order: list[str], slice_: str, value: str) -> DataFrame:
    """rows with ``latest``: the last non-null value of a row before, within keys, in the given order.

    ``slice_`` is a number that doesn't fall along the order. A key's rows are
    searched slice by slice, and what a slice ends with is carried to the next
    ones, so a key with a third of all rows is spread over its slices.
    """
    within = Window.partitionBy(*keys, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter(F.col(value).isNotNull()).groupBy(*keys, slice_).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    all_slices = rows.select(*keys, slice_).distinct().join(ends, [*keys, slice_], "left")
    carried = all_slices.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    placed = rows.withColumn("_own", F.last(value, ignorenulls=True).over(within))
    return placed.join(carried, [*keys, slice_]).withColumn("latest", F.coalesce("_own", "_carried")).drop("_own", "_carried")


def write_warc(captures: DataFrame, path: str) -> None:
    """Write records as WARC files below path.

    captures has record_id, kind, url, date, status, headers (map), payload_digest
    and body; of these what is null is left out of its record, a null body is
    empty. A line end in a URL or header would start another field and raises an error. Very
    long bodies are written whole, repeated rows are records of their own, ties
    don't occur. No rows: no records. Other columns are ignored.
    """
    broken = F.col("url").rlike("[\r\n]") | F.exists(F.map_entries("headers"), lambda e: F.concat(e["key"], F.coalesce(e["value"], F.lit(""))).rlike("[\r\n]"))
    url = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit("a line end in a URL or header"))).otherwise(F.col("url"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    given = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\r\n"))), "")
    http = F.concat(F.coalesce(F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit("\r\n")), F.lit("")), F.coalesce(given, F.lit("")), F.lit("\r\n"), F.coalesce("body", F.lit("")))
    made = captures.withColumn("_http", http)
    utc = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(unix_seconds(date) AS DECIMAL(18, 6)))")
    record = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_http").cast("string")),
        F.lit("\r\n"),
        F.col("_http"),
    )
    made.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("_head", rf"(?im)^{name}:[\x20\t]*([^\r\n]*?)[\x20\t]*\r?$", 1), F.lit(""))


def _date(name: str) -> Column:
    """A date to seconds; one that names no zone is in UTC, whatever the session's."""
    value = _field(name)
    return F.date_trunc("second", F.when(value.rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$"), value).otherwise(F.concat(value, F.lit("Z"))).try_cast("timestamp"))


def _first_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of records that go on over cuts, sorted by file and place, those that don't lie within another."""
    file, end = None, 0
    for b in batches:
        live = []
        for f, at, until in zip(b["_file"], b["_at"], b["_end"], strict=True):
            live.append(f != file or at >= end)
            if live[-1]:
                file, end = f, until
        yield b[live]


def _records(pieces: DataFrame) -> DataFrame:
    """The pieces of files that are records, and don't lie within one.

    Only a piece shorter than its Content-Length goes on over the cuts behind it. Of
    files with such pieces the places are summed up, split by split, and what lies
    before the end of the record that goes on is left out.
    """
    short = F.col("_size") < F.col("_whole")
    files = pieces.filter(short).select("_file").distinct()
    cut = pieces.join(files, "_file", "left_semi")
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_file", "_split").agg(F.sum(F.col("_size") + len(GAP + MARK)).alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("_file", "_split").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_at", F.coalesce(F.sum(F.col("_size") + len(GAP + MARK)).over(own), F.lit(0))).join(sums, ["_file", "_split"]).withColumn("_at", F.col("_at") + F.col("_from")).drop("_from")
    ends = placed.filter(short).select("_file", "_at", (F.col("_at") + F.col("_whole") + len(GAP + MARK)).alias("_end"))
    live = ends.repartition("_file").sortWithinPartitions("_file", "_at").mapInPandas(_first_ends, "_file string, _at long, _end long")
    known = placed.join(live, ["_file", "_at"], "left")
    outside = latest_before(known, ["_file"], ["_at"], "_split", "_end").filter("latest IS NULL OR latest <= _at")
    return pieces.join(files, "_file", "left_anti").unionByName(outside.select(pieces.columns))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, kind, url, date, status, headers, payload_digest, refers_to_url, refers_to_date of the responses and revisits in WARC files.

    Records of every version are read. kind is 'revisit' also for a response of
    status 304, which has no body of its own. Names of headers are in lower case;
    values of a repeated one are joined by commas. A field that a record lacks is
    null, a date that can't be read too. Records of other types are left out, and
    so is what stands before a file's first record. Bodies aren't kept. A record
    ends where its Content-Length says; one without ends at the next line that a
    record may begin with. Repeated records are rows of their own, ties don't
    occur. No files or empty ones: no rows. The heads of all records are written to
    the shared folder once.
    """
    text = spark.read.option("lineSep", GAP + MARK).text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"))
    # Behind the mark; only the heads are looked at, what stands before the second blank line.
    bare = text.withColumn("value", F.when(F.col("value").startswith(MARK), F.expr(f"substr(value, {len(MARK) + 1})")).otherwise(F.col("value")))
    heads = bare.select("_file", "_split", "_row", F.octet_length("value").cast("long").alias("_size"), F.substring_index("value", GAP, 2).alias("_two"))
    split = heads.withColumn("_head", F.substring_index("_two", GAP, 1)).filter(F.col("_head").rlike(r"^[0-9.]+\r\n")).withColumn("_http", F.expr("substr(_two, length(_head) + 5)")).drop("_two")
    whole = F.octet_length("_head") + len(GAP) + _field("Content-Length").try_cast("long")
    split = _records(Scratch(spark, "heads").write(split.withColumn("_whole", whole)))
    status = F.regexp_extract("_http", r"^HTTP/[\d.]+ (\d{3})", 1)
    lines = F.filter(F.split("_http", "\r?\n"), lambda x, i: (i > 0) & x.contains(":"))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, F.lit(":")) + 1)).alias("v")))
    made = split.select(
        F.regexp_replace(_field("WARC-Record-ID"), "^<|>$", "").alias("record_id"),
        F.when((_field("WARC-Type") == "response") & (status == "304"), "revisit").otherwise(_field("WARC-Type")).alias("kind"),
        _field("WARC-Target-URI").alias("url"),
        _date("WARC-Date").alias("date"),
        F.nullif(status, F.lit("")).cast("int").alias("status"),
        F.when(F.col("_http").startswith("HTTP/"), entries).otherwise(F.array().cast("array<struct<k:string,v:string>>")).alias("_entries"),
        _field("WARC-Payload-Digest").alias("payload_digest"),
        _field("WARC-Refers-To-Target-URI").alias("refers_to_url"),
        _date("WARC-Refers-To-Date").alias("refers_to_date"),
    )
    names = F.array_distinct(F.transform("_entries", lambda e: e["k"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter("_entries", lambda e: e["k"] == n), lambda e: e["v"]), ", "))
    return made.filter(F.col("kind").isin("response", "revisit")).withColumn("headers", F.map_from_arrays(names, values)).drop("_entries")


def _sliced(known: DataFrame, rows_per_slice: int) -> DataFrame:
    """known with ``_slice``, which rises with _asof: 0 for most URLs, about rows_per_slice rows to a slice for a URL of more.

    The edges of a URL's slices are quantiles of its own dates, so a burst is cut
    where it is dense. Records of one second stay together.
    """
    seconds = F.col("_asof").cast("double")
    counts = known.groupBy("canonical").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_slice)
    most = counts.agg(F.max("_n")).first()[0]
    if most is None:
        return known.withColumn("_slice", F.lit(0))
    n = -(-most // rows_per_slice)
    shares = F.array(*(F.lit(k / n) for k in range(1, n)))
    # A row for each URL of more than rows_per_slice records.
    edges = known.join(counts.select("canonical"), "canonical", "left_semi").groupBy("canonical").agg(F.percentile_approx(seconds, shares, F.lit(10 * n)).alias("_edges"))
    # Binary search: the number of edges that are not above the date.
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("_edges")) & (F.get("_edges", at + step - 1) <= seconds), at + step).otherwise(at))
    return known.join(edges, "canonical", "left").withColumn("_slice", F.when(F.col("_edges").isNotNull(), upto).otherwise(0)).drop("_edges")


def resolve_revisits(records: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """A row for each revisit: record_id, url, canonical, date, verdict, response_id, payload_digest, headers.

    records has record_id, kind ('response' or 'revisit'), url, date (timestamp),
    headers (map with lower-case keys), payload_digest and, if it likes,
    refers_to_url and refers_to_date: a revisit that names the capture it refers to
    is looked up by those, up to and including that date. Other kinds and columns
    are ignored. verdict: 'resolved'; 'no response'; 'validators differ' if the
    entity tags, the dates of modification or the digests, where both have them,
    aren't equal; 'no validator' if there is nothing to compare. Only resolved
    rows have response_id, payload_digest and headers, the response's with those
    of the revisit that may be renewed.

    Records of equal date are ordered by record_id. Null or blank url, or null
    date: 'no response', as a revisit, and never found, as a response. Null
    headers: none. Very long URLs and headers are taken whole. Repeated rows each
    give a row. No rows: no rows.
    """
    empty = F.create_map().cast("map<string,string>")
    for name, kind in (("refers_to_url", "string"), ("refers_to_date", "timestamp")):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    clean = records.filter(F.col("kind").isin("response", "revisit")).select("record_id", "kind", "url", "date", F.coalesce("headers", empty).alias("headers"), "payload_digest", "refers_to_url", "refers_to_date")
    refers = (F.col("kind") == "revisit") & F.col("refers_to_date").isNotNull()
    clean = clean.withColumn("canonical", canonical_url(F.when(F.col("kind") == "revisit", F.coalesce("refers_to_url", "url")).otherwise(F.col("url"))))
    clean = clean.withColumn("_asof", F.when(refers, F.least("refers_to_date", "date")).otherwise(F.col("date"))).withColumn("_behind", refers.cast("int")).drop("refers_to_url", "refers_to_date")
    usable = (F.col("canonical") != "") & F.col("date").isNotNull()
    known = _sliced(clean.filter(usable), rows_per_slice)
    known = known.withColumn("_response", F.when(F.col("kind") == "response", F.struct("record_id", "headers", "payload_digest")))
    found = latest_before(known, ["canonical"], ["_asof", "_behind", "record_id"], "_slice", "_response").filter("kind = 'revisit'").drop("_slice", "_response")
    lost = clean.filter(~F.coalesce(usable, F.lit(False)) & (F.col("kind") == "revisit"))
    rows = found.unionByName(lost, allowMissingColumns=True)

    theirs = F.col("latest.headers")
    pairs = [(_strong(F.col("headers")["etag"]), _strong(theirs["etag"])), (F.col("headers")["last-modified"], theirs["last-modified"]), (F.col("payload_digest"), F.col("latest.payload_digest"))]
    differ, agree = F.lit(False), F.lit(False)
    for mine, other in pairs:
        differ |= F.coalesce(mine != other, F.lit(False))
        agree |= F.coalesce(mine == other, F.lit(False))
    verdict = F.when(F.col("latest").isNull(), "no response").when(differ, "validators differ").when(agree, "resolved").otherwise("no validator")
    renewed = F.map_filter("headers", lambda k, _: k.isin(*RENEWABLE))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    resolved = F.col("verdict") == "resolved"
    return rows.withColumn("verdict", verdict).select(
        "record_id",
        "url",
        "canonical",
        "date",
        "verdict",
        F.when(resolved, F.col("latest.record_id")).alias("response_id"),
        F.when(resolved, F.col("latest.payload_digest")).alias("payload_digest"),
        F.when(resolved, merged).alias("headers"),
    )
