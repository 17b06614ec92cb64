"""Secret scans with an incremental ledger of blobs, in Spark expressions only.

Every version of a text is addressed by the SHA-256 of its content. A blob is
scanned by a rule version once: pairs that the ledger knows are skipped, copies
of a blob share one scan, and findings are joined back to all paths. A ledger row
says which rule versions a scan of a blob applied and what each of them found, so
findings of a replaced rule version don't outlive it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of


@dataclass(frozen=True)
class SecretRule:
    """Matches of pattern whose group ``group`` has ``least`` characters or more. ``mark`` is in every text with a match."""

    kind: str
    version: str
    pattern: str
    group: int = 0
    least: int = 1
    mark: str = ""


# The base patterns. A run of one character class is matched whole, so
# the least length of the last two can stand in the pattern itself.
RULES = (
    SecretRule("assign", "1", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    SecretRule("access", "1", r"AKIA[A-Z0-9]{16,}", mark="AKIA"),
    SecretRule("hex", "1", r"[0-9a-f]{24,}", mark="[0-9a-f]{24}"),
)
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,version:string>>"


def spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """The rule's spans in code points.

    The text between matches and the matches give the places by their lengths.
    """
    pattern = F.lit(rule.pattern)
    between, found, inside = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("a"), found.alias("b"), inside.alias("c"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(done: Column, piece: Column) -> Column:
        start = done["at"] + F.length(piece["0"])
        end = start + F.length(piece["1"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))
        return F.struct(end.alias("at"), F.when(F.length(piece["2"]) >= rule.least, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    pieces = F.transform(pieces, lambda p: F.struct(p["a"].alias("0"), p["b"].alias("1"), p["c"].alias("2")))
    return F.when(text.rlike(rule.pattern), F.aggregate(pieces, nothing, step, lambda x: x["spans"])).otherwise(F.array().cast(SPANS))


def addressed(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs with ``blob``, the address of the content, and ``marked``: whether a rule can match at all. Null text is the empty text."""
    marks = reduce(lambda a, b: a | b, (text_of().rlike(r.mark) if r.mark else F.lit(True) for r in rules))
    return docs.withColumn("blob", F.sha2(text_of(), 256)).withColumn("marked", marks)


def rule_ids(rules: tuple[SecretRule, ...]) -> list[str]:
    return [f"{r.kind}@{r.version}" for r in rules]


def scan_unseen(versions: DataFrame, rules: tuple[SecretRule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """What to append to the ledger: blob, scanned (array of kind@version), spans, for blobs that some rule version hasn't seen.

    ``versions`` is what addressed gives, of docs with doc_id and text; ``ledger`` has
    rows of earlier scans, a blob in any number of them. Of copies the row of the
    least doc_id is scanned. Addresses and ids are shuffled, and of the texts only
    those with a mark: the others can't have a match of any rule. Each span has the
    version of its rule. Spans are sorted by start, then by the order of the rules.
    """
    scratch = Scratch(versions.sparkSession, "secrets")
    ids = rule_ids(rules)
    none = F.array().cast("array<string>")
    me = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    blobs = versions.groupBy("blob").agg(F.min(me).alias("_first"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("_seen"))
        blobs = blobs.join(seen.hint("merge"), "blob", "left").withColumn("_seen", F.coalesce("_seen", none))
    else:
        blobs = blobs.withColumn("_seen", none)
    todo = blobs.select("blob", F.col("_first.doc_id").alias("_first"), F.array_except(F.array(*map(F.lit, ids)), F.col("_seen")).alias("scanned")).filter(F.size("scanned") > 0)
    todo = scratch.write(todo)
    texts = versions.filter("marked").select("blob", "doc_id", text_of().alias("_text"))
    # The same plan at any size: the marked texts are the smaller part, not always a small one.
    texts = texts.join(todo.hint("merge"), "blob").filter(F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["blob"])  # repeated rows
    spans = [F.when(F.array_contains("scanned", i), spans_of(F.col("_text"), r, k)).otherwise(F.array().cast(SPANS)) for k, (i, r) in enumerate(zip(ids, rules, strict=True))]
    found = scratch.write(texts.select("blob", F.sort_array(F.concat(*spans)).alias("spans")).filter(F.size("spans") > 0))
    return todo.select("blob", "scanned").join(found.hint("merge"), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def findings(ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """blob, spans for blobs in which a rule of this version found something; what replaced versions found is left out."""
    current = F.array(*map(F.lit, rule_ids(rules)))
    held = ledger.select("blob", F.filter("spans", lambda s: F.array_contains(current, F.concat_ws("@", s["kind"], s["version"]))).alias("spans")).filter(F.size("spans") > 0)
    return held.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def on_paths(versions: DataFrame, found: DataFrame) -> DataFrame:
    """versions (blob, marked and others) with ``spans``, empty where found (blob, spans) has none.

    found is written first: it is then a plain side of the join, whose hot blobs
    Spark can split. Rows without a mark have no spans and bypass the join.
    """
    found = Scratch(versions.sparkSession, "findings").write(found)
    joined = versions.filter("marked").join(found.hint("merge"), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return versions.filter("NOT marked").withColumn("spans", F.array().cast(SPANS)).unionByName(joined)


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """docs with ``blob`` and ``spans``: what the rules find now and what the ledger holds of them.

    docs has doc_id and text; ``ledger`` is what earlier calls of scan_unseen gave.
    Null and empty texts have no spans; copies share their blob's; overlapping
    spans of different rules all stay. A null doc_id is an id like others. Repeated
    rows are kept. Very long texts are scanned whole; a text's matches are put
    together one by one, so the cost of a text grows with the square of its number
    of matches. A column of docs named blob, marked or spans is replaced, others
    stay. No rows: no rows.
    """
    versions = addressed(docs.drop("blob", "marked", "spans"), rules)
    scans = scan_unseen(versions, rules, ledger)
    if ledger is not None:
        scans = scans.unionByName(ledger.select("blob", "scanned", "spans").join(versions.select("blob").distinct(), "blob", "left_semi"))
    return on_paths(versions, findings(scans, rules)).drop("marked")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every maximal run of overlapping spans replaced by the mark."""
    nothing = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        gap = F.concat(done["out"], F.substr(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mark))
        return F.struct(F.when(s["start"] >= done["at"], gap).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, nothing, step, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1)))).otherwise(text)


def counts(kinds: tuple[str, ...] = ("assign", "access", "hex")) -> dict[str, Column]:
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return {f"n_{k}": of(k) for k in kinds}


def base_spans(kinds: tuple[str, ...] = ("assign", "access", "hex")) -> Column:
    return F.filter("spans", lambda s: reduce(lambda a, b: a | b, (s["kind"] == k for k in kinds)))
