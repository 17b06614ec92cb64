"""Migration of seven kinds of JSON stores into typed tables, from declared mappings.

A store is a table of entries, a key and a JSON object each. A mapping names the
fields with their types and defaults; an entry that lacks a required field, or
whose value has not its type, is listed with the reason and not migrated. Rows
whose key is there already are skipped, so a migration can be run again; a ledger
of digests of the stores skips the work altogether.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources.checkpoints import written_once
from loreweave.sources.files import read_columnar_store
from loreweave.sources.versioned import FileTable

#: Dates may be written so; others count as none.
DATES = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")
REST = "map<string,string>"
LEDGER = "entity string, digest string, n_read long, n_added long, n_rejected long"
REJECTS = "entity string, key string, problem string, entry string"


@dataclass(frozen=True)
class Field:
    """A column, the type of its values, and the value of an entry without it. A required one has none."""

    name: str
    kind: str = "string"
    default: object = None
    required: bool = False
    source: str | None = None

    @property
    def key(self) -> str:
        return self.source or self.name


@dataclass(frozen=True)
class Entity:
    """A kind of store. Its id is a field of the entry, if ``own`` names one and the entry has it, else the entry's key.

    rest: the column that holds the fields which ``apart`` doesn't name.
    """

    name: str
    fields: tuple[Field, ...]
    own: str | None = None
    rest: str | None = None
    apart: tuple[str, ...] = ()


_LOG = ("time", "operator", "action", "doc_ids", "target", "migrated_count", "skipped_count", "chunks_updated")
ENTITIES = {
    e.name: e
    for e in (
        Entity(
            "users",
            (
                Field("username", required=True),
                Field("password_hash", required=True),
                Field("email", default=""),
                Field("display_name", default=""),
                Field("roles", "array<string>", ()),
                Field("status", default="active"),
                Field("created_at", "timestamp"),
                Field("last_login", "timestamp"),
            ),
            own="id",
        ),
        Entity("categories", (Field("strategy", default="recursive"), Field("chunk_size", "int", 500), Field("overlap", "int", 100))),
        Entity(
            "references",
            (
                Field("title", default=""),
                Field("authors", "array<string>", ()),
                Field("year", "int", 0),
                Field("venue", default=""),
                Field("url", default=""),
                Field("doi", default=""),
                Field("kind", default="paper", source="type"),
                Field("abstract", default=""),
                Field("created_at", "timestamp"),
            ),
            own="id",
        ),
        Entity(
            "documents",
            (
                Field("title", default=""),
                Field("content", default=""),
                Field("kb_id", default="default", source="knowledge_base_id"),
                Field("file_name", default=""),
                Field("file_type", default=""),
                Field("category", default=""),
                Field("created_at", "timestamp"),
                Field("updated_at", "timestamp"),
            ),
            rest="extra",
            apart=("title", "content"),
        ),
        Entity(
            "document_versions",
            (
                Field("doc_id", required=True),
                Field("version", "int", 0),
                Field("content", default=""),
                Field("extra", REST, {}, source="metadata"),
                Field("changed_by", default=""),
                Field("change_note", default=""),
                Field("created_at", "timestamp"),
            ),
            own="id",
        ),
        Entity(
            "op_log",
            (
                Field("time", "timestamp"),
                Field("operator", default=""),
                Field("action", default=""),
                Field("doc_ids", "array<string>", ()),
                Field("target", default=""),
                Field("migrated_count", "int", 0),
                Field("skipped_count", "int", 0),
                Field("chunks_updated", "int", 0),
            ),
            rest="extra",
            apart=_LOG,
        ),
        Entity("chat_stats", (Field("total_sessions", "int", 0), Field("total_messages", "int", 0))),
    )
}


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, entry of files that hold one object each, entries by their keys. Such a file is one value."""
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", REST)).alias("key", "entry"))


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, entry of files that hold a list; the key is the place in it and the entry's digest, so a longer list adds what is new."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<string>")).alias("_n", "entry"))
    return rows.select(F.concat_ws(":", F.col("_n").cast("string"), F.sha2("entry", 256)).alias("key"), "entry")


def single_entry(spark: SparkSession, path: str) -> DataFrame:
    """key, entry of a file that is one object: the one row of its table."""
    return spark.read.option("wholetext", True).text(path).select(F.lit("1").alias("key"), F.col("value").alias("entry"))


def version_entries(stores: DataFrame) -> DataFrame:
    """key, entry of versions from entries that are lists, by their document: it and its number make the key of one without an id."""
    each = stores.select("key", F.explode(F.from_json("entry", "array<string>")).alias("entry"))
    fields = F.from_json("entry", REST)
    own = F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != "doc_id"), F.create_map(F.lit("doc_id"), F.coalesce(fields["doc_id"], F.col("key")))))
    return each.select(F.concat(F.col("key"), F.lit("-v"), F.coalesce(fields["version"], F.lit("0"))).alias("key"), own.alias("entry"))


def _default(field: Field) -> Column:
    if field.kind == "array<string>":
        return F.array().cast(field.kind)
    return F.from_json(F.lit("{}"), REST) if field.kind == REST else F.lit(field.default).cast(field.kind)


def _typed(field: Field, raw: Column) -> Column:
    """The value in its type, or null."""
    if field.kind == "timestamp":
        return F.coalesce(*(F.try_to_timestamp(raw, F.lit(d)) for d in DATES))
    return F.from_json(raw, field.kind) if field.kind in ("array<string>", REST) else raw.try_cast(field.kind)


def mapped(entity: Entity, entries: DataFrame) -> DataFrame:
    """id, the entity's columns, _problem, _key and _entry for each entry (key, entry).

    An entry without a field has its default, one whose field is null has null. A
    date that can't be read is none; every other value that has not its type is a
    problem, and so are an entry that is no object, a missing key and a missing
    required field. Of several problems the first field's is named.
    """
    given = entries.select(F.col("key").cast("string").alias("_key"), F.col("entry").alias("_entry"), F.from_json("entry", REST).alias("_f"))
    raw = lambda f: F.col("_f")[f.key]
    has = lambda f: F.map_contains_key("_f", F.lit(f.key))
    value = lambda f: F.when(has(f), _typed(f, raw(f))).otherwise(_default(f))
    problems = [F.when(F.col("_key").isNull(), "no key"), F.when(F.col("_f").isNull(), "no object")]
    for f in entity.fields:
        if f.required:
            problems.append(F.when(raw(f).isNull(), f"no {f.key}"))
        if f.kind not in ("string", "timestamp"):
            problems.append(F.when(raw(f).isNotNull() & _typed(f, raw(f)).isNull(), f"{f.key} is no {f.kind}"))
    own = F.coalesce(F.col("_f")[entity.own], F.col("_key")) if entity.own else F.col("_key")
    rest = [F.map_filter("_f", lambda k, _: ~k.isin(list(entity.apart))).alias(entity.rest)] if entity.rest else []
    return given.select(own.alias("id"), *(value(f).alias(f.name) for f in entity.fields), *rest, F.coalesce(*problems).alias("_problem"), "_key", "_entry")


class Migration:
    """Tables of the entities, their rejects and the ledger below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str, schema) -> FileTable:
        found = FileTable(self.spark, f"{self.folder}/{name}")
        if not found.versions():
            found.create(self.spark.createDataFrame([], schema))
        return found

    def run(self, entity: Entity, entries: DataFrame) -> tuple[int, int, int]:
        """How many entries are read, added and rejected; a store that the ledger has is not read again.

        Rows are added first and the ledger last, so a run that breaks off is made
        up for by the next. Of entries of one id one is added.
        """
        ledger, rejects = self.table("ledger", LEDGER), self.table("rejects", REJECTS)
        row = F.sha2(F.to_json(F.struct("key", "entry")), 256)
        word = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38, 0)")).cast("string")
        digest = "-".join(str(x) for x in entries.agg(F.count(F.lit(1)), *(word(i) for i in range(4))).first())
        if not ledger.read().filter((F.col("entity") == entity.name) & (F.col("digest") == digest)).isEmpty():
            return 0, 0, 0
        # Mapped once: a filter on top would be pushed below and parse each entry again for every field that it names.
        rows = mapped(entity, entries)
        rows = written_once(rows.withColumn("_entry", F.when(F.col("_problem").isNotNull(), F.col("_entry"))))
        columns = [c for c in rows.columns if not c.startswith("_")]
        target = self.table(entity.name, rows.select(*columns).schema)
        good = rows.filter("_problem IS NULL").select(*columns).dropDuplicates(["id"])
        added = target.append(good.join(target.read().select("id"), "id", "left_anti"))
        bad = rows.filter("_problem IS NOT NULL").select(F.lit(entity.name).alias("entity"), F.col("_key").alias("key"), F.col("_problem").alias("problem"), F.col("_entry").alias("entry"))
        known = rejects.read().select(*(F.col(c).alias(f"_{c}") for c in ("entity", "key", "problem", "entry")))
        same = reduce(Column.__and__, (bad[c].eqNullSafe(known[f"_{c}"]) for c in ("entity", "key", "problem", "entry")))
        rejected = rejects.append(bad.join(known, same, "left_anti"))
        read = int(digest.split("-")[0])
        ledger.append(self.spark.createDataFrame([(entity.name, digest, read, added, rejected)], LEDGER))
        return read, added, rejected

    def store(self, stores: DataFrame, name: str = "chunks", force: bool = False) -> int:
        """How many chunks come from stores of parallel lists (see read_columnar_store).

        None, if there are chunks already and it isn't forced, or if any store's lists
        are of unequal length. Forced, chunks whose id is there are not added again.
        """
        schema = "chunk_id string, content string, embedding array<double>"
        target = self.table(name, schema)
        if (not force and not target.read().isEmpty()) or not stores.filter((F.size("ids") != F.size("chunks")) | (F.size("ids") != F.size("embeddings"))).isEmpty():
            return 0
        rows = read_columnar_store(stores).select("chunk_id", "content", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["chunk_id"])
        return target.append(rows.join(target.read().select("chunk_id"), "chunk_id", "left_anti"))
