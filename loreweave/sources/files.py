"""Files as tables: text, CSV, Markdown and DOCX pages, JSON lines, graphs; and their sinks.

Spark reads the files; only byte formats that it can't read are parsed in tasks,
file by file.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.operators.chunking import chunk_pages, pages

# Fixed values.
CODECS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "big5", "shift_jis", "euc_kr", "utf-16", "cp1252", "latin-1")
MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json"}
ROWS_PER_PAGE = 20
PAGES = "path string, page_number int, section_title string, text string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.element_at(table, extension(path)), F.lit("application/octet-stream"))


def decode_bytes(raw: bytes) -> str:
    """UTF-8 or else the first codec that reads the bytes."""
    for codec in CODECS:
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return texts_of(read_bytes(spark, path))


def texts_of(files: DataFrame) -> DataFrame:
    """path, text of files (path, content). Valid UTF-8 is decoded by Spark, other bytes by the list of codecs."""
    files = files.withColumn("_ok", F.try_validate_utf8(F.col("content").cast("string")).isNotNull())

    def other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": b["content"].map(lambda x: decode_bytes(bytes(x)))})

    good = files.filter("_ok").select("path", F.col("content").cast("string").alias("text"))
    return good.unionByName(files.filter("NOT _ok").select("path", "content").mapInPandas(other, "path string, text string"))


def text_pages(texts: DataFrame) -> DataFrame:
    """path, page_number, section_title, text: paragraphs gathered to pages of 2000 characters."""
    return texts.select("path", F.posexplode(pages(F.col("text"))).alias("_n", "text")).select("path", (F.col("_n") + 1).alias("page_number"), F.lit(None).cast("string").alias("section_title"), "text")


def markdown_sections(texts: DataFrame) -> DataFrame:
    """A page from every line that starts with '# ' or '## ' to the next."""
    lines = F.split("text", "\n")
    heads = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("^##? ") | (i == 0), i)), lambda i: i.isNotNull())
    marked = texts.select("path", lines.alias("_l"), heads.alias("_h"))
    until = lambda k: F.coalesce(F.get(F.col("_h"), k + 1), F.size("_l"))
    cut = F.transform("_h", lambda a, k: F.struct(F.when(F.get(F.col("_l"), a).rlike("^##? "), F.regexp_replace(F.get(F.col("_l"), a), "^#+ +", "")).alias("title"), F.array_join(F.slice(F.col("_l"), a + 1, until(k) - a), "\n").alias("text")))
    kept = F.filter(cut, lambda s: F.trim(s["text"]) != "")
    return marked.select("path", F.posexplode(kept).alias("_n", "_s")).select("path", (F.col("_n") + 1).alias("page_number"), F.col("_s.title").alias("section_title"), F.col("_s.text").alias("text"))


def csv_pages(rows: DataFrame, order: str) -> DataFrame:
    """page_number, text, total_rows: pages of 20 rows, each row as 'name: value; name: value' without empty values."""
    names = [c for c in rows.columns if c != order]
    line = F.concat_ws("; ", *(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in names))
    page = F.floor(F.col(order) / ROWS_PER_PAGE).cast("int") + 1
    grouped = rows.groupBy(page.alias("page_number")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_r"))
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))  # one row
    return grouped.select("page_number", F.array_join(F.transform("_r", lambda r: r["l"]), "\n").alias("text")).join(F.broadcast(total))


def docx_sections(raw: bytes) -> list[tuple[str | None, str]]:
    """(heading, text) of a DOCX file, cut at paragraphs with a heading style."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    found: list[tuple[str | None, list[str]]] = []
    for p in body.iter(f"{space}p"):
        text = "".join(t.text or "" for t in p.iter(f"{space}t")).strip()
        style = p.find(f"{space}pPr/{space}pStyle")
        if style is not None and re.match("heading", style.get(f"{space}val", ""), re.I) and text:
            found.append((text, []))
        elif text:
            if not found:
                found.append((None, []))
            found[-1][1].append(text)
    return [(h, "\n".join(lines)) for h, lines in found if h or lines]


#: Parsers of byte formats, by extension; add to it what needs a library of its own.
PARSERS: dict[str, Callable[[bytes], list[tuple[str | None, str]]]] = {"docx": docx_sections}


def parsed_pages(files: DataFrame, kind: str) -> DataFrame:
    """Pages of files that have a parser; a file that can't be read gives a page that says so."""
    if kind not in PARSERS:
        raise ValueError(f"no parser for {kind}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, n, h, t) for n, (h, t) in enumerate(PARSERS[kind](bytes(raw)), 1)]
                except Exception as e:  # any damage of a file
                    rows.append((path, 1, None, f"[unreadable: {type(e).__name__}]"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "section_title", "text"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def document_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Pages of all files at path by their kind; unknown kinds raise."""
    if kind in ("txt", "text"):
        return text_pages(read_texts(spark, path))
    if kind in ("md", "markdown"):
        return markdown_sections(read_texts(spark, path))
    return parsed_pages(read_bytes(spark, path), kind)


def csv_rows(raw: bytes) -> list[tuple[str | None, str]]:
    """Pages of 20 rows of a CSV file with a head line, each row as 'name: value; name: value' without empty values."""
    rows = csv.DictReader(io.StringIO(decode_bytes(raw).removeprefix("\ufeff")))
    lines = ["; ".join(f"{k}: {v}" for k, v in r.items() if k and v) for r in rows]
    return [(None, "\n".join(lines[i : i + ROWS_PER_PAGE])) for i in range(0, len(lines), ROWS_PER_PAGE)]


PARSERS["csv"] = csv_rows


def folder_pages(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Pages of all files below path, each by its extension; unknown ones raise an error, or are read as text."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kinds = [r[0] for r in listed.select(extension(F.col("path"))).distinct().collect()]  # a row for each extension
    known = {"txt", "text", "md", "markdown", *PARSERS}
    if strict and set(kinds) - known:
        raise ValueError(f"no parser for {', '.join(sorted(set(kinds) - known))}")
    found = None
    for kind in sorted(kinds):
        files = listed.filter(extension(F.col("path")) == kind).select("path", "content")
        if kind in PARSERS:
            part = parsed_pages(files, kind)
        else:
            part = (markdown_sections if kind in ("md", "markdown") else text_pages)(texts_of(files))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], PAGES)


def chunk_folder(spark: SparkSession, path: str, strategy: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of all files below path: parsed by extension, cut by the strategy."""
    return chunk_pages(folder_pages(spark, path), "path", strategy, size, overlap)


AUDIT = "ts double, iso string, action string, username string, resource string, result string, detail string, ip string"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; bad ones are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file {"nodes": [...], "edges": [...]}."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.inline("nodes")), whole.select(F.inline("edges"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes in a folder for each base and category, those without a base in one of their own, and edges."""
    nodes.withColumn("base", F.col("kb_id")).write.mode("overwrite").partitionBy("base", "category").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph_tables(spark: SparkSession, path: str, kb_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that write_graph has written; of one base its documents, their edges and what these lead to."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if kb_id is None:
        return nodes.drop("base"), edges
    own = nodes.filter(F.col("base") == kb_id).drop("base")
    met = edges.join(own.select(F.col("id").alias("source")), "source", "left_semi")
    told = nodes.filter("base IS NULL").drop("base").join(met.select(F.col("target").alias("id")).distinct(), "id", "left_semi")
    return own.unionByName(told.select(own.columns)), met.select(edges.columns)


def read_columnar_store(stores: DataFrame) -> DataFrame:
    """Rows of a store of parallel lists (ids, chunks, embeddings); lists of unequal length raise."""
    same = (F.size("ids") == F.size("chunks")) & (F.size("ids") == F.size("embeddings"))
    checked = stores.withColumn("ids", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("lists of unequal length")).cast("array<string>")))
    return checked.select(F.inline(F.arrays_zip("ids", "chunks", "embeddings"))).select(F.col("ids").alias("chunk_id"), F.col("chunks").alias("content"), F.col("embeddings").alias("embedding"))


def export_chunks(chunks: DataFrame) -> DataFrame:
    """What a chunk export holds of chunks (chunk_id, doc_id, title, category, chunk_index, text): with a preview of 200 characters in one line."""
    return chunks.select("chunk_id", "doc_id", "title", "category", "chunk_index", F.length("text").alias("n_chars"), F.regexp_replace(F.substring("text", 1, 200), "\n", " ").alias("preview"))


def write_export(chunks: DataFrame, path: str) -> None:
    """The export as one CSV file, export.csv below path, with one head line that starts with a byte order mark, as spreadsheets like it.

    Tasks write their parts without heads beside it. The parts are then joined
    behind the head, by the file system itself where it can, else through a buffer
    of fixed size, and the whole takes its name when it is complete.
    """
    rows = export_chunks(chunks)
    context = chunks.sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join((path, *names)))
    fs = at().getFileSystem(conf)
    parts = f"_parts-{uuid.uuid4().hex}"
    rows.write.option("escape", '"').csv(f"{path}/{parts}")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(parts)) if f.getPath().getName().startswith("part-") and f.getLen())

    def begun():
        out = fs.create(at(parts, "export.csv"), True)
        out.write(bytearray(("\ufeff" + ",".join(rows.columns) + "\n").encode()))
        return out

    begun().close()
    try:
        if names:
            joined = context._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(names))
            for k, name in enumerate(names):
                joined[k] = at(parts, name)
            fs.concat(at(parts, "export.csv"), joined)
    except UnsupportedOperationException:
        out = begun()
        for n in names:
            part = fs.open(at(parts, n))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.close()
    fs.delete(at("export.csv"), False)
    fs.rename(at(parts, "export.csv"), at("export.csv"))
    fs.delete(at(parts), True)


def replace_documents(docs: DataFrame, path: str) -> None:
    """All documents at path give way to docs; docs must not be read from there."""
    docs.write.mode("overwrite").parquet(path)


def newest_operations(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def save_operations(saved: DataFrame, log: DataFrame, n: int = 10) -> DataFrame:
    """saved and those of the last n operations of log that it hasn't, told by operator, action and time."""
    keys = ["operator", "action", "ts"]
    return saved.unionByName(newest_operations(log, n).join(saved.select(*keys), keys, "left_anti").select(saved.columns))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The bases of a registry: JSON objects with id, name, description, created_at, doc_count."""
    return spark.read.schema("id string, name string, description string, created_at string, doc_count int").option("multiLine", True).json(path)


def append_lines(lines: DataFrame, path: str) -> None:
    """Lines (value) behind those of a text log."""
    lines.select("value").write.mode("append").text(path)


def oldest_operations(log: DataFrame, n: int = 500) -> DataFrame:
    return log.orderBy("ts", "event_id").limit(n)


def continued_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """chunk ids '<key>_chunk_<n>' in order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), (F.row_number().over(w) - 1).cast("string")))
