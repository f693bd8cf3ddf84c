"""File sources and sinks: tables, CSV days, archives, logs of what is done."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands for a missing cell.
NULLS = ("", "NA", "na")
# The name of a null partition.
NO_ARCHIVE = "__HIVE_DEFAULT_PARTITION__"


def flatten(df: DataFrame, at: str = "") -> list[Column]:
    """Columns of a frame with its structs taken apart, named by their path with _."""
    out = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, [*path, f.name])
            else:
                out.append(F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias("_".join([*path, f.name])))

    walk(df.schema, [])
    return out


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _hadoop(spark, path)
    return bool(files.exists(hadoop))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    hadoop, files = _hadoop(spark, path)
    return int(files.getContentSummary(hadoop).getLength())


def cached(spark: SparkSession, path: str, make, rebuild: bool = False) -> DataFrame:
    """The Parquet at path; made and written there first if absent or to be rebuilt."""
    if rebuild or not exists(spark, path):
        export_parquet(make(), path)
    return spark.read.parquet(path)


def export_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def load_parquet(spark: SparkSession, path: str, table: str) -> int:
    """Replace a catalog table by the Parquet at path; its rows."""
    spark.read.parquet(path).write.mode("overwrite").format("parquet").saveAsTable(table)
    return spark.table(table).count()


def run_verified(df: DataFrame, path: str, rows: tuple[int, int] | None = None, size: tuple[int, int] | None = None) -> dict:
    """Write df to path and check the rows and bytes that arrived against ranges: seconds, rows, bytes, ok."""
    t = time.time()
    export_parquet(df, path)
    spark = df.sparkSession
    n, b = spark.read.parquet(path).count(), size_of(spark, path)
    ok = (rows is None or rows[0] <= n <= rows[1]) and (size is None or size[0] <= b <= size[1])
    return {"seconds": time.time() - t, "rows": n, "bytes": b, "ok": ok}


def local(spark: SparkSession, text: str, most: int = 1_000_000) -> pd.DataFrame:
    """Result of an SQL text on the driver; more than `most` rows are an error."""
    out = spark.sql(text).limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"the result has more than {most} rows")
    return out


def run_ddl(spark: SparkSession, script: str) -> int:
    """Run the statements of a script, separated by ; at line ends. How many they were."""
    statements = [x.strip() for x in re.split(r";\s*(?:\n|$)", script) if x.strip()]
    for x in statements:
        spark.sql(x)
    return len(statements)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def row_count(spark: SparkSession, name: str) -> int:
    return spark.table(name).count()


def scan(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Lazy scan of a file, folder, glob or list of them; only these columns are read."""
    d = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return d if columns is None else d.select(*[f"`{c}`" for c in columns])


def schema_of(spark: SparkSession, path: str) -> DataFrame:
    """name, type of a Parquet's columns, from its footer."""
    d = spark.read.parquet(path)
    return spark.createDataFrame(d.dtypes, "name string, type string")


def stream_to_parquet(df: DataFrame, path: str, checkpoint: str):
    """Append a streaming frame to Parquet files, exactly once; the started query, over what is available now."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_text(df: DataFrame, path: str, kind: str) -> None:
    """CSV with a header, or JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    w = df.write.mode("overwrite")
    (w.option("header", True).csv if kind == "csv" else w.json)(path)


def timed(df: DataFrame) -> dict:
    """Seconds and rows of running a frame."""
    t = time.time()
    n = df.count()
    return {"seconds": time.time() - t, "rows": n}


def dtype_of(column: str) -> str:
    """SMART columns by suffix, the rest by name."""
    if column.endswith("_normalized"):
        return "short"
    if column.endswith("_raw") or column == "capacity_bytes":
        return "long"
    return {"date": "date", "failure": "int"}.get(column, "string")


def _typed(column: str, strict: bool) -> Column:
    value = F.trim(F.col(f"`{column}`"))
    value = F.when(value.isin(*NULLS), None).otherwise(value)
    kind = dtype_of(column)
    return (value if kind == "string" else value.cast(kind) if strict else value.try_cast(kind)).alias(column)


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("lineSep", "\n").text(path).limit(1).first()
    return [c.strip().strip('"') for c in first["value"].rstrip("\r").split(",")] if first else []


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], strict: bool = True) -> DataFrame:
    """CSV files with a header, their columns found by name: files may have other orders, more columns or fewer (null).
    Cells in NULLS are null. strict: a cell that doesn't fit its type raises, else it is null. A folder's or glob's files
    share a header; a list is read file by file."""
    out = None
    for p in [path] if isinstance(path, str) else path:
        names = _header(spark, p)
        raw = spark.read.option("header", True).option("enforceSchema", False).schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(p)
        raw = raw.select(*[F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in columns])
        one = raw.select(*[_typed(c, strict) for c in columns])
        out = one if out is None else out.unionByName(one)
    return out


def sane_headers(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """path, columns, sane: a first line that ends in time and has the expected number of fields. Only first lines are
    kept; a file without a line end is one long line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.substring("value", 1, 65536).alias("value"), F.length("value").alias("n"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by(F.struct("value", "n"), "id").alias("f"))
    head = F.regexp_replace("f.value", "\r$", "")
    n = F.size(F.split(head, ","))
    return first.select("path", n.alias("columns"), ((n == expected) & ~head.contains("\r") & (F.col("f.n") < 65536)).alias("sane"))


class _Written:
    """Bytes written to an archive and not given away yet."""

    def __init__(self) -> None:
        self.data = bytearray()

    def write(self, x) -> int:
        self.data += x
        return len(x)

    def flush(self) -> None:
        pass


def zip_files(df: DataFrame, archive: str, file: str, row: str, header: str, path: str) -> dict[str, str]:
    """Archives of CSV files below path: archive -> path. df has a row's archive (null: Hive's name for null), file and
    text; a task writes an archive as it reads its rows, so no archive is held whole and none passes the driver.

    Archives are binary, and only the text writer puts plain bytes on any file system: it ends each of its rows with a
    line feed, so the bytes are cut at the line feeds they have, and an archive's own last byte is one (its comment)."""
    spark = df.sparkSession
    name = F.coalesce(F.col(archive).cast("string"), F.lit(NO_ARCHIVE))
    names = sorted(r["a"] for r in df.select(name.alias("a")).distinct().collect())  # one row per archive
    if not names:
        return {}
    at = F.array_position(F.lit(names), name).cast("int") - 1
    rows = df.select(at.alias("at"), F.col(file).cast("string").alias("file"), F.col(row).alias("row"))
    rows = rows.repartitionById(len(names), F.col("at")).sortWithinPartitions("file", "row").select("file", "row")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, current, member = _Written(), None, None
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            z.comment = b"\n"
            for f in frames:
                for x, part in f.groupby("file", sort=False):
                    if x != current:
                        if member is not None:
                            member.close()
                        current, member = x, z.open(x, "w", force_zip64=True)
                        member.write(f"{header}\n".encode())
                    member.write(("\n".join(part["row"]) + "\n").encode())
                cut = out.data.rfind(b"\n")
                if cut > 1 << 20:
                    yield pd.DataFrame({"content": [bytes(out.data[:cut])]})
                    del out.data[: cut + 1]
            if member is not None:
                member.close()
        if member is not None:
            yield pd.DataFrame({"content": [bytes(out.data[:-1])]})

    rows.mapInPandas(run, "content binary").select(F.col("content").cast("string")).write.mode("overwrite").option("compression", "none").text(path)
    folder, hadoop = _hadoop(spark, path)
    written = [str(f.getPath().toString()) for f in hadoop.listStatus(folder)]
    parts = {int(m.group(1)): p for p in written if (m := re.search(r"/part-(\d+)-[^/]*$", p))}
    return {a: parts[i] for i, a in enumerate(names)}


def unzip_days(spark: SparkSession, path: str, headers: bool = False) -> DataFrame:
    """file, line, row: the lines of all CSV files in the archives at path, header first, read by the executors. headers:
    the first lines only, without unpacking the rest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for blob in f["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX")):
                        at = 0
                        with z.open(name) as lines:
                            text = io.TextIOWrapper(lines, "utf-8", errors="replace", newline="")
                            while part := [text.readline()] if headers else text.readlines(1 << 20):
                                if not part[0]:
                                    break
                                yield pd.DataFrame({"file": name, "line": range(at, at + len(part)), "row": [x.rstrip("\r\n") for x in part]})
                                at += len(part)
                                if headers:
                                    break

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, line long, row string")


def typed_days(lines: DataFrame, columns: list[str], strict: bool = False, headers: DataFrame | None = None) -> DataFrame:
    """file and typed columns of the lines of unzip_days, each file's columns found by the names in its own header
    (headers: these lines, where they are known)."""
    headers = F.broadcast((lines if headers is None else headers).where("line = 0").select("file", F.split("row", ",").alias("__names")))
    cells = lines.where("line > 0 and row <> ''").join(headers, "file").withColumn("__cells", F.split("row", ",", -1))
    at = lambda c: F.array_position("__names", c)
    raw = cells.select("file", *[F.when(at(c) > 0, F.get("__cells", F.greatest(at(c) - 1, F.lit(0)).cast("int"))).alias(c) for c in columns])
    return raw.select("file", *[_typed(c, strict) for c in columns])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of work done: id, status, rows; empty where there is none yet."""
    kind = "id string, status string, rows long"
    return spark.read.schema(kind).json(path) if exists(spark, path) else spark.createDataFrame([], kind)


def log_done(spark: SparkSession, path: str, item: str, status: str, rows: int) -> None:
    """Append an outcome to the log: a small file of its own, so a failed run loses nothing."""
    spark.createDataFrame([(item, status, rows)], "id string, status string, rows long").coalesce(1).write.mode("append").json(path)


def ingest_quarters(spark: SparkSession, archives: dict[str, str], out: str, log: str, columns: list[str] | None = None) -> dict[str, int]:
    """Archives of daily CSV files (quarter -> path) to a Parquet folder per quarter: typed rows, the columns of the
    quarter's first day (or those given), days whose cells don't fit read leniently. Quarters that the log lists as
    completed are passed over; each is logged when it is written, failures as well. Rows of each quarter done now."""
    todo = spark.createDataFrame([(q,) for q in archives], "id string")
    left = sorted(r["id"] for r in outstanding(todo, read_log(spark, log), "id").collect())  # one row per archive
    done = {}
    for q in left:
        try:
            lines = unzip_days(spark, archives[q])
            heads = sorted(unzip_days(spark, archives[q], headers=True).collect(), key=lambda r: r["file"])  # one row per day
            names = columns
            if names is None:
                if not heads:
                    raise ValueError(f"no CSV file in {archives[q]}")
                names = [c.strip() for c in heads[0]["row"].split(",")]
            headers = spark.createDataFrame(heads, lines.schema)
            export_parquet(typed_days(lines, names, headers=headers).drop("file"), f"{out}/quarter={q}")
            done[q] = spark.read.parquet(f"{out}/quarter={q}").count()
            log_done(spark, log, q, "completed", done[q])
        except Exception:
            log_done(spark, log, q, "failed", 0)
            raise
    return done


def outstanding(todo: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """What a log doesn't list as completed yet."""
    return todo.join(log.where("status = 'completed'").select(key), key, "left_anti")


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns it lacks as nulls of their type, in this order first."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()], *rest)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files: a registry of frozen artefacts."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Registry:
    """Frozen artefacts by name: looked for in folders in order, their SHA-256 held against the one recorded."""

    def __init__(self, spark: SparkSession, folders: list[str], known: dict[str, str]):
        self.spark, self.folders, self.known = spark, folders, known
        self.warnings: list[str] = []

    def find(self, name: str) -> str:
        """The first folder's path that has the file; FileNotFoundError if none has."""
        for f in self.folders:
            if exists(self.spark, f"{f}/{name}"):
                return f"{f}/{name}"
        raise FileNotFoundError(name)

    def check(self, name: str) -> bool:
        """Whether the file is the one recorded; if not, a warning says so."""
        found = checksums(self.spark, self.find(name)).first()["sha256"]
        if name not in self.known:
            self.warnings.append(f"{name}: not recorded, now {found}")
            return False
        if found != self.known[name]:
            self.warnings.append(f"{name}: recorded as {self.known[name]}, now {found}")
        return found == self.known[name]

    def save(self, path: str) -> None:
        self.spark.createDataFrame([(json.dumps(self.known, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows)


def catalog_info(spark: SparkSession, table: str) -> DataFrame:
    """name, type, mode (REQUIRED, NULLABLE, REPEATED) of a table's columns."""
    mode = lambda k, nullable: "REPEATED" if k.startswith("array") else "NULLABLE" if nullable else "REQUIRED"
    rows = [(f.name, f.dataType.simpleString(), mode(f.dataType.simpleString(), f.nullable)) for f in spark.table(table).schema.fields]
    return spark.createDataFrame(rows, "name string, type string, mode string")


def table_metadata(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One row: name, columns, rows, bytes of a Parquet table."""
    d = spark.read.parquet(path)
    return d.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(len(d.columns)).alias("columns"), "rows", F.lit(size_of(spark, path)).alias("bytes"))
