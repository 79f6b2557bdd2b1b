"""Table files: Parquet, CSV, JSON and Arrow, by path or glob, local or object store."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tabforge.functions import workspace
from tabforge.functions.text import DEFAULT_PATH_FORMAT, PATH_FORMATS
from tabforge.functions.types import common_type
from tabforge.operators.combine import stack_by_name

# File suffix to reader.
SUFFIX_READERS = {
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "json",
    ".xlsx": "excel",
    ".xls": "excel",
    ".feather": "arrow",
    ".arrow": "arrow",
}

READ_BYTES_PER_TASK = 128 << 20


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """Parquet files; without a schema, the union of the columns of all files.

    Footers are merged in a Spark job.  Types that do not merge are widened, or become text, by reading
    the files of each schema apart.
    """
    given, paths = paths, expand(spark, *paths)
    reader = spark.read.options(**options)
    groups = []
    if any(map(_GLOB.search, given)):
        files = list_files(spark, *paths, recursive=False).select(F.col("path").alias("file"))
        groups = _by_group(files, [], paths, given, _bases(spark, given, options))
    frames = []
    for _, found, names, types in groups or [((), paths, {}, {})]:
        types = types | {f.name: f.dataType for f in schema or []}
        here = reader if not names else spark.read.options(**_listed(options))
        if schema:
            frames.append(_with_path_columns(here.schema(schema).parquet(*found), names, types))
            continue
        try:
            frames.append(_with_path_columns(here.option("mergeSchema", True).parquet(*found), names, types))
        except (PySparkException, Py4JJavaError) as error:
            if "MERGE" not in str(error).upper():
                raise
            frames += _each_schema(spark, found, _bases(spark, given, options), options)
    return frames[0] if len(frames) == 1 else stack_by_name(frames)


def _each_schema(spark: SparkSession, paths: Sequence[str], bases: Sequence[str], options: dict) -> list[DataFrame]:
    """The files of each schema, with the columns that only their paths hold.

    Tasks read the footers; Spark then infers one schema for each different footer, so the jobs do not grow with the files.
    """
    def footers(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            kinds = [_footer_kind(path, options) for path in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string())], names=["file", "names", "kind"])

    facts = list_files(spark, *paths).select(F.col("path").alias("file"), _path_names(F.col("path"), bases).alias("names"))
    types = _path_types(facts, bases)
    found = facts.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(
        footers, "file string, names string, kind string")
    kinds: dict[tuple[str, str], list[str]] = {}
    for r in found.orderBy("file").collect():
        kinds.setdefault((r.kind, r.names), []).append(r.file)
    reader = spark.read.options(**_listed(options)).option("mergeSchema", False)
    groups: dict[tuple[str, str], tuple[T.StructType, list[str]]] = {}
    for (_, names), same in kinds.items():
        schema = reader.parquet(same[0]).schema
        groups.setdefault((schema.json(), names), (schema, []))[1].extend(same)
    return [_with_path_columns(reader.schema(schema).parquet(*same), _path_columns(names, bases), types)
            for (_, names), (schema, same) in groups.items()]


def _footer_kind(path: str, options: dict) -> str:
    """Digest of the schema in a Parquet footer; a file that cannot be opened here is a kind of its own."""
    try:
        with _open(path, options) as f:
            footer = pq.ParquetFile(f)
            # The first line holds the address of the object.
            columns = str(footer.schema).partition("\n")[2]
            written = (footer.metadata.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
    except (OSError, pa.ArrowException):
        return path
    return hashlib.sha256(columns.encode() + written).hexdigest()


# Letters that make a path a glob.
_GLOB = re.compile(r"[*?{\[]")


def _bases(spark: SparkSession, paths: Sequence[str], options: dict) -> list[str]:
    """Folders below which folder names like ``r=EU`` are columns: the given paths, or their parts before a glob."""
    named = {k.lower(): v for k, v in options.items()}
    if str(named.get("recursivefilelookup", "")).lower() == "true":
        return []
    roots = []
    for path in [named["basepath"]] if "basepath" in named else paths:
        parts = path.split("/")
        at = next((i for i, part in enumerate(parts) if _GLOB.search(part)), len(parts))
        roots.append("/".join(parts[:at]) or ("/" if path.startswith("/") else "."))
    # Other stores need options to be opened; their paths are complete as they are.
    remote = re.compile(r"(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*:")
    return sorted({(r if remote.match(r) else workspace.qualified(spark, r)).rstrip("/") + "/" for r in roots}, key=lambda r: (len(r), r))


def _listed(options: dict) -> dict:
    """Options to read a list of files with, whose path columns are added here."""
    return {k: v for k, v in options.items() if k.lower() != "basepath"}


def _path_values(file: Column, bases: Sequence[str]) -> Column:
    """Map of the path columns of a file, as Spark finds them: the lowest folders ``name=value`` in a row below a base."""
    if not bases:
        return F.create_map().cast("map<string,string>")
    plain = F.regexp_replace(file, "^([a-zA-Z]+):///", "$1:/")
    base = F.get(F.filter(F.array(*map(F.lit, bases)), lambda b: F.startswith(plain, b)), F.lit(0))
    inner = F.coalesce(F.substr(plain, F.length(base) + 1), F.lit(""))
    folders = F.regexp_extract(inner, "^(.*/)?[^/]*$", 1)
    run = F.regexp_extract(folders, "(?:^|/)((?:[^/=]+=[^/]*/)+)(?:[^/=]*/)*$", 1)
    text = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.map_from_entries(F.transform(F.filter(F.split(run, "/"), lambda c: c != ""), lambda c: F.struct(
        text(F.substring_index(c, "=", 1)),
        F.nullif(text(F.regexp_extract(c, "=(.*)$", 1)), F.lit("__HIVE_DEFAULT_PARTITION__")))))


def _path_names(file: Column, bases: Sequence[str]) -> Column:
    return F.array_join(F.map_keys(_path_values(file, bases)), "/")


def _path_columns(names: str, bases: Sequence[str]) -> dict[str, Column]:
    """Path columns by name, as text, of a table of files."""
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return {n: _path_values(file, bases)[n] for n in names.split("/") if n}


def _path_types(facts: DataFrame, bases: Sequence[str]) -> dict[str, T.DataType]:
    """Type of each path column: the first that holds all its values in all files, in Spark's order."""
    if not bases:
        return {}
    number, date = r"^[-+]?[0-9]+$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    kinds = {T.IntegerType(): number, T.LongType(): number, T.DecimalType(38, 0): number,
             T.DoubleType(): r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$",
             T.DateType(): date + "$", T.TimestampType(): date + "([ T][0-9]{2}:[0-9]{2}.*)?$"}
    if facts.sparkSession.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") != "true":
        kinds = {}
    values = facts.select(F.explode(_path_values(F.col("file"), bases)).alias("name", "value")).where("value is not null")
    fits = values.groupBy("name").agg(*[
        F.bool_and(F.col("value").rlike(pattern) & F.col("value").try_cast(kind).isNotNull()).alias(f"k{i}")
        for i, (kind, pattern) in enumerate(kinds.items())], F.lit(True).alias("text"))
    order = [*kinds, T.StringType()]
    return {r["name"]: next(kind for kind, fit in zip(order, r[1:]) if fit) for r in fits.collect()}


def _with_path_columns(rows: DataFrame, columns: dict[str, Column], types: dict[str, T.DataType]) -> DataFrame:
    return rows.withColumns({n: c.cast(types.get(n, T.StringType())) for n, c in columns.items()}) if columns else rows


def expand(spark: SparkSession, *paths: str) -> list[str]:
    """Paths and globs as they are; ``**``, which stands for any folders, by the files that match."""
    out = []
    for path in paths:
        if "**" not in path:
            out.append(path)
            continue
        root, _, rest = path.partition("**")
        base = workspace.qualified(spark, root or ".")
        inner = F.ltrim(F.substr("path", F.lit(len(base) + 1)), F.lit("/"))
        found = [r.path for r in list_files(spark, root or ".").where(
            inner.rlike(glob_pattern("**" + rest))).orderBy("path").collect()]
        if not found:
            raise FileNotFoundError(path)
        out += found
    return out


def glob_pattern(pattern: str) -> str:
    """Regular expression of a glob over a whole relative path."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|", "[": "[", "]": "]"}.get(c, re.escape(c))
            i += 1
    return f"^{out}$"


def _lines(spark: SparkSession, paths: Sequence[str], options: dict | None = None) -> DataFrame:
    """``value, file, at``: all lines of the files, split as the text source does; ``at`` orders those of a file."""
    return spark.read.options(**(options or {})).text(list(paths)).select(
        "value", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))


def _first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, head, open``: each file's first line that is not blank, and whether a quote stays open on some line.

    One pass of the splittable text source over the files; only these rows are shuffled.
    """
    lines = _lines(spark, paths)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.where(F.trim("value") != "").groupBy("file").agg(
        F.min_by("value", "at").alias("head"), F.bool_or(quotes % 2 == 1).alias("open"))


def _json_layouts(spark: SparkSession, paths: Sequence[str], options: dict) -> DataFrame:
    """``file, whole``: whether each file is one value over several lines.

    It is if its first line leaves a bracket open and its last one closes more than it opens.  One pass finds these two lines
    of each file, and only they are parsed.  Only brackets outside strings count, so it does not matter which values Spark's
    lenient parser takes.  A file of several values that each go over lines is an error: neither layout reads it all.
    """
    separator = {k: v for k, v in options.items() if k.lower() == "linesep"}
    comments = str({k.lower(): v for k, v in options.items()}.get("allowcomments", "")).lower() == "true"

    def bare(line: str) -> Column:
        """A line without its strings and, where they are allowed, comments."""
        out = F.regexp_replace(F.regexp_replace(line, r"(?s)\\.", ""), "\"[^\"]*\"?|'[^']*'?", "s")
        return F.regexp_replace(out, r"/\*.*?\*/|//.*", "") if comments else out

    def step(line: str) -> Column:
        """Brackets that a line opens, less those that it closes."""
        count = lambda brackets: F.length(bare(line)) - F.length(F.translate(bare(line), brackets, ""))
        return count("[{") - count("]}")

    filled = (bare("value") if comments else F.col("value")).rlike(r"[^\s\x{FEFF}]")
    ends = _lines(spark, paths, separator).where(filled).groupBy("file").agg(
        F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"))
    facts = workspace.cut_lineage(ends.select("file", ((step("first") > 0) & (step("last") < 0)).alias("whole")))
    wholes = [r.file for r in facts.where("whole").select("file").collect()]
    if wholes:
        depth = F.sum("step").over(Window.partitionBy("file").orderBy("at"))
        steps = _lines(spark, wholes, separator).select("file", "at", step("value").alias("step")).where("step != 0")
        ends = steps.withColumn("depth", depth).where("depth <= 0")
        broken = ends.groupBy("file").count().where("count > 1").orderBy("file").first()
        if broken:
            raise ValueError(f"{broken.file} holds several JSON values that go over lines; multi_line=True reads the first one")
    return facts


def _by_group(facts: DataFrame, keys: Sequence[str], paths: Sequence[str], given: Sequence[str],
              bases: Sequence[str]) -> list[tuple]:
    """(key values, paths, path columns, their types) of each group of files that are alike.

    If all are, these are the given paths and Spark finds the path columns, unless those lie in a glob.
    A list of files has none in Spark, so they are taken from the path of each row's file.
    """
    facts = facts.withColumn("names", _path_names(F.col("file"), bases))
    keys = [*keys, "names"]
    groups = sorted(facts.groupBy(*keys).agg(F.min("file").alias("first")).collect(), key=lambda r: r["first"])
    key = lambda g: tuple(g[k] for k in keys[:-1])
    if len(groups) < 2 and not (groups and groups[0].names and any(map(_GLOB.search, given))):
        return [(key(g), list(paths), {}, {}) for g in groups]
    types = _path_types(facts, bases) if any(g.names for g in groups) else {}
    same = lambda g: reduce(and_, [F.col(k).eqNullSafe(F.lit(g[k])) for k in keys])
    return [(key(g), [r.file for r in facts.where(same(g)).select("file").orderBy("file").collect()],
             _path_columns(g.names, bases), types) for g in groups]


def delimiter(header: str) -> str:
    """The commonest of comma, semicolon, tab and bar outside quotes; comma among equals."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(",;\t|", key=bare.count)


def read_csv(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None,
             alike: bool = False, **options) -> DataFrame:
    """CSV with a header in each file; columns are matched by name over all files.

    One pass over the lines finds the files that are alike.  Files of another header or delimiter are
    read apart and stacked by name.  Files with a quoted line break are read by one task each, all others
    are split between lines.  ``sep`` and ``multiLine`` may be given instead.  Without a schema,
    types cost one more pass.

    ``alike=True`` says that all files have one header, and ``sep`` and ``multiLine`` hold for all (a comma and False, if
    not given).  No pass tells them apart then: the first header gives the columns, and a file with another one is an error.
    """
    given, paths = paths, expand(spark, *paths)
    base = {"header": True, "escape": '"', **options}
    bases = _bases(spark, given, options)
    wanted = _struct(spark, schema)
    if alike:
        base = {"enforceSchema": False, **base}
        if not any(map(_GLOB.search, given)):
            return _read_csv_group(spark, paths, wanted, None, {}, {}, base)
        facts = list_files(spark, *paths, recursive=False).select(F.col("path").alias("file"), F.lit(None).alias("head"))
        groups = _by_group(facts, ["head"], paths, given, bases)
    else:
        # One small row for each file; what an executor loses of them is made again.
        facts = _first_lines(spark, paths).persist()
        try:
            groups = _by_group(facts, ["head", "open"], paths, given, bases)
        finally:
            facts.unpersist()
    frames = []
    for (head, *opened), found, columns, types in groups:
        here = _listed(base) if columns else base
        if not alike:
            here = {"sep": delimiter(head), "multiLine": opened[0], **here}
        frames.append(_read_csv_group(spark, found, wanted, head, columns, types, here))
    if not frames:
        reader = spark.read.options(**base)
        return (reader.schema(wanted) if wanted is not None else reader).csv(paths)
    return frames[0] if len(frames) == 1 else stack_by_name(frames)


def _read_csv_group(spark: SparkSession, paths: Sequence[str], wanted: T.StructType | None, head: str | None,
                    columns: dict[str, Column], types: dict[str, T.DataType], options: dict) -> DataFrame:
    """Files of one header, with the columns that only their paths hold; the wanted columns by name, if any are."""
    if wanted is None:
        return _with_path_columns(spark.read.options(**{"inferSchema": True, **options}).csv(paths), columns, types)
    reader = spark.read.options(**options)
    kinds = {f.name: f.dataType for f in wanted}
    # Spark names the columns, unless the header holds just the wanted names.
    plain = head and '"' not in head and options["header"] is True and set(options) <= {"header", "escape", "sep", "multiLine"}
    names = head.split(options["sep"]) if plain else None
    if names != list(kinds):
        names = reader.csv(paths[:1]).columns
    rows = reader.schema(T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])).csv(paths)
    rows = _with_path_columns(rows, columns, types | kinds)
    return rows.select(*[F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in wanted])


def _struct(spark: SparkSession, schema: T.StructType | str | None) -> T.StructType | None:
    return spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema


def read_json(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None,
              multi_line: bool | None = None, **options) -> DataFrame:
    """JSON lines, or files that hold one array or object each.

    The layout is told for each file by the brackets that its first and last lines leave open, unless ``multi_line``
    says it.  JSON lines stay splittable; a multi-line file is read by one task.
    """
    given, paths = paths, expand(spark, *paths)
    read = lambda o: spark.read.options(**o).schema(schema) if schema else spark.read.options(**o)
    reader = read(options)
    if multi_line is None:
        facts = _json_layouts(spark, paths, options)
    elif any(map(_GLOB.search, given)):
        facts = list_files(spark, *paths, recursive=False).select(F.col("path").alias("file"), F.lit(multi_line).alias("whole"))
    else:
        return reader.option("multiLine", multi_line).json(paths)
    wanted = {f.name: f.dataType for f in _struct(spark, schema) or []}
    frames = []
    for (whole,), found, columns, kinds in _by_group(
            facts, ["whole"], paths, given, _bases(spark, given, options)):
        rows = (read(_listed(options)) if columns else reader).option("multiLine", whole).json(found)
        frames.append(_with_path_columns(rows, columns, kinds | wanted))
    if not frames:
        return reader.json(paths)
    return frames[0] if len(frames) == 1 else stack_by_name(frames)


def read_arrow(spark: SparkSession, *paths: str, schema: T.StructType | None = None,
               options: dict[str, str] | None = None) -> DataFrame:
    """Arrow IPC and Feather files; without a schema, the union of the columns of all files.

    Executors open the files themselves and each task streams some record
    batches, so one large file is shared among tasks and never held whole.
    ``options`` are ``fs.s3a`` settings for files of an object store.
    """
    files = list_files(spark, *expand(spark, *paths))
    if schema is None:
        schema = _united(files, options)
        if schema is None:
            raise FileNotFoundError(", ".join(paths))
    target = to_arrow_schema(schema)

    def footers(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            found = [(p, i) for p in b.column(0).to_pylist() for i in range(_batch_count(p, options))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), pa.array([i for _, i in found], pa.int64())],
                names=["path", "batch"])

    def load(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for path, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _aligned(_read_batch(path, i, options), target).to_batches()

    parts = files.select("path").mapInArrow(footers, "path string, batch bigint")
    # The rows to shuffle are tiny, so adaptive coalescing would leave one task:
    # the number of tasks follows from the bytes to read.
    size = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, size // READ_BYTES_PER_TASK)
    return parts.repartition(tasks, "path", "batch").mapInArrow(load, schema)


def _united(files: DataFrame, options: dict[str, str] | None) -> T.StructType | None:
    """Columns of all files in first-seen order, read from the footers in tasks; only different schemas are collected."""
    def schemas(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for path in b.column(0).to_pylist():
                found = from_arrow_schema(_arrow_schema(path, options)).json()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found])], names=["path", "found"])

    kinds = files.select("path").mapInArrow(schemas, "path string, found string").groupBy("found").agg(F.min("path").alias("path"))
    types: dict[str, T.DataType] = {}
    for r in sorted(kinds.collect(), key=lambda r: r.path):
        for f in T.StructType.fromJson(json.loads(r.found)):
            types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in types.items()]) if types else None


def list_files(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """Path, size and time of files; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
        .load(list(paths)).select("path", "length", "modificationTime")
    )


def file_inventory(spark: SparkSession, *paths: str) -> DataFrame:
    """Name and size in KB of each file, by name."""
    size = F.round(F.col("length") / 1024, 1).alias("size_kb")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return list_files(spark, *paths, recursive=False).select(name, size).orderBy("name")


def _open(path: str, options: dict[str, str] | None = None):
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(parsed.path))
    if options and parsed.scheme.startswith("s3"):
        named = {"access_key": "access.key", "secret_key": "secret.key", "session_token": "session.token",
                 "region": "endpoint.region", "endpoint_override": "endpoint"}
        given = {k: options[f"fs.s3a.{v}"] for k, v in named.items() if f"fs.s3a.{v}" in options}
        return pafs.S3FileSystem(**given).open_input_file(parsed.netloc + parsed.path)
    fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.open_input_file(inner)


def _arrow_schema(path: str, options: dict[str, str] | None = None) -> pa.Schema:
    with _open(path, options) as f:
        magic = f.read(6)
        f.seek(0)
        if magic == b"ARROW1":
            return ipc.open_file(f).schema
        if magic[:4] == b"FEA1":
            return feather.read_table(f).schema
        return ipc.open_stream(f).schema


def _batch_count(path: str, options: dict[str, str] | None = None) -> int:
    with _open(path, options) as f:
        magic = f.read(6)
        f.seek(0)
        # Only the file layout has an index of its batches.
        return ipc.open_file(f).num_record_batches if magic == b"ARROW1" else 1


def _read_batch(path: str, i: int, options: dict[str, str] | None = None) -> pa.Table:
    with _open(path, options) as f:
        magic = f.read(6)
        f.seek(0)
        if magic == b"ARROW1":
            return pa.Table.from_batches([ipc.open_file(f).get_batch(i)])
        if magic[:4] == b"FEA1":
            return feather.read_table(f)
        return ipc.open_stream(f).read_all()


def _aligned(table: pa.Table, schema: pa.Schema) -> pa.Table:
    cols = [
        table.column(f.name).cast(f.type) if f.name in table.column_names
        else pa.nulls(table.num_rows, f.type)
        for f in schema
    ]
    return pa.Table.from_arrays(cols, schema=schema)


def read_table(spark: SparkSession, paths: str | Sequence[str], **kwargs) -> DataFrame:
    """Read files of any supported kind and stack them by column name.

    Each path or glob is read by its suffix, CSV when the suffix is unknown.
    A path without a match is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no paths given")
    frames = []
    for p in paths:
        ext = os.path.splitext(p.rstrip("/"))[1].lower()
        frames.append(_read_one(spark, p, SUFFIX_READERS.get(ext, "csv"), **kwargs))
    return frames[0] if len(frames) == 1 else stack_by_name(frames)


def _read_one(spark: SparkSession, path: str, kind: str, **kwargs) -> DataFrame:
    if kind == "parquet":
        return read_parquet(spark, path, **kwargs)
    if kind == "json":
        return read_json(spark, path, **kwargs)
    if kind == "arrow":
        return read_arrow(spark, path, **kwargs)
    if kind == "excel":
        from tabforge.sources.excel import read_excel

        return read_excel(spark, path, **kwargs)
    return read_csv(spark, path, **kwargs)


# --- object stores -----------------------------------------------------------

def detect_path_format(path: str) -> str:
    """Format implied by an object path (driver-side twin of ``text.path_format``)."""
    lowered = path.lower()
    return next((name for needle, name in PATH_FORMATS if needle in lowered), DEFAULT_PATH_FORMAT)


def build_object_url(scheme: str, bucket: str, path: str) -> str:
    return f"{scheme}://{bucket}/{path.lstrip('/')}"


def s3_options(config: dict, env: dict | None = None) -> dict[str, str]:
    """``fs.s3a`` settings from the config, then from the environment."""
    env = os.environ if env is None else env

    def pick(key: str, variable: str, default: str = ""):
        return config.get(key) or env.get(variable, default)

    endpoint = pick("endpoint_url", "AWS_ENDPOINT_URL")
    out = {
        "fs.s3a.access.key": pick("aws_access_key_id", "AWS_ACCESS_KEY_ID"),
        "fs.s3a.secret.key": pick("aws_secret_access_key", "AWS_SECRET_ACCESS_KEY"),
        "fs.s3a.session.token": pick("aws_session_token", "AWS_SESSION_TOKEN"),
        "fs.s3a.endpoint.region": pick("region", "AWS_DEFAULT_REGION", "us-east-1"),
        "fs.s3a.endpoint": endpoint,
    }
    if endpoint:
        out["fs.s3a.path.style.access"] = "true"
        out["fs.s3a.connection.ssl.enabled"] = str(not endpoint.startswith("http://")).lower()
    return {k: v for k, v in out.items() if v}


def gcs_access(config: dict, env: dict | None = None) -> tuple[str, dict[str, str]]:
    """URL scheme and settings for a GCS bucket.

    A service-account key file is read with the GCS connector.  HMAC keys only
    work with the S3-compatible endpoint, so they select ``s3a``.
    """
    env = os.environ if env is None else env
    key_file = config.get("service_account_key_path") or env.get("GOOGLE_APPLICATION_CREDENTIALS")
    key = config.get("hmac_access_key") or env.get("GCS_HMAC_ACCESS_KEY")
    secret = config.get("hmac_secret") or env.get("GCS_HMAC_SECRET")
    if key and secret:
        return "s3a", {
            "fs.s3a.access.key": key,
            "fs.s3a.secret.key": secret,
            "fs.s3a.endpoint": "https://storage.googleapis.com",
            "fs.s3a.path.style.access": "true",
        }
    if key_file:
        return "gs", {
            "fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE",
            "fs.gs.auth.service.account.json.keyfile": key_file,
        }
    return "gs", {}


def read_object_store(spark: SparkSession, scheme: str, bucket: str, path: str, *,
                      file_format: str | None = None, options: dict[str, str] | None = None,
                      schema: T.StructType | None = None) -> DataFrame:
    """Read Parquet, JSON, Arrow or CSV objects under a bucket; the path may be a glob.

    The options are passed with the read, not set on the session, so reads with
    different credentials can run side by side.
    """
    url = build_object_url(scheme, bucket, path)
    file_format = file_format or detect_path_format(path)
    options = options or {}
    if file_format == "arrow":
        return read_arrow(spark, url, schema=schema, options=options)
    if file_format == "parquet":
        return read_parquet(spark, url, schema=schema, **options)
    if file_format in ("json", "jsonl"):
        return read_json(spark, url, schema=schema, **options)
    if file_format != "csv":
        raise ValueError(f"unsupported format {file_format!r}")
    return read_csv(spark, url, schema=schema, **options)
