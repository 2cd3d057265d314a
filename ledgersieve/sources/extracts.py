"""Reading delimited extracts: scan a folder, find the delimiter, clean rows, strip footers."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import rules
from ..functions.text import missing, present

CONFIG_FILES = ("sources.csv", "column_transforms.csv")
# Tried in this order; the first that gives at least two columns is used.
DELIMITERS = [("|", "pipe"), (",", "comma"), ("\t", "tab")]
_BLOCK, _ROW, _BAD, _OPEN = "__block", "__row", "__bad", "__open"


@dataclass(frozen=True)
class ExtractFile:
    """One file of a submission: where it is and how it is read."""

    name: str
    path: str
    folder: str | None
    delimiter: str | None
    columns: tuple[str, ...] = ()
    row_count: int = 0
    raw_col_count: int = 0
    footer_rows: int = 0
    bad_lines: int = 0
    encoding: str = "UTF-8"
    issues: tuple[str, ...] = field(default_factory=tuple)


_PATH = re.compile(r"^(?:(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*):)?(?://(?P<authority>[^/]*))?(?P<path>/.*)?$")


def below(root: str, path: str) -> list[str] | None:
    """The parts of ``path`` below ``root``; None if it is not below it.

    Both are paths as file systems print them.  A scheme or authority that the root leaves open
    matches any, so ``/in`` covers ``hdfs://host:8020/in`` and ``file:/in``.
    """
    top, one = _PATH.match(root), _PATH.match(path)
    if not top or not one:
        return None
    for part in ("scheme", "authority"):
        if top[part] and top[part] != one[part]:
            return None
    start = (top["path"] or "/").rstrip("/") + "/"
    inner = one["path"] or ""
    return inner[len(start):].split("/") if inner.startswith(start) else None


def _qualified(spark: SparkSession, directory: str) -> str:
    """The directory with the scheme and authority of its file system, relative paths resolved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def list_files(spark: SparkSession, directory: str) -> list[tuple[str, str, str | None, int, str]]:
    """``name, path, folder, length, modified`` of .txt and .csv files in the folder and one level below.

    A file's name is its path below the folder, so equal names in two folders stay two files.
    Only file names are read: the content column of the listing is never asked for.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "length", F.col("modificationTime").cast("string").alias("modified"))
    root, found = _qualified(spark, directory), []
    for row in listing.toLocalIterator():  # one row per extract of the submission
        parts = below(root, row.path)
        if parts is None:
            raise ValueError(f"{row.path} was listed but is not below {root}")
        if len(parts) > 2 or not parts[-1].lower().endswith((".txt", ".csv")):
            continue
        folder = parts[0] if len(parts) == 2 else None
        if folder is not None or parts[-1].lower() not in CONFIG_FILES:
            found.append(("/".join(parts), row.path, folder, row.length, row.modified))
    return sorted(found, key=lambda f: (f[2] is not None, f[0]))


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of a file with their place: ``value``, the start of their split and their row in it.

    Splits are not handed out in file order, but a split's start and a row's place in it are known.
    """
    options = {"sep": "\x01", "quote": "", "escape": "", "encoding": encoding, "header": "false", "maxColumns": "1000000"}
    lines = spark.read.schema("value string").options(**options).csv(path)
    return lines.withColumns({_BLOCK: F.col("_metadata.file_block_start"), _ROW: F.monotonically_increasing_id()})


def split_header(line: str, spark: SparkSession) -> tuple[str | None, str | None, tuple[str, ...]]:
    """Delimiter, its label and the header's names, trimmed and unique.  Blank names keep their place."""
    line = line.lstrip("\ufeff")
    for delimiter, label in DELIMITERS:
        if delimiter not in line:
            continue
        names = spark.createDataFrame([(line,)], "value string").select(
            F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(line.count(delimiter) + 1))), {"sep": delimiter}).alias("h")
        ).select("h.*").first()
        # Delimiters inside quotes leave fields behind the last one unfilled; those are no columns.
        quoted = line.count('"') >= 2
        names = list(names)
        while quoted and names and names[-1] is None:
            names.pop()
        seen: dict[str, int] = {}
        unique = []
        for place, name in enumerate((n or "").strip() for n in names):
            again = seen.get(name, 0)
            seen[name] = again + 1
            unique.append(f"Unnamed: {place}" if not name else f"{name}.{again}" if again else name)
        return delimiter, label, tuple(unique)
    return None, None, ()


def header_columns(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[str | None, str | None, tuple[str, ...]]:
    """Delimiter, its label and the header names; reads the first line only."""
    text = read_lines(spark, path, encoding).select("value").head(1)
    return split_header(text[0].value or "", spark) if text else (None, None, ())


def parse_lines(lines: DataFrame, delimiter: str, columns: tuple[str, ...]) -> DataFrame:
    """Data lines (``value`` and their place) as text columns; lines of another width keep themselves in the bad column."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in [*names, _BAD])
    options = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = lines.withColumn("__line", F.from_csv("value", F.lit(schema), options))
    return parsed.select(
        *[F.col("__line")[n].alias(c) for n, c in zip(names, columns, strict=True)], F.col("__line")[_BAD].alias(_BAD),
        _open_quote(F.col("value")).alias(_OPEN), _BLOCK, _ROW,
    )


def _scan(spark: SparkSession, path: str, delimiter: str, columns: tuple[str, ...], encoding: str, multi_line: bool) -> DataFrame:
    if not multi_line:
        lines = read_lines(spark, path, encoding)
        header = (F.col(_BLOCK) == 0) & (F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1)) == 0)
        return parse_lines(lines.where(~header), delimiter, columns)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns) + f", `{_BAD}` string"
    rows = (
        spark.read.schema(schema)
        .options(sep=delimiter, header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, multiLine="true",
                 encoding=encoding, enforceSchema="true")
        .csv(path)
    )
    return rows.withColumns({
        _OPEN: F.lit(False), _BLOCK: F.col("_metadata.file_block_start"), _ROW: F.monotonically_increasing_id(),
    })


def _too_long(delimiter: str, columns: tuple[str, ...]) -> Column:
    """More fields than the header has; short lines are filled with nulls instead."""
    fields = F.size(F.split(F.col(_BAD), "\\" + delimiter if delimiter == "|" else delimiter))
    return F.coalesce(fields > len(columns), F.lit(False))


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _open_quote(line: Column) -> Column:
    """A line that ends inside quotes: a line break within a field, or a stray quote."""
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return F.coalesce(quotes % 2 == 1, F.lit(False))


def _is_footer(columns: tuple[str, ...]) -> Column:
    return F.coalesce(_quoted(columns[0]).rlike(f"(?i){rules.FOOTER}"), F.lit(False))


def _kept(delimiter: str, columns: tuple[str, ...]) -> Column:
    return ~_too_long(delimiter, columns) & ~reduce(Column.__and__, [missing(_quoted(c)) for c in columns])


def line_facts(parsed: DataFrame, delimiter: str, columns: tuple[str, ...]) -> DataFrame:
    """One row about the parsed lines: bad and kept ones, open quotes, where the footer starts, filled and odd columns."""
    kept, footer = _kept(delimiter, columns), _is_footer(columns)
    return parsed.agg(
        F.count_if(_too_long(delimiter, columns)).alias("bad"),
        F.count_if(F.col(_OPEN)).alias("open_quotes"),
        F.count_if(kept).alias("rows"),
        F.count_if(kept & footer).alias("footer_like"),
        F.max(F.when(kept & ~footer, F.struct(_BLOCK, _ROW))).alias("last"),
        F.coalesce(F.max(F.when(kept, F.coalesce(_quoted(columns[0]).rlike(rules.MOJIBAKE), F.lit(False)))), F.lit(False)).alias("garbled"),
        F.array(*[F.count_if(kept & present(_quoted(c))) for c in columns]).alias("filled"),
        F.array(*[
            F.coalesce(F.max(F.when(kept, F.coalesce(_quoted(c).contains("|"), F.lit(False)))), F.lit(False)) for c in columns
        ]).alias("pipes"),
    )


def clean_rows(parsed: DataFrame, delimiter: str, columns: tuple[str, ...], last: DataFrame | tuple | None) -> DataFrame:
    """Rows without over-long and blank lines and without the footer: what looks like one behind the last other row.

    ``last`` is that row's place, or the one-row table of facts that holds it.
    """
    rows = parsed.where(_kept(delimiter, columns))
    behind = _is_footer(columns)
    if isinstance(last, DataFrame):
        rows = rows.join(last.select("last"))  # one row
        return rows.where(~(behind & F.coalesce(F.struct(_BLOCK, _ROW) > F.col("last"), F.lit(True)))).drop("last")
    if last is None:
        return rows.where(~behind)
    place = F.struct(F.lit(last[0]).alias(_BLOCK), F.lit(last[1]).alias(_ROW))
    return rows.where(~(behind & (F.struct(_BLOCK, _ROW) > place)))


@dataclass(frozen=True)
class ParsedFile:
    """What is known of a file once its lines are written as columns: enough to open it again without its text."""

    name: str
    path: str
    folder: str | None
    encoding: str
    multi_line: bool
    delimiter: str | None = None
    target: str | None = None  # the written columns; None for a file without a delimiter
    columns: tuple[str, ...] = ()
    filled: tuple[bool, ...] = ()
    last: tuple[int, int] | None = None  # place of the last row that is no footer
    row_count: int = 0
    footer_rows: int = 0
    bad_lines: int = 0
    issues: tuple[str, ...] = ()

    def opened(self, spark: SparkSession) -> tuple[ExtractFile, DataFrame | None]:
        """Facts of the file and its cleaned rows, all text."""
        if self.target is None:
            return ExtractFile(self.name, self.path, self.folder, None, encoding=self.encoding, issues=self.issues), None
        numbered = tuple(f"c{i}" for i in range(len(self.columns)))
        kept = [(n, c) for n, c, filled in zip(numbered, self.columns, self.filled, strict=True) if filled]
        info = ExtractFile(
            self.name, self.path, self.folder, self.delimiter, tuple(c for _, c in kept), self.row_count, len(kept), self.footer_rows, self.bad_lines,
            self.encoding, self.issues,
        )
        schema = ", ".join([*[f"{n} string" for n in numbered], f"{_BAD} string", f"{_OPEN} boolean", f"{_BLOCK} bigint", f"{_ROW} bigint"])
        rows = clean_rows(spark.read.schema(schema).parquet(self.target), self.delimiter, numbered, self.last)
        return info, rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(c) for n, c in kept])


def parse_extract(
    spark: SparkSession, path: str, work: str, name: str | None = None, folder: str | None = None, encoding: str = "UTF-8",
    multi_line: bool = False,
) -> ParsedFile:
    """Writes the parsed lines of one file once, as columns below ``work``.

    All executors share that folder, so the text is parsed once, places of rows stay what they
    are, and every later pass reads the columns it needs.
    """
    name = name or path.rstrip("/").rsplit("/", 1)[-1]
    delimiter, label, columns = header_columns(spark, path, encoding)
    if delimiter is None:
        return ParsedFile(name, path, folder, encoding, multi_line, issues=(issue_text("no_delimiter"),))
    numbered = tuple(f"c{i}" for i in range(len(columns)))
    target = f"{work.rstrip('/')}/extract-{uuid.uuid4().hex}"
    parsed = _scan(spark, path, delimiter, columns, encoding, multi_line).toDF(*numbered, _BAD, _OPEN, _BLOCK, _ROW)
    parsed.write.parquet(target)
    parsed = spark.read.schema(parsed.schema).parquet(target)
    facts = line_facts(parsed, delimiter, numbered).first()
    last = tuple(facts.last) if facts.last else None
    stripped = facts.rows - clean_rows(parsed, delimiter, numbered, last).count() if facts.footer_like else 0
    issues = []
    if label != "pipe":
        issues.append(issue_text("other_delimiter", label))
    if facts.bad:
        issues.append(issue_text("long_lines", facts.bad))
    if facts.open_quotes and not multi_line:
        issues.append(issue_text("open_quotes", facts.open_quotes))
    if stripped:
        issues.append(issue_text("footer", stripped))
    if facts.garbled:
        issues.append(issue_text("garbled"))
    issues += [issue_text("pipes", c) for c, odd in zip(columns, facts.pipes, strict=True) if odd]
    return ParsedFile(
        name, path, folder, encoding, multi_line, delimiter, target, tuple(columns), tuple(bool(f) for f in facts.filled), last, facts.rows - stripped,
        stripped, facts.bad, tuple(issues),
    )


def read_extract(
    spark: SparkSession, path: str, work: str, name: str | None = None, folder: str | None = None, encoding: str = "UTF-8",
    multi_line: bool = False,
) -> tuple[ExtractFile, DataFrame | None]:
    """Facts of one file and its cleaned rows, parsed into ``work``."""
    return parse_extract(spark, path, work, name, folder, encoding, multi_line).opened(spark)


_ISSUES = {
    "no_delimiter": "No pipe, comma or tab in the header line",
    "other_delimiter": "Fields are separated by {}, not by pipes",
    "long_lines": "{} line(s) have more fields than the header and were left out",
    "open_quotes": "{} line(s) end inside quotes; read the file with MultiLine if fields hold line breaks",
    "footer": "{} footer line(s) at the end were left out",
    "garbled": "The first column holds characters of a wrong encoding",
    "pipes": "Values of '{}' hold pipe characters",
}


def issue_text(kind: str, *values) -> str:
    return _ISSUES[kind].format(*values)


_INVENTORY = (
    "length bigint, modified string, seq bigint, name string, path string, folder string, encoding string, multi_line boolean, delimiter string, "
    "target string, columns array<string>, filled array<boolean>, last array<bigint>, row_count bigint, footer_rows bigint, bad_lines bigint, issues array<string>"
)


def _known(spark: SparkSession, inventory: str) -> tuple[dict[tuple, ParsedFile], int]:
    """The stored records by path, length, time and way of reading, the latest of each; and the last number given."""
    try:
        rows = spark.read.schema(_INVENTORY).parquet(f"{inventory}/files").orderBy("seq").collect()  # one row per file parsed so far
    except AnalysisException:
        return {}, 0
    found = {}
    for r in rows:
        record = {f.name: r[f.name] for f in fields(ParsedFile)}
        record |= {k: tuple(record[k]) for k in ("columns", "filled", "issues")} | {"last": tuple(r.last) if r.last else None}
        found[r.path, r.length, r.modified, r.encoding, r.multi_line] = ParsedFile(**record)
    return found, rows[-1].seq if rows else 0


def read_submission(
    spark: SparkSession, directory: str, work: str, only: list[str] | None = None, reading: dict[str, dict] | None = None, inventory: str | None = None,
) -> dict[str, tuple[ExtractFile, DataFrame | None]]:
    """Every file of a submission, or the named ones, by its path below the folder.

    ``reading`` gives ``encoding`` and ``multi_line`` by file, named with or without its folder.
    ``inventory`` is a lasting folder for parsed files and their facts: a file whose path, length
    and time are those of a record there is opened from its columns, and not parsed again.
    """
    wanted = [f for f in list_files(spark, directory) if only is None or f[0] in only]
    how, kept = reading or {}, inventory and inventory.rstrip("/")
    known, last = _known(spark, kept) if kept else ({}, 0)

    def one(file: tuple) -> tuple[ParsedFile, bool]:
        name, path, folder, length, modified = file
        options = {"encoding": "UTF-8", "multi_line": False} | (how.get(name) or how.get(name.rsplit("/", 1)[-1]) or {})
        record = known.get((path, length, modified, options["encoding"], options["multi_line"]))
        if record is not None:
            return replace(record, name=name, folder=folder), False
        return parse_extract(spark, path, f"{kept}/columns" if kept else work, name, folder, **options), True

    with ThreadPoolExecutor(8) as pool:  # two short jobs per file
        parsed = list(pool.map(one, wanted))
    fresh = [(file, record) for file, (record, new) in zip(wanted, parsed, strict=True) if new]
    if kept and fresh:
        rows = [
            (file[3], file[4], last + i, r.name, r.path, r.folder, r.encoding, r.multi_line, r.delimiter, r.target, list(r.columns), list(r.filled),
             list(r.last) if r.last else None, r.row_count, r.footer_rows, r.bad_lines, list(r.issues))
            for i, (file, r) in enumerate(fresh, 1)
        ]
        spark.createDataFrame(rows, _INVENTORY).coalesce(1).write.mode("append").parquet(f"{kept}/files")
    return {record.name: record.opened(spark) for record, _ in parsed}


def files_table(spark: SparkSession, files: list[ExtractFile], client: str, round_: str) -> DataFrame:
    """The file inventory as a table."""
    schema = (
        "client string, round string, file string, path string, folder string, delimiter string, encoding string, "
        "row_count bigint, raw_col_count int, footer_rows bigint, bad_lines bigint, issues array<string>"
    )
    rows = [
        (client, round_, f.name, f.path, f.folder, f.delimiter, f.encoding, f.row_count, f.raw_col_count, f.footer_rows, f.bad_lines, list(f.issues))
        for f in files
    ]
    return spark.createDataFrame(rows, schema)


def columns_table(spark: SparkSession, files: list[ExtractFile]) -> DataFrame:
    """``file, raw, position`` of every header."""
    rows = [(f.name, c, i) for f in files for i, c in enumerate(f.columns)]
    return spark.createDataFrame(rows, "file string, raw string, position int")


def rename_to_staging(df: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Rows under their staging names: a raw column mapped twice gives two columns, the first mapping of a name wins."""
    taken: dict[str, Column] = {}
    for raw, targets in mapping.items():
        for target in targets:
            taken.setdefault(target, _quoted(raw))
    return df.select(*[c.alias(name) for name, c in taken.items()])
