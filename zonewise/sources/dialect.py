"""CSV in configurable dialects, with NULL told from the empty field: parsing and writing of records.

Where a dialect is one that Spark's own reader has (no escapes of its own, no trailing delimiter), that
reader is used; the others go through a parser of lines in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTINGS = ("QUOTE_MINIMAL", "QUOTE_ALL", "QUOTE_NONE")
#: Bytes that a record may have.
MAX_RECORD = 4 << 20
# Fixed values of the standard escapes, and of the spellings of booleans (any case).
ESCAPES = {"Z": "\x1a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
TRUE, FALSE = ("y", "t", "yes", "true", "1"), ("n", "f", "no", "false", "0")


class CsvError(ValueError):
    pass


@dataclass(frozen=True)
class CsvDialect:
    null: str = ""
    has_null: bool = False
    quoting: str = "QUOTE_MINIMAL"
    delimiter: str = ","
    escape: str = "\\"
    quote: str = '"'
    skip_initial_space: bool = False
    double_quote: bool = False
    standard_escapes: bool = True
    trailing_delimiter: bool = False
    nonfinite_as_null: bool = False

    def __post_init__(self) -> None:
        ends = ("\n", "\r", "\0")
        checks = (
            (len(self.delimiter) != 1 or self.delimiter in ends, "the delimiter is one character, no line end"),
            (len(self.escape) > 1 or self.escape in ("\n", "\r", self.delimiter), "the escape is at most one character, no line end and not the delimiter"),
            (len(self.quote) > 1 or self.quote in ("\n", "\r", self.delimiter), "the quote is at most one character, no line end and not the delimiter"),
            (bool(self.escape) and self.escape == self.quote, "escape and quote are the same: use double_quote"),
            (not self.escape and self.standard_escapes, "standard escapes need an escape character"),
            (self.quoting not in QUOTINGS, f"quoting is one of {QUOTINGS}"),
            (not self.quote and self.quoting != "QUOTE_NONE", "quoting needs a quote character"),
            (any(c and c in self.null for c in ("\n", "\r", self.delimiter, self.escape, self.quote)), "the null string has a special character"),
        )
        for wrong, what in checks:
            if wrong:
                raise CsvError(what)


def parse_record(lines: Iterator[str], d: CsvDialect) -> list[str | None] | None:
    """The fields of the next record of some lines (without their ends); None after the last. A record may take several lines."""
    text = next(lines, None)
    if text is None:
        return None
    fields: list[str | None] = []
    if not text:
        if d.trailing_delimiter:
            raise CsvError("a record has no trailing delimiter")
        return [None] if d.has_null and not d.null else []
    quotes = d.quoting != "QUOTE_NONE"
    at, size = 0, len(text)

    def more() -> None:
        nonlocal text, at
        following = next(lines, None)
        if following is None:
            raise CsvError("a record ends within a field")
        text, at = text + "\n" + following, at
        if len(text) > MAX_RECORD:
            raise CsvError("a record is too long")

    def escaped() -> str:
        """What stands after an escape character."""
        nonlocal at
        if at == len(text):
            more()
        letter = text[at]
        at += 1
        if d.standard_escapes and letter == "x":
            digits = re.match(r"[0-9A-Fa-f]{1,2}", text[at:])
            if not digits:
                raise CsvError("a hexadecimal escape has no digit")
            at += digits.end()
            return chr(int(digits[0], 16))
        return ESCAPES.get(letter, letter) if d.standard_escapes else letter

    while True:
        if d.skip_initial_space:
            while at < len(text) and text[at] in " \t\v\f":
                at += 1
        if d.trailing_delimiter and at == len(text):
            return fields
        out: list[str] = []
        quoted = quotes and text[at : at + 1] == d.quote
        if quoted:
            at += 1
            while True:
                if at == len(text):
                    more()
                letter = text[at]
                at += 1
                if d.escape and letter == d.escape:
                    out.append(escaped())
                elif letter == d.quote:
                    if d.double_quote and text[at : at + 1] == d.quote:
                        out.append(d.quote)
                        at += 1
                        continue
                    break
                else:
                    out.append(letter)
            if at < len(text) and text[at] != d.delimiter:
                raise CsvError("a quoted field is followed by something else than a delimiter")
            fields.append("".join(out))
        elif d.standard_escapes and text.startswith(d.escape + "N", at) and text[at + 2 : at + 3] in ("", d.delimiter):
            at += 2
            fields.append(None)
        else:
            while at < len(text) and text[at] != d.delimiter:
                letter = text[at]
                at += 1
                out.append(escaped() if d.escape and letter == d.escape else letter)
            value = "".join(out)
            fields.append(None if d.has_null and value == d.null else value)
        if at == len(text):
            if d.trailing_delimiter:
                raise CsvError("a record has no trailing delimiter")
            return fields
        at += 1


def parse_text(text: str, d: CsvDialect) -> list[list[str | None]]:
    """All records of a text; an end of line after the last one starts none."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    source, out = iter(lines), []
    while (record := parse_record(source, d)) is not None:
        out.append(record)
    return out


def format_record(fields: Sequence[str | None], d: CsvDialect) -> str:
    text = d.delimiter.join(_format(f, d) for f in fields)
    return text + d.delimiter if d.trailing_delimiter else text


def _format(value: str | None, d: CsvDialect) -> str:
    if value is None:
        if d.has_null:
            return d.null
        if d.standard_escapes:
            return d.escape + "N"
        value = ""
    is_null = d.has_null and value == d.null
    if d.quoting == "QUOTE_NONE":
        if is_null:
            raise CsvError("a value equals the null string and cannot be quoted")
        return _escape(value, d, quoted=False)
    if d.quoting == "QUOTE_ALL" or is_null:
        return d.quote + _escape(value, d, quoted=True) + d.quote
    broken = "\n" in value or "\r" in value
    wants = d.delimiter in value or (d.escape and d.escape in value) or (d.double_quote and d.quote in value) or (broken and not d.standard_escapes)
    return d.quote + _escape(value, d, quoted=True) + d.quote if wants else _escape(value, d, quoted=False)


def _escape(value: str, d: CsvDialect, quoted: bool) -> str:
    out = []
    for letter in value:
        special = letter == d.escape and bool(d.escape)
        if letter == d.quote and d.quoting != "QUOTE_NONE":
            if d.double_quote:
                out.append(letter * 2)
                continue
            special = True
        elif letter in "\n\r":
            special = d.standard_escapes if quoted else True
        elif letter == d.delimiter and not quoted:
            special = True
        if special:
            if not d.escape:
                raise CsvError("a value needs an escape character and there is none")
            out.append(d.escape)
            if d.standard_escapes and letter in "\n\r":
                letter = "n" if letter == "\n" else "r"
        out.append(letter)
    return "".join(out)


def field_names(names: Sequence[str] | str, pattern: str | None = None, strip: bool = False) -> list[str]:
    """Names of fields, from a list or a string split by a regular expression; empty ones stay nameless, equal ones are an error."""
    made = re.split(pattern or ",", names) if isinstance(names, str) else [*names]
    made = [n.strip() for n in made] if strip else made
    seen = [n for n in made if n]
    if len(seen) != len(set(seen)):
        raise CsvError("two fields have the same name")
    return made


def _spark_can(d: CsvDialect) -> bool:
    return not d.standard_escapes and not d.trailing_delimiter and d.quoting != "QUOTE_NONE" and not d.skip_initial_space and (d.double_quote or bool(d.escape))


def read_csv(spark: SparkSession, path: str, dialect: CsvDialect = CsvDialect(), names: Sequence[str] | None = None, header: bool = False, multi_line: bool = False) -> DataFrame:
    """String columns of CSV files; without names or header c0, c1, ... A header must be the same in all files.

    multi_line: quoted fields may hold line ends; a file is then read by one task. Records with fewer
    fields than names have nulls at their end, more fields are an error.
    """
    if header and names is None:
        first = spark.read.text(path).limit(1).first()
        names = parse_record(iter([first[0]]), dialect) if first else []
    if names is None:
        first = spark.read.text(path).limit(1).first()
        names = [f"c{k}" for k in range(len(parse_record(iter([first[0]]), dialect) or []))] if first else []
    names = field_names([n or "" for n in names])
    kept = [n for n in names if n]
    schema = ", ".join(f"`{n}` string" for n in kept) or "c0 string"
    if _spark_can(dialect) and len(kept) == len(names) and names:
        options = {"sep": dialect.delimiter, "quote": dialect.quote, "escape": dialect.quote if dialect.double_quote else dialect.escape, "header": header, "multiLine": multi_line, "mode": "FAILFAST"}
        options["nullValue"] = dialect.null if dialect.has_null else "\0none"
        options["emptyValue"] = ""
        return spark.read.options(**options).schema(schema).csv(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for batch in batches:
            columns: list[list] = [[] for _ in kept]
            for text, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a record ends with its line, whatever lies in one batch with it, unless files are read whole
                records = parse_text(text if multi_line else text + "\n", dialect)
                if header and (multi_line or (at != place and at[1] == 0)):
                    if records and records[0] != [n or None for n in names]:
                        raise CsvError("a file's header differs from the first one's")
                    records = records[1:]
                place = at
                for record in records:
                    if len(record) > len(names):
                        raise CsvError(f"a record has {len(record)} fields instead of {len(names)}")
                    record = record + [None] * (len(names) - len(record))
                    for column, value in zip(columns, (v for n, v in zip(names, record, strict=True) if n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], kept)

    # the first line of a file is the first one of its block that begins at 0
    lines = spark.read.text(path, wholetext=multi_line).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    return lines.mapInArrow(parse, schema)


def write_csv(df: DataFrame, path: str, dialect: CsvDialect = CsvDialect(), mode: str = "errorifexists") -> None:
    """Writes a frame of scalars: numbers so that they are read back equal, booleans as 1 and 0.

    mode is Spark's: errorifexists, overwrite (truncates), append.
    """
    texts = df.select(*(field_text(F.col(f"`{f.name}`"), f.dataType.typeName(), dialect).alias(f"f{k}") for k, f in enumerate(df.schema.fields)))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([format_record(r, dialect) for r in rows], pa.string())], ["value"])

    texts.mapInArrow(form, "value string").write.mode(mode).text(path)


def field_text(value: Column, kind: str, dialect: CsvDialect) -> Column:
    if kind == "boolean":
        return F.when(value, "1").when(~value, "0")
    if kind in ("double", "float") and dialect.nonfinite_as_null:
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value.cast("string"))
    return value.cast("string")


def as_bool(text: Column) -> Column:
    """y, t, yes, true, 1 and n, f, no, false, 0 in any case; null for null; an error for all else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(text.isNull(), None).otherwise(F.raise_error(F.lit("a field is no boolean")).cast("boolean"))


def as_number(text: Column, kind: str) -> Column:
    """An integer or float of a field: an error for trailing characters or (integers) overflow; floats overflow to infinity."""
    plain = F.trim(text)
    made = plain.try_cast(kind)
    return F.when(text.isNull(), None).when(made.isNotNull(), made).otherwise(F.raise_error(F.lit(f"a field is no {kind}")).cast(kind))
