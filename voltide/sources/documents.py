"""Parsers for the document formats: JSON arrays, XML elements, HTML tables."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voltide import constants as K
from voltide.sources.markup import elements, table_rows

# rows of tables that a task hands on at a time
ROWS_AT_ONCE = 1 << 14
# --- fixed values: the white space that is trimmed ------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(x: Column) -> Column:
    """Trim every kind of white space, non-breaking spaces included."""
    return F.btrim(x, F.lit(WHITE_SPACE))


def read_text_payloads(spark, path: str, exchange: str, kind: str) -> DataFrame:
    """Whole text files as documents; the day is the ISO date in the path."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.lit(exchange).alias("exchange"),
        F.lit(kind).alias("kind"),
        F.try_to_date(F.regexp_extract(F.col("_metadata.file_path"), K.ISO_DATE, 1), "yyyy-MM-dd").alias("trade_date"),
        F.col("value").alias("payload"),
    )


def read_binary_payloads(spark, path: str, exchange: str, kind: str, charset: str = K.SOURCE_CHARSET) -> DataFrame:
    """Whole binary files decoded from the exchange's character set.

    Spark accepts this charset only with ``spark.sql.legacy.javaCharsets``,
    which ``voltide.session`` turns on.
    """
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(
        F.lit(exchange).alias("exchange"),
        F.lit(kind).alias("kind"),
        F.try_to_date(F.regexp_extract("path", K.ISO_DATE, 1), "yyyy-MM-dd").alias("trade_date"),
        F.decode("content", charset).alias("payload"),
    )


def json_rows(payloads: DataFrame, array_field: str, fields: list) -> DataFrame:
    """One row per element of a JSON document's array; every field as text."""
    record = ",".join(f"{f}:string" for f in fields)
    parsed = F.from_json("payload", f"struct<{array_field}:array<struct<{record}>>>")
    return payloads.withColumn("_rows", parsed[array_field]).select(
        "exchange", "trade_date", F.posexplode_outer("_rows").alias("pos", "r")
    ).where(F.col("r").isNotNull()).select("exchange", "trade_date", "pos", *[F.col(f"r.{f}").alias(f) for f in fields])


def _parsed_rows(payloads: DataFrame, schema: str, columns) -> DataFrame:
    """Rows of each document: exchange, trade_date and the columns of ``schema``.

    ``columns`` makes one list of values per column of a text. A row carries its
    own values only, so a document costs its length, whatever its number of
    rows.
    """
    def run(batches):
        for batch in batches:
            names = schema_names[2:]
            source, values = [], [[] for _ in names]

            def flush():
                at = pa.array(source, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(v, types[n]) for n, v in zip(names, values)]], schema_names)

            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                if text is None:
                    continue
                found = columns(text)
                source.extend([i] * len(found[0]))
                for whole, own in zip(values, found):
                    whole.extend(own)
                if len(source) >= ROWS_AT_ONCE:
                    yield flush()
                    source, values = [], [[] for _ in names]
            if source:
                yield flush()

    fields = [f.split(" ", 1) for f in schema.split(", ")]
    schema_names = ["exchange", "trade_date", *[n for n, _ in fields]]
    types = {n: {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[kind] for n, kind in fields}
    return payloads.select("exchange", "trade_date", "payload").mapInArrow(run, f"exchange string, trade_date date, {schema}")


def xml_rows(payloads: DataFrame, row_tag: str, fields: list) -> DataFrame:
    """One row per ``row_tag`` element at any depth; absent or empty children are NULL.

    A document is parsed once. One that is no well-formed XML gives the
    elements that can be cut out of it and parsed on their own.
    """
    def columns(text):
        rows = elements(text, row_tag, fields)
        return [list(range(len(rows))), *[[row[k] for row in rows] for k in range(len(fields))]]

    return _parsed_rows(payloads, ", ".join(["pos int", *[f"{f} string" for f in fields]]), columns)


def html_table_rows(payloads: DataFrame, header: str = "thead") -> DataFrame:
    """Rows of the first table of each document: (exchange, trade_date, row_pos, titles, cells).

    ``header='th'`` takes the titles from the rows of ``th`` cells and the rows
    from the whole table; ``header='thead'`` takes them from the table head,
    and the rows from the table body.
    """
    def columns(text):
        titles, rows = table_rows(text, header)
        kept = [k for k, row in enumerate(rows) if row]
        return kept, [titles] * len(kept), [rows[k] for k in kept]

    return _parsed_rows(payloads, "row_pos int, titles array<string>, cells array<string>", columns)


def html_records(payloads: DataFrame, names: dict, header: str = "thead", carry: str = None) -> DataFrame:
    """Rows of the first table of each document with named cells: (exchange, trade_date, pos, names..., carried).

    ``names`` maps a column to the titles it can stand under, looked up once a
    document; a row too short for a title gives NULL. ``carry`` names a column
    whose value in the row before, empty rows included, becomes ``carried``.
    """
    known = [None, []]  # the titles of the document before, and where each name stands

    def columns(text):
        titles, rows = table_rows(text, header)
        if titles != known[0]:
            known[:] = titles, [[titles.index(t) for t in wanted if t in titles] for wanted in names.values()]
        kept = [k for k, row in enumerate(rows) if row]
        out = [kept]
        if kept and min([len(rows[k]) for k in kept]) >= len(titles):
            cells = list(zip(*[rows[k] for k in kept]))
            out += [cells[places[0]] if places else [None] * len(kept) for places in known[1]]
        else:
            out += [[next((rows[k][p] for p in places if p < len(rows[k])), None) for k in kept] for places in known[1]]
        if carry is None:
            return out
        at = dict(zip(kept, out[1 + list(names).index(carry)]))
        return [*out, [at.get(k - 1) for k in kept]]

    fields = ["pos int", *[f"{name} string" for name in names], *([] if carry is None else ["carried string"])]
    return _parsed_rows(payloads, ", ".join(fields), columns)
