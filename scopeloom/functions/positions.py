"""Text positions: lengths in UTF-8, UTF-16 and graphemes, lines with byte bounds, spans."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

ship(__name__)


def utf8_len(s: Column) -> Column:
    return F.octet_length(s)


def utf16_len(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def _graphemes(s: pd.Series) -> pd.Series:
    import regex

    return s.map(lambda t: None if t is None else len(regex.findall(r"\X", t)))


def grapheme_len(s: Column) -> Column:
    """Extended grapheme clusters. Text without marks, joiners or CR-LF needs no clustering: ``length`` is right there."""
    simple = ~s.rlike(r"[\p{M}\x{200D}\x{FE00}-\x{FE0F}\x{1F1E6}-\x{1F1FF}\x{1F3FB}-\x{1F3FF}\x{1100}-\x{11FF}]|\r\n")
    return F.when(simple, F.length(s)).otherwise(F.pandas_udf(_graphemes, "int")(F.when(~simple, s)))


def offsets(s: Column) -> Column:
    return F.struct(utf8_len(s).alias("utf8"), utf16_len(s).alias("utf16"), grapheme_len(s).alias("grapheme"))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: number, text, byte bounds. A final newline ends the last line and starts none."""
    cut = F.when(F.endswith(F.col(text), F.lit("\n")), F.expr(f"slice(split({text}, '\\n'), 1, size(split({text}, '\\n')) - 1)")).otherwise(F.split(text, "\n"))
    rows = df.where(F.length(text) > 0).select(key, F.posexplode(cut).alias("line", "line_text"))
    before = F.sum(F.octet_length("line_text") + 1).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(key, "line", "line_text", F.coalesce(before, F.lit(0)).alias("start"), (F.coalesce(before, F.lit(0)) + F.octet_length("line_text")).alias("end"))


def trim_ascii(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\t\n\x0C\r ]+|[\t\n\x0C\r ]+$", "")


def contains(start_line, start_col, end_line, end_col, line, col) -> Column:
    """start <= position < end, by line and byte column."""
    at = F.struct(line, col)
    return (F.struct(start_line, start_col) <= at) & (at < F.struct(end_line, end_col))


def within(start_line, start_col, end_line, end_col, line, col) -> Column:
    """The same, inclusive at the end."""
    at = F.struct(line, col)
    return (F.struct(start_line, start_col) <= at) & (at <= F.struct(end_line, end_col))


def parse_position(s: Column) -> Column:
    """``PATH:LINE:COLUMN``, counted from 1, to a struct counted from 0; null if malformed."""
    good = s.rlike(r"^[^:]*:[1-9][0-9]*:[1-9][0-9]*$")
    part = lambda k: F.regexp_extract(s, r"^([^:]*):([0-9]+):([0-9]+)$", k)
    return F.when(good, F.struct(part(1).alias("path"), (part(2).cast("int") - 1).alias("line"), (part(3).cast("int") - 1).alias("column")))


# ---- positions in lines


def _boundaries(s: pd.Series) -> pd.Series:
    import regex

    return s.map(lambda t: None if t is None else [m.start() for m in regex.finditer(r"\X", t)])


_PLAIN = r"[\p{M}\x{200D}\x{FE00}-\x{FE0F}\x{1F1E6}-\x{1F1FF}\x{1F3FB}-\x{1F3FF}\x{1100}-\x{11FF}]|\r\n"


def grapheme_starts(s: Column) -> Column:
    """The characters, counted from 0, at which an extended grapheme cluster starts."""
    simple = ~s.rlike(_PLAIN)
    return F.when(simple, F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.pandas_udf(_boundaries, "array<int>")(F.when(~simple, s)))


#: Characters that are each a cluster of their own next to any other of them: what isn't here is left to ``regex``.
_ALONE = r"[\x00-\x0C\x0E-\u02FF\u0370-\u0482\u048A-\u058F\u2010-\u2027\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3]*"


def _char_ends(batches):
    """Of (key, text) a row for each character and one for the end: bytes, UTF-16 units and clusters begun before. Some texts at
    a time, so that what waits in memory doesn't grow with a batch."""
    import re

    import numpy as np
    import pyarrow as pa
    import regex

    alone, made = re.compile(_ALONE), ["i", "utf8", "utf16", "grapheme"]
    for b in batches:
        for lo in range(0, b.num_rows, 128):
            part = b.slice(lo, 128)
            sums, sizes = {c: [] for c in made}, []
            for t in part.column(1).to_pylist():
                first = np.frombuffer(t.encode("utf-8"), np.uint8)
                at = np.flatnonzero((first & 0xC0) != 0x80)
                starts = np.ones(len(at), np.int32)
                if not alone.fullmatch(t):
                    starts[:] = 0
                    starts[[m.start() for m in regex.finditer(r"\X", t)]] = 1
                sizes.append(len(at) + 1)
                sums["i"].append(np.arange(len(at) + 1))
                sums["utf8"].append(np.append(at, len(first)))
                sums["utf16"].append(np.append(0, np.cumsum(1 + (first[at] >= 0xF0))))
                sums["grapheme"].append(np.append(0, np.cumsum(starts)))
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), *[pa.array(np.concatenate(sums[c]).astype(np.int32)) for c in made]], [b.schema.names[0], *made])


def all_chars(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, utf8, utf16, grapheme) of every character of a line and of its end: what comes before it. Inside of a cluster
    the cluster counts as begun. Work grows with the length: ASCII text without CR-LF needs its numbers alone, other text has
    all its offsets summed in one pass."""
    t, i = F.col(text), F.col("i")
    plain = (F.octet_length(t) == F.length(t)) & ~F.contains(t, F.lit("\r\n"))
    numbered = df.where(plain).select(key, F.explode(F.sequence(F.lit(0), F.length(t))).alias("i")).select(key, "i", *[i.alias(c) for c in ("utf8", "utf16", "grapheme")])
    return numbered.unionByName(df.where(~plain).select(key, text).mapInArrow(_char_ends, numbered.schema))


def _bytes(s: Column, start: Column, length: Column | None = None) -> Column:
    b = F.encode(s, "UTF-8")
    return F.decode(F.substring(b, start + 1, F.greatest(length if length is not None else F.octet_length(s) - start, F.lit(0))), "UTF-8")


def _positioned(content: Column, start: Column) -> Column:
    bounds = F.struct(start.alias("start"), (start + F.octet_length(content)).alias("end"))
    return F.struct(content.alias("content"), bounds.alias("utf8_bounds"), utf16_len(content).alias("utf16_length"), grapheme_len(content).alias("grapheme_length"))


def from_range(s: Column, start: Column, end: Column) -> Column:
    """The substring of the bytes [start, end), with its bounds and lengths."""
    return _positioned(_bytes(s, start, end - start), start)


def from_line(s: Column, start: Column) -> Column:
    """The line that starts at a byte: up to the next newline, or the end."""
    return _positioned(F.substring_index(_bytes(s, start), "\n", 1), start)


def trimmed(start: Column, line: Column) -> Column:
    """Byte bounds of a line, that starts at ``start``, without white space at its ends; of a blank line, its end."""
    left = F.octet_length(line) - F.octet_length(F.regexp_replace(line, r"^[\t\n\x0C\r ]+", ""))
    return F.struct((start + left).alias("start"), (start + left + F.octet_length(trim_ascii(line))).alias("end"))


def at_column(line: Column, text: Column, column: Column) -> Column:
    """The position of a byte column in a line: (line, utf8, utf16, grapheme)."""
    before = _bytes(text, F.lit(0), column)
    return F.struct(line.cast("int").alias("line"), utf8_len(before).alias("utf8"), utf16_len(before).alias("utf16"), grapheme_len(before).alias("grapheme"))


def at_grapheme(line: Column, text: Column, grapheme: Column) -> Column:
    """The position of a grapheme column in a line; beyond it, of its end."""
    starts = grapheme_starts(text)
    before = F.substring(text, F.lit(1), F.coalesce(F.get(starts, grapheme), F.length(text)))
    return F.struct(line.cast("int").alias("line"), utf8_len(before).alias("utf8"), utf16_len(before).alias("utf16"), F.least(grapheme, F.size(starts)).cast("int").alias("grapheme"))


def node_spans(places: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``places`` (``key``, start_line, start_column, end_line, end_column; byte columns) with the span between the two positions,
    and the line that holds its start."""
    text = lines(sources, key, "text").select(key, "line", "line_text")
    s, e = (text.select(F.col(key).alias(f"{p}_key"), F.col("line").alias(f"{p}_line"), F.col("line_text").alias(f"{p}_text")) for p in ("s", "e"))
    rows = places.join(s, (F.col(key) == F.col("s_key")) & (F.col("start_line") == F.col("s_line"))).join(e, (F.col(key) == F.col("e_key")) & (F.col("end_line") == F.col("e_line")))
    span = F.struct(at_column(F.col("start_line"), F.col("s_text"), F.col("start_column")).alias("start"), at_column(F.col("end_line"), F.col("e_text"), F.col("end_column")).alias("end"))
    return rows.select(*places.columns, span.alias("span"), F.col("s_text").alias("containing_line"))


def position_order(p: Column) -> Column:
    return F.struct(p["line"].alias("line"), p["utf8"].alias("utf8"))


def span_order(span: Column) -> Column:
    """Spans by their start, then by their end."""
    return F.struct(position_order(span["start"]).alias("start"), position_order(span["end"]).alias("end"))


def first_line_columns(span: Column) -> Column:
    """Grapheme columns of a span on its first line; no end, if it goes on to the next."""
    return F.struct(span["start"]["grapheme"].alias("start"), F.when(span["start"]["line"] == span["end"]["line"], span["end"]["grapheme"]).alias("end"))
