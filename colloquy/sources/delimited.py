"""Delimited files of many sources at once, read as CSV readers read them.

A cell that starts with a quote goes on to the closing quote, over separators and line ends; a doubled quote within is one
quote; what stands behind the closing quote counts as it is. Quotes anywhere else are plain characters. Lines end with
\\n, \\r or \\r\\n only, and a line end within a cell stays as it was. An empty line is no record. A quote that is never
closed takes the rest of its file, as with other readers.

Whether a line end ends a record depends on all quotes before it in the file. Each line alone tells in which state it ends
if it starts outside a quoted cell, and if it starts inside: either both are the same, or it keeps the state, or it turns
it. So the state before each line is that of the last line with a fixed end, turned as often as lines since then turn it:
two running values of a window over the file. No line is folded after another, and no file is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands between a quoted cell's quotes, and any cell of a record that starts and ends in it. All parts are possessive.
QUOTED = r'(?:[^"]++|"")*+'


def cell_pattern(separator: str) -> str:
    rest = rf'(?:[^"{separator}][^{separator}]*+)?+'
    return rf'(?:"{QUOTED}"{rest}|{rest})'


def raw_lines(texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, text and ending (empty for the last line if nothing ends it) of texts, cut at \\n, \\r and \\r\\n."""
    each = F.regexp_extract_all(text, F.lit("([^\r\n]*+(?:\r\n|\r|\n|(?<=[^\r\n])\\z))"), F.lit(1))
    one = texts.select(F.col(doc_id).alias("doc_id"), F.posexplode(each).alias("_pos", "_line"))
    body = F.rtrim(F.col("_line"), F.lit("\r\n"))
    return one.select("doc_id", (F.col("_pos") + 1).alias("line_no"), body.alias("text"), F.substr("_line", F.length(body) + 1).alias("ending"))


def records(lines: DataFrame, separator: str = "\t") -> DataFrame:
    """doc_id, record_no (from 1) and cells (an array of strings) of lines (doc_id, line_no, text, and ending or \\n)."""
    cell = cell_pattern(separator)
    ends_open = rf'(?:{cell}{separator})*+"{QUOTED}'
    rest = rf'(?:[^"{separator}][^{separator}]*+)?+'
    text = F.col("text")
    from_outside = text.rlike(rf"\A{ends_open}\z")
    from_inside = text.rlike(rf'\A{QUOTED}(?:"{rest}{separator}{ends_open})?+\z')
    ending = F.col("ending") if "ending" in lines.columns else F.lit("\n")
    own = lines.select("doc_id", "line_no", "text", ending.alias("_ending"), from_outside.alias("_a"), from_inside.alias("_b"))
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    own = own.withColumn("_turns", F.sum((F.col("_a") & ~F.col("_b")).cast("long")).over(upto))
    fixed = F.when(F.col("_a") == F.col("_b"), F.struct("_a", "_turns"))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"_fixed": F.last(fixed, ignorenulls=True).over(before), "_seen": F.coalesce(F.lag("_turns").over(upto), F.lit(0))})
    turned = (F.col("_seen") - F.coalesce(F.col("_fixed._turns"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("_fixed._a"), F.lit(False)) != turned
    goes_on = F.when(inside, F.col("_b")).otherwise(F.col("_a"))
    part = F.when(goes_on, F.concat("text", "_ending")).otherwise(F.col("text"))
    own = own.select("doc_id", "line_no", part.alias("_part"), (~inside).alias("_starts")).filter("not _starts or _part <> ''")
    own = own.withColumn("record_no", F.sum(F.col("_starts").cast("long")).over(upto))
    one = own.groupBy("doc_id", "record_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "_part"))).alias("_lines"))
    whole = F.array_join(F.transform("_lines", lambda x: x["_part"]), "")
    return one.select("doc_id", "record_no", cells_of(whole, separator).alias("cells"))


def cells_of(record: Column, separator: str = "\t") -> Column:
    """The cells of a record's text, unquoted; a last quoted cell may lack its closing quote."""
    each = F.regexp_extract_all(F.concat(F.lit(separator), record), F.lit(rf'{separator}({cell_pattern(separator)}(?={separator}|\z)|"{QUOTED}\z)'), F.lit(1))
    return F.transform(each, unquoted)


def unquoted(cell: Column) -> Column:
    inner = F.replace(F.regexp_extract(cell, rf'\A"({QUOTED})', 1), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), F.concat(inner, F.regexp_extract(cell, rf'(?s)\A"{QUOTED}"(.*)\z', 1))).otherwise(cell)


def by_name(lines: DataFrame, names: dict[str, tuple[str, ...]], separator: str = "\t") -> DataFrame:
    """doc_id, row_no (from 1) and a column for each of names, of files whose first record is their header.

    names: a column's name to the header names that it may have, the first filled one counts. Cells are found by place: of
    a name that a header repeats the last one counts; cells beyond the header are left out; what a file or row lacks is null.
    """
    every = records(lines, separator)
    header = every.filter("record_no = 1").select("doc_id", F.reverse("cells").alias("_names"))
    wanted = sorted({alias for own in names.values() for alias in own})
    places = [F.when(F.array_position("_names", alias) > 0, F.size("_names") - F.array_position("_names", alias)).cast("int").alias(f"_{k}") for k, alias in enumerate(wanted)]
    rows = every.filter("record_no > 1").join(header.select("doc_id", *places), "doc_id")
    at = {alias: F.get("cells", F.col(f"_{k}")) for k, alias in enumerate(wanted)}

    def filled(column: Column) -> Column:
        return F.when(F.trim(column) != "", column)

    return rows.select("doc_id", (F.col("record_no") - 1).alias("row_no"), *[F.coalesce(*[filled(at[a]) for a in own]).alias(name) for name, own in names.items()])
