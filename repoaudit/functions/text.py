"""Line and string operators over file texts. All are column expressions: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoaudit.functions.regex import Bank, has_any, jvm, strip

# fixed value: every line boundary that a text line split recognises
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"
RARE_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"


def line_array(text: Column) -> Column:
    """Lines of a text without their terminators; a final terminator opens no extra line."""
    # most texts hold line feeds only, and a one-character split needs no regular expression
    plain = F.split(text, "\n", -1)
    pieces = F.array(F.when(text.rlike(RARE_BREAK), F.split(text, LINE_BREAK, -1)).otherwise(plain))
    # bound by a one-element transform, so that the split runs once
    whole = F.transform(
        pieces, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    )
    return F.element_at(whole, 1)


def explode_lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per line, numbered from 1. The file text itself is dropped."""
    cols = keep or ["repo_id", "path"]
    return files.select(*cols, F.posexplode(line_array(F.col("text"))).alias("pos", "line")).select(
        *cols, (F.col("pos") + 1).alias("line_no"), "line"
    )


def numbered(lines: Column) -> Column:
    """Array of (line_no, line) structs."""
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))


def hit_lines(lines: Column, rules: Bank) -> Column:
    """Line numbers, ascending, on which any pattern of the bank occurs."""
    marked = F.transform(lines, lambda x, i: F.when(has_any(x, rules), i + 1))
    return F.filter(marked, lambda n: n.isNotNull())


def first_match_line(lines: Column, rules: Bank) -> Column:
    """Number of the first line that hits the bank, or null."""
    return F.try_element_at(hit_lines(lines, rules), F.lit(1))


def line_at(lines: Column, line_no: Column) -> Column:
    """Text of one line by number; null when there is no such line."""
    return F.when(line_no >= 1, F.try_element_at(lines, line_no))


def snippet(line: Column) -> Column:
    """A whole line without outer white space; empty when there is none."""
    return strip(F.coalesce(line, F.lit("")))


def collapse_snippet(text: Column) -> Column:
    """White space runs become one blank."""
    return strip(F.regexp_replace(text, jvm(r"\s+"), " "))


def line_of(text: Column, needle: Column) -> Column:
    """Line (counting ``\\n`` only) of the first occurrence of a literal; null when absent."""
    at = F.expr("0") if needle is None else F.instr(text, needle)
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def count_literals(text: Column, tokens: list[str]) -> Column:
    """Non-overlapping occurrences of several literals, summed."""
    total = F.lit(0)
    for token in tokens:
        shrunk = F.length(F.replace(text, F.lit(token), F.lit("")))
        total = total + ((F.length(text) - shrunk) / len(token)).cast("int")
    return total


def ts_code_lines(text: Column) -> Column:
    """Lines of a TypeScript text with comments taken out.

    A line comment or block comment is replaced piecewise: within each comment
    match everything but line breaks is dropped.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)//[^\n\r]*|/\*.*?(?:\*/|\z)|[^/]+|/"), F.lit(0))
    kept = F.transform(
        pieces,
        lambda p: F.when(p.startswith("//"), F.lit(""))
        .when(p.startswith("/*"), F.regexp_replace(p, r"[^\n\r]", ""))
        .otherwise(p),
    )
    return line_array(F.array_join(kept, ""))


def code_line_array(text: Column, language: Column) -> Column:
    """Code lines with surrounding space removed: no blanks, no comments."""
    py = F.filter(F.transform(line_array(text), strip), lambda s: (s != "") & ~s.startswith("#"))
    ts = F.filter(F.transform(ts_code_lines(text), strip), lambda s: s != "")
    return F.when(language == "python", py).otherwise(ts)


def nloc(text: Column, language: Column) -> Column:
    return F.size(code_line_array(text, language))


def normalized_lines(text: Column, language: Column) -> Column:
    """Code lines with every white space character removed."""
    return F.transform(code_line_array(text, language), lambda s: F.regexp_replace(s, jvm(r"\s+"), ""))


def slug(heading: Column, collapse_dashes: bool = True) -> Column:
    """Anchor name of a heading. The two document checkers differ in the dash rule."""
    low = F.lower(strip(heading))
    bare = F.regexp_replace(low, jvm(r"[^\w\s-]"), "")
    dashed = F.regexp_replace(bare, jvm(r"\s+"), "-") if collapse_dashes else F.replace(bare, F.lit(" "), F.lit("-"))
    if collapse_dashes:
        dashed = F.regexp_replace(dashed, "-+", "-")
        return F.regexp_replace(dashed, "^-+|-+\\z", "")
    return dashed


def redact(value: Column, keep: int = 4) -> Column:
    """Preview of a secret: the first characters only."""
    return F.concat(F.substring(value, 1, keep), F.lit("…"))
