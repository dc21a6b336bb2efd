"""Column expressions over matrix rows and raw records.

Everything here stays inside Catalyst; nothing starts a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that separate numbers in a text matrix.
BLANKS = " \t\r\n\f\x0b"


def fail(message: str | Column, as_type: str) -> Column:
    """An expression of ``as_type`` that raises when it is evaluated."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.raise_error(text).cast(as_type)


def cell(value: Column, what: str) -> Column:
    """``value`` as a double; a null raises."""
    return F.coalesce(value.cast("double"), fail(f"null cell in {what}", "double"))


def row_cells(row: Column, n: int) -> list[Column]:
    """The ``n`` cells of a row as doubles. A row of another width raises, with its
    first cell; so does a null."""
    found = [cell(row[j], f"column {j}") for j in range(n)]
    size = F.coalesce(F.size(row), F.lit(-1))
    other = fail(F.concat(F.lit(f"matrix row must have {n} entries, found "), size.cast("string")), "double")
    return [F.when(size.isin(n, -1), found[0]).otherwise(other), *found[1:]]


def has_numbers(text: Column) -> Column:
    """Whether a text line holds anything but blanks."""
    return text.rlike(r"\S")


def numbers(text: Column, strict: bool = True) -> Column:
    """Blank-separated numbers as ``array<double>``.

    A word that is no number raises, or becomes a null cell if not ``strict``.
    """
    words = F.split(F.btrim(text, F.lit(BLANKS)), r"\s+")
    return words.cast("array<double>") if strict else words.try_cast("array<double>")


def is_full(row: Column, width: int | Column) -> Column:
    """Whether ``row`` has ``width`` cells and none of them is null.

    ``array_contains`` is compiled, and null for a row that has a null cell and
    not the value looked for. Only rows with a NaN need the slower lambda.
    """
    no_nan = F.coalesce(~F.array_contains(row, F.lit(float("nan"))), F.lit(False))
    full = no_nan | ~F.exists(row, lambda x: x.isNull())
    return F.coalesce((F.size(row) == width) & full, F.lit(False))


def centred(row: Column) -> Column:
    """Every entry less the mean of its own row.

    The mean is bound to a lambda variable so that it is computed once per row
    rather than once per cell.
    """
    mean = F.aggregate(row, F.lit(0.0), lambda total, x: total + x) / F.size(row)
    return F.transform(
        F.array(mean), lambda mu: F.transform(row, lambda x: x - mu)
    )[0]


def unit_sign(value: Column) -> Column:
    """-1 for negative values, +1 otherwise (zero included)."""
    return F.when(value < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def tokens(text: Column, sep: str = " ") -> Column:
    """Pieces of ``text`` between separators.

    Empty pieces inside are kept; one closing separator ends the last piece
    instead of opening another, and an empty text has no piece at all.
    """
    pattern = sep if sep == " " else rf"\Q{sep}\E"
    body = F.when(
        F.endswith(text, F.lit(sep)),
        F.substring(text, F.lit(1), F.length(text) - len(sep)),
    ).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, pattern)
    )


def offset_value(key: Column) -> Column:
    """An eight-byte big-endian key as a long."""
    return F.conv(F.hex(key), 16, -10).cast("long")


def record_number(offset: Column, record_length: int) -> Column:
    """The number of the record that starts at a byte offset."""
    return F.call_function("div", offset, F.lit(record_length))


def is_record_start(offset: Column, record_length: int) -> Column:
    """Whether a byte offset is a multiple of the record length."""
    return offset % F.lit(record_length) == 0


def byte_range(value: Column, start: int, end: int) -> Column:
    """Bytes ``start`` to ``end`` (both included, from 0) of a binary value."""
    return F.substring(value, start + 1, end - start + 1)
