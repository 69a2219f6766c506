"""Canonical forms shared by the operators: acts, targets, identifiers, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outer white space that is stripped from identifiers, acts and targets.
BLANKS = " \t\n\r\x0b\x0c\x85     　﻿"
NO_POSITION = -(1 << 62)


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def act_form(col: Column) -> Column:
    """Lower case without outer white space; null where nothing is left."""
    return F.nullif(F.lower(strip(col)), F.lit(""))


def target_form(col: Column) -> Column:
    """Plain form of a target: no outer blanks, no leading ./, forward single
    slashes. Addresses with a scheme keep theirs. Null where nothing is left."""
    bare = strip(col)
    path = F.regexp_replace(F.translate(bare, "\\", "/"), "/{2,}", "/")
    path = F.regexp_replace(path, r"^(\./)+(?=.)", "")
    return F.nullif(F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), bare).otherwise(path), F.lit(""))


def uuid_form(col: Column) -> Column:
    """32 lower-case hex digits of a 128-bit identifier however it is written
    (case, braces, parentheses, urn:uuid:, 0x, hyphens or none, outer blanks);
    null for blanks, the all-zero identifier and what is no identifier."""
    usual = col.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    bare = F.lower(strip(col))
    bare = F.regexp_replace(bare, r"^(urn:)?(uuid:|guid:)", "")
    bare = F.regexp_replace(bare, r"^[{(\[\"']+|[})\]\"']+$", "")
    bare = F.regexp_replace(bare, r"^0x", "")
    odd = F.translate(bare, "-", "")
    odd = F.when(odd.rlike("^[0-9a-f]{32}$"), odd)
    # Most are written in the usual way and skip the other steps.
    digits = F.when(usual, F.translate(col, "-", "")).otherwise(odd)
    return F.nullif(digits, F.lit("0" * 32))


def session_form(line: Column, of_file: Column) -> Column:
    """The line's session in lower case without outer blanks, else the file's."""
    blank = F.lit("")
    return F.coalesce(F.nullif(F.lower(strip(line)), blank), F.nullif(F.lower(strip(of_file)), blank))


def stream_ids(df: DataFrame, keys: tuple[str, ...] = ("p", "s", "a")) -> list[Column]:
    """Two independent 64-bit hashes of the stream's key: 128 bits stand for it
    in shuffles and sorts. Nulls count as a value of their own."""
    own = [F.coalesce(df[k].cast("string"), F.lit("\x00")) for k in keys]
    mixed = [F.concat(F.lit("~"), c) for c in reversed(own)]
    return [F.xxhash64(*own).alias("sid"), F.xxhash64(F.lit(7), *mixed).alias("sid2")]
