"""Transcript lines as problems 3 and 4 see them: session, tool blocks, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import strip, uuid_form

BLOCKS = "array<struct<type:string,text:string,id:string,tool_use_id:string>>"


def read_lines(raw_line: DataFrame, source_file: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """line_id, batch_no, file_id, line_no, session, kind (type), role, meta,
    side, key (uuid form) and the derived columns, which can use blocks and text.

    content is a JSON string (one text) or an array of blocks; what is neither
    gives no text and no blocks. text joins the text blocks with blanks. A
    line whose file is unknown and that names no session has a null session.
    What is derived is formed before the lines meet their files, so that
    contents are never shuffled.
    """
    content = F.col("message.content")
    is_list = F.coalesce(F.ltrim(content).startswith("["), F.lit(False))
    is_text = F.coalesce(F.ltrim(content).startswith('"'), F.lit(False))
    blocks = F.when(is_list, F.filter(F.from_json(content, BLOCKS), lambda b: b.isNotNull()))
    joined = F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), " ")
    single = F.when(is_text, F.expr("try_variant_get(try_parse_json(message.content), '$', 'string')"))
    needed = raw_line.select("line_id", "batch_no", "file_id", "line_no", "type", "uuid", "sessionid", "issidechain", "ismeta", "message")
    lines = needed.select(
        "line_id", "batch_no", "file_id", "line_no", "sessionid",
        F.lower(strip(F.col("type"))).alias("kind"),
        F.col("message.role").alias("role"),
        F.coalesce("ismeta", F.lit(False)).alias("meta"),
        F.coalesce("issidechain", F.lit(False)).alias("side"),
        uuid_form(F.col("uuid")).alias("key"),
        F.coalesce(blocks, F.array().cast(BLOCKS)).alias("blocks"),
        single.alias("single"),
    )
    lines = lines.withColumn("text", F.coalesce("single", joined, F.lit("")))
    lines = lines.select("line_id", "batch_no", "file_id", "line_no", "sessionid", "kind", "role", "meta", "side", "key", *[c.alias(n) for n, c in derived.items()])
    rest = ["line_id", "batch_no", "file_id", "line_no", "kind", "role", "meta", "side", "key", *derived]
    blank = F.lit("")
    named = lines.withColumn("session", F.nullif(F.lower(strip(F.col("sessionid"))), blank))
    files = source_file.select("file_id", F.col("session").alias("_session")).groupBy("file_id").agg(F.min("_session").alias("_session"))
    # Only the few lines that name no session meet their files.
    other = named.where("session is null").drop("session").join(files, "file_id", "left").withColumn("session", F.nullif(F.lower(strip(F.col("_session"))), blank))
    order = ["line_id", "batch_no", "file_id", "line_no", "session", *rest[4:]]
    return named.where("session is not null").select(order).unionByName(other.select(order))


def tool_ids(blocks: Column) -> Column:
    """Sorted use:id and result:id of the tool blocks that have an id."""
    use = F.transform(F.filter(blocks, lambda b: (b["type"] == "tool_use") & (F.coalesce(b["id"], F.lit("")) != "")), lambda b: F.concat(F.lit("use:"), b["id"]))
    result = F.transform(F.filter(blocks, lambda b: (b["type"] == "tool_result") & (F.coalesce(b["tool_use_id"], F.lit("")) != "")), lambda b: F.concat(F.lit("result:"), b["tool_use_id"]))
    return F.array_sort(F.concat(use, result))


def has_tools(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: F.coalesce(b["type"].isin("tool_use", "tool_result"), F.lit(False)))


def plain_text(text: Column) -> Column:
    """The words, parted by white space, in lower case without punctuation, joined by blanks."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{M}\p{N}\s]+", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
