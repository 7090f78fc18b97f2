"""Structured log lines in compact log event format (newline-delimited JSON with ``@`` fields)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.base import let, text_or_empty
from logloom.functions.json_text import as_text, filled, object_members, render_template, without
from logloom.functions.timeparse import rfc3339

# --- fixed values: reserved member names ----------------------------------------------------------
RESERVED = ["@t", "@l", "@mt", "@m", "@x", "@i"]
# ------------------------------------------------------------------------------------------------


def split_lines(body: Column) -> Column:
    """Trimmed, non-blank lines."""
    trimmed = F.transform(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(" \t\r\x0b\x0c\u0085 ")))
    return F.filter(trimmed, lambda line: line != "")


def member_text(members: Column, key: str) -> Column:
    return as_text(F.try_element_at(members, F.lit(key)))


def clef_timestamp(members: Column) -> Column:
    """The required ``@t``; NULL marks a line to skip."""
    return rfc3339(member_text(members, "@t"))


def any_valid(lines: Column) -> Column:
    """Whether some line is a JSON object with a valid ``@t``; stops at the first one."""
    return F.exists(lines, lambda line: let(object_members(line), clef_timestamp).isNotNull())


def clef_properties(members: Column) -> Column:
    return without(members, RESERVED)


def clef_texts(members: Column) -> dict[str, Column]:
    """Reserved text members, under the column names ``clef_fields`` reads."""
    return {f"clef_{name[1:]}": member_text(members, name) for name in RESERVED if name != "@t"}


def clef_fields(props: Column, own: Column, added: Column, timestamp: Column, source: Column) -> dict[str, Column]:
    """Event fields from columns computed one step before: the texts of ``clef_texts``, the non-reserved members,
    their JSON text and that of the enrichment still needed."""
    template, given = text_or_empty(F.col("clef_mt")), text_or_empty(F.col("clef_m"))
    message = F.when((given == "") & (template != ""), render_template(template, props)).otherwise(given)
    return {
        "timestamp": timestamp,
        "level": F.coalesce("clef_l", F.lit("Information")),
        "message_template": template,
        "message": message,
        "exception": text_or_empty(F.col("clef_x")),
        "given_type": text_or_empty(F.col("clef_i")),
        "source": source,
        "properties": filled(own, added),
    }
