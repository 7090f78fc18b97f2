"""JSON objects as ``map<string,variant>``: typed members, canonical text, template rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.base import apply_sql, let, let_sql

OBJECT_TYPE = "map<string,variant>"


END_MARK = "\u0003end"
END_MARK_ESCAPED = "\\u0003end"


def strict_json(text: Column) -> Column:
    """A variant holding the parsed text, for ``is_whole`` and ``members_of``; NULL for malformed JSON.

    The parser stops after the first value and ignores what follows. Inside an array that ends with a mark,
    trailing text is either malformed or keeps the mark from its place.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK_ESCAPED}"]')))


def is_whole(parsed: Column) -> Column:
    """Whether the text was exactly one JSON value."""
    return F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == END_MARK, F.lit(False))


def members_of(parsed: Column) -> Column:
    """Members of the object, keys ascending; NULL unless the text was exactly one JSON object."""
    return F.when(is_whole(parsed), F.try_variant_get(parsed, "$[0]", OBJECT_TYPE))


def object_members(text: Column) -> Column:
    """Members of a JSON object, keys ascending; NULL when the text is not exactly one JSON object."""
    return let(strict_json(text), members_of)


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_number(value: Column) -> Column:
    """Variant types BIGINT, DECIMAL(p,s), DOUBLE and FLOAT."""
    return F.left(F.schema_of_variant(value), F.lit(3)).isin("BIG", "DEC", "DOU", "FLO")


def as_text(value: Column) -> Column:
    """The string held by a variant, NULL for every other type."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def as_number(value: Column) -> Column:
    """The number held by a variant, NULL for every other type (numeric strings included)."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def parse_float(text: Column) -> Column:
    """Decimal text to DOUBLE, NULL unless the whole text is a number."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def number_or_numeric_text(value: Column) -> Column:
    return F.coalesce(as_number(value), parse_float(as_text(value)))


def _shortest_sql(x: str) -> str:
    """Scientific text of a double with as few digits as read back to it."""
    tries = [f"format_string('%.{digits}e', {x})" for digits in (14, 15, 16)]
    return f"CASE WHEN double({tries[0]}) = {x} THEN {tries[0]} WHEN double({tries[1]}) = {x} THEN {tries[1]} ELSE {tries[2]} END"


def _written_sql(x: str, powered: str, exponent: str) -> str:
    """A double in its shortest form: ``exponent`` is its exponent's text, used where ``powered`` holds for its ``power``."""
    plain = ("CASE WHEN digits = '' THEN '0' WHEN power < 0 THEN concat('0.', repeat('0', -power - 1), digits) "
             "WHEN length(digits) <= power + 1 THEN rpad(digits, power + 1, '0') "
             "ELSE concat(left(digits, power + 1), '.', substring(digits, power + 2)) END")
    scientific = f"concat(left(digits, 1), if(length(digits) > 1, concat('.', substring(digits, 2)), ''), 'e', if(power < 0, '-', '+'), {exponent})"
    body = f"concat(if(sci LIKE '-%', '-', ''), if({x} <> 0 AND ({powered}), {scientific}, {plain}))"
    digits = "rtrim('0', translate(split_part(sci, 'e', 1), '-.', ''))"
    finite = let_sql(_shortest_sql(x), "sci", let_sql("int(split_part(sci, 'e', 2))", "power", let_sql(digits, "digits", body)))
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) OR abs({x}) = double('Infinity') THEN string({x}) ELSE {finite} END"


def general_sql(x: str) -> str:
    """Shortest form of a double: plain for 1e-4 <= |x| < 1e6, else with a signed exponent of two digits at least."""
    return _written_sql(x, "power < -4 OR power >= 6", "lpad(string(abs(power)), greatest(2, length(string(abs(power)))), '0')")


def number_sql(x: str) -> str:
    """A double as JSON writes it: shortest form, plain for 1e-6 <= |x| < 1e21, else with a signed exponent."""
    return _written_sql(x, "power < -6 OR power >= 21", "string(abs(power))")


def general_number(x: Column) -> Column:
    return apply_sql(x, "x", general_sql("x"))


# --- fixed values: characters that JSON text writes as escapes, and what it writes -----------------
ESCAPED = {"&": "\\u0026", "<": "\\u003c", ">": "\\u003e", "\u2028": "\\u2028", "\u2029": "\\u2029"}
# ------------------------------------------------------------------------------------------------

#: A run of strings without the characters above and of what stands between values, a number, or another string. Possessive,
#: so that long texts need no stack.
_TOKEN = r'(?:[^"0-9-]++|"(?:[^"\\&<>\u2028\u2029]++|\\.)*+")++|-?[0-9][-+.0-9eE]*+|"(?:[^"\\]++|\\.)*+"'
#: Whether a text may hold something that is written in another way (long numbers, exponents, trailing zeros, escapes).
_ODD = r"[&<>\u2028\u2029]|[0-9][eE]|[.][0-9]*0[,}\]]|[0-9.]{16}|0[.]00000"


def _literal(text: str) -> str:
    return "r'" + text + "'"


def wire_sql(text: str, exact: bool) -> str:
    """JSON text as it goes over the wire: the characters above escaped in strings, every number as ``number_sql`` writes
    it. ``exact`` leaves whole numbers without point and exponent as they are (64-bit integers); otherwise all are doubles.

    One test decides whether a text needs any of this; most do not.
    """
    string = "tok"
    for char, written in ESCAPED.items():
        string = f"replace({string}, '{char}', r'{written}')"
    odd = "tok RLIKE '[.eE]'" + ("" if exact else " OR length(tok) >= 16")
    token = (f"CASE WHEN left(tok, 1) = '\"' THEN {string} WHEN tok RLIKE '^-?[0-9]' AND ({odd}) THEN "
             + let_sql("double(tok)", "num", number_sql("num")) + " ELSE tok END")
    tokens = f"transform(regexp_extract_all({text}, {_literal(_TOKEN)}, 0), tok -> {token})"
    return f"if({text} RLIKE {_literal(_ODD)}, array_join({tokens}, ''), {text})"


def wire_form(text: Column, exact: bool = False) -> Column:
    """``wire_sql`` of a column that is computed once."""
    return apply_sql(text, "t", wire_sql("t", exact))


_WHOLE = "if(d = floor(d) AND abs(d) < double(9223372036854775807L), string(bigint(d)), " + general_sql("d") + ")"
_DISPLAY = f"""
CASE left(schema_of_variant(v), 3)
  WHEN 'STR' THEN try_variant_get(v, '$', 'string')
  WHEN 'BOO' THEN try_variant_get(v, '$', 'string')
  WHEN 'VOI' THEN 'null'
  WHEN 'OBJ' THEN {let_sql("to_json(v)", "j", wire_sql("j", False))}
  WHEN 'ARR' THEN {let_sql("to_json(v)", "j", wire_sql("j", False))}
  ELSE {let_sql("try_variant_get(v, '$', 'double')", "d", _WHOLE)}
END"""


def display(value: Column) -> Column:
    """A member as it appears inside a rendered template."""
    return apply_sql(value, "v", _DISPLAY)


def canonical(members: Column) -> Column:
    """JSON text of a map whose keys are ascending; ``{}`` for an empty or missing map."""
    return F.when(F.coalesce(F.size(members), F.lit(0)) <= 0, F.lit("{}")).otherwise(wire_form(F.to_json(members)))


def without(members: Column, keys: list[str]) -> Column:
    return F.map_filter(members, lambda k, _: ~k.isin(*keys)) if keys else members


def render_template(template: Column, members: Column) -> Column:
    """Replace every ``{key}`` by its member's display text, keys in ascending order."""
    def substitute(text: Column, entry: Column) -> Column:
        slot = F.concat(F.lit("{"), entry["key"], F.lit("}"))
        return F.when(F.contains(text, slot), F.replace(text, slot, display(entry["value"]))).otherwise(text)

    rendered = F.aggregate(F.map_entries(members), template, substitute)
    return F.when(F.contains(template, F.lit("{")), rendered).otherwise(template)


def missing_entries(members: Column, extra: Column) -> Column:
    """Non-empty ``extra`` texts whose key is absent, null or empty text among the members."""
    def blank(key: Column) -> Column:
        return F.coalesce(F.try_variant_get(F.try_element_at(members, key), "$", "string"), F.lit("")) == ""

    return F.map_filter(extra, lambda k, v: v.isNotNull() & (v != "") & blank(k))


def without_entries(members: Column, needed: Column) -> Column:
    """JSON text of the members whose key is not among ``needed``, for ``filled``."""
    has = F.coalesce(F.size(needed), F.lit(0)) > 0
    kept = F.when(has, F.map_filter(members, lambda k, _: ~F.map_contains_key(needed, k))).otherwise(members)
    return F.coalesce(F.to_json(kept), F.lit("{}"))


def filled(own: Column, added: Column) -> Column:
    """One canonical object from two object texts without common keys; ``added`` may be NULL or empty.

    Joined as text and parsed once, which brings the keys into order.
    """
    head = F.when(own == "{}", F.lit("{")).otherwise(F.concat(F.left(own, F.length(own) - 1), F.lit(",")))
    merged = F.to_json(F.parse_json(F.concat(head, F.substring(added, F.lit(2), F.length(added)))))
    return wire_form(F.when(F.coalesce(added, F.lit("{}")) == "{}", own).otherwise(merged))
