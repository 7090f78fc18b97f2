"""The event-type fingerprint: standard 32-bit MurmurHash3 (x86 variant, seed 0) as column arithmetic.

Spark's own ``hash`` runs the same block step but starts from seed 42 and treats a trailing 1-3 byte
remainder differently. Two facts make it usable here without any Python UDF:

* ``hash(a, b)`` seeds the hash of ``b`` with the hash of ``a``; an integer whose hash is 0 therefore
  gives seed 0 (the integer hash is a bijection, so exactly one such integer exists);
* the finishing step is invertible, so the state after the whole 4-byte blocks can be recovered, the
  remainder mixed in the standard way, and the finishing step applied again with the full length.

All arithmetic is on BIGINT, masked to 32 bits; products are split so that they never overflow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.base import apply_sql, let_sql, nonempty, text_or_empty

# --- fixed values: constants of the published MurmurHash3 x86-32 algorithm -----------------------
BLOCK_C1 = 0xCC9E2D51
BLOCK_C2 = 0x1B873593
BLOCK_ADD = 0xE6546B64
FINISH_M1 = 0x85EBCA6B
FINISH_M2 = 0xC2B2AE35
# ------------------------------------------------------------------------------------------------
SPARK_SEED = 42
MASK = 0xFFFFFFFF


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 32)


def _seed_zero_prefix() -> int:
    """The signed integer that Spark's ``hash`` maps to 0."""
    # the finishing step maps only 0 to 0, so before it: state ^ 4 (the length of an int) must be 0
    state = ((4 - BLOCK_ADD) * _inverse(5)) & MASK
    state = ((state >> 13) | (state << 19)) & MASK
    k = state ^ SPARK_SEED
    k = (k * _inverse(BLOCK_C2)) & MASK
    k = ((k >> 15) | (k << 17)) & MASK
    k = (k * _inverse(BLOCK_C1)) & MASK
    return k - (1 << 32) if k >= 1 << 31 else k


SEED_ZERO = _seed_zero_prefix()


def _mul(v: str, factor: int) -> str:
    """``v * factor`` modulo 2**32 as SQL text."""
    low, high = factor & 0xFFFF, factor >> 16
    return f"(({v} * {low}L + shiftleft(({v} * {high}L) & 65535L, 16)) & {MASK}L)"


def _fold(v: str, *shifts: int) -> str:
    return "(" + " ^ ".join([v, *(f"shiftright({v}, {s})" for s in shifts)]) + ")"


def _chain(value: str, *steps: tuple[str, Callable[[str], str]]) -> str:
    for name, step in steps:
        value = let_sql(value, name, step(name))
    return value


def _finish(h: str) -> str:
    return _chain(h, ("f1", lambda v: _mul(_fold(v, 16), FINISH_M1)), ("f2", lambda v: _mul(_fold(v, 13), FINISH_M2)),
                  ("f3", lambda v: _fold(v, 16)))


def _unfinish(h: str) -> str:
    return _chain(h, ("u1", lambda v: _mul(_fold(v, 16), _inverse(FINISH_M2))),
                  ("u2", lambda v: _mul(_fold(v, 13, 26), _inverse(FINISH_M1))), ("u3", lambda v: _fold(v, 16)))


def _remainder(tail: str) -> str:
    """The 1-3 trailing bytes as a little-endian number, mixed like a block."""
    return _chain(
        f"hex({tail})",
        ("t1", lambda v: f"bigint(conv(concat(substring({v}, 5, 2), substring({v}, 3, 2), substring({v}, 1, 2)), 16, 10))"),
        ("t2", lambda v: _mul(v, BLOCK_C1)),
        ("t3", lambda v: _mul(f"((shiftleft({v}, 15) | shiftright({v}, 17)) & {MASK}L)", BLOCK_C2)))


def murmur3_32(text: Column) -> Column:
    """Unsigned 32-bit hash of the UTF-8 bytes, as BIGINT."""
    size = "octet_length(b)"
    whole = f"({size} - {size} % 4)"
    blocks = f"(bigint(hash({SEED_ZERO}, substring(b, 1, {whole}))) & {MASK}L)"
    mixed = f"({_unfinish(blocks)} ^ {whole} ^ {_remainder(f'substring(b, {whole} + 1, 3)')} ^ {size})"
    return apply_sql(text.cast("binary"), "b", f"if({size} % 4 = 0, {blocks}, {_finish(mixed)})")


def with_murmur3(df: DataFrame, text: Column, name: str) -> DataFrame:
    """The same hash as a chain of projections, for whole tables.

    Every step refers to the aliases of steps before it (lateral column aliases, which the analyzer turns into
    one projection per level), so generated code computes each value once; the single-expression form above is
    interpreted. Put the result behind a generator before filtering on it (as the ingest plan does), or the
    optimizer would copy the steps into the filter.
    """
    steps = {
        "_n": "bigint(octet_length(_b))",
        "_w": "_n - _n % 4",
        "_h": f"bigint(hash({SEED_ZERO}, substring(_b, 1, int(_w)))) & {MASK}L",
        "_u1": _mul(_fold("_h", 16), _inverse(FINISH_M2)),
        "_u2": _mul(_fold("_u1", 13, 26), _inverse(FINISH_M1)),
        "_x": "hex(substring(_b, int(_w) + 1, 3))",
        "_t1": "bigint(conv(concat(substring(_x, 5, 2), substring(_x, 3, 2), substring(_x, 1, 2)), 16, 10))",
        "_t2": _mul("_t1", BLOCK_C1),
        "_t3": _mul(f"((shiftleft(_t2, 15) | shiftright(_t2, 17)) & {MASK}L)", BLOCK_C2),
        "_f1": f"{_fold('_u2', 16)} ^ _w ^ _t3 ^ _n",
        "_f2": _mul(_fold("_f1", 16), FINISH_M1),
        "_f3": _mul(_fold("_f2", 13), FINISH_M2),
        name: f"if(_n % 4 = 0, _h, {_fold('_f3', 16)})",
    }
    out = df.select("*", text.cast("binary").alias("_b"), *[F.expr(step).alias(alias) for alias, step in steps.items()])
    return out.select(*df.columns, name)


def type_subject(template: Column, message: Column) -> Column:
    """The text whose hash is the event type: the template, else the message."""
    return F.coalesce(nonempty(template), text_or_empty(message))


def type_code(subject: Column, code: Column) -> Column:
    """``0x`` and eight hex digits; empty for an empty subject."""
    return F.when(subject == "", F.lit("")).otherwise(F.concat(F.lit("0x"), F.lpad(F.translate(F.hex(code), "ABCDEF", "abcdef"), 8, "0")))


def event_type(template: Column, message: Column) -> Column:
    subject = type_subject(template, message)
    return type_code(subject, murmur3_32(subject))
