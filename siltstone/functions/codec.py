"""Numbers and lists as bytes, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _turned(h: Column, width: int) -> Column:
    """Hex digits of ``width`` bytes with the bytes in reverse order."""
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


def big_endian(n: Column, width: int = 8) -> Column:
    """A number as bytes whose order is the number's."""
    return F.unhex(F.lpad(F.conv(n.cast("string"), 10, 16), 2 * width, "0"))


def from_big_endian(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def little_endian(n: Column, width: int) -> Column:
    return F.unhex(_turned(F.lpad(F.conv(n.cast("string"), 10, 16), 2 * width, "0"), width))


def from_little_endian(b: Column, width: int, what: str = "number") -> Column:
    """The unsigned number in ``width`` bytes; none at all is 0 and any other width an error."""
    wrong = F.raise_error(F.concat(F.lit(f"{what} of "), F.octet_length(b).cast("string"), F.lit(f" bytes, not {width}"))).cast("decimal(20,0)")
    number = F.conv(_turned(F.hex(b), width), 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(b) == 0, F.lit(0).cast("decimal(20,0)")).when(F.octet_length(b) != width, wrong).otherwise(number)


def list_payload(elements: Column, with_expiry: bool = False) -> Column:
    """array<struct<v:binary,exp:long>> as bytes: a count, then of each element its expiry (0: none), if kept, its length and itself."""
    one = lambda e: F.concat(*([F.hex(little_endian(F.coalesce(e["exp"], F.lit(0)), 4))] if with_expiry else []), F.hex(little_endian(F.octet_length(e["v"]), 4)), F.hex(e["v"]))
    return F.unhex(F.concat(F.hex(little_endian(F.size(elements), 4)), F.array_join(F.transform(elements, one), "")))


def list_elements(payload: Column, with_expiry: bool = False) -> Column:
    """The elements of such bytes, as array<struct<v:binary,exp:long>>; a payload that ends early or late is an error."""
    head = 8 if with_expiry else 4
    number = lambda at: from_little_endian(F.substring(payload, at, F.lit(4)), 4, "list payload").cast("int")
    element = "struct<v:binary,exp:bigint>"
    start = F.struct(F.lit(5).alias("at"), F.array().cast(f"array<{element}>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        size = number(at + head - 4)
        exp = F.nullif(number(at).cast("bigint"), F.lit(0).cast("bigint")) if with_expiry else F.lit(None).cast("bigint")
        one = F.struct(F.substring(payload, at + head, size).alias("v"), exp.alias("exp"))
        return F.struct((at + head + size).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    count = number(F.lit(1))
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(steps, start, step)
    bad = F.raise_error(F.lit("a list payload ends in the wrong place")).cast(f"array<{element}>")
    return F.when(F.octet_length(payload) == 0, F.array().cast(f"array<{element}>")).when(done["at"] != F.octet_length(payload) + 1, bad).otherwise(done["out"])
