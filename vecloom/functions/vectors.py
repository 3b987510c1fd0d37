"""Column functions on ARRAY vectors. All are built-in expressions that run inside whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element types whose distances are whole numbers.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def kind_of(*columns: tuple[DataFrame, str]) -> str:
    """bigint if the elements of all these (df, array column) are whole numbers, else double: the type of their distances."""
    return "bigint" if all(df.schema[c].dataType.elementType.simpleString() in WHOLE for df, c in columns) else "double"


def quantize(v: Column, scale: float = 127.0) -> Column:
    """Each element times scale, truncated toward zero, as INT."""
    return F.transform(v, lambda x: (x.cast("double") * F.lit(scale)).cast("int"))


def clamp_int8(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.least(x, F.lit(127)), F.lit(-128)))


def wrap_int8(v: Column) -> Column:
    """Compatibility: eight-bit two's complement, as a device that stores residuals in one byte would have them."""
    return F.transform(v, lambda x: F.pmod(x + F.lit(128), F.lit(256)) - F.lit(128))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def l2(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Squared Euclidean distance as `kind`: bigint for whole numbers, double for floats (see kind_of)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast(kind) - y.cast(kind)) * (x.cast(kind) - y.cast(kind))), F.lit(0).cast(kind), lambda s, x: s + x)


def dot(a: Column, b: Column, kind: str = "bigint") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), F.lit(0).cast(kind), lambda s, x: s + x)


def subvector(v: Column, m: Column | int, dsub: int) -> Column:
    return F.slice(v, (m if isinstance(m, Column) else F.lit(m)) * dsub + 1, F.lit(dsub))


def code_address(code: Column, ksub: int) -> Column:
    """Codes as places in a flat table: code of sub-quantiser m plus m * ksub."""
    return F.transform(code, lambda c, m: c + m * F.lit(ksub))


def adc(lut: Column, code: Column, m: int, ksub: int, clip: int | None = None) -> Column:
    """Sum of the table's entries (bigint or double) at the codes, unrolled, so that it compiles into plain array reads.

    clip: compatibility with tables of whole numbers whose entries wrap at so many bits.
    """
    entry = (lambda x: x.bitwiseAND(F.lit((1 << clip) - 1))) if clip else (lambda x: x)
    return reduce(lambda a, b: a + b, (entry(F.get(lut, F.get(code, F.lit(i)) + F.lit(i * ksub))) for i in range(m)))


def pack_item(m: Column, k: Column) -> Column:
    """(sub-quantiser, code) in one number, the code in the low eight bits."""
    return F.shiftleft(m, 8).bitwiseOR(k)


def unpack_item(item: Column) -> tuple[Column, Column]:
    return F.shiftright(item, 8), item.bitwiseAND(F.lit(255))
