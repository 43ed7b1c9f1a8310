"""Numbers as digit strings for sequence models, and affine scalers.

Column functions for the general case, and the settings of the textual form.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SerializerSettings:
    # fixed values: the textual form of the format
    base: int = 10
    prec: int = 3
    signed: bool = True
    fixed_length: bool = False
    max_val: float = 1e7
    time_sep: str = " ,"
    bit_sep: str = " "
    plus_sign: str = ""
    minus_sign: str = " -"
    half_bin_correction: bool = True
    decimal_point: str = ""
    missing_str: str = " Nan"

    def __post_init__(self) -> None:
        if self.decimal_point and not self.prec:
            raise ValueError("a decimal point needs a precision")

    @classmethod
    def of(cls, values: dict) -> SerializerSettings:
        return cls(**values)

    def as_dict(self) -> dict:
        return asdict(self)


def places(s: SerializerSettings) -> int:
    """Digits before the point that max_val takes."""
    n = 0
    while s.base**n < s.max_val:
        n += 1
    return n


def number_to_digits(x: Column, s: SerializerSettings) -> tuple[Column, Column]:
    """(sign, digits array) of the number cut to ``prec`` places after the point; a missing one has zeros.

    A millionth of the last place is added before the cut, so that 3.4 at three places gives
    3 4 0 0 although the nearest double lies below it. A number beyond ``max_val``, or one
    whose digits do not fit, fails the query, and so does a negative one where there is no sign.
    """
    n = places(s) + s.prec
    known = F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(x)
    scaled = F.floor(F.abs(known) * float(s.base**s.prec) + 1e-6)
    beyond = (F.abs(known) > s.max_val) | (F.abs(known) * float(s.base**s.prec) + 1e-6 >= float(s.base**n))
    total = F.when(beyond, _failed("beyond max_val: ", x)).otherwise(scaled.cast("bigint"))
    if not s.signed:
        total = F.when(known < 0, _failed("negative without a sign: ", x)).otherwise(total)
    digits = F.array(*[F.floor(total / F.lit(s.base ** (n - 1 - k))).cast("bigint") % s.base for k in range(n)])
    return F.when(x < 0, -1).otherwise(1), F.transform(digits, lambda d: d.cast("int"))


def _failed(why: str, x: Column) -> Column:
    return F.raise_error(F.concat(F.lit(why), x.cast("string"))).cast("bigint")


def digits_to_number(sign: Column, digits: Column, s: SerializerSettings) -> Column:
    whole = F.aggregate(digits, F.lit(0.0), lambda a, d: a * s.base + d)
    half = 0.5 if s.half_bin_correction else 0.0
    return sign * (whole + half) / float(s.base**s.prec)


def serialize_number(x: Column, s: SerializerSettings) -> Column:
    """One number with its sign, digits and time separator."""
    sign, digits = number_to_digits(x, s)
    lead = places(s)
    whole = F.concat_ws("", F.slice(digits, 1, lead).cast("array<string>"))
    after = F.concat_ws("", F.slice(digits, lead + 1, s.prec).cast("array<string>")) if s.prec else F.lit("")
    every = F.concat(whole, after)
    short = every if s.fixed_length else F.regexp_replace(every, "^0+(?=.)", "")
    if s.decimal_point:
        shortened = whole if s.fixed_length else F.regexp_replace(whole, "^0+", "")
        spaced = F.concat(_separated(shortened, s), F.lit(s.decimal_point), _separated(after, s))
    else:
        spaced = _separated(short, s)
    mark = F.when(sign < 0, s.minus_sign).otherwise(s.plus_sign) if s.signed else F.lit("")
    body = F.concat(mark, F.lit(s.bit_sep), spaced)
    return F.concat(F.when(F.isnan(x) | x.isNull(), F.lit(s.missing_str)).otherwise(body), F.lit(s.time_sep))


def _separated(digits: Column, s: SerializerSettings) -> Column:
    return F.regexp_replace(digits, "(?<=.)(?=.)", s.bit_sep) if s.bit_sep else digits


def serialize_array(values: Column, s: SerializerSettings) -> Column:
    return F.concat_ws("", F.transform(values, lambda x: serialize_number(x, s)))


def deserialize_array(text: Column, s: SerializerSettings, ignore_last: bool = False, steps: int | None = None) -> Column:
    """Numbers of a serialized array; what can't be read becomes null, empty pieces are left out.

    ``ignore_last`` leaves out the last number, which may be cut short; ``steps`` reads so many at most.
    """
    pieces = F.filter(F.split(text, _literal(s.time_sep)), lambda p: F.length(F.trim(p)) > 0)
    if ignore_last:
        pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    if steps is not None:
        pieces = F.slice(pieces, 1, steps)

    def read(piece: Column) -> Column:
        bare = F.regexp_replace(piece, _literal(s.bit_sep), "") if s.bit_sep else piece
        if s.decimal_point:
            bare = F.regexp_replace(bare, _literal(s.decimal_point), "")
        minus = F.contains(bare, F.lit(s.minus_sign.strip())) if s.signed else F.lit(False)
        number = F.regexp_replace(F.regexp_replace(bare, _literal(s.minus_sign.strip() or "-"), ""), r"\s", "").try_cast("double")
        half = 0.5 if s.half_bin_correction else 0.0
        value = (number + half) / float(s.base**s.prec)
        return F.when(minus, -value).otherwise(value)

    return F.transform(pieces, read)


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def handle_prediction(prediction: Column, n: int, strict: bool = False) -> Column:
    """A forecast of exactly n values: cut, or filled with its last value (null if strict or empty)."""
    size = F.size(prediction)
    filled = F.slice(F.concat(prediction, F.array_repeat(F.element_at(prediction, -1), n)), 1, n)
    short = F.lit(None).cast("array<double>") if strict else F.when(size > 0, filled)
    return F.when(size >= n, F.slice(prediction, 1, n)).otherwise(short)


def scale(x: Column, shift: Column, q: Column) -> Column:
    return (x - shift) / q


def unscale(x: Column, shift: Column, q: Column) -> Column:
    return x * q + shift
