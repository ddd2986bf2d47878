"""Packed integers as Column expressions: bit fields, flags, integer enums, layouts and tagged unions.

Layouts are checked when they are made, before any DataFrame exists. Packed words are BIGINT bit patterns; words of 128
bits are two of them, high and low. Shifts to the right are unsigned. Errors come as a status text beside the value, or
stop the job in strict mode.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width and signedness of the integer types that a word or a field can have.
TYPES = {f"{s}{n}": (n, s == "i") for s in "ui" for n in (8, 16, 32, 64, 128)} | {"bool": (1, False)}


def signed(x: int) -> int:
    """The BIGINT with the bit pattern of the 64-bit number x."""
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def _lit(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _right(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n) if n else c


def _left(c: Column, n: int) -> Column:
    return F.shiftleft(c, n) if n else c


def overflow_text(value: Column, most: int) -> Column:
    return F.concat(F.lit("value "), value.cast("string"), F.lit(f" exceeds max {most}"))


@dataclass(frozen=True)
class BitField:
    """Bits [start, start + length) of a word of ``bits`` bits."""

    start: int
    length: int
    bits: int = 64

    def __post_init__(self):
        if self.length <= 0:
            raise ValueError("a field needs a length of one bit at least")
        if self.start < 0 or self.start + self.length > self.bits:
            raise ValueError(f"a field of {self.length} bits at {self.start} exceeds {self.bits} bits")

    @property
    def max_value(self) -> int:
        return (1 << self.length) - 1

    @property
    def mask(self) -> int:
        return self.max_value << self.start

    def get(self, word: Column | str) -> Column:
        return _right(_long(word), self.start).bitwiseAND(_lit(self.max_value))

    def clear(self, word: Column | str) -> Column:
        return _long(word).bitwiseAND(_lit(~self.mask))

    def set_unchecked(self, word: Column | str, value: Column) -> Column:
        """Too large a value leaks into the bits above."""
        return self.clear(word).bitwiseOR(_left(_long(value), self.start))

    def fits(self, value: Column) -> Column:
        value = _long(value)
        if self.length >= 64:
            return F.lit(True)
        # a negative number is the pattern of one beyond 63 bits
        return value >= 0 if self.length == 63 else (value >= 0) & (value <= _lit(self.max_value))

    def set(self, word: Column | str, value: Column) -> Column:
        """Stops the job on overflow."""
        return F.when(self.fits(value), self.set_unchecked(word, value)).otherwise(F.raise_error(overflow_text(value, self.max_value)).cast("long"))

    def try_set(self, word: Column | str, value: Column) -> Column:
        """Struct of value (null on overflow) and status (null if set)."""
        fits = self.fits(value)
        return F.struct(F.when(fits, self.set_unchecked(word, value)).alias("value"), F.when(~fits, overflow_text(value, self.max_value)).alias("status"))


@dataclass(frozen=True)
class Flag:
    """One bit of a word."""

    bit: int
    bits: int = 64

    def __post_init__(self):
        if not 0 <= self.bit < self.bits:
            raise ValueError(f"bit {self.bit} is not in a word of {self.bits} bits")

    @property
    def mask(self) -> int:
        return 1 << self.bit

    def is_set(self, word: Column | str) -> Column:
        return _long(word).bitwiseAND(_lit(self.mask)) != 0

    def set(self, word: Column | str) -> Column:
        return _long(word).bitwiseOR(_lit(self.mask))

    def clear(self, word: Column | str) -> Column:
        return _long(word).bitwiseAND(_lit(~self.mask))

    def toggle(self, word: Column | str) -> Column:
        return _long(word).bitwiseXOR(_lit(self.mask))

    def set_to(self, word: Column | str, on: Column) -> Column:
        return F.when(on, self.set(word)).otherwise(self.clear(word))


@dataclass(frozen=True)
class IntEnum:
    """Names with integer codes, in any order and with gaps."""

    codes: Mapping[str, int]

    def __post_init__(self):
        if not self.codes:
            raise ValueError("an enum needs a name")
        if len(set(self.codes.values())) < len(self.codes):
            raise ValueError("two names have the same code")

    def encode(self, name: Column) -> Column:
        """Code of a name; null for a name that the enum lacks."""
        out = F.lit(None).cast("long")
        for k, code in self.codes.items():
            out = F.when(name == k, _lit(code)).otherwise(out)
        return out

    def decode(self, code: Column) -> Column:
        """Name of a code; null for a code that the enum lacks."""
        out = F.lit(None).cast("string")
        for k, n in self.codes.items():
            out = F.when(code == n, k).otherwise(out)
        return out


@dataclass(frozen=True)
class Member:
    """A named field or flag of a layout."""

    name: str
    type: str
    start: int
    length: int = 1
    enum: IntEnum | None = None

    @property
    def width(self) -> int:
        return TYPES[self.type][0]

    @property
    def signed(self) -> bool:
        return TYPES[self.type][1]

    @property
    def flag(self) -> bool:
        return self.type == "bool"


def flag(name: str, bit: int) -> Member:
    return Member(name, "bool", bit)


def _checked(repr_: str, members: Sequence[Member], taken: Sequence[tuple[str, int, int]] = ()) -> None:
    if repr_ not in TYPES or repr_ == "bool":
        raise ValueError(f"no integer type: {repr_}")
    bits, is_signed = TYPES[repr_]
    used = list(taken)
    for m in members:
        if m.type not in TYPES:
            raise ValueError(f"field '{m.name}': no integer type: {m.type}")
        if m.length <= 0:
            raise ValueError(f"field '{m.name}': length must be at least one bit")
        if m.start < 0 or m.start + m.length > bits:
            raise ValueError(f"field '{m.name}': exceeds {bits} bits")
        if not m.flag and m.length > m.width:
            raise ValueError(f"field '{m.name}': {m.length} bits do not fit {m.type}")
        if is_signed and m.length >= bits - 1:
            raise ValueError(f"field '{m.name}': so wide a field would lose bits of a signed word")
        for name, start, length in used:
            if name == m.name:
                raise ValueError(f"field '{m.name}' occurs twice")
            if m.start < start + length and start < m.start + m.length:
                raise ValueError(f"field '{m.name}' overlaps '{name}'")
        used.append((m.name, m.start, m.length))


class _Word:
    """Access to a word's bits; a word of over 64 bits is a pair of columns (high, low)."""

    def __init__(self, bits: int):
        self.wide = bits > 64

    def get(self, word, start: int, length: int) -> Column:
        most = (1 << length) - 1
        if not self.wide:
            return _right(_long(word), start).bitwiseAND(_lit(most))
        if length > 64:
            raise ValueError("a field of over 64 bits is read as a pair, by get_pair")
        high, low = map(_long, word)
        if start >= 64:
            return _right(high, start - 64).bitwiseAND(_lit(most))
        out = _right(low, start)
        if start + length > 64:
            out = out.bitwiseOR(_left(high, 64 - start))
        return out.bitwiseAND(_lit(most))

    def placed(self, value: Column, start: int, length: int) -> tuple[Column | None, Column | None]:
        """The value's bits moved to their place, as (high, low) parts."""
        value = _long(value).bitwiseAND(_lit((1 << length) - 1))
        if start >= 64:
            return _left(value, start - 64), None
        return (_right(value, 64 - start) if start + length > 64 else None), _left(value, start)


@dataclass(frozen=True)
class Layout:
    """A packed word: members in declaration order."""

    repr: str
    members: tuple[Member, ...]
    fixed: tuple[tuple[int, int, int], ...] = field(default=())  # start, length and value of bits that always are the same

    def __post_init__(self):
        _checked(self.repr, self.members, [(f"<fixed {k}>", a, n) for k, (a, n, _) in enumerate(self.fixed)])

    @property
    def bits(self) -> int:
        return TYPES[self.repr][0]

    @property
    def wide(self) -> bool:
        return self.bits > 64

    def member(self, name: str) -> Member:
        for m in self.members:
            if m.name == name:
                return m
        raise ValueError(f"no field '{name}'")

    # -- reading

    def raw(self, word, name: str) -> Column:
        """The field's bits as an unsigned number."""
        m = self.member(name)
        return _Word(self.bits).get(word, m.start, m.length)

    def get(self, word, name: str) -> Column:
        """Field value: a boolean for flags, a name (null if unknown) for enums, else a number; only a field as wide as its signed type is negative."""
        m, raw = self.member(name), self.raw(word, name)
        if m.flag:
            return raw != 0
        if m.signed and m.length == m.width < 64:
            raw = raw.bitwiseXOR(_lit(1 << (m.length - 1))) - F.lit(1 << (m.length - 1)).cast("long")
        return m.enum.decode(raw) if m.enum else raw

    def unpack(self, word) -> Column:
        """Struct of all fields."""
        return F.struct(*[self.get(word, m.name).alias(m.name) for m in self.members]) if self.members else F.struct(F.lit(True).alias("empty"))

    def status(self, word) -> Column:
        """Text of the first enum field with an unknown code, which shows the whole word; null if there is none."""
        out, shown = F.lit(None).cast("string"), self._shown(word)
        for m in reversed([m for m in self.members if m.enum]):
            out = F.when(self.get(word, m.name).isNull(), F.concat(F.lit(f"field '{m.name}': unknown discriminant "), shown)).otherwise(out)
        return out

    def _shown(self, word) -> Column:
        if self.wide:
            return F.concat_ws(":", *[_long(x).cast("string") for x in word])
        return F.format_string("%d", _long(word)) if TYPES[self.repr][1] or self.bits < 64 else unsigned(word).cast("string")

    def equals(self, word: Column | str, name: str, value: int) -> Column:
        """Predicate that a field has a value; on the topmost field of a non-negative word it is a range, which reaches the scan."""
        m = self.member(name)
        if not self.wide and m.start + m.length == 63:
            return _long(word).between(_lit(value << m.start), _lit(((value + 1) << m.start) - 1))
        return self.raw(word, name) == _lit(value)

    # -- writing

    def problem(self, values: Mapping[str, Column]) -> Column:
        """Text of the first field, in declaration order, whose value does not fit; null if all fit."""
        out = F.lit(None).cast("string")
        for m in reversed(self.members):
            if m.name not in values or m.flag:
                continue
            if m.enum:
                known = m.enum.encode(values[m.name])
                bad = (values[m.name].isNotNull() & known.isNull()) | F.coalesce(known > _lit((1 << min(m.length, 62)) - 1), F.lit(False))
                text = F.concat(F.lit(f"field '{m.name}': value "), F.coalesce(known.cast("string"), values[m.name]), F.lit(f" exceeds max {(1 << m.length) - 1}"))
            elif m.length >= 64:
                continue
            else:
                v, most = _long(values[m.name]), (1 << m.length) - 1
                least = _lit(-(1 << (m.length - 1)))
                bad = (v < least) | (v > _lit((1 << (m.length - 1)) - 1)) if m.signed else (v < 0) | (v > _lit(most))
                text = F.concat(F.lit(f"field '{m.name}': "), overflow_text(v, most))
            out = F.when(F.coalesce(bad, F.lit(False)), text).otherwise(out)
        return out

    def _word(self, values: Mapping[str, Column]) -> list[Column]:
        if unknown := set(values) - {m.name for m in self.members}:
            raise ValueError(f"no field {sorted(unknown)}")
        high, low = _lit(sum((v << a) >> 64 for a, _, v in self.fixed)), _lit(sum(v << a for a, _, v in self.fixed))
        for m in self.members:
            if m.name not in values:
                continue
            value = values[m.name]
            value = value.cast("boolean").cast("long") if m.flag else m.enum.encode(value) if m.enum else value
            up, down = _Word(self.bits).placed(F.coalesce(_long(value), F.lit(0).cast("long")), m.start, m.length)
            high, low = (high if up is None else high.bitwiseOR(up)), (low if down is None else low.bitwiseOR(down))
        return [high, low] if self.wide else [low]

    def pack(self, strict: bool = False, **values: Column) -> Column:
        """The word (a struct of high and low if wide) from field values, names for enums; fields not given or null are zero.

        Without strict: struct of value (null if a field does not fit) and status (null if all fit).
        """
        parts = self._word(values)
        word = F.struct(parts[0].alias("high"), parts[1].alias("low")) if self.wide else parts[0]
        problem = self.problem(values)
        if strict:
            return F.when(problem.isNull(), word).otherwise(F.raise_error(problem).cast("struct<high:bigint,low:bigint>" if self.wide else "long"))
        return F.struct(F.when(problem.isNull(), word).alias("value"), problem.alias("status"))


def unsigned(word: Column | str) -> Column:
    """The 64-bit pattern as a number from 0 to 2^64 - 1, for ordering and printing."""
    d = _long(word).cast("decimal(20,0)")
    return F.when(_long(word) >= 0, d).otherwise(d + F.lit(str(2**64)).cast("decimal(20,0)"))


@dataclass(frozen=True)
class TaggedLayout:
    """A packed word whose discriminant bits choose one of several layouts."""

    repr: str
    start: int
    length: int
    variants: Mapping[str, tuple[int, tuple[Member, ...]]]

    def __post_init__(self):
        _checked(self.repr, (), ())
        BitField(self.start, self.length, TYPES[self.repr][0])
        codes = [code for code, _ in self.variants.values()]
        if len(set(codes)) < len(codes):
            raise ValueError("two variants have the same discriminant")
        for name, (code, members) in self.variants.items():
            if not 0 <= code < 1 << self.length:
                raise ValueError(f"variant '{name}': discriminant {code} does not fit {self.length} bits")
            _checked(self.repr, members, [("discriminant", self.start, self.length)])

    def layout(self, name: str) -> Layout:
        code, members = self.variants[name]
        return Layout(self.repr, tuple(members), ((self.start, self.length, code),))

    def discriminant(self, word) -> Column:
        return _Word(TYPES[self.repr][0]).get(word, self.start, self.length)

    def kind(self, word) -> Column:
        """Name of the variant; null if the discriminant is unknown."""
        return IntEnum({k: code for k, (code, _) in self.variants.items()}).decode(self.discriminant(word))

    def kind_status(self, word) -> Column:
        shown = Layout(self.repr, ())._shown(word)
        return F.when(self.kind(word).isNull(), F.concat(F.lit("field '__discriminant': unknown discriminant "), shown))

    def is_variant(self, word, name: str) -> Column:
        """Judges the discriminant only."""
        return self.discriminant(word) == _lit(self.variants[name][0])

    def as_variant(self, word, name: str) -> Column:
        """Struct of value (the variant's fields, or null) and status (null if the word is that variant with known enum codes)."""
        layout, is_it = self.layout(name), self.is_variant(word, name)
        inner = layout.status(word)
        wrong = F.concat(F.lit("field '__discriminant': unknown discriminant "), layout._shown(word))
        return F.struct(F.when(is_it & inner.isNull(), layout.unpack(word)).alias("value"), F.when(~is_it, wrong).otherwise(inner).alias("status"))

    def pack(self, variant: str, strict: bool = False, **values: Column) -> Column:
        return self.layout(variant).pack(strict, **values)


def snake_case(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()
