"""Golden vectors and rejections of packed words."""

import random

import pytest
from pyspark.sql import functions as F

from foldspar.functions import keys
from foldspar.functions.bits import BitField, Flag, IntEnum, Layout, Member, TaggedLayout, flag, signed, snake_case, unsigned


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(x):
    return F.lit(signed(x)).cast("long")


BASIC = Layout("u64", (Member("a", "u8", 0, 8), Member("b", "u16", 8, 16), Member("c", "u32", 24, 32)))
SNOW = Layout("u64", (Member("sequence", "u16", 0, 12), Member("worker", "u16", 12, 10), Member("timestamp", "u64", 22, 42)))
SPARSE = IntEnum({"A": 0, "B": 2, "C": 5})
BASIC_ENUM = TaggedLayout("u64", 0, 4, {"Empty": (0, ()), "WithU8": (1, (Member("value", "u8", 4, 8),)), "WithU16": (2, (Member("value", "u16", 4, 16),))})


def test_pack_basic(spark):
    assert one(spark, BASIC.pack(strict=True, a=lit(1), b=lit(2), c=lit(3))) == (50332161,)
    assert one(spark, BASIC.pack(strict=True, b=lit(2))) == (512,)  # not given: zero
    assert one(spark, BASIC.unpack(lit(50332161))["b"], BASIC.get(lit(50332161), "c")) == (2, 3)


def test_snowflake_uses_every_bit(spark):
    word = SNOW.pack(strict=True, sequence=lit(4095), worker=lit(1023), timestamp=lit(2**42 - 1))
    assert one(spark, word, SNOW.get(word, "timestamp"), unsigned(word)) == (-1, 2**42 - 1, 2**64 - 1)


@pytest.mark.parametrize(("name", "value", "most"), [("sequence", 4096, 4095), ("worker", 1024, 1023)])
def test_overflow_names_the_field(spark, name, value, most):
    got = one(spark, SNOW.pack(**{name: lit(value)}))[0]
    assert (got.value, got.status) == (None, f"field '{name}': value {value} exceeds max {most}")
    with pytest.raises(Exception, match="exceeds max"):
        one(spark, SNOW.pack(strict=True, **{name: lit(value)}))


def test_unknown_enum_code_shows_the_word(spark):
    layout = Layout("u64", (Member("sparse", "u8", 0, 4, SPARSE), Member("value", "u8", 4, 8)))
    assert one(spark, layout.get(lit(673), "sparse"), layout.status(lit(673)), layout.status(lit(674))) == (None, "field 'sparse': unknown discriminant 673", None)
    got = one(spark, layout.pack(sparse=F.lit("D")))[0]
    assert got.value is None and "sparse" in got.status


def test_tagged(spark):
    assert one(spark, BASIC_ENUM.pack("WithU8", strict=True, value=lit(42)), BASIC_ENUM.kind(lit(673))) == (673, "WithU8")
    assert one(spark, BASIC_ENUM.kind(lit(15)), *[BASIC_ENUM.is_variant(lit(15), v) for v in BASIC_ENUM.variants]) == (None, False, False, False)
    assert one(spark, BASIC_ENUM.kind_status(lit(15))) == ("field '__discriminant': unknown discriminant 15",)
    foo = TaggedLayout("u64", 0, 4, {"Foo": (0, (Member("value", "u8", 4, 4, SPARSE),))})
    is_it, got = one(spark, foo.is_variant(lit(48), "Foo"), foo.as_variant(lit(48), "Foo"))
    assert is_it and got.value is None and got.status == "field 'value': unknown discriminant 48"
    assert one(spark, BASIC_ENUM.as_variant(lit(673), "WithU8")["value"]["value"]) == (42,)


def test_field_set(spark):
    f, g = BitField(0, 8), BitField(0, 4)
    assert one(spark, f.try_set(lit(0), lit(256))["status"], g.try_set(lit(0), lit(1000))["status"]) == ("value 256 exceeds max 255", "value 1000 exceeds max 15")
    assert one(spark, f.set_unchecked(lit(0), lit(511)), f.set(lit(4096), lit(255)), f.clear(lit(4351))) == (511, 4351, 4096)


def test_flags(spark):
    top = Flag(63)
    assert one(spark, top.set(lit(0)), top.is_set(top.set(lit(0))), top.toggle(top.toggle(lit(5))), top.clear(top.set(lit(1))), top.set_to(lit(0), F.lit(False))) == (-(2**63), True, 5, 1, 0)


def test_signed_fields(spark):
    layout = Layout("u32", (Member("byte", "i8", 0, 8), Member("short", "i16", 8, 16), Member("nibble", "i8", 24, 4)))
    word = layout.pack(strict=True, byte=lit(-1), short=lit(-1), nibble=lit(-1))
    assert one(spark, layout.get(word, "byte"), layout.get(word, "short"), layout.get(word, "nibble")) == (-1, -1, 15)
    assert one(spark, layout.pack(nibble=lit(8))["status"]) == ("field 'nibble': value 8 exceeds max 15",)


def test_wide_words_round_trip(spark):
    layout = Layout("u128", (Member("low", "u64", 0, 60), Member("across", "u32", 60, 19), Member("high", "u32", 79, 32), flag("top", 127)))
    rng = random.Random(1)
    for _ in range(5):
        v = {"low": rng.getrandbits(60), "across": rng.getrandbits(19), "high": rng.getrandbits(32)}
        word = layout.pack(strict=True, top=F.lit(True), **{k: lit(x) for k, x in v.items()})
        pair = (word["high"], word["low"])
        assert one(spark, *[layout.get(pair, k) for k in v], layout.get(pair, "top")) == (*v.values(), True)


def test_top_field_filter_reaches_the_scan(spark, tmp_path):
    layout = Layout("u64", (Member("rest", "u64", 0, 55), Member("top", "u8", 55, 8)))
    spark.range(1000).select(layout.pack(strict=True, rest=F.col("id"), top=F.col("id") % 7).alias("w")).write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w")).where(layout.equals("w", "top", 3))
    assert "GreaterThanOrEqual(w" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == len([i for i in range(1000) if i % 7 == 3])


@pytest.mark.parametrize(
    "make",
    [
        lambda: BitField(0, 0), lambda: BitField(60, 8), lambda: Flag(64), lambda: IntEnum({"a": 1, "b": 1}),
        lambda: Layout("u8", (Member("a", "u8", 4, 8),)), lambda: Layout("u64", (Member("a", "u8", 0, 8), Member("b", "u8", 7, 8))),
        lambda: Layout("u64", (Member("a", "u8", 0, 0),)), lambda: Layout("i64", (Member("a", "u64", 0, 63),)), lambda: Layout("u7", ()),
        lambda: Layout("u64", (Member("a", "u8", 0, 4), Member("a", "u8", 8, 4))), lambda: Layout("u64", (Member("a", "u8", 0, 9),)),
        lambda: TaggedLayout("u64", 0, 2, {"A": (4, ())}), lambda: TaggedLayout("u64", 0, 2, {"A": (1, ()), "B": (1, ())}),
        lambda: TaggedLayout("u64", 0, 4, {"A": (1, (Member("x", "u8", 3, 4),))}), lambda: BASIC.pack(d=F.lit(1)),
    ],
)
def test_bad_layouts_are_rejected(spark, make):
    with pytest.raises(ValueError):
        make()


def test_keys(spark):
    k = keys.slab_key(lit(3), lit(2**32 - 1))
    assert one(spark, keys.slab_of(k), keys.slot_of(k), keys.from_index(lit(2**32 - 1)), keys.from_index(lit(2**32 + 7))) == (3, 2**32 - 1, None, 7)
    assert [keys.rounded_capacity(n) for n in (1, 4, 100, 1000)] == [1, 4, 128, 1024]
    assert one(spark, keys.is_none(F.lit(None)), keys.is_some(lit(1))) == (True, True)
    with pytest.raises(ValueError):
        keys.rounded_capacity(0)


def test_snake_case():
    assert [snake_case(x) for x in ("WithU8", "Market", "FlagsOnly")] == ["with_u8", "market", "flags_only"]


def test_fields_of_63_bits_are_checked(spark):
    field, layout = BitField(0, 63), Layout("u64", (Member("a", "u64", 0, 63), flag("top", 63)))
    big = 2**63 - 1
    assert one(spark, field.try_set(lit(0), lit(-1)), field.try_set(lit(-(2**63)), lit(big)), layout.pack(a=lit(-1)), layout.pack(a=lit(big), top=lit(True))) == (
        (None, f"value -1 exceeds max {big}"), (-1, None), (None, f"field 'a': value -1 exceeds max {big}"), (-1, None),
    )
    assert one(spark, BitField(0, 64).try_set(lit(0), lit(-1))) == ((-1, None),)
