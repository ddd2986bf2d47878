"""Keys of keyed row stores: packed slab keys, keys with SQL null in the place of a sentinel, and capacity rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldspar.functions.bits import BitField

_SLOT, _SLAB = BitField(0, 32), BitField(32, 31)


def slab_key(slab: Column, slot: Column) -> Column:
    """slab in the high 32 bits (under 2^31), slot in the low ones."""
    return F.shiftleft(slab.cast("long"), 32).bitwiseOR(slot.cast("long"))


def slab_of(key: Column | str) -> Column:
    return F.shiftrightunsigned(F.col(key) if isinstance(key, str) else key, 32)


def slot_of(key: Column | str) -> Column:
    return _SLOT.get(key)


def from_index(index: Column, bits: int = 32) -> Column:
    """The key of an index; its largest value stands for no key and becomes null."""
    low = BitField(0, min(bits, 63)).get(index)
    return F.when(low != F.lit((1 << min(bits, 63)) - 1).cast("long"), low)


def is_none(key: Column) -> Column:
    return key.isNull()


def is_some(key: Column) -> Column:
    return key.isNotNull()


def rounded_capacity(capacity: int) -> int:
    """Ring buffers, channels and boxed stores round up to a power of two; none has capacity zero."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    return 1 << (capacity - 1).bit_length()


#: Fixed value: the bytes of a slab unless said otherwise.
SLAB_BYTES = 256 * 1024


def slab_sizing(capacity: int, slot_bytes: int, slab_bytes: int = SLAB_BYTES) -> tuple[int, int]:
    """Slots in a slab and the number of slabs that hold capacity slots of slot_bytes each."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    slot_bytes = max(1, slot_bytes)
    if slot_bytes > slab_bytes:
        raise ValueError(f"a slot of {slot_bytes} bytes does not fit a slab of {slab_bytes}")
    slots = slab_bytes // slot_bytes
    return slots, -(-capacity // slots)
