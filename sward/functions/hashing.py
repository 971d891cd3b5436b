"""Seeded orders that depend on the row key only, never on partitioning."""

from pyspark.sql import functions as F


def order_key(seed, *keys):
    """Hex digest that orders rows pseudo-randomly; equal for equal seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed, *keys):
    """Number in [0, 1) from the first 13 hex digits of the digest (52 bits)."""
    digits = F.conv(F.left(order_key(seed, *keys), F.lit(13)), 16, 10)
    return digits.cast("double") / float(16**13)


def normal(seed, *keys):
    """Standard normal number by the Box-Muller transform of two uniforms."""
    u = uniform(f"{seed}.a", *keys)
    v = uniform(f"{seed}.b", *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.pi() * v)
