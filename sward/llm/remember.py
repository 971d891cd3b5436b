"""What a Python worker remembers between rows, bounded in bytes."""

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa


def give_back():
    """Return what this worker no longer uses to the machine, at the end of a task.

    Workers outlive their tasks, and their allocators keep the most that any task had.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


@contextmanager
def no_collector():
    """Spare code that makes many small objects without cycles the collector's walks over all of them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Recent(dict):
    """Values by text, made when first asked for and kept in two generations.

    When the young generation holds ``limit`` bytes it becomes the old one, so what is asked for often
    is never made anew at once.  Keys of more than ``longest`` characters are not kept at all: in text
    without spaces a single key may be megabytes.  Results do not depend on any of this.
    """

    #: About what a key, a value and their place in a dictionary take beside their contents.
    OVERHEAD = 220

    def __init__(self, make, limit=48 << 20, longest=64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.old, self.size = {}, 0

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value, self.OVERHEAD + (len(value) if isinstance(value, bytes) else 0))
        return value

    def keep(self, key, value, size):
        """Remember a value of about ``size`` bytes, unless its key is too long."""
        if len(key) > self.longest:
            return
        self.size += size + 2 * len(key)
        if self.size > self.limit:
            self.old = self.copy()
            self.clear()
            self.size = 0
        self[key] = value
