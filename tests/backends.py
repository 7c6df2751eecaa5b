"""Backends of vectors for tests."""

import numpy as np


def hashed_vectors(dims: int):
    """A backend for tests: numbers from -1 to 1 that depend on the text alone (FNV-1a, then xorshift)."""

    def backend(texts: list[str]) -> list:
        seeds = []
        for text in texts:
            seed = 0xCBF29CE484222325
            for byte in text.encode():
                seed = (seed ^ byte) * 0x100000001B3 % (1 << 64)
            seeds.append(seed or 1)
        state, out = np.array(seeds, np.uint64), np.empty((len(texts), dims), np.float32)
        for i in range(dims):
            for shift, left in ((13, True), (7, False), (17, True)):
                state = state ^ (state << np.uint64(shift) if left else state >> np.uint64(shift))
            out[:, i] = (state / 2.0**64 * 2 - 1).astype(np.float32)
        return list(out)

    return backend
