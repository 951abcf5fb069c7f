"""Edit distances of long texts, exact: few edits by their paths, many by bits."""

from __future__ import annotations

from collections.abc import Sequence

#: Symbols of one side that are held against the other at once: masks of a block of distinct ones take 16 MB.
BLOCK = 16_384


def _alike(a: Sequence, i: int, b: Sequence, j: int) -> int:
    """How many symbols from a[i] and b[j] on are the same."""
    n, k, step = min(len(a) - i, len(b) - j), 0, 16
    if n <= 0 or a[i] != b[j]:
        return 0
    while k < n:
        step = min(step, n - k)
        if a[i + k : i + k + step] != b[j + k : j + k + step]:
            break
        k, step = k + step, 2 * step
    if k == n:
        return n
    high = k + step  # a[k:high] differs somewhere
    while high - k > 1:
        mid = (k + high) // 2
        if a[i + k : i + mid] == b[j + k : j + mid]:
            k = mid
        else:
            high = mid
    return k


def _few(a: Sequence, b: Sequence, most: int) -> int | None:
    """Edits between a and b where they are `most` at the most: for each number of edits, how far each diagonal comes by it."""
    n, m, none = len(a), len(b), -(1 << 60)
    at = {0: _alike(a, 0, b, 0)}
    if at[0] == n == m:
        return 0
    for e in range(1, most + 1):
        now = {}
        for k in range(max(-e, -n), min(e, m) + 1):
            i = min(max(at.get(k, none) + 1, at.get(k - 1, none), at.get(k + 1, none) + 1), n, m - k)
            now[k] = i + _alike(a, i, b, i + k)
        at = now
        if at.get(m - n, none) >= n:
            return e
    return None


def _many(a: Sequence, b: Sequence) -> int:
    """Edits between a and b by differences of neighbours in the table, a block of a's rows as one number; `across` is the block's last row."""
    across = [1] * len(b)
    for lo in range(0, len(a), BLOCK):
        block = a[lo : lo + BLOCK]
        masks: dict = {}
        for i, c in enumerate(block):
            masks.setdefault(c, []).append(i)
        width = len(block)
        for c, places in masks.items():
            held = bytearray(width // 8 + 1)
            for i in places:
                held[i >> 3] |= 1 << (i & 7)
            masks[c] = int.from_bytes(held, "little")
        whole, top = (1 << width) - 1, 1 << (width - 1)
        up, down = whole, 0
        for j, c in enumerate(b):
            same, before = masks.get(c, 0), across[j]
            column = same | down
            if before < 0:
                same |= 1
            row = ((((same & up) + up) ^ up) | same) & whole
            more, less = down | (whole ^ (row | up)), up & row
            across[j] = 1 if more & top else -1 if less & top else 0
            more, less = more << 1 & whole, less << 1 & whole
            if before < 0:
                less |= 1
            elif before > 0:
                more |= 1
            up = less | (whole ^ (column | more))
            down = more & column
    return len(a) + sum(across)


def distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions from a to b (texts, or lists of numbers). Paths take some 2.5 microseconds for each square of the edits, bits 1 + len(a) / 1800 for each symbol of b: paths are given up at half of that."""
    n = _alike(a, 0, b, 0)
    a, b = a[n:], b[n:]
    n = _alike(a[::-1], 0, b[::-1], 0)
    a, b = sorted((a[: len(a) - n], b[: len(b) - n]), key=len)
    if not a:
        return len(b)
    most = int((len(b) * (1 + len(a) / 1800) / 5) ** 0.5)
    found = _few(a, b, most)
    return _many(a, b) if found is None else found


def codes(*texts: Sequence[str]) -> list[Sequence]:
    """Lists of words as texts with a character for each word, which compare fast, or as lists of numbers where there are more words than characters."""
    known: dict[str, int] = {}
    out = [[known.setdefault(w, len(known)) for w in x] for x in texts]
    return ["".join(map(chr, x)) for x in out] if len(known) < 0x110000 else out
