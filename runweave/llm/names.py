"""Comparing names as people and recognisers write them."""

from __future__ import annotations

import re

# Words that tell versions of one piece apart.
VERSION_WORDS = frozenset(
    "mix remix edit reedit dub rework bootleg mashup live instrumental acapella acappella version remaster remastered "
    "extended radio club vip demo acoustic original unplugged reprise intro outro karaoke flip refix".split()
)
_WORD = re.compile(r"\w+", re.UNICODE)
_ROMAN = re.compile(r"^(?=[ivx])(x{0,3})(ix|iv|v?i{0,3})$")


def key(text: str) -> str:
    """Letters and digits in lower case."""
    return "".join(_WORD.findall(text.casefold())).replace("_", "")


def marks(text: str) -> tuple:
    """What must agree for two titles to be one recording: numbers, and version words in brackets or at the end."""
    words = _WORD.findall(text.casefold())
    numbers = tuple(re.findall(r"\d+", text)) + tuple(w for a, w in zip(words, words[1:]) if a in ("pt", "part", "vol", "volume", "no", "chapter") and _ROMAN.match(w))
    return numbers, tuple(sorted(w for w in words if w in VERSION_WORDS))


def within(a: str, b: str, k: int) -> bool:
    """Whether at most ``k`` slips (a letter more, less, other, or two neighbours exchanged) lie between a and b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return max(len(a), len(b)) <= k
    # Only the diagonals -k to k are kept: place y - x + k of row x.
    wide, far = 2 * k + 1, k + 1
    last = [abs(c - k) if c >= k else far for c in range(wide)]
    before = [far] * wide
    for x in range(1, len(a) + 1):
        row = [far] * wide
        for c in range(wide):
            y = x + c - k
            if y < 0 or y > len(b):
                continue
            if y == 0:
                row[c] = x
                continue
            d = last[c] + (a[x - 1] != b[y - 1])
            if c + 1 < wide:
                d = min(d, last[c + 1] + 1)
            if c:
                d = min(d, row[c - 1] + 1)
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, before[c] + 1)
            row[c] = min(d, far)
        if min(row) > k:
            return False
        before, last = last, row
    return last[len(b) - len(a) + k] <= k
