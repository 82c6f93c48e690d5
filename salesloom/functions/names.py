"""Column names for values, from which the values can be told again.

A value is its own column name unless that would clash: with a column that is there
already, with another value but for letter case (Spark's names ignore it), with the name
of the missing value or with a name made here. Then the name is "=" (more of them, should that be a column too) and the value
in percent encoding, capitals encoded too, so that names stay apart in any case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

NULL_COLUMN = "null"
MARK = "="
#: What no value's encoding is.
NO_VALUE = "%"
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_ -")


def _fold(name: str) -> str:
    return "".join(letter.upper().lower() for letter in name)


def _encoded(value: str) -> str:
    return "".join(
        letter if letter in PLAIN else "".join(f"%{byte:02x}" for byte in letter.encode("utf-8", "surrogatepass"))
        for letter in value
    )


def column_names(values: Sequence[str | None], taken: Iterable[str] = ()) -> list[str]:
    """A column name for each value, in order; ``taken`` are the names of other columns."""
    folds = Counter(_fold(value) for value in dict.fromkeys(values) if value is not None)
    taken = set(map(_fold, taken))
    names = []
    for value in values:
        plain = NULL_COLUMN if value is None else value
        clashes = value is not None and (folds[_fold(value)] > 1 or _fold(value) == _fold(NULL_COLUMN))
        if not plain or plain.startswith(MARK) or clashes or _fold(plain) in taken:
            plain = MARK + (NO_VALUE if value is None else _encoded(value))
        while _fold(plain) in taken:
            plain = MARK + plain
        names.append(plain)
    return names


def value_of(name: str) -> str | None:
    """The value that a column was named for."""
    encoded = name.lstrip(MARK)
    if encoded == name:
        return None if name == NULL_COLUMN else name
    return None if encoded == NO_VALUE else unquote(encoded, errors="surrogatepass")


def quoted(name: str) -> str:
    """A column name to be taken as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"
