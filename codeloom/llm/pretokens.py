"""Pre-tokens of the byte-level vocabularies: the matches of the published splitting pattern, by cached chunks."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

#: The contractions of the published pattern, and Unicode's White_Space characters.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


@functools.cache
def splitter() -> tuple[re.Pattern, re.Pattern]:
    """(the pattern with its character classes written out, so that the faster re can match it; a blank before white
    space)."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    letters, numbers = ("".join(_ranges(_runs(p, every))) for p in (r"\p{L}", r"\p{N}"))
    return re.compile(rf"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"), re.compile(f" [{SPACES}]")


def _runs(p: str, every: str) -> Iterator[tuple[int, int]]:
    """The runs of code points that match p, which stand next to each other in ``every`` as in Unicode."""
    import regex

    start = last = None
    for m in regex.finditer(p, every):
        at = ord(m[0])
        if last is not None and at == last + 1:
            last = at
            continue
        if start is not None:
            yield start, last
        start = last = at
    if start is not None:
        yield start, last


def _ranges(runs: Iterator[tuple[int, int]]) -> Iterator[str]:
    for a, b in runs:
        yield re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}"


def pieces(text: str) -> list[str]:
    return splitter()[0].findall(text)


def chunks(text: str) -> tuple[str, list[str]] | None:
    """(what stands before the first blank, what follows each blank), or None where a blank precedes white space or the end. A
    match can only begin at a blank or stand between two, so the pieces of a text are those of its first part and those
    of a blank and each other part; only white space with a blank that no word follows breaks that rule."""
    if text.endswith(" ") or splitter()[1].search(text):
        return None
    first, *rest = text.split(" ")
    return first, rest
