"""Synthetic values: placeholder names and addresses, built from short lists."""

from __future__ import annotations

from ..model import ConfigurationError

_FIRST = "Ada Bo Cleo Dara Eli Fay Gus Hana Ines Jonas Kira Lev Mona Nils Olga Pia Quin Rosa Sam Tess".split()
_LAST = "Ash Birch Cedar".split()

#: Sixty two-word names, and sixty addresses in a domain reserved for examples.
NAMES = tuple(f"{a} {b}" for b in _LAST for a in _FIRST)
EMAILS = tuple(f"{n.lower().replace(' ', '.')}@example.org" for n in NAMES)
CORPORA = {"name": NAMES, "email": EMAILS}


def load(name: str, path: str) -> tuple[str, ...]:
    """Make the lines of a text file a corpus of that name: without white space around them, and without empty ones."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = tuple(x for x in (line.strip() for line in f) if x)
    except OSError as e:
        raise ConfigurationError(f"corpus {name} can't be read") from e
    if not lines:
        raise ConfigurationError(f"corpus {name} is empty")
    CORPORA[name] = lines
    return lines
