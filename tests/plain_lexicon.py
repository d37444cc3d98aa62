"""A plain version, one text at a time, of `paperflow.functions.lexicon.overstatements`."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import plain_prose as prose
import regex

GUARD_REACH = 20


@dataclass(frozen=True)
class Entry:
    """A pattern with its severity. A guard looks at what follows: `require` must be there, `reject` must not."""

    ident: str
    pattern: str
    severity: str = "hard"
    require: str | None = None
    reject: str | None = None
    english: bool = False


def overstatements(text: str | None, entries: Iterable[Entry]) -> list[tuple[str, str, int, int]]:
    """(rule, severity, start, end), one for each start: a hard finding before a warning, then the longest, then the first entry.

    English entries don't apply inside parentheses."""
    low = prose.lower_same_length(text or "")
    open_text, best = prose.mask(low, ("url", "doi", "paren"))[0], {}
    for e in entries:
        for m in regex.finditer(e.pattern, open_text if e.english else low):
            after = low[m.end() : m.end() + GUARD_REACH]
            if m[0] and (e.require is None or regex.search(e.require, after)) and (e.reject is None or not regex.search(e.reject, after)):
                weight = (e.severity == "hard", m.end())
                if m.start() not in best or weight > best[m.start()][0]:
                    best[m.start()] = (weight, (e.ident, e.severity, m.start(), m.end()))
    return [best[a][1] for a in sorted(best)]
