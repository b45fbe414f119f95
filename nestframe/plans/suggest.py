"""Names that a mistyped one may have meant."""

from __future__ import annotations

from collections.abc import Iterable


def distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b; a difference in case alone is one."""
    if a == b:
        return 0
    a, b = a.lower(), b.lower()
    if a == b:
        return 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def suggestions(name: str, known: Iterable[str]) -> list[str]:
    """Known names within half the longer name's length, nearest first."""
    scored = [(distance(name, k), k) for k in known]
    return [k for d, k in sorted(scored) if d <= max(len(name) // 2, len(k) // 2, 1)]


def or_list(names: list[str], limit: int = 5) -> str:
    quoted = [f'"{n}"' for n in names[:limit]]
    if len(quoted) < 2:
        return "".join(quoted)
    return f"{', '.join(quoted[:-1])}{',' if len(quoted) > 2 else ''} or {quoted[-1]}"


def did_you_mean(name: str, known: Iterable[str]) -> str:
    found = suggestions(name, known)
    return f" Did you mean {or_list(found)}?" if found else ""
