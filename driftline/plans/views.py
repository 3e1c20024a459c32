"""The derived tables as SQL, for checking results with another engine."""

from __future__ import annotations

from driftline.sources.derived import SALTS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SALT_CASE = "CASE doc_id % 32 " + " ".join(
    f"WHEN {i} THEN {quote(chr(10) + s)}" for i, s in enumerate(SALTS)
) + " ELSE '' END"

# name: (views it needs, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "content": (
        [],
        f"SELECT doc_id, source, lang, text || {_SALT_CASE} AS text FROM documents",
    ),
}


def with_views(
    names: list[str], body: str, recursive: bool = False, replaced: dict | None = None
) -> str:
    """``body`` with the named views, and what they need, in a WITH clause.

    ``replaced`` holds other definitions for some of the views.
    """
    views = {**VIEWS, **(replaced or {})}
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in views[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(f"{n} AS ({views[n][1]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"
