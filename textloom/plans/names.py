"""Which annotations an export has, and what it calls them."""

from __future__ import annotations


def select_annotations(available: list[str], wanted: list[str]) -> dict[str, str]:
    """Export names by annotation from a list: "a as b" renames, "not a" leaves out, "..." stands for all others; the last entry of a name counts."""
    chosen: dict[str, str] = {}
    left_out = {w[4:].strip() for w in wanted if w.startswith("not ")}
    for w in wanted:
        if w == "...":
            for a in available:
                chosen.setdefault(a, a)
        elif not w.startswith("not "):
            name, _, shown = w.partition(" as ")
            chosen.pop(name.strip(), None)
            chosen[name.strip()] = shown.strip() or name.strip()
    if not any(not w.startswith("not ") for w in wanted):
        chosen = {a: a for a in available}
    return {a: s for a, s in chosen.items() if a not in left_out}


def export_names(annotations: list[str]) -> dict[str, str]:
    """Names without their modules (the part before the last full stop) where that leaves them different."""
    short = {a: a.rpartition(".")[2] for a in annotations}
    count: dict[str, int] = {}
    for s in short.values():
        count[s] = count.get(s, 0) + 1
    return {a: s if count[s] == 1 else a for a, s in short.items()}


def without_collisions(names: dict[str, str], taken: list[str], prefix: str = "corpus") -> dict[str, str]:
    """Export names of which those that are ``taken`` (by elements of the source) get a prefix."""
    return {a: f"{prefix}.{s}" if s in taken else s for a, s in names.items()}
