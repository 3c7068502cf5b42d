"""Trees written as S-expressions: parsing, leaves, covers and rewriting."""

from __future__ import annotations

import re

TOKEN = re.compile(r"[()]|[^\s()]+")


def parse(text: str) -> str | list:
    """Nested lists of atoms, without recursion, so depth is no matter."""
    stack: list[list] = [[]]
    for t in TOKEN.findall(text):
        if t == "(":
            stack.append([])
        elif t == ")":
            done = stack.pop()
            if not stack:
                raise ValueError("unbalanced")
            stack[-1].append(done)
        else:
            stack[-1].append(t)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("unbalanced")
    return stack[0][0]


def write(tree: str | list) -> str:
    return tree if isinstance(tree, str) else f"({' '.join(write(x) for x in tree)})"


def leaves(tree: str | list, barrier=lambda node: False) -> list[str]:  # noqa: ANN001
    """Atoms in order; nothing below a node the barrier holds for."""
    if isinstance(tree, str):
        return [tree]
    return [] if barrier(tree) else [a for x in tree for a in leaves(x, barrier)]


def atom_parts(atom: str) -> tuple[str, str, str]:
    """Root, type and language of root/Type/lang."""
    root, kind, lang = (atom.split("/") + ["", ""])[:3]
    return root, kind, lang


def without(tree: str | list, drop) -> str | list | None:  # noqa: ANN001
    """The tree less its atoms that ``drop`` holds for; emptied nodes go, nodes of one child become it."""
    if isinstance(tree, str):
        return None if drop(tree) else tree
    kept = [y for y in (without(x, drop) for x in tree) if y is not None]
    return None if not kept else kept[0] if len(kept) == 1 else kept


def replace(tree: str | list, old: str | list, new: str | list) -> str | list:
    if tree == old:
        return new
    return tree if isinstance(tree, str) else [replace(x, old, new) for x in tree]


def paths(tree: str | list, wanted, at: tuple[int, ...] = ()) -> list[tuple[int, ...]]:  # noqa: ANN001
    """Paths to the atoms that ``wanted`` holds for, in order."""
    if isinstance(tree, str):
        return [at] if wanted(tree) else []
    return [p for i, x in enumerate(tree) for p in paths(x, wanted, (*at, i))]


def at_path(tree: str | list, path: tuple[int, ...]) -> str | list:
    for i in path:
        tree = tree[i]
    return tree


def replace_at(tree: str | list, path: tuple[int, ...], new: str | list) -> str | list:
    if not path:
        return new
    return [replace_at(x, path[1:], new) if i == path[0] else x for i, x in enumerate(tree)]


def smallest_cover(tree: str | list, atoms: set[str]) -> str | list | None:
    """The deepest node that holds all the atoms."""
    if not atoms <= set(leaves(tree)):
        return None
    while not isinstance(tree, str):
        inside = next((x for x in tree if atoms <= set(leaves(x))), None)
        if inside is None:
            return tree
        tree = inside
    return tree


def governing(tree: str | list, clause, focal) -> list[list]:  # noqa: ANN001
    """Innermost clauses (nodes ``clause`` holds for) that hold a focal atom, outermost first, each once."""
    out: list[list] = []

    def walk(node: str | list, best: list | None) -> None:
        if isinstance(node, str):
            if focal(node) and best is not None and not any(best is o for o in out):
                out.append(best)
            return
        best = node if clause(node) else best
        for x in node:
            walk(x, best)

    walk(tree, None)
    return out


def normalise_atoms(atoms: list[str], rename: dict[str, str], drop) -> list[str]:  # noqa: ANN001
    """Sorted distinct atoms after renames and drops: an edge as an unordered set."""
    return sorted({rename.get(a, a) for a in atoms if not drop(a)})
