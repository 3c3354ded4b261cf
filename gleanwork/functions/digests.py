"""Structural digests of JSON documents, for comparing nodes across tables."""

from __future__ import annotations

import hashlib
import json


def _leaf(value: object) -> str:
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value)


def _known(node: object, ids: dict, add: bool, containers: set[int] | None = None) -> int | None:
    """The number of a JSON value among those in `ids`; None for a new one, unless it is to be
    added. Equal values have one number, whatever their key order or number spelling."""
    kind = type(node)
    if kind is str:
        key = node
    elif kind is dict:
        members = []
        for name, child in node.items():
            known = _known(child, ids, add, containers)
            if known is None:
                return None
            members.append((name, known))
        members.sort()
        key = ("{", *members)
    elif kind is list:
        members = []
        for child in node:
            known = _known(child, ids, add, containers)
            if known is None:
                return None
            members.append(known)
        key = ("[", *members)
    elif kind is int or kind is float:
        key = (_leaf(node),)
    else:
        key = node  # true, false or null; numbers are never keys themselves
    found = ids.setdefault(key, len(ids)) if add else ids.get(key)
    if containers is not None and (kind is dict or kind is list):
        containers.add(found)
    return found


def held_nodes(whole: object, nodes: list) -> list[bool]:
    """Whether each value is an object or array somewhere in the whole document.

    The document's values are numbered once, and a value is known by the numbers of its
    members: no digest is made of what is compared within one row only.
    """
    try:
        ids: dict = {}
        containers: set[int] = set()
        _known(whole, ids, True, containers)
        return [_known(node, ids, False) in containers for node in nodes]
    except RecursionError:
        # Nested too deep to call for each level.
        held: set[str] = set()
        node_digest(whole, held)
        return [node_digest(node) in held for node in nodes]


def node_digest(node: object, found: set[str] | None = None) -> str:
    """A digest equal for equal JSON values, whatever their key order or number spelling.

    Built from the members' digests, so a whole tree costs one pass; every object and
    array met on the way is added to `found`. The walk keeps its own stack: a document's
    depth is no limit.
    """
    done: list[str] = []  # digests of finished nodes whose parent is not finished
    waiting: list[tuple[object, bool]] = [(node, False)]
    while waiting:
        at, ready = waiting.pop()
        if not isinstance(at, (dict, list)):
            done.append(_leaf(at))
            continue
        children = list(at.values()) if isinstance(at, dict) else at
        if not ready:
            waiting.append((at, True))
            waiting.extend((child, False) for child in reversed(children))
            continue
        digests = done[len(done) - len(children) :]
        del done[len(done) - len(children) :]
        if isinstance(at, dict):
            body = "{" + json.dumps(sorted(zip(at, digests, strict=True)))
        else:
            body = "[" + json.dumps(digests)
        digest = hashlib.sha256(body.encode()).hexdigest()
        if found is not None:
            found.add(digest)
        done.append(digest)
    return done[0]
