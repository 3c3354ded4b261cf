"""Preparing documents for rule learning: size budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Context windows in tokens, the reserve, characters per token, HTML budget.
WINDOWS = {"discovery": 32768, "extraction": 65536, "index": 65536}
RESERVED_TOKENS = 4096
CHARS_PER_TOKEN = 2
HTML_CHARS = 120_000


def budget_chars(kind: str, windows: dict[str, int] | None = None) -> int:
    """Characters an index or detail document may take in its prompt."""
    stage = {"index": "index", "detail": "extraction"}.get(kind)
    if stage is None:
        raise ValueError(f"no document budget for {kind!r}")
    return ((windows or WINDOWS)[stage] - RESERVED_TOKENS) * CHARS_PER_TOKEN


def _trimmed(text: str, budget: int) -> str | None:
    """Indented JSON within the budget, dropping last elements of the longest array."""
    import heapq
    import json

    try:
        document = json.loads(text)
    except (ValueError, RecursionError):
        return None
    whole = json.dumps(document, indent=2)
    size = len(whole)
    if size <= budget:
        return whole
    heap: list = []
    inner: dict[int, list[int]] = {}
    arrays: dict[int, tuple[list, int]] = {}
    order = 0
    stack = [(document, 0, None)]
    while stack:
        node, depth, owner = stack.pop()
        here = owner
        if isinstance(node, list):
            here = order
            arrays[order] = (node, depth)
            inner.setdefault(owner, []).append(order) if owner is not None else None
            heapq.heappush(heap, (-len(node), order))
            order += 1
        children = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        stack.extend((child, depth + 1, here) for child in reversed(list(children)))
    gone: set[int] = set()
    while size > budget:
        while heap and (heap[0][1] in gone or -heap[0][0] != len(arrays[heap[0][1]][0])):
            heapq.heappop(heap)
        if not heap or -heap[0][0] <= 1:
            return None
        _, place = heapq.heappop(heap)
        array, depth = arrays[place]
        last = array.pop()
        body = json.dumps(last, indent=2)
        indent = 2 * (depth + 1)
        # The element's own lines, its separator and its indentation leave with it.
        size -= len(body) + body.count("\n") * indent + 2 + indent
        dropped = {id(last)}
        pending = [last]
        while pending:
            node = pending.pop()
            dropped.add(id(node))
            pending.extend(
                child
                for child in (node.values() if isinstance(node, dict) else node if isinstance(node, list) else ())
                if isinstance(child, (dict, list))
            )
        gone.update(i for i in inner.get(place, []) if id(arrays[i][0]) in dropped)
        nested = [i for i in inner.get(place, []) if i in gone]
        while nested:
            below = inner.get(nested.pop(), [])
            gone.update(below)
            nested.extend(below)
        heapq.heappush(heap, (-len(array), place))
    return json.dumps(document, indent=2)


def trim_to_budget(document: Column, chars: int) -> Column:
    """The document as indented JSON of at most `chars` characters.

    Drops the last element of the array with the most elements, wherever it is, until the
    text fits; null when no array has more than one element left to drop, and for documents
    Python cannot read (a number of thousands of digits, thousands of levels).
    """

    @F.arrow_udf(T.StringType())
    def trimmed(texts):
        import pyarrow as pa

        return pa.array([None if t is None else _trimmed(t, chars) for t in texts.to_pylist()], pa.string())

    return trimmed(F.when(F.try_parse_json(document).isNotNull(), document))
