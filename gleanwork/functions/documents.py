"""Typed reads from VARIANT documents, guarded so that no row can fail a task."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions.binding import let

_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"
_STEP = r"(?:[A-Za-z_][A-Za-z0-9_]*|\"[^\"\\']+\")"
# a.b, a[0].b, a[].b, "a.b".c, [0], [] and @ for the whole document. An index has to fit an
# integer; a quoted member may hold anything but quotes and backslashes.
PATH = re.compile(rf"^(?:@|(?:{_STEP}|\[[0-9]{{0,9}}\])(?:\.{_STEP}|\[[0-9]{{0,9}}\])*)\Z")
PATH_SQL = PATH.pattern.replace(r"\Z", r"\z")
# A `[]` step, which inside quotes is part of a name.
_EACH = r'\[\](?=(?:[^"]*"[^"]*")*[^"]*$)'


def parse_json(text: Column) -> Column:
    return F.try_parse_json(text)


def parse_document(text: Column) -> Column:
    """The parsed body, or null unless it is a JSON object or array."""
    return F.when(text.rlike(r"\A[ \t\r\n]*[\[{]"), F.try_parse_json(text))


def field(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null when absent.

    Meant for leaves and small values: it renders the value's whole schema.
    """
    return let(
        F.schema_of_variant(value),
        lambda shape: F.when(F.startswith(shape, F.lit("OBJECT")), F.lit("object"))
        .when(F.startswith(shape, F.lit("ARRAY")), F.lit("array"))
        .when(shape == "STRING", F.lit("string"))
        .when(shape == "BOOLEAN", F.lit("boolean"))
        .when(shape.rlike(_NUMBER), F.lit("number"))
        .when(shape == "VOID", F.lit("null"))
        .when(shape.isNotNull(), F.lit("other")),
    )


def is_absent(value: Column) -> Column:
    """Missing, or present as JSON null."""
    return value.isNull() | F.is_variant_null(value)


def elements(value: Column) -> Column:
    """The array's elements; null for anything but an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def entries(value: Column) -> Column:
    """The object's members as a map; null for anything but an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def is_container(value: Column) -> Column:
    """Whether it is a JSON object or array, without copying what it holds."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull() | elements(value).isNotNull()


def as_string(value: Column) -> Column:
    """The text of a JSON string; null for every other kind, numbers included."""
    return let(
        value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    )


def string_of(value: Column) -> Column:
    """The same for a column or a lambda's argument: it is named twice in place of bound, and so compiled."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_number(value: Column) -> Column:
    return let(
        value,
        lambda v: F.when(F.schema_of_variant(v).rlike(_NUMBER), F.try_variant_get(v, "$", "double")),
    )


def string_list(value: Column) -> Column:
    """array<string>, or null unless every element is a JSON string."""
    return let(
        F.transform(elements(value), string_of),
        lambda texts: F.when(~F.exists(texts, lambda text: text.isNull()), texts),
    )


def variant(value: Column) -> Column:
    return value.cast("variant")


def filter_text(value: Column) -> Column:
    """A JSON scalar in the terms a query parameter is written in."""
    return let(
        value,
        lambda v: let(
            kind(v),
            lambda shape: F.when(shape == "string", F.try_variant_get(v, "$", "string")).when(
                shape.isin("boolean", "number"), F.to_json(v)
            ),
        ),
    )


def _flat(items: Column) -> Column:
    """Merge one level of nested lists, as a `[]` step does."""
    return F.flatten(F.transform(items, lambda item: F.coalesce(elements(item), F.array(item))))


def _present(items: Column) -> Column:
    return F.filter(items, lambda item: ~is_absent(item))


def _variant_path(steps: Column) -> Column:
    """`a."b.c"[0]` to `$.a["b.c"][0]`."""
    quoted = F.regexp_replace(steps, r'\.?("[^"]+")', "[$1]")
    return (
        F.when((steps == "") | (steps == "@"), F.lit("$"))
        .when(F.startswith(quoted, F.lit("[")) | F.startswith(quoted, F.lit(".")), F.concat(F.lit("$"), quoted))
        .otherwise(F.concat(F.lit("$."), quoted))
    )


def eval_path(doc: Column, path: Column) -> Column:
    """Evaluate a per-row path (`a.b`, `a[].b`, `a[0].b`) on a document.

    Returns a struct: `is_list`, `items` (the values) and `resolved`. A projection over
    something that is not a list does not resolve; over an empty list it does.
    """

    def walk(items: Column, steps: Column) -> Column:
        last = F.size(steps) - 1
        return F.aggregate(
            F.transform(steps, lambda step, i: F.struct(_variant_path(step).alias("step"), (i == last).alias("last"))),
            items,
            lambda found, part: F.when(
                part["last"],
                _present(F.transform(found, lambda item: F.try_variant_get(item, part["step"], "variant"))),
            ).otherwise(
                F.flatten(
                    F.transform(
                        found,
                        lambda item: F.coalesce(
                            elements(F.try_variant_get(item, part["step"], "variant")),
                            F.array().cast("array<variant>"),
                        ),
                    )
                )
            ),
        )

    def outcome(is_list: Column, items: Column, resolved: Column) -> Column:
        return F.struct(is_list.alias("is_list"), items.alias("items"), resolved.alias("resolved"))

    def projected(head: Column, parts: Column) -> Column:
        steps = F.slice(parts, F.lit(2), F.size(parts) - 1)
        return let(
            walk(_flat(elements(head)), steps), lambda items: outcome(F.lit(True), items, items.isNotNull())
        )

    def plain(head: Column) -> Column:
        return let(
            elements(head),
            lambda items: F.when(items.isNotNull(), outcome(F.lit(True), items, F.lit(True)))
            .when(~is_absent(head), outcome(F.lit(False), F.array(head), F.lit(True)))
            .otherwise(outcome(F.lit(False), F.lit(None).cast("array<variant>"), F.lit(False))),
        )

    def evaluated(parts: Column) -> Column:
        head = F.try_variant_get(doc, _variant_path(F.element_at(parts, 1)), "variant")
        return let(head, lambda h: F.when(F.size(parts) > 1, projected(h, parts)).otherwise(plain(h)))

    return let(F.split(path, _EACH), evaluated)


def _steps(path: str) -> list[str]:
    if not PATH.match(path):
        raise ValueError(f"not a document path: {path!r}")
    return [re.sub(r'\.?("[^"]+")', r"[\1]", step) for step in re.split(_EACH, path)]


def _at(value: Column, step: str) -> Column:
    if step in ("", "@"):
        return value
    return F.try_variant_get(value, ("$" if step[0] in "[." else "$.") + step, "variant")


def path_items(doc: Column, path: str) -> Column:
    """The list a path known when the plan is built leads to; null when it is none."""
    parts = _steps(path)
    if len(parts) == 1:
        return elements(_at(doc, parts[0]))
    items = _flat(elements(_at(doc, parts[0])))
    for step in parts[1:-1]:
        items = F.flatten(
            F.transform(
                items,
                lambda item: F.coalesce(elements(_at(item, step)), F.array().cast("array<variant>")),
            )
        )
    final = parts[-1]
    return _present(F.transform(items, lambda item: _at(item, final)) if final else items)


def path_found(doc: Column, path: str) -> Column:
    """The same value where JSON null is left as it is: compiled, and written only once."""
    parts = _steps(path)
    return _at(doc, parts[0]) if len(parts) == 1 else path_items(doc, path).cast("variant")


def path_value(doc: Column, path: str) -> Column:
    """The value at such a path as a VARIANT; null when it does not resolve."""
    parts = _steps(path)
    if len(parts) == 1:
        return let(_at(doc, parts[0]), lambda value: F.when(~is_absent(value), value))
    return path_items(doc, path).cast("variant")


def drop_empty(metadata: Column) -> Column:
    """The object without members that are null, "", [] or {}; other values unchanged."""
    kept = F.map_filter(
        entries(metadata),
        lambda _, value: ~is_absent(value) & ~F.to_json(value).isin('""', "[]", "{}"),
    )
    return let(kept, lambda k: F.when(k.isNotNull(), F.to_variant_object(k)).otherwise(metadata))


def metadata_text(value: Column) -> Column:
    """What a metadata value shows as; null when it has no text form."""

    def scalar(item: Column) -> Column:
        text = as_string(item)
        number = F.when(kind(item) == "number", F.to_json(item))
        return F.coalesce(F.when(text != "", text), number)

    def joined(texts: Column) -> Column:
        whole = (F.size(texts) > 0) & ~F.exists(texts, lambda text: text.isNull())
        return F.when(texts.isNotNull(), F.when(whole, F.array_join(texts, ", "))).otherwise(scalar(value))

    return let(F.transform(elements(value), scalar), joined)


def json_salvage(text: Column) -> Column:
    """The object in a reply that may carry prose around it; an empty object if none."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when(
        (start > 0) & F.contains(text, F.lit("}")) & (end >= start),
        F.substring(text, start, end - start + 1),
    )

    def gated(body: Column) -> Column:
        parsed = F.try_parse_json(body)
        return F.when(entries(parsed).isNotNull(), parsed)

    return F.coalesce(gated(text), gated(inner), F.parse_json(F.lit("{}")))
