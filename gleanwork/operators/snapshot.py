"""Regression checks of rule output against pinned expectations, table against table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.functions import documents as D
from gleanwork.functions.digests import held_nodes
from gleanwork.functions.pay import pay_violation
from gleanwork.operators.joins import pinned
from gleanwork.operators.quality import metadata_violations

SCALARS = ("title", "company_name", "employment_type")
LISTS = ("locations", "categories")
REQUIRED = ("title", "company_name", "description")


def link_differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., side): `missing` rows are expected and not found, `extra` the reverse."""
    want = expected.select(*keys).distinct().withColumn("want", F.lit(True))
    have = actual.select(*keys).distinct().withColumn("have", F.lit(True))
    return (
        want.join(have, keys, "full_outer")
        .filter(F.col("want").isNull() | F.col("have").isNull())
        .select(*keys, F.when(F.col("have").isNull(), "missing").otherwise("extra").alias("side"))
    )


def unpinned_links(snapshots: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Snapshots that pin no link at all and so prove nothing."""
    return snapshots.join(expected.select(key).distinct(), key, "left_anti").select(key)


def _as_set(value: Column) -> Column:
    items = F.transform(D.elements(value), lambda item: F.to_json(item))
    return F.array_sort(F.array_distinct(F.coalesce(items, F.array().cast("array<string>"))))


def _text(value: Column) -> Column:
    return F.when(~D.is_absent(value), F.to_json(value))


def field_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, field, problem, expected, actual) of every broken expectation.

    Both frames are (key, doc VARIANT). Scalars compare exactly, lists as sets, the
    description trimmed, pay exactly; only what a snapshot pins is compared, whereas the
    required fields must be present and metadata and pay must obey their own rules.
    """
    want = expected.select(key, F.col("doc").alias("want"), F.lit(True).alias("pinned"))
    have = actual.select(key, F.col("doc").alias("have"), F.lit(True).alias("produced"))
    both = want.join(have, key, "full_outer")
    checks = []

    def check(field: str, problem: str, broken: Column, exp: Column, act: Column) -> None:
        checks.append(
            F.when(
                broken,
                F.struct(
                    F.lit(field).alias("field"), F.lit(problem).alias("problem"),
                    exp.alias("expected"), act.alias("actual"),
                ),
            )
        )

    none = F.lit(None).cast("string")
    matched = F.col("pinned") & F.col("produced")
    check("*", "not_produced", F.col("produced").isNull(), none, none)
    check("*", "not_pinned", F.col("pinned").isNull(), none, none)
    for field in REQUIRED:
        check(field, "absent", matched & D.field(F.col("have"), f"$.{field}").isNull(), none, none)
    for field in SCALARS:
        exp, act = D.field(F.col("want"), f"$.{field}"), D.field(F.col("have"), f"$.{field}")
        check(field, "differs", matched & exp.isNotNull() & ~_text(exp).eqNullSafe(_text(act)), _text(exp), _text(act))
    for field in LISTS:
        exp, act = D.field(F.col("want"), f"$.{field}"), D.field(F.col("have"), f"$.{field}")
        check(field, "differs", matched & exp.isNotNull() & (_as_set(exp) != _as_set(act)), _text(exp), _text(act))
    exp = D.as_string(D.field(F.col("want"), "$.description"))
    act = D.as_string(D.field(F.col("have"), "$.description"))

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")

    differs = (trimmed(exp) != "") & ~trimmed(exp).eqNullSafe(trimmed(F.coalesce(act, F.lit(""))))
    check("description", "differs", matched & F.coalesce(differs, F.lit(False)), exp, act)
    exp, act = D.field(F.col("want"), "$.pay"), D.field(F.col("have"), "$.pay")
    check("pay", "differs", matched & exp.isNotNull() & ~_text(exp).eqNullSafe(_text(act)), _text(exp), _text(act))
    check("pay", "invalid", matched & pay_violation(act).isNotNull(), none, pay_violation(act))
    check("pay", "pinned_invalid", matched & pay_violation(exp).isNotNull(), pay_violation(exp), none)
    broken = metadata_violations(F.col("have"))
    check("metadata", "invalid", matched & (F.size(broken) > 0), none, F.to_json(broken))
    title = trimmed(D.as_string(D.field(F.col("want"), "$.title")))
    text = trimmed(D.as_string(D.field(F.col("want"), "$.description")))
    proves = F.coalesce((title != "") & (text != ""), F.lit(False))
    check("*", "proves_nothing", F.col("pinned") & ~proves, none, none)
    found = F.filter(F.array(*checks), lambda entry: entry.isNotNull())
    return both.select(key, F.explode(found).alias("f")).select(key, "f.*")


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def are_nodes(whole, documents):
    """For each of a row's documents, whether it is a node of the row's whole document."""
    import json

    import pyarrow as pa

    out = []
    for text, listed in zip(whole.to_pylist(), documents.to_pylist(), strict=True):
        if text is None or listed is None:
            out.append(None if listed is None else [False] * len(listed))
            continue
        given = [place for place, d in enumerate(listed) if d is not None]
        held = held_nodes(json.loads(text), [json.loads(listed[place]) for place in given])
        known = [False] * len(listed)
        for place, found in zip(given, held, strict=True):
            known[place] = found
        out.append(known)
    return pa.array(out, pa.list_(pa.bool_()))


def foreign_documents(responses: DataFrame) -> DataFrame:
    """(response_id, position, url) of references whose document is not a node of their response.

    responses(response_id, doc VARIANT, refs): `refs` is the array of (position, url,
    document) that mapping made of the response, so both sides of the question are one row.
    Its nodes are held for that row only and each reference is looked up among
    them; nothing is shuffled, and only foreign references become rows. References without a
    document have none to compare.
    """
    texts = pinned(responses, __doc=F.to_json("doc"), __texts=F.transform("refs", lambda r: F.to_json(r["document"])))
    judged = pinned(texts, __known=are_nodes(F.col("__doc"), F.col("__texts")))
    known = F.arrays_zip(F.col("refs").alias("ref"), F.col("__known").alias("known"))
    foreign = F.filter(known, lambda k: k["ref"]["document"].isNotNull() & ~k["known"])
    return judged.select("response_id", F.explode(F.transform(foreign, lambda k: k["ref"])).alias("r")).select("response_id", "r.position", "r.url")
