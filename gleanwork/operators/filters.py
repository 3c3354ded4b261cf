"""A board's `filter.` parameters applied to the postings of its responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.binding import let
from gleanwork.functions.urls import filter_params
from gleanwork.operators.joins import pinned

INVALID_KEY = "invalid_key"
UNRESOLVED_KEY = "unresolved_key"


def judge_responses(responses: DataFrame) -> DataFrame:
    """responses(stored_url, refs, ...) with every ref judged and a `reason` of refusal.

    A response and its postings are one row, so the rules over a whole response (a key that
    resolves nowhere refuses it) need neither a shuffle nor a join: each posting's outcome
    per key is worked out once and read by both.
    """
    keyed = pinned(
        responses,
        filters=F.transform(
            filter_params(F.col("stored_url")),
            lambda f: F.struct(
                f["key"].alias("key"), f["values"].alias("values"), f["key"].rlike(D.PATH_SQL).alias("valid")
            ),
        ),
    )

    def check(document: Column):
        def run(entry: Column) -> Column:
            def outcome(found: Column) -> Column:
                texts = F.transform(found["items"], D.filter_text)
                return F.struct(
                    F.coalesce(found["resolved"], F.lit(False)).alias("resolved"),
                    F.coalesce(F.arrays_overlap(texts, entry["values"]), F.lit(False)).alias("matched"),
                )

            return F.when(
                entry["valid"] & document.isNotNull(), let(D.eval_path(document, entry["key"]), outcome)
            )

        return run

    judged = pinned(
        keyed,
        refs=F.transform(
            "refs", lambda ref: ref.withField("checks", F.transform("filters", check(ref["document"])))
        ),
    )
    in_hand = F.filter("refs", lambda ref: ref["document"].isNotNull())
    resolved = F.transform(
        F.sequence(F.lit(0), F.size("filters") - 1),
        lambda i: F.exists("refs", lambda ref: F.coalesce(F.get(ref["checks"], i)["resolved"], F.lit(False))),
    )
    has_filters = F.size("filters") > 0
    reason = F.when(F.exists("filters", lambda f: ~f["valid"]), INVALID_KEY).when(
        has_filters & (F.size(in_hand) > 0), F.when(~F.forall(resolved, lambda hit: hit), UNRESOLVED_KEY)
    )
    return pinned(judged, reason=reason)


def apply_posting_filters(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving references, refused responses) of responses(stored_url, refs, ...).

    Keys combine with AND, a key's values with OR, a list matches on any element.
    References without a document pass unless their whole response is refused.
    """
    judged = judge_responses(responses)
    passing = F.filter(
        "refs",
        lambda ref: ref["document"].isNull() | F.forall(ref["checks"], lambda check: check["matched"]),
    )
    surviving = F.transform(passing, lambda ref: ref.dropFields("checks"))
    carried = [c for c in responses.columns if c not in ("refs", "stored_url")]
    kept = judged.filter(F.col("reason").isNull()).select(*carried, F.inline(surviving))
    refused = judged.filter(F.col("reason").isNotNull()).select("response_id", "reason")
    return kept, refused
