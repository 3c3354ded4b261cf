"""The declarative JSON mapping: responses to posting references, documents to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.binding import let
from gleanwork.functions.urls import base_parts, resolve, resolve_column, url_host
from gleanwork.operators import rules as R
from gleanwork.operators.joins import fits, lookup_join, pinned


def attach_rule(
    df: DataFrame, winners: DataFrame, kind: str, url: Column, spread_by: list[str],
    small_fits: bool | None = None,
) -> DataFrame:
    """Add `host` and the `rule_id` serving it (null when no rule does).

    Rules are broadcast after their number is checked (here, unless the caller knows it):
    one host may hold most rows, and shuffling by host would pile them into one task.
    """
    lookup = winners.filter(F.col("kind") == kind).select(F.col("domain").alias("host"), "rule_id")
    known = fits(lookup) if small_fits is None else small_fits
    return lookup_join(df.withColumn("host", url_host(url)), lookup, ["host"], "left", spread_by, known)


def by_rule(rules: dict[int, object], build) -> Column | None:
    """CASE rule_id over the distinct specifications: rules sharing one share a branch.

    `build(spec, serves)` gives a branch's value, `serves` being its condition.
    """
    branches: dict[str, list[int]] = {}
    specs = {}
    for rule_id, spec in rules.items():
        if spec is None:
            continue
        text = repr(spec)
        branches.setdefault(text, []).append(rule_id)
        specs[text] = spec
    if not branches:
        return None
    result = None
    for text, ids in branches.items():
        condition = F.col("rule_id").isin(*ids)
        branch = build(specs[text], condition)
        result = F.when(condition, branch) if result is None else result.when(condition, branch)
    return result


def of_kind(rules: list[R.Rule], kind: str) -> dict[int, R.Rule]:
    return {i: rule for i, rule in enumerate(rules) if rule.kind == kind}


def applied_field(specs: dict[int, dict], value: Column) -> tuple[Column, Column]:
    """(value, error) of the rules that put a path's text through worker functions.

    `value` is the column that holds what each row's path leads to. Its text is handed to a
    function once per place in the chains, whatever the number of rules: a worker function
    runs for every row of a plan.
    """
    text = F.when(F.col("rule_id").isin(*specs), D.string_of(value))
    for place in range(max(len(spec["apply"]) for spec in specs.values())):
        for name in R.TEXT_FUNCTIONS:
            ids = [i for i, spec in specs.items() if spec["apply"][place : place + 1] == [name]]
            if ids:
                serves = F.col("rule_id").isin(*ids)
                text = F.when(serves, R.text_functions()[name](F.when(serves, text))).otherwise(text)
    first = by_rule({i: spec["apply"][0] for i, spec in specs.items()}, lambda name, _: F.lit(name))
    wrong = ~D.is_absent(value) & (F.schema_of_variant(value) != "STRING")
    return D.variant(text), F.when(wrong, F.concat(first, F.lit("() expects a string, found "), D.kind(value)))


def map_detail(df: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """Read every Silver field from `doc` by the row's rule, all domains in one pass.

    Adds `mapped`, a struct of VARIANT fields (null when undeclared or unresolved), and
    `rule_error`, the first thing a rule could not stomach. Rows without a rule stay.
    What the paths lead to is pinned before it is looked at, so each is walked once.
    """
    chosen = of_kind(rules, R.DETAIL)
    read, wrong, worked = {}, {}, {}
    for field in R.SILVER_FIELDS:
        specs = {i: spec for i, rule in chosen.items() if (spec := rule.spec(field)) is not None}
        applied = {i: spec for i, spec in specs.items() if R.applies(spec)}
        plain = {i: spec for i, spec in specs.items() if i not in applied}
        # A bare path is a specification too: its value is all that is read here.
        paths = {i: spec["path"] if i in applied else spec for i, spec in specs.items()}
        value = by_rule(paths, lambda spec, on: _read(spec, F.col("doc"), on))
        error = by_rule(plain, lambda spec, on: R.compile_field(spec, F.col("doc"), on)[1])
        if value is not None:
            read[field] = value
        if error is not None:
            wrong[field] = error
        if applied:
            worked[field] = applied
    if not read:
        values = F.struct(*[F.lit(None).cast("variant").alias(field) for field in R.SILVER_FIELDS])
        return pinned(df, mapped=values, rule_error=F.lit(None).cast("string"))
    found = pinned(df, **{f"__read_{f}": v for f, v in read.items()}, **{f"__wrong_{f}": v for f, v in wrong.items()})
    values, errors = [], []
    for field in R.SILVER_FIELDS:
        if field not in read:
            values.append(F.lit(None).cast("variant").alias(field))
            continue
        value = F.col(f"__read_{field}")
        plain = F.when(~D.is_absent(value), value)
        error = F.col(f"__wrong_{field}") if field in wrong else F.lit(None).cast("string")
        if field in worked:
            text, refused = applied_field(worked[field], value)
            serves = F.col("rule_id").isin(*worked[field])
            plain, error = F.when(serves, text).otherwise(plain), F.when(serves, refused).otherwise(error)
        values.append(plain.alias(field))
        errors.append(error)
    mapped = pinned(found, mapped=F.struct(*values), rule_error=F.coalesce(*errors, F.lit(None).cast("string")))
    return mapped.drop(*[f"__read_{f}" for f in read], *[f"__wrong_{f}" for f in wrong])


def _read(spec: object, doc: Column, serves: Column) -> Column:
    """A field's value, where JSON null may stand for an absent one."""
    if isinstance(spec, str):
        return D.path_found(doc, spec)
    return R.compile_field(spec, doc, serves)[0]


def _listing(responses: DataFrame, rules: list[R.Rule]) -> tuple[DataFrame, list[str]]:
    """The responses with their postings list and the parts of their address, and the
    columns that go on with each posting."""
    kept = [c for c in responses.columns if c not in ("doc", "rule_id", "host", "text", "body")]

    def postings(spec, on):
        if isinstance(spec, str):
            return D.path_items(F.col("doc"), spec)
        return D.elements(R.compile_field(spec, F.col("doc"), on)[0])

    listed = by_rule({i: rule.spec("postings") for i, rule in of_kind(rules, R.INDEX).items()}, postings)
    listed = F.array().cast("array<variant>") if listed is None else listed
    return pinned(responses, __listed=listed, __base=base_parts(F.col("response_url"))), kept


def index_refs(responses: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """responses(response_url, doc, rule_id, ...) with `refs` in place of the document.

    `refs` is an array of (position, url, document), one per element of the response's
    postings list. An element without a usable address is dropped alone; document is null
    unless the element is itself an object or array (it then has to be fetched). A response
    is one row before and after, so nothing is shuffled.
    """

    def addresses(spec, on):
        if isinstance(spec, dict) and set(spec) == {"sql"}:
            # The expression reads the posting by the name `element`.
            return F.expr(f"transform(__listed, element -> cast(({spec['sql']}) as string))")

        def read(element: Column) -> Column:
            value, error = R.compile_field(spec, element)
            return F.when(error.isNull(), D.as_string(value))

        return F.transform("__listed", read)

    named = by_rule({i: rule.spec("posting_url") for i, rule in of_kind(rules, R.INDEX).items()}, addresses)
    named = F.array().cast("array<string>") if named is None else named
    # Lists are pinned before they are indexed, or each element would rebuild them.
    listing, kept = _listing(responses, rules)
    listing = pinned(listing, __named=named)

    def ref(element: Column, i: Column) -> Column:
        def address(text: Column) -> Column:
            return F.when(text != "", resolve(F.col("__base"), text))

        return F.struct(
            i.alias("position"),
            let(F.get("__named", i), address).alias("url"),
            F.when(D.is_container(element), element).alias("document"),
        )

    found = F.filter(F.transform("__listed", ref), lambda r: r["url"].isNotNull())
    # Pinned, or a filter on the references (exploding them adds one) would build them again.
    return pinned(listing, refs=found).select(*kept, "refs")


def map_index(responses: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """The references of all responses, one row each.

    The same as the exploded `index_refs`, with the list exploded first: each element is then
    read by compiled columns in place of an interpreted expression over the list.
    """

    def address(spec, on):
        if isinstance(spec, dict) and set(spec) == {"sql"}:
            return F.expr(f"get(transform(array(__element), element -> cast(({spec['sql']}) as string)), 0)")
        value, error = R.compile_field(spec, F.col("__element"))
        return F.when(error.isNull(), D.as_string(value))

    listing, kept = _listing(responses, rules)
    named = by_rule({i: rule.spec("posting_url") for i, rule in of_kind(rules, R.INDEX).items()}, address)
    each = listing.select("*", F.posexplode("__listed").alias("__position", "__element"))
    each = each.withColumn("__named", F.lit(None).cast("string") if named is None else named)
    each = resolve_column(each.withColumn("__text", F.nullif("__named", F.lit(""))), "__base", "__text", "__url")
    document = F.when(D.is_container(F.col("__element")), F.col("__element"))
    found = pinned(each, __found=F.struct(F.col("__position").alias("position"), F.col("__url").alias("url"), document.alias("document")))
    return found.filter(F.col("__found.url").isNotNull()).select(*kept, "__found.*")
