"""HTML jobs: pages are read once into a node array, every rule is an expression over it.

A page's nodes are kept as one array per row in document order (`nodes[pre]` is the node,
`slice(pre, size)` its subtree), so link, clean and extraction rules need no shuffle and
no join. `node_rows` gives the same as a relational table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.functions import htmltree
from gleanwork.functions.binding import let
from gleanwork.functions.urls import next_page_url, url_join
from gleanwork.operators import rules as R
from gleanwork.operators.joins import pinned
from gleanwork.schemas import NODES


@F.arrow_udf(NODES)
def shred(markup):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(NODES)

    def rows(page):
        nodes = htmltree.read(page) if page is not None else None
        if nodes is None:
            return None
        return [{**n, "attrs": list(n["attrs"].items()) if n["attrs"] is not None else None} for n in nodes]

    # One page's nodes at a time are Python objects, which take many times their markup.
    return pa.concat_arrays([pa.array([], kind), *(pa.array([rows(page.as_py())], type=kind) for page in markup)])


@F.arrow_udf(T.StringType())
def to_html(nodes):
    import pyarrow as pa

    return pa.array([htmltree.write(n.as_py()) if n.is_valid else None for n in nodes], pa.string())


@F.arrow_udf(T.StringType())
def markdown_of(nodes):
    import pyarrow as pa

    return pa.array([htmltree.markdown(n.as_py()) if n.is_valid else None for n in nodes], pa.string())


@F.arrow_udf(T.StringType())
def markdown(fragment):
    """Markdown of an HTML fragment."""
    import pyarrow as pa

    return pa.array(
        [None if f is None else htmltree.markdown(htmltree.nodes_of(f)) for f in fragment.to_pylist()],
        pa.string(),
    )


def shred_pages(pages: DataFrame) -> DataFrame:
    """pages(url, html, ...) with `nodes` in place of the markup."""
    return pinned(pages, nodes=shred(F.col("html")))


def rendered(df: DataFrame, name: str, render, nodes: Column) -> DataFrame:
    """Add the output of a node renderer (`to_html`, `markdown_of`) over a nodes expression.

    The argument is made a column of its own first: a worker function over an expression
    with nested lambdas is not always split off the plan.
    """
    given = pinned(df, __nodes=nodes)
    return pinned(given, **{name: render(F.col("__nodes"))}).drop("__nodes")


def node_rows(pages: DataFrame) -> DataFrame:
    """The relational form: one row per node of every page."""
    return pages.select("page_id", F.inline(shred(F.col("html"))))


def first(items: Column, predicate) -> Column:
    return F.get(F.filter(items, predicate), F.lit(0))


def subtree(nodes: Column, node: Column) -> Column:
    """The node and everything below it."""
    return F.slice(nodes, node["pre"] + 1, node["size"])


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has_class(node: Column, name: str) -> Column:
    classes = F.split(F.coalesce(attribute(node, "class"), F.lit("")), r"\s+")
    return F.array_contains(classes, F.lit(name))


def texts(nodes: Column) -> Column:
    """The non-blank text pieces, each trimmed."""
    trimmed = F.transform(
        F.filter(nodes, lambda n: n["tag"] == "#text"),
        lambda n: F.regexp_replace(n["text"], r"(?U)^\s+|\s+\z", ""),
    )
    return F.filter(trimmed, lambda text: text != "")


def text_of(nodes: Column, separator: str = "") -> Column:
    return F.array_join(texts(nodes), separator)


def page_base(nodes: Column, url: Column) -> Column:
    """What relative links resolve against: the first `base` address, else the page's."""
    href = F.get(
        F.transform(
            F.filter(nodes, lambda n: (n["tag"] == "base") & attribute(n, "href").isNotNull()),
            lambda n: attribute(n, "href"),
        ),
        F.lit(0),
    )
    return F.when(href.isNull(), url).otherwise(url_join(url, href))


def anchors(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: (n["tag"] == "a") & attribute(n, "href").isNotNull())


def resolve_links(pages: DataFrame) -> DataFrame:
    """Every anchor address made absolute, honouring a base element."""
    return (
        pages.withColumn("base", page_base(F.col("nodes"), F.col("url")))
        .select(
            "page_id",
            "base",
            F.posexplode(F.transform(anchors(F.col("nodes")), lambda n: attribute(n, "href"))).alias("position", "href"),
        )
        .withColumn("url", url_join(F.col("base"), F.col("href")))
        .drop("base")
    )


def _chosen(nodes: Column, selector: dict) -> Column:
    """The nodes a selector names."""

    def matches(node: Column) -> Column:
        hit = ~F.startswith(node["tag"], F.lit("#"))
        if "tag" in selector:
            hit = hit & (node["tag"] == selector["tag"])
        if "class" in selector:
            hit = hit & has_class(node, selector["class"])
        if "take" in selector:
            hit = hit & attribute(node, selector["take"]).isNotNull()
        for name, wanted in selector.get("has", {}).items():
            hit = hit & F.coalesce(attribute(node, name) == wanted, F.lit(False))
        for name, wanted in selector.get("starts", {}).items():
            hit = hit & F.coalesce(F.startswith(attribute(node, name), F.lit(wanted)), F.lit(False))
        for name, wanted in selector.get("contains", {}).items():
            hit = hit & F.coalesce(F.contains(attribute(node, name), F.lit(wanted)), F.lit(False))
        for name, wanted in selector.get("not_starts", {}).items():
            hit = hit & ~F.coalesce(F.startswith(attribute(node, name), F.lit(wanted)), F.lit(False))
        if "text_any" in selector:
            text = F.lower(text_of(subtree(nodes, node)))
            hit = hit & F.exists(
                F.array(*[F.lit(word) for word in selector["text_any"]]),
                lambda word: F.contains(text, word),
            )
        return hit

    return F.filter(nodes, matches)


def rule_links(nodes: Column, url: Column, rule: dict) -> Column:
    """The absolute links a rule finds on a page, in order and without repeats."""
    found = []
    for selector in rule["select"]:
        chosen = _chosen(nodes, selector)
        if "next_page_param" in selector:
            param = selector["next_page_param"]
            found.append(
                F.when(F.size(chosen) > 0, F.array(next_page_url(url, param))).otherwise(
                    F.array().cast("array<string>")
                )
            )
            continue
        raw = F.filter(
            F.transform(chosen, lambda n: attribute(n, selector["take"])),
            lambda link: link != "" if selector.get("non_empty") else link.isNotNull(),
        )
        base = page_base(nodes, url) if rule.get("resolve") == "base" else url
        found.append(let(base, lambda b: F.transform(raw, lambda link: url_join(b, link))))
    links = F.array_distinct(F.flatten(F.array(*found)))
    return F.filter(links, lambda link: link.isNotNull())


def discover(pages: DataFrame, rules: list[R.Rule]) -> tuple[DataFrame, DataFrame]:
    """(frontier, learning requests) of listing pages.

    pages(page_id, url, html, start_url_id, rule_id). The frontier is
    (page_id, start_url_id, kind, position, url), kind `job` or `listing`. A page whose
    host has no rule, or whose next-page address cannot be built, asks for one.
    """
    from gleanwork.operators.mapping import by_rule

    known = {i: rule for i, rule in enumerate(rules) if rule.kind == R.DISCOVERY}
    shredded = shred_pages(pages.filter(F.col("rule_id").isin(*known))) if known else None
    requests = pages.filter(~F.coalesce(F.col("rule_id").isin(*known), F.lit(False))) if known else pages
    requests = requests.select(
        F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1).alias("domain"),
        "url",
        "html",
    )
    if shredded is None:
        empty = pages.sparkSession.createDataFrame(
            [], "page_id bigint, start_url_id string, kind string, position int, url string"
        )
        return empty, requests
    none = F.array().cast("array<string>")

    def links(field: str) -> Column:
        specs = {i: rule.spec(field) for i, rule in known.items()}
        value = by_rule(specs, lambda spec, _: rule_links(F.col("nodes"), F.col("url"), spec))
        return none if value is None else F.coalesce(value, none)

    def tagged(field: str, kind: str) -> Column:
        return F.transform(
            links(field),
            lambda link, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), link.alias("link")),
        )

    frontier = shredded.select(
        "page_id",
        "start_url_id",
        F.explode(F.concat(tagged("job_links", "job"), tagged("next_links", "listing"))).alias("f"),
    ).select("page_id", "start_url_id", "f.kind", "f.position", F.col("f.link").alias("url"))
    return frontier, requests


def clean_nodes(nodes: Column) -> Column:
    """Nodes without noise subtrees and comments, inlined data and style attributes."""

    def is_blob(key: Column, value: Column) -> Column:
        data = F.startswith(F.lower(F.regexp_replace(value, r"(?U)^\s+", "")), F.lit("data:"))
        return (key == "style") | (key.isin("href", "src", "srcset") & data)

    return F.transform(
        F.filter(nodes, lambda n: ~n["noise"]),
        lambda n: n.withField("attrs", F.map_filter(n["attrs"], lambda k, v: ~is_blob(k, v))),
    )


def prune_nodes(nodes: Column) -> Column:
    """Only anchors with an address, what they contain and what contains them."""
    return F.filter(nodes, lambda n: n["linked"])


def absolute_nodes(nodes: Column, url: Column) -> Column:
    """Nodes with every anchor address resolved."""
    return let(
        page_base(nodes, url),
        lambda base: F.transform(
            nodes,
            lambda n: n.withField(
                "attrs",
                F.when(
                    (n["tag"] == "a") & attribute(n, "href").isNotNull(),
                    F.transform_values(
                        n["attrs"], lambda k, v: F.when(k == "href", F.coalesce(url_join(base, v), v)).otherwise(v)
                    ),
                ).otherwise(n["attrs"]),
            ),
        ),
    )


def clean_markup(markup: Column) -> Column:
    """The same cleaning on well-formed markup with expressions alone (no worker)."""
    for tag in sorted(htmltree.NOISE - htmltree.VOID):
        markup = F.regexp_replace(markup, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    for tag in sorted(htmltree.NOISE & htmltree.VOID):
        markup = F.regexp_replace(markup, rf"(?is)<{tag}\b[^>]*>", "")
    markup = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    markup = F.regexp_replace(markup, r"""(?i)\s(?:href|src|srcset)\s*=\s*(?:"\s*data:[^"]*"|'\s*data:[^']*')""", "")
    return F.regexp_replace(markup, r"""(?i)\sstyle\s*=\s*(?:"[^"]*"|'[^']*')""", "")


def extract_fields(nodes: Column, rule: R.Rule) -> Column:
    """The Silver fields of a detail page, as one struct; null without the panel."""
    panel_spec, title_spec = rule.spec("panel"), rule.spec("title")
    chips_spec, note, sections_spec = rule.spec("chips"), rule.spec("note"), rule.spec("sections")

    def below(node: Column) -> Column:
        return F.filter(subtree(nodes, node), lambda n: n["pre"] > node["pre"])

    def is_a(spec: dict):
        return lambda n: (n["tag"] == spec["tag"]) & (
            has_class(n, spec["class"]) if "class" in spec else F.lit(True)
        )

    def within(node: Column, outer: Column) -> Column:
        return (node["pre"] >= outer["pre"]) & (node["pre"] < outer["pre"] + outer["size"])

    def read(panel: Column) -> Column:
        inside = below(panel)
        icon = is_a(chips_spec["icon"])
        row = first(inside, is_a(chips_spec["row"]))

        def chip(name: str) -> Column:
            def led_by(node: Column) -> Column:
                lead = first(below(node), icon)
                return F.coalesce(text_of(subtree(nodes, lead)) == chips_spec[name], F.lit(False))

            return let(
                row,
                lambda r: first(
                    below(r),
                    lambda n: (n["parent"] == r["pre"]) & ~F.startswith(n["tag"], F.lit("#")) & led_by(n),
                ),
            )

        def label(node: Column) -> Column:
            icons = F.filter(subtree(nodes, node), icon)
            return text_of(
                F.filter(subtree(nodes, node), lambda n: ~F.exists(icons, lambda i: within(n, i)))
            )

        level = let(
            chip("level"),
            lambda c: let(
                first(below(c), is_a(chips_spec["level_value"])),
                lambda named: F.when(named.isNotNull(), text_of(subtree(nodes, named))).otherwise(label(c)),
            ),
        )
        marker = first(inside, lambda n: (n["tag"] == "#text") & F.contains(n["text"], F.lit(note)))
        noted = let(
            marker,
            lambda m: text_of(subtree(nodes, F.get(nodes, m["parent"])), " "),
        )
        tail = F.substring(noted, F.instr(noted, note) + len(note), F.length(noted))
        named = F.filter(
            F.transform(F.split(tail, ";"), lambda t: F.btrim(t, F.lit(" ."))), lambda t: t != ""
        )
        shown = let(
            chip("location"),
            lambda c: F.filter(
                F.transform(
                    F.filter(below(c), is_a(chips_spec["location_value"])),
                    lambda n: F.trim(F.ltrim(text_of(subtree(nodes, n)), F.lit("; "))),
                ),
                lambda t: t != "",
            ),
        )
        none = F.array().cast("array<string>")
        locations = F.when(F.size(F.coalesce(named, none)) > 0, named).otherwise(F.coalesce(shown, none))
        sections = F.filter(
            inside,
            lambda n: (n["parent"] == panel["pre"])
            & (n["tag"] == "div")
            & F.exists(below(n), lambda m: m["tag"] == sections_spec["heading"]),
        )
        notices = F.filter(
            inside,
            lambda n: (n["tag"] == "div")
            & F.exists(sections, lambda s: n["parent"] == s["pre"])
            & F.exists(below(n), icon),
        )
        prose = F.filter(
            inside,
            lambda n: F.exists(sections, lambda s: within(n, s))
            & ~F.exists(notices, lambda d: within(n, d)),
        )
        return F.struct(
            text_of(subtree(nodes, first(inside, is_a(title_spec)))).alias("title"),
            let(chip("company"), label).alias("company_name"),
            locations.alias("locations"),
            F.nullif(level, F.lit("")).alias("experience_level"),
            prose.alias("prose"),
        )

    return let(
        first(nodes, is_a(panel_spec)),
        lambda panel: F.when(panel.isNotNull(), read(panel)),
    )


def extract_pages(pages: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """pages(url, html, rule_id, ...) plus `mapped`, a struct of VARIANT Silver fields.

    `mapped` is null where no rule serves the page or the rule finds no posting on it.
    """
    from gleanwork.operators.mapping import by_rule

    known = {i: rule for i, rule in enumerate(rules) if rule.kind == R.EXTRACTION}
    read = by_rule(known, lambda rule, _: extract_fields(F.col("nodes"), rule)) if known else None
    absent = F.lit(None).cast("variant")
    if read is None:
        nothing = F.struct(*[absent.alias(f) for f in R.SILVER_FIELDS])
        return pages.withColumn("mapped", F.when(F.lit(False), nothing))
    shredded = pinned(pages, nodes=shred(F.when(F.col("rule_id").isin(*known), F.col("html"))))
    found = rendered(pinned(shredded, found=read), "description", markdown_of, F.col("found.prose"))
    level = F.col("found.experience_level")
    fields = {
        "title": F.coalesce(F.col("found.title"), F.lit("")).cast("variant"),
        "company_name": F.coalesce(F.col("found.company_name"), F.lit("")).cast("variant"),
        "employment_type": absent,
        "locations": F.col("found.locations").cast("variant"),
        "categories": F.array().cast("array<string>").cast("variant"),
        "description": F.col("description").cast("variant"),
        "metadata": F.when(
            level.isNotNull(), F.to_variant_object(F.struct(level.alias("experience_level")))
        ).otherwise(F.parse_json(F.lit("{}"))),
        "pay": absent,
    }
    mapped = F.struct(*[value.alias(name) for name, value in fields.items()])
    return found.withColumn("mapped", F.when(F.col("found").isNotNull(), mapped)).drop(
        "nodes", "found", "description"
    )
