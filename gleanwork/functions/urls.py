"""URL functions, all native expressions (RFC 3986 handling without a Python worker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.binding import let
from gleanwork.schemas import HTML_TYPE

# scheme, authority, path, query and fragment, as RFC 3986 appendix B splits them.
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_BEFORE_QUERY = r"^([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"#(.*)$"

FILTER_PREFIX = "filter."


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)" + _FRAGMENT, 1)


def has_fragment(url: Column) -> Column:
    return F.contains(url, F.lit("#"))


def _unpaired(host: Column) -> Column:
    return F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))


def malformed(url: Column) -> Column:
    """An authority with an unpaired bracket cannot be parsed at all."""
    return _unpaired(authority(url))


def _hostname(site: Column) -> Column:
    host = F.regexp_replace(site, r"^.*@", "")
    return F.when(
        ~_unpaired(host),
        F.nullif(F.lower(F.regexp_extract(host, r"^(?:\[([^\]]*)\]|([^:\[]*))", 0)), F.lit("")),
    )


def url_hostname(url: Column) -> Column:
    """Lower-cased authority host without user info and port; null when there is none."""
    return F.regexp_replace(_hostname(authority(url)), r"[\[\]]", "")


def url_host(url: Column) -> Column:
    """The key rules are looked up by: the host, or for a scheme-less address the
    first path segment as written.
    """
    first = F.nullif(F.regexp_extract(path(url), r"^([^/]*)", 1), F.lit(""))
    return F.when(authority(url) != "", url_hostname(url)).otherwise(first)


# One step of dot removal: a leading `..`, or a plain segment and the `..` after it.
_STEP_UP = r"^/\.\.(?=/|$)|/(?!\.\.(?:/|$))[^/]*/\.\.(?=/|$)"


def _without_dots(own: Column) -> Column:
    """Resolve the `.` and `..` segments of a bound path, as many steps as it has `..`."""

    def climbed(path: Column) -> Column:
        ups = F.regexp_count(path, F.lit(r"/\.\.(?=/|$)"))
        return F.aggregate(
            F.sequence(F.lit(0), ups),
            path,
            lambda done, _: F.regexp_replace(done, _STEP_UP, ""),
        )

    rooted = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.lit("/"), own))
    plain = let(F.regexp_replace(rooted, r"/\.(?=/|$)", ""), climbed)
    # A path ending in a dot segment names a folder.
    ends_in_dots = F.endswith(own, F.lit("/.")) | F.endswith(own, F.lit("/..")) | own.isin(".", "..")
    slash = F.when(ends_in_dots, F.lit("/")).otherwise(F.lit(""))
    named = F.regexp_replace(F.concat(plain, slash), r"(?<=/)/$", "")
    return F.coalesce(F.nullif(F.when(ends_in_dots, named).otherwise(plain), F.lit("")), F.lit("/"))


def _has_dots(own: Column) -> Column:
    framed = F.concat(F.lit("/"), own, F.lit("/"))
    return F.contains(framed, F.lit("/./")) | F.contains(framed, F.lit("/../"))


def _climbed_path(base: Column, ref: Column) -> Column:
    """Base directory plus a relative path whose only dot segments are leading `..`; null
    where anything else is to be resolved.

    The common references, by string functions alone: patterns cost many times as much.
    """
    own, rest = ref["path"], ref["rest"]
    ups = ((F.length(own) - F.length(rest)) / 3).cast("int")
    left = F.greatest(base["depth"] - ups, F.lit(1))
    above = F.concat(F.call_function("substring_index", base["folder"], F.lit("/"), left), F.lit("/"))
    dotted = F.startswith(rest, F.lit(".")) | F.contains(rest, F.lit("/.")) | F.contains(own, F.lit("//"))
    return F.when(base["depth"].isNotNull() & ~dotted, F.concat(F.when(ups > 0, above).otherwise(base["folder"]), rest))


def _merged_path(folder: Column, own: Column) -> Column:
    """Base directory plus relative path, dot segments resolved.

    Everything up to the base path's last slash, then the relative path; an empty inner
    segment would turn into a doubled slash, so runs of slashes are closed up.
    """

    def tidy(path: Column) -> Column:
        closed = F.when(
            F.contains(path, F.lit("//")), F.regexp_replace(path, r"(?<=[^/])/{2,}|(?<=^)/{2,}", "/")
        ).otherwise(path)
        return let(
            closed,
            lambda p: F.when(_has_dots(p), _without_dots(p)).otherwise(p),
        )

    return let(F.concat(folder, own), tidy)


def base_parts(url: Column) -> Column:
    """What resolving against an address takes from it; compute it once per base."""

    def parts(b: Column) -> Column:
        has_site = b["site"] != ""
        front = F.concat(
            F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit(":"))).otherwise(""),
            F.when(has_site, F.concat(F.lit("//"), b["site"])).otherwise(""),
        )
        folder = F.regexp_extract(b["path"], r"^(.*/)?", 0)
        # The slashes of a folder that has no dots and no empty segments to resolve, else null.
        tidy = F.startswith(folder, F.lit("/")) & ~F.contains(folder, F.lit("/.")) & ~F.contains(folder, F.lit("//"))
        depth = F.when(tidy, F.length(folder) - F.length(F.replace(folder, F.lit("/"))))
        return F.struct(
            b["url"].alias("url"), b["scheme"].alias("scheme"), b["path"].alias("path"), b["query"].alias("query"),
            b["malformed"].alias("malformed"), has_site.alias("has_site"), front.alias("front"),
            folder.alias("folder"), depth.alias("depth"),
        )

    given = F.struct(
        url.alias("url"), scheme(url).alias("scheme"), authority(url).alias("site"), path(url).alias("path"),
        query_string(url).alias("query"), malformed(url).alias("malformed"),
    )
    return let(given, parts)


def _relative_parts(ref: Column) -> Column:
    """Path, the path behind its leading `../`, query and fragment of a reference without
    scheme and authority."""
    front = F.substring_index(ref, "#", 1)
    own = F.substring_index(front, "?", 1)
    return F.struct(
        own.alias("path"),
        F.when(F.startswith(own, F.lit("../")), F.regexp_replace(own, r"^(?:\.\./)+", "")).otherwise(own).alias("rest"),
        F.substring(front, F.length(own) + 2, F.length(front)).alias("query"),
        F.substring(ref, F.length(front) + 2, F.length(ref)).alias("fragment"),
    )


def _joined_path(base: Column, ref: Column) -> Column:
    own = ref["path"]
    return (
        F.when(own == "", base["path"])
        .when(
            F.startswith(own, F.lit("/")),
            F.when(_has_dots(own), _without_dots(own)).otherwise(own),
        )
        .otherwise(F.coalesce(_climbed_path(base, ref), _merged_path(base["folder"], own)))
    )


def _joined(base: Column, ref: Column, resolved: Column) -> Column:
    """The resolved address from the parts of both and the path they make."""
    kept_query = F.when((ref["path"] == "") & (ref["query"] == ""), base["query"]).otherwise(ref["query"])
    # Dot segments may have consumed the root.
    slash = F.when(base["has_site"] & (resolved != "") & ~F.startswith(resolved, F.lit("/")), F.lit("/"))
    return F.concat(
        base["front"],
        F.coalesce(slash, F.lit("")),
        resolved,
        F.when(kept_query != "", F.concat(F.lit("?"), kept_query)).otherwise(""),
        F.when(ref["fragment"] != "", F.concat(F.lit("#"), ref["fragment"])).otherwise(""),
    )


def _resolved(base: Column, ref: Column, joined: Column) -> Column:
    bracketed = F.contains(ref, F.lit("[")) | F.contains(ref, F.lit("]"))
    return (
        F.when(bracketed & malformed(ref), F.lit(None).cast("string"))
        .when((F.contains(ref, F.lit(":")) & ref.rlike(_SCHEME)) | (base["url"] == ""), ref)
        .when(base["malformed"], F.lit(None).cast("string"))
        .when(ref == "", base["url"])
        .when(F.startswith(ref, F.lit("//")), F.concat(base["scheme"], F.lit(":"), ref))
        .otherwise(joined)
    )


def resolve(base: Column, ref: Column) -> Column:
    """Resolve a reference against `base_parts`; null when either cannot be parsed."""
    joined = let(_relative_parts(ref), lambda r: let(_joined_path(base, r), lambda p: _joined(base, r, p)))
    return _resolved(base, ref, joined)


def resolve_column(df: DataFrame, base: str, ref: str, name: str) -> DataFrame:
    """`resolve` over columns, for one reference a row: its steps are columns of their own,
    which are compiled, whereas what is bound inside an expression is interpreted."""
    parts = df.withColumn("__ref", _relative_parts(F.col(ref)))
    parts = parts.withColumn("__path", _joined_path(F.col(base), F.col("__ref")))
    joined = _joined(F.col(base), F.col("__ref"), F.col("__path"))
    return parts.withColumn(name, _resolved(F.col(base), F.col(ref), joined)).drop("__ref", "__path")


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a reference against a base address; null when it cannot be parsed."""
    return let(base_parts(base), lambda b: resolve(b, ref))


def decode_part(text: Column) -> Column:
    """Percent and plus decoding that leaves a stray percent sign alone."""
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def encode_part(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pair_key(pair: Column) -> Column:
    return decode_part(F.element_at(F.split(pair, "=", 2), 1))


def _pair_value(pair: Column) -> Column:
    return decode_part(F.coalesce(F.get(F.split(pair, "=", 2), F.lit(1)), F.lit("")))


def query_pairs(url: Column) -> Column:
    """Decoded (key, value) pairs in order; a blank value is kept."""
    return F.transform(
        F.filter(F.split(query_string(url), "&"), lambda pair: pair != ""),
        lambda pair: F.struct(_pair_key(pair).alias("key"), _pair_value(pair).alias("value")),
    )


def grouped_pairs(pairs: Column) -> Column:
    """One (key, values) entry per key, keys and values in first-seen order."""
    keys = F.array_distinct(F.transform(pairs, lambda pair: pair["key"]))
    return F.transform(
        keys,
        lambda key: F.struct(
            key.alias("key"),
            F.transform(
                F.filter(pairs, lambda pair: pair["key"] == key), lambda pair: pair["value"]
            ).alias("values"),
        ),
    )


def strip_params(url: Column, prefix: str = FILTER_PREFIX) -> Column:
    """Drop query pairs whose decoded key starts with the prefix; keep the rest verbatim."""
    kept = F.array_join(
        F.filter(
            F.split(query_string(url), "&"),
            lambda pair: (pair != "") & ~F.startswith(_pair_key(pair), F.lit(prefix)),
        ),
        "&",
    )
    front = F.regexp_extract(url, _BEFORE_QUERY, 1)
    lowered = F.when(
        scheme(front) != "", F.concat(scheme(front), F.substring(front, F.length(scheme(front)) + 1, F.length(front)))
    ).otherwise(front)
    return F.concat(
        lowered,
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
        F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise(""),
    )


def strip_filter_params(url: Column) -> Column:
    return strip_params(url, FILTER_PREFIX)


def filter_params(url: Column) -> Column:
    """The `filter.` parameters as an array of (key, values), prefix removed."""
    wanted = F.filter(query_pairs(url), lambda pair: F.startswith(pair["key"], F.lit(FILTER_PREFIX)))
    return grouped_pairs(
        F.transform(
            wanted,
            lambda pair: F.struct(
                F.substring(pair["key"], F.lit(len(FILTER_PREFIX) + 1), F.length(pair["key"])).alias("key"),
                pair["value"].alias("value"),
            ),
        )
    )


def next_page_url(url: Column, param: str = "page") -> Column:
    """The address of the following results page; null when the page is not a number, or the last one there is."""
    groups = grouped_pairs(F.filter(query_pairs(url), lambda pair: pair["value"] != ""))
    present = F.filter(groups, lambda group: group["key"] == param)
    current = F.when(
        F.size(present) > 0,
        F.get(F.get(present, F.lit(0))["values"], F.lit(0)).try_cast("bigint"),
    ).otherwise(F.lit(1).cast("bigint"))
    after = F.try_add(current, F.lit(1))
    following = F.array(after.cast("string"))
    bumped = F.when(
        F.size(present) > 0,
        F.transform(
            groups,
            lambda group: F.struct(
                group["key"].alias("key"),
                F.when(group["key"] == param, following).otherwise(group["values"]).alias("values"),
            ),
        ),
    ).otherwise(
        F.concat(groups, F.array(F.struct(F.lit(param).alias("key"), following.alias("values"))))
    )
    encoded = F.array_join(
        F.flatten(
            F.transform(
                bumped,
                lambda group: F.transform(
                    group["values"],
                    lambda value: F.concat(encode_part(group["key"]), F.lit("="), encode_part(value)),
                ),
            )
        ),
        "&",
    )
    return F.when(
        after.isNotNull(),
        F.concat(
            F.regexp_extract(url, _BEFORE_QUERY, 1),
            F.lit("?"),
            encoded,
            F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise(""),
        ),
    )


def bare_media_type(header: Column) -> Column:
    """Media type without parameters, lower case; a missing header means HTML."""
    return F.when(header.isNull() | (header == ""), F.lit(HTML_TYPE)).otherwise(
        F.lower(F.trim(F.element_at(F.split(header, ";"), 1)))
    )


def domain_slug(domain: Column) -> Column:
    """A lower-case key safe as a partition or file name."""
    return F.btrim(F.regexp_replace(F.lower(domain), "[^a-z0-9]+", "_"), F.lit("_"))
