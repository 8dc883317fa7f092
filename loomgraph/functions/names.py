"""Names and ids: prefixes, subject wildcards, paths, slugs and labels, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import STRIPPED


def strip_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "^(" + "|".join(STRIPPED) + "):", "")


def add_prefix(kind: str, name: Column) -> Column:
    return F.when(name.startswith(f"{kind}:"), name).otherwise(F.concat(F.lit(f"{kind}:"), name))


def has_wildcard(subject: Column) -> Column:
    return subject.rlike(r"(^|\.)\*(\.|$)") | subject.rlike(r"(^|\.)>$")


def subject_regex(subject: Column) -> Column:
    """Regular expression of the literal subjects that a pattern takes: ``*`` one token, a last ``>`` one or more."""
    tokens = F.split(subject, r"\.")
    last = F.size(tokens) - 1
    part = lambda t, i: F.when(t == "*", F.lit("[^.]+")).when((t == ">") & (i == last), F.lit(".+")).otherwise(F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    return F.concat(F.lit("^"), F.array_join(F.transform(tokens, part), r"\."), F.lit("$"))


def _filled(subject: Column) -> Column:
    tokens = F.split(subject, r"\.")
    last = F.size(tokens) - 1
    return F.array_join(F.transform(tokens, lambda t, i: F.when((t == "*") | ((t == ">") & (i == last)), F.lit("_x_")).otherwise(t)), ".")


def subject_matches(a: Column, b: Column) -> Column:
    """Whether two subjects meet. Either may be a pattern; of two patterns one must take the other with its wildcards filled in."""
    wild_a, wild_b = has_wildcard(a), has_wildcard(b)
    takes = lambda pattern, literal: F.regexp_like(literal, subject_regex(pattern))
    return (a == b) | F.when(wild_a & wild_b, takes(a, _filled(b)) | takes(b, _filled(a))).when(wild_a, takes(a, b)).when(wild_b, takes(b, a)).otherwise(False)


def join_path(prefix: Column, path: Column) -> Column:
    """``/prefix/path`` with single slashes and none at the end; ``/`` for nothing."""
    whole = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(prefix, F.lit("")), F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")
    cut = F.regexp_replace(whole, "/$", "")
    return F.when(cut == "", "/").otherwise(cut)


def base_slug(heading: Column) -> Column:
    """Lower-case letters and digits with single hyphens for blanks; other characters go, and ``section`` stands for nothing."""
    kept = F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}\x20-]", "")
    slug = F.trim(F.regexp_replace(kept, "[ -]+", "-"), F.lit("-"))
    return F.when(slug == "", "section").otherwise(slug)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def package_name(specifier: Column) -> Column:
    """First path segment of an import specifier, or the first two of a scoped one."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def route_of(path: Column) -> Column:
    """Pattern of a url path: numbers and ids become ``:id``, no trailing slash or extension."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/+$", "")
    out = F.regexp_replace(F.regexp_replace(bare, "/[0-9]+(?=/|$)", "/:id"), "/[0-9a-f]{8}-[0-9a-f-]{27}(?=/|$)", "/:id")
    return F.when(out == "", "/").otherwise(out)


def page_route(file: Column, root: Column) -> Column:
    """Route of a front-end file under a pages or app root; null if the file is no page.

    Pages router: the path without extension and ``/index``; ``_`` and ``api`` files are none.
    App router: the folder of a ``page`` file without ``(groups)``; parallel (``@``) and
    intercepting (``(.)``) folders are none. ``[x]`` becomes ``:x``, ``[...x]`` ``*x`` and ``[[...x]]`` ``*x?``.
    """
    inside = F.when(file.startswith(F.concat(root, F.lit("/"))), F.substring(file, F.length(root) + 2, F.length(file)))
    bare = F.regexp_replace(inside, r"\.(tsx|jsx|ts|js)$", "")
    app = F.regexp_extract(root, "(^|/)app$", 0) != ""
    folder = F.when(bare == "page", "").when(bare.endswith("/page"), F.regexp_replace(bare, "/page$", ""))
    folder = F.when(folder.rlike(r"(^|/)(@|\(\.+\))"), F.lit(None)).otherwise(folder)
    folder = F.regexp_replace(F.regexp_replace(folder, r"(^|/)\([^)/]+\)(?=/|$)", ""), "^/+", "")
    page = F.when(~bare.rlike("(^|/)_|^api(/|$)"), F.regexp_replace(bare, "(^|/)index$", ""))
    route = F.when(app, folder).otherwise(page)
    route = F.regexp_replace(route, r"\[\[\.\.\.([^\]]+)\]\]", "*$1?")
    route = F.regexp_replace(route, r"\[\.\.\.([^\]]+)\]", "*$1")
    route = F.regexp_replace(route, r"\[([^\]]+)\]", ":$1")
    return F.concat(F.lit("/"), route)


def escape_label(label: Column) -> Column:
    steps = [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, label)


def host_of(url: Column) -> Column:
    """Host of a url without port and user; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))
