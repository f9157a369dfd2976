"""Scalar expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 of a name; namespace is a UUID's text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def fingerprint(config: dict) -> str:
    """The first 16 hexadecimal digits of the hash of a canonical JSON form: a version of what shapes an index."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def glob_pattern(glob: str) -> str:
    """A regular expression for a whole path; ** crosses folders, * and ? don't."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k]))
            k += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def glob_form(glob: Column) -> Column:
    """As glob_pattern, for globs in a column."""
    out = F.regexp_replace(glob, r"([.+^$()\[\]{}|\\])", r"\\$1")
    for sign, form in (("**/", "\1"), ("**", "\2"), ("*", "[^/]*"), ("?", "[^/]"), ("\1", "(?:.*/)?"), ("\2", ".*")):
        out = F.replace(out, F.lit(sign), F.lit(form))
    return F.concat(F.lit("^"), out, F.lit("$"))


def first_paragraph(text: Column, limit: int = 300) -> Column:
    """The first paragraph that isn't a heading, cut to limit characters; empty if there is none."""
    blocks = F.transform(F.split(text, "\n\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    told = F.try_element_at(F.filter(blocks, lambda b: (b != "") & ~b.startswith("#")), F.lit(1))
    return F.coalesce(F.substring(told, 1, limit), F.lit(""))


def route(url: Column, limit: int = 256) -> Column:
    """The path of a url, or of a route with a query, without host, query and fragment; it begins with a slash."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*|^[A-Za-z][A-Za-z0-9+.-]*:(?!//)", ""), r"[?#].*$", "")
    return F.substring(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)), 1, limit)


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
