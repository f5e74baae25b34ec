"""Package names, versions, dates and addresses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """Edits over the longer name's bytes; 0 if both are empty."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


#: Characters that look alike.
LOOKALIKES = ("0o", "1l", "1i", "li", "mn", "vu", "db", "qp")


def lookalike(name: Column, other: Column) -> Column:
    """Equal length, at most two differences, one of them between characters that look alike."""
    pairs = [*LOOKALIKES, *(p[::-1] for p in LOOKALIKES)]
    a, b = F.split(name, ""), F.split(other, "")
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    glyph = F.exists(F.zip_with(a, b, lambda x, y: F.lower(F.concat(x, y)).isin(pairs)), lambda d: d)
    return (F.octet_length(name) == F.octet_length(other)) & (differ <= 2) & glyph


def technique(name: Column, top: Column) -> Column:
    """How a name imitates another, or null."""
    return (
        F.when(lookalike(name, top), F.concat(F.lit("homoglyph substitution (looks like '"), top, F.lit("')")))
        .when((F.replace(name, F.lit("-"), F.lit("")) == F.replace(top, F.lit("-"), F.lit(""))) & (name != top), F.concat(F.lit("hyphen manipulation of '"), top, F.lit("'")))
        .when(name.contains("/") & (F.substring_index(name, "/", -1) == top), F.concat(F.lit("scope-squatting of '"), top, F.lit("'")))
    )


def plugin(name: Column, top: Column) -> Column:
    """Whether a name is that of an extension of another."""
    return F.startswith(name, F.concat(top, F.lit("-"))) | F.startswith(name, F.concat(top, F.lit("."))) | (F.contains(name, F.concat(F.lit("-"), top)) & (F.octet_length(name) > F.octet_length(top) + 5))


def spec_name(spec: Column) -> Column:
    """The name in ``name``, ``name@version``, ``@scope/name`` or ``@scope/name@version``."""
    return F.regexp_extract(spec, r"^(@?[^@]*)", 1)


def spec_version(spec: Column) -> Column:
    """The version of a specifier, or null."""
    found = F.regexp_extract(spec, r"^.[^@]*@(.*)$", 1)
    return F.when(found != "", found)


def strip_range(spec: Column) -> Column:
    for sign in (r"^\^+", r"^~+", r"^(>=)+", r"^=+"):
        spec = F.regexp_replace(spec, sign, "")
    return spec


def clean_version(spec: Column) -> Column:
    """A single version out of a range, or null if it names none."""
    v = strip_range(F.btrim(spec))
    return F.when((v != "") & (v != "*") & ~v.contains("||") & ~v.contains(" "), v)


def semver(version: Column) -> Column:
    """struct(major, minor, patch), null if one is missing or no number."""
    parts = F.split(F.regexp_replace(version, "^v+", ""), r"\.")
    number = lambda x: F.when(x.rlike(r"^\+?[0-9]+$"), x).try_cast("bigint")
    major, minor, patch = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1))), number(F.substring_index(F.get(parts, F.lit(2)), "-", 1))
    return F.when(major.isNotNull() & minor.isNotNull() & patch.isNotNull(), F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch")))


def bump(old: Column, new: Column) -> Column:
    """major, minor or patch; what can't be parsed counts as patch."""
    a, b = semver(old), semver(new)
    return F.when(a["major"] != b["major"], "major").when(a["minor"] != b["minor"], "minor").otherwise("patch")


def cache_key(name: Column, version: Column) -> Column:
    return F.concat(F.replace(name, F.lit("/"), F.lit("__")), F.lit("@"), version, F.lit(".json"))


def encode_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("%2F"))


def maintainer_key(name: Column, email: Column) -> Column:
    return F.lower(F.coalesce(name, email, F.lit("unknown")))


def email_domain(email: Column) -> Column:
    """After the last @, or null."""
    return F.when(email.contains("@"), F.substring_index(email, "@", -1))


def safe_component(part: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen only, and no parent directory."""
    return part.rlike(r"^[A-Za-z0-9._-]+$") & ~part.contains("..")


def safe_ref(ref: Column) -> Column:
    return ref.rlike(r"^[A-Za-z0-9._/-]+$") & ~ref.contains("..")


def repository(url: Column) -> Column:
    """struct(owner, repo) of a repository's address: github:o/r, git@github.com:o/r, any address with
    github.com/o/r, or a bare o/r; null for others and for unsafe parts."""
    raw = F.btrim(url)
    rest = (
        F.when(raw.startswith("github:"), F.substring(raw, 8, 1 << 20))
        .when(raw.startswith("git@github.com:"), F.substring(raw, 16, 1 << 20))
        .when(raw.contains("github.com/"), F.regexp_replace(raw, r"^.*?github\.com/", ""))
        .when(raw.rlike(r"^[^/:.]+/[^/:.]+$"), raw)
    )
    parts = F.split(F.regexp_replace(F.btrim(rest), "/+$", ""), "/")
    owner, repo = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"(\.git)+$", "")
    return F.when(safe_component(owner) & safe_component(repo), F.struct(owner.alias("owner"), repo.alias("repo")))


def age_days(ts: Column, now: Column) -> Column:
    """Whole days of 24 hours from an RFC 3339 instant to ``now``, towards zero; null if unreadable."""
    at = F.try_to_timestamp(F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), ts))
    return ((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at)) / 86400).cast("long")


def rough_day(ts: Column) -> Column:
    """A day number with months of 30 days, from the first ten characters of a date; null if unreadable."""
    part = lambda a, n: F.substring(ts, a, n).try_cast("bigint")
    y, m, d = part(1, 4), part(6, 2), part(9, 2)
    div = lambda k: F.floor(y / k)
    return F.when(F.length(ts) >= 10, y * 365 + div(4) - div(100) + div(400) + m * 30 + d)


def cvss_severity(scores: Column) -> Column:
    """The severity of an array of struct(kind, score): the first entry that decides, else Medium."""

    def one(s: Column) -> Column:
        number, text, kind = s["score"].try_cast("double"), F.upper(F.coalesce(s["score"], F.lit(""))), F.upper(F.coalesce(s["kind"], F.lit("")))
        by_number = F.when(F.isnan(number), "Low").when(number >= 9, "Critical").when(number >= 7, "High").when(number >= 4, "Medium").otherwise("Low")
        by_text = F.when(text.contains("CRITICAL"), "Critical").when(text.contains("HIGH"), "High").when(text.contains("MODERATE") | text.contains("MEDIUM"), "Medium").when(kind.contains("CRITICAL"), "Critical").when(kind.contains("HIGH"), "High")
        return F.when(number.isNotNull(), by_number).otherwise(by_text)

    return F.coalesce(F.get(F.filter(F.transform(F.coalesce(scores, F.array()), one), lambda x: x.isNotNull()), F.lit(0)), F.lit("Medium"))
