"""Scalar column builders of the code-knowledge model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Editions in ranking order where a caller names no others; editions outside the order come last.
EDITIONS = ("community", "enterprise", "vendor", "association")
#: Risk thresholds.
RISK_HIGH, RISK_MEDIUM = 10, 4
#: Fields that every model has, with type and comodel.
MAGIC_FIELDS = (
    ("id", "integer", None),
    ("display_name", "char", None),
    ("create_uid", "many2one", "res.users"),
    ("create_date", "datetime", None),
    ("write_uid", "many2one", "res.users"),
    ("write_date", "datetime", None),
)
UNRESOLVED = "__unresolved__"
RELATIONAL = ("many2one", "one2many", "many2many")
#: Characters that one token is reckoned at.
CHARS_PER_TOKEN = 3.0


def edition_rank(edition: Column, order: Sequence[str] = EDITIONS) -> Column:
    out = F.lit(len(order))
    for rank, name in enumerate(order):
        out = F.when(edition == name, rank).otherwise(out)
    return out


def version_key(version: Column) -> Column:
    """Struct of the two numbers of ``N.M``, for numeric order; null where the shape is another."""
    parts = F.split(version, r"\.")
    return F.when(version.rlike(r"^\d+\.\d+$"), F.struct(parts[0].cast("int").alias("major"), parts[1].cast("int").alias("minor")))


def is_version(version: Column) -> Column:
    """Full match of ``N.M``; Spark's rlike isn't anchored by itself."""
    return version.rlike(r"^\d+\.\d+$")


def in_version_range(version: Column, low: Column, high: Column) -> Column:
    """low <= version <= high by number; an unset or unreadable bound is open."""
    number = lambda c: c.try_cast("double")
    return F.coalesce(number(version) >= number(low), F.lit(True)) & F.coalesce(number(version) <= number(high), F.lit(True))


def risk_level(score: Column) -> Column:
    return F.when(score >= RISK_HIGH, "HIGH").when(score >= RISK_MEDIUM, "MEDIUM").otherwise("LOW")


def token_estimate(text: Column) -> Column:
    """Tokens a text is reckoned at; a null or empty one has none."""
    return F.coalesce(F.ceil(F.length(text) / CHARS_PER_TOKEN), F.lit(0)).cast("int")


def escape_like(text: str) -> str:
    """``text`` as a literal inside a LIKE pattern with escape character backslash."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def ilike_literal(text: Column, part: str) -> Column:
    """Case-insensitive substring; ``%``, ``_`` and backslash stand for themselves."""
    return text.ilike(f"%{escape_like(part)}%")


def optional_equal(col: Column, value: object | None) -> Column:
    """No condition where the parameter isn't set."""
    return F.lit(True) if value is None else col == F.lit(value)


def not_placeholder(module: Column, unresolved: Column) -> Column:
    return ~F.coalesce(unresolved, F.lit(False)) & (module != UNRESOLVED)


def qualify_xmlid(xmlid: Column, module: Column) -> Column:
    """``module.xmlid`` where the id names no module itself."""
    return F.when(F.contains(xmlid, F.lit(".")), xmlid).otherwise(F.concat_ws(".", module, xmlid))


def l2_normalise(v: Column) -> Column:
    """``v`` over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Fixed values: (prefixes or whole names, kind, super safety, return required), first fit wins.
CONVENTIONS = (
    (("_compute_",), (), "compute", "never", False),
    (("_inverse_",), (), "inverse", "never", False),
    (("_search_",), (), "search", "never", False),
    (("_get_default_", "_default_"), (), "default", "never", False),
    (("_get_",), (), "builder", "usually", False),
    (("_prepare_",), (), "prepare", "usually", False),
    (("_check_",), (), "check", "usually", False),
    (("action_",), (), "action", "always", True),
    ((), ("create", "write", "unlink", "copy", "read"), "crud", "always", True),
    (("_",), (), "private", "usually", False),
)


def method_convention(name: Column) -> Column:
    """(kind, super_safety, return_required) by a method's name; names that nothing fits are public."""
    row = lambda kind, safety, returns: F.struct(F.lit(kind).alias("kind"), F.lit(safety).alias("super_safety"), F.lit(returns).alias("return_required"))
    out = row("public", "usually", False)
    for starts, names, *rest in reversed(CONVENTIONS):
        fits = name.isin(*names) if names else F.lit(False)
        for start in starts:
            fits = fits | name.startswith(start)
        out = F.when(fits, row(*rest)).otherwise(out)
    return out


def effective_readonly(readonly: Column, related: Column, compute: Column, inverse: Column) -> Column:
    """What is said, else whether the field is computed or related without an inverse; plain fields can be written."""
    derived = (related.isNotNull() | compute.isNotNull()) & inverse.isNull()
    return F.coalesce(readonly, derived)


#: Operators of domain terms, and the major versions in which others came.
DOMAIN_OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "=?", "=like", "=ilike", "like", "not like", "ilike", "not ilike", "in", "not in", "child_of")
DOMAIN_OPERATORS_SINCE = ((9, ("parent_of",)), (17, ("any", "not any")), (19, ("any!", "not any!", "not =like", "not =ilike")))


def is_domain_operator(operator: Column, version: Column) -> Column:
    """Whether a version knows a term operator; a version that can't be read knows all."""
    major = F.coalesce(F.split(version, r"\.")[0].try_cast("int"), F.lit(99))
    known = operator.isin(*DOMAIN_OPERATORS)
    for since, names in DOMAIN_OPERATORS_SINCE:
        known = known | (major >= since) & operator.isin(*names)
    return F.coalesce(known, F.lit(False))


def any_of(values: Column, wanted: Sequence[str]) -> Column:
    """Whether an array, null as none, holds any of the wanted values."""
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False)) if wanted else F.lit(False)


def first_of(values: Column, wanted: Sequence[str]) -> Column:
    """The array's first element that is wanted, else null."""
    return F.get(F.filter(values, lambda x: x.isin(*wanted)), 0) if wanted else F.lit(None).cast("string")


def period_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def round_half_even(x: Column, digits: int = 1) -> Column:
    return F.bround(x, digits)
