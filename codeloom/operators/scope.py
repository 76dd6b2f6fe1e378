"""Who may see a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _listed(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def visible(profile: Column, own: Sequence[str] | None, shared: Sequence[str] = ()) -> Column:
    """Admins (``own`` None) see all; others see rows with profiles, all of which they own or share.

    Without the size test an empty profile array would be visible to everyone.
    """
    if own is None:
        return F.lit(True)
    allowed = _listed(sorted({*own, *shared}))
    return F.coalesce((F.size(profile) > 0) & F.forall(profile, lambda p: F.array_contains(allowed, p)), F.lit(False))


def narrow(own: Sequence[str] | None, shared: Sequence[str], named: str | None) -> tuple[list[str] | None, list[str]]:
    """The scope that a named profile leaves: shared profiles stay, a name out of scope leaves nothing."""
    if named is None:
        return (None if own is None else list(own)), list(shared)
    if own is None or named in own or named in shared:
        return [named], list(shared)
    return [], []


def vector_visible(profile: Column, allowed: Sequence[str] | None) -> Column:
    """Filter of single-valued rows: None means all, an empty list nothing."""
    if allowed is None:
        return F.lit(True)
    return profile.isin(*allowed) if allowed else F.lit(False)


def allowed_union(own: Sequence[str] | None, shared: Sequence[str]) -> list[str] | None:
    return None if own is None else sorted({*own, *shared})
