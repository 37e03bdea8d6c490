"""Missing values filled from records of the same group, with their provenance.

Functional dependencies are mined from complete rows and verified on all of them.
Where a determinant fixes the field, its dictionary fills it; elsewhere a group of
the row gives a representative value. What neither can fill stays open.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.staging import join_bounded, materialize


@dataclass(frozen=True)
class Dependency:
    """What all complete rows say about ``determinant -> field``."""

    determinant: tuple[str, ...]
    field: str
    groups: int
    repeated_groups: int
    violations: int

    @property
    def holds(self) -> bool:
        """No group has two values, and some group repeats its value: else nothing is verified."""
        return self.repeated_groups > 0 and self.violations == 0


def dictionary(rows: DataFrame, determinant: list[str], field: str, ident: str) -> DataFrame:
    """For each determinant of the complete rows: the least and greatest value and the number of rows (two or more count as 2)."""
    whole = rows.where(F.col(field).isNotNull())
    for c in determinant:
        whole = whole.where(F.col(c).isNotNull())
    return whole.groupBy(*determinant).agg(
        F.min(field).alias("least"), F.max(field).alias("greatest"), (F.min(ident) != F.max(ident)).alias("repeated")
    )


def mine(rows: DataFrame, determinant: list[str], field: str, ident: str) -> Dependency:
    """Verify one candidate dependency on all complete rows."""
    d = dictionary(rows, determinant, field, ident)
    n, again, bad = d.agg(F.count(F.lit(1)), F.count_if("repeated"), F.count_if(F.col("least") != F.col("greatest"))).first()
    return Dependency(tuple(determinant), field, n, again, bad)


def _refuted(rows: DataFrame, tried: list[tuple[str, ...]], field: str, keep: int | None = None) -> set[tuple[str, ...]]:
    """Candidates of which ``rows`` hold a counterexample, all looked at in one pass.

    With ``keep``, one group in so many of each candidate is looked at, with all
    its rows. That no counterexample is found says nothing.
    """
    if not tried:
        return set()
    known = lambda d: F.when(F.greatest(*[F.col(c).isNull() for c in d], F.lit(False)) == F.lit(False), F.xxhash64(*d))
    each = rows.where(F.col(field).isNotNull()).select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), known(d).alias("h")) for i, d in enumerate(tried)))).alias("x"), field)
    each = each.select("x.c", "x.h", field).where("h is not null")
    if keep:
        each = each.where(F.pmod("h", F.lit(keep)) == 0)
    bad = each.groupBy("c", "h").agg((F.min(field) != F.max(field)).alias("bad")).where("bad")
    return {tried[r.c] for r in bad.select("c").distinct().collect()}


def mine_all(rows: DataFrame, field: str, ident: str, columns: list[str], most: int = 2, support: float = 0.1, probe: int = 100_000, groups: int = 64) -> list[Dependency]:
    """All minimal dependencies of ``field`` on up to ``most`` of ``columns``, verified on all complete rows.

    Every set of columns is a candidate. Those are refuted first of which any
    ``probe`` rows hold a counterexample (one is enough), then those of which one
    in ``groups`` of their groups does. What is left is verified on all rows, the
    small sets first, and supersets of a set that holds aren't looked at. A
    dependency holds if no group has two values and at least ``support`` of its groups
    repeat theirs: else nearly every group is one row and nothing is verified.
    ``probe`` and ``groups`` save work and decide nothing: a counterexample is one
    in all rows too (rows meet by 64-bit hashes), and groups, support and
    violations are counted on all rows.
    """
    found: list[Dependency] = []
    some = rows.limit(probe)
    for size in range(1, most + 1):
        tried = [c for c in combinations(columns, size) if not any(set(d.determinant) <= set(c) for d in found)]
        for sample, keep in ((some, None), (rows, groups)):
            gone = _refuted(sample, tried, field, keep)
            tried = [c for c in tried if c not in gone]
        checked = [mine(rows, list(c), field, ident) for c in tried]
        found += [d for d in checked if d.holds and d.repeated_groups >= support * d.groups]
    return found


def fill(
    rows: DataFrame,
    field: str,
    ident: str,
    candidates: Sequence[list[str] | Dependency],
    groups: list[list[str]] = (),
    representative: Column | None = None,
) -> DataFrame:
    """``rows`` with null ``field`` filled where a dependency or a group allows, and where from.

    ``candidates`` are determinants to be verified, or dependencies that ``mine_all`` has
    verified; the first that holds and knows the row fills it; ``groups`` are then tried in order, and give
    ``representative`` (an aggregate over the field; by default the greatest
    value). The result has the columns of ``rows`` and ``field_filled`` (whether
    it was filled) and ``field_source``: ``observed``, ``dependency:a,b``,
    ``group:a,b`` or ``open``. Complete rows take part in no join. Rows with a
    null in a determinant or group column aren't filled by it. A candidate with a
    violation, or one that no two rows support, isn't used. Each row must be
    there once. ``ident`` names each row.
    """
    filled, source = f"{field}_filled", f"{field}_source"
    verified = [c for c in candidates if isinstance(c, Dependency) or mine(rows, c, field, ident).holds]
    verified = [list(c.determinant) if isinstance(c, Dependency) else list(c) for c in verified]
    missing = rows.where(F.col(field).isNull())
    steps: list[tuple[str, str]] = []
    for i, d in enumerate(verified):
        found = materialize(dictionary(rows, d, field, ident).select(*d, F.col("least").alias(f"__v{i}")), "dictionary")
        missing = join_bounded(missing, found, d, "left")
        steps.append((f"__v{i}", f"dependency:{','.join(d)}"))
    for j, g in enumerate(groups):
        i = len(verified) + j
        known = rows.where(F.col(field).isNotNull())
        for c in g:
            known = known.where(F.col(c).isNotNull())
        found = materialize(known.groupBy(*g).agg((representative if representative is not None else F.max(field)).alias(f"__v{i}")), "groups")
        missing = join_bounded(missing, found, list(g), "left")
        steps.append((f"__v{i}", f"group:{','.join(g)}"))
    value, origin = F.lit(None).cast(rows.schema[field].dataType), F.lit("open")
    for name, label in reversed(steps):
        value = F.when(F.col(name).isNotNull(), F.col(name)).otherwise(value)
        origin = F.when(F.col(name).isNotNull(), F.lit(label)).otherwise(origin)
    repaired = missing.select(*(value.alias(c) if c == field else F.col(c) for c in rows.columns), (origin != "open").alias(filled), origin.alias(source))
    complete = rows.where(F.col(field).isNotNull()).select(*rows.columns, F.lit(False).alias(filled), F.lit("observed").alias(source))
    return complete.unionByName(repaired)


#: Words that stand for "not known" in key fields.
STAND_INS = ("na", "n/a", "nan", "none", "null", "nil", "unknown", "unk", "missing", "undefined", "tbd")


def real_text(column: str, stand_ins: Sequence[str] = STAND_INS) -> Column:
    """The text, or null if it is null, blank, without a letter or digit, or one of ``stand_ins``, whatever its case and the spaces around."""
    plain = F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    no = (F.regexp_replace(plain, r"[^\p{L}\p{N}]", "") == "") | plain.isin(*stand_ins)
    return F.when(no, None).otherwise(F.col(column))


def real_day(column: str, stand_ins: Sequence[int] = ()) -> Column:
    """The day's number, or null where it isn't positive or is one of ``stand_ins``. By default every positive number is a day."""
    no = F.col(column) <= 0
    return F.when((no | F.col(column).isin(*stand_ins)) if stand_ins else no, None).otherwise(F.col(column))
