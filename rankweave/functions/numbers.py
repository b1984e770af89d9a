"""Vector and score arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, BASELINE, SOFT_STEP = 60, 0.65, 0.05


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(a: Column, dim: int | None = None) -> Column:
    """True for vectors that are finite, not zero and, if a dimension is given, of that length."""
    ok = a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0)
    return F.coalesce(ok & (F.size(a) == dim) if dim else ok, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Null where lengths differ or a vector is not usable."""
    return F.when(usable(a) & usable(b) & (F.size(a) == F.size(b)), dot(a, b) / (norm(a) * norm(b)))


def semantic_score(distance: Column) -> Column:
    """1 - distance, rescaled so that BASELINE is 0; null distances score 0."""
    c = 1 - distance
    return F.when(distance.isNull() | F.isnan(distance) | (c <= BASELINE), 0.0).otherwise(F.least(F.lit(1.0), (c - BASELINE) / (1 - BASELINE)))


def rrf_normalized(raw: Column, lists: int = 2) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / (lists / (RRF_K + 1))))


def skill_penalty(score: Column, wanted: Column, owned: Column, coverage: Column) -> Column:
    """Scores of rows that have none of the wanted skills are cut down and capped."""
    return F.when(F.size(wanted) == 0, score).when(F.size(owned) == 0, F.least(score * 0.1, F.lit(0.08))).when(coverage == 0, F.least(score * 0.2, F.lit(0.15))).otherwise(score)


def coverage(wanted: Column, owned: Column) -> Column:
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, owned)) / F.size(F.array_distinct(wanted)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def constraint_status(confirmed: Column, evidence: Column, excluded: Column, must: Column, verified: Column) -> Column:
    """ungated, unknown, fail or pass; must is a list of groups of which one skill each is asked for."""
    met = F.forall(must, lambda g: (F.size(g) == 0) | F.arrays_overlap(g, verified))
    return F.when(~confirmed, "ungated").when(~evidence, "unknown").when(F.size(F.array_intersect(excluded, verified)) > 0, "fail").when(met, "pass").otherwise("fail")


#: The order of groups in a rerank window and in the check of ranked output, and the order of ranking, where rows that nothing gates equal those that pass.
STATUS_ORDER = {"pass": 0, "ungated": 1, "unknown": 2, "fail": 3}
PARTITION_ORDER = {"pass": 0, "ungated": 0, "unknown": 1, "fail": 2}


def status_rank(status: Column) -> Column:
    return reduce(lambda c, p: c.when(status == p[0], p[1]), STATUS_ORDER.items(), F.when(F.lit(False), -1)).otherwise(9)


def partition_rank(status: Column) -> Column:
    return reduce(lambda c, p: c.when(status == p[0], p[1]), PARTITION_ORDER.items(), F.when(F.lit(False), -1)).otherwise(0)


def steps(score: Column, bands: list[tuple[float, float]], rest: float) -> Column:
    """The value of the first band whose lower bound the score reaches."""
    return reduce(lambda c, b: c.when(score >= b[0], b[1]), bands, F.when(F.lit(False), 0.0)).otherwise(rest)


#: A score's percentile by its lower bound.
PERCENTILES = [(90, 95.0), (80, 85.0), (70, 70.0), (60, 50.0), (50, 30.0)]


def timeline_flags(claimed: Column, shown: Column, projects: Column, graduated: Column, as_of: Column, boasts: Column) -> dict[str, Column]:
    """Flags of a profile's years: `conflict` with the year of graduation (two years before it are allowed), `evidence` (no project at
    all, or far fewer years shown than claimed), and `boasts`, the number of boasting phrases of one who shows less than three years."""
    conflict = F.coalesce(claimed > F.greatest(as_of - graduated, F.lit(0)) + 2, F.lit(False))
    evidence = (projects == 0) | ((claimed >= 5) & (shown < 1.0)) | ((claimed >= 3) & (shown * 2.5 < claimed))
    return {"conflict": conflict, "evidence": evidence, "boasts": F.when(shown < 3.0, boasts).otherwise(0)}


def trust(skills: Column, ghosts: Column, claimed: Column, shown: Column, anachronisms: Column, depth: Column, conflict: Column, flags: Column) -> dict[str, Column]:
    """trust_score, trust_status and penalty of a profile's claims; flags: how many timeline flags there are beside the conflict."""
    ghost = ghosts / F.greatest(skills, F.lit(1))
    gap = F.when(claimed >= 3, F.greatest((claimed - shown) / claimed, F.lit(0.0))).otherwise(0.0)
    hollow = (claimed >= 5) & (depth < 40)
    score = (
        1.0 - F.when(conflict, 0.25).otherwise(0.0) - F.when(ghost > 0.5, ghost * 0.35).when(ghost > 0.3, ghost * 0.15).otherwise(0.0)
        - F.when(gap > 0.6, 0.35).when(gap > 0.3, 0.15).otherwise(0.0) - F.least(anachronisms, F.lit(3)) * 0.25 - F.when(hollow, 0.25).otherwise(0.0)
    )
    score = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.round(score, 2)))
    every = flags + anachronisms + conflict.cast("int") + (ghost > 0.5).cast("int") + hollow.cast("int")
    status = F.when((score < 0.45) | (every >= 2) | (anachronisms > 0), "HIGH_INFLATION_RISK").when((score < 0.75) | (every >= 1), "QUESTIONABLE").otherwise("VERIFIED")
    penalty = F.when(status == "HIGH_INFLATION_RISK", (1 - score) * 0.75).when(status == "QUESTIONABLE", (1 - score) * 0.4).otherwise(0.0)
    return {"trust_score": score, "trust_status": status, "penalty": F.round(penalty, 2)}
