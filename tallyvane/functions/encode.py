"""Fixed-width metadata vectors as native array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions.normalize import scale_age
from tallyvane.schema import META_FEATURES, META_GROUPS, SEXES, SITES


def _bit(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def meta_columns(age: Column, sex: Column, site: Column, fitz: Column) -> dict[str, Column]:
    """PRJ9. The 19 features by name. Missing is all zero, unrecognised lights 'unknown'."""
    sex_key, site_key = F.lower(F.trim(sex)), F.lower(F.trim(site))
    has_age = age.isNotNull() & (age > 0) & (age < 130)
    out = {"age_norm": F.when(has_age, age / 100.0).otherwise(0.0)}
    for s in SEXES[:-1]:
        out[f"sex_{s}"] = _bit(sex_key == s)
    out["sex_unknown"] = _bit(sex_key.isNotNull() & ~sex_key.isin(*SEXES[:-1]))
    for s in SITES[:-1]:
        out[f"site_{s}"] = _bit(site_key == s)
    out["site_unknown"] = _bit(site_key.isNotNull() & ~site_key.isin(*SITES[:-1]))
    for i in range(1, 7):
        out[f"fitz_{i}"] = _bit(fitz == i)
    return out


def meta_mask_columns(age: Column, sex: Column, site: Column, fitz: Column) -> dict[str, Column]:
    """PRJ9. Presence mask: one bit per feature, equal within a feature group."""
    present = {
        "age": age.isNotNull() & (age > 0) & (age < 130),
        "sex": sex.isNotNull(),
        "site": site.isNotNull(),
        "fitz": fitz.isNotNull() & fitz.between(1, 6),
    }
    return {
        META_FEATURES[i]: _bit(present[group])
        for group, members in META_GROUPS.items()
        for i in members
    }


def meta_vector(age: Column, sex: Column, site: Column, fitz: Column) -> Column:
    cols = meta_columns(age, sex, site, fitz)
    return F.array(*[cols[n] for n in META_FEATURES])


def meta_mask(age: Column, sex: Column, site: Column, fitz: Column) -> Column:
    cols = meta_mask_columns(age, sex, site, fitz)
    return F.array(*[cols[n] for n in META_FEATURES])


def manifest_columns(
    age: Column, sex: Column, site: Column, age_norm: float = 90.0, age_missing: float | None = 0.5
) -> dict[str, Column]:
    """PRJ7/PRJ8. The 13-feature form. Missing or unseen sex and site both fold to unknown.

    ``age_missing`` is the *scaled* value of a missing age (0.5 when serving);
    ``None`` keeps the builder's rule: raw years, missing = 0.
    """
    sex_key = F.lower(F.coalesce(sex, F.lit("unknown")))
    site_key = F.lower(F.coalesce(site, F.lit("unknown")))
    if age_missing is None:
        out = {"age_approx": F.coalesce(age, F.lit(0.0))}
    else:
        scaled = scale_age(age, age_norm, None, clip=True)
        out = {"age_approx": F.coalesce(scaled, F.lit(age_missing))}
    for s in SEXES[:-1]:
        out[f"sex_{s}"] = _bit(sex_key == s)
    out["sex_unknown"] = _bit(~sex_key.isin(*SEXES[:-1]))
    for s in SITES[:-1]:
        out[f"site_{s}"] = _bit(site_key == s)
    out["site_unknown"] = _bit(~site_key.isin(*SITES[:-1]))
    return out


def blend_absent(vec: Column, mask: Column, absent: Sequence[float] | Column, width: int) -> Column:
    """PRJ10. value·mask + absent·(1 − mask), element by element."""
    absent_at = (lambda i: absent[i]) if isinstance(absent, Column) else (lambda i: F.lit(float(absent[i])))
    return F.array(*[vec[i] * mask[i] + absent_at(i) * (1.0 - mask[i]) for i in range(width)])


def drop_mask(mask: Column, rate: float, seed: int, key: Column, width: int) -> Column:
    """PRJ10. Random mask drop, reproducible per (seed, key, position) on any partitioning."""
    def kept(i: int) -> Column:
        draw = uniform(F.lit(seed), key, F.lit(i))
        return F.when(draw < rate, 0.0).otherwise(mask[i])
    return F.array(*[kept(i) for i in range(width)])


def uniform(*parts: Column) -> Column:
    """A uniform draw in [0, 1) that depends only on its arguments.

    The top 52 bits of an md5, so a re-run or a re-computed partition repeats it.
    """
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def order_key(seed: int | str, *key: Column) -> Column:
    """Seeded pseudo-random sort key, equal in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def mask_group(vec: Column, group: str, width: int = len(META_FEATURES)) -> Column:
    """SC11. The vector (or mask) with one feature group set to zero."""
    members = set(META_GROUPS[group])
    return F.array(*[F.lit(0.0) if i in members else vec[i] for i in range(width)])
