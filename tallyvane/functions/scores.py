"""Score algebra on ``array<double>`` columns.

For the class counts met here (K up to ``UNROLL``) every function expands to plain
element arithmetic, which Spark compiles into the stage; higher-order functions are
interpreted and are only used beyond that width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions.normalize import literal_map

UNROLL = 16
FLOOR = 1e-12

Vector = Sequence[float] | Column


def vec(values: Vector) -> Column:
    """A parameter vector as a column: literals are constant-folded."""
    return values if isinstance(values, Column) else F.array(*[F.lit(float(v)) for v in values])


def at(values: Vector, i: int) -> Column:
    return values[i] if isinstance(values, Column) else F.lit(float(values[i]))


def fold_sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; for run-time parameters that would
    otherwise be repeated in every element."""
    return F.transform(F.array(value), body)[0]


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_map2(a: Column, b: Vector, fn, k: int) -> Column:
    if k <= UNROLL:
        return F.array(*[fn(a[i], at(b, i)) for i in range(k)])
    return F.zip_with(a, vec(b), fn)


def normalise(a: Column, k: int, floor: float | None = None) -> Column:
    """Divide by the sum; a sum that is not positive divides by one (or by ``floor``)."""
    total = fold_sum([a[i] for i in range(k)]) if k <= UNROLL else array_sum(a)
    total = F.greatest(total, F.lit(floor)) if floor else F.when(total > 0, total).otherwise(1.0)
    if k <= UNROLL:
        return F.array(*[a[i] / total for i in range(k)])
    return F.transform(a, lambda x: x / total)


def softmax(z: Column, k: int) -> Column:
    """SC1. Shifted by the row maximum, so no logit can overflow."""
    top = F.array_max(z)
    if k <= UNROLL:
        ex = [F.exp(z[i] - top) for i in range(k)]
        total = fold_sum(ex)
        return F.array(*[e / total for e in ex])
    total = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(z, lambda x: F.exp(x - top) / total)


def logsumexp(z: Column, k: int) -> Column:
    top = F.array_max(z)
    if k <= UNROLL:
        return top + F.log(fold_sum([F.exp(z[i] - top) for i in range(k)]))
    return top + F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_softmax(z: Column, k: int) -> Column:
    """SC1."""
    lse = logsumexp(z, k)
    if k <= UNROLL:
        return F.array(*[z[i] - lse for i in range(k)])
    return F.transform(z, lambda x: x - lse)


def argmax(p: Column) -> Column:
    """SC2. Index of the first largest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def max_prob(p: Column) -> Column:
    return F.array_max(p)


def max_prob_of_logits(z: Column, k: int) -> Column:
    """SC2. The largest softmax probability without the other K − 1: 1 / Σ exp(z − max)."""
    top = F.array_max(z)
    return 1.0 / fold_sum([F.exp(z[i] - top) for i in range(k)])


def nll(z: Column, y: Column, k: int) -> Column:
    """Negative log-likelihood of class ``y`` straight from logits."""
    return logsumexp(z, k) - z[y]


def nll_from_probs(p: Column, y: Column) -> Column:
    return -F.log(F.greatest(p[y], F.lit(FLOOR)))


def temperature(z: Column, k: int, per_class: Vector | None = None, scalar=None) -> Column:
    """SC5. Per-class temperatures when given, else the scalar, else unchanged.

    Column parameters may be null at run time and then fall through the same order.
    """
    one = F.lit(1.0)
    t_all = one if scalar is None else F.coalesce(scalar if isinstance(scalar, Column) else F.lit(float(scalar)), one)
    if per_class is None:
        return array_map2(z, F.array(*[t_all] * k), lambda a, t: a / t, k)
    t = F.coalesce(vec(per_class), F.array(*[t_all] * k))
    return array_map2(z, t, lambda a, b: a / b, k)


def dirichlet(z: Column, weight: Sequence[Sequence[float]] | Column, bias: Vector, k: int) -> Column:
    """SC6. weight · log_softmax(z) + bias; a weight of another shape fails the query."""
    lp = log_softmax(z, k)
    if isinstance(weight, Column):
        ok = (F.size(weight) == k) & (F.size(weight[0]) == k) & (F.size(vec(bias)) == k)
        row = lambda i: [weight[i][j] for j in range(k)]
    else:
        if len(weight) != k or any(len(r) != k for r in weight):
            raise ValueError(f"dirichlet weight must be {k} x {k}")
        ok = F.lit(True)
        row = lambda i: [F.lit(float(v)) for v in weight[i]]
    lifted = let(lp, lambda v: F.array(*[
        fold_sum([w * v[j] for j, w in enumerate(row(i))]) + at(bias, i) for i in range(k)
    ]))
    return F.when(ok, lifted).otherwise(F.raise_error(F.lit("dirichlet shape mismatch")).cast("array<double>"))


def prior_ratio(train: Vector, target: Vector, k: int) -> list[Column]:
    """target/train with both clipped at 1e-12 and renormalised; literals are folded here."""
    if not isinstance(train, Column) and not isinstance(target, Column):
        clip = lambda p: [max(float(v), FLOOR) for v in p]
        s, t = clip(train), clip(target)
        return [F.lit((b / sum(t)) / (a / sum(s))) for a, b in zip(s, t)]

    def norm(p: Vector) -> list[Column]:
        clipped = [F.greatest(at(p, i), F.lit(FLOOR)) for i in range(k)]
        total = fold_sum(clipped)
        return [c / total for c in clipped]
    return [t / s for s, t in zip(norm(train), norm(target))]


def shift_logits(z: Column, train: Vector, target: Vector, k: int) -> Column:
    """SC7. Prior shift in logit space."""
    ratio = prior_ratio(train, target, k)
    return F.array(*[z[i] + F.log(ratio[i]) for i in range(k)])


def shift_probs(p: Column, train: Vector, target: Vector, k: int) -> Column:
    """SC7. Prior shift in probability space; an all-zero row stays zero."""
    ratio = prior_ratio(train, target, k)
    if isinstance(train, Column) or isinstance(target, Column):
        moved = let(F.array(*ratio), lambda q: F.array(*[p[i] * q[i] for i in range(k)]))
        return let(moved, lambda a: normalise(a, k))
    return normalise(F.array(*[p[i] * ratio[i] for i in range(k)]), k)


def scale_probs(p: Column, scales: Vector, k: int, renormalise: bool = True) -> Column:
    """SC8."""
    scaled = array_map2(p, scales, lambda a, s: a * s, k)
    return normalise(scaled, k) if renormalise else scaled


def override_flag(p: Column, idx: int, threshold) -> Column:
    """SC9. Does the safety rule fire? A null threshold switches it off."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    return F.coalesce(p[idx] >= t, F.lit(False))


def override_pred(pred: Column, p: Column, idx: int, threshold) -> Column:
    """SC9. Force class ``idx`` where its probability reaches the threshold.

    Which probabilities to pass - raw or final - is the caller's explicit choice.
    """
    return F.when(override_flag(p, idx, threshold), F.lit(idx)).otherwise(pred).cast("int")


def ranked(p: Column, names: Sequence[str] | None = None) -> Column:
    """SRT1. Structs (class_idx, [name,] prob) by probability descending, index ascending."""
    idx = F.sequence(F.lit(0), F.size(p) - 1)
    pairs = F.zip_with(p, idx, lambda v, i: F.struct((-v).alias("neg"), i.alias("class_idx")))
    def shape(s: Column) -> Column:
        fields = [s["class_idx"].alias("class_idx")]
        if names is not None:
            fields.append(F.get(F.array(*[F.lit(n) for n in names]), s["class_idx"]).alias("class"))
        return F.struct(*fields, (-s["neg"]).alias("probability"))
    return F.transform(F.array_sort(pairs), shape)


def top_k(p: Column, n: int, names: Sequence[str] | None = None) -> Column:
    return F.slice(ranked(p, names), 1, n)


def scores_with_margin(p: Column, names: Sequence[str], thresholds: dict[str, float], default: float) -> Column:
    """SRT2. All classes, best first, each with its threshold and its margin over it."""
    table = literal_map(thresholds)
    limit = lambda c: F.coalesce(F.try_element_at(table, c), F.lit(default))
    return F.transform(
        ranked(p, names),
        lambda s: F.struct(
            s["class"].alias("classCode"),
            s["probability"].alias("probability"),
            limit(s["class"]).alias("threshold"),
            (s["probability"] - limit(s["class"])).alias("thresholdMargin"),
        ),
    )


def top_attributions(attr: Column, n: int = 6) -> Column:
    """SRT3. Map feature -> value, largest absolute value first, name as the tie-break."""
    keyed = F.transform(
        F.map_entries(attr),
        lambda e: F.struct((-F.abs(e["value"])).alias("k"), e["key"].alias("id"), e["value"].alias("value")),
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, n),
        lambda s: F.struct(
            s["id"].alias("id"),
            s["value"].alias("value"),
            F.when(s["value"] >= 0, "supports").otherwise("weakens").alias("direction"),
        ),
    )


def closest_alternatives(p: Column, pred: Column, names: Sequence[str], n: int = 2) -> Column:
    """SRT4. The best classes other than the predicted one."""
    return F.slice(F.filter(ranked(p, names), lambda s: s["class_idx"] != pred), 1, n)


def prob_map(p: Column, names: Sequence[str]) -> Column:
    """MAP1. class -> probability, best class first."""
    return F.map_from_entries(F.transform(ranked(p, names), lambda s: F.struct(s["class"], s["probability"])))


def prob_of(m: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(name)), F.lit(0.0))


def focal(p_log: Column, y: Column, k: int, gamma: float = 2.0, smoothing: float = 0.0, alpha: Vector | None = None) -> Column:
    """AGG26. Focal loss of one row from its log-probabilities.

    With smoothing s every class keeps s/K of the target mass; class weights multiply
    the per-class terms, as cross-entropy with both options does.
    """
    w = (lambda i: F.lit(1.0)) if alpha is None else (lambda i: at(alpha, i))
    hit = F.coalesce(*[F.when(y == i, w(i) * p_log[i]) for i in range(k)])
    spread = fold_sum([w(i) * p_log[i] for i in range(k)])
    ce = -(hit * (1.0 - smoothing) + spread * (smoothing / k))
    return F.pow(1.0 - F.exp(-ce), F.lit(gamma)) * ce


def ldam_logits(z: Column, y: Column, margins: Vector, k: int, s: float = 30.0) -> Column:
    """AGG26. Logits after subtracting the true class's margin, scaled by ``s``."""
    return F.array(*[s * (z[i] - F.when(y == i, at(margins, i)).otherwise(0.0)) for i in range(k)])


def bin_index(v: Column, bins: int = 15, closed: str = "left") -> Column:
    """AGG14. Zero-based equal-width bin on [0, 1].

    ``left``: [lo, hi) with the last bin closed. ``right``: (lo, hi] with the first closed.
    """
    if closed == "left":
        raw = F.floor(v * bins)
    elif closed == "right":
        raw = F.ceil(v * bins) - 1
    else:
        raise ValueError("closed must be 'left' or 'right'")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """QG7. Cosine of two equally long vectors; zero when either has no length."""
    dot = array_sum(F.zip_with(a, b, lambda x, y: x * y))
    na = F.sqrt(array_sum(F.transform(a, lambda x: x * x)))
    nb = F.sqrt(array_sum(F.transform(b, lambda x: x * x)))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """QG7. Token-set similarity; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
