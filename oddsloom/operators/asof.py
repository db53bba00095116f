"""Causal lookups: the latest fact known at a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.timeline import Timeline, latest, scan, whole_max


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    left_ts: str,
    right_ts: str,
    carry: Sequence[str],
    width: int | None,
    right_tie: Sequence[str] = (),
    tolerance: int | None = None,
    mask_after_last: bool = False,
    strict: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Attach to each left row the latest right row with `right_ts <= left_ts` of the same key.

    `strict` asks for `<`. Among right rows of one instant the highest `right_tie` wins. With
    `tolerance`, older matches are NULL. With `mask_after_last`, rows later than the key's last
    right row are NULL too. All left rows are kept. The matched time comes back as
    `<prefix><right_ts>` and the columns in `carry` as `<prefix><name>`.

    Both inputs are tagged, put on one timeline and scanned, so the work is one shuffle by
    (key, chunk) whatever the sizes and however hot a key is.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ties = [f"__tie_{i}" for i in range(len(right_tie))]
    fact = F.struct(F.col(right_ts).alias("at"), *[F.col(c) for c in carry])
    facts = right.select(
        *keys,
        F.col(right_ts).alias("__ts"),
        F.lit(1 if strict else 0).alias("__side"),
        *[F.col(c).alias(t) for c, t in zip(right_tie, ties)],
        fact.alias("__fact"),
    )
    side = 0 if strict else 1
    probes = left.select(
        *keys,
        F.col(left_ts).alias("__ts"),
        F.lit(side).alias("__side"),
        F.struct(*left.columns).alias("__row"),
    )
    both = facts.unionByName(probes, allowMissingColumns=True)
    line = Timeline.of(keys, ["__ts", "__side", *ties], width)
    outs = {"__hit": latest(F.col("__fact"))}
    if mask_after_last:
        outs["__end"] = whole_max(F.col("__fact.at"))
    seen = scan(both, line, outs).filter(F.col("__row").isNotNull())
    valid: Column = F.col("__hit").isNotNull()
    if tolerance is not None:
        valid = valid & (F.col("__ts") - F.col("__hit.at") <= F.lit(tolerance))
    if mask_after_last:
        valid = valid & (F.col("__ts") <= F.col("__end"))
    hit = F.when(valid, F.col("__hit"))
    return seen.select(
        "__row.*",
        hit["at"].alias(f"{prefix}{right_ts}"),
        *[hit[c].alias(f"{prefix}{c}") for c in carry],
    )
