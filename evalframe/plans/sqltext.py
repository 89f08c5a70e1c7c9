"""Pieces of oracle SQL shared by many queries (DuckDB dialect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def r(expression: str) -> str:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {DIGITS}) + 0::double)"


def rounded(df: DataFrame) -> DataFrame:
    """The same on the Spark side, for every double column."""
    return df.select(
        *[
            (F.round(F.col(f"`{name}`"), DIGITS) + F.lit(0.0)).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def scores(name: str, source: str, keys: list[str], y: str, p: str, single_class: str = "'NaN'::double") -> str:
    """CTEs ending in ``name``: all binary metrics per group.

    The isotonic fit is f_i = max over lo<=i of min over hi>=i of mean(lo..hi)
    on the histogram of distinct probabilities.
    """
    k = ", ".join(keys)
    on = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    of = lambda a: ", ".join(f"{a}.{c}" for c in keys)
    return f"""{name}_h as (select {k}, p, sum(y) as pos, cast(count(*) as double) as n,
      cast(row_number() over (partition by {k} order by p) as int) as i
      from (select {k}, cast({y} as double) as y, cast({p} as double) as p from {source}) where y is not null and p is not null group by {k}, p),
    {name}_c as (select *, sum(pos) over (partition by {k} order by i) as cp, sum(n) over (partition by {k} order by i) as cn from {name}_h),
    {name}_m as (select {of('lo')}, lo.i as lo, hi.i as hi, (hi.cp - lo.cp + lo.pos) / (hi.cn - lo.cn + lo.n) as m
      from {name}_c lo join {name}_c hi on {on('lo', 'hi')} and lo.i <= hi.i),
    {name}_x as (select {of('t')}, t.i, m.lo, min(m.m) as mn from {name}_c t join {name}_m m on {on('t', 'm')} and m.lo <= t.i and m.hi >= t.i
      group by {of('t')}, t.i, m.lo),
    {name}_f as (select {k}, i, max(mn) as f from {name}_x group by {k}, i),
    {name}_s as (select {of('c')}, sum(c.n) as n, sum(c.pos) as pos, sum(case when c.p > 0.5 then c.pos else 0 end) as tp,
      sum(case when c.p > 0.5 then c.n else 0 end) as pp, sum(c.pos*(1-c.p)*(1-c.p) + (c.n-c.pos)*c.p*c.p) as sq,
      sum(c.pos * ((c.cn - c.n) - (c.cp - c.pos) + (c.n - c.pos)/2)) as u,
      sum(c.pos*(1-f.f)*(1-f.f) + (c.n-c.pos)*f.f*f.f) as iso
      from {name}_c c join {name}_f f on {on('c', 'f')} and c.i = f.i group by {of('c')}),
    {name} as (select {k}, (n - pos - pp + 2*tp)/n as accuracy,
      case when pp > 0 then tp/pp else 0 end as precision, case when pos > 0 then tp/pos else 0 end as recall,
      case when pp + pos > 0 then 2*tp/(pp+pos) else 0 end as f1,
      case when pos > 0 and n > pos then u/(pos*(n-pos)) else {single_class} end as roc_auc,
      sq/n as bs, (sq-iso)/n as bs_mcb, (pos/n)*(1-pos/n) - iso/n as bs_dsc, (pos/n)*(1-pos/n) as bs_unc,
      (coalesce(tp/nullif(pos,0), 0) + coalesce((n-pos-pp+tp)/nullif(n-pos,0), 0)) / (case when pos > 0 and n > pos then 2.0 else 1.0 end) as balanced_accuracy,
      cast(n as bigint) as n, cast(pos as bigint) as pos from {name}_s)"""


ALL_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "bs", "bs_mcb", "bs_dsc", "bs_unc", "balanced_accuracy"]


def rounded_metrics(names: list[str] = ALL_METRICS, alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return ", ".join(f"{r(dot + m)} as {m}" for m in names)


def md5_rank_split(name: str, source: str, group: list[str], key: str, take: str, seed: int = 42) -> str:
    """CTE ``name``: ``source`` with ``drawn`` for the first ``take`` rows (over n) by md5(seed|key)."""
    part = f"partition by {', '.join(group)}" if group else ""
    return f"""{name} as (select *, rn <= {take} as drawn from (select *, row_number() over ({part} order by md5(concat_ws('|', '{seed}', {key}))) as rn,
      count(*) over ({part}) as n_group from {source}))"""


def train_size(test_fraction: float) -> str:
    return f"round_even((1 - {test_fraction}::double) * n_group, 0)"


# the mean of 1 / targets, summed as decimals so that it doesn't depend on the order of rows
CHANCE = "(cast(round(sum(cast(1.0::double / n_targets as decimal(38, 18))), 9) as double) / count(n_targets))"
