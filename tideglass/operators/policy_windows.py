"""Bounded window functions inside rule conditions: count, exists, changed_by, percentage_change, age_days.

Rules name look-backs where they need them; ``compile_policies`` lifts them out, plans each distinct one once for all rules of all
policies, and hands back rows with one column per look-back and policies that name these columns. Evaluation, traces and
simulation then work as for any governed feature. Operands and conditions that this adds to those of ``policy``:

* ``{"count": NAME, "days": D, "where": CONDITION}`` as an operand: rows of the source NAME, or usable values of the feature NAME of
  the evaluated rows themselves, in [t - D, t], both ends included. ``where`` may be left out; it must not hold a window itself.
* ``{"exists": NAME, "days": D, "where": CONDITION}`` as a condition: such a count is at least one. Never unknown.
* ``{"changed_by": FEATURE, "days": D}`` as an operand: the value less the newest usable value at or before t - D. Unknown where
  either is not there.
* ``{"percentage_change": FEATURE, "days": D}``: the same as a share of the older value's size; unknown where that is zero too.
* ``{"age_days": COLUMN}``: whole days from a timestamp of the row to its time; unknown for null.

Plan: all look-backs, of all lengths, share one ordered pass over the evaluated rows stacked with their sources: one shuffle, each table read once,
cost per row independent of D and of the rows in a look-back. Hot keys are cut as in ``ordered.running``. Rows with a null key form a
key of their own; rows and source rows without a time are in no look-back (count 0, change unknown). Repeated and simultaneous source rows all
count; of simultaneous values of a feature the greatest one is the older value. Empty tables give counts of 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import VALUED_STATES
from tideglass.operators.ordered import FIND, by_heat, running
from tideglass.operators.policy import Compiler, Policy

WINDOWS = ("count", "exists", "changed_by", "percentage_change", "age_days")
LONGEST_DAYS = 3660


@dataclass(frozen=True)
class Source:
    """Observations that rules may count: their rows, the columns that match the evaluated rows' keys, and their time."""

    rows: DataFrame
    keys: tuple[str, ...]
    ts: str


@dataclass(frozen=True)
class LookBack:
    kind: str  # count, changed_by, percentage_change or age_days
    of: str
    days: int
    where: str = ""  # a condition without parameters, as JSON with sorted keys

    def column(self, position: int) -> str:
        return f"_w{position}_{self.kind}_{self.of}_{self.days}"


def _windowed(node) -> bool:
    if isinstance(node, dict):
        return any(k in node for k in WINDOWS) or any(_windowed(v) for v in node.values())
    return isinstance(node, list) and any(_windowed(v) for v in node)


def _bound(node, parameters: dict):
    """The condition with its parameters replaced by their values, so equal look-backs of two policies are one."""
    if isinstance(node, dict):
        return {"literal": parameters[node["parameter"]]} if "parameter" in node else {k: _bound(v, parameters) for k, v in node.items()}
    return [_bound(v, parameters) for v in node] if isinstance(node, list) else node


def _look_back(node: dict, parameters: dict) -> LookBack:
    kind = next(k for k in WINDOWS if k in node)
    days = node.get("days", 0)
    if kind != "age_days" and not (isinstance(days, int) and 0 < days <= LONGEST_DAYS):
        raise ValueError(f"{kind} of {node[kind]}: days must be a whole number from 1 to {LONGEST_DAYS}")
    where = node.get("where")
    if where is not None and (kind not in ("count", "exists") or _windowed(where)):
        raise ValueError(f"{kind} of {node[kind]}: a condition is for count and exists, and holds no window itself")
    text = json.dumps(_bound(where, parameters), sort_keys=True) if where is not None else ""
    return LookBack("count" if kind == "exists" else kind, node[kind], days, text)


def _lift(node, parameters: dict, seen: dict[LookBack, str]):
    """The condition with every window replaced by a feature; ``seen`` collects the look-backs and names their columns."""
    if isinstance(node, list):
        return [_lift(v, parameters, seen) for v in node]
    if not isinstance(node, dict):
        return node
    if any(k in node for k in WINDOWS):
        back = _look_back(node, parameters)
        feature = {"feature": seen.setdefault(back, back.column(len(seen)))}
        return {"left": feature, "operator": "GTE", "right": {"literal": 1}} if "exists" in node else feature
    return {k: _lift(v, parameters, seen) for k, v in node.items()}


def lift(policies: list[Policy]) -> tuple[list[Policy], dict[LookBack, str]]:
    """Policies whose conditions name plain columns, and the distinct look-backs with the column of each."""
    seen: dict[LookBack, str] = {}
    out = []
    for p in policies:
        rules = tuple(replace(r, condition=_lift(r.condition, p.parameters, seen)) if r.enabled else r for r in p.rules)
        out.append(replace(p, rules=rules))
    return out, seen


def _usable(feature: str) -> Column:
    return F.when(F.col(f"{feature}_state").isin(VALUED_STATES), F.col(feature))


def _hits(back: LookBack, own: bool) -> Column:
    """1 for a row that the look-back counts, else null."""
    held = _usable(back.of).isNotNull() if own else F.lit(True)
    if back.where:
        held = held & Compiler({}).condition(json.loads(back.where))
    return F.when(held, 1)


def _source_condition_rows(rows: DataFrame) -> DataFrame:
    """Source columns are plain facts: null is missing, anything else a value."""
    return rows.select("*", *[F.when(F.col(c).isNotNull(), "VALUE").otherwise("NOT_AVAILABLE").alias(f"{c}_state") for c in rows.columns if f"{c}_state" not in rows.columns])


def _marked(rows: DataFrame, keys, ts: str, asked: Column | None, marks: dict[str, Column], olds: dict[str, Column]) -> DataFrame:
    """Rows of one origin with the keys and the time of the pass, a mark for each look-back they can count in, and older values."""
    carried = [] if asked is None else [asked.alias("_asked")]
    return rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).cast("timestamp_ntz").alias("_t"), *carried,
        *[m.alias(n) for n, m in marks.items()], *[v.cast("double").alias(n) for n, v in olds.items()],
    )


def _one_pass(rows: DataFrame, keys: list[str], ts: str, counts: dict[LookBack, str], olds: dict[tuple[str, int], str], sources: dict[str, Source], hot: DataFrame | str | None) -> DataFrame:
    """All counts and older values of all lengths in one ordered pass over the rows stacked with their sources.

    A counted row adds 1 at its time and takes it back a microsecond after t + D; a value becomes the older value of length D at
    t + D. So each figure is a running sum or a running maximum of (time, value), and an evaluated row reads it at its own time.
    """
    own = {n: _hits(b, True) for b, n in counts.items() if b.of not in sources}
    stacked = _marked(rows, keys, ts, F.struct(*[F.col(c) for c in rows.columns]), own, {n: _usable(f) for (f, _), n in olds.items()})
    for name in sorted({b.of for b in counts if b.of in sources}):
        s = sources[name]
        marks = {n: _hits(b, False) for b, n in counts.items() if b.of == name}
        stacked = stacked.unionByName(_marked(_source_condition_rows(s.rows), s.keys, s.ts, None, marks, {}), allowMissingColumns=True)

    none = F.when(F.lit(False), F.col("_asked"))

    def step(after: Column | None, asked: Column, by: int, lengths: set[int] | None) -> Column:
        at = F.col("_t") if after is None else F.col("_t") + after
        cells = [F.when(F.lit(lengths is None or b.days in lengths), F.col(n) * by).cast("bigint").alias(n) for b, n in counts.items()]
        return F.struct(at.alias("_at"), F.lit(int(by == 0)).alias("_side"), asked.alias("_asked"), *cells, *[F.when(F.lit(False), F.col(n)).alias(n) for n in olds.values()])

    def older(days: int) -> Column:
        cells = [F.when(F.lit(d == days), F.col(n)).alias(n) for (_, d), n in olds.items()]
        return F.struct(
            (F.col("_t") + F.make_dt_interval(F.lit(days))).alias("_at"), F.lit(0).alias("_side"), none.alias("_asked"),
            *[F.lit(None).cast("bigint").alias(n) for n in counts.values()], *cells,
        )

    steps = [step(None, F.col("_asked"), 0, set())]
    if counts:
        steps.append(step(None, none, 1, None))
        steps += [step(F.make_dt_interval(F.lit(d), F.lit(0), F.lit(0), F.lit(0.000001)), none, -1, {d}) for d in sorted({b.days for b in counts})]
    steps += [older(d) for d in sorted({d for _, d in olds})]
    key = [f"_k{i}" for i in range(len(keys))]
    brought = F.coalesce(*[F.col(n).cast("double") for n in [*counts.values(), *olds.values()]]).isNotNull()
    figures = {n: ("sum", n) for n in counts.values()}
    figures |= {n: ("max", F.when(F.col(n).isNotNull(), F.struct("_at", F.col(n).alias("v")))) for n in olds.values()}
    longest = max([b.days for b in counts] + [d for _, d in olds])

    def job(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
        # Rows of usual keys are moved before they are spread into steps.
        spread = (rows.repartition(*key) if hot is None else rows).select(*key, F.inline(F.array(*steps)))
        spread = spread.filter(F.when(F.col("_side") == 1, F.col("_asked").isNotNull()).otherwise(brought & F.col("_at").isNotNull()))
        return running(spread, key, "_at", ["_side"], {f"_r{n}": how for n, how in figures.items()}, days=longest, hot=hot).filter("_side = 1")

    held = stacked.filter(F.col("_asked").isNotNull() | (F.col("_t").isNotNull() & brought))
    if isinstance(hot, DataFrame):
        hot = hot.select(*[F.col(k).alias(n) for k, n in zip(keys, key)], *[c for c in hot.columns if c not in keys])
    read = by_heat(held, key, job, hot)
    return read.select(
        "_asked.*", *[F.coalesce(f"_r{n}", F.lit(0).cast("bigint")).alias(n) for n in counts.values()], *[F.col(f"_r{n}.v").alias(n) for n in olds.values()]
    )


def _state(value: Column) -> Column:
    return F.when(value.isNull(), "NOT_AVAILABLE").when(value == 0, "ZERO").otherwise("VALUE")


def with_look_backs(rows: DataFrame, keys: list[str], ts: str, backs: dict[LookBack, str], sources: dict[str, Source] | None = None, hot: DataFrame | str | None = FIND) -> DataFrame:
    """Rows with a column and a ``_state`` for each look-back; every row stays, once. ``hot``: hot keys, where the caller knows them."""
    sources = sources or {}
    for b in backs:
        if b.kind == "count" and b.of not in sources and b.of not in rows.columns:
            raise ValueError(f"count of {b.of}: neither a source nor a feature of the rows")
    plain, out = rows.columns, rows
    counts = {b: n for b, n in backs.items() if b.kind == "count"}
    changes = {b: n for b, n in backs.items() if b.kind in ("changed_by", "percentage_change")}
    olds = {key: f"_old_{key[0]}_{key[1]}" for key in sorted({(b.of, b.days) for b in changes})}
    if counts or olds:
        out = _one_pass(rows, keys, ts, counts, olds, sources, hot)
    for b, n in changes.items():
        old = F.col(olds[b.of, b.days])
        moved = _usable(b.of).cast("double") - old
        out = out.withColumn(n, moved if b.kind == "changed_by" else F.when(old != 0, moved / F.abs(old)))
    for b, n in backs.items():
        if b.kind == "age_days":
            out = out.withColumn(n, F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(b.of).cast("timestamp"))) / 86_400_000_000))
    return out.select(*plain, *[c for n in backs.values() for c in (F.col(n), _state(F.col(n)).alias(f"{n}_state"))])


def compile_policies(
    rows: DataFrame, keys: list[str], ts: str, policies: list[Policy], sources: dict[str, Source] | None = None, hot: DataFrame | str | None = FIND
) -> tuple[DataFrame, list[Policy], dict[LookBack, str]]:
    """Rows with all look-backs of the policies, the policies over these columns, and which column holds which look-back.

    ``rows`` carry ``<feature>`` and ``<feature>_state`` for each feature that rules name. Parameters inside ``where`` take the policy's
    own values; those outside may still be overridden when the policies are evaluated.
    """
    plain, backs = lift(policies)
    return with_look_backs(rows, keys, ts, backs, sources, hot), plain, backs
