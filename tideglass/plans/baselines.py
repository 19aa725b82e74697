"""Signals against robust baselines of an account's own history."""

from pyspark.sql import functions as F

from tideglass.operators import baselines as bl
from tideglass.registry import query

BLOCK_US = 30 * 86_400_000_000


def leading_sql(x, digits=3):
    unit = f"CAST(power(10, greatest(length(CAST(abs({x}) AS VARCHAR)) - {digits}, 0)) AS BIGINT)"
    return f"CAST(sign({x}) * (abs({x}) // {unit} * {unit} + {unit} // 2) AS BIGINT)"


def baseline_sql(points, key, ts, value):
    """``points`` with n, median and deviation of the twelve blocks before each row's block, from the rows themselves."""
    return f"""pt AS (SELECT *, CAST(floor(epoch_us({ts})::DOUBLE / {BLOCK_US}) AS BIGINT) AS block, {leading_sql(value)} AS v FROM {points}),
asked AS (SELECT DISTINCT {key}, block FROM pt),
held AS (SELECT a.{key}, a.block, p.v FROM asked a LEFT JOIN pt p ON a.{key} = p.{key} AND p.block BETWEEN a.block - 12 AND a.block - 1),
mid AS (SELECT {key}, block, count(v) AS n, quantile_disc(v, 0.5) AS median FROM held GROUP BY ALL),
bse AS (SELECT m.{key}, m.block, any_value(n) AS n, any_value(median) AS median, quantile_disc(abs(v - median), 0.5) AS deviation FROM mid m JOIN held h ON m.{key} = h.{key} AND m.block = h.block GROUP BY ALL),
agn AS (SELECT pt.* EXCLUDE (v), n, median, deviation, greatest(deviation, abs(median) // 100) AS width FROM pt JOIN bse ON pt.{key} = bse.{key} AND pt.block = bse.block)"""


TRANSFERS = "tr AS (SELECT transfer_id, payer_id, beneficiary_id, event_time, CAST(amount * 100 AS BIGINT) AS cents, row_number() OVER (PARTITION BY payer_id, beneficiary_id ORDER BY event_time, transfer_id) = 1 AS new_beneficiary FROM b_transfer)"
TRANSFER_BASE = baseline_sql("tr", "payer_id", "event_time", "cents")


def transfers(t):
    return t.transfer.select("transfer_id", "payer_id", "beneficiary_id", "event_time", (F.col("amount") * 100).cast("bigint").alias("cents"))


@query("win_robust_baseline", f"WITH {TRANSFERS}, {TRANSFER_BASE} SELECT payer_id, block, n, median, deviation FROM bse")
def _(t):
    return bl.robust_baseline(transfers(t), ["payer_id"], "event_time", "cents")


@query(
    "signal_large_unusual_transfer",
    f"""WITH {TRANSFERS}, {TRANSFER_BASE} SELECT 'LARGE_UNUSUAL_TRANSFER' AS signal_type, transfer_id, payer_id, cents, median, new_beneficiary FROM agn
WHERE n >= 5 AND (100 * (cents - median) >= 519 * greatest(width, 1) OR (new_beneficiary AND 100 * (cents - median) >= 200 * greatest(width, 1)))""",
)
def _(t):
    return bl.unusual_transfers(transfers(t)).select("signal_type", "transfer_id", "payer_id", "cents", "median", "new_beneficiary")


SHARES = f"""sh AS (SELECT account_id, make_timestamp(blk * {BLOCK_US}) AS block_start, CAST(debit * 1000 // total AS BIGINT) AS debit_share FROM (
  SELECT account_id, CAST(floor(epoch_us(event_time)::DOUBLE / {BLOCK_US}) AS BIGINT) AS blk, sum(CASE WHEN cents < 0 THEN -cents ELSE 0 END) AS debit, sum(abs(cents)) AS total FROM b_movement GROUP BY ALL))"""


@query(
    "signal_debit_credit_anomaly",
    f"""WITH {SHARES}, {baseline_sql("sh", "account_id", "block_start", "debit_share")} SELECT 'DEBIT_CREDIT_PATTERN_ANOMALY' AS signal_type, account_id, block_start, debit_share, median FROM agn
WHERE n >= 4 AND 100 * abs(debit_share - median) >= 519 * greatest(width, 50)""",
)
def _(t):
    return bl.pattern_anomalies(t.movement).select("signal_type", "account_id", "block_start", "debit_share", "median")


CLOSING = """cl AS (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY day) AS balance_before FROM (
  SELECT account_id, day, CAST(sum(moved) OVER (PARTITION BY account_id ORDER BY day) AS BIGINT) AS balance FROM (SELECT account_id, date_trunc('day', event_time)::TIMESTAMP AS day, sum(cents) AS moved FROM b_movement GROUP BY ALL)))"""


@query(
    "signal_balance_drain",
    f"""WITH {CLOSING}, {baseline_sql("cl", "account_id", "day", "balance")} SELECT 'ACCOUNT_BALANCE_DRAIN' AS signal_type, account_id, day, balance, median FROM agn
WHERE n >= 5 AND median > 0 AND 100 * balance <= 20 * median AND 100 * balance_before > 20 * median""",
)
def _(t):
    return bl.balance_drains(t.movement).select("signal_type", "account_id", "day", "balance", "median")
