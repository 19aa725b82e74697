"""Small pieces of ANSI SQL used in the checks."""


def uuid_sql(expr: str) -> str:
    h = f"md5({expr})"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'||"
        f"substr('89ab',CAST((strpos('0123456789abcdef',substr({h},17,1))-1)%4+1 AS INT),1)||substr({h},18,3)||'-'||substr({h},21,12))"
    )


def iso_sql(ts: str) -> str:
    return (
        f"(strftime({ts},'%Y-%m-%dT%H:%M:%S')||CASE WHEN epoch_us({ts})%1000000=0 THEN '' "
        f"WHEN epoch_us({ts})%1000=0 THEN strftime({ts},'.%g') ELSE strftime({ts},'.%f') END||'Z')"
    )


def feature_id_sql(name: str, identity: str, start: str, end: str) -> str:
    return uuid_sql(f"'{name}|'||{identity}||'|'||{iso_sql(start)}||'|'||{iso_sql(end)}")


PAYMENT_POINTS = """pts AS (
  SELECT account_id, event_time, return_count, return_value FROM (
    SELECT account_id, event_time,
      count(*) OVER w AS return_count, sum(amount) OVER w AS return_value,
      row_number() OVER (PARTITION BY account_id, event_time ORDER BY event_id) AS rn
    FROM b_payment_returned WHERE return_reason_category NOT IN ('TECHNICAL','BENEFICIARY_DETAIL')
    WINDOW w AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
  WHERE rn = 1)"""

_ID = feature_id_sql("returned_payment_count_30d", "account_id", "event_time - INTERVAL 30 DAY", "event_time")
PAYMENT_FEATURES = f"""{PAYMENT_POINTS},
feats AS (SELECT {_ID} AS feature_value_id, CAST(account_id AS VARCHAR) AS entity_id, CAST(return_count AS DOUBLE) AS value_numeric,
  event_time - INTERVAL 30 DAY AS window_start, event_time AS window_end FROM pts)"""

_DID = feature_id_sql("current_dpd", "event_id", "event_time", "event_time")
DPD_FEATURES = f"""dpdf AS (SELECT {_DID} AS feature_value_id, CAST(facility_id AS VARCHAR) AS entity_id, event_time, event_id, counterparty_id,
  reconciled AND current_dpd >= 0 AS usable, current_dpd,
  CASE WHEN NOT (reconciled AND current_dpd >= 0) THEN 'INVALID' WHEN current_dpd = 0 THEN 'ZERO' ELSE 'VALUE' END AS state
  FROM b_dpd_changed)"""


def dpd_band_sql(x: str) -> str:
    return f"(CASE WHEN {x}>=90 THEN 4 WHEN {x}>=60 THEN 3 WHEN {x}>=30 THEN 2 WHEN {x}>=1 THEN 1 ELSE 0 END)"


DPD_CROSSINGS = f"""{DPD_FEATURES},
lagged AS (SELECT *, lag(current_dpd) OVER (PARTITION BY entity_id ORDER BY event_time, feature_value_id) AS previous_dpd
  FROM dpdf WHERE usable),
crossed AS (SELECT *, CASE WHEN coalesce(previous_dpd,0) <= 0 AND current_dpd >= 1 THEN 'DPD_EMERGED'
  WHEN coalesce(previous_dpd,0) >= 1 AND {dpd_band_sql('current_dpd')} > {dpd_band_sql('previous_dpd')} THEN 'DPD_WORSENING' END AS crossing
  FROM lagged)"""

DPD_SIGNALS = f"""{DPD_CROSSINGS},
dpds AS (SELECT {uuid_sql("crossing||':'||feature_value_id")} AS signal_id, crossing AS signal_type, entity_id, event_time AS effective_at,
  CASE WHEN current_dpd>=90 THEN 'CRITICAL' WHEN current_dpd>=60 THEN 'HIGH' WHEN current_dpd>=30 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN current_dpd>=90 THEN 'CRITICAL' WHEN current_dpd>=30 THEN 'HIGH' ELSE 'MEDIUM' END AS materiality_band,
  feature_value_id, counterparty_id FROM crossed WHERE crossing IS NOT NULL)"""

PAYMENT_SIGNALS = f"""{PAYMENT_FEATURES},
pays AS (SELECT {uuid_sql('feature_value_id')} AS signal_id, 'REPEATED_PAYMENT_RETURN' AS signal_type, entity_id, window_end AS effective_at,
  'MEDIUM' AS severity, 'MEDIUM' AS materiality_band, feature_value_id FROM feats WHERE value_numeric >= 3)"""

UTILIZATION = """lims AS (SELECT facility_id, effective_at, arg_max(limit_amount, event_id) AS limit_amount FROM b_limit_changed GROUP BY ALL),
util AS (SELECT o.facility_id, o.event_id, o.effective_at, o.outstanding, l.limit_amount,
  CASE WHEN l.limit_amount > 0 THEN round(CAST(o.outstanding AS DOUBLE) / CAST(l.limit_amount AS DOUBLE), 6) END AS utilization_ratio,
  l.limit_amount - o.outstanding AS headroom,
  CASE WHEN l.limit_amount IS NULL THEN 'NOT_AVAILABLE' WHEN l.limit_amount <= 0 THEN 'INVALID' WHEN o.outstanding = 0 THEN 'ZERO' ELSE 'VALUE' END AS state
  FROM b_outstanding_changed o ASOF LEFT JOIN lims l ON o.facility_id = l.facility_id AND o.effective_at >= l.effective_at)"""

DAILY_EXCESS = f"""{UTILIZATION},
daily AS (SELECT facility_id, date_trunc('day', effective_at) AS day, max(CASE WHEN headroom < 0 THEN 1 ELSE 0 END) AS in_excess,
  max(greatest(utilization_ratio - 1, 0.0)) AS excess_ratio FROM util WHERE state IN ('VALUE','ZERO') GROUP BY ALL)"""
