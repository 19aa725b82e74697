"""Explicit schemas of the wire records."""

from pyspark.sql import types as T


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STRING, LONG, DOUBLE, BOOL, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
MONEY = T.DecimalType(20, 2)

ENVELOPE = _s(
    ("eventId", STRING), ("eventType", STRING), ("eventTime", STRING), ("entityType", STRING), ("entityId", STRING),
    ("data", STRING), ("_corrupt", STRING),
)

PAYMENT_RETURNED = _s(
    ("paymentInstructionId", STRING), ("accountId", STRING), ("counterpartyId", STRING), ("facilityId", STRING),
    ("amount", MONEY), ("currency", STRING), ("returnReasonCode", STRING), ("returnReasonCategory", STRING),
    ("instrumentType", STRING), ("instructionDate", T.DateType()), ("returnDate", T.DateType()),
    ("sourceTransactionId", STRING), ("reversalOfEventId", STRING),
)

FEATURE_VALUE = _s(
    ("featureValueId", STRING), ("definitionId", STRING), ("featureName", STRING), ("definitionVersion", STRING),
    ("entityType", STRING), ("entityId", STRING), ("state", STRING), ("valueType", STRING), ("valueNumeric", STRING),
    ("knowledgeTime", STRING), ("calculatedAt", STRING), ("windowStart", STRING), ("windowEnd", STRING),
    ("qualityState", STRING), ("lineageTransformationVersion", STRING), ("priorValueNumeric", STRING),
)

# Full canonical envelope with its nested parts.
CANONICAL = _s(
    ("eventId", STRING), ("eventType", STRING), ("schemaVersion", STRING),
    ("entity", _s(("type", STRING), ("id", STRING), ("resolutionConfidence", DOUBLE))),
    ("times", _s(("eventTime", TS), ("effectiveTime", TS), ("knowledgeTime", TS), ("ingestedAt", TS))),
    ("source", _s(("system", STRING), ("recordId", STRING), ("authorityTier", STRING), ("rights", T.ArrayType(STRING)))),
    ("execution", _s(("mode", STRING), ("runId", STRING))),
    ("payload", STRING),
)

# The execution modes.
EXECUTION_MODES = ["LIVE", "RECOVERY", "REBUILD", "BACKFILL", "COUNTERFACTUAL", "AS_CORRECTED"]
