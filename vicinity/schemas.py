"""Declared schemas of payloads, references and results."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I, _B, _T = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

PAYLOAD = _struct(
    id=_S,
    transaction=_struct(amount=_D, installments=_I, requested_at=_T),
    customer=_struct(avg_amount=_D, tx_count_24h=_I, known_merchants=T.ArrayType(_S)),
    merchant=_struct(id=_S, mcc=_S, avg_amount=_D),
    terminal=_struct(is_online=_B, card_present=_B, km_from_home=_D),
    last_transaction=_struct(timestamp=_T, km_from_current=_D),
)
REFERENCE_JSON = _struct(vector=T.ArrayType(_D), label=_S)
TEST_ENTRY = _struct(request=PAYLOAD, expected_approved=_B, expected_fraud_score=_D)
