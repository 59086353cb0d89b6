"""Feature vectors, validation and sources against worked examples and hand-made edge rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from vicinity.config import MCC_RISK, Norms, read_mcc_risk, read_norms
from vicinity.functions import kernels
from vicinity.functions.features import clamp, installment_value, new_transaction_id, rounded, vectorize
from vicinity.functions.validation import split_payloads
from vicinity.schemas import PAYLOAD
from vicinity.sources import generate, payloads, references

LEGIT = {
    "id": "tx-1329056812",
    "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2331036248},
    "last_transaction": None,
}
FRAUD = {
    "id": "tx-3330991687",
    "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]},
    "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.2745933273},
    "last_transaction": None,
}


def changed(path, value, base=LEGIT):
    row = json.loads(json.dumps(base))
    group = row
    *above, name = path.split(".")
    for a in above:
        group = group[a]
    if value is KeyError:
        del group[name]
    else:
        group[name] = value
    return row


def frame(spark, *rows):
    texts = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return payloads.parse_payloads(texts)


def vectors(spark, *rows, **options):
    return [r.vector for r in vectorize(frame(spark, *rows), **options).collect()]


def test_worked_examples(spark):
    legit, fraud = vectors(spark, LEGIT, FRAUD)
    assert legit == [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]
    assert fraud == [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1, -1, 0.9523, 1.0, 0, 1, 1, 0.75, 0.0055]


def test_edges(spark):
    last = {"timestamp": "2026-03-11T18:15:53Z", "km_from_current": 2500.0}
    rows = [
        changed("customer.avg_amount", 0), changed("merchant.mcc", "0000"), changed("customer.known_merchants", None), changed("customer.known_merchants", KeyError), changed("last_transaction", KeyError),
        changed("last_transaction", last), changed("last_transaction", {**last, "timestamp": "2026-03-12T00:00:00Z"}), changed("transaction.amount", 20000.0), changed("transaction.amount", 10.5),
        changed("transaction.requested_at", "2026-03-15T23:59:59Z"),
    ]
    v = vectors(spark, *rows)
    assert v[0][2] == 1 and v[1][12] == 0.5 and v[2][11] == v[3][11] == 1 and v[4][5:7] == [-1, -1]
    assert v[5][5:7] == [0.0208, 1] and v[6][5] == 0 and v[7][0] == 1 and v[8][0] == math.floor(10.5 / 10000 * 1e4 + 0.5) / 1e4
    assert v[9][3] == v[9][4] == 1


def test_rounding_like_the_service(spark):
    (v,) = vectors(spark, LEGIT, rounding="service")
    assert v[0] == 41.12 / 10000 and v[3] == 0.7826
    with pytest.raises(ValueError):
        vectorize(frame(spark, LEGIT), rounding="none")


def test_clamp_and_rounding_keep_null_and_nan(spark):
    rows = spark.createDataFrame([(-1.0,), (0.5,), (7.0,), (None,), (float("nan"),)], "x double")
    found = [r[0] for r in rows.select(clamp(F.col("x"))).collect()]
    assert found[:4] == [0.0, 0.5, 1.0, None] and math.isnan(found[4])
    assert rows.select(rounded(F.lit(0.125), 2)).first()[0] == 0.13


def test_kernels(spark):
    row = spark.createDataFrame([([1.0, 2.0, 2.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    found = row.select(kernels.squared_distance(a, b, 3), kernels.distance(a, b, 3), kernels.dot(a, b, 3), kernels.squared_norm(a, 3), kernels.manhattan(a, b, 3), kernels.cosine_distance(a, b, 3), kernels.cosine_distance(a, z, 3)).first()
    assert list(found) == [8.0, math.sqrt(8), 1.0, 9.0, 4.0, pytest.approx(1 - 1 / 3), None]


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        ("id", " ", "id is blank"), ("transaction.amount", 0.0, "amount is not positive"), ("transaction.installments", 0, "installments below 1"), ("customer.avg_amount", -1.0, "customer average is negative"),
        ("customer.tx_count_24h", -1, "transaction count is negative"), ("merchant.id", "", "merchant id is blank"), ("merchant.mcc", None, "mcc is blank"), ("merchant.avg_amount", -0.1, "merchant average is negative"),
        ("terminal.km_from_home", -1.0, "distance from home is negative"), ("last_transaction", {"timestamp": "2026-03-11T18:15:53Z", "km_from_current": -1.0}, "last transaction's distance is negative"),
        ("transaction.requested_at", None, "requested_at is missing"), ("terminal.is_online", None, "is_online is missing"),
    ],
)
def test_rejects(spark, path, value, message):
    good, bad = split_payloads(frame(spark, LEGIT, changed(path, value), changed("customer.avg_amount", 0)))
    assert good.count() == 2 and [r.errors for r in bad.collect()] == [[message]]


def test_json_round_trip(spark, tmp_path):
    rows = frame(spark, LEGIT, FRAUD)
    rows.select(payloads.to_text(F.struct("*")).alias("value")).write.text(str(tmp_path / "p"))
    found = payloads.read_payloads(spark, str(tmp_path / "p"))
    assert sorted(found.drop("unreadable").collect(), key=str) == sorted(rows.collect(), key=str) and not any(r.unreadable for r in found.collect())
    assert rows.schema == PAYLOAD and "last_transaction_timestamp" in payloads.flat(rows).columns
    assert rows.select(installment_value().alias("v")).first().v == 20.56
    assert rows.select(new_transaction_id().alias("v")).first().v.startswith("tx-")


def test_unreadable_records_are_rejected(spark, tmp_path):
    """Neither batch nor column of texts loses them."""
    (text,) = (r.value for r in frame(spark, LEGIT).select(payloads.to_text(F.struct("*")).alias("value")).collect())
    lines = [text, '{"id": "x", "transaction": ', "no json", '{"id": "tx-1", "transaction": {"amount": "many"}}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    texts = spark.createDataFrame([(line,) for line in lines] + [(None,)], "value string")
    for rows, broken in ((payloads.read_payloads(spark, str(tmp_path / "in.json")), 3), (payloads.parse_payloads(texts, unreadable=True), 4)):
        good, bad = split_payloads(rows)
        assert good.schema == PAYLOAD and good.count() == 1
        assert [r.errors for r in bad.collect()] == [["record is not readable"]] * broken
        assert {r.unreadable for r in bad.collect()} >= set(lines[1:])


def test_positions_in_several_files(spark, tmp_path):
    for n, name in enumerate("cab"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"vector": [float(n)] * 14, "label": f"{name}{i}"} for i in range(3)]))
    found = {r.label: r.ref_id for r in references.read_reference_json(spark, str(tmp_path)).collect()}
    assert found == {f"{name}{i}": (n << 32) + i for n, name in enumerate("abc") for i in range(3)}


def test_references(spark, tmp_path):
    good = [{"vector": [0.1] * 14, "label": "FRAUD"}, {"vector": [0.2] * 14, "label": "legit"}, None]
    (tmp_path / "refs.json").write_text(json.dumps(good))
    refs = references.read_reference_json(spark, str(tmp_path / "refs.json"))
    (tmp_path / "plain.json").write_text(json.dumps(good[:2]))
    assert references.read_reference_json(spark, str(tmp_path / "plain.json")).collect() == refs.collect()
    references.write_store(refs, str(tmp_path / "store"), expected=2)
    assert [r.is_fraud for r in references.read_store(spark, str(tmp_path / "store")).orderBy("ref_id").collect()] == [True, False]
    with pytest.raises(ValueError, match="expected"):
        references.write_store(refs, str(tmp_path / "x"), expected=3)
    bad = spark.createDataFrame([(0, [0.1] * 13, "legit"), (1, [float("nan")] * 14, "legit"), (2, None, "legit"), (3, [None] * 14, None)], "ref_id long, vector array<double>, label string")
    assert [len(r.errors) for r in references.split_references(bad)[1].orderBy("ref_id").collect()] == [1, 1, 1, 2]
    with pytest.raises(ValueError, match="broken"):
        references.write_store(bad, str(tmp_path / "y"))
    with pytest.raises(ValueError, match="not a reference store"):
        bad.write.parquet(str(tmp_path / "z"))
        references.read_store(spark, str(tmp_path / "z"))
    assert references.file_checksums(spark, str(tmp_path / "refs.json")).first().sha256


def test_config_files(tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"max_amount": 1, "max_installments": 2, "amount_vs_avg_ratio": 3, "max_minutes": 4, "max_km": 5, "max_tx_count_24h": 6, "max_merchant_avg_amount": 7}))
    (tmp_path / "m.json").write_text(json.dumps(MCC_RISK))
    assert read_norms(str(tmp_path / "n.json")) == Norms(1, 2, 3, 4, 5, 6, 7) and read_mcc_risk(str(tmp_path / "m.json")) == MCC_RISK


def test_generator(spark):
    rows = generate.generate_payloads(spark, 2000, 42, 0.3)
    again = generate.generate_payloads(spark, 2000, 42, 0.3).repartition(7)
    assert sorted(rows.collect(), key=str) == sorted(again.collect(), key=str)
    good, bad = split_payloads(rows)
    assert bad.count() == 0 and good.count() == 2000
    share = {r.profile: r["count"] / 2000 for r in rows.groupBy("profile").count().collect()}
    assert abs(share["LEGIT"] - 0.7) < 0.05 and abs(share["FRAUD"] - 0.27) < 0.05 and abs(share["BORDERLINE"] - 0.03) < 0.02
    legit = rows.where("profile = 'LEGIT'").select("transaction.amount", "customer.avg_amount", "merchant.id", "customer.known_merchants", "terminal.*").collect()
    assert all(10 <= r.amount <= 500 and r.avg_amount == r.amount * 2 and r.id in r.known_merchants and not (r.is_online and r.card_present) for r in legit)
    none = rows.where("last_transaction is null").count() / 2000
    assert abs(none - 0.2) < 0.05
