"""Vendor files with headers of their own, and announcements in JSON, on hand-made files."""

import hashlib
import json
import math

import pytest

from panelforge.operators import models
from panelforge.sources import announcements, files, vendor


def _put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_daily_files_with_three_header_styles_and_faults(spark, tmp_path):
    _put(tmp_path, "20240102.csv", "﻿日期,代码,开盘价,最高价,最低价,收盘价,成交量(手),成交额(千元),复权因子\n20240102,000001.sz,10,12,9,11,5,6,2\n20240103,000002.SZ,1,1,1,1,1,1,1\n20240102,000003.SZ,1,1,1,x,1,1,1\n20240102,000001.SZ,10,12,9,11,5,6,2\n")
    _put(tmp_path, "20240103.csv", 'Trade_Date,TS_Code,note,open,high,low,close,vol,amount,adj_factor\n2024-01-03,000001.SZ,"a, b",10,12,9,11,5,"6,000",2\n2024/01/03,000004.SZ,,10,12,9,,5,6,2\n2024-01-03,000005.SZ,,1,1,1,1,1,1,0\nno date,000006.SZ,,1,1,1,1,1,1,1\n')
    _put(tmp_path / "deep", "20240104.csv", "amount,vol,close,low,high,open,instrument,date,adjustment_factor\n6,5,11,9,12,10,000001.SZ,20240104,3\n\n")
    _put(tmp_path, "20240105.csv", "date,instrument,open\n20240105,000001.SZ,1\n")
    _put(tmp_path, "20240108.csv", "日期,交易日期,代码,open,high,low,close,vol,amount,adj_factor\n20240108,20240108,000001.SZ,1,1,1,1,1,1,1\n")
    _put(tmp_path, "20240109.csv", "20240109,000001.SZ,1,1,1,1,1,1,1\n")
    rows = vendor.read_daily(spark, str(tmp_path), "back_ratio").collect()
    good = {(r.instrument, str(r.session)): r for r in rows if r.reason is None}
    assert good.keys() == {("000001.SZ", f"2024-01-0{d}") for d in (2, 3, 4)}
    assert [(r.open, r.close, r.volume, r.amount) for _, r in sorted(good.items())] == [(20.0, 22.0, 500.0, 6000.0), (20.0, 22.0, 500.0, 6e6), (30.0, 33.0, 500.0, 6000.0)]
    reasons = sorted(r.reason for r in rows if r.reason)
    assert reasons == sorted(["date_differs_from_file", "bad_number", "duplicate", "missing_cell", "bad_adjustment", "bad_date", "missing_column", "ambiguous_column", "no_header"])
    assert all(r.open is None for r in rows if r.reason)
    raw = {r.instrument: r.open for r in vendor.read_daily(spark, str(tmp_path / "deep")).collect()}
    assert raw == {"000001.SZ": 10.0}
    with pytest.raises(ValueError):
        vendor.read_daily(spark, str(tmp_path), "forward")


@pytest.mark.parametrize("kind,field,wanted,effective,available", [("fund_flow", "net_inflow_amount", 10_000.0, "07:00:00", "10:00:00"), ("auction", "auction_return", 0.01, "01:25:00", "01:26:00"), ("margin", "margin_financing_buy", 1.0, "07:00:00", "10:00:00"), ("chip", "chip_win_rate", 0.01, "07:00:00", "10:00:00"), ("industry", "industry_amount", 10_000.0, "07:00:00", "10:00:00")])
def test_alternative_sources_in_base_units(spark, tmp_path, kind, field, wanted, effective, available):
    columns = [c for c, _ in vendor.FIELDS[kind].values()]
    _put(tmp_path, "20240102.csv", ",".join(["日期", "代码", "名称", *columns]) + "\n" + ",".join(["20240102", "a", "n", *["1"] * len(columns)]) + "\n" + ",".join(["20240102", "b", "n", *[""] * len(columns)]) + "\n20240103,c,n\n")
    rows = vendor.read_alternative(spark, str(tmp_path), kind).collect()
    value = {(r.instrument, r.field): r for r in rows if r.reason is None}
    assert len(value) == 2 * len(columns) and value["A", field].value == pytest.approx(wanted) and value["B", field].value is None
    assert str(value["A", field].effective_at) == f"2024-01-02 {effective}" and str(value["A", field].available_at) == f"2024-01-02 {available}"
    assert [(r.instrument, r.reason) for r in rows if r.reason] == [("C", "date_differs_from_file")]
    with pytest.raises(ValueError):
        vendor.read_alternative(spark, str(tmp_path), kind, available_clock="01:00:00")
    later = vendor.read_alternative(spark, str(tmp_path), kind, lag_days=2).where("reason IS NULL").first()
    assert str(later.available_at).startswith("2024-01-04")


def test_limit_events_merge_and_need_their_label(spark, tmp_path):
    columns = [c for c, _ in vendor.FIELDS["limit_event"].values()]
    _put(tmp_path, "20240102.csv", ",".join(["日期", "代码", "标签", *columns]) + "\n20240102,a,涨停,5,1,,3,4\n20240102,a,首板涨停,-9,2,7,1,4\n20240102,b,跌停,1,1,1,1,1\n")
    rows = {r.field: r.value for r in vendor.read_alternative(spark, str(tmp_path), "limit_event").collect()}
    assert rows == {"kpl_limit_up_flag": 1.0, "kpl_main_net_amount": -9.0, "kpl_close_seal_amount": 2.0, "kpl_turnover_amount": 7.0, "kpl_float_market_cap": 3.0, "kpl_max_seal_amount": 4.0}


ITEM = {"announcementId": "first", "title": "Example annual report", "publishTime": "2023-04-30 18:00:00", "actualPublishTime": "2023-04-30 18:00:00", "endDate": "2022-12-31 00:00:00", "announcementType": "年度报告", "announcementTypeCode": "annual", "market": "A", "stockTag": [{"code": " 000001.sz", "name": "Example"}, {"name": "Other", "code": "000002.SZ"}], "industryTag": [], "hasPdf": True}


def _found(spark, *items):
    lines = [i if isinstance(i, str) else json.dumps(i, ensure_ascii=False) for i in items]
    return announcements.classified(spark.createDataFrame([(x,) for x in lines], "value string"))


def _counts(found):
    row = announcements.ledger(found).first().asDict()
    return {k: v for k, v in row.items() if v}


def test_an_announcement_is_known_when_announced_and_published(spark):
    rows = announcements.revisions(_found(spark, {**ITEM, "actualPublishTime": "2023-05-01T09:00:00+08:00"})).collect()
    assert {r.code for r in rows} == {"000001.SZ", "000002.SZ"}
    assert {(str(r.available_at), r.time_quality, r.source_type, str(r.effective_at)) for r in rows} == {("2023-05-01 01:00:00", "actual", "periodic_report", "2022-12-31 15:59:59")}
    late = announcements.revisions(_found(spark, {**ITEM, "actualPublishTime": None})).first()
    assert str(late.available_at) == "2023-05-01 10:00:00" and late.time_quality == "nominal_plus_delay"


def test_hashes_are_those_of_canonical_json(spark):
    stable = {k: ITEM[k] for k in announcements.STABLE}
    source = hashlib.sha256(json.dumps(stable, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    row = announcements.revisions(_found(spark, ITEM)).first()
    assert row.source_hash == source
    assert row.revision_id == hashlib.sha256(f"2022-12-31|annual|2023-04-30T18:00:00+08:00|{source}".encode()).hexdigest()[:24]
    document = "AB" * 32
    with_document = {**stable, "sourceDocumentHash": document.lower()}
    row = announcements.revisions(_found(spark, {**ITEM, "sourceDocumentHash": document})).first()
    assert row.source_hash == hashlib.sha256(json.dumps(with_document, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    nominal = announcements.revisions(_found(spark, {**ITEM, "actualPublishTime": None})).first()
    assert nominal.revision_id == hashlib.sha256(f"2022-12-31|annual|None|{nominal.source_hash}".encode()).hexdigest()[:24]


def test_duplicates_quarantine_and_broken_lines(spark):
    assert _counts(_found(spark, ITEM, dict(ITEM))) == {"received": 2, "admitted": 1, "duplicate": 1}
    assert _counts(_found(spark, {**ITEM, "_pitQuarantined": True})) == {"received": 1, "quarantined": 1}
    assert _counts(_found(spark, ITEM, {**ITEM, "announcementId": "second"})) == {"received": 2, "quarantined": 2}
    document = {**ITEM, "announcementId": "second", "sourceDocumentHash": "0" * 64}
    assert _counts(_found(spark, ITEM, document)) == {"received": 2, "admitted": 1, "quarantined": 1}
    assert _counts(_found(spark, document, {**document, "announcementId": "third"})) == {"received": 2, "admitted": 1, "duplicate": 1}
    other = {**ITEM, "announcementId": "x", "title": "Notice", "announcementType": "other"}
    lacking = {k: v for k, v in ITEM.items() if k != "announcementId"}
    nobody = {**ITEM, "announcementId": "y", "stockTag": [{"code": " "}]}
    found = _counts(_found(spark, "{not json", "[1]", "", other, lacking, nobody))
    assert found == {"received": 6, "corrupt": 3, "not_periodic": 1, "incomplete": 2}
    assert _counts(_found(spark, ITEM).limit(0)) == {}


def test_revisions_supersede_in_order_of_availability(spark):
    items = [{**ITEM, "announcementId": str(i), "title": f"report {i}", "actualPublishTime": f"2023-0{m}-01 10:00:00"} for i, m in ((1, 7), (2, 5), (3, 6))]
    rows = sorted(announcements.revisions(_found(spark, *items)).where("code = '000001.SZ'").collect(), key=lambda r: r.available_at)
    assert [r.supersedes for r in rows] == [None, rows[0].revision_id, rows[1].revision_id]
    forecast = announcements.revisions(_found(spark, {**ITEM, "title": "业绩预告"})).first()
    assert forecast.source_type == "earnings_forecast" and forecast.effective_at == forecast.available_at


def test_an_interrupted_write_leaves_the_old_version(spark, tmp_path):
    members = spark.createDataFrame([("2024-01-02", i, i) for i in range(1, 61)], "session string, instrument long, place int").selectExpr("to_date(session) AS session", "instrument", "place")
    path = str(tmp_path / "u")
    with pytest.raises(ValueError):
        files.read_tiers(spark, path)
    assert files.write_tiers(members, path) == 1
    assert files.write_tiers(members.where("place = 1"), path, finish=False) == 2
    rows = files.read_tiers(spark, path).collect()
    assert len(rows) == 60 and sum(r.top10 for r in rows) == 10 and all(r.top50 for r in rows if r.top10) and sum(r.top50 for r in rows) == 50
    assert files.write_tiers(members.where("place < 4"), path) == 2
    assert files.read_tiers(spark, path).count() == 3 and files.read_tiers(spark, path, 1).count() == 60


@pytest.mark.parametrize("sharpe,spread,trials,error", [(0.2, 0.1, 10, 0.05), (0.1, 0.05, 54, 0.08), (0.05, 0.02, 2, 0.03)])
def test_deflated_sharpe_by_its_closed_form(spark, sharpe, spread, trials, error):
    """The normal distribution by the error function, its quantile by bisection."""
    below = lambda z: (1 + math.erf(z / math.sqrt(2))) / 2

    def quantile(p):
        lo, hi = -10.0, 10.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
        return lo

    best = spread * ((1 - 0.5772156649015329) * quantile(1 - 1 / trials) + 0.5772156649015329 * quantile(1 - 1 / (trials * math.e)))
    df = spark.createDataFrame([(sharpe, spread, trials, error), (sharpe, spread, 1, error)], "sharpe double, sharpe_spread double, trials long, sharpe_error double")
    found = [r.dsr for r in models.deflated_sharpe(df).orderBy("trials").collect()]
    assert found == [None, pytest.approx(below((sharpe - best) / error), abs=1e-6)]
