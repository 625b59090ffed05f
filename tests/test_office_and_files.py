import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from incidentkit.plans import back_office as B
from incidentkit.sources import direct_debit as X, files as S

DHO16, DHO14 = B.JUDGED_SIZES


def test_catalog_rules(spark):
    cat = [
        ("laan", "Betula nova Red Velvet", DHO16, 90.0, 1), ("laan", "Betula nova Red Velvet", "20-25", 120.0, 2),
        ("laan", "Betula nova Northwind", DHO16, 90.0, 3), ("laan", "Betula nova Southwind", "20-25", 500.0, 4),
        ("laan", "Fagus nova Highway", DHO14, 50.0, 5), ("laan", "Alnus recta X", "20-25", 70.0, 6),
        ("laan", "Sorbus fictiva", DHO16, 10.0, 7),
    ]
    catalog = spark.createDataFrame(cat, "group string, latin_name string, size_code string, price double, row_no int")
    names = spark.createDataFrame(
        [
            ("laan", "Betula nova Even Rounds", 1), ("laan", "Fagus nova Y", 2), ("laan", "Alnus recta Z", 3), ("fruit", "Pyrus 'Harbour Light'", 4),
            ("fruit", "Sorbus  Fictiva", 5), ("laan", "Nieuw soort A", 6), ("laan", "Fagus nova y", 7),
        ],
        "group string, latin_name string, row_no int",
    )
    out = B.extend_catalog(names, catalog).collect()
    added = [r for r in out if (r.latin_name, r.size_code) not in {(c[1], c[2]) for c in cat}]
    assert {(r.size_code, r.price, r.control) for r in added if r.latin_name == "Betula nova Even Rounds"} == {
        (DHO16, 90.0, "Betula nova Red Velvet"), ("20-25", 120.0, "Betula nova Red Velvet")}
    assert [(r.size_code, r.price) for r in added if r.latin_name.lower() == "fagus nova y"] == [(DHO14, 50.0)]
    for name in ("Alnus recta Z", "Pyrus 'Harbour Light'", "Nieuw soort A"):
        rows = [r for r in added if r.latin_name == name]
        assert sorted(r.size_code for r in rows) == sorted(B.STANDARD_SIZES) and all(r.price is None and r.control is None for r in rows)
    assert not any("Fictiva" in r.latin_name for r in added)
    assert [(r.group, r.latin_name, r.size_code) for r in out] == sorted((r.group, r.latin_name, r.size_code) for r in out)


def test_tvt_signs(spark):
    schema = "person int, s decimal(10,2), t decimal(10,2), u decimal(10,2)"
    new = spark.createDataFrame([(1, Decimal("5"), None, Decimal("1")), (2, Decimal("1"), Decimal("1"), None), (3, Decimal("2"), None, None)], schema)
    old = spark.createDataFrame([(1, Decimal("2"), None, None), (2, Decimal("4"), None, None), (3, Decimal("2"), None, None), (4, Decimal("8"), None, None)], schema)
    got = {r.person: (r.factor, float(r.units), r.kind) for r in B.tvt_export(new, old, ["person"], ["s", "t", "u"], 2021).collect()}
    assert got == {1: (1, 4.0, 10), 2: (-1, 2.0, 10), 4: (-1, 8.0, 10)}


def test_leave_weeks(spark):
    leave = spark.createDataFrame([(1, dt.date(2020, 7, 3), dt.date(2020, 7, 7), 8)], "person int, start date, end date, hours int")
    staff = spark.createDataFrame([(1,), (2,)], "person int")
    got = [(r.person, r.start, r.end, r.units) for r in B.leave_export(leave, ["person"], staff).orderBy("person", "start").collect()]
    assert got == [(1, dt.date(2020, 6, 29), dt.date(2020, 7, 3), 8), (1, dt.date(2020, 7, 6), dt.date(2020, 7, 10), 16), (2, None, None, 0)]


def test_export_diff(spark):
    got = spark.createDataFrame([(1, 1.0), (2, 0.0299), (3, None)], "k int, units double")
    wanted = spark.createDataFrame([(2, 0.03), (3, None), (4, 2.0)], "k int, units double")
    assert {(r.k, r.status, r.fields) for r in B.export_diff(got, wanted, ["k"], ["units"]).collect()} == {(1, "extra", None), (2, "changed", "units"), (4, "missing", None)}


def test_dutch_csv(spark, tmp_path):
    path = tmp_path / "leave.csv"
    path.write_text(
        "WerkgeverId;PersnrVerl;Persnr;Naam;Ingangsdatum;Einddatum;Soort;Factor;Eenheden\n"
        "90001;1;5001;Testpersoon A.;6-7-2020;10-7-2020;15;-1;38\n"
        "90001;2;5002;Testpersoon B.;1-1-2020;31-12-2020;10;1;1,25000000000001E-02;\n"
        ";;;;;;;;\n90001;3;5003;Testpersoon C.;;;15;-1;0\n",
        encoding="utf-8",
    )
    rows = S.read_dutch_csv(spark, str(path)).orderBy("leave_person_no").collect()
    assert [r.units for r in rows] == [38.0, 1.25000000000001e-02, 0.0]
    assert rows[0].start == dt.date(2020, 7, 6) and rows[2].start is None and rows[1].name == "Testpersoon B."


def test_direct_debits(spark, tmp_path):
    tx = "".join(
        f"""<DrctDbtTxInf><PmtId><EndToEndId>T-{i}</EndToEndId></PmtId><InstdAmt Ccy="EUR">{a}</InstdAmt><DrctDbtTx><MndtRltdInf><MndtId>M-{i % 2}</MndtId>
        <DtOfSgntr>2015-02-03</DtOfSgntr></MndtRltdInf></DrctDbtTx><DbtrAgt><FinInstnId><BIC>BANKNL2A</BIC></FinInstnId></DbtrAgt><Dbtr><Nm>Test {i}</Nm><PstlAdr><AdrLine>Straat 1</AdrLine>
        <AdrLine>Stad</AdrLine></PstlAdr></Dbtr><DbtrAcct><Id><IBAN>X{i}</IBAN></Id></DbtrAcct><RmtInf><Ustrd>Adv-W0{7 + i % 2}-Fact-2033 77{i}</Ustrd></RmtInf></DrctDbtTxInf>"""
        for i, a in enumerate(["10.02", "20.00", "5.02"])
    )
    path = tmp_path / "debits.xml"
    path.write_text(
        f"""<?xml version="1.0" encoding="UTF-8"?><Document xmlns="urn:iso:std:iso:20022:tech:xsd:pain.008.001.02"><CstmrDrctDbtInitn>
        <GrpHdr><MsgId>A1</MsgId><CreDtTm>2033-04-05T06:07:08</CreDtTm><NbOfTxs>3</NbOfTxs><CtrlSum>35.00</CtrlSum></GrpHdr>
        <PmtInf><PmtInfId>B1</PmtInfId><NbOfTxs>3</NbOfTxs><CtrlSum>35.00</CtrlSum><ReqdColltnDt>2033-04-09</ReqdColltnDt>{tx}</PmtInf></CstmrDrctDbtInitn></Document>"""
    )
    rows = X.read_direct_debits(spark, str(path))
    first = rows.where("end_to_end_id = 'T-0'").first()
    assert first.amount == Decimal("10.02") and first.currency == "EUR" and first.address == ["Straat 1", "Stad"] and first.signed_on == dt.date(2015, 2, 3)
    check = B.reconcile_debits(rows, X.read_dd_header(spark, str(path))).first()
    assert (check.counted, check.count_gap, check.sum_gap) == (3, 0, Decimal("0.04"))
    assert X.read_dd_batch(spark, str(path)).first().collect_on == dt.date(2033, 4, 9)
    weeks = {(r.mandate_id, r.week): float(r.amount) for r in B.debits_per_mandate(rows).collect()}
    assert weeks == {("M-0", 7): 15.04, ("M-1", 8): 20.0}


def test_word_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("de\nhet\nde\nen\n")
    assert [r.word for r in S.read_wordlist(spark, str(tmp_path / "w.txt")).orderBy("line").collect()] == ["de", "het", "en"]
    (tmp_path / "m.txt").write_text("pc = computer\npc=scherm\n tel =telefoon\nniets\n")
    got = {r.word: r.replacement for r in S.read_wordmap(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {"pc": "computer", "tel": "telefoon"}


def test_margin_flags(spark):
    row = ("metal", 1, "w", "c", None, Decimal("20"), Decimal("30"), Decimal("1"), None, None, Decimal("2"), Decimal("150"), False)
    schema = "department string, week int, worker string, client string, hours decimal(18,2), buy_rate decimal(18,2), sell_rate decimal(18,2), recruiter_fee decimal(18,2), material decimal(18,2), travel decimal(18,2), overtime_hours decimal(18,2), overtime_pct decimal(18,2), invoiced boolean"
    r = B.weekly_margin(spark.createDataFrame([row], schema)).first()
    assert (float(r.sales), float(r.purchase), float(r.margin), r.missing_hours, r.to_invoice) == (90.0, 60.0, 29.0, False, True)
