"""Inline XBRL and taxonomies on small fixtures."""

from __future__ import annotations

import datetime

import pytest

from ledgerloom.sources import inline_xbrl as X
from ledgerloom.sources import taxonomy as Y

def fact(name, text, context="Y31", more=""):
    return f'<ix:nonNumeric name="{name}" contextRef="{context}"{more}>{text}</ix:nonNumeric>'


def context(name, period, segment=""):
    days = f"<xbrli:instant>{period[0]}</xbrli:instant>" if len(period) == 1 else f"<xbrli:startDate>{period[0]}</xbrli:startDate><xbrli:endDate>{period[1]}</xbrli:endDate>"
    return f'<xbrli:context id="{name}"><xbrli:entity>{segment}</xbrli:entity><xbrli:period>{days}</xbrli:period></xbrli:context>'


MEMBER = '<xbrli:segment><xbrldi:explicitMember dimension="kw:OvenAxis">kw:TunnelMember</xbrldi:explicitMember></xbrli:segment>'
PAGE = "".join([
    "<html><ix:header><ix:resources>", context("Y31", ("2030-07-01", "2031-06-30")), context("Tunnel", ("2031-06-30",), MEMBER),
    '<xbrli:unit id="tonne"><xbrli:measure>utr:t</xbrli:measure></xbrli:unit><xbrli:unit id="perTile"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unitNumerator>',
    "<xbrli:unitDenominator><xbrli:measure>kw:tile</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit></ix:resources></ix:header>",
    fact("dei:EntityRegistrantName", "KILNWORKS CORPORATION"), fact("dei:DocumentType", "10-K"), fact("dei:DocumentFiscalYearFocus", "2031"),
    fact("dei:DocumentPeriodEndDate", "June 30, 2031", more=' format="ixt:date-monthname-day-year-en"'),
    fact("dei:Security12bTitle", "8% Bonds"), fact("dei:TradingSymbol", "KWB"), fact("dei:Security12bTitle", "Common Stock of no par value", "Tunnel"), fact("dei:TradingSymbol", " KILN ", "Tunnel"),
    fact("dei:SecurityExchangeName", "The Nasdaq Stock Market LLC", "Tunnel", ' format="ixt-sec:exchnameen"'), fact("dei:EntityAddressCityOrTown", "Leeds,"), fact("dei:AuditorName", "Clay &amp; Sons"),
    '<p>Dug <ix:nonFraction name="kw:ClayDug" contextRef="Y31" unitRef="tonne" scale="3" sign="-" format="ixt:num-dot-decimal">12.5</ix:nonFraction></p>',
    '<ix:nonNumeric name="kw:OvensTextBlock" contextRef="Y31" escape="true" continuedAt="more">Each tile costs <ix:nonFraction name="kw:CostPerTile" contextRef="Y31" unitRef="perTile">0.85</ix:nonFraction>',
    '<ix:exclude>F-3</ix:exclude> in summer,</ix:nonNumeric><p>between</p><ix:continuation id="more" continuedAt="last">less</ix:continuation><ix:continuation id="last"> in winter</ix:continuation>',
    '<ix:nonFraction name="kw:Closed" contextRef="Tunnel" unitRef="tonne" xsi:nil="true"></ix:nonFraction></html>',
])


def test_inline_facts(spark):
    read = X.read(spark.createDataFrame([("k.html", PAGE), ("n.html", None)], "filing string, html string")).cache()
    contexts = {r["id"]: r for r in X.contexts(read).collect()}
    assert (contexts["Y31"]["start"], contexts["Y31"]["end"]) == (datetime.date(2030, 7, 1), datetime.date(2031, 6, 30))
    assert contexts["Tunnel"]["instant"] == datetime.date(2031, 6, 30) and contexts["Tunnel"]["dimensions"][0]["member"] == "kw:TunnelMember"
    assert {r["id"]: r["unit"] for r in X.units(read).collect()} == {"tonne": "utr:t", "perTile": "iso4217:EUR/kw:tile"}
    facts = X.facts(read)
    by = {r["concept"]: r for r in facts.collect()}
    assert float(by["kw:ClayDug"]["number"]) == -12_500 and float(by["kw:CostPerTile"]["number"]) == 0.85
    assert (by["kw:OvensTextBlock"]["text"], by["kw:OvensTextBlock"]["pieces"]) == ("Each tile costs 0.85 in summer,less in winter", 3)
    assert by["kw:Closed"]["number"] is None and by["dei:DocumentPeriodEndDate"]["text"] == "2031-06-30"
    assert X.unresolved(facts, X.contexts(read), X.units(read)).count() == 0
    assert X.unresolved(facts, X.contexts(read).where("id = 'Y31'"), X.units(read)).count() == 4
    company = X.companies(facts).first()
    assert (company["registrant"], company["short_name"], company["symbols"], company["context"]) == ("Kilnworks Corporation", "Kilnworks", ["KILN"], "Kilnworks Corporation (KILN), Form 10-K for fiscal year 2031.")
    assert company["profile"] == "Kilnworks Corporation - annual report on Form 10-K for the fiscal year ended June 30, 2031 (fiscal year 2031). Common stock trading symbol: KILN, on the Nasdaq Stock Market LLC. Address of principal executive offices: Leeds. Independent registered public accounting firm (auditor): Clay & Sons."
    asked = spark.createDataFrame([(1, "What did kilnworks's ovens use?"), (2, "Kilnworkss say"), (3, "KILN?")], "question_id int, question string")
    assert {r["question_id"]: r["filings"] for r in X.resolve_filings(asked, X.companies(facts)).collect()} == {1: ["k.html"], 2: [], 3: ["k.html"]}
    with pytest.raises(Exception, match="no registrant name in k.html"):
        X.companies(facts.where("concept <> 'dei:EntityRegistrantName'")).collect()


def test_damaged_pages_raise():
    for page, why in ((PAGE.replace('id="last"', 'id="lost"'), "missing"), (PAGE.replace('<ix:continuation id="last">', '<ix:continuation id="last" continuedAt="more">'), "loops"), ("<p>x</p>", "header"), (PAGE.replace('name="kw:CostPerTile" ', ""), "without name")):
        with pytest.raises(ValueError, match=why):
            X.parse(page)


def test_damaged_pages_as_rows(spark):
    pages = [("k.html", PAGE), ("cut.html", PAGE.replace('id="last"', 'id="lost"')), ("plain.html", "<p>x</p>"), ("null.html", None)] + [(f"k{k}.html", PAGE) for k in range(40)]
    df = spark.createDataFrame(pages, "filing string, html string").coalesce(1)
    read = X.read(df, strict=False).cache()
    errors = {r["filing"]: r["error"] for r in read.where("error is not null").collect()}
    assert errors.keys() == {"cut.html", "plain.html"} and "missing" in errors["cut.html"] and "header" in errors["plain.html"]
    assert X.facts(read).select("filing").distinct().count() == 41 and read.count() == 43
    with pytest.raises(Exception, match="missing or loops"):
        X.read(df).collect()


SCHEMA = """<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" targetNamespace="http://x/2025"><xsd:annotation><xsd:appinfo>
<link:linkbaseRef xlink:href="x_pre.xml"/><link:roleType roleURI="http://x/role/BS"><link:definition>0002 - Statement - BALANCE SHEETS</link:definition></link:roleType>
<link:roleType roleURI="http://x/role/Tax"><link:definition>99952 - Disclosure - INCOME TAXES AND MORE</link:definition></link:roleType>
<link:roleType roleURI="http://x/role/TaxT"><link:definition>99953 - Disclosure - Income Taxes (Tables)</link:definition></link:roleType><link:roleType roleURI="http://x/role/odd"><link:definition>odd</link:definition></link:roleType>
</xsd:appinfo></xsd:annotation></xsd:schema>"""
LINKS = """<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink">
<link:presentationLink xlink:role="http://x/role/BS"><link:loc xlink:label="a" xlink:href="u.xsd#us-gaap_Assets"/><link:loc xlink:label="b" xlink:href="u.xsd#us-gaap_Cash"/><link:loc xlink:label="c" xlink:href="u.xsd#us-gaap_Other"/>
<link:presentationArc xlink:from="a" xlink:to="b"/><link:presentationArc xlink:from="c" xlink:to="b"/><link:presentationArc xlink:from="none" xlink:to="c"/></link:presentationLink>
<link:presentationLink xlink:role="http://x/role/Tax"><link:loc xlink:label="t" xlink:href="u.xsd#kw_OvensTextBlock"/></link:presentationLink>
<link:labelLink xlink:role="http://x"><link:loc xlink:label="a" xlink:href="u.xsd#us-gaap_Assets"/><link:label xlink:label="l" xlink:role="http://www.xbrl.org/2003/role/totalLabel">Total</link:label><link:label xlink:label="l"> Assets </link:label><link:labelArc xlink:from="a" xlink:to="l"/></link:labelLink></link:linkbase>"""


def test_taxonomy(spark, tmp_path):
    (tmp_path / "x.xsd").write_text(SCHEMA)
    with pytest.raises(FileNotFoundError, match="x_pre"):
        Y.read(spark, f"file://{tmp_path}")
    (tmp_path / "x_pre.xml").write_text(LINKS)
    rows = Y.read(spark, f"file://{tmp_path}").cache()
    roles = Y.roles(rows)
    assert {(r["sort_code"], r["type"], r["title"]) for r in roles.collect()} == {("0002", "Statement", "BALANCE SHEETS"), ("99952", "Disclosure", "INCOME TAXES AND MORE"), ("99953", "Disclosure", "Income Taxes (Tables)"), ("", "(unknown)", "odd")}
    assert {r["role"][-3:]: r["concepts"] for r in Y.presented(rows).collect()} == {"/BS": ["us-gaap:Assets", "us-gaap:Cash", "us-gaap:Other"], "Tax": ["kw:OvensTextBlock"]}
    assert [(r["child"], r["parent"]) for r in Y.parents(rows).collect()] == [("us-gaap:Cash", "us-gaap:Assets")]
    assert [tuple(r) for r in Y.labels(rows).collect()] == [("us-gaap:Assets", "Assets")]
    assert [r["title"] for r in Y.primary_statements(roles).collect()] == ["BALANCE SHEETS"]
    facts = X.facts(X.read(spark.createDataFrame([("o.html", PAGE)], "filing string, html string")))
    assert [(r["place"], r["topic"]) for r in Y.note_topics(facts, roles, Y.presented(rows)).collect()] == [(1, "Income Taxes and More")]




def test_taxonomies_of_filings(spark, tmp_path):
    for name, ns, links in (("a-1.xsd", "http://a/1", "a_pre.xml"), ("a-2.xsd", "http://a/1", ""), ("b.xsd", "http://b/1", "b_lab.xml")):
        link = f'<link:linkbaseRef xlink:href="{links}"/>' if links else ""
        (tmp_path / name).write_text(f'<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" targetNamespace="{ns}">{link}</xsd:schema>')
        if links:
            (tmp_path / links).write_text('<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase"/>')
    pages = [("p", '<HTML lang="en" xmlns:x="http://a/1"\n xmlns:y=\'http://z\'><p xmlns:b="http://b/1">'), ("q", '<html xmlns="http://b/1">'), ("r", "<html xmlns:b='http://b/1' xmlns:c='http://b/1'>"), ("s", None)]
    found = Y.filing_taxonomies(Y.read(spark, f"file://{tmp_path}"), spark.createDataFrame(pages, "filing string, html string"))
    assert {tuple(r) for r in found.collect()} == {("p", "a-1.xsd", "a-1.xsd"), ("p", "a-1.xsd", "a_pre.xml"), ("r", "b.xsd", "b.xsd"), ("r", "b.xsd", "b_lab.xml")}
