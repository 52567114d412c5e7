"""Inline XBRL of a page as contexts, units and facts, and what its cover facts say.

A page is read in one pass of its tags: every open fact or continuation collects the text below it, but for what an
exclusion inside it holds. Values follow from the texts by column expressions (`functions.numbers`).
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T

_CONTEXT = "id string, instant date, start date, end date, dimensions array<struct<axis:string,member:string,typed_value:string>>"
_FACT = (
    "seq int, concept string, context_ref string, unit_ref string, is_numeric boolean, is_nil boolean, format string, scale int, decimals string, "
    "is_negated boolean, display_text string, is_text_block boolean, pieces int"
)
COMMON_EQUITY = r"(?i)\b(common|ordinary)\s+(stock|shares?)\b"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.collecting: list[dict] = []
        self.facts, self.continuations, self.contexts, self.units = [], {}, [], []
        self.has_header, self.context, self.unit, self.side = False, None, None, None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == "ix:header":
            self.has_header = True
        elif tag == "ix:exclude":
            for c in self.collecting:
                c["excluded"] += 1
        elif tag in ("ix:nonfraction", "ix:nonnumeric", "ix:continuation", "xbrldi:explicitmember", "xbrldi:typedmember", "xbrli:instant", "xbrli:startdate", "xbrli:enddate", "xbrli:measure"):
            own = {"tag": tag, "at": at, "text": [], "excluded": 0}
            self.collecting.append(own)
            if tag in ("ix:nonfraction", "ix:nonnumeric"):
                self.facts.append(own)
            elif tag == "ix:continuation" and "id" in at:
                self.continuations[at["id"]] = own
        elif tag == "xbrli:context":
            self.context = {"id": self._needed(tag, at, "id"), "instant": None, "start": None, "end": None, "dimensions": []}
            self.contexts.append(self.context)
        elif tag == "xbrli:unit":
            self.unit, self.side = {"id": self._needed(tag, at, "id"), "numerators": [], "denominators": []}, "numerators"
            self.units.append(self.unit)
        elif tag == "xbrli:unitdenominator":
            self.side = "denominators"

    def handle_endtag(self, tag):
        if tag == "ix:exclude":
            for c in self.collecting:
                c["excluded"] -= c["excluded"] > 0
        elif tag == "xbrli:unitdenominator":
            self.side = "numerators"
        own = next((c for c in reversed(self.collecting) if c["tag"] == tag), None)
        if own is None:
            return
        self.collecting.remove(own)
        said = "".join(own["text"]).strip()
        if tag == "xbrli:measure" and self.unit is not None:
            self.unit[self.side].append(said)
        elif self.context is not None and tag in ("xbrli:instant", "xbrli:startdate", "xbrli:enddate"):
            self.context[{"xbrli:instant": "instant", "xbrli:startdate": "start", "xbrli:enddate": "end"}[tag]] = said
        elif self.context is not None and tag.startswith("xbrldi:"):
            explicit = tag == "xbrldi:explicitmember"
            self.context["dimensions"].append({"axis": self._needed(tag, own["at"], "dimension"), "member": said if explicit else None, "typed_value": None if explicit else said})

    def handle_data(self, data):
        for c in self.collecting:
            if not c["excluded"]:
                c["text"].append(data)

    @staticmethod
    def _needed(tag, at, name):
        if at.get(name) is None:
            raise ValueError(f"<{tag}> without {name}")
        return at[name]

    def rows(self) -> dict:
        if not self.has_header:
            raise ValueError("no ix:header: not an inline XBRL page")
        facts = []
        for seq, own in enumerate(self.facts):
            at, chain, seen, after = own["at"], [own], set(), own["at"].get("continuedat")
            while after is not None:
                if after in seen or after not in self.continuations:
                    raise ValueError(f"continuation {after} is missing or loops")
                seen.add(after)
                chain.append(self.continuations[after])
                after = chain[-1]["at"].get("continuedat")
            scale = at.get("scale") or ""
            facts.append({
                "seq": seq, "concept": self._needed(own["tag"], at, "name"), "context_ref": self._needed(own["tag"], at, "contextref"), "unit_ref": at.get("unitref"), "is_numeric": own["tag"] == "ix:nonfraction",
                "is_nil": at.get("xsi:nil") == "true", "format": at.get("format"), "scale": int(scale) if scale.lstrip("+-").isdigit() else 0, "decimals": at.get("decimals"), "is_negated": at.get("sign") == "-",
                "display_text": " ".join("".join(t for c in chain for t in c["text"]).split()), "is_text_block": at.get("escape") == "true", "pieces": len(chain),
            })
        return {"contexts": self.contexts, "units": self.units, "facts": facts}


def parse(html: str) -> dict:
    page = _Page()
    page.feed(html)
    page.close()
    return page.rows()


#: Pages that a task turns into rows at a time.
_PAGES = 16


def read(pages: DataFrame, filing: str = "filing", html: str = "html", strict: bool = True) -> DataFrame:
    """(filing, contexts, units, facts), arrays in page order; null pages are left out.

    A page that is damaged or without inline XBRL raises or, unless `strict`, is a row without arrays whose `error`, a further column, says why.
    """
    texts = "array<struct<id:string,instant:string,start:string,end:string,dimensions:array<struct<axis:string,member:string,typed_value:string>>>>"
    schema = f"filing string, contexts {texts}, units array<struct<id:string,numerators:array<string>,denominators:array<string>>>, facts array<struct<{', '.join(':'.join(c.split()) for c in _FACT.split(', '))}>>" + ("" if strict else ", error string")
    arrow = None

    def parsed(name: str | None, page: str) -> dict:
        try:
            return {"filing": name} | parse(page)
        except ValueError as why:
            if strict:
                raise
            return {"filing": name, "error": str(why)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, _PAGES):
                batch = whole.slice(low, _PAGES)
                rows = [parsed(f, h) for f, h in zip(batch.column("filing").to_pylist(), batch.column("html").to_pylist(), strict=True)]
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    plain = pages.select(F.col(filing).cast("string").alias("filing"), F.col(html).alias("html")).where("html is not null")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    found = plain.mapInArrow(run, schema)
    date = lambda x, n: F.to_date(x[n]).alias(n)
    dated = F.transform("contexts", lambda x: F.struct(x["id"].alias("id"), date(x, "instant"), date(x, "start"), date(x, "end"), x["dimensions"].alias("dimensions")))
    return found.withColumn("contexts", dated)


def contexts(read_pages: DataFrame) -> DataFrame:
    return read_pages.select("filing", F.inline("contexts"))


def units(read_pages: DataFrame) -> DataFrame:
    """(filing, id, numerators, denominators, unit): unit is written a*b/c."""
    rows = read_pages.select("filing", F.inline("units"))
    below = F.when(F.size("denominators") > 0, F.concat(F.lit("/"), F.array_join("denominators", "*"))).otherwise("")
    return rows.withColumn("unit", F.concat(F.array_join("numerators", "*"), below))


def facts(read_pages: DataFrame) -> DataFrame:
    """Facts with number (exact, scaled, signed) or text; a nil fact has neither."""
    rows = read_pages.select("filing", F.inline("facts"))
    value = N.scaled(N.ix_number(F.when(F.col("is_numeric") & ~F.col("is_nil"), F.col("display_text")), F.col("format")), F.col("scale"), F.col("is_negated"))
    text = N.ix_text(F.when(~F.col("is_numeric") & ~F.col("is_nil"), F.col("display_text")), F.when(~F.col("is_numeric"), F.col("format")))
    return rows.withColumns({"number": value, "text": text})


def unresolved(fact_rows: DataFrame, context_rows: DataFrame, unit_rows: DataFrame) -> DataFrame:
    """(filing, seq, missing): facts that name a context or unit which the page does not have."""
    no_context = fact_rows.join(context_rows.select("filing", F.col("id").alias("context_ref")), ["filing", "context_ref"], "left_anti").select("filing", "seq", F.lit("context").alias("missing"))
    with_unit = fact_rows.where("unit_ref is not null")
    return no_context.union(with_unit.join(unit_rows.select("filing", F.col("id").alias("unit_ref")), ["filing", "unit_ref"], "left_anti").select("filing", "seq", F.lit("unit").alias("missing")))


def common_stocks(fact_rows: DataFrame) -> DataFrame:
    """(filing, seq, symbol, exchange, title): classes of common equity in cover order, each symbol once.

    A title, a symbol and an exchange belong together if they share a context; the first fact of each counts.
    """
    of = lambda concept, name: fact_rows.where(F.col("concept") == concept).groupBy("filing", "context_ref").agg(F.min_by("text", "seq").alias(name))
    titles = fact_rows.where((F.col("concept") == "dei:Security12bTitle") & F.col("text").rlike(COMMON_EQUITY)).select("filing", "context_ref", "seq", F.col("text").alias("title"))
    rows = titles.join(of("dei:TradingSymbol", "symbol"), ["filing", "context_ref"]).join(of("dei:SecurityExchangeName", "exchange"), ["filing", "context_ref"], "left")
    rows = rows.withColumn("symbol", T.trimmed(F.col("symbol"))).where("symbol <> ''")
    first = F.row_number().over(Window.partitionBy("filing", "symbol").orderBy("seq"))
    return rows.withColumn("_n", first).where("_n = 1").select("filing", "seq", "symbol", T.clean_value(F.col("exchange")).alias("exchange"), T.clean_value(F.col("title")).alias("title"))


_COVER = {
    "registrant": "dei:EntityRegistrantName", "form": "dei:DocumentType", "fiscal_year": "dei:DocumentFiscalYearFocus", "period_end": "dei:DocumentPeriodEndDate", "line1": "dei:EntityAddressAddressLine1",
    "line2": "dei:EntityAddressAddressLine2", "city": "dei:EntityAddressCityOrTown", "state": "dei:EntityAddressStateOrProvince", "zip": "dei:EntityAddressPostalZipCode",
    "incorporation": "dei:EntityIncorporationStateCountryCode", "auditor": "dei:AuditorName", "auditor_place": "dei:AuditorLocation", "auditor_id": "dei:AuditorFirmId",
}


def companies(fact_rows: DataFrame) -> DataFrame:
    """(filing, registrant, short_name, symbols, names, context, profile) from cover facts; a filing without a registrant's name raises."""
    covers = fact_rows.groupBy("filing").agg(*(F.min_by(F.when(F.col("concept") == c, F.col("text")), F.when(F.col("concept") == c, F.col("seq"))).alias(n) for n, c in _COVER.items()))
    covers = covers.select("filing", F.col("form").alias("raw_form"), F.col("period_end"), F.col("fiscal_year").alias("raw_year"), *(T.clean_value(F.col(n)).alias(n) for n in _COVER if n != "period_end"))
    missing = F.raise_error(F.concat(F.lit("no registrant name in "), F.col("filing")))
    covers = covers.withColumn("registrant", F.when(F.coalesce("registrant", F.lit("")) != "", F.col("registrant")).otherwise(missing))
    stocks = common_stocks(fact_rows).groupBy("filing").agg(F.array_sort(F.collect_list(F.struct("seq", "symbol", "exchange", "title"))).alias("stocks"))  # a few classes a filing
    df = covers.join(stocks, "filing", "left").withColumn("stocks", F.coalesce("stocks", F.array().cast("array<struct<seq:int,symbol:string,exchange:string,title:string>>")))
    symbols = F.transform("stocks", lambda s: s["symbol"])
    short = T.short_name(F.col("registrant"))
    part = lambda before, v, after="": F.coalesce(F.concat(F.lit(before), v, F.lit(after)), F.lit(""))
    on = lambda s: part(", on the ", F.regexp_replace(s["exchange"], "The ", ""))
    one, many = (F.transform("stocks", f) for f in (lambda s: F.concat(s["symbol"], on(s)), lambda s: F.concat(s["symbol"], part(" (", s["title"], ")"), on(s))))
    traded = F.when(F.size("stocks") == 1, part(" Common stock trading symbol: ", F.try_element_at(one, F.lit(1)), ".")).when(F.size("stocks") > 1, F.concat(F.lit(" Common stock trading symbols: "), F.array_join(many, "; "), F.lit("."))).otherwise("")
    street = F.nullif(F.concat_ws(", ", "line1", "line2", "city"), F.lit(""))
    profile = F.concat(
        F.col("registrant"), F.lit(" - annual report on Form "), F.coalesce("raw_form", F.lit("10-K")), part(" for the fiscal year ended ", F.date_format(F.try_to_date("period_end", "yyyy-MM-dd"), "MMMM d, yyyy")), part(" (fiscal year ", F.col("raw_year"), ")"), F.lit("."), traded,
        F.coalesce(F.concat(F.lit(" Address of principal executive offices: "), street, part(", ", F.col("state")), part(" ", F.col("zip")), F.lit(".")), F.lit("")), part(" State of incorporation: ", F.col("incorporation"), "."),
        F.coalesce(F.concat(F.lit(" Independent registered public accounting firm (auditor): "), F.col("auditor"), part(", ", F.col("auditor_place")), part(" (PCAOB ID ", F.col("auditor_id"), ")"), F.lit(".")), F.lit("")),
    )
    names = F.array_distinct(F.transform(F.array_compact(F.concat(F.array(short), symbols)), F.lower))
    return df.select("filing", "registrant", short.alias("short_name"), symbols.alias("symbols"), names.alias("names"), T.company_line(F.col("registrant"), symbols, F.col("form"), F.col("fiscal_year")).alias("context"), profile.alias("profile"))


def resolve_filings(questions: DataFrame, company_rows: DataFrame) -> DataFrame:
    """(question_id, filings): filings of which a name stands in the question as a whole word, in order; none gives an empty array.

    questions (question_id, question); companies are a small dimension, one row a filing, and each question is held against their names.
    """
    names = company_rows.select("filing", F.explode("names").alias("name"))
    escaped = F.regexp_replace("name", r"([^\p{L}\p{N}\s])", r"\\$1")
    found = questions.join(names, F.regexp_like("question", F.concat(F.lit(r"(?i)\b"), escaped, F.lit(r"\b")))).groupBy("question_id").agg(F.array_sort(F.collect_set("filing")).alias("filings"))
    return questions.select("question_id").join(found, "question_id", "left").withColumn("filings", F.coalesce("filings", F.array().cast("array<string>")))
