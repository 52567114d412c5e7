"""Column functions over text: keyword queries, figures, labels, titles, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a question that say nothing about what it asks for.
STOP_WORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "from", "by", "with", "and", "or", "as", "is", "was", "were",
    "be", "been", "are", "what", "which", "who", "whom", "how", "much", "many", "did", "does", "do", "its", "it", "this",
    "that", "these", "those", "their", "there", "than", "then", "per", "during", "year", "years", "fiscal", "ended",
    "ending", "end", "according", "statement", "statements", "total", "amount", "value", "company", "s",
)
#: Phrases of questions that compare or derive.
SYNTHESIS = (
    "compare", "comparison", "versus", " vs ", " vs.", "difference between", "trend", "ratio",
    "calculate", "growth rate", "year-over-year", "year over year", "combined", "across",
)
#: Phrases that name a statement.
STATEMENT_KEYWORDS = {
    "income_statement": ("revenue", "revenues", "gross margin", "gross profit", "cost of revenue", "operating income", "operating margin", "net income", "earnings per share"),
    "balance_sheet": ("total assets", "total liabilities", "balance sheet", "stockholders equity", "shareholders equity", "stockholders' equity", "shareholders' equity", "total equity"),
    "cash_flow_statement": ("cash flow", "operating activities", "financing activities", "investing activities", "cash from operations"),
    "equity_statement": (
        "changes in stockholders equity", "changes in shareholders equity", "changes in stockholders' equity", "changes in shareholders' equity", "changes in equity",
        "statement of stockholders' equity", "statements of stockholders' equity", "stockholders' equity statement", "equity statement",
    ),
    "comprehensive_income": ("comprehensive income", "other comprehensive income"),
}
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
#: Fixed patterns: furniture lines of a filing.
PAGE_NUMBER, RULE, BARE_ITEM = r"^(?:F-)?\d{1,4}$", r"^(?:\\?[_\-*=~.]){3,}$", r"(?i)^Item\s+\d{1,2}[A-Za-z]?$"
#: Fixed patterns: whole lines that are titles of statements, tried in this order, and the title of the notes.
_WHOLE = r"(?i)^(CONSOLIDATED\s+)?({})$"
TITLES = {
    "balance_sheet": _WHOLE.format(r"(STATEMENTS?\s+OF\s+)?BALANCE\s+SHEETS?"),
    "cash_flow_statement": _WHOLE.format(r"STATEMENTS?\s+OF\s+CASH\s+FLOWS?|CASH\s+FLOWS?\s+STATEMENTS?"),
    "equity_statement": _WHOLE.format(r"STATEMENTS?\s+OF\s+(CHANGES\s+IN\s+)?(STOCKHOLDERS|SHAREHOLDERS).{0,3}\s+EQUITY|(STOCKHOLDERS|SHAREHOLDERS).{0,3}\s+EQUITY\s+STATEMENTS?"),
    "comprehensive_income": _WHOLE.format(r"STATEMENTS?\s+OF\s+COMPREHENSIVE\s+INCOME|COMPREHENSIVE\s+INCOME\s+STATEMENTS?"),
    "income_statement": _WHOLE.format(r"STATEMENTS?\s+OF\s+(OPERATIONS|INCOME)|(OPERATIONS|INCOME)\s+STATEMENTS?"),
}
NOTES_TITLE = r"(?i)^NOTES\s+TO\s+(CONSOLIDATED\s+)?FINANCIAL\s+STATEMENTS$"
#: Fixed patterns: what a figure is not part of, and legal forms at the end of a name.
CITATION = r"\(Source:[^)]*\)|[A-Z]{4}-10K-\d{4}\.html|\b(?:Item|Note|PART)\s+\w+"
DATE_DAY = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\b"
YEAR = r"^(19|20)\d\d$"
LEGAL_FORM = r"(?i)(?<=\S),?\s+(Corporation|Corp\.?|Incorporated|Inc\.?|Company|Co\.?|Limited|Ltd\.?|plc|LLC|L\.?P\.?|N\.V\.|S\.A\.|AG|SE)$"
#: Words that stay small in a title, and suffixes that stay capital in a name.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
CAPITAL_SUFFIXES = ("LLP", "LLC", "LP", "USA")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def keyword_terms(question: Column, names: Column | None = None) -> Column:
    """Distinct words in order of appearance, without stop words, years and the words of names."""
    drop = F.array(*(F.lit(w) for w in STOP_WORDS))
    own = F.filter(words(question), lambda w: ~F.array_contains(drop, w) & ~w.rlike(YEAR))
    return F.array_distinct(own if names is None else F.array_except(own, names))


def keyword_query(question: Column, names: Column | None = None) -> Column:
    """`"w" OR "w"` over the keyword terms, null if none is left."""
    quoted = F.transform(keyword_terms(question, names), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    return F.nullif(F.array_join(quoted, " OR "), F.lit(""))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def stated_figures(answer: Column, question: Column) -> Column:
    """Figures of an answer that are no part of a citation, no day of a month, no year and not in the question."""
    bare = F.regexp_replace(F.regexp_replace(answer, CITATION, " "), DATE_DAY, " ")
    asked = number_tokens(question)
    return F.filter(number_tokens(bare), lambda t: ~t.rlike(YEAR) & ~F.array_contains(asked, t))


def _title(line: Column, patterns: dict[str, str]) -> Column:
    text, out = trimmed(line), F.lit(None).cast("string")
    for kind, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(pattern), F.lit(kind)).otherwise(out)
    return F.when(F.length(text).between(1, 60), out)


def statement_title(line: Column) -> Column:
    """The statement that a line of at most 60 characters names as a whole, else null."""
    return _title(line, TITLES)


def is_notes_title(line: Column) -> Column:
    return _title(line, {"notes": NOTES_TITLE}).isNotNull()


def is_statement_boundary(line: Column) -> Column:
    return _title(line, {**TITLES, "notes": NOTES_TITLE}).isNotNull()


def statement_of_question(question: Column, keywords: dict[str, tuple[str, ...]] = STATEMENT_KEYWORDS) -> Column:
    """The one statement that a question's phrases name; a phrase within a longer one that is there too does not count; else null."""
    low, out = F.lower(question), []
    every = [(kind, word) for kind, words_ in keywords.items() for word in words_]
    for kind in keywords:
        said = F.lit(False)
        for word in keywords[kind]:
            longer = [F.contains(low, F.lit(o)) for _, o in every if len(o) > len(word) and word in o]
            alone = F.contains(low, F.lit(word))
            for o in longer:
                alone = alone & ~o
            said = said | alone
        out.append(F.when(said, F.lit(kind)))
    named = F.array_compact(F.array(*out))
    return F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1)))


def needs_synthesis(question: Column) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in SYNTHESIS)), lambda w: F.contains(F.lower(question), w))


def is_noise(line: Column) -> Column:
    """Page numbers, rules and bare item headers."""
    text = trimmed(line)
    return text.rlike(PAGE_NUMBER) | text.rlike(RULE) | text.rlike(BARE_ITEM)


def _table_lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, "\n"), trimmed), lambda x: F.startswith(x, F.lit("|")))


def row_labels(content: Column) -> Column:
    """First-seen labels of table rows: first cell of lines that start with a pipe, with a letter and two characters at least."""
    labels = F.transform(_table_lines(content), lambda x: trimmed(F.element_at(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), 1)))
    return F.array_distinct(F.filter(labels, lambda x: (F.length(x) >= 2) & x.rlike(r"\p{L}")))


def embedding_text(heading: Column, content: Column, template: str = "{}") -> Column:
    """Heading and content, with the row labels of a table below the heading, inside a model's template."""
    labels = F.array_join(row_labels(content), ", ")
    rows = F.when(labels == "", "Financial data table.").otherwise(F.concat(F.lit("Financial data table with rows: "), labels, F.lit(".")))
    table = F.when(F.size(_table_lines(content)) > 0, F.concat(F.lit("\n"), rows)).otherwise("")
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), heading, table, F.lit("\n\n"), content, F.lit(after))


def short_name(name: Column, rounds: int = 8) -> Column:
    """A company name without leading article and legal forms, never empty."""
    out = trimmed(F.regexp_replace(trimmed(name), r"(?i)^the (?=.*\S)", ""))
    for _ in range(rounds):
        out = trimmed(F.regexp_replace(out, LEGAL_FORM, ""))
    return out


def clean_value(value: Column) -> Column:
    """A cover value without trailing commas; all capitals of more than four letters become title case, but for acronyms and suffixes."""
    bare = trimmed(F.regexp_replace(trimmed(value), "[,;]+$", ""))
    letters = F.regexp_replace(bare, r"\P{L}", "")
    shouted = (F.length(letters) > 4) & ~letters.rlike(r"[^\p{Lu}]")
    acronym = lambda w: w.rlike(r"\p{L}") & (~w.rlike("(?i)[AEIOU]") | F.contains(w, F.lit("&")))
    spoken = F.array_join(F.transform(F.split(bare, " "), lambda w: F.when(acronym(w), w).otherwise(F.initcap(F.lower(w)))), " ")
    for suffix in CAPITAL_SUFFIXES:
        spoken = F.regexp_replace(spoken, rf"(?i)\b{suffix}\b", suffix)
    return F.nullif(F.when(shouted, spoken).otherwise(bare), F.lit(""))


def topic_title(title: Column) -> Column:
    """A role title as a heading: all capitals become title case with small words small."""
    small = F.array(*(F.lit(w) for w in SMALL_WORDS))
    bare = trimmed(title)
    cased = F.transform(F.split(F.lower(bare), " "), lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.initcap(w)))
    return F.when(bare.rlike(r"\p{Ll}"), bare).otherwise(F.array_join(cased, " "))


def company_line(name: Column, symbols: Column, form: Column, year: Column) -> Column:
    """`Name (SYM), Form 10-K for fiscal year Y.`, without the parts that are null or empty."""
    part = lambda before, v, after="": F.when(v.isNotNull() & (v != ""), F.concat(F.lit(before), v, F.lit(after))).otherwise("")
    return F.concat(name, part(" (", F.array_join(symbols, ", "), ")"), part(", Form ", form), part(" for fiscal year ", year), F.lit("."))


def concept_of(fragment: Column) -> Column:
    """`us-gaap_Assets` is us-gaap:Assets."""
    return F.regexp_replace(fragment, "^([^_]+)_", "$1:")


def role_definition(text: Column) -> Column:
    """struct(sort_code, type, title) of `code - Type - Title`; without three parts the type is `(unknown)`, the code empty."""
    parts = F.split(text, " - ", 3)
    whole = F.size(parts) == 3
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.struct(F.when(whole, at(1)).otherwise("").alias("sort_code"), F.when(whole, at(2)).otherwise("(unknown)").alias("type"), F.when(whole, at(3)).otherwise(text).alias("title"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([*_])", r"\\$1"), r"[ \t\r\n]+", " ")


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "’‘", "''")


# Fixed patterns: a score in words, one alone on the last line, one that leads, and what stands before a reply that was not read.
WRITTEN_SCORE = (
    r"(?i)\b(?:score|metric|value|rating|rate[ds]?)\b[^.\d]{0,30}?\b(?:is|of|be|as|at)\s*(?:an?\s+)?\**([1-5])\b(?![.,]\d)"
    r"|\b(?:score|metric|value|rating)\s*[:=]\s*\**([1-5])\b(?![.,]\d)|\b([1-5])\s*(?:/\s*5|out of 5|stars?)\b"
)
TRAILING_SCORE, LEADING_SCORE, UNREAD_REPLY = r"\n\s*\**([1-5])\**\z", r"\A\**([1-5])\**(?![\d.,%])\s", "from the following text:"


def judge_score(reply: Column) -> Column:
    """The last written score of a reply, else the number alone on its last line, else a leading one; 1 to 5."""
    text = trimmed(reply)
    written = [F.nullif(F.try_element_at(F.regexp_extract_all(text, F.lit(WRITTEN_SCORE), k), F.lit(-1)), F.lit("")) for k in (1, 2, 3)]
    alone = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (TRAILING_SCORE, LEADING_SCORE)]
    return F.coalesce(*written, *alone).cast("int")


def recovered_score(error: Column) -> Column:
    """The score in a reply that an error quotes as unread; null for other errors."""
    at = F.instr(error, UNREAD_REPLY)
    return F.when(at > 0, judge_score(F.substr(error, at + len(UNREAD_REPLY))))


def line_window(line: Column, figure: Column, width: int = 160) -> Column:
    """A line, or of a longer one `width` characters centred on a figure, kept within the line, with marks where text is left out."""
    tokens = number_tokens(line)
    gaps = F.transform(F.split(line, NUMBER, -1), lambda g: F.length(g))
    place = F.array_position(tokens, figure).cast("int")
    before = F.aggregate(F.slice(gaps, F.lit(1), place), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(tokens, F.lit(1), place - 1), F.lit(0), lambda a, x: a + F.length(x))
    at = F.when(place > 0, before).otherwise(0)
    start = F.greatest(F.lit(0), F.least(at - width // 2, F.length(line) - width))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(line, start + 1, F.lit(width)), F.when(start + width < F.length(line), "...").otherwise(""))
    return F.when(F.length(line) <= width, line).otherwise(cut)
