"""Secret scans: fixed patterns, plus sliding-window entropy of candidate strings. SQL expressions only.

Base kinds: `assign` (a key word, a separator and a value of 6 or more), `access` (key ids of 20 or
more) and `hex` (24 or more hex digits). Matches are leftmost and do not overlap within a kind.

The method adds `entropy` spans. Candidates are runs of 20 or more key characters; what base spans cover
is cut out of them, and the pieces of 20 or more that are left, with a letter and a digit, are held
against the allow list: identifiers and paths of words are no secrets, and placeholder words are left out
of a piece, which must still have 20 characters. A piece belongs to the narrowest character class that
holds it (hex, alphanumeric, any key character). A window slides over it: each step adds one character to
the counts, which are packed five bits each into longs, and takes one away, and moves the sum of c log2 c
by two table entries. A piece is a secret if the Shannon entropy of a window reaches the threshold of its
class.

Running totals over matches are made by doubling, so a text with n matches costs n log n, and strings of
any length are walked once.

Positions are code points, end exclusive; spans are ordered by start, then kind as listed, then end.

Defined results: null text is empty and has no spans; repeated rows are scanned alike; an empty table stays
empty; columns of the input keep their values whatever their names, but for one that is called like the
result (`_spans`), which is replaced; very long texts and candidates are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns and least lengths of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Bits a character that a window must reach, by class.
HEX_BITS, ALNUM_BITS, KEY_BITS = 3.0, 3.7, 3.8
#: Whole candidates that look like keys and are none: identifiers, paths of words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z_/-]*/[A-Za-z_-]*[0-9]{0,4}$",
)
#: What stands in the place of a key.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|dummy|xxxxx|00000|12345"
_NONE = "cast(array() as array<struct<start:int,end:int,value:string>>)"
#: Counts of up to 31 in a long.
_PACKED = 12
#: Characters of the blocks that a text is taken from.
_BLOCK = 4096


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for a body in which a value, evaluated once, has a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, of: str = "x + a[i - d]") -> str:
    """SQL for an array's running totals, or another associative function `of` x and an earlier a[i - d]."""
    strides = "transform(sequence(0, 30), k -> shiftleft(1, k))"
    return _let("v", values, f"aggregate(filter({strides}, d -> d < size(v)), v, (a, d) -> transform(a, (x, i) -> if(i >= d, {of}, x)))")


_LARGEST = "greatest(x, a[i - d])"


def _matches(text: str, pattern: str, value_group: int = 0) -> str:
    """SQL for array<struct<start, end, value>> of all matches, from the lengths of matches and of what lies between."""
    p = _quoted(pattern)
    lengths = f"transform(regexp_extract_all({text}, {p}, 0), x -> length(x))"
    gaps = f"transform(split({text}, {p}, -1), x -> length(x))"
    ends = _running("zip_with(slice(gaps, 1, size(lens)), lens, (g, l) -> g + l)")
    found = f"zip_with(zip_with({ends}, lens, (e, l) -> named_struct('start', e - l, 'end', e)), regexp_extract_all({text}, {p}, {value_group}), (x, v) -> named_struct('start', x.start, 'end', x.end, 'value', v))"
    return f"if(rlike({text}, {p}), {_let('lens', lengths, _let('gaps', gaps, found))}, {_NONE})"


def _spans(found: str, order: int, keep: str = "true") -> str:
    return f"transform(filter({found}, x -> {keep}), x -> named_struct('start', x.start, 'kind', {order}, 'end', x.end))"


def _uncovered(base: str, found: str, least: int) -> str:
    """SQL for the pieces of matches that no base span covers, of at least so many characters.

    Base spans and matches are put into one order of starts. At each of them a piece may begin: where the
    last match begins or the furthest base span ends, up to the next base span or the match's end.
    """
    marks = f"array_sort(concat(transform({base}, b -> named_struct('at', b.start, 'far', b.end, 'no', -1)), transform(found, (c, i) -> named_struct('at', c.start, 'far', 0, 'no', i))))"
    upcoming = f"reverse({_running('transform(reverse(marks), m -> if(m.no < 0, -m.at, -2147483647))', _LARGEST)})"
    number, far = (_running(f"transform(marks, m -> m.{f})", _LARGEST) for f in ("no", "far"))
    piece = "named_struct('c', found[greatest(n[i], 0)], 'from', greatest(found[greatest(n[i], 0)].start, f[i]), 'to', least(found[greatest(n[i], 0)].end, coalesce(-try_element_at(u, i + 2), 2147483647)))"
    pieces = f"filter(transform(sequence(0, size(marks) - 1), i -> if(n[i] >= 0, {piece}, null)), p -> p.to - p.from >= {least})"
    cut = f"transform({pieces}, p -> named_struct('start', p.from, 'end', p.to, 'value', substring(p.c.value, p.from - p.c.start + 1, p.to - p.from)))"
    inner = _let("marks", marks, _let("n", number, _let("f", far, _let("u", upcoming, cut))))
    return _let("found", found, f"if(size({base}) = 0 or size(found) = 0, found, {inner})")


def top_entropy(value: str, window: int = WINDOW) -> str:
    """SQL for the largest entropy, in bits a character, of the windows of a string; -1 if it is shorter than a window.

    State: packed counts n, s = sum of c log2 c over the window, how many characters came, the largest entropy.
    """
    if window > 31:
        raise ValueError("a window has 31 characters at most")
    steps = "array(" + ", ".join(f"{(k + 1) * math.log2(k + 1) - k * math.log2(max(k, 1))!r}D" for k in range(window + 1)) + ")"
    code = f"instr('{ALPHABET}', c) - 1"
    places = f"transform(codes, (c, i) -> named_struct('i', c, 'o', if(i >= {window}, codes[i - {window}], -1)))"
    count = lambda of: f"cast(shiftright(a.n[{of} div {_PACKED}], 5 * ({of} % {_PACKED})) & 31 as int)"
    one = lambda of: f"shiftleft(1L, 5 * ({of} % {_PACKED}))"
    added = f"transform(a.n, (v, j) -> if(j = x.i div {_PACKED}, v + {one('x.i')}, v))"
    taken = f"transform(a.n, (v, j) -> if(j = x.o div {_PACKED}, v - {one('x.o')}, v))"
    # First the character that leaves, then the one that comes.
    left = f"if(x.o < 0, a, named_struct('n', {taken}, 's', a.s - g[{count('x.o')} - 1], 'k', a.k, 'top', a.top))"
    come = f"named_struct('n', {added}, 's', a.s + g[{count('x.i')}], 'k', a.k + 1, 'top', a.top)"
    told = f"named_struct('n', a.n, 's', a.s, 'k', a.k, 'top', if(a.k >= {window}, greatest(a.top, {math.log2(window)!r}D - a.s / {window}), a.top))"
    step = _let("a", left, _let("a", come, told))
    start = f"named_struct('n', array_repeat(0L, {-(-len(ALPHABET) // _PACKED)}), 's', 0D, 'k', 0, 'top', -1D)"
    fold = f"aggregate({places}, {start}, (a, x) -> {step}, a -> a.top)"
    return _let("g", steps, _let("codes", f"transform(split({value}, ''), c -> {code})", fold))


def spans(text: str, allowed: Sequence[str] = ALLOWED) -> tuple[dict[str, str], str]:
    """SQL for the base span arrays by kind, and for the entropy spans given the base ones, in order, in column _base."""
    base = {
        "assign": _spans(_matches(text, ASSIGN, 2), 0, f"length(x.value) >= {LEAST_VALUE}"),
        "access": _spans(_matches(text, ACCESS), 1),
        "hex": _spans(_matches(text, HEX), 2),
    }
    need = f"case when rlike(x.value, '^[0-9a-fA-F]+$') then {HEX_BITS} when rlike(x.value, '^[0-9A-Za-z]+$') then {ALNUM_BITS} else {KEY_BITS} end"
    listed = " or ".join(f"rlike(x.value, {_quoted(a)})" for a in allowed) or "false"
    keep = f"rlike(x.value, '[0-9]') and rlike(x.value, '[A-Za-z]') and not ({listed}) and {top_entropy(f'regexp_replace(x.value, {_quoted(PLACEHOLDER)}, {chr(39) * 2})')} >= {need}"
    return base, _spans(_uncovered("_base", _matches(text, CANDIDATE), WINDOW), 3, keep)


def scan(docs: DataFrame, text_column: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Every row with _spans array<struct<start, kind, end>>, kind being a place in KINDS."""
    base, added = spans("_text", allowed)
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    found = found.withColumn("_base", F.array_sort(F.concat(*(F.expr(x) for x in base.values()))))
    kept = (F.col(f"_row.`{c}`") for c in docs.columns if c != "_spans")
    return found.select(*kept, F.array_sort(F.concat(F.col("_base"), F.expr(added))).alias("_spans"))


def written(column: str = "_spans", most: int = len(KINDS)) -> Column:
    """kind:start:end of the spans, joined by commas; those of the first `most` kinds."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(filter({column}, x -> x.kind < {most}), x -> concat_ws(':', {names}[x.kind], x.start, x.end)), ',')")


def redacted(text_column: str, column: str = "_spans", mark: str = "[SECRET]") -> Column:
    """Text with each stretch that spans cover replaced by the mark."""
    far = _running(f"transform({column}, x -> x.end)", _LARGEST)
    before = "if(i = 0, 0, f[i - 1])"
    # A piece of the text comes from the blocks that it lies in, so that finding its place costs no more than a block.
    start = f"greatest(p - j * {_BLOCK}, 0)"
    part = f"substring(blocks[j], {start} + 1, least(q - j * {_BLOCK}, {_BLOCK}) - {start})"
    piece = lambda p, q: _let("p", p, _let("q", q, f"if(p >= q, '', array_join(transform(sequence(cast(p div {_BLOCK} as int), cast((q - 1) div {_BLOCK} as int)), j -> {part}), ''))"))
    pieces = f"transform({column}, (x, i) -> if(x.start >= {before}, concat({piece(before, 'x.start')}, '{mark}'), ''))"
    whole = f"array_join(concat({pieces}, array({piece('f[size(f) - 1]', f'length({text_column})')})), '')"
    blocks = f"regexp_extract_all({text_column}, '(?s).{{1,{_BLOCK}}}', 0)"
    return F.expr(f"if(size({column}) = 0, {text_column}, {_let('f', far, _let('blocks', blocks, whole))})")
