"""Secret scans (operator 3): DataFrame functions only.

Base spans come from three patterns (assigned credentials, access keys, long hexadecimal runs).
The randomness test battery adds spans: each long token of one inferred encoding goes through
three tests of its symbols, against what ordinary text in that alphabet would show:

  uniformity   chi-squared of the symbol counts; text, with its uneven letters, scores high. Where
               letters have one case, the likelihood ratio of even letters to those of text
               instead, which has more power in short tokens
  runs         number of runs of one character class; text changes class seldom
  correlation  lag-1 serial correlation of symbol numbers; an ordered or periodic token, which
               the other two take for random, is vetoed by it, as is one that is too uniform, or
               in one case too uneven for chance

The first two give a joint p-value under "this is text", and a document's tokens go through
Benjamini-Hochberg control of false discoveries with weights in proportion to their lengths; the
tokens that have no inferred encoding, or are vetoed, are not among the tested ones. Where letters
have one case, dashes and underscores only part the symbols and are left out.
Each document is judged alone, so nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

#: Shortest token that the battery can tell from text, and the share of false discoveries allowed.
TOKEN_LENGTH = 24
FALSE_SHARE = 0.001
TOKEN = rf"[A-Za-z0-9+/_-]{{{TOKEN_LENGTH},}}"

#: Alphabets by inferred encoding.
HEX_ALPHABET = "0123456789abcdef"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: Of ordinary text's letter frequencies p: sum of p squared, sum of p cubed, chance that the next character has another class.
TEXT_SQUARES, TEXT_CUBES, TEXT_CHANGES = 0.065, 0.0055, 0.15
#: Rough percentages of the letters a to z in text of the tables' languages; none is so low that a few names with q, x or z count as chance.
TEXT_LETTERS = dict(zip(BASE36_ALPHABET[10:], (8.0, 1.6, 3.2, 4.5, 14.0, 1.6, 1.8, 3.5, 7.2, 0.4, 0.7, 4.4, 2.7, 7.8, 6.0, 2.1, 0.5, 6.6, 6.8, 7.0, 4.3, 1.2, 1.3, 0.4, 0.9, 0.6)))

_SPAN = "struct<start:int,kind:int,end:int>"
#: Parts that are put together at a time; a list of parts then costs their number, not its square.
CHUNK = 32

_LETTERS = [list(a) for a in (HEX_ALPHABET, BASE32_ALPHABET, BASE36_ALPHABET, BASE64_ALPHABET)]
_HEX, _BASE32, _BASE36, _BASE64 = 1, 2, 3, 4


# Expressions are written as SQL text: one call makes a tree of any size.


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values: list) -> str:
    """A list of texts or doubles, or of such lists, as a literal."""
    return "array(" + ", ".join(_array(v) if isinstance(v, list) else _quoted(v) if isinstance(v, str) else f"{v!r}D" for v in values) + ")"


def _none(kind: str) -> str:
    return f"cast(array() as array<{kind}>)"


def _once(value: str, name: str, use: str) -> str:
    """use, in which name stands for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _held(rows: DataFrame, **columns: str) -> DataFrame:
    """rows with further columns that later steps, and filters on their results, read as values and never as expressions.

    A generator of one row: the optimizer does not move expressions or filters through it, so
    the plan stays as small as what is written here, however often a column is used.
    """
    made = ", ".join(f"'{name}', {c}" for name, c in columns.items())
    return rows.select("*", F.expr(f"inline(array(named_struct({made})))"))


def _chunks(parts: str) -> str:
    return f"transform(sequence(0, greatest(cast((size({parts}) - 1) div {CHUNK} as int), 0)), chunk -> slice({parts}, chunk * {CHUNK} + 1, {CHUNK}))"


def _running(parts: str, to: str, result: str, kind: str) -> str:
    """For each part x, result, an expression of x and at, the sum so far; to: the sum after x. kind: the type of a result.

    First come the sums at which chunks begin, then each chunk's results by themselves.
    """
    begun = "aggregate(chunks, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, xs) -> named_struct('at', aggregate(xs, s.at, (at, x) -> {0}), 'out', concat(s.out, array(s.at))), s -> s.out)".format(to)
    step = f"named_struct('at', {_once('t.at', 'at', to)}, 'out', concat(t.out, array({_once('t.at', 'at', result)})))"
    whole = f"flatten(zip_with(chunks, {begun}, (xs, first) -> aggregate(xs, named_struct('at', first, 'out', {_none(kind)}), (t, x) -> {step}, t -> t.out)))"
    return _once(parts, "parts", f"case when size(parts) > 0 then {_once(_chunks('parts'), 'chunks', whole)} else {_none(kind)} end")


def matches(text: str, pattern: str, kind: int, group: int, least: int, hint: str) -> str:
    """Spans of a pattern's leftmost non-overlapping matches whose group has enough characters.

    The pieces between matches come from split(), the matches from regexp_extract_all(); their
    lengths in turn give the places. hint: a cheap pattern without which there is no match.
    """
    p = _quoted(pattern)
    lengths = f"arrays_zip(transform(split({text}, {p}), y -> length(y)), transform(regexp_extract_all({text}, {p}, 0), y -> length(y)), transform(regexp_extract_all({text}, {p}, {group}), y -> length(y)))"
    parts = f"filter(transform({lengths}, y -> named_struct('gap', y['0'], 'n', y['1'], 'own', y['2'])), y -> y.n is not null)"
    span = f"named_struct('start', at + x.gap, 'kind', if(x.own >= {least}, {kind}, null), 'end', at + x.gap + x.n)"
    return f"case when {text} rlike {_quoted(hint)} then filter({_running(parts, 'at + x.gap + x.n', span, _SPAN)}, y -> y.kind is not null) else {_none(_SPAN)} end"


def discoveries(text: str) -> str:
    """All long tokens with their places."""
    p, kind = _quoted(TOKEN), "struct<start:int,t:string>"
    zipped = f"arrays_zip(transform(split({text}, {p}), y -> length(y)), regexp_extract_all({text}, {p}, 0))"
    parts = f"filter(transform({zipped}, y -> named_struct('gap', y['0'], 't', y['1'])), y -> y.t is not null)"
    return f"case when {text} rlike {p} then {_running(parts, 'at + x.gap + length(x.t)', 'named_struct({0}start{0}, at + x.gap, {0}t{0}, x.t)'.format(chr(39)), kind)} else {_none(kind)} end"


def _text_facts(alphabet: list[str]) -> tuple[list[float], list[float], float, float]:
    """Of an alphabet with letters of one case: which symbols are letters, log-likelihood ratios of even letters to text's, their mean and deviation under text."""
    of = [TEXT_LETTERS.get(c.lower(), 0.0) for c in alphabet]
    even, total = sum(p > 0 for p in of), sum(of)
    ratio = [math.log(total / (even * p)) if p else 0.0 for p in of]
    mean = sum(p * r for p, r in zip(of, ratio)) / total
    return [float(p > 0) for p in of], ratio, mean, (sum(p * r * r for p, r in zip(of, ratio)) / total - mean * mean) ** 0.5


def _encoding(t: str) -> str:
    """Number of the encoding that the token's characters allow; null where none is inferred."""
    return f"""case when {t} rlike '^[0-9a-fA-F_-]+$' and {t} rlike '[0-9]' and {t} rlike '[a-fA-F]' then {_HEX}
        when {t} rlike '^[A-Z2-7_-]+$' and {t} rlike '[2-7]' and {t} rlike '[A-Z]' then {_BASE32}
        when ({t} rlike '^[0-9a-z_-]+$' or {t} rlike '^[0-9A-Z_-]+$') and {t} rlike '[0-9]' and {t} rlike '[a-zA-Z]' then {_BASE36}
        when {t} rlike '[0-9]' and {t} rlike '[A-Z]' and {t} rlike '[a-z]' then {_BASE64} end"""


def _z(t: str) -> str:
    """Evidence against text as a z-score; null where no encoding is inferred, or the token looks ordered, too uniform or too uneven."""
    bare = f"translate({t}, '-_', '')"
    symbols = f"case e when {_BASE64} then translate({t}, '-_', '+/') when {_BASE32} then {bare} else lower({bare}) end"
    return _once(_encoding(t), "e", f"case when e is not null then {_once(symbols, 's', _battery())} end")


def _battery() -> str:
    """The three tests of a token's symbols s in encoding e; the alphabet is data, so there is one tree for all encodings. Time is linear in the token's length."""
    of = lambda table: f"element_at({_array(table)}, e)"
    dot = lambda table: f"aggregate(zip_with(counts, {of(table)}, (c, w) -> c * w), 0D, (a, c) -> a + c)"
    size, facts = of([float(len(a)) for a in _LETTERS]), [_text_facts(a) for a in _LETTERS]
    counts = f"transform({of(_LETTERS)}, c -> cast(length(s) - length(replace(s, c, '')) as double))"
    # under randomness: Wilson-Hilferty, k degrees of freedom; far below is more even than chance
    even = _once(f"{size} - 1", "k", "(power(greatest(chi, 0D) / k, 1D / 3) - (1 - 2 / (9 * k))) / sqrt(2 / (9 * k))")
    odd = _once(even, "x", f"x < -4 or (e <> {_BASE64} and x > 5)")
    # under text: mean and deviation of the statistic from the letter frequencies
    mixed = f"({size} - 1 + n * ({size} * {TEXT_SQUARES}D - 1) - chi) / (2 * {size} * sqrt(n * {TEXT_CUBES - TEXT_SQUARES**2!r}D))"
    likely = _once(dot([f[0] for f in facts]), "m", f"({dot([f[1] for f in facts])} - m * {of([f[2] for f in facts])}) / (sqrt(m) * {of([f[3] for f in facts])})")
    uniform = f"case when e = {_BASE64} then {mixed} else {likely} end"
    kinds = f"translate(s, '{BASE64_ALPHABET}', '{'u' * 26 + 'l' * 26 + '0' * 10 + 'oo'}')"
    changing = f"(regexp_count({kinds}, 'u+|l+|0+|o+') - 1 - (n - 1) * {TEXT_CHANGES}D) / sqrt((n - 1) * {TEXT_CHANGES * (1 - TEXT_CHANGES)!r}D)"
    # sums of the symbols' numbers, of their squares, and of their products with the next
    numbers = of([[float(i + 1) for i in range(len(a))] for a in _LETTERS])
    places = f"transform(split(s, ''), c -> cast(instr({of([''.join(a) for a in _LETTERS])}, c) as double))"
    product = "aggregate(zip_with(at, slice(at, 2, size(at)), (x, y) -> coalesce(x * y, 0D)), 0D, (a, x) -> a + x)"
    cov = f"{product} - mean * (2 * n * mean - at[0] - element_at(at, -1)) + (n - 1) * mean * mean"
    var = f"aggregate(zip_with(counts, {numbers}, (c, x) -> c * x * x), 0D, (a, c) -> a + c) - n * mean * mean"
    mean = f"aggregate(zip_with(counts, {numbers}, (c, x) -> c * x), 0D, (a, c) -> a + c) / n"
    ordered = _once(mean, "mean", _once(places, "at", _once(var, "v", f"abs({cov}) * sqrt(n) > 4 * v or v <= 1e-9")))
    judged = f"case when not ({odd} or {ordered}) then ({uniform} + {changing}) / sqrt(2D) end"
    chi = f"aggregate(counts, 0D, (a, c) -> a + c * c) * {size} / n - n"
    return _once("cast(length(s) as double)", "n", _once(counts, "counts", _once(chi, "chi", judged)))


def _controlled(tested: str) -> str:
    """Spans that weighted Benjamini-Hochberg keeps, of an array of (start, n, z) of tested tokens."""
    mean = f"aggregate({tested}, 0D, (s, x) -> s + x.n) / size({tested})"
    # an upper bound of the normal tail, weighted by length
    ranked = f"array_sort(transform({tested}, x -> named_struct('p', if(x.z > 0, 0.5D * exp(-x.z * x.z / 2), 1D) * mean / x.n, 'start', x.start, 'n', x.n)))"
    level = f"array_max(filter(transform(ranked, (x, i) -> if(x.p <= (i + 1) * {FALSE_SHARE}D / size({tested}), x.p, null)), p -> p is not null))"
    below = "transform(filter(ranked, x -> x.p <= level), x -> named_struct('start', x.start, 'kind', 3, 'end', x.start + x.n))"
    kept = _once(_once(mean, "mean", ranked), "ranked", _once(level, "level", below))
    return f"case when size({tested}) > 0 then {kept} else {_none(_SPAN)} end"


def spans(docs: DataFrame) -> DataFrame:
    """docs, which has a string column text, with scan_base and scan_all: arrays of (start, kind, end) in code points, ordered by start, then kind.

    A null text counts as empty; a document without matches has empty arrays. Two spans may
    overlap; an added span that overlaps a base one is left out.
    """
    rows = _held(docs, scan_text="coalesce(text, '')")
    rows = _held(
        rows,
        scan_a=matches("scan_text", ASSIGN, 0, 2, LEAST["assign"], r"(?i)password|passwd|secret|token|api_?key"),
        # a run of at least the length is the same as a run that is long enough
        scan_b=matches("scan_text", rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1, 0, LEAST["access"], "AKIA"),
        scan_c=matches("scan_text", rf"[0-9a-f]{{{LEAST['hex']},}}", 2, 0, LEAST["hex"], rf"[0-9a-f]{{{LEAST['hex']}}}"),
        scan_t=discoveries("scan_text"),
    )
    tested = f"filter(transform(scan_t, y -> named_struct('start', y.start, 'n', length(y.t), 'z', {_z('y.t')})), y -> y.z is not null)"
    rows = _held(rows, scan_base="array_sort(concat(scan_a, scan_b, scan_c))", scan_z=tested)
    rows = _held(rows, scan_added=_controlled("scan_z"))
    free = "filter(scan_added, x -> not exists(scan_base, b -> b.start < x.end and x.start < b.end))"
    rows = _held(rows, scan_all=f"array_sort(concat(scan_base, {free}))")
    return rows.drop("scan_text", "scan_a", "scan_b", "scan_c", "scan_t", "scan_z", "scan_added")


def joined(found: str) -> str:
    """kind:start:end, joined by commas."""
    return f"array_join(transform({found}, s -> concat(element_at({_array(list(KINDS))}, s.kind + 1), ':', s.start, ':', s.end)), ',')"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every document.

    Null and empty texts have no spans; repeated rows have a row each; an empty table gives no
    rows; columns other than doc_id and text are not read.
    """
    rows = spans(common.take(docs, doc_id="long", text="string"))
    count = lambda of, k: f"cast(size(filter({of}, s -> s.kind = {k})) as bigint)"
    found = {f"n_{KINDS[k]}": count("scan_base", k) for k in range(3)}
    found |= {"base_sha256": f"sha2(cast({joined('scan_base')} as binary), 256)", "spans": joined("scan_all"), "n_random": count("scan_all", 3)}
    return _held(rows, **found).select("doc_id", *found)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs, with each stretch of text that spans cover replaced by a mark; all else, and every other column, as it is."""
    held = f"c{common.place(docs, 'text')}"
    rows = spans(common.plain(docs).withColumn("text", F.col(held).cast("string")))
    # of each span: characters to keep before it, how many it takes with them, whether it is marked
    cut = "named_struct('gap', greatest(x.start - at, 0), 'n', greatest(at, x.end) - at, 'fresh', x.start >= at)"
    rows = _held(rows, scan_cut=_running("scan_all", "greatest(at, x.end)", cut, "struct<gap:int,n:int,fresh:boolean>"))
    # a chunk of spans is cut from its own stretch of text, so no cut goes through all that is left
    one = f"named_struct('rest', substring(t.rest, x.n + 1), 'out', concat(t.out, array(concat(left(t.rest, x.gap), if(x.fresh, {_quoted(mark)}, '')))))"
    inner = f"array_join(aggregate(xs, named_struct('rest', left(s.rest, n), 'out', {_none('string')}), (t, x) -> {one}).out, '')"
    more = _once("aggregate(xs, 0, (a, x) -> a + x.n)", "n", f"named_struct('rest', substring(s.rest, n + 1), 'out', concat(s.out, array({inner})))")
    clean = f"aggregate({_chunks('scan_cut')}, named_struct('rest', text, 'out', {_none('string')}), (s, xs) -> {more}, s -> concat(array_join(s.out, ''), s.rest))"
    rows = _held(rows, scan_clean=f"case when size(scan_cut) > 0 then {clean} else text end")
    return rows.withColumn(held, F.col("scan_clean")).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
