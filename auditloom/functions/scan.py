"""Text scanning: clauses with spans, a scanner for tables of patterns, stances, and the parts of claims.

Arrow helpers find where the patterns of a table, or the words of a list (by one automaton), match in
a text's clauses; texts and clauses
without a word that a match needs are left out before, texts by one test of a whole batch. What a match means (stance, severity, metric,
product, period, version) are column expressions over its row. Places count characters from 0.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import lexicons as lx
from .text import let

#: Java reads \s, \d and \w as Python does with this flag.
UNICODE = "(?U)"
MATCH = "nth int, quote string, line string, start int, stop string, entry int, k int, seen long, at int, g1 string, g2 string, g3 string, reported boolean, context string, may int"

#: Bits of may: what a row's clause may have, by a test of all rows at once that leaves nothing out; where it says no, the pattern proper is not tried.
MAY_DENY, MAY_EDITION, MAY_PEOPLE, MAY_TERMS, MAY_PRODUCT, HAS_PRODUCT = (1 << i for i in range(6))
#: For each bit, the column that is tested (its place in MATCH) and what any match of the pattern proper has; for the last one, the pattern itself, so it says yes only where the clause surely names a product (\\s is ASCII here).
MAY = [(1, "[不无非]|没有|未见|错误|虚假"), (2, "[版代]"), (2, lx.PEOPLE), (2, lx.TERMS), (1, "产品|【"), (1, lx.PRODUCT)]


def _either(words) -> str:
    """A pattern of any of the words, which have no special characters but % and such."""
    return "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", w) for w in words)


def clause_spans(text: Column) -> Column:
    """Array of (quote, start, end): what lies between ends of sentences, empty clauses aside."""
    def spans(texts: pa.Array) -> pa.Array:
        parts = pc.split_pattern_regex(texts, f"[{lx.STOPS}]")
        flat, offsets = parts.flatten(), parts.offsets.to_numpy()
        sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(sizes + 1)])
        rows = np.repeat(np.arange(len(parts)), np.diff(offsets))
        start = before[:-1] - before[offsets[rows]]
        full = sizes > 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows[full], minlength=len(parts)))]).astype(np.int32)
        cells = pa.StructArray.from_arrays([flat.filter(pa.array(full)), pa.array(start[full].astype(np.int32)), pa.array((start + sizes)[full].astype(np.int32))], ["quote", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends), cells)

    return F.arrow_udf(spans, "array<struct<quote string, start int, end int>>")(F.coalesce(text, F.lit("")))


_QUOTED, _NEAR, _CLAUSE = re.compile(lx.QUOTED), re.compile(f"{lx.REPORTING}|{lx.UNTRUE}"), re.compile(f"[^{lx.STOPS}]+")


def _reported(text: str) -> list[tuple[int, int]]:
    """Spans of quotes with a word of reporting or of denial near them."""
    return [q.span() for q in _QUOTED.finditer(text) if _NEAR.search(text, max(0, q.start() - 16), q.start()) or _NEAR.search(text, q.end(), q.end() + 12)]


def _scanner(patterns: list[tuple[str, tuple[str, ...]]], hint: str, compatible: bool) -> Callable[[pa.Array], pa.Array]:
    """From texts to lists of MATCH rows: what each pattern of the table finds in the clauses that hint matches and that have one of the pattern's words.

    Which patterns have a word anywhere in a text is found for all texts at once, so that a clause
    meets these alone.
    """
    table, need = [(re.compile(p), words) for p, words in patterns], re.compile(hint)

    def of_text(text: str, plain: bool, some: list[int]) -> list[tuple]:
        rows, spans = [], None
        for nth, c in enumerate(_CLAUSE.finditer(text)):
            quote, start, seen, needed = c[0], c.start(), 0, False
            line = quote if plain else unicodedata.normalize("NFKC", quote)
            for i in some:
                pattern, words = table[i]
                for w in words:
                    if w in line:
                        break
                else:
                    continue
                if not needed and not need.search(quote):
                    break
                needed, before = True, seen
                for k, m in enumerate(pattern.finditer(line)):
                    spans = _reported(text) if spans is None else spans
                    own = m.start()
                    at = start + own
                    groups = (*m.groups(), None, None, None)[:3]
                    rows.append((nth, quote, line, start, text[c.end() : c.end() + 1], i, k, before, own, *groups, any([a < at < b for a, b in spans]), text[max(0, at - 12) : at + len(m[0]) + 12]))
                    seen |= 1 << i
        return rows

    def scan(texts: pa.Array) -> pa.Array:
        has = pc.fill_null(pc.match_substring_regex(texts, hint), False)
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        few = texts.filter(has)
        given = few.to_pylist()
        plain = [not compatible or unicodedata.is_normalized("NFKC", t) for t in given]
        lines = few if all(plain) else pa.array([t if p else unicodedata.normalize("NFKC", t) for t, p in zip(given, plain, strict=True)], pa.string())
        some: list[list[int]] = [[] for _ in given]
        for i, (_, words) in enumerate(table):
            if words:
                for at in np.flatnonzero(pc.match_substring_regex(lines, _either(words)).to_numpy(zero_copy_only=False)).tolist():
                    some[at].append(i)
        for at, t, p, own in zip(np.flatnonzero(has.to_numpy(zero_copy_only=False)).tolist(), given, plain, some, strict=True):
            out[at] = of_text(t, p, own) if own else []
        return _listed(out)

    return scan


def _listed(found: list[list[tuple]]) -> pa.Array:
    """Lists of MATCH rows as Arrow's."""
    names = [x.split()[0] for x in MATCH.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in MATCH.split(", ")]
    offsets = np.concatenate([[0], np.cumsum([len(rows) for rows in found])]).astype(np.int32)
    cols = list(zip(*(r for rows in found for r in rows), strict=True)) or [()] * (len(names) - 1)
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds[:-1], strict=True)]
    may = np.zeros(len(arrays[0]), np.int32)
    for bit, (place, pattern) in enumerate(MAY):
        may |= pc.match_substring_regex(arrays[place], pattern).to_numpy(zero_copy_only=False).astype(np.int32) << bit
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*arrays, pa.array(may)], names))


def may(row: Column, bit: int) -> Column:
    return row["may"].bitwiseAND(F.lit(bit)) != 0


@lru_cache(8)
def _automaton(words: tuple[str, ...]):
    """Of all words, each with its entries; built once in a Python worker. None without words."""
    import ahocorasick

    entries: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        entries.setdefault(w, []).append(i)
    entries.pop("", None)
    out = ahocorasick.Automaton()
    for w, own in entries.items():
        out.add_word(w, (len(w), own))
    out.make_automaton()
    return out if entries else None


def _words_of(text: str, words: tuple[str, ...]) -> list[tuple]:
    """MATCH rows of words: one pass over the text, whatever the number of words. Matches across ends of clauses don't count, nor do those of a word that overlap its match before."""
    automaton = _automaton(words)
    hits = [(end - n + 1, end + 1, i) for end, (n, own) in automaton.iter(text) for i in own] if automaton else []
    if not hits:
        return []
    clauses = list(_CLAUSE.finditer(text))
    starts, spans = [c.start() for c in clauses], _reported(text)
    inside = []
    for at, end, i in hits:
        nth = bisect_right(starts, at) - 1
        if nth >= 0 and end <= clauses[nth].end():
            inside.append((nth, i, at, end))
    rows, last, k = [], None, 0
    for nth, i, at, end in sorted(inside):
        k = k + 1 if last and last[:2] == (nth, i) else 0
        if k and at < last[2]:
            k -= 1
            continue
        last, c = (nth, i, end), clauses[nth]
        rows.append((nth, c[0], c[0], c.start(), text[c.end() : c.end() + 1], i, k, 0, at - c.start(), None, None, None, any(a < at < b for a, b in spans), text[max(0, at - 12) : end + 12]))
    return rows


#: Words beyond which texts reach the automaton without a test of all texts at once.
TESTED_WORDS = 200


def words_found(text: Column, words: list[str]) -> Column:
    """Array of MATCH rows for words, in the order of clause, word and place; seen is 0."""
    own = tuple(words)
    tested = _either(dict.fromkeys(w for w in own if w)) if 0 < len(own) <= TESTED_WORDS else ""

    def scan(texts: pa.Array) -> pa.Array:
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        has = pc.fill_null(pc.match_substring_regex(texts, tested), False)
        for at, t in zip(np.flatnonzero(has.to_numpy(zero_copy_only=False)).tolist(), texts.filter(has).to_pylist(), strict=True):
            out[at] = _words_of(t, own)
        return _listed(out)

    return F.arrow_udf(scan, f"array<struct<{MATCH}>>")(text)


def found(text: Column, patterns: list[tuple[str, tuple[str, ...]]], hint: str, compatible: bool = False) -> Column:
    """Array of MATCH rows for the patterns of a table; texts that hint does not match have none: Arrow tests all texts of a batch at once."""
    return F.arrow_udf(_scanner(patterns, hint, compatible), f"array<struct<{MATCH}>>")(text)


def stance(row: Column) -> Column:
    """asserted, negated, quoted or question, of a MATCH row; negation goes first, then quotes."""
    denied = F.left(row["quote"], row["at"]).rlike(rf"{UNICODE}(?:{lx.DENIALS})\s*(?:(?:{lx.ACTIONS})\s*)?\z") | F.substring(row["quote"], row["at"] + 1, F.length(row["quote"])).rlike(lx.FALSE_TAIL)
    return F.when(may(row, MAY_DENY) & denied, "negated").when(row["reported"], "quoted").when(row["stop"].isin("？", "?"), "question").otherwise("asserted")


def scanned(text: Column, words: dict[str, list[str]] | None = None, severity: dict[str, str] | None = None, review: str = lx.REVIEW_WORD) -> Column:
    """Lexicon hits that are asserted or asked; a word in two categories is a hit of each."""
    words, severity = words or lx.CLAIM_WORDS, severity or lx.CLAIM_SEVERITY
    entries = [(category, word) for category, ws in words.items() for word in ws]
    columns = [F.array(*map(F.lit, xs)) for xs in ([c for c, _ in entries], [w for _, w in entries], [severity[c] for c, _ in entries])]
    rows = F.transform(words_found(text, [w for _, w in entries]), lambda r: F.struct(r["entry"].alias("entry"), stance(r).alias("stance"), (r["start"] + r["at"]).alias("position"), r["context"].alias("context")))

    def hit(r: Column) -> Column:
        category, word, level = (F.get(c, r["entry"]) for c in columns)
        return F.struct(category.alias("category"), word.alias("word"), F.when((r["stance"] == "question") | (word == review), "review").otherwise(level).alias("severity"), r["stance"].alias("stance"), r["position"].alias("position"), r["context"].alias("context"))

    return F.transform(F.filter(rows, lambda r: r["stance"].isin("asserted", "question")), hit)


def marked(text: Column, markers: list[str], negations: list[str] | None = None) -> Column:
    """Distinct markers in the order of place, the first one's place and context, and how many were denied or not asserted."""
    before, names = rf"(?:{_either(negations or lx.MARKER_NEGATIONS)})\z", F.array(*map(F.lit, markers))
    rows = F.transform(words_found(F.coalesce(text, F.lit("")), markers), lambda r: F.struct(
        (r["start"] + r["at"]).alias("at"), r["entry"].alias("entry"), (~F.left(r["quote"], r["at"]).rlike(before) & (stance(r) == "asserted")).alias("good"), r["context"].alias("context")))

    def merged(rs: Column) -> Column:
        good = F.filter(rs, lambda r: r["good"])
        first = F.get(good, F.lit(0))
        return F.struct(F.array_distinct(F.transform(good, lambda r: F.get(names, r["entry"]))).alias("words"), first["at"].alias("position"), first["context"].alias("context"), (F.coalesce(F.size(rs), F.lit(0)) - F.size(good)).alias("denied"))

    return let(F.array_sort(rows), merged)


def is_disclosed(text: Column) -> Column:
    """Is the material disclosed as an AI illustration: a match whose stance is asserted. Line ends inside a match count as blanks."""
    flat = F.regexp_replace(text, r"(?i)(?<=AI|智能|生成|生成式|合成|绘制|图|[（(])[\n\s]+(?=AI|人工智能|示意|效果图|模拟|演示|[（(])", " ")
    rows = found(flat, [(f"(?i){lx.DISCLOSED}", ("示意", "效果图", "模拟", "演示"))], "示意|效果图|模拟|演示")
    return F.when(text.isNotNull(), F.exists(rows, lambda r: stance(r) == "asserted"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"{UNICODE}\A\s+|\s+\z", "")


def names_product(text: Column, name: Column) -> Column:
    """Does the text name the product as a whole: no word character before it, no letter or ideograph after it."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z一-鿿])"))
    return F.coalesce((name != "") & F.contains(text, name) & F.rlike(text, pattern), F.lit(False))


def declared_product(text: Column) -> Column:
    """The one product that a text declares, or null."""
    groups = [F.regexp_extract_all(text, F.lit(UNICODE + lx.PRODUCT), F.lit(i)) for i in (1, 2)]
    names = F.array_distinct(F.transform(F.filter(F.concat(*groups), lambda x: x != ""), stripped))
    return F.when(text.rlike(UNICODE + lx.PRODUCT), let(names, lambda ns: F.when(F.size(ns) == 1, ns[0])))


def product_of(row: Column, known: Column) -> Column:
    """The product of a MATCH row's clause: its own, or the known one where the clause names it."""
    quote = row["quote"]
    named, declared = (F.regexp_extract(quote, UNICODE + lx.PRODUCT, i) for i in (2, 1))
    own = stripped(let(named, lambda x: F.when(x != "", x).otherwise(declared)))  # one of the groups is empty
    return F.when(may(row, HAS_PRODUCT), own).when(may(row, MAY_PRODUCT) & quote.rlike(UNICODE + lx.PRODUCT), own).when(names_product(quote, known), known)


def _all(line: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(line, F.lit(UNICODE + pattern), F.lit(group))


def days_of(line: Column) -> Column:
    """The one period of a clause in days, or null."""
    def days(period: Column) -> Column:
        return F.regexp_extract(period, r"\A[0-9.]+", 0).cast("double") * F.when(F.right(period, F.lit(1)) == "周", 7).otherwise(1)

    def one(periods: Column) -> Column:
        each = let(F.array_distinct(F.transform(periods, days)), lambda ds: F.when(F.size(ds) == 1, ds[0]))
        return F.when(F.size(periods) == 1, days(F.get(periods, F.lit(0)))).when(F.size(periods) > 1, each)

    return let(_all(line, lx.PERIOD), one)


def version_of(line: Column) -> Column:
    """The one product version of a clause, ambiguous, or null."""
    found = let(F.array_distinct(_all(line, lx.EDITION)), lambda vs: F.when(F.size(vs) == 1, vs[0]).otherwise("ambiguous"))
    return F.when(line.rlike(UNICODE + lx.EDITION), found)


def sorted_set(line: Column, pattern: str) -> Column:
    return F.when(line.rlike(pattern), F.array_sort(F.array_distinct(_all(line, pattern)))).otherwise(F.array().cast("array<string>"))


#: The table of patterns of claims: metrics with a number, then what else is claimed.
CLAIMS = [
    *((f"(?i){p}", words) for (_, p, _), words in zip(lx.MEASURES, lx.MEASURE_WORDS, strict=True)), (f"(?i){lx.SHADE}", ("色号", "色號", "#")), (lx.PLAIN_EFFECT, tuple(lx.PLAIN_EFFECT.split("|"))),
    (lx.BEFORE_AFTER, ("前后", "效果对比", "功效对比")), (lx.UNEDITED, tuple(lx.UNEDITED.split("|"))),
]


#: Texts of these characters, without quotes, are scanned by Arrow for all clauses of a batch: of their white space only the blank and the line end occur, their compatible form has as many characters, and both readers of patterns see them alike.
PLAIN = r"\A[\n -!#-~一-鿿。、【】《》！-～]*\z"
#: What claim_rows gives for each match: MATCH without seldom used fields, and what Arrow finds of a plain text's clause: own (the product that it names), periods (how many; null: not known) and days of the only one, trim (may the quote have white space at an end).
CLAIM_ROW = "nth int, quote string, line string, start int, stop string, entry int, k int, seen long, at int, g1 string, g2 string, g3 string, reported boolean, may int, own string, periods int, days double, trim boolean, known string"
_ROW = [(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]]) for x in CLAIM_ROW.split(", ")]


def _groups(pattern: str) -> str:
    """The pattern with names for its groups, after what stands before its first match (pre)."""
    nth = iter(range(1, 99))
    named = re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?P<g{next(nth)}>", pattern.removeprefix("(?i)"))
    return f"(?{'i' if pattern.startswith('(?i)') else ''}s)\\A(?P<pre>.*?)(?:{named})"


_GROUPS, _PRODUCT, _PERIOD = {}, _groups(lx.PRODUCT), _groups(lx.PERIOD)
#: White space as Java's (?U)\s has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_DECLARED = re.compile(lx.PRODUCT.replace(r"\s", f"[{_SPACE}]"))


def _declared(text: str) -> str | None:
    """declared_product() of one text."""
    names = {re.sub(rf"\A[{_SPACE}]+|[{_SPACE}]+\Z", "", x) for found in _DECLARED.findall(text) for x in found if x}
    return names.pop() if len(names) == 1 else None


def _flags(mask: pa.Array) -> np.ndarray:
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


def _plain_claims(texts: pa.Array, patterns: list[tuple[str, tuple[str, ...]]], hint: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Matches in plain texts, by Arrow for all clauses at once: which texts have a pattern twice in a clause (their matches don't count), each match's text, and its CLAIM_ROW but may and known."""
    parts = pc.split_pattern_regex(texts, f"[{lx.STOPS}]")
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), np.diff(offsets))
    before = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    codes = np.frombuffer("\n".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    full = sizes > 0
    nth = np.cumsum(full) - 1
    nth -= (np.concatenate([[0], np.cumsum(full)])[offsets[:-1]])[owner]
    start, after = before - before[offsets[:-1]][owner], before + sizes
    last = np.zeros(len(flat), bool)
    last[offsets[1:] - 1] = True
    keep = full & _flags(pc.match_substring_regex(flat, hint))
    quote, owner, nth, start, after, last, sizes = flat.filter(pa.array(keep)), owner[keep], nth[keep], start[keep], after[keep], last[keep], sizes[keep]
    wide = pc.match_substring_regex(quote, "[！-～]")
    line = pc.replace_with_mask(quote, wide, pa.array([unicodedata.normalize("NFKC", q) for q in quote.filter(wide).to_pylist()], pa.string()))
    seen, twice, found = np.zeros(len(quote), np.int64), np.zeros(len(texts), bool), []
    for i, (pattern, words) in enumerate(patterns):
        at = np.flatnonzero(_flags(pc.match_substring_regex(line, _either(words))))
        n = pc.count_substring_regex(line.take(pa.array(at)), pattern).to_numpy(zero_copy_only=False)
        twice[owner[at[n > 1]]] = True
        at = at[n == 1]
        if len(at):
            got = pc.extract_regex(line.take(pa.array(at)), _GROUPS.get(pattern) or _GROUPS.setdefault(pattern, _groups(pattern)))
            names = [f.name for f in got.type]
            groups = [pc.struct_field(got, g) if g in names else pa.nulls(len(at), pa.string()) for g in ("g1", "g2", "g3")]
            found.append((at, np.full(len(at), i, np.int32), seen[at], pc.utf8_length(pc.struct_field(got, "pre")).to_numpy(zero_copy_only=False), groups))
            seen[at] |= 1 << i
    if not found:
        return twice, np.zeros(0, np.int64), pa.table({n: pa.array([], k) for n, k in _ROW})
    at = np.concatenate([f[0] for f in found])
    some = pa.array(at)
    product, period, periods = pc.extract_regex(quote, _PRODUCT), pc.extract_regex(line, _PERIOD), pc.count_substring_regex(line, lx.PERIOD)
    declared, named = (pc.struct_field(product, g) for g in ("g1", "g2"))  # one of them is empty; null where nothing matches
    one = pc.if_else(pc.not_equal(named, ""), named, declared)
    days = pc.multiply(pc.cast(pc.struct_field(period, "g1"), pa.float64()), pc.if_else(pc.equal(pc.struct_field(period, "g2"), "周"), 7.0, 1.0))
    single = pc.equal(periods, 1)
    stop = np.where(last[at], 0, codes[np.minimum(after[at], max(len(codes) - 1, 0))])
    chars = {int(c): chr(c) if c else "" for c in np.unique(stop)}
    cols = {
        "nth": nth[at], "quote": quote.take(some), "line": pc.if_else(wide, line, None).take(some), "start": start[at], "stop": [chars[c] for c in stop.tolist()], "entry": np.concatenate([f[1] for f in found]), "k": np.zeros(len(at)), "seen": np.concatenate([f[2] for f in found]),
        "at": np.concatenate([f[3] for f in found]), **{g: pa.concat_arrays([f[4][j] for f in found]) for j, g in enumerate(("g1", "g2", "g3"))}, "reported": np.zeros(len(at), bool), "may": np.zeros(len(at)),
        "own": pc.utf8_trim(one, " ").take(some), "periods": periods.take(some), "days": pc.if_else(single, days, None).take(some), "trim": pc.match_substring_regex(quote, r"\A | \z").take(some), "known": pa.nulls(len(at), pa.string()),
    }
    return twice, owner[at], pa.table({n: c if isinstance(c := cols[n], pa.Array | pa.ChunkedArray) and c.type == k else pa.array(c).cast(k) for n, k in _ROW})


def _claims_of(texts: pa.Array, given: pa.Array, patterns: list[tuple[str, tuple[str, ...]]], hint: str, plain: str) -> tuple[np.ndarray, pa.Table]:
    """Each match's text and its CLAIM_ROW: of plain texts by Arrow, of others clause by clause."""
    texts, given = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (texts, given))
    has = _flags(pc.match_substring_regex(texts, hint))
    easy = np.flatnonzero(has & _flags(pc.match_substring_regex(texts, plain)))
    parts, hard = [], has.copy()
    if len(easy):
        twice, owner, rows = _plain_claims(texts.take(pa.array(easy)), patterns, hint)
        good = ~twice[owner]
        parts.append((easy[owner[good]], rows.filter(pa.array(good))))
        hard[easy[~twice]] = False
    at = np.flatnonzero(hard)
    if len(at):
        lists = _scanner(patterns, hint, True)(texts.take(pa.array(at)))
        cells = lists.flatten()
        cols = {f.name: cells.field(f.name) for f in cells.type}
        rows = pa.table({n: cols[n] if n in cols else pa.array([True] * len(cells)) if n == "trim" else pa.nulls(len(cells), k) for n, k in _ROW})
        parts.append((np.repeat(at, np.diff(lists.offsets.to_numpy())), rows))
    if not parts:
        return np.zeros(0, np.int64), pa.table({n: pa.array([], k) for n, k in _ROW})
    owner, rows = np.concatenate([p[0] for p in parts]), pa.concat_tables([p[1] for p in parts]).combine_chunks()
    may = np.zeros(len(rows), np.int32)
    quote, line = rows["quote"], pc.coalesce(rows["line"], rows["quote"])
    for bit, (place, pattern) in enumerate(MAY):
        may |= _flags(pc.match_substring_regex((quote, line)[place - 1], pattern)).astype(np.int32) << bit
    # what the whole text declares is asked only where a clause names no product itself
    lost = np.flatnonzero(may & HAS_PRODUCT == 0)
    known: list[str | None] = [None] * len(rows)
    if len(lost):
        asked = np.unique(owner[lost])
        declared = dict(zip(asked.tolist(), (g or _declared(t) for g, t in zip(given.take(pa.array(asked)).to_pylist(), texts.take(pa.array(asked)).to_pylist(), strict=True)), strict=True))
        for i in lost.tolist():
            known[i] = declared[owner[i]]
    names = [n for n, _ in _ROW]
    return owner, rows.set_column(names.index("may"), "may", pa.array(may)).set_column(names.index("known"), "known", pa.array(known, pa.string()))


def claim_rows(rows: DataFrame, keys: list[str], plain: str = PLAIN) -> DataFrame:
    """keys and, for each match of CLAIMS in _text, CLAIM_ROW, its names with an underscore before; known is _given or the declared product, where a clause names none. line is null where it is the quote."""
    out = StructType([*rows.select(*keys).schema.fields, *(StructField(f"_{f.name}", f.dataType) for f in StructType.fromDDL(CLAIM_ROW))])
    n, patterns, hint = len(keys), CLAIMS, lx.CLAIM_HINT

    def scan(batches):
        for b in batches:
            owner, found = _claims_of(b.column(n), b.column(n + 1), patterns, hint, plain)
            for at in range(0, len(owner), 1 << 14):
                some, part = pa.array(owner[at : at + (1 << 14)]), found.slice(at, 1 << 14)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(some) for i in range(n)), *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in part.columns)], out.names)

    return rows.select(*keys, "_text", "_given").mapInArrow(scan, out)


def stated(row: Column) -> dict[str, Column]:
    """metric, variant, value, shade, unit and timed (may it have a period) of a MATCH row of CLAIMS, and is it a claim at all.

    Effect words are claims only in a clause without a number, and of real pictures the first one counts.
    """
    n = len(lx.MEASURES)
    shade, effect, pair, plain = range(n, n + 4)
    entry, metric, value, unit, variant = row["entry"], F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, _, groups) in enumerate(lx.MEASURES):
        own = entry == i
        metric, value, unit = F.when(own, name).otherwise(metric), F.when(own, row[f"g{groups['value']}"]).otherwise(value), F.when(own, row[f"g{groups['unit']}"]).otherwise(unit)
        variant = F.when(own, row[f"g{groups['variant']}"]).otherwise(variant) if "variant" in groups else variant
    metric = F.when(entry == shade, "色号").when(entry == effect, F.substring(row["line"], row["at"] + 1, F.lit(2))).when(entry > effect, lx.METRIC_PHOTO).otherwise(metric)
    names = F.create_map(*(F.lit(x) for kv in lx.UNIT_NAMES.items() for x in kv))
    unit = F.when(entry == shade, "色号").when(unit == "%", unit).otherwise(F.coalesce(names[F.lower(unit)], F.lower(unit)))
    hours = (metric == lx.METRIC_HOURS) & (unit == "天")
    real = F.when(entry == effect, row["seen"].bitwiseAND((1 << n) - 1) == 0).when(entry == pair, row["k"] == 0).when(entry == plain, (row["k"] == 0) & (row["seen"].bitwiseAND(1 << pair) == 0)).otherwise(True)
    return {
        "metric": metric, "variant": variant, "value": value.cast("double") * F.when(hours, 24).otherwise(1), "shade": F.when(entry == shade, F.upper(row["g1"])), "unit": F.when(hours, "h").otherwise(unit),
        "timed": ~F.coalesce((entry < n) & metric.isin(*lx.WITHOUT_PERIOD), F.lit(False)), "real": real,
    }
