"""Text cleaning as column expressions: native, usable in any projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, written out because engines differ on \s.
S = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"\A[{S}]+|[{S}]+\z"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Signs of a lost template or broken markup, one pattern a rule.
DEFECTS = (
    rf"[^{S}] {{2,}}[^{S}]",
    rf"[^{S}]\x{{a0}}{{2,}}[^{S}]",
    rf"\([{S}]*[,;.)]",
    rf"\[[{S}]*[\],;.]",
    rf"(?:\A|[^.{S}])[{S}][.,](?:\z|[^.\p{{Nd}}])",
    rf"(?:\A|[{S}]),(?:[{S}]|\z)",
    rf"(?:\A|[^\p{{L}}\p{{N}}_])(?:le|la|les|en|du|de|des|au|aux|à|vers)[{S}]+[,;)]",
    r"\{\{|\}\}|\|\||==|<[a-z/][^>]*>",
)
#: What any of them asks for, quick to look for: two blanks, a bracket, a mark after white space or at the start, or markup.
DEFECT_SIGNS = rf"  |\x{{a0}}\x{{a0}}|[(\[{{}}|=<]|[{S}][.,;)]|\A,"
#: Titles of closing sections, after which an article is cut.
TAIL_SECTIONS = (
    "notes et références", "notes", "références", "référence", "liens externes", "voir aussi", "bibliographie", "articles connexes",
    "annexes", "sources", "publications", "filmographie", "discographie", "liens internes", "lien externe",
)
SENTENCE_END, SENTENCE_START = "[.!?…»]", r'[A-ZÀ-ÖØ-Þ«"“(\p{Nd}]'
CLOSING = ".!?…»)\"”"
TERMINAL = rf"[{CLOSING}]\z"
#: Articles that answers are compared without.
ARTICLES = ("le", "la", "les", "l", "un", "une", "des", "du", "de", "d", "au", "aux")

#: Fixed value: the pre-tokenizer's pattern.
PRE_TOKEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}|[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where the body's lambdas would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def defect_rules(c: Column) -> list[Column]:
    return [c.rlike(p) for p in DEFECTS]


def defective(c: Column) -> Column:
    """Whether any rule hits. Few texts show a sign of one; those are looked at rule by rule, in one pass."""
    return c.rlike(DEFECT_SIGNS) & c.rlike("|".join(f"(?:{p})" for p in DEFECTS))


def sentences(c: Column, stripped: bool = False) -> Column:
    return F.filter(F.split(c if stripped else strip(c), rf"(?<={SENTENCE_END})[{S}]+(?={SENTENCE_START})"), lambda s: s != "")


def is_title(c: Column, stripped: bool = False) -> Column:
    """A short line without closing punctuation."""
    s = c if stripped else strip(c)
    return (F.length(s) <= 90) & ~F.coalesce(F.right(s, F.lit(1)).isin(*CLOSING), F.lit(False)) & (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) <= 12)


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s != "")


def is_tail(line: Column) -> Column:
    return F.rtrim(F.lower(line), F.lit(" :")).isin(*TAIL_SECTIONS)


def paragraph(found: Column, most_dropped: float = 0.4) -> Column:
    """A paragraph's sentences joined without the defective ones; null if too many went."""
    return F.when(
        (F.size(found["kept"]) > 0) & ((found["n"] - F.size(found["kept"])) / F.greatest(F.lit(1), found["n"]) <= most_dropped), F.array_join(found["kept"], " ")
    )


def body_lines(c: Column) -> Column:
    """Lines before the first closing section, without headings."""
    def cut(own):
        ends = F.array_position(F.transform(own, is_tail), F.lit(True)).cast("int")
        before = F.when(ends > 0, F.slice(own, F.lit(1), ends - 1)).otherwise(own)
        return F.filter(before, lambda s: ~is_title(s, stripped=True))

    return let(lines(c), cut)


def judged_lines(c: Column) -> Column:
    """``(n, kept)`` for each body line: its sentences, and those without defects. A line without signs of one needs one look."""

    def one(line):
        def judged(found):
            kept = F.when(line.rlike(DEFECT_SIGNS), F.filter(found, lambda s: ~defective(s))).otherwise(found)
            return F.struct(F.size(found).alias("n"), kept.alias("kept"))

        return let(sentences(line, stripped=True), judged)

    return F.transform(body_lines(c), one)


def article(judged: Column, least_line: int = 40, least: int = 300) -> Column:
    """An encyclopaedia article from its judged lines, or null."""
    kept = F.filter(F.transform(judged, lambda found: paragraph(found)), lambda p: p.isNotNull() & (F.length(p) >= least_line))
    return let(F.array_join(kept, "\n\n"), lambda text: F.when(F.length(text) >= least, text))


def web_page(c: Column, least: int = 400, most: int = 20_000) -> Column:
    """Web text, or null if it is short, mostly not letters, or repeats its lines."""
    def judged(text):
        own = lines(text)
        alpha = (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))) / F.greatest(F.lit(1), F.length(text))
        return F.when(alpha >= 0.6, let(own, lambda x: F.when(F.size(F.array_distinct(x)) >= F.size(x) * F.lit(0.7), F.array_join(x, "\n\n"))))

    return let(strip(c), lambda whole: F.when(F.length(whole) >= least, let(F.substring(whole, 1, most), judged)))


def chunks(c: Column, size: int = 4000, least_tail: int = 200) -> Column:
    """Paragraphs gathered greedily until ``size`` characters are reached; a short rest is dropped."""
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def add(z, p):
        full = z["n"] + F.length(p) >= size
        grown = F.concat(z["open"], F.array(p))
        return F.struct(
            F.when(full, F.concat(z["done"], F.array(F.array_join(grown, "\n\n")))).otherwise(z["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(grown).alias("open"),
            F.when(full, F.lit(0)).otherwise(z["n"] + F.length(p)).alias("n"),
        )

    return F.aggregate(
        paragraphs, start, add, lambda z: F.when(z["n"] >= least_tail, F.concat(z["done"], F.array(F.array_join(z["open"], "\n\n")))).otherwise(z["done"])
    )


def dialogue(c: Column, most_turns: int = 10, most_chars: int = 600) -> Column:
    """``[Name:] text`` turns as alternating user and assistant messages; null under two turns."""
    parts = F.split(c, r"\[[^\]\n]{1,40}?[" + S + r"]*:[" + S + r"]*\][" + S + r"]*")
    turns = F.slice(F.filter(F.transform(F.slice(parts, 2, 1 << 30), strip), lambda t: t != ""), 1, most_turns)
    even = F.slice(turns, 1, (F.size(turns) - F.size(turns) % 2).cast("int"))
    return F.when(
        F.size(even) >= 2,
        F.transform(even, lambda t, i: F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.substring(t, 1, most_chars).alias("content"))),
    )


def qa_window(context: str, start: str, length: str, width: int = 600) -> Column:
    """The part of a context around an answer, cut at sentence ends where they are near. Arguments are SQL; start counts from 0."""
    c, a, n = context, start, length
    s0 = f"greatest(0, least({a} - {width // 3}, length({c}) - {width}))"
    e0 = f"greatest(least(length({c}), {s0} + {width}), {a} + {n})"
    head = f"substring({c}, 1, {a})"
    # The last ". " before the answer, counted from 0; -1 without one.
    cut = f"(case when instr({head}, '. ') = 0 then -1 else {a} - instr(reverse({head}), ' .') - 1 end)"
    space = f"(case when locate(' ', {c}, {s0} + 1) = 0 then 0 else locate(' ', {c}, {s0} + 1) end)"
    s1 = f"(case when {s0} > 0 then case when {cut} <> -1 and {cut} >= {s0} - 200 then {cut} + 2 else {space} end else {s0} end)"
    dot = f"locate('. ', {c}, {a} + {n} + 1)"
    e1 = f"(case when {e0} < length({c}) and {dot} > 0 and {dot} - 1 - {s1} <= {width + 250} then {dot} else {e0} end)"
    return strip(F.expr(f"substring({c}, {s1} + 1, greatest(0, {e1} - {s1}))"))


def ends_sentence(c: Column) -> Column:
    """With a full stop unless it ends a sentence already."""
    return F.when(F.right(c, F.lit(1)).isin(".", "!", "?"), c).otherwise(F.concat(c, F.lit(".")))


def sanitized(c: Column) -> Column:
    """Text that can't be taken for a special token."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def first_filled(*columns: Column) -> Column:
    """The first that isn't blank, as it is; else empty."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns], F.lit(""))


def pre_tokens(c: Column) -> Column:
    """Pieces that merges never cross: contractions, words, single digits, punctuation, line breaks, blanks."""
    return F.regexp_extract_all(c, F.lit(rf"(?U){PRE_TOKEN}"), F.lit(0))


#: The pre-tokenizer's pattern for texts below U+0100, with their letters, numbers and blanks written out.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
LATIN_PRE_TOKEN = (
    rf"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL]{{2}})|[^\r\n{_L}{_N}]?[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+[\r\n]*"
    rf"|[{_S}]*[\r\n]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


def is_latin(c: Column) -> Column:
    """Texts below U+0100: composed already, and cut by Python's ``re`` as ``pre_tokens`` does."""
    return ~c.rlike(r"[^\x00-\xff]")
