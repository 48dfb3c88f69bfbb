"""DuckDB spellings of the cleaning functions, for the SQL twins."""

from __future__ import annotations

from lexmill.functions.text import DEFECTS, STRIP, TAIL_SECTIONS, TERMINAL, S


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def defect(s: str) -> str:
    return "(" + " or ".join(f"regexp_matches({s}, '{p}')" for p in DEFECTS) + ")"


def sentences(p: str) -> str:
    mark = rf"regexp_replace({strip(p)}, '([.!?…»])[{S}]+([A-ZÀ-ÖØ-Þ«\"“(\p{{Nd}}])', '\1' || chr(1) || '\2', 'g')".replace('\\"', '"')
    return f"list_filter(string_split({mark}, chr(1)), lambda s_: s_ <> '')"


def heading(x: str) -> str:
    s = strip(x)
    return f"(length({s}) <= 90 and not regexp_matches({s}, '{TERMINAL}') and length({s}) - length(replace({s}, ' ', '')) <= 12)"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l_: {strip('l_')}), lambda l_: l_ <> '')"


def tail(x: str) -> str:
    names = ", ".join(f"'{n}'" for n in TAIL_SECTIONS)
    return f"(regexp_replace(lower({x}), '[ :]+$', '') in ({names}))"


#: CRC-32 by its rule: the table of the reflected polynomial.
def crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def crc(x: str) -> str:
    table = "[" + ",".join(map(str, crc_table())) + "]::bigint[]"
    byte = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda b_: ('0x' || b_)::bigint)"
    return f"xor(list_reduce({byte}, lambda c_, b_: xor(c_ >> 8, ({table})[xor(c_ & 255, b_) + 1]), 4294967295::bigint), 4294967295::bigint)"


def web_page(x: str) -> str:
    """Expects ``x`` to be a column."""
    t = f"substring({strip(x)}, 1, 20000)"
    own = lines(t)
    return (
        f"case when length({strip(x)}) >= 400 and length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))::double / greatest(1, length({t})) >= 0.6::double"
        f" and len(list_distinct({own})) >= len({own}) * 0.7::double then array_to_string({own}, chr(10) || chr(10)) end"
    )


def permutation(name: str, n: str, keys: str) -> str:
    """CTEs that end in ``name(k, pos, place)``: for each key ``k`` of the CTE ``keys``, where 0 to n - 1 go; the CTE ``n`` has one row n. Needs ``with recursive``."""
    moves = ["x", "y"]
    steps = []
    for r in range(4):
        own, other, side = (moves[r % 2], moves[1 - r % 2], "ab"[r % 2])
        moved = f"({own} + ('0x' || substring(md5(k || ':{r}:' || {other}), 1, 8))::bigint) % {side} as {own}"
        steps.append(f"{name}_{r + 1} as (select k, v, n, a, b, {', '.join(moved if c == own else c for c in 'xy')} from {name}_{r})")
    low = "ceil(sqrt(n))::bigint"
    return f"""{name}_d as (select n, a, (n + a - 1) // a as b from (select n, unnest(range({low}, {low} + 64)) as a from {n}) order by a * ((n + a - 1) // a) - n, a limit 1),
        {name}_v as (select n, a, b, unnest(range(a * b)) as v from {name}_d), {name}_0 as (select k, v, n, a, b, v // b as x, v % b as y from {name}_v, {keys}), {', '.join(steps)},
        {name}_m as (select k, v, x * b + y as place, n from {name}_4), {name}_w(k, pos, place, n) as (select k, v, place, n from {name}_m where v < n union all select w.k, w.pos, m.place, w.n from {name}_w w join {name}_m m on w.k = m.k and w.place = m.v where w.place >= w.n),
        {name} as (select k, pos, place from {name}_w where place < n)"""
