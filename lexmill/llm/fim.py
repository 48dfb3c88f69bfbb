"""Fill-in-the-middle by a parallel automaton scan.

One automaton over bytes counts units (characters, words or lines) and looks for the
sentinels. A text is cut into chunks, and chunks into lanes, at any byte. Each emits its
state-transition function with the units begun from each start state; these functions
compose associatively, so a prefix scan over them gives every chunk's entry state and the
units before it. A cut after k units is then looked for only in the chunk that holds the
k-th unit. Texts of one chunk are done where they are read; the chunks of longer ones are
dealt over the cluster, and only their functions, not their bytes, meet before the cuts
are known.

Where the cuts lie and which form a document takes follows from a hash of its id alone.

Defined results: a null text is the empty text, and plain; a null id is hashed as the empty
string; a text that holds a sentinel is plain; rows that are equal in id and text come as
often as the table has them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix, suffix and middle begin with these.
SENTINELS = ("<P>", "<S>", "<M>")
SPACES = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
#: A text longer than this is dealt over the cluster in chunks of this size.
CHUNK = 1 << 20
LANE, PAD = 256, 256


class Automaton:
    """Bytes to states: what of a unit and which beginning of a sentinel has just been read. A found sentinel stays found."""

    def __init__(self, unit: str = "chars", sentinels: tuple[str, ...] = SENTINELS):
        #: Of each kind of unit: the first state, and from state and byte to (state, whether a unit begins with this byte).
        first, read = {
            "chars": (0, lambda s, b: (0, b & 0xC0 != 0x80)),
            "words": (0, lambda s, b: (0, False) if b in SPACES else (1, s == 0)),
            "lines": (0, lambda s, b: (0 if b == 10 else 1, s == 0)),
        }[unit]
        marks = [s.encode() for s in sentinels]

        def seen(before: bytes | None, b: int) -> bytes | None:
            """The longest end of what was read that begins a sentinel; None once one is whole."""
            if before is None:
                return None
            now = before + bytes([b])
            if any(now.endswith(m) for m in marks):
                return None
            return next(now[i:] for i in range(len(now) + 1) if any(m.startswith(now[i:]) for m in marks))

        number, rows = {(first, b""): 0}, []
        todo = [(first, b"")]
        for unit_state, before in todo:
            row = []
            for b in range(256):
                state, begins = read(unit_state, b)
                key = state, seen(before, b)
                if key not in number:
                    number[key] = len(number)
                    todo.append(key)
                row.append(number[key] | begins << 7)
            rows.append([*row, number[unit_state, before]])  # padding changes nothing
        if len(rows) > 128:
            raise ValueError("too many states")
        self.table = np.array(rows, np.uint8).ravel()
        self.n_states = len(rows)
        self.found = np.array([key[1] is None for key in number])


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The functions (end state, units) by start state of two neighbours, as one. Associative."""
    ends, units = first
    return np.take_along_axis(then[0], ends, 1), units + np.take_along_axis(then[1], ends, 1)


def scanned(functions: tuple[np.ndarray, np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the composition of its group's rows up to it, in doubling steps."""
    ends, units = functions[0].astype(np.int64), functions[1].astype(np.int64)
    step = 1
    while step < len(group):
        same = np.flatnonzero(group[step:] == group[:-step]) + step
        if not len(same):
            break
        ends[same], units[same] = compose((ends[same - step], units[same - step]), (ends[same], units[same]))
        step *= 2
    return ends, units


class Scan:
    """Byte strings scanned side by side, as lanes of equal width."""

    def __init__(self, automaton: Automaton, blobs: list[bytes]):
        self.automaton, self.size = automaton, np.array([len(b) for b in blobs], np.int64)
        lanes = np.maximum(1, -(-self.size // LANE))
        self.blob = np.repeat(np.arange(len(blobs)), lanes)
        self.first = np.cumsum(lanes) - lanes
        flat = np.full(int(lanes.sum()) * LANE, PAD, np.uint16)
        for b, at in zip(blobs, self.first.tolist(), strict=True):
            flat[at * LANE : at * LANE + len(b)] = np.frombuffer(b, np.uint8)
        self.lanes = flat.reshape(-1, LANE)
        n = automaton.n_states
        state = np.tile(np.arange(n, dtype=np.int64), (len(self.lanes), 1))
        units = np.zeros(state.shape, np.int32)
        for column in np.ascontiguousarray(self.lanes.T):
            step = automaton.table[state * (PAD + 1) + column[:, None]]
            units += step >> 7
            state = (step & 127).astype(np.int64)
        self.upto = scanned((state, units), self.blob)
        self.last = self.first + lanes - 1

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """(end state, units) by start state, of each whole byte string."""
        return self.upto[0][self.last], self.upto[1][self.last]

    def cut(self, blob: np.ndarray, k: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Where in its string unit number k (from 0) begins, which it has when read from the state ``entry``."""
        units = self.upto[1]
        low, high = self.first[blob], self.last[blob]
        while (open_ := low < high).any():  # the first lane up to which there are more than k units
            middle = (low + high) // 2
            enough = units[middle, entry] > k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        before = np.maximum(low - 1, 0)
        inner = low > self.first[blob]
        state = np.where(inner, self.upto[0][before, entry], entry)
        left = k - np.where(inner, units[before, entry], 0)
        at = np.zeros(len(blob), np.int64)
        for i, column in enumerate(self.lanes[low].T):
            step = self.automaton.table[state * (PAD + 1) + column]
            begins = (step >> 7).astype(bool)
            at[begins & (left == 0)] = i
            left = left - begins
            state = (step & 127).astype(np.int64)
        return (low - self.first[blob]) * LANE + at


def _sections(text: bytes, a: int, b: int) -> tuple[bytes, bytes, bytes]:
    return text[:a], text[a:b], text[b:]


def _written(form: str, text: bytes, a: int, b: int, marks: list[bytes]) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = _sections(text, a, b)
    p, s, m = marks
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def _bounds(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(x, y), np.maximum(x, y)


def _rows(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[list[dict]]:
    """Rows with texts as bytes, some megabytes at a time."""
    for batch in batches:
        part, size = [], 0
        columns = [c.cast(pa.binary()) if n in ("text", "bytes") else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
        for values in zip(*columns, strict=True):
            row = {n: v.as_py() for n, v in zip(batch.schema.names, values, strict=True)}
            part.append(row)
            size += len(row.get("text") or row.get("bytes") or b"")
            if size >= most:
                yield part
                part, size = [], 0
        if part:
            yield part


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def hashed(key: Column) -> list[Column]:
    """The first four 8-digit groups of a key's SHA-256, as numbers."""
    hex_ = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = 90, spm_below: int = 20, chunk: int = CHUNK
) -> DataFrame:
    """``(id, n, form, prefix_units, middle_units, output)`` for each row; ``restored`` undoes it.

    Percent of documents: from ``plain_from`` on they stay plain, below ``spm_below`` the suffix
    comes first.
    """
    from lexmill.storage import stage

    kind = docs.schema[id_col].dataType.simpleString()
    marks = [s.encode() for s in sentinels]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *hashed(F.col(id_col)))
    long_ = F.octet_length("text") > chunk

    def form_of(n, found, h3, h4) -> str:
        return "plain" if not n or found or h3 % 100 >= plain_from else "spm" if h4 % 100 < spm_below else "psm"

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(unit, sentinels)
        for part in _rows(batches):
            texts = [r["text"] for r in part]
            scan = Scan(automaton, texts)
            ends, units = scan.functions()
            n = units[:, 0]
            h1, h2 = (np.array([r[h] for r in part], np.int64) for h in ("h1", "h2"))
            a, b = _bounds(n, h1, h2)
            # A cut at 0 is the beginning, one at n the end; others begin a unit.
            at = []
            for k in (a, b):
                found = np.where(k == n, scan.size, 0)
                inner = np.flatnonzero((k > 0) & (k < n))
                found[inner] = scan.cut(inner, k[inner], np.zeros(len(inner), np.int64))
                at.append(found.tolist())
            lost = automaton.found[ends[:, 0]].tolist()
            forms = [form_of(x, f, r["h3"], r["h4"]) for x, f, r in zip(n.tolist(), lost, part, strict=True)]
            plain = np.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["id"] for r in part], batch_type), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(a, pa.int64(), mask=plain), pa.array(b - a, pa.int64(), mask=plain),
                    _text([_written(f, t, x, y, marks) for f, t, x, y in zip(forms, texts, *at, strict=True)]),
                ],
                ["id", "n", "form", "prefix_units", "middle_units", "output"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema[id_col].dataType)
    result = f"id {kind}, n long, form string, prefix_units long, middle_units long, output string"
    short = rows.where(~long_).mapInArrow(in_place, result)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _rows(batches, 1):
            for r in part:
                t = r["text"]
                doc = hashlib.sha256(b"%r " % (r["id"],) + hashlib.sha256(t).digest()).hexdigest()
                for i, at in enumerate(range(0, len(t), chunk)):
                    yield pa.RecordBatch.from_pylist([{"doc": doc, "id": r["id"], "chunk_no": i, "bytes": t[at : at + chunk], **{h: r[h] for h in ("h1", "h2", "h3", "h4")}}], cut_schema)

    cut_schema = pa.schema([("doc", pa.string()), ("id", batch_type), ("chunk_no", pa.int32()), ("bytes", pa.binary()), *[(h, pa.int64()) for h in ("h1", "h2", "h3", "h4")]])
    hs = "h1 long, h2 long, h3 long, h4 long"
    pieces = rows.where(long_).mapInArrow(cut_up, f"doc string, id {kind}, chunk_no int, bytes binary, {hs}")
    # Equal rows have equal chunks: one of each is scanned, the copies are counted.
    own = [F.first(c).alias(c) for c in ("id", "bytes", "h1", "h2", "h3", "h4")]
    chunks = stage(pieces.groupBy("doc", "chunk_no").agg(*own, F.count("*").alias("copies")), "fim-chunks")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(unit, sentinels)
        for part in _rows(batches):
            ends, units = Scan(automaton, [r["bytes"] for r in part]).functions()
            yield pa.RecordBatch.from_arrays([pa.array([r["doc"] for r in part]), pa.array([r["chunk_no"] for r in part], pa.int32()), pa.array(ends.tolist(), pa.list_(pa.int64())), pa.array(units.tolist(), pa.list_(pa.int64()))], ["doc", "chunk_no", "ends", "units"])

    functions = chunks.select("doc", "chunk_no", "bytes").mapInArrow(summed, "doc string, chunk_no int, ends array<long>, units array<long>")
    # A string holds 2 GB at most, so a document has 2 GB / chunk functions at most.
    of_doc = functions.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "ends", "units"))).alias("f"))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(unit, sentinels)
        for batch in batches:
            for doc, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends, units = scanned((np.array([x["ends"] for x in f]), np.array([x["units"] for x in f])), np.zeros(len(f), np.int8))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * len(f)), pa.array([x["chunk_no"] for x in f], pa.int32()), pa.array([0, *ends[:-1, 0].tolist()], pa.int64()), pa.array([0, *units[:-1, 0].tolist()], pa.int64()),
                        pa.array(units[:, 0].tolist(), pa.int64()), pa.array([int(units[-1, 0])] * len(f), pa.int64()), pa.array([bool(automaton.found[ends[-1, 0]])] * len(f)),
                    ],
                    ["doc", "chunk_no", "entry", "before", "upto", "n", "found"],
                )

    entries = of_doc.mapInArrow(entered, "doc string, chunk_no int, entry long, before long, upto long, n long, found boolean")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's parts, by the section of the output that they go to and their place in it."""
        automaton = Automaton(unit, sentinels)
        for part in _rows(batches):
            scan = Scan(automaton, [r["bytes"] for r in part])
            out = []
            for i, r in enumerate(part):
                n, t = r["n"], r["bytes"]
                form = form_of(n, r["found"], r["h3"], r["h4"])
                a, b = sorted((r["h1"] % (n + 1), r["h2"] % (n + 1)))
                at = [0 if k == 0 or k < r["before"] else len(t) if k >= r["upto"] else int(scan.cut(np.array([i]), np.array([k - r["before"]]), np.array([r["entry"]]))[0]) for k in (a, b)]
                order = {"psm": (0, 2, 1), "spm": (1, 2, 0), "plain": (0, 0, 0)}[form]
                parts = [(0, t)] if form == "plain" else list(zip(order, _sections(t, *at), strict=True))
                common = {"doc": r["doc"], "id": r["id"], "copies": r["copies"], "n": n, "form": form, "prefix_units": None if form == "plain" else a, "middle_units": None if form == "plain" else b - a}
                out += [common | {"section": s, "place": r["chunk_no"], "bytes": x} for s, x in parts if x]
                if r["chunk_no"] == 0 and form != "plain":
                    p, s, m = marks
                    out += [common | {"section": s_, "place": -1, "bytes": x} for s_, x in zip(order, (p, m, s), strict=True)]
            yield pa.RecordBatch.from_pylist(out, dealt_schema)

    dealt_schema = pa.schema([("doc", pa.string()), ("id", batch_type), ("copies", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("section", pa.int32()), ("place", pa.int32()), ("bytes", pa.binary())])
    parts = chunks.join(entries, ["doc", "chunk_no"]).mapInArrow(dealt, f"doc string, id {kind}, copies long, n long, form string, prefix_units long, middle_units long, section int, place int, bytes binary")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "place", "bytes"))), lambda x: x["bytes"].cast("string")), "")
    same = ("id", "copies", "n", "form", "prefix_units", "middle_units")
    long_rows = parts.groupBy("doc").agg(*[F.first(c).alias(c) for c in same], joined.alias("output"))
    again = long_rows.select("id", "n", "form", "prefix_units", "middle_units", "output", F.explode(F.expr("sequence(1L, copies)"))).drop("col")
    return short.unionByName(again).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which an output of that form was made."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    both = F.transform(F.array(parts), lambda p: F.concat(F.when(form == "psm", F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(2))), F.get(p, F.lit(3)), F.when(form == "psm", F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1)))))
    return F.when(form == "plain", output).otherwise(F.get(both, F.lit(0)))
