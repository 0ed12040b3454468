"""SentencePiece encoding and decoding by a relational lattice (operator 2).

Texts are cut into units that no piece crosses (a run of blanks with the letters after it; single
characters that occur in no longer piece). Distinct units are counted over the corpus. Their
substrings of bounded length are exploded and equi-joined to the piece table; the edges are
grouped by unit, and a fold with Spark's `aggregate` finds the segmentation:

* for a unigram model, Viterbi: the path of the largest total score;
* for a BPE model, merges in the order of scores, the leftmost first among equals. The scores of such
  a model are merge ranks, and a path of the largest total isn't what the model's own encoder
  returns (the README has figures), so the fold follows the encoder.

The segmented units form a dictionary in the shared folder: files sorted by a hash of the unit, one
a hash range, which workers map and search, and which hold each unit's first bytes as well. All
distinct units of 2 to LONGEST characters go through the lattice, up to the DICTIONARY most
frequent. Only what is left (single characters, longer units and those beyond the dictionary) is
segmented in the task, by the same rule.

Edge cases: null and empty texts have no ids; characters without a piece become bytes, or the
unknown id where the model has no byte pieces; repeated rows are encoded alike; an empty table gives
no rows; other columns are ignored, and `ids` and `decoded` take the place of columns of that name. Decoding returns the text exactly, but for U+2581, which the
model reads as a blank, and unknown ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import arrays, storage
from corpusflow.llm.idcache import IdCache

BLANK = "▁"
LONGEST = 62
DICTIONARY = 32_000_000
#: Distinct units that a task counts before it hands them on.
FLUSH = 1_000_000
#: Bytes of text that a worker handles at once.
SLICE_BYTES = 1 << 19
#: Units that a task segments.
UNITS_A_TASK = 50_000
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    """Pieces, scores and kinds of a SentencePiece model file, as far as encoding needs them."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int = UNIGRAM
    prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict)
    bytes_: list[int | None] = field(default_factory=lambda: [None] * 256)
    unknown: int = 0

    @classmethod
    def read(cls, path: str) -> "Model":
        pieces, scores, kinds, algorithm, prefix, squeeze, rule = [], [], [], UNIGRAM, True, True, "identity"
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    p = dict(_fields(value))
                    pieces.append(p.get(1, b"").decode())
                    scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                    kinds.append(p.get(3, 1))
                elif number == 2:
                    algorithm = dict(_fields(value)).get(3, UNIGRAM)
                elif number == 3:
                    n = dict(_fields(value))
                    rule, prefix, squeeze = n.get(1, b"").decode(), bool(n.get(3, 1)), bool(n.get(4, 1))
        if rule != "identity" or squeeze or algorithm not in (UNIGRAM, BPE):
            raise ValueError("only models without text normalisation are supported")
        return cls(pieces, scores, kinds, algorithm, prefix)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 4)}
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == 6:
                self.bytes_[int(p[3:5], 16)] = i
            elif k == 2:
                self.unknown = i
        longer = [p for p in self.ids if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in longer):
            raise ValueError("a piece joins words")
        inner = "".join(sorted({c for p in longer for c in p} - {BLANK}))
        self.inner = np.zeros(0x110000, bool)
        self.inner[[ord(c) for c in inner]] = True
        self.inner[[0x20, ord(BLANK)]] = False
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores, default=0.0) - 10

    def __reduce__(self):
        return Model, (self.pieces, self.scores, self.kinds, self.algorithm, self.prefix)

    def prepared(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts as the model reads them: U+2581 is a blank, and a blank goes before a text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(column, BLANK)).as_py():
            column = pc.replace_substring(column, BLANK, " ")
        if self.prefix:
            blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), none, pc.binary_join_element_wise(blank, column, none))
        return arrays.utf8(column)

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of units: blanks with the inner characters after them; any other character alone."""
        at, code = arrays.code_points(data)
        if not len(at):
            return at, at
        blank, inner = code == 0x20, self.inner[code]
        start = np.ones(len(at), bool)
        start[1:] = ~((blank[1:] & blank[:-1]) | (inner[1:] & (inner[:-1] | blank[:-1])))
        edge = np.searchsorted(at, off[:-1])
        start[edge[edge < len(at)]] = True
        begin = at[start]
        return begin, np.append(begin[1:], len(data))

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        own = [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in own else own

    def segment(self, unit: str) -> list[int]:
        """The unit's ids, in plain Python: for units that no dictionary has."""
        parts = self._merged(unit) if self.algorithm == BPE else self._best(unit)
        out: list[int] = []
        for p in parts:
            out += [self.ids[p]] if p in self.ids else [i for c in p for i in self.fallback(c)]
        return out

    def _merged(self, unit: str) -> list[str]:
        part, left, right = list(unit), list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (whole := part[i] + part[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[whole]], i, whole))

        for i in range(len(unit) - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j < 0 or part[i] + part[j] != whole:
                continue
            part[i], part[j], right[i] = whole, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p]

    def _best(self, unit: str) -> list[str]:
        best = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            ways = [(best[s][0] + self.scores[self.ids[unit[s:e]]], s) for s in range(max(0, e - self.longest), e) if unit[s:e] in self.ids]
            if unit[e - 1] not in self.ids:
                ways.append((best[e - 1][0] + self.floor, e - 1))
            best.append(max(ways))
        parts, e = [], len(unit)
        while e:
            parts.append(unit[best[e][1] : e])
            e = best[e][1]
        return parts[::-1]

    def spelled(self) -> list[bytes]:
        """Each id's bytes."""
        return [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(BLANK, " ").encode() if k != 2 else " ⁇ ".encode() for p, k in zip(self.pieces, self.kinds, strict=True)]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces of data as an Arrow column, with BLANK for blanks."""
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    own = np.ascontiguousarray(data[arrays.spread(start, end - start)])
    return pc.replace_substring(pa.StringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(own)), " ", BLANK)


def counted_units(docs: DataFrame, model: Model) -> DataFrame:
    """h (the unit's hash), unit, n: how often each distinct unit of 2 to LONGEST characters occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, found = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def row() -> pa.RecordBatch:
            units = pa.concat_arrays([f[1] for f in found])
            h = np.concatenate([f[0] for f in found])
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), units, pa.array(times[np.searchsorted(known, h)])], ["h", "unit", "n"])

        for batch in arrays.sliced(batches, limit=SLICE_BYTES):
            data, off = model.prepared(batch.column("text"))
            start, end = model.units(data, off)
            long = np.flatnonzero(end - start > 1)
            start, end = start[long], end[long]
            h, at, n = np.unique(arrays.word_hashes(data, start, end), return_index=True, return_counts=True)
            place = np.searchsorted(known, h)
            old = place < len(known)
            old[old] = known[place[old]] == h[old]
            times[place[old]] += n[old]
            units = strings(data, start[at[~old]], end[at[~old]])
            size = pc.utf8_length(units).to_numpy()
            good = (size > 1) & (size <= LONGEST)
            fresh = np.flatnonzero(~old)[good]
            found.append((h[fresh], units.filter(pa.array(good))))
            known, times = np.insert(known, place[fresh], h[fresh]), np.insert(times, place[fresh], n[fresh])
            if len(known) > FLUSH:
                yield row()
                known, times, found = known[:0], times[:0], []
        if len(known):
            yield row()
        known = times = found = None
        arrays.trim()

    return docs.select("text").mapInArrow(count, "h long, unit string, n long").groupBy("h", "unit").agg(F.sum("n").alias("n"))


def _wide(edges: Column) -> Column:
    """Each edge with bitmaps of the boundaries from its start to its end, of the two alone, and of all but those between them."""

    def one(x: Column) -> Column:
        start, end = F.shiftright(x, 30).bitwiseAND(F.lit(63)).cast("int"), F.shiftright(x, 24).bitwiseAND(F.lit(63)).cast("int")
        bit = lambda n, at: F.call_function("shiftleft", F.lit(n).cast("long"), at)
        full, ends = bit(2, end) - bit(1, start), bit(1, start).bitwiseOR(bit(1, end))
        return F.struct(x.alias("x"), full.alias("full"), ends.alias("ends"), F.bitwise_not(full).bitwiseOR(ends).alias("keep"))

    return F.transform(edges, one)


def _merge_fold(wide: Column, size: Column) -> Column:
    """Starts of a unit's pieces, and its end, after merging neighbours in the order of ranks, the leftmost among equals.

    The state is a bitmap of boundaries, at first all. An edge is a possible merge while its two ends are boundaries and one
    boundary lies between them; the least possible edge takes that one away. When no edge is possible, the state is negated
    and stays.
    """

    def step(now: Column, _: Column) -> Column:
        merges = F.filter(wide, lambda x: (F.bit_count(now.bitwiseAND(x["full"])) == 3) & (now.bitwiseAND(x["ends"]) == x["ends"]))
        return F.when(now < 0, now).otherwise(F.coalesce(now.bitwiseAND(F.array_min(merges)["keep"]), F.bitwise_not(now)))

    every = F.call_function("shiftleft", F.lit(2).cast("long"), size) - 1
    left = F.aggregate(F.sequence(F.lit(2), size), every, step, lambda now: F.when(now < 0, F.bitwise_not(now)).otherwise(now))
    return F.transform(F.array(left), lambda now: F.filter(F.sequence(F.lit(0), size), lambda i: F.call_function("getbit", now, i) == 1))[0]


def _viterbi_fold(edges: Column, size: Column, floor: float) -> Column:
    """Cuts of the path with the largest total score; edges: array of (s, e, score)."""
    state = "array<struct<score:double,s:int>>"

    def step(best: Column, e: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((F.element_at(best, x["s"] + 1)["score"] + x["score"]).alias("score"), x["s"].alias("s")))
        lone = F.struct((F.element_at(best, e)["score"] + floor).alias("score"), (e - 1).alias("s"))
        ways = F.when(F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1)), ways).otherwise(F.concat(ways, F.array(lone)))
        return F.concat(best, F.array(F.array_max(ways)).cast(state))

    best = F.aggregate(F.sequence(F.lit(1), size), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"))).cast(state), step)

    def back(cuts: Column, _: Column) -> Column:
        at = F.element_at(cuts, 1)
        return F.when(at == 0, cuts).otherwise(F.concat(F.array(F.element_at(best, at + 1)["s"]), cuts))

    return F.aggregate(F.sequence(F.lit(1), size), F.array(size), back)


def segmented(units: DataFrame, model: Model) -> DataFrame:
    """unit, cuts, ids (array of int) of distinct units of at most LONGEST characters; cuts are pieces' starts and the end.

    -1 stands for a character that is no edge. In a BPE model single characters are pieces anyhow, whatever their rank, so
    they need no edge; `single` has their ids.

    Units are dealt once, by ranges of their hash h where they have one; the explode, the join and the grouping keep to that.
    """
    spark = units.sparkSession
    order = {x: r for r, x in enumerate(sorted({-model.scores[i] for i in model.ids.values()}))}
    table = pa.table({"piece": list(model.ids), "id": pa.array(model.ids.values(), pa.int64()), "rank": pa.array([order[-model.scores[i]] for i in model.ids.values()], pa.int64()), "score": pa.array([model.scores[i] for i in model.ids.values()], pa.float64())})
    pieces = F.broadcast(spark.createDataFrame(table))  # the model's vocabulary: its size doesn't depend on the input
    if "h" not in units.columns:
        units = units.withColumn("h", F.xxhash64("unit"))
    each = units.select("h", "unit").repartitionByRange(max(8, -(-units.count() // UNITS_A_TASK)), "h").withColumn("size", F.length("unit"))
    spans = each.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    shortest = 2 if model.algorithm == BPE else 1
    spans = spans.where(F.col("s") + shortest <= F.col("size")).withColumn("l", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(max(shortest, model.longest)), F.col("size") - F.col("s")))))
    edges = spans.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("l"))).join(pieces, "piece")
    # An edge is one long: 24 bits of rank, 12 of place (start * 64 + end), 24 of id. A list of longs is light to group.
    place = (F.col("s") * 64 + F.col("s") + F.col("l")).cast("long")
    edge = F.shiftleft("rank", 36).bitwiseOR(F.shiftleft(place, 24)).bitwiseOR(F.col("id"))
    scored = [] if model.algorithm == BPE else [F.collect_list(F.struct(place.alias("place"), "score")).alias("scored")]
    found = edges.groupBy("h", "unit").agg(F.collect_list(edge).alias("edges"), *scored).withColumn("size", F.length("unit"))
    if model.algorithm == BPE:
        # A transform of one element holds the value; a column that is used once would be found anew in every step.
        cuts = F.transform(F.array(_wide(F.col("edges"))), lambda wide: _merge_fold(wide, F.col("size")))[0]
    else:
        found = found.withColumn("scored", F.transform("scored", lambda x: F.struct(F.shiftright(x["place"], 6).cast("int").alias("s"), x["place"].bitwiseAND(F.lit(63)).cast("int").alias("e"), x["score"].alias("score"))))
        cuts = _viterbi_fold(F.col("scored"), F.col("size"), model.floor)
    found = found.withColumn("cuts", cuts)
    wanted = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: (F.element_at("cuts", i) * 64 + F.element_at("cuts", i + 1)).cast("long"))
    at = lambda x: F.shiftright(x, 24).bitwiseAND(F.lit(4095).cast("long"))
    ids = F.transform(wanted, lambda w: F.coalesce(F.get(F.filter("edges", lambda x: at(x) == w), F.lit(0)).bitwiseAND(F.lit((1 << 24) - 1)), F.lit(-1)).cast("int"))
    return found.select("unit", "cuts", ids.alias("ids"))


def single(model: Model) -> np.ndarray:
    """The id of each character that is a piece, or -1."""
    out = np.full(0x110000, -1, np.int32)
    for p, i in model.ids.items():
        if len(p) == 1:
            out[ord(p)] = i
    return out


def write_dictionary(docs: DataFrame, model: Model) -> list[tuple[int, str]]:
    """Segment the corpus' units; (smallest hash, path) of the dictionary's files, in order."""
    units = storage.written(counted_units(docs, model), "units")
    if units.count() > DICTIONARY:
        rows = units.groupBy("n").agg(F.count("*").alias("m"))
        total = rows.withColumn("total", F.sum("m").over(Window.orderBy(F.desc("n"))))
        least = total.where(F.col("total") <= DICTIONARY).agg(F.min("n")).first()[0]
        units = units.where(F.col("n") >= F.lit(least))
    folder = f"{storage.shared_dir(docs.sparkSession)}/units"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, full, sizes, ids, chars = [], [], [], [], single(model)
        for batch in batches:
            data, off = arrays.utf8(pc.replace_substring(batch.column("unit"), BLANK, " "))
            head.append(arrays.heads(arrays.eights(data), off[:-1], np.diff(off)))
            full.append(arrays.word_hashes(data, off[:-1], off[1:]))
            size = pc.list_value_length(batch.column("ids")).to_numpy().astype(np.int64)
            own = batch.column("ids").flatten().to_numpy().copy()
            cuts = batch.column("cuts").flatten().to_numpy()
            at, code = arrays.code_points(data)
            first = np.searchsorted(at, off[:-1])
            begin = np.delete(cuts, np.cumsum(size + 1) - 1) + np.repeat(first, size)
            none = np.flatnonzero(own < 0)
            own[none] = chars[np.where(code[begin[none]] == 0x20, ord(BLANK), code[begin[none]])]
            sizes.append(size)
            ids.append(own)
        if head:
            head, full, sizes, ids = map(np.concatenate, (head, full, sizes, ids))
            order = np.argsort(full.view(np.int64), kind="stable")
            starts = np.cumsum(sizes) - sizes
            ids = ids[arrays.spread(starts[order], sizes[order])].astype("<i4")
            ends = np.concatenate([[0], np.cumsum(sizes[order])]).astype("<u4")
            path = f"{folder}/{TaskContext.get().partitionId()}.units"
            storage.write_file(path, [np.array([len(full), len(ids)], "<u8").tobytes(), full[order].tobytes(), head[order].tobytes(), ends.tobytes(), ids.tobytes()])
            yield pa.RecordBatch.from_pydict({"low": [int(full.view(np.int64).min())], "path": [path]})
        head = full = sizes = ids = None
        arrays.trim()

    return sorted(map(tuple, segmented(units, model).mapInArrow(write, "low long, path string").collect()))  # one row a file


class Encoder:
    """A worker's view of the dictionary, and the ids of what it has looked up there."""

    def __init__(self, model: Model, files: list[tuple[int, str]]) -> None:
        self.model, self.files = model, files
        self.low = np.array([f[0] for f in files], np.int64)
        self.open: dict[int, tuple[np.ndarray, ...]] = {}
        self.known = IdCache()

    def _file(self, i: int) -> tuple[np.ndarray, ...]:
        if i not in self.open:
            held = storage.read_file(self.files[i][1])
            n, m = (int(x) for x in np.frombuffer(held, "<u8", 2))
            self.open[i] = np.frombuffer(held, np.int64, n, 16), np.frombuffer(held, "<u8", n, 16 + 8 * n), np.frombuffer(held, "<u4", n + 1, 16 + 16 * n), np.frombuffer(held, "<i4", m, 20 + 20 * n)
        return self.open[i]

    def _learn(self, text: bytes, begin: np.ndarray, end: np.ndarray, head: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, all ids) of units: from the dictionary, or segmented here."""
        key = full.view(np.int64)
        order = np.argsort(key, kind="stable")
        count = np.full(len(key), -1, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        which = np.searchsorted(self.low, key[order], "right") - 1
        cut = np.searchsorted(which, np.arange(len(self.files) + 1))
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            keys, heads, ends, ids = self._file(i)
            own = order[cut[i] : cut[i + 1]]
            at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            hit = (keys[at] == key[own]) & (heads[at] == head[own])
            own, at = own[hit], at[hit]
            size = (ends[at + 1] - ends[at]).astype(np.int64)
            got = ids[arrays.spread(ends[at].astype(np.int64), size)]
            odd = np.zeros(len(own), bool)  # a character without a piece
            odd[np.repeat(np.arange(len(own)), size)[got < 0]] = True
            parts.append((own[~odd], got[np.repeat(~odd, size)]))
            count[own[~odd]] = size[~odd]
        left = np.flatnonzero(count < 0)
        mine = [self.model.segment(text[a:b].decode("utf-8", "replace").replace(" ", BLANK)) for a, b in zip(begin[left].tolist(), end[left].tolist(), strict=True)]
        count[left] = list(map(len, mine))
        parts.append((left, np.array([i for x in mine for i in x], np.int32)))
        out = np.empty(int(count.sum()), np.int32)
        first = np.cumsum(count) - count
        for own, ids in parts:
            out[arrays.spread(first[own], count[own])] = ids
        return count, out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's); data, off: `Model.prepared`."""
        begin, end = self.model.units(data, off)
        doc = np.searchsorted(off, begin, "right") - 1
        text = data.tobytes()
        head, full = arrays.heads(arrays.eights(data), begin, end - begin), arrays.word_hashes(data, begin, end)
        at, n = self.known.find(head, full, lambda new: self._learn(text, begin[new], end[new], head[new], full[new]))
        count = np.bincount(doc, n, len(off) - 1).astype(np.int64)
        return self.known.gather(at, n), np.concatenate([[0], np.cumsum(count)])


_ENCODERS: dict[str, Encoder] = {}


def _worker(model: Model, files: list[tuple[int, str]]) -> Encoder:
    """One encoder a worker process."""
    key = files[0][1] if files else ""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, files)
    return _ENCODERS[key]


class Speller:
    """From ids to bytes."""

    def __init__(self, model: Model) -> None:
        spelled = model.spelled()
        self.prefix = model.prefix
        self.size = np.array(list(map(len, spelled)), np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts whose ids lie between offsets, a prefixed blank included."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.data[arrays.spread(self.first[ids], size)], ends[off]


def encode(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """docs with ids: array of int, for the model file at path."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    model = Model.read(path)
    files = write_dictionary(docs, model)
    names = [c for c in docs.columns if c != "ids" and (keep_text or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(model, files)
        for batch in arrays.sliced(batches, limit=SLICE_BYTES):
            ids, off = encoder.encode(*model.prepared(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], [*names, "ids"])

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in names]).add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids: array of int) with decoded, the text its ids spell, in place of a column of that name."""
    from pyspark.sql.types import StringType, StructType

    model = Model.read(path)
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column("ids")
                off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
                data, edge = speller.spell(column.flatten().to_numpy(), off)
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                texts = [t[1:] if speller.prefix and t[:1] == " " else t for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, StructType([encoded.schema[c] for c in names]).add("decoded", StringType()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip (decoded equals the text), in one pass."""
    model = Model.read(path)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    files = write_dictionary(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, speller = _worker(model, files), Speller(model)
        for batch in arrays.sliced(batches, limit=SLICE_BYTES):
            column = batch.column("text")
            data, off = model.prepared(column)
            ids, cut = encoder.encode(data, off)
            told, edge = speller.spell(ids, cut)
            same = [np.array_equal(told[a:b], data[c:d]) for a, b, c, d in zip(edge[:-1].tolist(), edge[1:].tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
            same = pc.and_(pa.array(same, pa.bool_()), pc.invert(pc.match_substring(pc.fill_null(column, ""), BLANK)))
            own = ids.astype("<i4")
            crc = [zlib.crc32(own[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(cut)), pa.array(crc, pa.int64()), same], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, path)
