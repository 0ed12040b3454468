"""Chat formatting by token-level assembly, with a loss mask (operator 13).

Contents are encoded apart from the template, so no content ever joins with a control string into a token. Control
strings are ids above the vocabulary, spliced between the contents' ids:

    user        <s>[INST] content [/INST]
    assistant   content </s>
    other role  <s>[ROLE] role [/ROLE] content </s>

(without the blanks). The mask covers the assistant's contents; it is the running sum of +1 where one starts and -1
where it ends. Control strings in contents and roles get a backslash behind their first character, and those that have
backslashes there get one more, so that a formatted text can be cut and read back without loss.

Turns are dealt by ranges of (conversation, turn, role, start of text), so a conversation of any length is encoded by many
tasks. A row of the formatted table is a whole conversation, or, where a range or CUT ends first, a piece of one
(`piece`: its order). Digests of whole conversations are taken row by row; pieces, of which a task has those of its first
and last conversation beside longer ones, are sorted by conversation and streamed through one digest each, since
a digest of all turns is sequential.

Edge cases: null texts and null roles are read back as empty; turns of the same number are ordered by role, then text, nulls
as empty; rows without turn come first; rows without conv_id are one conversation of id null; roles other than user
and assistant, the empty one too, are written out; an empty table gives no rows (the query's: conversation -1); repeated rows are
turns of their own; columns beside conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import arrays, storage, token_output

BEGIN, END, USER, USER_END, ROLE, ROLE_END = range(6)
#: Control strings, in the order of their ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: Characters of a text that ranges are cut by.
START = 32
#: Ids from which a conversation goes on in another row.
CUT = 1 << 16

PIECES = "conv_id long, piece long, whole boolean, ids array<int>, loss array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPED = re.compile(r"(<)\\(\\*/?s>)|(\[)\\(\\*/?(?:INST|ROLE)\])")


def escaped(text: Column) -> Column:
    """text with one more backslash in everything that looks like a control string."""
    text = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(\\*/?(INST|ROLE)\])", r"[\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text) if "\\" in text else text


class Coder:
    """The tokenizer's encoder, its ids' bytes, and the control strings' ids behind them."""

    def __init__(self, path: str) -> None:
        self.encoder = token_output.Encoder(path)
        self.encoder.library.encode_special_tokens = True  # in a content they are text
        self.base = self.encoder.library.get_vocab_size()
        alphabet = {c: b for b, c in enumerate(_byte_alphabet())}
        vocabulary = self.encoder.library.get_vocab()
        special = {t.content for t in self.encoder.library.get_added_tokens_decoder().values()}
        parts: list[bytes] = [b""] * (self.base + len(CONTROLS))
        for token, i in vocabulary.items():
            parts[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        parts[self.base :] = [c.encode() for c in CONTROLS]
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def text(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all ids, where each id's bytes end)."""
        size = self.size[ids]
        return self.bytes[arrays.spread(self.at[ids], size)].tobytes(), np.cumsum(size)

    def assemble(self, role: pa.Array, content: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mask, ids of each turn) of turns; role and content escaped, without nulls."""
        kind = np.full(len(role), 2)
        kind[pa.compute.equal(role, "user").to_numpy(zero_copy_only=False)] = 0
        kind[pa.compute.equal(role, "assistant").to_numpy(zero_copy_only=False)] = 1
        other = kind == 2
        named = pa.compute.if_else(pa.array(other), role, "")
        role_ids, role_n = self.encoder.encode(named)
        own_ids, own_n = self.encoder.encode(content)
        before = np.where(kind == 1, 0, 2)
        between = other.astype(np.int64)
        total = before + role_n + between + own_n + 1
        ends = np.cumsum(total)
        first = ends - total
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        ids[ends - 1] = self.base + np.where(kind == 0, USER_END, END)
        ids[first[kind != 1]] = self.base + BEGIN
        ids[first[kind == 0] + 1] = self.base + USER
        ids[first[other] + 1] = self.base + ROLE
        ids[(first + 2 + role_n)[other]] = self.base + ROLE_END
        start = first + before
        ids[arrays.spread(start, role_n)] = role_ids
        start += role_n + between
        ids[arrays.spread(start, own_n)] = own_ids
        step = np.zeros(len(ids) + 1, np.int8)
        loss = (kind == 1) & (own_n > 0)
        step[start[loss]] += 1
        step[(start + own_n)[loss]] -= 1
        return ids, np.cumsum(step[:-1], dtype=np.int8).astype(bool), total

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of formatted ids."""
        data, end = self.text(ids)
        marks = np.flatnonzero(ids >= self.base)
        role, at = "assistant", 0
        for mark, code in zip(marks.tolist(), (ids[marks] - self.base).tolist(), strict=True):
            stop = int(end[mark]) - len(CONTROLS[code])
            if code == USER:
                role = "user"
            elif code == ROLE_END:
                role = unescaped(data[at:stop].decode())
            elif code in (USER_END, END):
                yield role, unescaped(data[at:stop].decode())
                role = "assistant"
            at = int(end[mark])

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        """The text of each run under the mask."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield unescaped(self.text(ids[a:b])[0].decode())


def _byte_alphabet() -> str:
    """The characters that stand for bytes 0 to 255 in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(moved)) for b in range(256))


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder a worker process."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def formatted(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids and loss mask of the conversations in turns (conv_id, turn, role, text), as a table in the shared folder.

    A row is a conversation (whole) or a piece of one, in the order of `piece`.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        conv, cut, first, last, size = None, False, True, None, 0
        code = coder(tokenizer)

        def row(whole: bool) -> pa.RecordBatch:
            ids, mask = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "piece": pa.array([last], pa.int64()), "whole": [whole], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int32())), "loss": pa.ListArray.from_arrays(pa.array([0, len(mask)], pa.int32()), pa.array(mask))})

        started = False
        for batch in arrays.sliced(batches):
            ids, mask, count = code.assemble(batch.column("role"), batch.column("text"))
            ends = np.cumsum(count).tolist()
            at = 0
            for c, place, end in zip(batch.column("conv_id").to_pylist(), batch.column("place").to_pylist(), ends, strict=True):
                if started and c != conv:
                    if held:
                        yield row(not cut and not first)
                    cut, first, size = False, False, 0
                started, conv, last = True, c, place
                held.append((ids[at:end], mask[at:end]))
                size += end - at
                at = end
                if size >= CUT:
                    yield row(False)
                    cut, size = True, 0
        if held:
            yield row(False)

    text, role = (escaped(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("text", "role"))
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    dealt = plain.withColumn("start", F.substring("text", 1, START)).repartitionByRange("conv_id", "turn", "role", "start").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = dealt.select("conv_id", role, text, F.monotonically_increasing_id().alias("place"))
    return storage.written(ordered.mapInArrow(assemble, PIECES), "formatted", compression="zstd")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.chars, self.all = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, code: Coder, ids: np.ndarray, mask: np.ndarray) -> None:
        for role, text in code.turns(ids):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for text in code.learned(ids, mask):
            self.loss.update(text.encode())
            self.chars += len(text)
        self.all += len(code.text(ids)[0].decode())

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.all


def digests(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted table holds, read back from ids and mask alone: turns, text under the mask and formatted text of each conversation."""
    names, kinds = zip(*((x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in DIGESTS.split(", ")), strict=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, now, conv, out = coder(tokenizer), None, None, []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            ids, loss = batch.column("ids"), batch.column("loss")
            for k, (c, whole) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("whole").to_pylist(), strict=True)):
                if now is not None and (whole or c != conv):
                    out.append(now.row(conv))
                    now = None
                now, conv = now or _Digest(), c
                now.add(code, ids[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False))
            if len(out) >= 1000:
                yield table()
                out = []
        if now is not None:
            out.append(now.row(conv))
        if out:
            yield table()
        arrays.trim()

    columns = ["conv_id", "whole", "ids", "loss"]
    parts = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.where("whole").select(*columns).mapInArrow(read, DIGESTS).unionByName(parts.select(*columns).mapInArrow(read, DIGESTS))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(formatted(turns, path), path)
