"""Chat formatting at the level of tokens.

Control tokens are reserved ids outside the vocabulary, spliced between
segments that are encoded each by itself, so no text can produce them.  In the
formatted text they show as control strings; where a text has such a string,
or a backslash, a backslash is put inside it, which reading takes out again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_OPEN = {"user": "[INST]", "system": "<<SYS>>", "assistant": "<s>"}
_CLOSE = {"user": "[/INST]", "system": "<</SYS>>", "assistant": "</s>"}
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Template:
    """Reserved ids begin at ``first_reserved``, in the order of CONTROLS.

    ``ranks`` (bytes to id) and ``pattern`` are a byte-level BPE vocabulary.
    A turn of role user, system or assistant stands between its two controls;
    any other role is named between [ROLE] and [/ROLE] before its text, which
    </s> ends.  Only the text of assistant turns is learned.
    """

    ranks: dict[bytes, int]
    pattern: str
    first_reserved: int
    _encoding: object = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str, pattern: str, first_reserved: int = 50_300) -> Template:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(ranks.values()) >= first_reserved:
            raise ValueError("reserved ids must lie outside the vocabulary")
        return cls(ranks, pattern, first_reserved)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_encoding": None}

    @property
    def encoding(self):  # noqa: ANN201
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("chat", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding

    def segments(self, role: str, text: str) -> list[tuple[str, bool, bool]]:
        """``(string, is a control, is learned)`` in order."""
        if role in _OPEN:
            return [(_OPEN[role], True, False), (escape(text), False, role == "assistant"), (_CLOSE[role], True, False)]
        return [("[ROLE]", True, False), (escape(role), False, False), ("[/ROLE]", True, False), (escape(text), False, False), ("</s>", True, False)]

    def encode(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all turns end to end, their loss mask, and the turns' bounds."""
        parts, learned, owner = [], [], []
        for i, (role, text) in enumerate(turns):
            for string, control, learn in self.segments(role, text):
                parts.append([self.first_reserved + CONTROLS.index(string)] if control else self.encoding.encode_ordinary(string))
                learned.append(learn)
                owner.append(i)
        size = np.array([len(p) for p in parts], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = np.fromiter((t for p in parts for t in p), np.int32, int(edge[-1]))
        # +1 where a learned segment begins, -1 where it ends: the running sum is the mask.
        step = np.zeros(len(ids) + 1, np.int64)
        on = np.array(learned, bool)
        np.add.at(step, edge[:-1][on], 1)
        np.add.at(step, edge[1:][on], -1)
        bounds = edge[np.searchsorted(np.array(owner), np.arange(len(turns) + 1))] if turns else np.zeros(1, np.int64)
        return ids, np.cumsum(step[:-1]) > 0, bounds

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()

    def read(self, ids: np.ndarray) -> tuple[str, str, int]:
        """Role, text and number of formatted characters of one encoded turn."""
        cut = np.flatnonzero(ids >= self.first_reserved)
        names = [CONTROLS[i] for i in ids[cut] - self.first_reserved]
        between = [self.decode(ids[a + 1 : b].tolist()) for a, b in zip(cut[:-1], cut[1:])]
        chars = sum(map(len, names)) + sum(map(len, between))
        if names[0] == "[ROLE]":
            return unescape(between[0]), unescape(between[1]), chars
        return next(r for r, c in _OPEN.items() if c == names[0]), unescape(between[0]), chars


def format_turns(turns: DataFrame, template: Template) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, turn, position, ids, loss, first_token)``, a row for a row.

    Turns of a conversation stand in the order of turn (null first), then
    role, then text; rows that repeat stay.  position counts them from 0 and
    first_token is the place of the first token in the whole conversation.  A
    null role or text counts as empty; turns of a null conv_id form one
    conversation.
    """
    shared = turns.sparkSession.sparkContext.broadcast(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mask, bounds = shared.value.encode([(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])
            offsets = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array(np.diff(bounds), pa.int64())],
                ["conv_id", "turn", "role", "text", "ids", "loss", "n"])

    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    encoded = slim.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss array<boolean>, n long")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return encoded.select("conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("position"), "ids", "loss", before.alias("first_token"))


def read_back(formatted: DataFrame, template: Template) -> DataFrame:
    """Digests of each conversation, made from the ids and masks alone.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.
    Rows stream through in order, so a conversation of any length takes the memory of one turn.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now, out = shared.value, None, []

        def done() -> None:
            if now:
                out.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            out.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, ids, loss in zip(*(batch.column(i) for i in range(3))):
                key = conv.as_py()
                if now is None or now["id"] != key:
                    done()
                    now = {"id": key, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
                ids, loss = np.asarray(ids.values, np.int32), np.array(loss.as_py(), bool)
                role, text, chars = t.read(ids)
                learned = unescape(t.decode(ids[loss].tolist()))
                now["n"] += 1
                now["all"] += chars
                now["chars"] += len(learned)
                now["turns"].update(f"{role}\n{text}\n".encode())
                now["loss"].update(learned.encode())
            yield flush()
        done()
        yield flush()

    ordered = formatted.select("conv_id", "ids", "loss", "position").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.drop("position").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
