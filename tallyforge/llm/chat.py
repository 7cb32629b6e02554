r"""Chat formatting over a prefix tree of conversations.

A turn is written as ``### ROLE: TEXT</turn>`` and a line end, with role and text escaped, so
that no text can hold what marks a turn: ``\`` becomes ``\\``, ``###`` becomes ``\h`` and
``</turn>`` becomes ``\t`` (and ``:`` in a role ``\c``). A backslash always leads a pair, so
reading back is exact. The loss mask covers the escaped texts of assistant turns.

Conversations that share their first turns share nodes of a prefix tree. A node's path is the
chain of hashes of the turns down to it, so sorting conversations by path is a depth-first
walk, done by a range partitioning and a sort. A task walks its range with the current path
in hand and writes each node once into a pack, a bounded sequence of characters: text, and
per node its start, end, parent and first position id (positions count along the
conversation, so siblings share them), plus the ancestor intervals that its characters may
attend besides earlier ones of their own node. The same is given in token ids: each node's
tokens stand once in the pack, with their places, position ids, ancestor intervals and loss; the
text stays beside them, since a vocabulary that lowers letters cannot give it back. Where a pack is full the next one repeats the
current path, so a first turn shared by a third of all conversations costs one repeat a
pack and no task gathers a whole tree.

Defined results: null text and null role are empty; rows are by turn, then role and text
(null turn first); rows that repeat a turn are each a turn; a null conv_id is a
conversation; turns of any length are written whole; an empty table gives an empty result;
other columns are ignored, under whatever names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import only, read_table, written
from tallyforge.llm.tokens import encoder, vocabulary_path

MARK, END = "### ", "</turn>"
#: A pack is closed at so many characters (a longer path has one of its own) or members.
PACK_CHARS, PACK_MEMBERS = 1 << 18, 2048
_TO = {"\\": "\\\\", "###": "\\h", END: "\\t", ":": "\\c"}
_FROM = {v: k for k, v in _TO.items()}
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_PAIR = re.compile(r"\\.", re.S)
_TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)


def escaped(text: str, of=_TEXT) -> str:
    return of.sub(lambda m: _TO[m[0]], text)


def unescaped(text: str) -> str:
    return _PAIR.sub(lambda m: _FROM[m[0]], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, with the place of its escaped text."""
    head = f"{MARK}{escaped(role, _ROLE)}: "
    body = escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn; raises where it is not of this format."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not formatted by this template")
        out.append((unescaped(m[1]), unescaped(m[2]), *m.span(2)))
        at = m.end()
    return out


NODE = "struct<start: int, end: int, parent: int, position: int, attends: array<struct<start: int, end: int>>, loss_start: int, loss_end: int, token_start: int, token_end: int, token_position: int, token_attends: array<struct<start: int, end: int>>, loss_token_start: int, loss_token_end: int>"
PACK = f"text string, nodes array<{NODE}>, members array<struct<conv_id: long, node: int>>, tokens array<int>"
_INTERVAL = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(_INTERVAL)), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("token_position", pa.int32()), ("token_attends", pa.list_(_INTERVAL)), ("loss_token_start", pa.int32()), ("loss_token_end", pa.int32())])
_MEMBER = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])


def _and_own(attends: list[dict], start: int, end: int) -> list[dict]:
    """A node's ancestor intervals and its own, as one where they lie end to end."""
    if attends and attends[-1]["end"] == start:
        return [*attends[:-1], {"start": attends[-1]["start"], "end": end}]
    return [*attends, {"start": start, "end": end}]


def with_tokens(pack: dict, encode: Callable[[list[str]], list[list[int]]]) -> dict:
    """The pack with the token ids of every node, once, and each node's token place, position and intervals.

    What comes before the loss, the loss, and what comes after are encoded each by itself, so that the loss is
    whole tokens.
    """
    parts = []
    for n in pack["nodes"]:
        ends = [n["start"], n["end"]] if n["loss_start"] is None else [n["start"], n["loss_start"], n["loss_end"], n["end"]]
        parts.append([pack["text"][a:b] for a, b in zip(ends, ends[1:], strict=False)])
    ids = iter(encode([x for p in parts for x in p]))
    tokens: list[int] = []
    for n, p in zip(pack["nodes"], parts, strict=True):
        own = [next(ids) for _ in p]
        up = pack["nodes"][n["parent"]] if n["parent"] >= 0 else None
        n["token_start"] = len(tokens)
        n["token_position"] = 0 if up is None else up["token_position"] + up["token_end"] - up["token_start"]
        n["token_attends"] = [] if up is None else _and_own(up["token_attends"], up["token_start"], up["token_end"])
        n["loss_token_start"], n["loss_token_end"] = (None, None) if len(p) == 1 else (len(tokens) + len(own[0]), len(tokens) + len(own[0]) + len(own[1]))
        for x in own:
            tokens += x
        n["token_end"] = len(tokens)
    return pack | {"tokens": tokens}


def conversation_tokens(pack: dict, node: int) -> list[int]:
    """A member's token ids, from what its last node attends and itself."""
    if node < 0:
        return []
    n = pack["nodes"][node]
    return [t for iv in _and_own(n["token_attends"], n["token_start"], n["token_end"]) for t in pack["tokens"][iv["start"] : iv["end"]]]


class Packer:
    """Writes conversations that come in the order of their paths."""

    def __init__(self, most_chars: int = PACK_CHARS, most_members: int = PACK_MEMBERS):
        self.most = most_chars, most_members
        self._new()

    def _new(self) -> None:
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.members: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> dict | None:
        """Adds a conversation; the pack before it, if that was full."""
        shared = self._shared(turns)
        new = [formatted(r, t) for r, t in turns[shared:]]
        done = None
        if self.members and (len(self.members) >= self.most[1] or self.size + sum(len(t) for t, _, _ in new) > self.most[0]):
            done = self.close()
            shared, new = 0, [formatted(r, t) for r, t in turns]
        del self.path[shared:]
        for turn, (text, a, b) in zip(turns[shared:], new, strict=True):
            parent = self.path[-1][1] if self.path else -1
            up = self.nodes[parent] if self.path else None
            attends = [] if up is None else _and_own(up["attends"], up["start"], up["end"])
            position = 0 if up is None else up["position"] + up["end"] - up["start"]
            loss = (self.size + a, self.size + b) if turn[0] == "assistant" else (None, None)
            self.nodes.append({"start": self.size, "end": self.size + len(text), "parent": parent, "position": position, "attends": attends, "loss_start": loss[0], "loss_end": loss[1]})
            self.text.append(text)
            self.size += len(text)
            self.path.append((turn, len(self.nodes) - 1))
        self.members.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})
        return done

    def _shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        for (own, _), turn in zip(self.path, turns, strict=False):
            if own != turn:
                break
            n += 1
        return n

    def close(self) -> dict | None:
        out = {"text": "".join(self.text), "nodes": self.nodes, "members": self.members} if self.members else None
        self._new()
        return out


def position_ids(node: dict) -> range:
    """The position id of each of a node's characters."""
    return range(node["position"], node["position"] + node["end"] - node["start"])


def conversation(pack: dict, node: int) -> tuple[str, list[tuple[int, int]]]:
    """A member's formatted text and loss intervals, from what its last node attends and itself."""
    text, losses, chain = [], [], []
    k = node
    while k >= 0:
        chain.append(k)
        k = pack["nodes"][k]["parent"]
    last = pack["nodes"][node] if node >= 0 else None
    for iv in [*last["attends"], {"start": last["start"], "end": last["end"]}] if last else []:
        text.append(pack["text"][iv["start"] : iv["end"]])
    for k in reversed(chain):
        n = pack["nodes"][k]
        if n["loss_start"] is not None:
            move = n["position"] - n["start"]
            losses.append((n["loss_start"] + move, n["loss_end"] + move))
    return "".join(text), losses


def packs(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The formatted output: PACK rows, written. vocabulary: a tokenizer's file."""
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    c = only(conversations, c=conv_col, n=turn_col, r=role_col, t=text_col)
    empty = F.lit("")
    turn = F.struct(F.col("n").cast("long").alias("n"), F.coalesce("r", empty).alias("r"), F.coalesce("t", empty).alias("t"))
    whole = c.groupBy(F.col("c").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    step = lambda seen, x: F.concat(seen, F.array(F.sha2(F.concat_ws("\n", F.element_at(F.concat(F.array(F.lit("")), seen), -1), F.sha2(x["r"], 256), F.sha2(x["t"], 256)), 256)))
    path = F.aggregate("turns", F.array().cast("array<string>"), step)
    keyed = whole.withColumn("path", F.array_join(F.transform(path, lambda h: F.substring(h, 1, 24)), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, code = Packer(), encoder(vocabulary)

        def row(p: dict) -> pa.RecordBatch:
            p = with_tokens(p, lambda texts: [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)])
            return pa.RecordBatch.from_arrays([pa.array([p["text"]], pa.string()), pa.array([p["nodes"]], pa.list_(_NODE)), pa.array([p["members"]], pa.list_(_MEMBER)), pa.array([p["tokens"]], pa.list_(pa.int32()))], ["text", "nodes", "members", "tokens"])

        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                done = packer.add(conv_id, [(x["r"], x["t"]) for x in turns.as_py()])
                if done:
                    yield row(done)
        if done := packer.close():
            yield row(done)

    ordered = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return written(ordered.select("conv_id", "turns").mapInArrow(run, PACK), "packs")


def read_back(packed: DataFrame) -> DataFrame:
    """A row for each conversation in the output, parsed and unescaped again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pack in batch.to_pylist():
                for m in pack["members"]:
                    text, losses = conversation(pack, m["node"])
                    turns = parsed(text)
                    loss = "".join(unescaped(text[a:b]) for a, b in losses)
                    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((m["conv_id"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(text)))
            cols = [*zip(*rows, strict=True)] or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packed.select("text", "nodes", "members").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = only(read_table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast(table.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(table.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(packs(table.unionByName(extra)))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(text)
    + (length(text) - length(replace(text, '\', '')))
    - (length(text) - length(replace(text, '###', ''))) // 3
    - 5 * ((length(text) - length(replace(text, '</turn>', ''))) // 7)
    + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, ':', '')))
    - (length(role) - length(replace(role, '###', ''))) // 3
    - 5 * ((length(role) - length(replace(role, '</turn>', ''))) // 7))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
