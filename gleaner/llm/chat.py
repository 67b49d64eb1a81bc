"""Chat formatting over a prefix tree of conversations.

Turns are written ``<|im_start|>role\\ntext<|im_end|>\\n``; control strings inside a text are escaped
reversibly. Conversations that begin with the same turns share their nodes in a prefix tree. The tree is
written depth-first, in blocks: each shared turn is emitted once in its block, with the position it has in
its conversations and the intervals of the block that hold its ancestors, which are what it may attend to
besides itself. The loss mask covers the texts of assistant turns.

Distinct conversations are found first, by the chained hash of their turns, so copies cost one row each. They
are then dealt by ranges of their paths and sorted, which is depth-first order; a task walks its range with
the open path as its only state. A block ends at the end of a range, or when it holds ``BLOCK_TOKENS``
tokens; the next one repeats the path it goes on from, since attention cannot leave a block.

Defined cases: null texts and roles count as empty; turns are ordered by turn, then role and text, nulls
first, so ties and repeated rows are turns of their own; a null conv_id is one conversation; a text may be
empty; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tokens import Encoder
from gleaner.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
BLOCK_TOKENS = 1 << 20
ASSISTANT = "assistant"
_HASH = 12

_NODE = (
    "struct<node_id:string,parent_id:string,block:bigint,offset:bigint,n_tokens:bigint,depth:int,position:bigint,role:string,"
    "ids:array<int>,loss_start:int,loss_end:int,attends:array<struct<lo:bigint,hi:bigint>>>"
)


def escape(text: str) -> str:
    """Double every backslash and put one into ``<|``, so that no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    """Roles end at a line end, which is escaped as well."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    """Undo either."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def chained(turns: list[tuple[str, str]]) -> list[bytes]:
    """A hash of every prefix of a conversation."""
    out, last = [], b""
    for role, text in turns:
        body = b"".join(len(x).to_bytes(8, "big") + x for x in (role.encode(), text.encode()))
        last = hashlib.blake2b(last + body, digest_size=_HASH).digest()
        out.append(last)
    return out


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        path, leaf = [], []
        for turns in batch.column("turns").to_pylist():
            chain = chained([(t["role"], t["text"]) for t in turns])
            path.append(b"".join(chain))
            leaf.append(chain[-1].hex())
        out = {"path": pa.array(path, pa.binary()), "leaf": pa.array(leaf, pa.string())}
        yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names}, **out})


def _emit(vocabulary: str | None, block_tokens: int):
    """mapInArrow over sorted distinct conversations: the new nodes of each, and its path of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        block = TaskContext.get().partitionId() << 32
        used = 0
        open_: list[dict] = []  # the path last written
        kind = None
        for batch in batches:
            out: dict[str, list] = {"leaf": [], "nodes": [], "new": []}
            for leaf, path, turns in zip(batch.column("leaf").to_pylist(), batch.column("path").to_pylist(), batch.column("turns").to_pylist()):
                if used >= block_tokens:
                    block, used, open_ = block + 1, 0, []
                chain = [path[i : i + _HASH] for i in range(0, len(path), _HASH)]
                shared = 0
                while shared < min(len(chain), len(open_)) and open_[shared]["hash"] == chain[shared]:
                    shared += 1
                del open_[shared:]
                new = []
                for k in range(shared, len(chain)):
                    role, text = turns[k]["role"], turns[k]["text"]
                    head = encoder.plain_ids(f"{START}{escape_role(role)}\n")
                    body = encoder.plain_ids(escape(text))
                    ids = head + body + encoder.plain_ids(f"{END}\n")
                    above = open_[-1] if open_ else None
                    attends = [] if above is None else _joined(above["attends"], above["offset"], above["end"])
                    position = 0 if above is None else above["position"] + above["end"] - above["offset"]
                    loss = (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)
                    node = {"hash": chain[k], "id": f"{block}:{used}", "offset": used, "end": used + len(ids), "position": position, "attends": attends}
                    new.append({
                        "node_id": node["id"], "parent_id": above["id"] if above else None, "block": block, "offset": used, "n_tokens": len(ids), "depth": k,
                        "position": position, "role": role, "ids": ids, "loss_start": loss[0], "loss_end": loss[1],
                        "attends": [{"lo": a, "hi": b} for a, b in attends],
                    })
                    used += len(ids)
                    open_.append(node)
                out["leaf"].append(leaf)
                out["nodes"].append([x["id"] for x in open_])
                out["new"].append(new)
            kind = kind or pa.list_(pa.struct([
                ("node_id", pa.string()), ("parent_id", pa.string()), ("block", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("depth", pa.int32()),
                ("position", pa.int64()), ("role", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
                ("attends", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
            ]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["leaf"], pa.string()), pa.array(out["nodes"], pa.list_(pa.string())), pa.array(out["new"], kind)], names=["leaf", "nodes", "new"]
            )

    return run


def _joined(attends: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """Intervals of the ancestors of a child: its parent's and the parent itself, adjoining ones merged."""
    if attends and attends[-1][1] == lo:
        return [*attends[:-1], (attends[-1][0], hi)]
    return [*attends, (lo, hi)]


def prefix_tree(conversations: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, conversations, members)`` of ``conversations (conv_id, turn, role, text)``.

    ``nodes`` holds the written tree, one row per turn and block: tokens, position of the first, loss interval
    within the node, and the intervals of its block that its ancestors take. The second names the nodes of each
    distinct conversation in order, the third the distinct conversation of every conv_id.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    whole = rows.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "role", "text"))), lambda x: F.struct(x["role"], x["text"])).alias("turns")
    )
    named = materialize(whole.mapInArrow(_paths, "conv_id long, turns array<struct<role:string,text:string>>, path binary, leaf string"), "conversations")
    distinct = named.groupBy("leaf").agg(F.min(F.struct("path", "turns")).alias("c")).select("leaf", "c.path", "c.turns")
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    written = materialize(ordered.mapInArrow(_emit(vocabulary, block_tokens), f"leaf string, nodes array<string>, new array<{_NODE}>"), "tree")
    nodes = written.select(F.explode("new").alias("n")).select("n.*")
    return nodes, written.select("leaf", "nodes"), named.select("conv_id", "leaf")


def parse(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = text.index("\n", at)
        stop = text.index(END, line)
        turns.append((unescape(text[at + len(START) : line]), unescape(text[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns


def _read_back(vocabulary: str | None):
    """mapInArrow: digests of every distinct conversation from the tokens of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for parts in batch.column("parts").to_pylist():
                parts.sort(key=lambda x: x["k"])
                text = "".join(encoder.text(x["ids"]) for x in parts)
                turns = parse(text)
                loss = "".join(unescape(encoder.text(x["ids"][x["loss_start"] : x["loss_end"]])) for x in parts)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            kinds = {k: pa.string() if k.endswith("sha256") else pa.int64() for k in out}
            yield pa.RecordBatch.from_pydict({"leaf": batch.column("leaf"), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    return run


def formatted(conversations: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per conversation with digests of its turns and of the text under the loss mask, read back."""
    nodes, distinct, members = prefix_tree(conversations, vocabulary, block_tokens)
    paths = distinct.select("leaf", F.posexplode("nodes").alias("k", "node_id"))
    parts = paths.join(nodes.select("node_id", "ids", "loss_start", "loss_end"), "node_id")
    whole = parts.groupBy("leaf").agg(F.collect_list(F.struct("k", "ids", "loss_start", "loss_end")).alias("parts"))
    read = whole.mapInArrow(_read_back(vocabulary), "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(read, "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", F.col("leaf").alias("tree_leaf"))
