"""Prefix trie of conversations by vertical bitmaps.

1. Turns become digests (128 bits of role and text, and the text's code points). Ranges of whole conversation blocks are
   sorted by conversation and turn, and read as a stream that rebuilds each conversation and cuts the range into shards.
2. A shard has a bitset of its conversations for each (position, turn). Depth-first, a node's bitset is intersected with the
   postings of the next position: each intersection is a child, its bits are counted, and its members that end there are
   listed. The lowest bit left names the next posting to try, so no intersection is empty.
3. Nodes carry a digest of their path, by which the shards' nodes are merged. Each merged node is owned by the shard of its
   smallest member; owned children, leaves and savings are summed over the shard's subtrees and then over the shards.

The members that end at a node are hashed as a stream of the shards' lists in the order of their ids, so a node at which
very many conversations end needs no more memory than another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import scratch, stage

#: Conversations and turns at which a shard ends; the last conversation is taken whole.
CONVERSATIONS, TURNS = 4096, 1 << 17
ROOT = b"\0" * 16
NODES = "shard long, nth long, path binary, depth long, conv_id long, n_convs long, chars long, size long, ends binary"
_NODE_TYPES = [*[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 5, pa.binary()]


def borrowed(conv_id: int, most: int) -> int:
    """Turns that a conversation takes from the first one of its block."""
    return zlib.crc32(b"%d" % conv_id) % most if most else 0


def subtrees(conv_ids: list[int], turns: list[list[tuple[bytes, int]]]) -> list[list]:
    """(path, depth, least conversation, conversations, code points, nodes of the subtree, ends) of each node
    in depth-first order. conv_ids ascend; turns are each conversation's (digest, code points)."""
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for k, own in enumerate(turns):
        bit = 1 << k
        for at, (digest, _) in enumerate(own):
            postings[at, digest] = postings.get((at, digest), 0) | bit
        ending[len(own)] = ending.get(len(own), 0) | bit

    def members(bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    out: list[list] = []
    stack = [((1 << len(turns)) - 1, 0, ROOT, 0)] if turns else []
    while stack:
        bits, depth, path, chars = stack.pop()
        first = (bits & -bits).bit_length() - 1
        done = bits & ending.get(depth, 0)
        listed = b",".join(b"%d" % conv_ids[k] for k in members(done)) if done else None
        out.append([path, depth, conv_ids[first], bits.bit_count(), chars, 1, listed])
        left = bits & ~done
        while left:
            digest, n = turns[(left & -left).bit_length() - 1][depth]
            child = bits & postings[depth, digest]
            left &= ~child
            stack.append((child, depth + 1, hashlib.blake2b(path + digest, digest_size=16).digest(), n))
    # in this order the nodes of a subtree follow its top
    above: list[int] = []
    for k, node in enumerate(out):
        while above and out[above[-1]][1] >= node[1]:
            j = above.pop()
            out[j][5] = k - j
        above.append(k)
    for j in above:
        out[j][5] = len(out) - j
    return out


def _shards(block: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        turns: list[list[tuple[bytes, int]]] = []
        base_of, base = None, []  # the first turns of the block's first conversation
        n_turns = 0

        def rebuilt(conv: int, own: list) -> list:
            nonlocal base_of, base
            if conv % block == 0:
                base_of, base = conv, own[:most]
            h = borrowed(conv, most)
            start = base[:h] if base_of == conv - conv % block else []
            return start + own[h:]

        def emit() -> Iterator[pa.RecordBatch]:
            rows = subtrees(ids, turns)
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                cells = [[ids[0]] * len(part), range(i, i + len(part)), *zip(*part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _NODE_TYPES)], names=[f.split()[0] for f in NODES.split(", ")])
            ids.clear()
            turns.clear()

        conv, own = None, []
        for b in batches:
            cid, n = b.column(0).to_pylist(), b.column(3).to_pylist()
            digests = np.ascontiguousarray(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1)).astype("<i8").tobytes()
            for k, c in enumerate(cid):
                if c != conv:
                    if conv is not None:
                        ids.append(conv)
                        turns.append(rebuilt(conv, own))
                        n_turns += len(turns[-1])
                        if len(ids) >= CONVERSATIONS or n_turns >= TURNS:
                            yield from emit()
                            n_turns = 0
                    conv, own = c, []
                own.append((digests[16 * k : 16 * k + 16], n[k]))
        if conv is not None:
            ids.append(conv)
            turns.append(rebuilt(conv, own))
        if ids:
            yield from emit()

    return run


def _summed(table):
    """Sums over the subtrees of a shard's nodes: of owned children, leaves and savings; parent_conv_id of owned nodes, and
    what the merged node has."""
    table = table.sort_by("nth")
    col = lambda name: table.column(name).to_numpy(zero_copy_only=False)
    depth, size, own, total = col("depth"), col("size"), col("own").astype(np.int64), col("total")
    at = np.arange(len(depth))
    up = np.full(len(depth), -1)  # place of each node's parent: the last node before it that is less deep
    seen: list[int] = []
    for k, d in enumerate(depth.tolist()):
        del seen[d:]
        up[k] = seen[d - 1] if d else -1
        seen.append(k)
    below = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[at + size] - s[at]
    inner = up >= 0
    children = np.bincount(up[inner], weights=own[inner], minlength=len(depth)).astype(np.int64)
    first = col("first")
    parents = pa.array(np.where(inner, first[np.maximum(up, 0)], 0), mask=~(inner & (own > 0)))
    cells = [*(table.column(c).combine_chunks() for c in ("path", "first", "depth", "total")), parents, pa.array(children), pa.array(below(own * col("leaf").astype(np.int64))), pa.array(below(own * (total - 1) * col("chars")))]
    return pa.Table.from_arrays(cells, names=["path", "conv_id", "depth", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ends_sha256) from lists of ids that come by path and in their order."""
    path, state, done = None, None, []

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.string())], names=["path", "ends_sha256"])

    for b in batches:
        for p, ends in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if p != path:
                if path is not None:
                    done.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256(ends)
            else:
                state.update(b",")
                state.update(ends)
        if len(done) >= 10_000:
            yield batch(done)
            done = []
    if path is not None:
        done.append((path, state.hexdigest()))
    if done:
        yield batch(done)


def prefix_trie(
    conversations: DataFrame, *, block: int = 100, most: int = 6, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Conversation c is rebuilt of the first h turns of c - c % block and its own turns after its first h, where h is the
    checksum of c modulo ``most`` (0: conversations as they are). Members of a node start with its turns.

    A null turn comes first; ties of turn come in the order of a digest of role and text, so repeated rows are turns of
    their own. A null role or text is empty. Rows without a conversation id take no part. A conversation that has no turn
    after being rebuilt is a member of the root. An empty table has no nodes. Texts have any length, as only their digests
    are kept; a conversation's digests, 20 bytes a turn, have to fit in a task. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(7), text, role).alias("d2"), F.char_length(text).cast("long").alias("n"), F.col(turn_col).alias("turn")
    )
    floor = F.col("conv") - F.pmod("conv", F.lit(block).cast("long"))
    ordered = rows.withColumn("block", floor).repartitionByRange("block").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "d1", "d2")
    facts, sums = ("conv_id", "depth", "n_convs", "parent_conv_id"), ("n_children", "n_leaves", "saved_tokens")
    with scratch() as keep:
        nodes = stage(ordered.select("conv", "d1", "d2", "n").mapInArrow(_shards(block, most), NODES), "trie")
        inner = F.max(F.col("size") > 1)
        merged = nodes.groupBy("path").agg(F.sum("n_convs").alias("total"), F.min("conv_id").alias("first"), inner.alias("inner"))
        weighed = nodes.select("shard", "nth", "path", "depth", "size", "chars", "conv_id").join(merged, "path")
        weighed = weighed.select("shard", "nth", "path", "depth", "size", "chars", "total", "first", (F.col("conv_id") == F.col("first")).alias("own"), (~F.col("inner")).alias("leaf"))
        parts = weighed.groupBy("shard").applyInArrow(_summed, f"path binary, {', '.join(f'{c} long' for c in (*facts, *sums))}")
        whole = parts.groupBy("path").agg(*[F.max(c).alias(c) for c in facts], *[F.sum(c).alias(c) for c in sums])
        ends = nodes.where("ends IS NOT NULL").select("path", "shard", "ends").repartition("path").sortWithinPartitions("path", "shard")
        hashed = ends.mapInArrow(_hashed, "path binary, ends_sha256 string")
        none = F.lit(hashlib.sha256(b"").hexdigest())
        out = whole.join(hashed, "path", "left").select(*facts, *sums, F.coalesce("ends_sha256", none).alias("ends_sha256"))
        keep(nodes)
    return out
