"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from the head of a base conversation and its own turns behind its own
head. No rebuilt text is ever made:

1. Turns are numbered and get prefix fingerprints q(n) = sum of h(turn i) * B^i over i <= n,
   modulo the prime 2^61 - 1, in two lanes. (n, q) with (n, q)(m, r) = (n + m, q + B^n r) is a
   monoid, so a conversation may lie over many range partitions: each one scans its own part and
   the parts' products are put in front afterwards.
2. The rebuilt prefix of depth d is a base head, or base head times the own suffix:
   q_base(g) + (q_own(n) - q_own(h)) * B^(g - h), worked out from stored products alone.
3. Equal (depth, fingerprint) is a node. Each node's members must share the parent and the last
   turn's digest, and all turns of one digest must equal, in role and text, the stored turn that
   the digest's first reference names. Where any of this fails, all is done again by other
   constants.
4. Sums over subtrees are sums over members: a node's value stands with its smallest member, at
   its depth; running sums from the deepest turn up, added over a node's members, are the sum
   over its subtree.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import written

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
NODE = ["depth", "f1", "f2"]


@dataclass(frozen=True)
class PrefixTrie:
    """``longest_head``: turns that a base may lend at most; ``piece``: ids in one piece of a list to hash; ``tries``: sets of constants."""

    longest_head: int = 8
    piece: int = 256
    seed: int = 1
    tries: int = 8


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, by halves of 32 bits (2^64 = 8 and 2^61 = 1 there)."""
    low, s29, s32, s61 = np.uint64(0xFFFFFFFF), np.uint64(29), np.uint64(32), np.uint64(61)
    a1, a0, b1, b0 = a >> s32, a & low, b >> s32, b & low
    middle, least = a1 * b0 + a0 * b1, a0 * b0
    out = (a1 * b1 << np.uint64(3)) + (middle >> s29) + ((middle & np.uint64((1 << 29) - 1)) << s32) + (least & _P) + (least >> s61)
    out = (out & _P) + (out >> s61)
    return np.where(out >= _P, out - _P, out)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    return np.where(out >= _P, out - _P, out)


def _bases(seed: int) -> tuple[int, int]:
    r = random.Random(seed)
    return r.randrange(1 << 32, PRIME), r.randrange(1 << 32, PRIME)


def _sorted(df: DataFrame, *order) -> DataFrame:
    """Rows in one global order, dealt to ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _carried(df: DataFrame, key: str, values: list[str], combine: Callable, unit: tuple) -> DataFrame:
    """pid, key, and as ``c_`` columns what the earlier parts of that key sum up to, for parts that continue a key.

    ``df`` has pid, seq (row number in the part) and ``values`` at each row up to that row. Two
    rows a part pass through the driver.
    """
    spark = df.sparkSession
    edge = df.groupBy("pid").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max("seq").alias("seq"))
    rows = df.select("pid", "seq", *values).join(F.broadcast(edge), ["pid", "seq"]).orderBy("pid").collect()
    out, current, acc = [], None, unit
    for r in rows:
        part = tuple(r[v] for v in values)
        goes_on = r.low == current
        if goes_on:
            out.append((r.pid, r.low, *acc))
        acc = combine(acc, part) if goes_on and r.high == r.low else part
        current = r.high
    schema = "pid int, " + key + " long, " + ", ".join(f"c_{v} long" for v in values)
    return F.broadcast(spark.createDataFrame(out, schema))  # at most one row a part


def scan_turns(turns: DataFrame, seed: int) -> DataFrame:
    """Turns in order with the prefix products of their part: pid, seq, conv_id, n, q1, q2, p1, p2 (before the turn), size, t1, t2, role, text."""
    b1, b2 = _bases(seed)
    key = seed.to_bytes(8, "big")

    def run(batches):
        pid, seq, last = TaskContext.get().partitionId(), 0, None
        n = q1 = q2 = w1 = w2 = 0
        for batch in batches:
            role, text = batch.column("role"), batch.column("text")
            rows = []
            for c, r, t in zip(batch.column("conv_id").to_pylist(), role.cast(pa.binary()).to_pylist(), text.cast(pa.binary()).to_pylist()):
                if c != last:
                    n, q1, q2, w1, w2, last = 0, 0, 0, 1, 1, c
                digest = hashlib.blake2b(len(r).to_bytes(8, "big") + r + t, digest_size=16, key=key).digest()
                t1, t2 = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                p1, p2, w1, w2, n = q1, q2, w1 * b1 % PRIME, w2 * b2 % PRIME, n + 1
                q1, q2 = (q1 + t1 * w1) % PRIME, (q2 + t2 * w2) % PRIME
                rows.append((n, q1, q2, p1, p2, t1, t2))
            cols = np.array(rows, np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), pid, np.int32)), pa.array(np.arange(seq, seq + len(rows))), batch.column("conv_id"),
                 *(pa.array(c) for c in cols), pc.binary_length(text).cast(pa.int64()), role, text],
                names=["pid", "seq", "conv_id", "n", "q1", "q2", "p1", "p2", "t1", "t2", "size", "role", "text"])
            seq += len(rows)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"), F.substring(text, 1, 64).alias("head"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("copy"))
    ordered = _sorted(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("tie"), F.col("copy"))
    return written(ordered.select("conv_id", "role", "text").mapInArrow(
        run, "pid int, seq long, conv_id long, n long, q1 long, q2 long, p1 long, p2 long, t1 long, t2 long, size long, role string, text string"), "turns")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _with(batch: pa.RecordBatch, names: list[str], new: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(new[n].view(np.int64)) if n in new else batch.column(n) for n in names], names=names)


def place_turns(turns: DataFrame, seed: int) -> DataFrame:
    """Turns without texts by their position in the whole conversation: conv_id, n, q1, q2, p1, p2, size, t1, t2."""
    bases = _bases(seed)

    def combine(x, y):
        return (x[0] + y[0], *((q + pow(b, x[0], PRIME) * r) % PRIME for b, q, r in zip(bases, x[1:], y[1:])))

    carry = _carried(turns, "conv_id", ["n", "q1", "q2"], combine, (0, 0, 0))
    names = ["conv_id", "n", "q1", "q2", "p1", "p2", "size", "t1", "t2"]

    def run(batches):
        for batch in batches:
            before = batch.column("c_n").to_numpy()
            new = {"n": (batch.column("n").to_numpy() + before).view(np.uint64)}
            for lane, b in zip("12", bases):
                powers = {k: pow(b, int(k), PRIME) for k in np.unique(before)}
                front = np.array([powers[k] for k in before], np.uint64)
                for x in ("q", "p"):
                    new[x + lane] = add(multiply(front, _column(batch, x + lane)), _column(batch, "c_q" + lane))
            yield _with(batch, names, new)

    joined = turns.drop("role", "text", "seq").join(carry, ["pid", "conv_id"], "left").fillna(0, ["c_n", "c_q1", "c_q2"])
    return written(joined.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "places")


def rebuilt_prefixes(places: DataFrame, base: Column, keep: Column, cfg: PrefixTrie, seed: int) -> DataFrame:
    """conv_id, depth, f1, f2, p1, p2 (the parent's fingerprint), size, t1, t2 (of the last turn), length: a row per prefix, depth 0 included."""
    inverse = [[pow(b, -k, PRIME) for k in range(cfg.longest_head + 1)] for b in _bases(seed)]
    at_head = F.col("n") == F.col("keep")
    own = places.withColumn("keep", keep).groupBy("conv_id").agg(
        F.max("n").alias("turns"), F.max("keep").cast("int").alias("keep"), *(F.max(F.when(at_head, F.col(f"q{i}"))).alias(f"o{i}") for i in "12")).withColumn("base", base)
    lent = places.filter(F.col("n") <= cfg.longest_head).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("n", "q1", "q2", "p1", "p2", "size", "t1", "t2"))).alias("lent"))
    head = F.when(F.col("lent").isNull() | (F.col("keep") < 1), F.slice("lent", 1, 0)).otherwise(F.slice("lent", 1, F.greatest("keep", F.lit(1))))
    convs = own.join(lent, "base", "left").withColumn("lent", head)
    taken = F.coalesce(F.when(F.size("lent") > 0, F.size("lent")), F.lit(0))
    convs = convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("keep"), F.lit(0)))
    for i in "12":
        convs = convs.withColumn(f"e{i}", F.when(F.col("taken") > 0, F.element_at("lent", -1)[f"q{i}"]).otherwise(F.lit(0).cast("long")))
    convs = written(convs.fillna(0, ["o1", "o2"]), "conversations")

    out = ["conv_id", "depth", "f1", "f2", "p1", "p2", "size", "t1", "t2", "length"]
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *(zero.alias(c) for c in out[1:-1]), "length")
    heads = convs.select("conv_id", "length", F.explode("lent").alias("t")).select(
        "conv_id", F.col("t.n").alias("depth"), F.col("t.q1").alias("f1"), F.col("t.q2").alias("f2"), "t.p1", "t.p2", "t.size", "t.t1", "t.t2", "length")

    def run(batches):
        for batch in batches:
            shift = (batch.column("keep").to_numpy() - batch.column("taken").to_numpy()).astype(np.int64)
            new = {"depth": (batch.column("n").to_numpy() - shift).view(np.uint64)}
            for lane, back in zip("12", inverse):
                factor = np.array(back, np.uint64)[shift]
                front, own_head = _column(batch, "e" + lane), _column(batch, "o" + lane)
                for to, x in (("f", "q"), ("p", "p")):
                    own_part = add(_column(batch, x + lane), _P - own_head)
                    new[to + lane] = add(front, multiply(own_part, factor))
            yield _with(batch, out, new)

    some = convs.select("conv_id", "keep", "taken", "length", "o1", "o2", "e1", "e2")
    tails = places.join(some, "conv_id").filter("n > keep").mapInArrow(run, ", ".join(f"{c} long" for c in out))
    return written(roots.unionByName(heads).unionByName(tails), "prefixes")


def _turns_differ(turns: DataFrame) -> int:
    """Turns that differ, in role or text, from the stored turn that their digest's first reference names."""
    ref = turns.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("uses"), F.min("pid").alias("pid")).filter("uses > 1").drop("uses")
    ref = turns.join(ref, ["t1", "t2", "pid"]).groupBy("t1", "t2", "pid").agg(F.min("seq").alias("seq"))
    named = turns.join(ref.select("pid", "seq"), ["pid", "seq"]).select("t1", "t2", F.col("role").alias("role_0"), F.col("text").alias("text_0"))
    off = turns.select("t1", "t2", "role", "text").join(named, ["t1", "t2"]).filter("role <> role_0 or text <> text_0")
    return off.agg(F.count(F.lit(1))).first()[0]


def _member_hashes(ends: DataFrame, cfg: PrefixTrie) -> DataFrame:
    """depth, f1, f2, ends_sha256: SHA-256 of each node's conv_ids, ascending, joined by commas.

    Ranges over (node, id) cut a large node's ids into many tasks, which join them in pieces; the
    last step reads one row per piece, in order, and holds one batch of pieces.
    """
    def pieces(batches):
        node, ids = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if row[:3] != node or len(ids) == cfg.piece:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = row[:3], []
                ids.append(row[3])
            yield as_batch(out)
        if ids:
            yield as_batch([(*node, ids[0], ",".join(map(str, ids)))])

    def as_batch(rows):
        cols = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=[*NODE, "first", "ids"])

    def digests(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for d, f1, f2, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (d, f1, f2) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, f1, f2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield hashed(out)
        if node:
            yield hashed([(*node, state.hexdigest())])

    def hashed(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])

    cut = _sorted(ends.select(*NODE, "conv_id"), *NODE, "conv_id").mapInArrow(pieces, "depth long, f1 long, f2 long, first long, ids string")
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = cut.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return whole.mapInArrow(digests, "depth long, f1 long, f2 long, ends_sha256 string")


def _subtree_sums(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, f1, f2, n_leaves, saved_tokens."""
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    rows = prefixes.select("conv_id", *NODE).join(own, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaf"])
    names = ["seq", "conv_id", *NODE, "saved", "leaf"]

    def run(batches):
        pid, seq, last, acc = TaskContext.get().partitionId(), 0, None, {"saved": 0, "leaf": 0}
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(conv)]))
            new = {"seq": np.arange(seq, seq + len(conv))}
            for c in acc:
                total = np.cumsum(batch.column(c).to_numpy())
                front = np.r_[0, total][starts]
                front[0] -= acc[c] if conv[0] == last else 0
                new[c] = total - front[run_of]
                acc[c] = int(new[c][-1])
            last, seq = conv[-1], seq + len(conv)
            out = _with(batch, [n for n in names if n != "seq"], {k: v for k, v in new.items() if k != "seq"})
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), pid, np.int32)), pa.array(new["seq"]), *out.columns], names=["pid", *names])

    upward = _sorted(rows.withColumn("up", -F.col("depth")), "conv_id", "up").select("conv_id", *NODE, "saved", "leaf")
    sums = written(upward.mapInArrow(run, "pid int, " + ", ".join(f"{c} long" for c in names)), "sums")
    carry = _carried(sums, "conv_id", ["saved", "leaf"], lambda x, y: (x[0] + y[0], x[1] + y[1]), (0, 0))
    whole = sums.join(carry, ["pid", "conv_id"], "left").fillna(0, ["c_saved", "c_leaf"])
    return whole.groupBy(*NODE).agg(F.sum(F.col("leaf") + F.col("c_leaf")).alias("n_leaves"), F.sum(F.col("saved") + F.col("c_saved")).alias("saved_tokens"))


def _nodes(turns: DataFrame, base: Column, keep: Column, cfg: PrefixTrie, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Prefixes, their nodes, and whether every node's members are shown to be equal."""
    scanned = scan_turns(turns, seed)
    prefixes = rebuilt_prefixes(place_turns(scanned, seed), base, keep, cfg, seed)
    same = ["p1", "p2", "t1", "t2"]
    nodes = written(prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"),
        *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"most_{c}") for c in same)), "nodes")
    mixed = nodes.filter(" or ".join(f"{c} <> most_{c}" for c in same)).agg(F.count(F.lit(1))).first()[0]
    return prefixes, nodes, mixed == 0 and _turns_differ(scanned) == 0


def prefix_trie(turns: DataFrame, base: Column, keep: Column, cfg: PrefixTrie = PrefixTrie()) -> DataFrame:
    """A row per distinct prefix of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, turn, role, text. ``base`` and ``keep`` (at most ``longest_head``) are
    expressions of ``conv_id``: conversation c becomes the first ``keep`` turns of ``base`` (all
    it has; none where there is no such conversation), then its own turns after its first
    ``keep``. A null role or text is empty. Turns stand by turn, null first; ties by role, by the
    text's first 64 characters, then by a hash of the text; repeated rows are turns of their own.
    Rows without conv_id belong to no conversation. A very long conversation is dealt to many
    tasks. Other columns are not read. The root (depth 0) has a null parent and no text; an empty
    table gives an empty table.
    """
    for i in range(cfg.tries):
        prefixes, nodes, equal = _nodes(turns, base, keep, cfg, cfg.seed + i)
        if equal:
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes met in each of {cfg.tries} tries")
    above = [F.col("depth") - 1, F.col("p1"), F.col("p2")]
    to = [c.alias(n) for c, n in zip(above, NODE)]
    children = nodes.filter("depth > 0").select(*to).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(*(F.col(c).alias(f"up_{c}") for c in NODE), F.col("conv_id").alias("parent_conv_id"))
    hashes = _member_hashes(prefixes.filter("depth = length"), cfg)
    out = nodes.join(children, NODE, "left").join(_subtree_sums(prefixes, nodes), NODE).join(hashes, NODE, "left")
    out = out.join(parents, [c == F.col(f"up_{n}") for c, n in zip(above, NODE)], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
