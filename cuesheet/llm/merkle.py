"""Merkle manifest of a dataset: parents keep their SHA-256 states, folding resumes them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import LOWER, UPPER, narrow, table
from cuesheet.plans.ordered import row_numbers
from cuesheet.session import materialize

#: Children of a node.
FAN = 16


def _root_bits(n: int, power: int) -> int:
    """First 32 bits of the fractional part of a root of n."""
    target, lo, hi = n << 32 * power, 0, n << 32
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**power <= target else (lo, mid - 1)
    return lo & 0xFFFFFFFF


@cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    """Initial state (square roots of primes) and round constants (cube roots of primes) of SHA-256."""
    primes = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
    return np.array([_root_bits(p, 2) for p in primes[:8]], np.uint32), np.array([_root_bits(p, 3) for p in primes[:64]], np.uint32)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) each; 32-bit words."""

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x >> np.uint32(r)) | (x << np.uint32(32 - r))

    w = list(block.T.copy())
    a, b, c, d, e, f, g, h = state.T.copy()
    for t, k in enumerate(_constants()[1]):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (turn(x, 7) ^ turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (turn(y, 17) ^ turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + ((e & f) ^ (~e & g)) + k + w[t]
        two = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return state + np.stack((a, b, c, d, e, f, g, h), axis=1)


_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) bytes as hex text: just one block (n, 16) each."""
    return _HEX[digests].reshape(len(digests), 64).view(">u4").astype(np.uint32)


def last_block(children: np.ndarray) -> np.ndarray:
    """The padding behind that many blocks of hex text."""
    out = np.zeros((len(children), 16), np.uint32)
    out[:, 0], out[:, 15] = 1 << 31, children * 512
    return out


def state_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.astype(">u4")).view(np.uint8).reshape(-1, 32)


def state_words(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).reshape(-1, 32).view(">u4").astype(np.uint32)


def absorb(children: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest (n, 32) of every node and its states (n, FAN, 32) before each child; children are (n, FAN, 32), padded."""
    state = np.repeat(_constants()[0][None], len(children), axis=0)
    states = np.zeros(children.shape, np.uint8)
    for slot in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > slot)
        states[has, slot] = state_bytes(state[has])
        state[has] = compress(state[has], hex_block(children[has, slot]))
    return state_bytes(compress(state, last_block(sizes))), states


def resume(state: np.ndarray, child: np.ndarray, right: np.ndarray, n_right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Digests of nodes with another child in one slot: from the state before the slot, the child and the right siblings on."""
    now = compress(state_words(state), hex_block(child))
    for j in range(int(n_right.max(initial=0))):
        has = np.flatnonzero(n_right > j)
        now[has] = compress(now[has], hex_block(right[has, j]))
    return state_bytes(compress(now, last_block(size)))


def field(value: Column) -> Column:
    """A value in a leaf: its UTF-8 length, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, digest) to their parents (grp, idx, m, digest, children, states): a run of FAN nodes each."""

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                raw = some.column(2).to_pylist()
                sizes = np.array([len(r) // 32 for r in raw], np.int64)
                children = np.frombuffer(b"".join(r.ljust(32 * FAN, b"\0") for r in raw), np.uint8).reshape(-1, FAN, 32)
                digest, states = absorb(children, sizes)
                new = [pa.array(sizes, pa.int32()), pa.array([d.tobytes() for d in digest], pa.binary()), some.column(2).cast(pa.binary())]
                new.append(pa.array([s[:m].tobytes() for s, m in zip(states, sizes)], pa.binary()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *new], names=["grp", "idx", "m", "digest", "children", "states"])

    run = nodes.groupBy("grp", F.expr(f"idx div {FAN}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("c"))
    # lists of bytes are joined as hex text and packed again: concat of binary takes no array
    packed = run.select("grp", F.col("run").alias("idx"), F.unhex(F.concat_ws("", F.transform("c", lambda x: F.hex(x["digest"])))).alias("children"))
    return packed.mapInArrow(hash_runs, "grp string, idx long, m int, digest binary, children binary, states binary")


class Tree:
    """Levels of the trees of all groups: levels[l] has the nodes of level l + 1; ``tops`` the last node of each group."""

    def __init__(self, leaves: DataFrame, name: str):
        """``leaves`` are (grp, idx, digest), idx from 0 in each group."""
        self.levels: list[DataFrame] = []
        counts = materialize(leaves.groupBy("grp").agg(F.count("*").alias("n")), f"{name}-counts")
        nodes, level = leaves, 0
        self.tops = leaves.join(counts.where("n = 1"), "grp", "left_semi").select("grp", "digest", F.lit(0).alias("level"))
        counts = counts.where("n > 1")
        while not counts.isEmpty():
            level += 1
            nodes = materialize(_parents(nodes.join(counts, "grp", "left_semi")), f"{name}-level")
            self.levels.append(nodes)
            counts = counts.select("grp", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
            self.tops = self.tops.unionByName(nodes.join(counts.where("n = 1"), "grp", "left_semi").select("grp", "digest", F.lit(level).alias("level")))
            counts = materialize(counts.where("n > 1"), f"{name}-counts")

    def paths(self, above: DataFrame, down_to: int) -> DataFrame:
        """(grp, idx, path, ...) of the nodes of level ``down_to`` (0: leaves); ``above`` has (grp, level, path, ...) of each group's top.

        A step of a path is the number of children of the parent, the node's
        slot, the parent's state before it and the siblings; a path has its own
        step first, then those of the parent.  Every parent hands its path to
        its children, FAN at most.
        """
        rest = [c for c in above.columns if c not in ("grp", "level", "path")]
        found = None
        for level in range(len(self.levels), down_to - 1, -1):
            tops = above.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "path", *rest)
            if found is None:
                found = tops
                continue
            parent = self.levels[level].select("grp", "idx", "m", "children", "states").join(found, ["grp", "idx"])
            slots = parent.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            step = F.expr(
                "concat(unhex(lpad(hex(m), 2, '0')), unhex(lpad(hex(slot), 2, '0')), substring(states, slot * 32 + 1, 32),"
                " substring(children, 1, slot * 32), substring(children, slot * 32 + 33, 512))"
            )
            found = slots.select("grp", (F.col("idx") * FAN + F.col("slot")).alias("idx"), F.concat(step, F.col("path")).alias("path"), *rest).unionByName(tops)
        return found


def _steps(path: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(children, slot, state, siblings) of each level of a path."""
    out, at = [], 0
    while at < len(path):
        m, slot = path[at], path[at + 1]
        out.append((m, slot, path[at + 2 : at + 34], path[at + 34 : at + 34 + 32 * (m - 1)]))
        at += 34 + 32 * (m - 1)
    return out


def fold(leaves: np.ndarray, paths: list[list[tuple[int, int, bytes, bytes]]]) -> np.ndarray:
    """Root digests (n, 32) when each leaf (n, 32) is put into its place; level by level over all rows at once."""
    now = leaves.copy()
    for t in range(max(map(len, paths), default=0)):
        rows = np.array([i for i, p in enumerate(paths) if len(p) > t])
        steps = [paths[i][t] for i in rows]
        size, slot = np.array([s[0] for s in steps]), np.array([s[1] for s in steps])
        state = np.frombuffer(b"".join(s[2] for s in steps), np.uint8).reshape(-1, 32)
        right = b"".join(s[3][32 * s[1] :].ljust(32 * (FAN - 1), b"\0") for s in steps)
        now[rows] = resume(state, now[rows], np.frombuffer(right, np.uint8).reshape(-1, FAN - 1, 32), size - 1 - slot, size)
    return now


def _prove(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, folded leaf, path, subroot, root) to the result columns."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                col = {n: some.column(i).to_pylist() for i, n in enumerate(some.schema.names)}
                paths = [_steps(p) for p in col["path"]]
                proofs = [hashlib.sha256(b"".join(s[3] for s in p).hex().encode()).hexdigest() for p in paths]
                folded = fold(np.frombuffer(b"".join(col["replaced"]), np.uint8).reshape(-1, 32), paths)
                out = [[x.hex() for x in col[n]] for n in ("leaf", "subroot", "root")] + [proofs, [f.tobytes().hex() for f in folded]]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, pa.string()) for c in out)], names=names)

    ddl = ", ".join(["doc_id long", *(f"{n} string" for n in names[1:])])
    source = rows.select("doc_id", "leaf", F.coalesce("tampered", "leaf").alias("replaced"), "path", "subroot", "root")
    return source.mapInArrow(prove, ddl).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, tampered: Column, tamper: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are hashes of ``fields`` (doc_id, source and text among them).  Each
    source has a tree over its leaves by doc_id, and the sources, null first,
    have one over theirs.  Every parent is stored with its hash state before
    each child; ``folded_root`` is computed from there with the leaf (where
    ``tampered`` holds, the leaf with ``tamper`` as its text) and the right
    siblings.  Null fields count as ``-``; rows without doc_id come first and are
    not tampered with; rows that repeat an id are leaves each, ordered by hash; an empty
    table has no rows and no root.
    """
    base = narrow(docs, **{f: f for f in fields})
    leaf = lambda text: F.unhex(F.sha2(F.concat(*(field(text if f == "text" else F.col(f)) for f in fields)), 256))
    keyed = base.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"),
        leaf(F.col("text")).alias("digest"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf(tamper)).alias("tampered"),
        F.monotonically_increasing_id().alias("uid"),
    )
    order = ["doc_id", "digest", "uid"]
    ranges = materialize(keyed, "leaves").repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id())
    leaves = row_numbers(materialize(ranges, "leaf-ranges"), ["grp"], [F.col(c) for c in order], "idx", F.col("part"))
    leaves = materialize(leaves.withColumn("idx", F.col("idx") - 1).drop("part", "uid"), "leaves")
    inner = Tree(leaves.select("grp", "idx", "digest"), "tree")
    tops = materialize(inner.tops, "subroots")
    ranked = materialize(tops.repartitionByRange("grp").withColumn("part", F.spark_partition_id()), "source-ranges")
    ranked = materialize(
        row_numbers(ranked.withColumn("all", F.lit("")), ["all"], "grp", "idx", F.col("part")).withColumn("idx", F.col("idx") - 1), "sources"
    )
    outer = Tree(ranked.select(F.col("all").alias("grp"), "idx", "digest"), "top")
    root = outer.tops.select("grp", "level", F.unhex(F.lit("")).alias("path"), F.col("digest").alias("root"))
    above = outer.paths(root, 0).select("idx", "path", "root").join(ranked.select("idx", F.col("grp"), "level", F.col("digest").alias("subroot")), "idx").drop("idx")
    paths = inner.paths(materialize(above, "source-paths"), 0)
    return _prove(leaves.withColumnRenamed("digest", "leaf").join(paths, ["grp", "idx"]))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(docs, tampered=fifth, tamper=F.translate("text", UPPER, LOWER))


QUERIES = {"op12_merkle": op12_merkle}


def _tree_sql(name: str, source: str, levels: int) -> str:
    """CTEs over ``source`` (grp, idx, d): name0 .. name<levels>, and name_s<l>, the siblings of each node on its way up."""
    out = [f"{name}0 AS (SELECT grp, idx, d FROM {source})"]
    for k in range(levels):
        out.append(
            f"""{name}_s{k} AS (
      SELECT grp, idx, d, count(*) OVER (PARTITION BY grp) > 1 AS many,
             coalesce(string_agg(d, '') OVER (PARTITION BY grp, idx // {FAN} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
             coalesce(string_agg(d, '') OVER (PARTITION BY grp, idx // {FAN} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
      FROM {name}{k})"""
        )
        out.append(
            f"""{name}{k + 1} AS (
      SELECT grp, idx // {FAN} AS idx, CASE WHEN bool_or(many) THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE min(d) END AS d
      FROM {name}_s{k} GROUP BY grp, idx // {FAN})"""
        )
    return ",\n    ".join(out)


def _climb_sql(name: str, tree: str, source: str, levels: int) -> str:
    """CTEs name0 .. name<levels>: rows of ``source`` (grp, idx, f, proof, ...) on their way up the tree."""
    out = [f"{name}0 AS (SELECT * FROM {source})"]
    for k in range(levels):
        out.append(
            f"""{name}{k + 1} AS (
      SELECT r.* REPLACE (r.idx // {FAN} AS idx, CASE WHEN many THEN sha256(pre || f || post) ELSE f END AS f,
                          CASE WHEN many THEN proof || pre || post ELSE proof END AS proof)
      FROM {name}{k} r JOIN {tree}_s{k} s ON r.grp = s.grp AND r.idx = s.idx)"""
        )
    return ",\n    ".join(out)


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _oracle(inner: int = 6, outer: int = 4) -> str:
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    head = "".join(_field_sql(f) + " || " for f in ("doc_id", "source", "lang", "n_chars"))
    bit = "CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END"
    byte = reduce(lambda c, k: f"list_reduce([{c}, 0::BIGINT], lambda c{k}, z{k}: {bit.format(c=f'c{k}')})", range(8), "xor(a, b)")
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce('=' || source, '') AS grp, sha256({head}{_field_sql("text")}) AS leaf, sha256({head}{_field_sql(lower)}) AS low,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
                             lambda a, b: {byte}), 4294967295) AS crc
      FROM documents),
    l AS (
      SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS d,
             CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS f, '' AS proof
      FROM d),
    {_tree_sql("t", "l", inner)},
    subroots AS (SELECT grp AS source_key, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, d FROM t{inner}),
    {_tree_sql("u", "subroots", outer)},
    {_climb_sql("c", "t", "l", inner)},
    mid AS (SELECT c.doc_id, c.leaf, s.d AS subroot, s.grp, s.idx, c.f, c.proof FROM c{inner} c JOIN subroots s ON c.grp = s.source_key),
    {_climb_sql("e", "u", "mid", outer)}
    SELECT doc_id, leaf, subroot, u{outer}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u{outer}.d AS verified
    FROM e{outer} e, u{outer}
    """


ORACLE = {"op12_merkle": _oracle()}
