"""Token counts, Merkle manifest and phrase mining against the tokenizer, plain hashing and plain counting."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import collocations, merkle, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, grp string, k string, key string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) and columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], DOCS)


def odd_text(rng: random.Random, n: int) -> str:
    """Words, runs of blanks, contractions, special strings and pieces longer than any overlap."""
    out, size = [], 0
    while size < n:
        roll = rng.random()
        if roll < 0.5:
            part = " " * rng.choice([1, 1, 1, 2, 3]) + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9)))
        elif roll < 0.6:
            part = rng.choice(["'s", "'re", "'", "!!!", "...", "\n\n", "\t ", " " * rng.randint(1, 200)])
        elif roll < 0.65:
            part = "<|endoftext|>"
        elif roll < 0.7:
            part = rng.choice(["a", "ab", "x1", "é", "中文", "\U0001f600"]) * rng.randint(1, 400)
        elif roll < 0.75:
            part = "".join(rng.choice("qwertyuiop") for _ in range(rng.randint(100, 700)))
        else:
            part = "".join(chr(rng.choice([0x4E00, 0x3B1, 0x1F600, 0x61, 0x20]) + rng.randint(0, 20)) for _ in range(rng.randint(1, 10)))
        out.append(part)
        size += len(part)
    return "".join(out)


@pytest.fixture(scope="module")
def tokens():
    return token_counts.ByteTokens(token_counts.default_tokenizer())


def test_units_and_windows(tokens):
    rng = random.Random(11)
    for _ in range(150):
        text = odd_text(rng, rng.randint(1, 3000))
        whole = len(tokens.encode(text))
        assert tokens.counts([text]) == [whole]
        parts = iter([text[i : i + 77] for i in range(0, len(text), 77)])
        n, head, tail, length = token_counts.parse(tokens, parts, 150, 80)
        full = tokens.encode(text)
        assert (n, length) == (whole, len(text))
        assert head[:, :3].tolist() == full[full[:, 0] < 80][:, :3].tolist()
        assert tail[:, :3].tolist() == full[full[:, 1] > len(text) - 80][:, :3].tolist()


def test_token_counts(spark, tokens):
    rng = random.Random(12)
    rows = [(None, None), (1, ""), (2, " "), (3, "<|endoftext|>"), (4, "it's <|endoftext|>'s"), (4, "it's <|endoftext|>'s"), (4, "other")]
    rows += [(10 + k, odd_text(rng, rng.randint(1, 2500))) for k in range(80)]
    rows += [(200 + k, c * n) for k, (c, n) in enumerate([("a", 5000), ("ab ", 900), ("é", 3001), (" ", 4000), ("'", 2500), ("\n", 2000), ("x1", 1500)])]
    docs = frame(spark, [(d, t, "en", "s", 0) for d, t in rows]).repartition(5)
    for step, overlap in ((100, 40), (400, 64)):
        got = token_counts.count_tokens(docs, limit=300, step=step, overlap=overlap).collect()
        want = Counter()
        for d, t in rows:
            n = len(tokens.encode(t or ""))
            want[d, len((t or "").encode()), n, n > 300] += 1
        assert Counter(tuple(r) for r in got) == want
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, overlap=10)


def test_long_documents_are_cut(spark, tokens):
    """With production parameters, on the table: texts beyond a chunk go through the splice."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.char_length("text") > 20_000)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, step=4096).collect()}
    assert got == {r["doc_id"]: len(tokens.encode(r["text"])) for r in docs.collect()} and len(got) > 3


def plain_manifest(rows):
    """The tree rebuilt from scratch for each leaf."""

    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes, at):
        proof, path = [], []
        while len(nodes) > 1:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            proof += run[: at % 16] + run[at % 16 + 1 :]
            path.append((run[: at % 16], run[at % 16 + 1 :]))
            nodes = [h(nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
            at //= 16
        return nodes[0], proof, path

    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        change = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        other = text.translate(low) if change and text is not None else text
        leaf = lambda t: h([field(d), field(source), field(lang), field(n), field(t)])  # noqa: B023, E731
        groups["" if source is None else "=" + source].append(((d is not None, d or 0, leaf(text)), d, leaf(text), leaf(other)))
    names = sorted(groups, key=lambda s: s.encode())
    for g in groups.values():
        g.sort(key=lambda x: x[0])
    tops = [climb([x[2] for x in groups[s]], 0)[0] for s in names]
    out = Counter()
    for i, s in enumerate(names):
        leaves = [x[2] for x in groups[s]]
        for j, (_, d, leaf, other) in enumerate(groups[s]):
            sub, proof, path = climb(leaves, j)
            root, more, up = climb(tops, i)
            now = other
            for before, after in path + up:
                now = h(before + [now] + after)
            out[d, leaf, sub, root, h(proof + more), now, now == root] += 1
    return out


def run_manifest(docs):
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = merkle.manifest(docs, fifth, F.translate("text", merkle.UPPER, merkle.LOWER)).collect()
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got)


def test_hash_states():
    rng = np.random.default_rng(3)
    children, sizes = rng.integers(0, 256, (40, 16, 32), dtype=np.uint8), rng.integers(1, 17, 40)
    digest, states = merkle.absorb(children, sizes)
    for i, m in enumerate(sizes):
        parts = [c.tobytes().hex() for c in children[i, :m]]
        assert digest[i].tobytes().hex() == hashlib.sha256("".join(parts).encode()).hexdigest()
        slot = int(rng.integers(0, m))
        child = rng.integers(0, 256, (1, 32), dtype=np.uint8)
        right = np.zeros((1, 15, 32), np.uint8)
        right[0, : m - slot - 1] = children[i, slot + 1 : m]
        got = merkle.resume(states[i, slot][None], child, right, np.array([m - slot - 1]), np.array([m]))
        parts[slot] = child[0].tobytes().hex()
        assert got[0].tobytes().hex() == hashlib.sha256("".join(parts).encode()).hexdigest()


def test_manifest(spark):
    rng = random.Random(4)
    sizes = {None: 3, "hot": 600, "one": 1, "run": 16, "more": 17, "é": 40, **{f"s{k}": 2 for k in range(20)}}
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Abc", "abc", "Ünï " * rng.randint(1, 50), f"T{rng.random()}"])
            rows.append((rng.randrange(10_000), text, rng.choice([None, "en"]), source, rng.choice([None, len(text or "")])))
    rows += [(7, "Twice", "en", "hot", 5)] * 30 + [(None, "No id", None, "hot", None)] * 3 + [(7, "other", "en", "hot", 5)]
    assert run_manifest(frame(spark, rows).repartition(7)) == plain_manifest(rows)
    assert run_manifest(frame(spark, rows[:1])) == plain_manifest(rows[:1])
    assert run_manifest(frame(spark, rows[3:300])) == plain_manifest(rows[3:300])
    assert not run_manifest(frame(spark, rows[:0]))


def plain_collocations(rows, at_least, top):
    f, n = defaultdict(Counter), Counter()
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            ws = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(ws)
            for i in range(len(ws)):
                for size in range(1, 6):
                    if i + size <= len(ws):
                        f[lang][tuple(ws[i : i + size])] += 1
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= at_least}
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(seed: int):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "a", "é", "b\x01c", "b\x00", "b\x01", "x\x1fy", " z", "中"] + [f"w{k}" for k in range(25)]
    idioms = [["once", "upon", "a", "time"], ["very", "very", "very", "very", "very", "very"], ["b\x01", "b\x00"], ["new", "york", "city"]]
    rows = []
    for d in range(150):
        ws = []
        for _ in range(rng.randint(0, 60)):
            ws += rng.choice(idioms) if rng.random() < 0.2 else [vocab[min(int(rng.expovariate(0.15)), len(vocab) - 1)]]
        text = "".join(w + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "? "]) for w in ws)
        rows.append((d, text, rng.choice(["en", "en", "en", "fr", None, "und"]), "s", 0))
    return rows + [(None, None, None, None, None), (3, "", "en", None, None), (3, "a b", "xx", None, None)]


@pytest.mark.parametrize("limits", [{}, {"max_entries": 50, "max_words": 12, "chunk": 300}])
def test_collocations(spark, limits):
    rows = phrase_rows(8)
    docs = frame(spark, rows).repartition(4)
    got = collocations.collocations(docs, at_least=5, **limits).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 5, 2000) and len(got) > 60
    if not limits:
        few = collocations.collocations(docs, at_least=5, top=7).collect()
        assert sorted(tuple(r) for r in few) == plain_collocations(rows, 5, 7)
        assert collocations.collocations(docs.limit(0)).count() == 0


def test_trie_bursts():
    trie = collocations.HatTrie(3, burst=4)
    rng = random.Random(2)
    want = Counter()
    for _ in range(2000):
        key = b"".join(rng.randrange(1, 9).to_bytes(4, "big") for _ in range(3))
        want[key] += 1
        trie.add([key], [1])
    assert any(isinstance(box, collocations.Node) for box in trie.root.below.values())
    assert trie.entries() == len(want)
    first, n = trie.take(10)
    assert 10 <= len(n) < len(want) and len({first[i : i + 4] for i in range(0, len(first), 12)}) == 1
    rest, m = trie.take(1 << 62)
    raw = first + rest
    assert Counter(dict(zip((raw[i : i + 12] for i in range(0, len(raw), 12)), n + m))) == want
    assert trie.entries() == 0


def test_merged_counts_ignore_how_runs_were_split(spark):
    rows = [("en", b"a\0b\0", 3), ("en", b"a\0b\0c\0", 2), ("en", b"a\0b\0c\0", 4), ("en", b"a\0b\x01\x01\0", 5), ("fr", b"a\0b\0", 1)]
    runs = spark.createDataFrame([(1, *r) for r in rows], "part long, lang string, key binary, n long")
    got = {(r["lang"], r["phrase"], r["size"]): r["f"] for r in collocations.merge_runs(runs, 2, 2).collect()}
    assert got == {("en", "a b", 2): 9, ("en", "a b c", 3): 6, ("en", "a b\0", 2): 5}
