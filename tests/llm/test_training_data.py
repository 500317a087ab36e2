"""Training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import chat_format, decontaminate, exact_dedup, line_dedup, linking, minhash, packing, pii, ppm, repeats, toxicity
from cuesheet.llm.common import components, lean, run_parts, slices, whole_runs, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, sig string"
SF = "/root/testdata/sf0.001"


def texts(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    """Random texts with exact copies, near copies, a shared passage, nulls, empty and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = line(130)
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "A b."), (3, "a B."), (4, " \n\n ")]
    for k in range(5, n):
        roll = rng.random()
        old = rng.choice(out)[1]
        if roll < 0.15:
            text = old
        elif roll < 0.35 and old:
            ws = old.split(" ")
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
            text = " ".join(ws)
        else:
            text = "\n".join(line(rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
            text += "\n" + passage if rng.random() < 0.2 else ""
        out.append((k, text))
    out.append((n, "\n".join(line(30) for _ in range(400))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "s", 0, "clash", "clash") for d, t in rows], DOCS)


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots(pairs, {n for p in pairs for n in p})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = texts(1) + [(7, "twice"), (7, "twice"), (None, "no id")]
    hash_fn = (lambda t: F.substring(F.md5(t), 1, 1)) if weak else exact_dedup.content_hash
    got = exact_dedup.exact_dedup(frame(spark, rows), keep="largest", hash_fn=hash_fn).collect()
    low = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(low)].append(d)
    want = Counter()
    for d, t in rows:
        norm = (t or "").translate(low)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        want[d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_chat_events(spark):
    events = [
        (1, 1, "message", 10, "user", "hi <|turn|> [INST]\\"),
        (1, 2, "delta", 11, "assistant", "Hel"),
        (1, 3, "delta", 11, "assistant", "lo"),
        (1, 4, "edit", 10, None, "bye </s>"),
        (1, 5, "regenerate", 11, None, None),
        (1, 6, "delta", 11, "assistant", "<\\[new]"),
        (1, 7, "message", 12, "user", "gone"),
        (1, 8, "delete", 12, None, None),
        (1, 9, "edit", 99, None, "unknown"),
        (None, 0, None, None, None, None),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.format_chats(log).collect()}
    assert chat_format.parse(got[1]["formatted"]) == [("user", "bye </s>"), ("assistant", "<\\[new]")]
    assert [chat_format.unescape(got[1]["formatted"][m["start"] : m["end"]]) for m in got[1]["mask"]] == ["<\\[new]"]
    assert not re.search(r"</s>|\[INST\]|\[/INST\]", got[1]["formatted"])
    assert chat_format.parse(got[None]["formatted"]) == [("", "")]
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("<|[]\\/sINST>tun") for _ in range(rng.randint(0, 30)))
        assert chat_format.unescape(chat_format.escape(text)) == text


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = texts(3) + [(7, "a b"), (7, "a b"), (98, "it's <|endoftext|>x É. ΑΣ. 12,5 ..."), (None, "x")]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(frame(spark, rows), capacity=64).collect()
    want = Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for lo, n in sorted(spans):
            assert lo == at
            at += n
        assert at <= 64
    assert len(bins) <= packing.lower_bound(np.array([r["length"] for r in got]), 64) + 1


def test_bound_and_exchange(spark):
    rng = random.Random(4)
    for _ in range(30):
        sizes = np.array(sorted((rng.randint(1, 100) for _ in range(40)), reverse=True))
        _, _, fill = packing.best_fit_decreasing(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= len(fill) and fill.max() <= 100 and fill.sum() == sizes.sum()
    pieces = spark.createDataFrame([(k, k, 0, 0, rng.randint(1, 100), 0) for k in range(500)], "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, capacity=100, group=50).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(500)) and max(r["round"] for r in out) > 0


def test_minhash(spark):
    rows = texts(6, 120)
    got = collect(minhash.near_duplicates(frame(spark, [*rows, (None, "x y")])))
    bags = {d: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, t in rows if (w := words(t))}

    def similar(x, y):
        shared = sum((x & y).values())
        return shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared) - 1e-12

    pairs = [(a, b) for a in bags for b in bags if a < b and similar(bags[a], bags[b])]
    want = roots(pairs, [d for d, _ in rows])
    assert {d: r["class_id"] for d, r in got.items() if d is not None} == want
    assert all(got[d]["kept"] == (want[d] == d) and got[d]["class_size"] == list(want.values()).count(want[d]) for d in want)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def edits_between(x: bytes, y: bytes) -> int:
    """Edit distance by the matrix; equal ends cost nothing."""
    while x and y and x[0] == y[0]:
        x, y = x[1:], y[1:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, e in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def line_rows_for(seed: int) -> list[tuple[int | None, str | None]]:
    """Variants of lines, one template with many numbers, short lines, blank lines, repeated ids and rows."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(24, 60))) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (1, "short\n" + base[0]), (None, base[0])]
    for d in range(2, 45):
        lines = ["x" + "".join(rng.choice("abcdé ") for _ in range(30))]
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        lines += ["".join(x), f"ticket number {rng.randrange(10**4):04} was closed today", rng.choice(["short", "other", "", "  ", "é"])]
        rows.append((d, "\n".join(lines)))
    rows += [(7, "shared line that is long enough\nunique line C of the seventh row"), (7, "unique line B of the other row\nquite another line of that row")]
    rows += [(50, "shared line that is long enough"), (8, "twice the same row\nin every column, with id and text")] * 2
    return rows


def test_lines(spark):
    rows = line_rows_for(7)
    # rows that repeat id and text are one document; repeated ids come in the order of the text's hash
    th = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t")).collect()}
    named = sorted({(d, th[t], t) for d, t in rows if d is not None}, key=lambda r: r[:2])
    copies = Counter((d, t) for d, t in rows)
    at = [(d, h, no, x) for d, h, t in named for no, x in enumerate((t or "").split("\n")) if x.strip()]
    n_rows = [copies[d, t] for d, h, t in named for no, x in enumerate((t or "").split("\n")) if x.strip()]
    raw = [x.encode() for *_, x in at]
    long = [len(x) >= 24 for *_, x in at]
    pairs = [
        (i, j)
        for i in range(len(at))
        for j in range(i + 1, len(at))
        if raw[i] == raw[j] or long[i] and long[j] and abs(len(raw[i]) - len(raw[j])) <= 2 and edits_between(raw[i], raw[j]) <= 2
    ]
    root = roots(pairs, range(len(at)))
    links = Counter()
    for i, j in pairs:
        links[i] += n_rows[j]
        links[j] += n_rows[i]
    got = line_dedup.line_dedup(frame(spark, rows), max_share=1.0).collect()
    want = Counter({(None, rows[3][1], 0): 1})
    for d, h, t in named:
        mine = [k for k, x in enumerate(at) if x[:2] == (d, h)]
        drop = {at[k][2] for k in mine if root[k] != k}
        n = sum(links[k] + n_rows[k] - 1 for k in mine)
        text = t if not drop else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in drop)
        want[d, text, n] += copies[d, t]
    assert Counter((r["doc_id"], r["text"], r["n_links"]) for r in got) == want
    assert sum(links.values()) > 300
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_slices_of_a_bucket_find_the_same_links(spark):
    rng = random.Random(9)
    rows = [(d, f"ticket number {rng.randrange(10**5):05} was closed today") for d in range(300)]
    docs = frame(spark, rows).select("doc_id", F.xxhash64("text").alias("th"), "text")
    lines = line_dedup.line_rows(docs, 2, 24).cache()
    found = [line_dedup.edit_links(docs, lines, 2, **how).collect() for how in ({}, {"slice_rows": 40}, {"slice_bytes": 500})]
    counts = []
    for result in found:
        n, forest = Counter(), []
        for r in result:
            if r["b"] is None:
                n[r["a"]] += r["n"]
            else:
                forest.append((r["a"], r["b"]))
        counts.append((n, roots(forest, {x for p in forest for x in p})))
    texts_of = sorted({t for _, t in rows})
    want = Counter({line_dedup.line_id(x.encode()): sum(copies for y, copies in Counter(t for _, t in rows).items() if x != y and edits_between(x.encode(), y.encode()) <= 2) for x in texts_of})
    assert counts[0] == counts[1] == counts[2] and counts[0][0] == +want and len(want) > 200


def test_very_long_lines():
    rng = random.Random(3)
    line = bytes(rng.choice(b"abcd ") for _ in range(130_000))
    other = line[:500] + b"x" + line[501:90_000] + line[90_001:]
    far = line[:500] + b"xyz" + line[503:]
    xs, ys = [line, line, other] * 14, [other, far, far] * 14
    assert line_dedup.within_edits(xs, ys, 2).tolist() == [True, False, False] * 14


def test_lengths_on_both_sides_of_65536_are_compared():
    lines = [b"ab" * 32767 + b"c", b"ab" * 32767 + b"cd"]
    sig = line_dedup.line_keys(lines, 2, line_dedup.Powers())[1]
    assert [len(x) for x in lines] == [65535, 65536]
    assert line_dedup.may_be_near(sig[:1], sig[1:], 2).all()


def test_a_document_of_mostly_repeated_lines_is_cut_unless_it_is_a_copy(spark):
    rng = random.Random(17)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    shared, own, other = [line() for _ in range(7)], [line() for _ in range(3)], [line() for _ in range(40)]
    rows = [
        (1, "\n".join(shared + other)),
        (2, "\n".join(shared + own)),  # 70 % repeated, no near-duplicate of document 1
        (3, "\n".join(shared + other)),  # a copy as a whole
        (4, "\n".join([shared[0]] * 9)),
    ]
    got = collect(line_dedup.line_dedup(frame(spark, rows)))
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1]
    assert got[2]["text"] == "\n".join(own) and got[4]["text"] == ""
    assert [got[d]["n_dropped"] for d in (1, 2, 3, 4)] == [0, 7, 0, 9]
    stage = collect(line_dedup.drop_repeated_lines(frame(spark, rows)))
    assert all(stage[d]["text"] == got[d]["text"] for d in got)


def test_decontaminate(spark):
    rows = texts(8)
    items = [(1, " ".join((rows[20][1] or "x").split()[2:25])), (2, "b a"), (3, None), (4, "..."), (None, "a"), (5, "a"), (5, "b")]
    index = decontaminate.build_index(frame(spark, rows), block_words=300)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = collect(decontaminate.contamination(index, decontaminate.search(index, asked, block_bytes=20)))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for at in range(len(w) - min(10, len(w)) + 1):
                windows[tuple(w[at : at + 10])].add(i)
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    found |= ids
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    far = frame(spark, [(1, "one two x three four"), (2, "four three two one"), (3, "one two")])
    near = decontaminate.search(decontaminate.build_index(far), spark.createDataFrame([(9, "one two three four")], "item_id long, text string"), slop=1)
    assert sorted((r["kind"], r["start"], r["stop"]) for r in near.collect()) == [("near", 0, 4), ("near", 0, 5)]


def test_pii(spark):
    rows = [
        (1, "mail a.b@c.example.org, 10.0.0.256 and 10.0.0.25"),
        (2, "then +1 (269) 555-3296 4524132264652876 end"),
        (3, "é 71.129.171.132 4815819516090933"),
        (4, "version 2.0, on 2024-01-15, 123 of 456"),
        (5, None),
        (6, "9" * 5000 + "." + "0" * 6000),
    ]
    got = collect(pii.find_pii(frame(spark, rows)))
    spans = {d: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for d, r in got.items()}
    base = {d: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for d, r in got.items()}
    assert base[1] == spans[1] == [("email", 5, 22), ("ip", 39, 48)]
    assert base[2] == [] and spans[2] == [("phone", 5, 22), ("card", 23, 39)]
    assert base[3] == [("ip", 2, 16)] and spans[3] == [("ip", 2, 16), ("card", 17, 33)]
    assert spans[4] == spans[5] == spans[6] == []


def test_ppm(spark):
    rows = texts(9) + [(None, "zz top")]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    got = collect(ppm.score_documents(docs, F.col("doc_id") % 10 != 0, class_col="lang", block_bytes=2000))
    train = [(d, ppm.tokens(t) + [ppm.END_TOKEN]) for d, t in rows if d is not None and d % 10]
    unigram = Counter(w for _, ws in train for w in ws)
    total, v = sum(unigram.values()), len(unigram)

    def symbols(w):
        s = bytes([ppm.START]) * ppm.ORDER + (w if w == ppm.END_TOKEN else w + b" ")
        return [(s[i - ppm.ORDER : i], s[i]) for i in range(ppm.ORDER, len(s))]

    tries = {}
    for k in (0, 1):
        trie = tries[k] = defaultdict(Counter)
        for d, ws in train:
            if d % 2 == k:
                for w in ws:
                    for c, b in symbols(w):
                        for n in range(ppm.ORDER + 1):
                            trie[c[ppm.ORDER - n :]][b] += 1

    def cost(trie, w):
        out = 0.0
        for c, b in symbols(w):
            gone = set()
            for n in range(ppm.ORDER, -1, -1):
                here = {x: m for x, m in trie.get(c[ppm.ORDER - n :], {}).items() if x not in gone}
                if not here:
                    continue
                size = sum(here.values()) + len(here)
                if b in here:
                    out += math.log10(here[b] / size)
                    break
                out += math.log10(len(here) / size)
                gone |= set(here)
            else:
                out -= math.log10(252 - len(gone))
        return out

    share = [sum(d % 2 == k for d, _ in train) + 0.5 for k in (0, 1)]
    for d, t in rows:
        ws = ppm.tokens(t) + [ppm.END_TOKEN]
        each = [math.log10(share[k] / sum(share)) + sum(cost(tries[k], w) for w in ws) for k in (0, 1)]
        want = max(each) + math.log10(sum(10 ** (e - max(each)) for e in each))
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(unigram[w] > 0 for w in ws), total)
        assert r["score"] == pytest.approx(want, rel=1e-5)
        assert r["base_score"] == pytest.approx(sum(math.log10((unigram[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws))


def test_repeats(spark):
    rows = texts(10) + [(7, "r " * 300), (7, "r " * 300)]
    got = repeats.remove_repeats(frame(spark, rows), length=100, with_text=True).collect()
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + 100] for _, b in raw for i in range(len(b) - 99))
    want = Counter()
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] > 1:
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        want[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_repeats_beyond_16_mib(spark):
    """One text over 2**24 bytes; what it repeats lies behind that, once across the edge of a stretch."""
    rng = np.random.default_rng(5)
    body = (rng.integers(0, 26, 21_500_000) + 97).astype(np.uint8).tobytes().decode()
    edge = 5 << 22  # where the sixth stretch begins
    rows = [(1, body), (2, "A" + body[20_900_000:20_900_450] + "B"), (3, body[edge - 300 : edge + 300]), (4, body[17_000_000:17_000_399])]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(frame(spark, rows), with_text=True).collect()}
    spans = {d: [(s["lo"], s["hi"]) for s in r["spans"]] for d, r in got.items()}
    assert spans[2] == [(1, 451)] and spans[3] == [(0, 600)] and spans[4] == []
    assert spans[1] == [(20_900_000, 20_900_450), (edge - 300, edge + 300)]


def test_toxicity(spark):
    rng = random.Random(12)
    bad = ["grimple", "snorkum", "blatfex"]
    rows = []
    for d in range(400):
        ws = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(30)]
        if d % 4 == 0:
            ws[3], ws[9] = rng.choice(bad), rng.choice(bad)
        rows.append((d, " ".join(ws), int(d % 4 == 0)))
    train = spark.createDataFrame([r for r in rows if r[0] < 300], "doc_id long, text string, toxic int")
    model = toxicity.fit(train, max_examples=64)
    got = collect(toxicity.score_toxicity(frame(spark, [r[:2] for r in rows if r[0] >= 300] + [(999, None), (998, "")]), model))
    assert all((got[d]["score"] >= 0.7) == bool(y) for d, _, y in rows if d >= 300) and got[999]["score"] < 0.1
    index = model.index
    for _ in range(20):
        ids, w = index.vector({i: 1 for i in rng.sample(range(len(index.idf)), min(2, len(index.idf)))})
        at, cos = index.nearest(ids, w, 5)
        dense = np.zeros((len(index.idf), len(index.ids)))
        for t in range(len(index.idf)):
            lo, hi = index.start[index.first[t]], index.start[index.first[t + 1]]
            dense[t, index.at[lo:hi]] = index.weight[lo:hi]
        norms = (dense**2).sum(axis=0)
        assert np.minimum(abs(norms - 1), norms).max() < 1e-5
        every = w @ dense[ids]
        assert np.allclose(cos, np.sort(every[every > 0])[::-1][:5], atol=1e-6)
    nothing = toxicity.fit(spark.createDataFrame([], train.schema))
    assert collect(toxicity.score_toxicity(frame(spark, [(1, "x")]), nothing))[1]["score"] == 0


def test_toxicity_with_few_labels(spark):
    """Six toxic texts, their word in four of them: terms of either class are selected, and scores differ."""
    rng = random.Random(4)
    text = lambda *more: " ".join([*("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(12)), *more])
    rows = [(d, text("snorkum"), 1) for d in range(4)] + [(d, text(), 1) for d in (4, 5)] + [(d, text("pleased"), 0) for d in range(6, 66)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {b"snorkum", b"pleased"} <= set(model.index.terms)
    got = collect(toxicity.score_toxicity(frame(spark, [(900, text("snorkum")), (901, text("pleased"))]), model))
    assert got[900]["score"] > got[901]["score"]


def test_pipeline_stages(spark):
    """Planted rows, with null and repeated ids: what each stage keeps, and whole packed rows, against plain Python."""
    import corpus_pipeline

    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    item = prose(14)
    a, b, c = prose(60), prose(60), prose(60)
    rows = [
        (1, a), (2, a), (3, a + " more"), (4, b), (4, c), (4, c),  # copies and a repeated id with different texts
        (5, prose(20) + " " + item + " " + prose(5)), (None, prose(9) + "\n" + item), (None, prose(12)), (6, None), (7, ""),
        (8, prose(3000)), (9, "a line that several documents share\n" + prose(30)), (10, prose(30) + "\na line that several documents share"),
    ]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns
    # a, its copies and its variant are one class; rows that repeat everything stay once
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter([(1, a), (4, b), (4, c), *rows[6:]])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = corpus_pipeline.without_items(docs, bench)
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter(r for r in rows if item not in (r[1] or ""))
    cut = corpus_pipeline.line_dedup(spark, docs, "")
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert text[9] == rows[12][1] and text[10] == rows[13][1].split("\n")[0]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["doc_id"] == 10)
    packed = corpus_pipeline.packing(spark, docs, "").collect()
    tokenizer = packing.WordTokens(packing.default_tokenizer()).tokenizer
    expected = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            raw = np.array(ids[at : at + 2048], "<u4").tobytes()
            expected[d, k, at, len(raw) // 4, zlib.crc32(raw)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == expected
    filled = defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(toxicity.labelled_texts(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    low = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).where("score < 0.7").collect()}
    first = docs.where(F.col("doc_id").isin(sorted(low)))
    lines = line_dedup.line_dedup(first).select("doc_id", "text")
    kept = {r["doc_id"] for r in minhash.near_duplicates(lines).where("kept").collect()}
    clean = {r["doc_id"] for r in decontaminate.decontaminate(lines, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept & clean


def test_histogram_bound_never_rules_out_a_similar_pair():
    """Second round of near-dedup: a pair at 0.8 or more always stays, repeats of one shingle included."""
    rng = np.random.default_rng(3)
    sets = [np.zeros(0, np.uint64), np.full(300_000, 7, np.uint64)]
    for n in (1, 4, 40, 900):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for change in (0, 0.05, 0.1, 0.15, 0.5):
            cut = base.copy()
            gone = rng.random(n) < change
            cut[gone] = rng.integers(0, 2**63, int(gone.sum())).astype(np.uint64)
            sets += [np.sort(cut), np.sort(np.concatenate((cut, np.full(n // 5, cut[0]))))]
    size = np.array([len(x) for x in sets])
    bag = np.stack([np.frombuffer(linking.histogram(minhash.numbered(x)), np.uint8) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    kept = linking.may_reach(0.8, size, bag, i, j)
    similar = np.array([minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8 for a, b in zip(i, j)])
    assert similar.sum() > 10
    assert kept[similar].all()
    assert not kept[~similar & (size[i] > 500) & (size[j] > 500) & (size[i] < 10_000) & (size[j] < 10_000)].all()


def test_joined_words_have_the_ids_of_single_texts():
    from tokenizers import Tokenizer

    from cuesheet.llm.packing import WordTokens, default_tokenizer

    texts = ["Plain words, plain words. Straße", "", "x1 don't (stop) end.", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(5000))]
    ids, counts = WordTokens(default_tokenizer()).ids([t.encode() for t in texts])
    want = [Tokenizer.from_file(default_tokenizer()).encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_keeps_frequent_words_and_is_kept_from_task_to_task():
    """Whatever is forgotten, the ids are those of whole texts; a word that comes often stays, with or without marks."""
    rng = random.Random(31)
    path = packing.default_tokenizer()
    assert packing.word_tokens(path) is packing.word_tokens(path)
    encoder = packing.WordTokens(path, limit=60)
    word = lambda: "".join(rng.choice(["a", "b", "É", "ß", "7", "'s", "!", "$$$", ".", ",", "|>", "<|endoftext|>", "-", "Σ", "x́"]) for _ in range(rng.randint(1, 6)))
    for n in range(30):
        texts = [" ".join([word() for _ in range(20)] + ["often", "often$$$", "é,", "é,%%%"] * (n > 3)) for _ in range(4)]
        ids, counts = encoder.ids([t.encode() for t in texts])
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(encoder.slot) <= 60
    assert {b"often", b"often$$$", "é,".encode(), "é,%%%".encode()} <= set(encoder.slot)


def test_nearest_examples_are_exact_in_few_passes(monkeypatch):
    """Blocks with like bounds, blocks of which few are needed, ties and one example left out: all cosines summed in plain Python."""
    rng = np.random.default_rng(8)
    passes = []
    plain = toxicity.spans
    monkeypatch.setattr(toxicity, "spans", lambda a, b: passes.append(1) or plain(a, b))
    for kind in ("alike", "apart", "equal"):
        index = toxicity.Index({}, np.ones(30), np.zeros(200), np.arange(200), block=5)
        vectors = []
        for j in range(200):
            low = {"alike": 0, "apart": j // 10, "equal": 3}[kind]
            some = low + np.arange(8) if kind == "equal" else np.sort(rng.choice(np.arange(low, 30 if kind == "alike" else low + 10), 6, False))
            vectors.append(index.vector({int(i): 1 if kind == "equal" else int(rng.integers(1, 9)) for i in some}))
        index.fill(vectors)
        for skip in (-1, 0, 77):
            ids, w = vectors[77]
            want = [sum(float(w[ids == t][0]) * float(x) for t, x in zip(*v) if t in ids) for v in vectors]
            order = sorted((j for j in range(200) if want[j] > 0 and j != skip), key=lambda j: (-want[j], j))[:15]
            passes.clear()
            at, cos = index.nearest(ids, w, 15, skip=skip)
            assert at.tolist() == order and cos.tolist() == [want[j] for j in order]
            assert len(passes) <= 3
    at, cos = index.nearest(np.zeros(0, np.int64), np.zeros(0, np.float32), 15)
    assert not len(at) and not len(cos)


def test_passages_of_over_50_words_on_both_sides_of_400_bytes(spark):
    """The contract's 400 bytes decide, not the number of words: a shared passage of 56 words in 399 bytes stays, one of 400 goes."""
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = []
    for k, size in enumerate((350, 399, 400, 480)):
        passage = prose(80)[:size]
        assert len(passage.split()) >= 50
        rows += [(10 * k + c, prose(30 + c) + f"{c}" + passage + f"{'xyz'[c]}" + prose(25)) for c in range(3)]
    got = collect(repeats.remove_repeats(frame(spark, rows)))
    assert all(got[d]["n_removed"] == (0 if d < 20 else 400 if d < 30 else 480) and got[d]["n_bytes"] == len(t) for d, t in rows)


def test_line_keys_of_many_lines_take_little_memory():
    """8 MB of lines, one of them longer than what is worked on at a time: keys and signatures are those of each line alone."""
    import tracemalloc

    rng = random.Random(23)
    lines = [rng.randbytes(rng.randint(1, 900)) for _ in range(16_000)]
    lines[5000:5000] = [rng.randbytes(700_000), b"x"]
    powers = line_dedup.Powers()
    line_dedup.line_keys([b"z" * 700_000], 2, powers)
    tracemalloc.start()
    keys, sig = line_dedup.line_keys(lines, 2, powers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    for k in (0, 1, 700, 4999, 5000, 5001, 5002, 16_000, 16_001):
        alone = line_dedup.line_keys([lines[k]], 2, powers)
        assert keys[k].tolist() == alone[0][0].tolist() and sig[k].tolist() == alone[1][0].tolist()


def test_parts_of_batches_and_runs_are_small_and_whole():
    import pyarrow as pa

    rng = random.Random(29)
    rows = [(run, "é" * rng.randint(0, 30) if rng.random() < 0.9 else None) for run in range(40) for _ in range(rng.randint(1, 9))]
    batch = pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows]), pa.array([t for _, t in rows])], names=["grp", "text"])
    cut = list(slices(batch, 1000))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and max(c.num_rows for c in cut) < len(rows) / 3
    assert not list(slices(batch.slice(0, 0)))
    table, starts = next(whole_runs([batch], "grp"))
    table = table.set_column(1, "text", table.column("text").fill_null(""))
    parts = list(run_parts(table, starts, "text", 300))
    assert pa.concat_tables([t for t, _ in parts]).equals(table)
    for t, s in parts:
        runs = t.column("grp").to_pylist()
        assert s[0] == 0 and s[-1] == t.num_rows and all(len(set(runs[a:b])) == 1 for a, b in zip(s[:-1], s[1:])) and len(set(runs)) == len(s) - 1
        assert len(s) == 2 or sum(len(x.encode()) for x in t.column("text").to_pylist()) <= 300
    assert 3 < len(parts) < 40


def test_a_word_is_looked_up_once_in_a_run_of_texts():
    """Any white space and any place of it; ids are those of whole texts."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    encoder = packing.WordTokens(packing.default_tokenizer())
    texts = ["one Two one\ttwo\x0b three\r\n " * 200, " \x0c", "", "\n<|endoftext|> ONE\x1ctwo\x85 three <| Two\n", "two\x00 É é "]
    encoder.slot = Counted()
    ids, counts = encoder.ids([t.encode() for t in texts])
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert Counted.asked < 20


def test_the_encoder_goes_when_another_operator_has_the_process():
    path = packing.default_tokenizer()
    encoder = packing.word_tokens(path)
    assert list(lean(lambda batches: batches, "words")([1, 2])) == [1, 2] and packing.word_tokens(path) is encoder
    assert list(lean(lambda batches: iter([packing.word_tokens.cache_info().currsize]))([])) == [0]
