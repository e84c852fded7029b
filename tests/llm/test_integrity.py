"""Fill-in-the-middle, decontamination and the Merkle manifest against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontamination
from newsloom.llm.boundary_set import ArrayContainer, BitmapContainer, BoundarySet, RunContainer
from newsloom.llm.decontamination import find_contamination, merged
from newsloom.llm.fill_middle import SEED, fill_in_middle, restored, transformed
from newsloom.llm.merkle_manifest import build_manifest, proofs
from newsloom.llm.queries import op11_fill_middle, op12_decontamination, op13_merkle_manifest
from newsloom.llm.veb_tree import Block, address, fold, steps_of


def odd_texts(n, most, seed, parts):
    pick = random.Random(seed)
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, most))) for _ in range(n)]


# --- boundary set ---------------------------------------------------------------------


@pytest.mark.parametrize("step, kind", [(40, ArrayContainer), (3, BitmapContainer), (1, RunContainer)])
def test_containers(step, kind):
    rng = np.random.default_rng(step)
    positions = np.unique(np.arange(0, 393_216, step) + (rng.integers(0, step, len(np.arange(0, 393_216, step)))))
    found = BoundarySet(positions)
    assert {type(x) for x in found.containers} == {kind} and len(found) == len(positions)
    ranks = rng.permutation(len(positions))
    assert (found.select(ranks) == positions[ranks]).all()


def test_mixed_containers_and_gaps():
    rng = np.random.default_rng(5)
    parts = [[0, 7, 65_535], np.arange(65_536, 131_072), 3 * 65_536 + np.flatnonzero(rng.random(65_536) < 0.4), [10**12]]
    positions = np.concatenate(parts).astype(np.int64)
    found = BoundarySet(positions)
    assert [type(x) for x in found.containers] == [ArrayContainer, RunContainer, BitmapContainer, ArrayContainer]
    assert (found.select(np.arange(len(positions))) == positions).all()
    assert len(BoundarySet(np.zeros(0, np.int64))) == 0


# --- fill in the middle ---------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text, cut=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"{SEED}:{'-' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < spm:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


FIM_PARTS = ["a", "b ", "\n", " ", "é", "日本 ", "<", "<P", ">", "\x1c", "\x0b", "S>", "𝒳 "]


def test_fill_in_middle_batch():
    texts = [None, "", " ", "\n\n", "<M>", *odd_texts(3000, 30, 1, FIM_PARTS), "word " * 60_000, "x" * 300_000]
    ids = [None, *range(len(texts) - 1)]
    found = transformed(ids, pa.array(texts, pa.string()), SEED, 90, 50)
    got = list(zip(*(found[c] for c in ("n", "form", "prefix_chars", "middle_chars"))))
    expected = [plain_fim(i, t, 90, 50) for i, t in zip(ids, texts)]
    assert got == [x[:4] for x in expected]
    assert [x.decode() for x in found["output"]] == [x[4] for x in expected]
    assert {x[1] for x in expected} == {"plain", "psm", "spm"}


def test_fill_in_middle_rows(spark):
    texts = [None, "", "one", "<P> here", *odd_texts(300, 40, 2, FIM_PARTS), "long text, " * 30_000]
    rows = [(None if i % 17 == 5 else i % 250, t, "x", -1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(5)
    out = fill_in_middle(docs, cut_percent=90, spm_percent=50)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = out.select("*", restored("output", "form").alias("back")).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter((i, *plain_fim(i, t, 90, 50)) for i, t, _, _ in rows)
    assert Counter(r["back"] for r in found) == Counter(t or "" for _, t, _, _ in rows)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = set()
    for i, t in docs:
        *own, output = plain_fim(i, t)
        expected.add((i, *own, sha(output), sha(t or "")))
    assert {tuple(r) for r in op11_fill_middle(spark, sf_dir).collect()} == expected


# --- decontamination ------------------------------------------------------------------

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bench_words(text):
    return [(m.group(), m.start(), m.end()) for m in BENCH_WORD.finditer((text or "").translate(SMALL))]


def plain_hits(text, items):
    """(n_words, the words hit, their places, the items found)"""
    words = bench_words(text)
    own = [w for w, _, _ in words]
    hit, found = set(), set()
    for item_id, item in items:
        w = [x for x, _, _ in bench_words(item)]
        if not w:
            continue
        for s in range(max(1, len(w) - 9)):
            window = w[s : s + 10]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(item_id)
    covered = {c for i in hit for c in range(words[i][1], words[i][2])}
    return len(own), len(hit), covered, sorted(str(x) for x in found if x is not None)


def test_merged():
    spans = np.array([[5, 9], [0, 2], [2, 4], [6, 7], [8, 12], [1, 2]])
    assert merged(spans).tolist() == [[0, 2], [2, 4], [5, 12]]


def bench_rows(seed):
    pick = random.Random(seed)
    letters = ["a", "B", "c", "É", "日", "7", "é"]
    words = lambda n: [pick.choice(letters) for _ in range(n)]
    items = [(i % 40, pick.choice([" ", "-", "\n. "]).join(words(pick.choice([0, 1, 5, 9, 10, 11, 14, 30])))) for i in range(60)]
    items += [(None, "only a row without an id"), (3, None), (50, ""), (51, items[0][1])]
    docs = [(None, "x a"), (1, None), (2, ""), (3, "..."), (4, "Ä " * 50)]
    for i in range(120):
        parts = words(pick.randint(0, 25))
        for _, text in pick.sample(items[:60], pick.randint(0, 2)):
            parts += [text.upper().replace("É", "É") if pick.random() < 0.3 else text, *words(pick.randint(0, 8))]
        docs.append((i % 90, pick.choice([" ", ", ", "\x00"]).join(parts)))
    docs.append((500, "see: ONLY a row, without an id!"))
    return docs, items


def test_decontamination_against_brute_force(spark, monkeypatch):
    docs, items = bench_rows(3)
    table = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, items string, n_words int")
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, n string")
    expected, letters = Counter(), {}
    for i, t in docs:
        n, hits, covered, found = plain_hits(t, items)
        expected[(i, n, hits, tuple(found))] += 1
        letters.setdefault(i, []).append((covered, {c for _, a, b in bench_words(t) for c in range(a, b)}))
    # A small piece and a small group cut the items into many automata; the result is the same.
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 4)
    for group_words in (10**6, 150):
        out = find_contamination(table, benchmark, group_words=group_words)
        assert out.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
        got, inside = Counter(), {}
        for r in out.collect():
            inside.setdefault(r["doc_id"], []).append({c for a, b in r["spans"] for c in range(a, b)})
            got[(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]))] += 1
        assert got == expected
        # The stretches hold the letters of the words that are hit, and of no others.
        for i, wanted in letters.items():
            assert all(any(covered == own & here for own in inside[i]) for covered, here in wanted)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in find_contamination(docs, none).orderBy("doc_id").collect()] == [
        (1, 2, 0, []),
        (2, 0, 0, []),
    ]
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert find_contamination(docs.limit(0), items).count() == 0


def test_decontamination_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = {r["doc_id"]: r for r in op12_decontamination(spark, sf_dir).collect()}
    assert len(found) == len(docs) and any(r["contaminated"] for r in found.values())
    windows = {}
    for item_id, text in items:
        w = [x for x, _, _ in bench_words(text)]
        for s in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(item_id))
    assert {len(w) for w in windows} == {10}
    for i, t in docs:
        own = [w for w, _, _ in bench_words(t)]
        at = [s for s in range(len(own) - 9) if tuple(own[s : s + 10]) in windows]
        hit = {x for s in at for x in range(s, s + 10)}
        ids = sorted({x for s in at for x in windows[tuple(own[s : s + 10])]})
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert tuple(found[i]) == (i, len(own), len(hit), len(ids), digest, bool(hit))


# --- Merkle manifest ------------------------------------------------------------------


@pytest.mark.parametrize("levels", range(1, 12))
def test_addresses(levels):
    places = np.concatenate([np.atleast_1d(address(levels, d, np.arange(1 << d))) for d in range(levels)])
    assert sorted(places.tolist()) == list(range((1 << levels) - 1))
    # The top half of the levels comes first, and each subtree below it is one stretch.
    top = levels // 2
    if top:
        below = levels - top
        for subtree in range(1 << top):
            own = [
                address(levels, top + d, (subtree << d) + np.arange(1 << d)) for d in range(below)
            ]
            own = np.sort(np.concatenate([np.atleast_1d(x) for x in own]))
            assert own[0] == (1 << top) - 1 + subtree * ((1 << below) - 1) and own[-1] - own[0] == (1 << below) - 2


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def plain_path(levels, i):
    found = []
    for level in levels[:-1]:
        found.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i >>= 1
    return found


def plain_field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_manifest(rows, changed):
    """Counter of (doc_id, leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text) rows."""
    leaf = lambda r: h("".join(plain_field(x) for x in r))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees, langs = {}, sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang] = plain_tree([leaf(r) for r in order if r[2] == lang])
    top = plain_tree([trees[lang][-1][0] for lang in langs])
    out = Counter()
    for place, lang in enumerate(langs):
        for i, r in enumerate(x for x in order if x[2] == lang):
            path = plain_path(trees[lang], i) + plain_path(top, place)
            node = leaf(changed(r))
            for right, sibling in path:
                node = h(sibling + node if right else node + sibling)
            out[(r[0], leaf(r), trees[lang][-1][0], top[-1][0], h("".join(s for _, s in path)), node)] += 1
    return out


def test_blocks():
    for n, height in [(1, 0), (1, 3), (2, 1), (5, 3), (8, 3), (9, 4), (300, 9)]:
        leaves = np.array([h(str(i)) for i in range(n)], "S64")
        built = Block.build(leaves, height)
        again = Block.unpacked(built.packed(), n, height)
        assert len(built.packed()) == 32 * (2 ** (height + 1) - 1)
        for block in (built, again):
            for i, path in enumerate(block.paths(np.arange(n))):
                assert len(steps_of(path)) == height and fold(leaves[i], steps_of(path)) == block.root


def changed(r):
    return (*r[:3], r[3] + 1 if r[3] is not None and r[0] is not None and r[0] % 5 == 0 else r[3], r[4])


def test_manifest_against_brute_force(spark):
    pick = random.Random(1)
    langs = [None, "", "-", "=", "en", "é", "zz", *[f"l{i}" for i in range(30)]]
    rows = []
    for i in range(700):
        lang = "hot" if i % 2 else pick.choice(langs)
        rows.append((i, pick.choice(["a", None]), lang, pick.choice([3, None]), pick.choice(["é text", "", None])))
    rows += [rows[1]] * 40 + [(3, "other", "hot", 1, "x"), (None, None, None, None, None), (None, "b", "hot", 1, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string")
    claimed = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    expected = plain_manifest(rows, changed)
    for levels in (2, 12):
        manifest = build_manifest(docs.repartition(6), altered=claimed, levels=levels)
        out = proofs(manifest)
        assert Counter(
            (r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"]) for r in out.collect()
        ) == expected
    assert len({r["root"] for r in manifest.root.collect()}) == 1


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(4, "s", "en", 2, "hi")], "doc_id long, source string, lang string, n_chars long, text string")
    leaf = h("1:4" + "1:s" + "2:en" + "1:2" + "2:hi")
    row = proofs(build_manifest(docs)).first()
    assert (row["leaf"], row["subroot"], row["root"], row["path"], row["proof"], row["folded_root"]) == (leaf, leaf, leaf, "", h(""), leaf)
    none = build_manifest(docs.limit(0))
    assert proofs(none).count() == 0 and none.root.count() == 0


def test_manifest_query(spark, sf_dir):
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    bad = lambda r: zlib.crc32(str(r[0]).encode()) % 7 == 0
    claim = lambda r: (*r[:3], r[3] + 1 if bad(r) and r[3] is not None else r[3], r[4])
    found = op13_merkle_manifest(spark, sf_dir).collect()
    assert Counter(tuple(r)[:6] for r in found) == plain_manifest(rows, claim)
    assert {r["doc_id"] for r in found if not r["verified"]} == {r[0] for r in rows if bad(r)}
