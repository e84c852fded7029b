import random
import re

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import jaccard_join
from newsloom.llm.components import connected_components
from newsloom.llm.html_text import extract_main_text, main_text
from newsloom.llm.importance import features, log_ratios, resample
from newsloom.llm.jaccard_join import keep_one_of_each, leftovers, full_sets, near_duplicate_components, near_duplicate_links
from newsloom.llm.language import UNKNOWN, Compressor, keep_known, learn, predict_languages
from newsloom.llm.quality_lines import BOILERPLATE, MEASURES, judge_documents, keep_clean, measure, verdicts
from newsloom.llm.shingles import shingle_sets
from newsloom.llm.top_k import Shard, search, top_inner_products

import brute

PARTS = ["a ", "b ", "\n", "\n\n", "é ", "日本 ", "| ", "!! ", "*", "\t", "\x0b", "\x1c", "x. ", "All rights Reserved ", "\r\n", "字。", "؟ "]


def odd_texts(n, most, seed, parts=PARTS):
    pick = random.Random(seed)
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, most))) for _ in range(n)]


def test_quality_measures():
    texts = [None, "", "\n", *odd_texts(3000, 60, 1), "w " * 5000]
    found = measure(pa.array(texts, pa.string()))
    assert [tuple(int(found[x][i]) for x in MEASURES) for i in range(len(texts))] == [
        brute.quality(t, BOILERPLATE) for t in texts
    ]


CLEAN = "The first sentence is here and it goes on. The second one follows it. And so on, and so on, until the end of it."


def test_quality_verdicts(spark):
    rows = [
        (1, CLEAN),
        (2, CLEAN + "\nAll rights reserved."),
        (3, "home | news | sport | more | and | so | on | and | on | and | again | and | more | links | in | it"),
        (4, "SHOUT!! " * 3 + "THEY!! DO!! ALL!! THE!! TIME!! SO!! WE!! CAN!! NOT!! READ!! IT!! AT!! ALL!! OR!! NOT!! YES!! NO!!"),
        (5, None),
        (6, ""),
        (None, CLEAN),
        (1, "short"),
        (7, "same words again and over again in one line of text.\n" * 9),
    ]
    docs = spark.createDataFrame([(i, t, 5, False, "x") for i, t in rows], "doc_id long, text string, n_chars int, kept boolean, n_words string")
    found = {(r["doc_id"], r["n_words"]): r for r in judge_documents(docs).collect()}
    assert len(found) == len(rows)
    kept = {k for k, r in found.items() if r["kept"]}
    assert kept == {(1, 25), (2, 28), (None, 25)}
    assert found[(2, 28)]["clean_text"] == CLEAN + "\n"
    assert found[(7, 99)]["base_failed"] and found[(5, 0)]["clean_text"] == ""
    clean = keep_clean(docs)
    assert clean.columns == docs.columns
    assert sorted((r["text"], r["n_chars"]) for r in clean.collect()) == sorted(
        [(CLEAN, len(CLEAN)), (CLEAN, len(CLEAN)), (CLEAN + "\n", len(CLEAN) + 1)]
    )
    assert judge_documents(docs.limit(0)).count() == 0 and keep_clean(docs.limit(0)).count() == 0


def test_long_lines_and_other_scripts(spark):
    long = CLEAN.replace(". ", ", ") + " Nothing in its privacy policy says so."
    rows = [(1, long), (2, "All rights reserved, see the privacy policy."), (3, "これ は 文 です。 " * 6), (4, "これ は 文 です " * 6), (5, "هذا نص قصير جدا؟ " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_bad_lines"], r["clean_text"]) for r in judge_documents(docs).collect()}
    assert found[1] == (0, long) and found[2] == (1, "")
    assert [found[i][0] for i in (3, 4, 5)] == [0, 1, 0]


def test_verdicts_at_the_limits():
    found = {"n_words": np.array([19, 20, 100, 100]), "n_repeat_words": np.array([0, 6, 31, 30]), "n_lost_words": np.array([0, 12, 0, 61])}
    assert [x.tolist() for x in verdicts(found)] == [[True, False, True, False], [False, True, False, False]]


def test_shingle_sets():
    texts = [None, "", "  ", *odd_texts(3000, 25, 2, ["a ", "B ", "b ", "É ", "\n", "c", " ", "\x1cd "])]
    hashes, offsets = shingle_sets(pa.array(texts, pa.string()))
    names = {}
    for i, text in enumerate(texts):
        own = brute.shingles(text)
        assert len(own) == offsets[i + 1] - offsets[i]
        assert names.setdefault(frozenset(own), hashes[offsets[i] : offsets[i + 1]].tobytes()) == hashes[offsets[i] : offsets[i + 1]].tobytes()
    assert len(set(names.values())) == len(names)


def copies(seed):
    """Texts with exact and near copies around the limit, a shared passage and short texts."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(pick.randint(5, 120))]
        for _ in range(pick.randint(1, 8)):
            own = list(base)
            for _ in range(pick.randint(0, 5)):
                own[pick.randrange(len(own))] = word()
            texts.append(" ".join(own))
        texts.append(" ".join(base + passage))
        texts.append(" ".join(passage + base[:5]))
    return [*texts, *texts[:5], "one two", "One TWO", "one", None, "", " \n", "x " * 3000]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_IN_SLICE", 4)
    monkeypatch.setattr(jaccard_join, "BUCKET_KEYS", 500)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    rows = list(enumerate(copies(seed)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, point string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_components(docs).collect()}
    assert found == brute.components(rows)


@pytest.mark.parametrize("seed, block, matrix", [(1, 300, 1000), (2, 100_000, 1 << 21), (3, 2000, 64)])
def test_links_of_near_copies(spark, seed, block, matrix, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "MATRIX_CELLS", matrix)
    rows = list(enumerate(copies(seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in near_duplicate_links(docs).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == brute.links(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute.components(rows)


def test_links_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (3, "A B C D E F"), (3, "other words are in this text"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in near_duplicate_links(docs).collect())
    assert found == sorted([("None", 2, 0), ("None", 0, 0), ("4", 2, 1), ("3", 2, 1), ("3", 2, 0), ("8", 0, 0)])
    assert near_duplicate_links(docs.limit(0)).count() == 0


def test_components_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (3, "A B C D E F"), (3, "other words are in this text"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near_duplicate_components(docs).collect())
    assert found == sorted([("None", 2, None), ("None", 0, None), ("4", 2, 3), ("3", 2, 3), ("3", 2, 3), ("8", 0, 8)])
    assert near_duplicate_components(docs.limit(0)).count() == 0
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "8", "None", "None"]


def test_one_row_of_each_component_stays(spark):
    one, two, three = "a b c d e f", "other words are in this text", " ".join(f"w{i}" for i in range(60))
    near = three + " more"
    rows = [(3, one, 1), (5, one, 2), (5, two, 3), (6, two, 4), (7, "", 5), (7, "", 6), (8, three, 7), (8, three, 7), (8, near, 8)]
    docs = spark.createDataFrame([(str(i), t, x) for i, t, x in rows], "name string, body string, x int").repartition(3)
    kept = keep_one_of_each(docs.withColumn("name", docs["name"].cast("int")), doc_id="name", text="body")
    assert kept.columns == docs.columns
    found = sorted(tuple(r) for r in kept.collect())
    assert found[:4] == [(3, one, 1), (5, two, 3), (7, "", 5), (7, "", 6)]
    assert len(found) == 5 and found[4] in rows[6:]


@pytest.mark.parametrize("seed, span", [(5, 30), (6, 8)])
def test_links_of_repeated_ids(spark, seed, span):
    pick = random.Random(seed)
    rows = [(pick.randint(0, span), text) for text in copies(seed)[:60]]
    rows += pick.choices(rows, k=25) + [(i, rows[0][1]) for i in (1, 1, 2, None)] + [(None, ""), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_duplicate_links(docs).collect()
    expected = brute.rows_linked(rows)
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected))
    # One row of each component stays, and rows that link with nothing.
    kept = [tuple(r) for r in keep_one_of_each(docs).collect()]
    texts = {}
    for (i, text), (_, n, component, _) in zip(rows, expected):
        texts.setdefault((i, frozenset(brute.shingles(text))), (component, n))
    able = [(i, t) for i, t in kept if i is not None and brute.shingles(t)]
    assert all(texts[(i, frozenset(brute.shingles(t)))][0] == i for i, t in able)
    assert len(able) == len(distinct_components(rows)) and len(kept) - len(able) == sum(
        i is None or not brute.shingles(t) for i, t in rows
    )


def distinct_components(rows):
    numbered = [(k, t) for k, (i, t) in enumerate(rows) if i is not None and brute.shingles(t)]
    return {c for _, c in brute.components(numbered).values()}


def test_links_of_few_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    near, nearer = text + " sixteen", text + " sixteen seventeen"
    for rows in ([(1, text), (1, text), (2, near), (3, nearer)], [(3, text), (5, text), (5, near), (6, nearer)]):
        found = near_duplicate_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [r["n_links"] for r in found] == [3] * 4


def test_kept_rows_may_have_any_columns(spark):
    rows = [(1, "a b c d e f", "x", 2), (2, "a b c d e f", "y", 3), (4, "", "z", 1), (2, "so it is and so on", "y", 4)]
    docs = spark.createDataFrame([(*r, r[0]) for r in rows], "id long, text string, point string, component int, doc_id long")
    assert keep_one_of_each(docs).columns == docs.columns and keep_one_of_each(docs).count() == 3
    for names, part in (("_id, _point, _n", 4), ("Id, _Row, hash", 3)):
        first, second, third = names.split(", ")
        docs = spark.createDataFrame(rows[:part], f"{first} long, text string, {second} string, {third} int")
        kept = keep_one_of_each(docs, doc_id=first)
        assert kept.columns == docs.columns
        assert sorted(r[0] for r in kept.collect()) == ([1, 2, 4] if part == 4 else [1, 4])


def test_own_rows_are_spread_over_the_buckets():
    from newsloom.llm.jaccard_join import _by_bucket

    rng = np.random.default_rng(1)
    carriers = []
    for _ in range(200):
        points = rng.integers(0, 2**62, 50)
        keys = rng.integers(0, 2**63, 400).astype(np.uint64)
        own = [points.astype("<i8"), points.astype("<i8"), points.astype("<i8"), np.zeros(0, "<u8")]
        batch = _by_bucket(keys, rng.choice(points, 400), np.ones(400, bool), 20, own)
        held = [(b, x) for b, x in zip(batch.column("bucket").to_pylist(), batch.column("own_points").to_pylist()) if x]
        assert len(held) == 1 and held[0][1] == own[0].tobytes()
        carriers.append(held[0][0])
    assert len(set(carriers)) == 20 and max(carriers.count(b) for b in range(20)) < 40


def test_leftovers_find_links_that_the_pivot_misses(spark):
    words = [f"w{i}" for i in range(124)]
    texts = {1: words, 2: ["x"] * 11 + words[11:], 3: ["x"] * 22 + words[22:], 4: ["x"] * 33 + words[33:]}
    sets = full_sets(spark.createDataFrame([(" ".join(t),) for t in texts.values()], "text string"))
    points = [r["point"] for r in sets.collect()]
    cells = spark.createDataFrame(
        [(points[0], p, d, p) for p, d in zip(points, (0.0, 0.128, 0.216, 0.304))],
        "pivot long, point long, distance double, component long",
    )
    pairs = {frozenset((r["a"], r["b"])) for r in leftovers(cells, sets).collect()}
    whole = [brute.shingles(" ".join(t)) for t in texts.values()]
    linked = {
        frozenset((points[i], points[j]))
        for i in range(4)
        for j in range(i)
        if 100 * len(whole[i] & whole[j]) >= 80 * len(whole[i] | whole[j])
    }
    # A chain: neighbours link, the ends don't.
    assert linked == {frozenset(points[i : i + 2]) for i in range(3)} and pairs <= linked
    joined = connected_components(spark.createDataFrame([tuple(p) for p in pairs], "a long, b long"))
    assert joined.select("component").distinct().count() == 1 and joined.count() == 4


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 101), (7, 7)] + [(200, x) for x in range(201, 260)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(21), 0), **dict.fromkeys((100, 101, 103), 100), **dict.fromkeys(range(200, 260), 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_languages_against_a_plain_version(spark, sf_dir):
    """Every text compressed in full with each dictionary by the library."""
    import zstandard

    from newsloom.llm import language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0")
    learned = learn(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    made = language.Compressor(learned)
    for name, compress in zip(made.names, made.each):
        # What it returns is a frame that the raw-content dictionary opens again.
        kind = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sample = language.prepared("Some words and others, 12.")
        assert zstandard.ZstdDecompressor(dict_data=kind).decompress(compress(sample), max_output_size=1000) == sample
    for r in predict_languages(docs, learned).collect():
        text = texts[r["doc_id"]] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == (UNKNOWN, 0.0, True)
            continue
        data = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode()
        blocks = [data[i : i + 512] for i in range(0, len(data), 512)]
        sizes = {n: max(1, sum(len(c(b)) - 9 for b in blocks)) for n, c in zip(made.names, made.each)}
        best, second = sorted(sizes, key=lambda n: (sizes[n], n))[:2]
        assert (r["lang_pred"], r["score"]) == (best, 1 - sizes[best] / sizes[second])
        assert r["rejected"] == (1 - sizes[best] / sizes[second] < 0.005)


def test_learning_takes_a_bounded_part_of_every_text(spark, monkeypatch):
    from newsloom.llm import language

    shown = []
    monkeypatch.setattr(language, "prepared", lambda x, keep=language.prepared: shown.append(x) or keep(x))
    body = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(3000))
    ids = [i for i in range(400) if language.zlib.crc32(str(i).encode()) % 3 != 1]
    # One id has most rows, with many texts; a header begins all.
    rows = [(ids[0], f"header {i} {body}", "de") for i in range(600)] + [(i, "header " + body, "de") for i in ids[1:]]
    rows += [(i, "short", "en") for i in ids[:3]] + [(None, body, "en"), (ids[5], None, "en"), (ids[6], "12 34", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = learn(docs, rows=40, dictionary_bytes=2000)
    assert sorted(learned) == ["de", "en"] and len(learned["de"]) <= 2000
    assert sum(map(len, shown)) <= 3 * 2000 + 200 and learned["de"].count(b"header") <= 3
    assert learn(docs.repartition(7), rows=40, dictionary_bytes=2000) == learned


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = learn(docs)
    assert sorted(learned) == ["de", "en", "es", "fr"]
    found = predict_languages(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)
    odd = spark.createDataFrame(
        [(None, None, "en", 1), (1, "", None, 2), (1, "12 !! 3", "xx", 3), (2, "the and of " * 9000, None, 4)],
        "doc_id long, text string, lang string, score int",
    )
    rows = predict_languages(odd, learned).collect()
    assert sorted(r["lang_pred"] for r in rows) == ["en", UNKNOWN, UNKNOWN, UNKNOWN]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert learn(odd.limit(0)) == {} and predict_languages(odd, {}).where("lang_pred <> 'und'").count() == 0
    kept = keep_known(odd, learned)
    assert kept.columns == odd.columns and kept.count() == 1
    assert keep_known(odd.limit(0), learned).count() == 0


def test_languages_tie_goes_to_the_smaller_name():
    same = Compressor({"b": b"some words of a language", "a": b"some words of a language"})
    assert same.predict("words of a language") == ("a", 0.0)


PAGE = """<html><head><title>T</title><script>if(a<b){"</p>"}</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div id="cookie-notice">We use cookies on the site and you can accept.</div>
<nav><a href=/>Home</a></nav><article class="post"><header><h1>The title &amp; more</h1></header>
<p>One &lt;b&gt; two&nbsp;three<br>four. <a href=x>link text</a> and so on.<p>Second <b>bold</b> par &eacute;&#233;&#x41;.
<div class="ad">Buy now</div><ul><li>item one<li>item two</ul><form><label>Name</label><input></form>
<section class="comments"><p>I like the article and this is what I think of it.</p></section></article>
<aside><p>Related</p></aside><footer>&copy; x</footer></body></html>"""
LONG = "This is one of the paragraphs that we have in the text and it is long enough to be called good, since there are many words in it and it goes on and on for a while until it is over two hundred characters."  # noqa: E501


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "The title & more", "One <b> two three four. link text and so on.", "Second bold par ééA.", "item one", "item two",
    ]
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div>Copyright</div>"
    assert main_text(page).split("\n") == ["Head", LONG, "Short.", LONG]
    page = f"<div id=main><h1>Head</h1><p>{LONG}</p></div><ol class=commentlist><li><article class=comment><p>{LONG}</p></article></ol>"
    assert main_text(page).split("\n") == ["Head", LONG]
    for odd in (None, "", "<", "<p", "<article>", "<script>x", "<!-- x", "<div class='a", "<p>&#xfffffff;</p>"):
        assert main_text(odd) == ""
    assert main_text("<article>" + "<p>word</p>" * 20000).count("word") == 20000


TEASER = '<article class="card"><h3><a href=x>A headline of some other page</a></h3><p>What it is about, in one line.</p></article>'


def test_main_text_beside_teaser_articles():
    page = f"<body>{TEASER * 2}<div><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{TEASER * 3}</body>"
    assert main_text(page).split("\n") == ["Head", LONG, "Short.", LONG]
    assert main_text(f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article>{TEASER * 3}").split("\n") == ["Head", LONG, "Short."]


def test_rules_hold_inside_an_article():
    links = "<p>" + "<a href=x>Other headline without stops</a> by Jane Doe " * 4 + "</p>"
    page = f"<div><p>{LONG}</p></div><article><p>{LONG}</p>{links}<p>Code.</p><p><a href=x>More</a></p><p>Between.</p><p><a href=y>Next</a></p></article>"
    assert main_text(page).split("\n") == [LONG, LONG]
    assert main_text(f"<article><p>{LONG}</p><p>Code.</p><p>End.</p></article>").split("\n") == [LONG, "Code.", "End."]


@pytest.mark.parametrize("shown", ['data-title="the hidden cost"', "title='a hidden gem'", 'data-x="display: none"', 'data-class="ad"', "style='color:red'"])
def test_attribute_values_hide_nothing(shown):
    assert main_text(f"<article><section {shown}><p {shown}>{LONG}</p></section></article>") == LONG


@pytest.mark.parametrize("hidden", ["hidden", 'HIDDEN=""', "class=x hidden", 'style="color:red;Display : none"', "style=display:none"])
def test_hidden_elements(hidden):
    assert main_text(f"<article><p>{LONG}</p><section {hidden}><p>{LONG} Not shown.</p></section></article>") == LONG


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (1, None, None, 4), (None, "v", "", 5)], "page_id long, url string, html string, n_chars int")
    found = sorted((str(r["page_id"]), r["url"] or "", r["n_chars"], len(r["text"])) for r in extract_main_text(pages).collect())
    n = len(main_text(PAGE))
    assert found == [("1", "", 0, 0), ("1", "u", n, n), ("None", "v", 0, 0)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_importance(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = resample(docs, labels).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, docs.count() + 1))
    assert [r["kept"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r["kept"] for r in rows), reverse=True)
    by_key = sorted(rows, key=lambda r: (-r["key"], r["doc_id"]))
    assert [r["rank"] for r in by_key] == sorted(r["rank"] for r in rows)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    weight = lambda q: np.mean([r["log_weight"] for r in rows if marks.get(r["doc_id"]) == q])
    assert weight(1) > weight(0) + 5
    assert resample(docs, labels, share=0.25).where("kept").count() == -(-docs.count() // 4)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a b", 3)], "doc_id long, text string, rank int")
    assert resample(odd, labels.limit(0)).where("kept and log_weight = 0").count() == 3
    assert resample(odd.limit(0), labels).count() == 0


def test_importance_against_a_plain_version(spark):
    """Counts, log ratios, Gumbel keys, ranks and the kept share, text by text."""
    import math
    from collections import Counter

    from newsloom.llm import importance as module

    pick = random.Random(5)
    rows = [(i % 70, " ".join(pick.choice("a b c D É x1 the of".split()) for _ in range(pick.randint(0, 12)))) for i in range(90)]
    rows += [(None, "a b c"), (None, None), (71, ""), (5, "the of a")]
    marks = [(i, pick.choice([0, 1])) for i in range(0, 70, 2)] + [(3, None), (None, 1), (4, 1)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, key double").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = resample(docs, labels)
    noise = {r["doc_id"]: r["u"] for r in docs.selectExpr(
        "doc_id", f"(shiftrightunsigned(xxhash64({module.SEED}, coalesce(doc_id, -1)), 12) + 0.5D) / pow(2, 52) u").distinct().collect()}

    def own(text):
        words = (text or "").translate(brute.SMALL).split()
        code = lambda x: int(features(pa.array([x]))[0][1 if " " in x else 0])
        return [code(w) for w in words] + [code(f"{a} {b}") for a, b in zip(words, words[1:])]

    good = {i for i, q in marks if q == 1 and i is not None}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(own(t))
        target.update(own(t) if i in good else [])
    smooth, n = module.SMOOTHING, module.BUCKETS
    p, q = sum(target.values()) + smooth * n, sum(raw.values()) + smooth * n
    ratio = lambda b: math.log((target[b] + smooth) / p) - math.log((raw[b] + smooth) / q)
    expected = []
    for i, t in rows:
        parts = own(t)
        weight = round(module.PER_FEATURES * sum(map(ratio, parts)) / len(parts), 6) if parts else 0.0
        expected.append((i, weight, weight - math.log(-math.log(noise[i]))))
    got = sorted(found.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    expected.sort(key=lambda x: (-round(x[2], 5), x[0] is None, x[0] or 0))
    assert sorted((str(i), round(w, 4), round(k, 4)) for i, w, k in expected) == sorted(
        (str(r["doc_id"]), round(r["log_weight"], 4), round(r["key"], 4)) for r in got
    )
    assert [r["key"] for r in got] == sorted((r["key"] for r in got), reverse=True)
    listed = [x for _, x in marks]
    share = sum(x == 1 for x in listed) / sum(x is not None for x in listed)
    assert sum(r["kept"] for r in got) == math.ceil(share * len(rows) - 1e-9)
    assert all(r["kept"] for r in got[: sum(r["kept"] for r in got)])


def test_features_are_unigrams_and_bigrams():
    _, offsets = features(pa.array(["a b c", None, "", "a", "A a"]))
    assert np.diff(offsets).tolist() == [5, 0, 0, 1, 3]
    assert log_ratios(np.array([5.0, 0.0]), np.array([5.0, 5.0]))[0] > 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)


def whole(rows):
    return [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]


def test_top_k(spark, monkeypatch):
    from newsloom.llm import top_k as module

    monkeypatch.setattr(module, "SHARD_ROWS", 70)
    monkeypatch.setattr(module, "GROUP_SHARDS", 2)
    monkeypatch.setattr(module, "LEAF_ROWS", 8)
    pick = random.Random(4)
    rows = [(i, [pick.gauss(0, 1) for _ in range(6)]) for i in range(450)]
    rows += [(1000 + i, [1.0] * 6) for i in range(150)] + [(3000, [2.0, 1.0]), (3001, [1.0, 5.0])]
    found = top_inner_products(vectors(spark, rows), module.F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute.top_k(whole(rows), 10)


def test_top_k_of_odd_rows(spark):
    from newsloom.llm import top_k as module

    rows = [(0, [1.0, 2.0]), (1, [3e38, 3e38]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [-0.5, 0.0]), (6, [])]
    query = module.F.col("vec_id") % 100 == 0
    found = [tuple(r) for r in top_inner_products(vectors(spark, rows), query).orderBy("rank").collect()]
    assert [(r[0], r[2]) for r in found] == [(0, 1), (0, 5)] and found[0][3] == 2**63 - 1 and found[1][3] == -512 * 1024
    assert top_inner_products(vectors(spark, rows).limit(0), query).count() == 0


def test_search_keeps_ties_with_smaller_ids():
    shard = Shard(np.arange(100, 0, -1), np.ones((100, 3)))
    assert search([shard], 5, np.ones(3), 3, -10) == [(3, 1), (3, 2), (3, 3)]
    assert search([shard], 5, np.ones(3), 3, 3) == [(3, 1), (3, 2), (3, 3)]
    assert search([shard], 5, np.ones(3), 3, 4) == []


@pytest.mark.parametrize("name", ["comment-content", "comment-body", "sidebar-content", "widget-content", "comment-page", "siteFooter", "content comments"])
def test_asides_with_layout_words(name):
    aside = f'<div class="{name}"><p>{LONG} A reader says so.</p></div>'
    assert main_text(f"<article><p>{LONG}</p>{aside}</article>") == LONG
    assert main_text(f"<p>{LONG}</p>{aside}") == LONG
    assert main_text(f'<div id="comments"><article><p>{LONG} Says one.</p></article></div><article><p>{LONG}</p></article>') == LONG


@pytest.mark.parametrize("name", ["has-sidebar", "page-with-ads", "no-comments", "sidebar-layout"])
def test_layouts_are_no_asides(name):
    assert main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG


def test_boxes_around_the_article():
    for name in ("notice", "overlay", "banner"):
        assert main_text(f'<div id="{name}"><article><p>{LONG}</p></article></div>') == LONG
        assert main_text(f'<div id="{name}"><p>{LONG}</p></div>') == LONG
        assert main_text(f'<p>{LONG}</p><div id="{name}"><p>{LONG} Now.</p></div><p>{LONG}</p>').split("\n") == [LONG, LONG]


def test_custom_elements_are_text():
    page = f"<article><p>{LONG}</p><video-player></video-player><p>{LONG}</p><button-group><p>{LONG}</p></button-group><script-x/><p>{LONG}</p></article>"
    assert main_text(page).split("\n") == [LONG] * 4
    assert main_text(f"<article><p>{LONG}</p><button>{LONG}</button><video src=x>{LONG}</video><script/><p>{LONG}</p></article>").count(LONG) == 2


def test_inline_elements_that_are_not_shown():
    for hides in ("hidden", 'style="color: red; display:none"', "hidden=''"):
        page = f"<article><p>{LONG}<span {hides}>never <b>or <span>at</span> all</b><br><br>no</span> And this.</p><p>{LONG}<i {hides}>open</p><p>{LONG}</p></article>"
        assert main_text(page).split("\n") == [LONG + " And this.", LONG, LONG]
    assert main_text(f'<article><p>{LONG} <span title="hidden display:none">Shown.</span></p></article>') == LONG + " Shown."


OTHER = (
    "Ensimmäinen lause alkaa tästä ja jatkuu pitkään, jotta lukija saa tietää mistä tekstissä puhutaan. Toinen lause seuraa sitä "
    "eikä ole yhtään lyhyempi kuin ensimmäinen, sillä senkin pitää olla riittävän pitkä laskettavaksi mukaan."
)


def test_a_language_without_stop_words():
    links = "".join(f"<li><a href=x>Uutiset {i}</a></li>" for i in range(9))
    page = f"<nav>{links}</nav><h1>Otsikko</h1><p>{OTHER}</p><p>Lyhyt.</p><p>{OTHER}</p><ul>{links}</ul><p>Oikeudet.</p>"
    assert main_text(page).split("\n") == ["Otsikko", OTHER, "Lyhyt.", OTHER]
    # Beside a known language, text without its words is no article.
    assert main_text(f"<p>{LONG}</p><p>{LONG}</p><p>{OTHER}</p><p>End.</p>").split("\n") == [LONG, LONG]


def naive_text(blocks):
    """The block rules, block by block, over (text, linked part, heading) without article elements."""
    from newsloom.llm.html_text import STOP_WORDS

    def stops(text):
        words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))

    share = lambda b: len(b[1]) / len(b[0])
    running = [b for b in blocks if len(b[0]) >= 70 and share(b) <= 0.2]
    known = not running or any(stops(b[0]) >= 0.08 for b in running)
    labels = []
    for b in blocks:
        if share(b) > 0.2:
            label = "bad"
        elif len(b[0]) < 70:
            label = "bad" if b[1] else "short"
        elif not known or stops(b[0]) >= 0.32:
            label = "good" if len(b[0]) > 200 else "near"
        else:
            label = "near" if stops(b[0]) >= 0.30 else "bad"
        labels.append(label)
    for i in range(len(blocks) - 2, -1, -1):
        if labels[i] == "short" and blocks[i][2] and labels[i + 1] in ("good", "near"):
            labels[i] = "near"
    sides = lambda i, stop: [
        next((x for x in part if x in stop), "bad") for part in (labels[:i][::-1], labels[i + 1 :])
    ]
    new = list(labels)
    for i, x in enumerate(labels):
        if x == "short":
            near = sides(i, ("good", "near", "bad"))
            new[i] = "good" if "good" in near and "bad" not in near else "bad"
    labels = list(new)
    for i, x in enumerate(labels):
        if x == "near":
            new[i] = "bad" if sides(i, ("good", "bad")) == ["bad", "bad"] else "good"
    return [b[0] for b, x in zip(blocks, new) if x == "good"]


def test_block_rules_against_a_naive_version():
    pick = random.Random(12)
    texts = [LONG, LONG[:150].strip(), OTHER, "Short one.", "Read more", "word " * 30 + "end", "the " * 12 + "rare " * 26 + "end"]
    for _ in range(400):
        foreign = pick.random() < 0.15
        blocks, page = [], ""
        for _ in range(pick.randint(0, 12)):
            text = pick.choice([OTHER, "Lyhyt."] if foreign else texts)
            heading, linked = pick.random() < 0.2, ""
            if pick.random() < 0.3:
                linked = text[: pick.choice([4, len(text) // 2, len(text)])].strip()
            inner = f"<a href='x'>{linked}</a>{text[len(linked):]}" if linked else text
            blocks.append((text, linked, heading))
            page += f"<h2>{inner}</h2>" if heading else f"<p class='x'>{inner}</p>\n"
        assert main_text(page).split("\n") == (naive_text(blocks) or [""])
