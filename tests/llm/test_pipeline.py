import brute
import corpus_pipeline
from newsloom.llm.language import MIN_MARGIN, _compressor, learn
from newsloom.llm.packing import pack_documents
from newsloom.llm.quality_lines import BOILERPLATE


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    languages = _compressor(learn(docs))
    rows = [(i, t) for i, t in rows if languages.predict(t)[1] >= MIN_MARGIN]

    kept = []
    for i, t in rows:
        n, _, _, _, repeat, _, _, lost = brute.quality(t, BOILERPLATE)
        if n >= 20 and 100 * repeat <= 30 * n and 100 * lost <= 60 * n:
            lines = t.split("\n")
            left = []
            for k, line in enumerate(lines):
                if not brute.quality(line, BOILERPLATE)[6]:
                    left.append(line + ("\n" if k + 1 < len(lines) else ""))
            kept.append((i, "".join(left)))
    found = brute.components(kept)
    last = [(i, t) for i, t in kept if found[i][1] == i]
    expected = pack_documents(spark.createDataFrame(last, "doc_id long, text string"))
    shown = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, expected.select(shown).collect()))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
