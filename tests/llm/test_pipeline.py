import corpus_pipeline as cp
from priorview.llm import decontaminate as d
from priorview.llm import packing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, line_id string, tree_host int, near_key long"


def rows():
    return [(1, "the cat sat on the mat and looked at the dog", "en", "s", 9, "x", 1, 2), (2, None, "en", "s", 0, "x", 1, 2),
            (3, "", None, None, None, None, None, None), (4, "123 456 --", "en", "s", 1, "x", 1, 2),
            (5, "le chat est assis sur le tapis et regarde le chien", "fr", "s", 1, "x", 1, 2),
            (6, "le chat est assis sur le tapis et regarde le chien\nune autre ligne ici", "fr", "s", 1, "x", 1, 2),
            (None, "a line of a document without id, the only one", "en", "s", 1, "x", 1, 2),
            (1, "the cat sat on the mat and looked at the dog", "en", "s", 9, "x", 1, 2)]


def test_stages_keep_columns_and_cases(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for frame in (docs, docs.where("false")):
        cur = frame
        for _, stage in cp.STAGES[:-1]:
            cur = cp.stored(stage(spark, cur, SF), "test")
            assert [f.simpleString() for f in cur.schema] == [f.simpleString() for f in docs.schema]
        last = cp.STAGES[-1][1](spark, cur, SF)
        assert last.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ids = sorted((r.doc_id for r in last.collect()), key=str)
        assert ids == ([] if frame is not docs else [1, 5, 6, None])
    after = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, docs.where("doc_id >= 5"), SF).collect()}
    assert after[6] == ("une autre ligne ici", 19)


def test_run(spark):
    got = cp.run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = d.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    bad = {list(docs)[k] for k, *_ in items.scan([r.text for r in docs.values()])}
    kept = {r.doc_id for r in got}
    assert kept <= set(docs) and 0 < len(kept) < len(docs)
    assert not [i for i in bad & kept if "\n" not in docs[i].text]  # a passage within one line stays whole
    assert len(kept) > 0.6 * len(docs)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.SEPARATOR == 1
