"""The corpus pipeline and each of its stages on small tables: nulls, empty and long texts, repeated rows, clashing names."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from ruleloom.llm import common, near_dedup, packing, quality_model
from ruleloom.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, class_id string, digest string, n_words int, removed_spans string, `_id` int, best string"
EXTRA = (5, 0.5, True, "c", "d", -1, "r", 1, "b")


def text_of_words(seed, n=80):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)) + "."


def texts():
    shared = text_of_words(1000, 60)
    near = text_of_words(2000, 200).split()
    out = {i: text_of_words(i) for i in range(30)}
    out |= {30: None, 31: "", 32: " \n\t", 33: " ".join(f"long{i}" for i in range(20_000)), 34: out[3], 35: out[3].replace(" ", "  ", 1)}
    out |= {36: " ".join(near), 37: " ".join([*near[:90], "edited", *near[91:]]), 38: f"First words.\n{shared}", 39: f"{text_of_words(3000)}\n{shared}\nAnd the end of it."}
    return out | {i: " ".join(["### junk"] * 50) for i in range(40, 60)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", *EXTRA) for i, t in texts().items()]
    rows += [rows[4]] * 5 + [(None, text_of_words(99), *[None] * 11)] * 3 + [(-(2**63), text_of_words(98), *[None] * 11)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(not (t or "").startswith("###")), 0) for i, t in texts().items()]
    spark.createDataFrame([*marks, (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark, folder):
    docs, seen = common.documents(spark, folder), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, folder))
        assert docs.dtypes == before.dtypes, name
        seen.append({r.doc_id: r for r in docs.collect()})
    quality, exact, near, cut = seen
    assert not any(i in quality for i in range(40, 60)) and all(i in quality for i in [*range(30), 36, 37, None, -(2**63)])
    assert 35 in exact and 3 not in exact and 34 not in exact  # the longest text of a group stays
    assert 36 in near and 37 not in near
    assert cut[38].text == texts()[38] and cut[39].text == f"{text_of_words(3000)}\nAnd the end of it." and cut[0].text == texts()[0]
    assert all(cut[i].kept is True and cut[i].n_words == -1 for i in (0, 38))
    for r in seen[1:]:
        assert sum(1 for i in r if i == 4) == 1


def test_run_packs_what_the_stages_keep(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    coder = packing.tokenizer(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    for doc in (0, 38):
        ids, at = coder.encode(texts()[doc]) + (1).to_bytes(4, "little"), 0
        for p in got[got.doc_id == doc].sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    assert not set(got.doc_id.dropna()) & {*range(40, 60), 34, 37}


def test_empty_tables(spark, folder):
    docs = common.documents(spark, folder).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages_equal_brute_force(spark, folder):
    """Quality, exact and near stages against their operators' rules, in plain Python, on all rows."""
    docs = common.documents(spark, folder)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    model = quality_model.train(docs, common.labels(spark, folder))
    rows = [r for r, s in zip(rows, model.score(np.array([quality_model.measure(t) for _, t in rows]))) if s >= 0.3]
    bare = lambda t: t.translate({ord(c): None for c in common.BLANKS})
    rank = lambda r: (-len(r[1]), r[0] is None, r[0] or 0)
    groups = {}
    for r in rows:
        groups.setdefault(bare(r[1]), []).append(r)
    rows = sorted((min(g, key=rank) for g in groups.values()), key=lambda r: (r[0] is None, r[0] or 0))
    h = [near_dedup.shingle_labels(near_dedup.words_of(t)) for _, t in rows]
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near_dedup.aligned(h[a], h[b]) or not (len(h[a]) or len(h[b])):
                top = [min(top[a], top[b]) if x in (top[a], top[b]) else x for x in top]
    rows = [r for i, r in enumerate(rows) if top[i] == i]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.materialise(stage(spark, docs, folder))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()) == sorted((i is None, i or 0, t) for i, t in rows)
