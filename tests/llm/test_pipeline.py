"""The pipeline from end to end, with odd rows among the documents."""

import hashlib
import re
from pathlib import Path

import pytest

import corpus_pipeline
from collatium.llm import op1_bpe, op2_quality, op5_langid, op10_simhash
from collatium.llm.common import release


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The driver's smallest tables, with nulls in every column, empty, wordless and repeated rows, and a column of a clashing name."""
    out = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, "Words without an id, and the rest of them are in the table of the others.", "en", "src1", 70), (90_001, None, None, None, None), (90_002, "", "de", "src2", 0), (90_003, " \n\t", "fr", "src1", 3), (90_004, "%%% 12 %%", "en", "src3", 9)]
    more = spark.createDataFrame(odd, docs.schema).unionByName(docs.limit(20)).unionByName(docs.limit(20))
    docs.unionByName(more).selectExpr("*", "'own' as score", "1 as tokens", "'own' as language").write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, names = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, folder))
        kept[name] = (docs.collect(), out.collect())
        docs = out
        assert set(names) <= set(out.columns) and (name == "encoding" or out.columns == names)
        assert len(kept[name][1]) <= len(kept[name][0]) and kept[name][1]
    before, after = kept["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {90_004} and len(after) > 0.9 * (len(before) - 5)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "encoding"]
    # near-duplicates: one of each group stays, and no two that stay are near
    before, after = kept["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in after}
    near = [(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert not near and len(after) == len(sets)
    assert {r.text for r in before if len((r.text or "").split()) > 8 and not any(len(shingles(r.text) & s) * 5 >= 4 * len(shingles(r.text) | s) for k, s in sets.items() if k != r.doc_id)} <= {r.text for r in after}
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in kept["encoding"][1][:50]:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_of_the_whole_and_of_nothing(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 20
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_give_memory_back(spark, folder, monkeypatch):
    """Python workers serve one stage after the other: none starts with what another has freed, and none keeps what it freed."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0).cache()
    runs, whole = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: (runs.append(run), whole(df, run, schema))[1])
    op10_simhash.signatures(docs, "doc_id", "text", 5)
    op10_simhash.hash_sets(docs, "doc_id", "text", 5)
    op1_bpe.encode_decode(docs, "")
    op2_quality.features_of(docs.select("text", "source", "lang", "n_chars"))
    op2_quality.score(docs, None)
    op5_langid.with_likelihoods(docs, None, "text")
    op10_simhash.near_labels(docs)
    monkeypatch.undo()
    monkeypatch.setattr(op1_bpe, "codec", lambda path: None)
    assert len(runs) == 9 and not docs.count()  # near_labels has signatures, hash_sets and near_edges

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    for run in runs:
        release()
        base = held()
        blocks = [b"x" * (1000 + i % 7) for i in range(60_000)]
        pins = blocks[::5000]  # freed blocks below one that lives stay with the process
        del blocks
        assert held() > base + 40
        assert not sum(x.num_rows for x in run(iter([])))
        assert held() < base + 15
        del pins
