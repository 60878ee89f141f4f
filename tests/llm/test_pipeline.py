"""Every stage of the pipeline against a plain version of it, on its own input; planted cases; and the whole run."""

import base64
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_decontaminate import plain as plain_leaks
from test_linejoin import plain as plain_lines
from test_simhash import plain_groups, plain_print

import corpus_pipeline
from marquee.llm import simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The given documents with planted ones, and what each stage made of the rows the one before it kept."""
    folder = tmp_path_factory.mktemp("tables")
    given = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    passage = given["benchmark"].first()["text"]
    words = [f"planted{i}" for i in range(70)]
    own = " ".join(f"kept{i}" for i in range(60))
    rows = [(10_001, own), (10_002, own), (10_003, own.replace("kept7 ", "other ")), (10_004, "start of it\n" + " ".join(words)),
            (10_005, "another begin\n" + " ".join(words)), (10_006, f"before that {passage} after that"), (10_007, "clean words of its own here"),
            (10_008, None), (10_009, ""), (None, "no id at all")]
    planted = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], given["documents"].schema)
    given["documents"].union(planted).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        given[t].write.parquet(f"{folder}/{t}.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(folder)).write.parquet(f"{folder}/stage{number}")
        out.append(spark.read.parquet(f"{folder}/stage{number}"))
    return str(folder), out, given


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_columns_of_documents_until_the_last_stage(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    assert all(df.columns == COLUMNS for df in stages[1][:-1])


def test_toxicity_drops_what_the_chain_rejects(spark, stages):
    folder, out, given = stages
    known, categories = toxicity.by_language(out[0], given["labels"])
    model = toxicity.train(out[0], known, categories)
    place, rejected = model.place(), set()
    for row in out[0].select("doc_id", "text").collect():
        values = np.zeros((1, len(place)))
        for feature, n in toxicity.text_features(row.text).items():
            if feature in place:
                values[0, place[feature]] = n
        p = model.probabilities(np.log1p(np.minimum(values, toxicity.MANY)))[0]
        if (p >= np.array(model.thresholds)).any():
            rejected.add(row.doc_id)
    assert rejected and ordered(r.doc_id for r in out[1].collect()) == ordered(r.doc_id for r in out[0].collect() if r.doc_id not in rejected)
    assert {10_001, 10_007, None} <= {r.doc_id for r in out[1].collect()}


def test_lines(stages):
    assert ordered(pairs(stages[1][2])) == plain_lines(pairs(stages[1][1]))


def test_near_copies(stages):
    before, after = pairs(stages[1][2]), pairs(stages[1][3])
    groups = {}
    prints = [(i, plain_print(t, 5)) for i, t in before if i is not None]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (_, a) in enumerate(prints):
        for _, b in prints[:k]:
            if (a ^ b).bit_count() <= simhash.RADIUS:
                root[find(a)] = find(b)
    for i, p in prints:
        groups[find(p)] = min(i, groups.get(find(p), i))
    assert ordered(i for i, _ in after) == ordered([*groups.values(), *(i for i, _ in before if i is None)])


def test_benchmark(stages):
    before, after = pairs(stages[1][3]), pairs(stages[1][4])
    items = [tuple(r) for r in stages[2]["benchmark"].select("item_id", "text").collect()]
    held = {d for d, _ in plain_leaks(before, items)}
    assert 10_006 in held and ordered(after) == ordered(r for r in before if r[0] not in held)


def test_planted_cases(stages):
    left = {r.doc_id: r.text for r in stages[1][4].collect()}
    assert left[10_001] and 10_002 not in left and 10_003 not in left and 10_006 not in left
    assert left[10_005] == "another begin" and left[10_007] == "clean words of its own here" and None in left


def test_tokens(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {i: library.encode_ordinary(t or "") for i, t in pairs(stages[1][4])}
    found = stages[1][5].collect()
    assert len(found) == len(expected)
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == expected[r.doc_id] and r.same
        assert r.ids_sha256 == sha256(r.ids).hexdigest()


def test_run_is_the_stages_one_after_the_other(spark, stages):
    assert ordered(tuple(r) for r in corpus_pipeline.run(spark, stages[0]).collect()) == ordered(tuple(r) for r in stages[1][5].collect())
