"""The pipeline's stages against brute force on the small table."""

import pytest

import corpus_pipeline as cp
from gravelbed.llm import simhash


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_groups(rows, threshold=0.8):
    """Smallest id of each row's group, over all pairs."""
    sets, root = [(i, shingles(t)) for i, t in sorted(rows)], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_order(stages):
    columns = stages["documents"].columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "pieces"]
    assert all(stages[n].columns == columns for n, _ in cp.STAGES[:-1]) and stages["pieces"].columns == [*columns, "tokens", "n_tokens"]


def test_exact_stage(stages):
    rows = stages["toxicity"].collect()
    best = {}
    for r in rows:
        key = (r["text"] or "").encode().lower()
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in stages["exact_dedup"].collect()} == set(best.values())


def test_near_stage(stages):
    groups = brute_groups([(r["doc_id"], r["text"]) for r in stages["exact_dedup"].collect()])
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == set(groups.values())


def test_run_equals_stages(spark, sf_dir, stages):
    a, b = ({r["doc_id"]: (r["n_tokens"], r["text"]) for r in df.collect()} for df in (cp.run(spark, sf_dir), stages["pieces"]))
    assert a == b and len(a) > 0


def test_near_duplicates_of_made_groups(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:100], "new", *base[101:]])), (3, " ".join([*base, *(f"z{i}" for i in range(30))])), (4, " ".join(f"v{i}" for i in range(90)))]
    rows += [(10 + k, " ".join([*(f"q{i}" for i in range(150)), f"end{k}"])) for k in range(150)] + [(5, ""), (6, None), (None, "a b c"), (7, "x y"), (8, "x y z"), (9, "twice"), (9, "twice")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} | {10 + k: 10 for k in range(150)}
    assert simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2 + 1 + 7
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_pairs_at_the_threshold_are_all_found(spark):
    rows = []
    for g in range(40):  # 40 of 200 shingles replaced in each of two ways: 160 / 200
        base = [f"g{g}w{i}" for i in range(184)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[:164], *(f"g{g}z{i}" for i in range(20))]))]
    kept = brute_groups(rows)
    assert all(kept[2 * g + 1] == 2 * g for g in range(40))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept


def test_chains_through_contracted_members(spark):
    """Each text is near the next alone, in buckets that all of them share and that are dealt in parts."""
    line = [f"w{i}" for i in range(700)]
    rows = [(k, " ".join(line[3 * k : 3 * k + 160])) for k in range(150)] + [(1000 + k, " ".join([*line[:100], *(f"k{k}x{i}" for i in range(100))])) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: r for i, r in brute_groups(rows).items() if i < 150}
    assert set(want.values()) == {0}
    old, simhash.PART = simhash.PART, 16
    try:
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()} == want
    finally:
        simhash.PART = old
