"""Line dedup, mixing, quality rules, neighbours and the pipeline against brute force."""

from __future__ import annotations

import random
import uuid
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modlens.llm import ann, line_dedup, mixing, quality_rules
from modlens.llm.queries import ORACLE


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice("abc") * rng.randrange(2)
        b = "".join(b)
        for most in (1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == min(distance(a, b), most + 1)


def slow_drops(rows, min_chars=20, near_chars=40, edits=2):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if len(line) >= min_chars:
                first.setdefault(line, (i, k))
    near = {
        b for a in first for b in first
        if first[a] < first[b] and len(a) >= near_chars and len(b) >= near_chars
        and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    }
    return {
        (i, k) for i, t in rows for k, line in enumerate((t or "").split("\n"))
        if line in first and (line in near or first[line] != (i, k))
    }


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "house", "tree", "été", "straße"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 13))) for _ in range(25)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice("xyz")
            own.append("".join(line))
        rows.append((i, "\n".join(own)))
    return rows


def test_line_dedup_equals_all_pairs(docs_of, line_rows):
    drops = slow_drops(line_rows)
    got = {tuple(r) for r in line_dedup.dropped_lines(docs_of(line_rows)).collect()}
    assert got == drops and len(drops) > 20


def test_finer_cuts_equal_all_pairs(docs_of, line_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 0)
    got = {tuple(r) for r in line_dedup.dropped_lines(docs_of(line_rows)).collect()}
    assert got == slow_drops(line_rows)


def test_finer_cuts_share_a_key():
    """Lines within the edits share a key that is one of the shorter line's own."""
    rng = random.Random(9)
    for edits, pieces, size in [(1, 4, 40), (2, 8, 40), (2, 16, 55), (3, 8, 47)]:
        for _ in range(60):
            a = "".join(rng.choice("abcd") for _ in range(size))
            b = list(a)
            for _ in range(edits):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = rng.choice("xyz") * rng.randrange(2)
            a, b = sorted((a, "".join(b)), key=len)
            if distance(a, b) > edits:
                continue
            keys = {0: set(), 1: set()}
            for rows, found, own in line_dedup.finer_keys([a, b], edits, pieces):
                for row, key, is_own in zip(rows.tolist(), found.tolist(), own.tolist(), strict=True):
                    if is_own or row:
                        keys[row].add(key)
            assert keys[0] & keys[1], (a, b)


def test_lines_that_share_a_third_are_not_paired(docs_of, monkeypatch):
    rng = random.Random(12)
    head = "every page of this site starts with these words "
    rows = [(i, head + "".join(rng.choice("abcdefghij ") for _ in range(100))) for i in range(400)]
    rows.append((400, rows[7][1][:90] + "#" + rows[7][1][90:]))
    compared = []
    verify = line_dedup.near_lines
    monkeypatch.setattr(
        line_dedup, "near_lines", lambda docs, pairs, edits: compared.append(pairs.count()) or verify(docs, pairs, edits)
    )
    got = {tuple(r) for r in line_dedup.dropped_lines(docs_of(rows)).collect()}
    assert got == {(400, 0)} and sum(compared) < 3 * len(rows)


def test_line_dedup_odd_rows(docs_of, odd):
    out = line_dedup.line_dedup(docs_of(odd))
    drops = slow_drops([r[:2] for r in odd])
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text, *_ in odd:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in drops)
        assert (got[i]["text"], got[i]["n_dropped"]) == (kept, sum(d[0] == i for d in drops))
    assert {"score", "line", "n", "sig"} <= set(out.columns)
    assert line_dedup.line_dedup(docs_of([])).collect() == []


def test_mixing_meets_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    targets = {"source": {"src0": 0.5, "src1": 0.2}, "lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}
    out = mixing.mixing(docs, temper=0.5, targets={**targets, "source": {**targets["source"], mixing.REST: 0.3}})
    rows = out.collect()
    assert len(rows) == docs.count()
    total = sum(r["n_tokens"] * r["weight"] for r in rows)
    share = lambda c, v: sum(r["n_tokens"] * r["weight"] for r in rows if r[c] == v) / total
    for dimension, goals in targets.items():
        for value, goal in goals.items():
            assert share(dimension, value) == pytest.approx(goal, abs=2e-3)
    topics = Counter()
    for r in rows:
        topics[r["topic"]] += r["n_tokens"]
    tempered = {t: (n / sum(topics.values())) ** 0.5 for t, n in topics.items()}
    for t, n in tempered.items():
        assert share("topic", t) == pytest.approx(n / sum(tempered.values()), abs=2e-3)
    assert max(r["probability"] for r in rows) == 1
    assert all(0 < r["probability"] <= 1 for r in rows)
    drawn = docs.select("doc_id", mixing.draw(F.col("doc_id"), 7).alias("u"))
    u = dict(drawn.collect())
    assert all(r["selected"] == (u[r["doc_id"]] < r["probability"]) for r in rows)


def test_rake_by_hand():
    index = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    tokens = np.array([40.0, 10.0, 20.0, 30.0])
    weights = mixing.rake(index, tokens, [np.array([0.7, 0.3]), np.array([0.5, 0.5])])
    fitted = weights * tokens / (weights * tokens).sum()
    assert fitted[:2].sum() == pytest.approx(0.7) and fitted[[0, 2]].sum() == pytest.approx(0.5)
    # raking keeps the odds ratio
    assert fitted[0] * fitted[3] / fitted[1] / fitted[2] == pytest.approx(6.0)


def test_one_odd_row_leaves_the_other_cells(spark):
    """A short document of an odd source and language: what the others keep stays, in the operator and the stage."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.DOCUMENT)
    odd = spark.createDataFrame([(10**6, "word " * 20, "xx", "odd", 100)], docs.schema)
    before, after = (
        {r["doc_id"]: r for r in mixing.mixing(d).drop("text").collect()} for d in (docs, docs.union(odd))
    )
    assert after[10**6]["probability"] == 1 and after[10**6]["multiplicity"] > 2
    for i, r in before.items():
        assert after[i]["probability"] == pytest.approx(r["probability"], rel=0.01)
    rows = corpus_pipeline.mixed_sources(spark, docs.union(odd), "").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({i: r["copies"] for i, r in after.items() if r["copies"]})
    assert sum(before[i]["n_tokens"] for i in {r["doc_id"] for r in rows} - {10**6}) > 0.9 * sum(
        r["n_tokens"] for r in before.values()
    )
    # and the stage has the mix: languages within two standard errors or so of their weighted shares
    kept, goal = Counter(), Counter()
    for r in after.values():
        kept[r["lang"]] += r["n_tokens"] * r["copies"]
        goal[r["lang"]] += r["n_tokens"] * r["weight"]
    for v in goal:
        assert kept[v] / sum(kept.values()) == pytest.approx(goal[v] / sum(goal.values()), abs=0.01)


def test_mixing_size(docs_of):
    """Probability times multiplicity is the rate of the stated size, so weighted tokens have that size and the mix."""
    text = "one two three four five"
    rows = [(i, text, "en" if i < 90 else "fr", "s") for i in range(100)]
    targets = {"source": {"s": 1}, "lang": {"en": 0.5, "fr": 0.5}}
    got = {r["lang"]: r for r in mixing.mixing(docs_of(rows), targets=targets, size=0.6).collect()}
    assert (got["en"]["probability"], got["en"]["multiplicity"]) == (pytest.approx(1 / 3), 1)
    assert (got["fr"]["probability"], got["fr"]["multiplicity"]) == (1, pytest.approx(3))
    assert got["fr"]["copies"] in (2, 3, 4)
    whole = mixing.mixing(docs_of(rows), temper=1.0).collect()
    assert {(r["probability"], r["selected"], r["copies"]) for r in whole} == {(1, True, 1)}


def test_mixing_odd_rows(docs_of, odd):
    rows = mixing.mixing(docs_of(odd)).collect()
    assert len(rows) == len(odd) and all(0 <= r["probability"] <= 1 for r in rows)
    assert mixing.mixing(docs_of([])).collect() == []


def test_rules_odd_rows(docs_of, odd):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [*odd, (100, long, "en", None), (101, "a b c d " * 30, "en", None), (102, f"{long}\n{long}\nx\nx", "en", None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs_of(rows)).collect()}
    for i, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {
            j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)
        }
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(docs_of([])).collect() == []


def test_rules_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE["op5_quality_rules"]).to_arrow_table()
    got = quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).toArrow()
    order = lambda t: t.select(sorted(t.column_names)).sort_by("doc_id").to_pylist()
    assert order(got) == order(want)


def nearest_by_hand(ids, x, query, k=10):
    out = []
    for q in sorted({i for i in ids if query(i)}):
        v = x[ids.index(q)]
        d = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in zip(ids, x, strict=True) if i != q)
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(1, 16)), 600, 0)]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, v.tolist(), "c") for i, v in zip(ids, x, strict=True)]
    rows += [(9000, None, "c"), (9100, [], "c"), (9200, [0.0] * 16, "c"), (9300, [float("nan")] * 16, "c"), (None, [1.0] * 16, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    got = ann.nearest(table, F.col("vec_id") % 100 == 0).collect()
    want = nearest_by_hand(ids, x.astype(np.float64), lambda i: i % 100 == 0)
    assert len(got) == len(want)
    true = defaultdict(set)
    for q, _, i, _ in want:
        true[q].add(i)
    assert np.mean([r["vec_id"] in true[r["query_id"]] for r in got]) >= 0.95
    at = dict(zip(ids, x.astype(np.float64), strict=True))
    for r in got:
        assert r["score"] == pytest.approx(float(np.sqrt(((at[r["query_id"]] - at[r["vec_id"]]) ** 2).sum())), abs=1e-12)
    # equal vectors: distance 0, smallest ids first
    same = sorted(ids[1500:])
    for q in [i for i in same if i % 100 == 0]:
        own = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert own == [i for i in same if i != q][:10]


def test_few_neighbours(spark):
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (0, [1.0, 0.0])], schema)
    got = sorted(tuple(r)[:3] for r in ann.nearest(table, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(spark.createDataFrame([], schema), F.lit(True)).collect() == []


def test_graph_finds_the_nearest_centroid():
    rng = np.random.default_rng(2)
    graph = ann.CentroidGraph(ann.balanced_centroids(rng.normal(size=(4000, 8)), 300, rng))
    x = rng.normal(size=(400, 8))
    exact = ((x[:, None] - graph.c[None]) ** 2).sum(2).argmin(1)
    assert (graph.search(x)[0][:, 0] == exact).mean() > 0.97


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage of the pipeline reads and gives, on a small table with planted cases."""
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    source = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 400")
    extra = [(10_000 + i, t, None, None, None) for i, t in enumerate([None, "", "Same short line.", "\n\n"])]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{sf_dir}/labels.parquet")
    before, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/{name}-{uuid.uuid4().hex}"
        stage(spark, before, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (before, after)
        before = after
    return out, sf_dir


def texts(df):
    return dict(df.select("doc_id", "text").collect())


def test_stages_keep_clean_documents(stages):
    out, _ = stages
    for name in list(out)[:-1]:
        before, after = out[name]
        assert after.columns == before.columns == corpus_pipeline.DOCUMENT
        assert set(texts(after)) <= set(texts(before))
    before, after = out["toxicity"]
    assert len(texts(after)) > 0.9 * len(texts(before))


def test_stage_line_dedup(stages):
    before, after = (texts(x) for x in stages[0]["line_dedup"])
    drops = {d for d in slow_exact(before)}
    for i, text in before.items():
        left = None if text is None else [x for k, x in enumerate(text.split("\n")) if (i, k) not in drops]
        if i in after and text is not None:
            assert set(after[i].split("\n")) <= set(left)
        else:
            assert i in after or not "".join(left).strip()


def slow_exact(rows):
    """Later copies of equal lines."""
    first = {}
    for i in sorted(rows):
        for k, line in enumerate((rows[i] or "").split("\n")):
            if len(line) >= 20:
                if line in first:
                    yield (i, k)
                first.setdefault(line, (i, k))


def test_stage_near_duplicates(stages):
    before, after = (texts(x) for x in stages[0]["near_duplicates"])
    grams = {}
    for i, t in before.items():
        w = (t or "").lower().encode().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in grams}
    for a in sorted(grams):
        for b in grams:
            if a < b and grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    assert set(after) == {i for i, c in label.items() if i == c}


def test_pipeline_packs_what_is_left(spark, stages):
    out, sf_dir = stages
    before, after = out["packing"]
    assert {r["doc_id"] for r in after.collect()} == set(texts(before))
    again = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, again.collect())) == sorted(map(key, after.collect()))


def test_finer_keys_stay_inside_the_shared_one():
    """A line of 90 characters has few finer keys for the key it shares with many (195 before), and lines within two
    edits share one of them wherever they are edited."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    starts, ends, _, own = line_dedup.finer_probes(90, 0, 2, 8)
    assert starts.shape == ends.shape and own.any() and len(own) <= 60
    for slot in range(len(line_dedup.probes(90, 2)[0])):
        assert len(line_dedup.finer_probes(90, slot, 2, 8)[2]) <= 60
    for _ in range(100):
        other, found = list(line), [{}, {}]
        for _ in range(2):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        other = "".join(other)
        for rows, keys, own in line_dedup.finer_keys([line, other], 2, 16):
            for row, key, mine in zip(rows.tolist(), keys.tolist(), own.tolist(), strict=True):
                found[row][key] = found[row].get(key, False) or mine
        assert any(found[0][k] or found[1][k] for k in found[0].keys() & found[1].keys())


def test_copies_leave_after_the_join_with_shared_keys(docs_of, line_rows, monkeypatch):
    """All keys of all lines are unfolded where they meet the shared ones, and not shuffled to leave out copies."""
    plans, write = {}, line_dedup.written

    def spied(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "written", spied)
    line_dedup.line_dedup(docs_of(line_rows)).count()
    assert "LeftSemi" in plans["entries"] and "Generate" not in plans["entries"]
