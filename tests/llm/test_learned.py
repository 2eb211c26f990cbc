"""Toxicity, quality and language identification: held-out accuracy, odd rows, empty tables."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens.llm import language_id, license_scan, quality, toxicity
from modlens.llm.common import crc_remainder, remainder
from modlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_remainders_agree(spark):
    ids = spark.range(50).withColumn("r", remainder(F.col("id"), 4))
    assert all(r["r"] == crc_remainder(r["id"], 4) for r in ids.collect())


def test_toxicity_held_out(spark, labels):
    """Few toxic documents are there to learn from, so some held-out ones are missed, but clean ones stay."""
    found = by_id(QUERIES["op7_toxicity"](spark, SF).collect())
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    clean = [i for i, y in truth.items() if y == 0]
    assert all(r["held_out"] == (crc_remainder(i, 3) == 1) for i, r in found.items())
    assert sum(found[i]["predicted"] for i in clean) <= 0.02 * len(clean)
    mean = lambda y: np.mean([found[i]["score"] for i, v in truth.items() if v == y])
    assert mean(1) > mean(0) + 0.2


def test_toxicity_learns_wording():
    rng = np.random.default_rng(0)
    words = [f"w{''.join(rng.choice(list('abcdefghij'), 4))}" for _ in range(400)]
    rows = []
    for i in range(600):
        text = list(rng.choice(words, 60))
        if i % 3 == 0:
            for _ in range(3):
                text[rng.integers(60)] = "venomous"
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    model = toxicity.train(rows[:450])
    assert b"venomous" in model.toxic and b"venomous" not in model.ordinary
    pair = model.compressors()
    x = np.array([toxicity.features(toxicity.distances(t, *pair)) for _, t, _ in rows[450:]])
    y = np.array([y for *_, y in rows[450:]])
    assert ((model.threshold(x) >= 0.7) == y).mean() > 0.95


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_odd_rows_and_no_labels(spark, docs_of, odd, labels, name):
    run = {"toxicity": toxicity.toxicity, "quality": quality.quality}[name]
    none = labels.where("false")
    rows = run(docs_of(odd), none, F.lit(True)).collect()
    assert [r["score"] for r in rows] == [0.0] * len(odd)
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd_docs = docs_of([(10**6 + i, *r[1:]) for i, r in enumerate(odd)]).select("doc_id", "text")
    rows = by_id(run(known.union(odd_docs), labels, F.lit(True)).collect())
    scores = [rows[10**6 + i]["score"] for i in range(len(odd))]
    assert all(0 <= s <= 1 and not math.isnan(s) for s in scores)
    assert scores[: len(odd) // 2] == scores[len(odd) // 2 :]
    assert all(rows[10**6 + i]["predicted"] == (s >= 0.7) for i, s in enumerate(scores))
    assert run(docs_of([]), labels, F.lit(True)).collect() == []


def test_quality_held_out(spark, labels):
    found = by_id(QUERIES["op2_quality"](spark, SF).collect())
    held = [r for r in labels.collect() if crc_remainder(r["doc_id"], 4) == 2]
    right = [found[r["doc_id"]]["predicted"] == r["quality"] for r in held]
    assert np.mean(right) > 0.95 and all(found[r["doc_id"]]["held_out"] for r in held)
    assert all((r["n_passages"] == 0) == (r["top_passage"] is None) for r in found.values())


def test_attention_gradient():
    """The analytic step lowers the loss like a numeric one would: training separates bags by one odd passage."""
    rng = np.random.default_rng(1)
    bags = rng.integers(1, 8, 300)
    x = rng.normal(size=(bags.sum(), 4))
    y = (np.arange(300) % 2).astype(float)
    first = np.cumsum(bags) - bags
    x[first[y == 1], 2] += 8
    model = quality.train(x, bags, y)
    score, attention = model(x, bags)
    assert ((score >= 0.5) == y).mean() > 0.97
    assert np.median([attention[f : f + b].argmax() == 0 for f, b, t in zip(first, bags, y, strict=True) if t]) == 1


def test_letters_are_letters():
    from modlens.llm.language_id import words_of

    assert words_of("½ ² ① _ 12") == [] and words_of(None) == []
    assert words_of("Été a½b x²") == ["été", "a", "b", "x"]


def test_language_held_out(spark):
    found = QUERIES["op9_language_id"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert len(right) > 200 and np.mean(right) > 0.98


def test_language_odd_rows(docs_of, odd):
    english = [(100 + i, "the house of the old man is on the hill " * (1 + i % 4), "en", None) for i in range(30)]
    german = [(200 + i, "das haus steht auf dem berg und der mann ist alt " * (1 + i % 4), "de", None) for i in range(30)]
    rows = by_id(
        language_id.language_id(docs_of([*odd, *english, *german]), F.col("doc_id") >= 100).collect()
    )
    assert all(rows[i]["lang_pred"] == ("en" if i < 200 else "de") for i in rows if i >= 100)
    for i, (_, text, *_) in enumerate(odd):
        letters = any(c.isalpha() for c in text or "")
        assert (rows[i]["lang_pred"] == "und") == (not letters)
        assert letters or (rows[i]["score"] == 0 and rows[i]["rejected"])
    assert {r["lang_pred"] for r in language_id.language_id(docs_of(odd), F.lit(False)).collect()} == {"und"}
    assert language_id.language_id(docs_of([]), F.lit(True)).collect() == []


def test_kneser_ney_sums_to_one(docs_of):
    """After any seen context the probabilities of all letters, seen or not, sum to one."""
    docs = docs_of([(1, "abab abc bcab cabba", "x", None), (2, "bacca abba", "x", None)])
    models = language_id.learn_models(docs)
    letters = "abc" + language_id.END
    for context in ("ab", "ba", "ca"):
        padded = [context + c for c in letters]
        total = 0.0
        for word in padded:
            codes = np.frombuffer((language_id.START * 3 + word).encode("utf-32-le"), dtype=np.uint32)
            end, logp = np.array([len(codes)]), 0.0
            for n in range(language_id.ORDER, 0, -1):
                table = models.orders[0][n - 1]
                at, hit = language_id._find(table.grams, language_id.hashes(codes, n, end))
                if hit[0]:
                    logp += table.logp[at[0]]
                    break
                if n > 1:
                    at, hit = language_id._find(table.contexts, language_id.hashes(codes, n - 1, end - 1))
                    logp += table.backoff[at[0]] if hit[0] else 0.0
            total += math.exp(logp)
        assert total == pytest.approx(1.0, abs=0.06)


def test_license_scan_equals_all_templates(spark):
    """Every line against every template, without looking for candidates first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {(r["doc_id"], r["first_line"], r["license"]) for r in license_scan.license_scan(docs).collect()}
    scanner, slow = license_scan.Scanner(license_scan.TEMPLATES), set()
    for r in docs.collect():
        for k, line in enumerate(r["text"].split("\n")):
            words = license_scan.words_of(line)
            fits = []
            for name, template in scanner.words.items():
                if abs(len(template) - len(words)) <= 0.2 * len(template):
                    changed = scanner.differences(name, words)
                    if len(changed) <= 0.2 * len(template):
                        fits.append((len(changed), name))
            if fits:
                slow.add((r["doc_id"], k, min(fits)[1]))
    assert found == slow and len(found) > 20


def test_license_blocks_and_changes(docs_of, odd):
    text = license_scan.TEMPLATES["MIT text"]
    wrapped = "\n".join(text[i : i + 400] for i in range(0, len(text), 400))
    altered = license_scan.TEMPLATES["ISC text"].replace("any purpose", "some purpose")
    rows = [(100, f"Intro line.\n{wrapped}\nMore prose here."), (101, altered), (102, "Licensed under nothing at all.")]
    found = {r["doc_id"]: r for r in license_scan.license_scan(docs_of([*odd, *rows])).collect()}
    assert set(found) == {100, 101}
    assert found[100]["license"] == "MIT text" and found[100]["first_line"] == 1
    assert (found[101]["license"], found[101]["changes"]) == ("ISC text", ["-any", "+some"])
    assert license_scan.license_scan(docs_of([])).collect() == []


def slow_licenses(scanner, text):
    """(first line, last line, license) by brute force: every stretch of words against every template."""
    lines = [license_scan.words_of(x) for x in text.split("\n")]
    at = [k for k, line in enumerate(lines) for _ in line]
    words, found = [w for line in lines for w in line], []
    for name, template in scanner.words.items():
        most = int(0.2 * len(template))
        for a in range(len(words)):
            for b in range(a + len(template) - most, min(len(words), a + len(template) + most) + 1):
                # inside a line a changed first or last word is one missing and one added
                low = a + (words[a] != template[0] and a > 0 and at[a - 1] == at[a])
                high = b - (words[b - 1] != template[-1] and b < len(words) and at[b - 1] == at[b])
                common = Counter(template) & Counter(words[low:high])
                n = low - a + b - high
                if len(template) + high - low - 2 * common.total() + n <= most:
                    n += len(scanner.differences(name, words[low:high]))
                    if n <= most:
                        found.append((n - len(template), n, b - a, name, a, b))
    chosen = []
    for *_, name, a, b in sorted(found):
        if all(b <= c or a >= d for c, d, _ in chosen):
            chosen.append((a, b, name))
    return [(at[a], at[b - 1], name) for a, b, name in sorted(chosen)]


def test_license_layouts_equal_all_stretches():
    """Paragraphs split by blank lines, stacked notices, notices inside prose, a changed first word."""
    t = license_scan.TEMPLATES
    cut = lambda name, *marks: reduce(lambda x, m: x.replace(m, f"\n\n{m}"), marks, t[name])
    apache = cut("Apache-2.0 notice", "http://", "Unless")
    gpl = cut("GPL-3.0 notice", "This program is distributed", "See the GNU")
    mit = cut("MIT text", "The above", "THE SOFTWARE IS")
    wrapped = "\n".join(t["ISC text"][i : i + 60] for i in range(0, len(t["ISC text"]), 60))
    cases = {
        f"Copyright 2020 A\n\n{mit}\n\nEnd.": [(2, 6, "MIT text")],
        apache: [(0, 4, "Apache-2.0 notice")],
        f"Some prose.\n{gpl}": [(1, 5, "GPL-3.0 notice")],
        f"{wrapped}\n{t['MIT']}": [(0, wrapped.count("\n"), "ISC text"), (wrapped.count("\n") + 1,) * 2 + ("MIT",)],
        f"{t['CC-BY-4.0']}\n{t['MIT']}": [(0, 0, "CC-BY-4.0"), (1, 1, "MIT")],
        f"We wrote all of this long ago. {t['GPL-3.0']} You are welcome to read on and on.": [(0, 0, "GPL-3.0")],
        f"{t['MIT']} and {t['CC-BY-SA-4.0']} are both named here.": [(0, 0, "MIT"), (0, 0, "CC-BY-SA-4.0")],
        "Published under the MIT License.": [],
        "Licensed under CC BY 3.0 since then.": [],
        f"Permissions are granted{t['ISC text'][10:]}": [(0, 0, "ISC text")],
        "Nothing of the kind is said in this text.": [],
    }
    scanner = license_scan.Scanner(t)
    for text, want in cases.items():
        got = [r[:3] for r in scanner.scan(text)]
        assert got == want == slow_licenses(scanner, text)
    assert scanner.scan(mit)[0][4] == [] and scanner.scan(apache)[0][4] == []


def test_language_limits_come_from_all_learning_documents(docs_of):
    """More learning documents than any sample held, some long: medians are those of all of them."""
    words = ["the", "house", "river", "stone", "green", "walks"]
    texts = [" ".join(words[(i * j) % 6] for j in range(1, 4 + i % 9)) for i in range(900)]
    texts += [" ".join(["qzx", "xqz", "zzq"] * 3000)] * 901  # over 20,000 characters
    docs = docs_of([(i, t, "en", "web") for i, t in enumerate(texts)])
    found = language_id.language_id(docs, F.lit(True)).collect()
    entropy = np.array([r["cross_entropy"] for r in found])
    size = np.array([sum(len(w) + 1 for w in language_id.words_of(texts[r["doc_id"]])) for r in found])
    centre = np.median(entropy)
    off = np.abs(entropy - centre) / (0.02 + 1 / np.sqrt(size))
    far = (entropy - centre) / (0.02 + 1 / np.sqrt(size)) / max(np.median(off) * 1.4826, 0.05) - language_id.TOLERANCE
    assert len(found) == 1801
    assert all(r["rejected"] == (f > 0) for r, f in zip(found, far, strict=True) if abs(f) > 0.05)
    assert [r["score"] for r in found] == pytest.approx(1 / (1 + np.maximum(far, 0)), rel=0.02)


def test_support_counts_documents_and_neighbourhoods():
    from collections import defaultdict

    rng = np.random.default_rng(6)
    documents = [[f"{'.' * (i % 3)}w{rng.integers(0, 30)}".encode() for i in range(rng.integers(0, 40))] for _ in range(50)]
    documents += [[b"..."], [], [b"copy", b"of", b"copy"], [b"copy", b"of", b"copy"]]
    around, within = defaultdict(set), Counter()
    for words in documents:
        bare = [w.strip(toxicity._EDGES) for w in words]
        within.update(set(bare))
        for i, w in enumerate(bare):
            around[w].add((bare[i - 1] if i else b"", bare[i + 1] if i + 1 < len(bare) else b""))
    assert toxicity._support(documents) == {w: min(within[w], len(s)) for w, s in around.items() if w}
    assert toxicity._support([]) == toxicity._support([[]]) == {}


def test_support_holds_little_more_than_the_words():
    import tracemalloc

    rng = np.random.default_rng(7)
    names = [f"word{i}".encode() for i in range(5000)]
    documents = [[names[j] for j in rng.integers(0, 5000, 400)] for _ in range(500)]
    tracemalloc.start()
    toxicity._support(documents)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * 200_000  # sets of neighbours took 115 bytes a word
