"""Quality rules, license scan, language identification, toxicity, the pipeline and the queries."""

from __future__ import annotations

import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as registry
import corpus_pipeline
from stridelog.llm import language_id, license_scan, quality_rules, toxicity
from tests.conftest import SF_DIR

from .conftest import awkward, by_id, dicts, prose, table
from .test_dedup import brute_components

# --- quality rules


def brute_signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_signals_equal_brute_force(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in dicts(quality_rules.signals(docs)))
    assert got == sorted((str(i), *brute_signals(t)) for i, t in awkward())


def test_verdicts(llm, docs, empty):
    rows = dicts(quality_rules.quality(docs))
    assert len(rows) == len(awkward())
    for r in rows:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality"] >= 0.5)
    assert quality_rules.quality(empty).count() == 0
    noisy = " ".join(f"{w}###" for w in prose(1, 100).split())
    rows = by_id(quality_rules.quality(table(llm, [*((i, prose(i, 80)) for i in range(50)), (99, noisy)])))
    assert all(rows[i]["kept"] for i in range(50))
    assert rows[99]["quality"] < rows[0]["quality"]


def test_estimation_recovers_classes(llm):
    rng = np.random.default_rng(3)
    shares, names = (0.7, 0.15, 0.1, 0.05), ["a", "b", "c"]
    bad = np.array([[0.01, 0.02, 0.03], [0.9, 0.1, 0.1], [0.02, 0.8, 0.3], [0.1, 0.05, 0.95]])
    kind = rng.choice(4, 20_000, p=shares)
    votes = np.where(rng.random((len(kind), 3)) < bad[kind], -1, 1)
    votes[rng.random(votes.shape) < 0.2] = 0
    frame = llm.createDataFrame(votes.tolist(), "a int, b int, c int")
    model = quality_rules.estimate(frame, names, 60).first().model
    assert np.allclose(model.share, shares, atol=0.05) and abs(sum(model.share) - 1) < 1e-9
    assert np.allclose(np.array(model.bad).reshape(4, 3)[:, :].diagonal(-1), [0.9, 0.8, 0.95], atol=0.15)


def test_the_method_rejects_what_the_base_lets_pass(llm):
    """Against the labels of the generated documents, which the method does not see."""
    labels = {r["doc_id"]: r["quality"] for r in dicts(llm.read.parquet(f"{SF_DIR}/labels.parquet"))}
    rows = dicts(quality_rules.quality(llm.read.parquet(f"{SF_DIR}/documents.parquet")))
    passed = [r for r in rows if not r["base_failed"] and labels.get(r["doc_id"]) is not None]
    rejected = {q: [not r["kept"] for r in passed if labels[r["doc_id"]] == q] for q in (0, 1)}
    assert np.mean(rejected[0]) > 0.9 and np.mean(rejected[1]) < 0.02


# --- license scan


def brute_licenses(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        phrase = phrase.split()
        for k in range(len(words) - len(phrase) + 1):
            if words[k : k + len(phrase)] == phrase:
                starts.append(k)
                labels.add(label)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)),
    )


def test_licenses_equal_brute_force(llm, empty):
    rows = [
        *awkward(),
        (30, "mit license " * 500),
        (31, "general public license general public general public license apache-license"),
        (32, "MIT\nLicense mit licensed émit license"),
    ]
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = dicts(license_scan.license_scan(table(llm, rows)))
    assert sorted((str(r["doc_id"]), *map(str, (r[n] for n in names))) for r in got) == sorted(
        (str(i), *map(str, brute_licenses(t))) for i, t in rows
    )
    assert license_scan.license_scan(empty).count() == 0


def test_templates_with_words_missing_and_added(llm):
    text = (
        "Permission is hereby granted, free of any charge, to person obtaining a copy "
        "of this software and its associated documentation files"
    )
    rows = by_id(license_scan.license_scan(table(llm, [(1, text), (2, "permission is hereby granted")])))
    assert rows[1]["labels"] == "mit" and 0.6 < rows[1]["score"] < 1 and rows[1]["n_base"] == 0
    assert rows[2]["labels"] == "" and rows[2]["score"] == 0


def brute_template(words, template, k=license_scan.K):
    """The best cover of one template, by the definition, over single places."""
    template = template.split()
    grams = len(template) - k + 1
    hits = [
        (pos - at, at, pos)
        for pos in range(len(words) - k + 1)
        for at in range(grams)
        if words[pos : pos + k] == template[at : at + k]
    ]
    best, islands = 0.0, []
    for diagonal in sorted({d for d, _, _ in hits}):
        best = max(best, sum(d == diagonal for d, _, _ in hits) / grams)
        if islands and diagonal - islands[-1][-1] <= license_scan.DRIFT:
            islands[-1].append(diagonal)
        else:
            islands.append([diagonal])
    best = best if best >= license_scan.MIN_COVER else 0.0
    for island in islands:
        chain, before = [], -1
        for at in range(grams):
            places = [pos for d, a, pos in hits if a == at and d in island]
            if places:
                if min(places) > before:
                    chain.append(min(places))
                before = max(before, min(places))
        long = max(chain) - min(chain) + k > len(template) + len(template) // 4 + license_scan.DRIFT
        if len(chain) / grams >= license_scan.MIN_COVER and not long:
            best = max(best, len(chain) / grams)
    return best


def test_labels_and_scores_equal_brute_force(llm):
    rng = random.Random(8)
    texts = ["rights reserved all rights", "all rights reserved " * 40, "all rights and reserved rights"]
    for template in license_scan.TEMPLATES:
        for _ in range(6):
            words = template.split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choices(["x", "the", "license", "all"], k=rng.randrange(5))
            texts.append(" ".join([*rng.choices(["all", "y"], k=3), *words, *words[: rng.randrange(5)]]))
        texts.append(" ".join(reversed(template.split())))
        half = template.split()
        texts.append(" ".join([*half[len(half) // 2 :], *half[: len(half) // 2]]))
    rows = by_id(license_scan.license_scan(table(llm, list(enumerate(texts)))))
    for i, text in enumerate(texts):
        covers = {t: brute_template(text.split(), t) for t in license_scan.TEMPLATES}
        labels = {license_scan.TEMPLATES[t] for t, cover in covers.items() if cover}
        base = set(filter(None, brute_licenses(text)[4].split(",")))
        assert rows[i]["labels"] == ",".join(sorted(labels | base)), text
        assert abs(rows[i]["score"] - max([*covers.values(), float(bool(base))])) < 1e-12, text
    assert rows[0]["labels"] == "" and rows[1]["labels"] == "all-rights-reserved"


def test_a_template_longer_than_one_block(llm):
    template = prose(21, 200, 10**6)
    words = template.split()
    changed = [*words[:70], "a", "b", *words[70:130], *words[132:]]
    texts = [template, " ".join(changed), " ".join(words[100:] + words[:100]), " ".join(words[:130])]
    found = license_scan.spans(table(llm, list(enumerate(texts))), templates={template: "own"})
    spans = {(r["doc_id"], r["first"], r["last"]): r["cover"] for r in dicts(found)}
    assert spans[0, 0, 198] == 1 and set(i for i, _, _ in spans) == {0, 1}
    assert max(c for (i, _, _), c in spans.items() if i == 1) == brute_template(changed, template)


# --- language identification


def test_language_accuracy_on_held_out_rows(llm):
    docs = llm.read.parquet(f"{SF_DIR}/documents.parquet")
    got = language_id.identify_language(docs, language_id.learn_dictionaries(docs))
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in dicts(got) if r["held_out"] and r["lang_pred"] != "und"]
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in held]
    assert len(held) > 150 and np.mean(right) > 0.95
    sure = [ok for ok, r in zip(right, held) if r["accepted"]]
    assert np.mean(sure) >= np.mean(right)


def test_language_of_awkward_texts(docs, empty):
    models = {"aa": b"alpha beta gamma delta " * 50, "bb": b"uno due tre quattro " * 50}
    rows = dicts(language_id.identify_language(docs, models))
    assert len(rows) == len(awkward())
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "und")
    found = by_id(language_id.identify_language(docs, models))
    assert all(found[i]["lang_pred"] == "und" for i in (6, 7, 8))
    assert all(r["lang_pred"] == "und" for r in dicts(language_id.identify_language(docs, {})))
    assert language_id.learn_dictionaries(empty) == {} == language_id.learn_dictionaries(docs)
    assert language_id.identify_language(empty, models).count() == 0
    lang, score, accepted = language_id.classify("x", tuple(sorted(models.items())))
    assert (lang, accepted) == ("aa", False) and score == 0.5  # a tie is narrow


# --- toxicity


def labelled(llm, n=600):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = prose(i, 60)
        if toxic:
            text += " " + " ".join(rng.choice(["vilea", "vileb", "vilec", "crude"], 2))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return table(llm, rows), llm.createDataFrame(labels, "doc_id bigint, toxic int"), rows


def test_toxic_rows_are_found_and_clean_ones_left(llm):
    docs, labels, rows = labelled(llm)
    model = toxicity.learn(docs, labels)
    got = by_id(toxicity.score_toxicity(docs, model))
    wrong = [i for i, _ in rows if got[i]["predicted"] != (i % 5 == 0)]
    assert len(wrong) <= 3
    unseen = toxicity.Model(model.weights, model.bias).score(prose(1, 50) + " viled vilee crude")
    assert unseen >= 0.3  # endings that the sample does not have
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in dicts(kept)} == {i for i in got if not got[i]["predicted"]}


def test_risk_does_not_turn_negative():
    rng = np.random.default_rng(0)
    positive = [np.array([0, *rng.integers(2, 50, 3)]) for _ in range(100)]
    unlabelled = [rng.integers(2, 50, 4) for _ in range(900)] + positive[:100]
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 50, 0.1)
    score = lambda r: 1 / (1 + np.exp(-(bias + weights[r].sum())))
    assert np.mean([score(r) for r in positive]) > 0.8
    assert np.mean([score(r) for r in unlabelled[:900]]) < 0.2


def test_toxicity_of_awkward_input(llm, docs, empty):
    no_labels = llm.createDataFrame([], "doc_id bigint, toxic int")
    odd = llm.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (9, 1)], "doc_id bigint, toxic int")
    for labels in (no_labels, odd):
        rows = dicts(toxicity.score_toxicity(docs, toxicity.learn(docs, labels)))
        assert len(rows) == len(awkward())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.score_toxicity(empty, toxicity.learn(empty, odd)).count() == 0
    assert toxicity.drop_toxic(empty, odd).count() == 0


# --- pipeline and registered queries


def test_pipeline_on_awkward_documents(llm, docs, tmp_path):
    llm.createDataFrame([(1, 0), (9, 0)], "doc_id bigint, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(llm, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = sorted({r["doc_id"] for r in dicts(kept) if r["doc_id"] is not None})
    assert {9, 11, 12, 13, 14, 15, 16, 17, 19, 20} <= set(ids)
    assert not set(ids) & {18} and len(set(ids) & {1, 2, 3, 4, 5}) == 1
    packed = dicts(corpus_pipeline.run(llm, str(tmp_path)))
    assert sorted({r["doc_id"] for r in packed if r["doc_id"] is not None}) == ids


def brute_pipeline(rows, toxic, size=4096):
    """Rows (doc_id, piece, start, length, ids_crc32), and the filled lengths of the sequences."""
    rows = [(i, t) for i, t in rows if i not in toxic]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(t.split()), []).append((-len(t), i, t))
    rows = [(i, t) for _, i, t in map(min, groups.values())]
    rows = [(int(i), dict(rows)[int(i)]) for i, _, c in brute_components(rows, 5) if i == c]
    first = {}
    windows = {i: [tuple(w[k : k + 13]) for k in range(len(w) - 12)] for i, t in rows for w in [t.split()]}
    for i, found in windows.items():
        for window in found:
            first[window] = min(first.get(window, i), i)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        gone = {k + j for k, w in enumerate(windows[i]) if first[w] < i for j in range(13)}
        kept = " ".join(w for k, w in enumerate(t.split()) if k not in gone)
        ids = np.array([*tokenizer.encode(kept, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            out.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    filled = []
    for length in sorted((r[3] for r in out), reverse=True):
        at = max((k for k, n in enumerate(filled) if n + length <= size), key=filled.__getitem__, default=None)
        if at is None:
            filled.append(length)
        else:
            filled[at] += length
    return sorted(out), sorted(filled)


def test_pipeline_equals_brute_force(llm, tmp_path):
    _, labels, rows = labelled(llm)
    toxic = {i for i, _ in rows if i % 5 == 0}
    for i in range(20):
        words = prose(5000 + i, 80).split()
        passage = prose(6000 + i, 20)
        near = [*words[:40], "changed", *words[41:]]
        rows += [
            (1000 + i, " ".join(words)),
            (1100 + i, "\n ".join(words)),  # copy but for white space, longer
            (1200 + i, " ".join(near)),
            (1300 + i, prose(7000 + i, 30) + " " + passage + " " + prose(7100 + i, 30)),
            (1400 + i, prose(7200 + i, 40) + " " + passage),
            (1500 + i, passage),  # nothing is left of it
        ]
    rows.append((1600, prose(8000, 5000)))  # more than a sequence
    table(llm, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    expected, filled = brute_pipeline(rows, toxic)
    packed = corpus_pipeline.run(llm, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.columns == columns
    got = [tuple(r[c] for c in columns) for r in dicts(packed)]
    assert sorted(r[:5] for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert sorted(sequences) == list(range(len(filled)))
    assert sorted(sum(n for _, n in pieces) for pieces in sequences.values()) == filled


NAMES = [n for n in registry.queries() if re.match(r"op\d+_|pipeline", n)]


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.oracle_sql()])
def test_query_equals_sql(llm, name):
    df = registry.queries()[name](llm, SF_DIR)
    connection = duckdb.connect()
    for table_name in ("documents", "labels"):
        path = Path(SF_DIR) / f"{table_name}.parquet"
        connection.execute(f"CREATE VIEW {table_name} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, result.fetchall())) == sorted(
        str(tuple(r[c] for c in columns)) for r in dicts(df)
    )


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_license_scan"])
def test_native_plans_have_no_python(llm, name):
    plan = registry.queries()[name](llm, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
