import re

from bidstream.llm import licenses
from tests.llm.conftest import SCHEMA, collected


def scanned(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


EXTRA = [
    (1000, "GNU GENERAL\nPUBLIC--LICENSE gnu general public licenseX mit license, MIT License apache license" * 3, None, None, 0, None, None, None),
    (1001, "Licensed under the Apache License, Version 2.0.", None, None, 0, None, None, None),
    (1002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", None, None, 0, None, None, None),
    (1003, "cc\x00by ccéby CC_BY cc by-nc 4.0 licensed under CC BY-NC 4.0", None, None, 0, None, None, None),
    (1004, "the license of the public is general by the version", None, None, 0, None, None, None),
    (1005, "by " * 20000 + "cc by", None, None, 0, None, None, None),
    (1006, "GNU GENERAL PUBLIC L\u0130CENSE M\u0130T license apache \u212Aelvin wor\u212A \u00c9 LICENSE Apache\u00c9 License", None, None, 0, None, None, None),
]


def test_base_places_and_labels(spark, docs, rows, tmp_path):
    spark.createDataFrame(EXTRA, SCHEMA).unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.op5_licenses(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = sorted(((r[0], *scanned(r[1])) for r in [*rows, *EXTRA]), key=repr)
    assert collected(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in out.collect():
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_the_method_finds_templates(spark):
    out = {r["doc_id"]: r for r in licenses.find_licenses(spark.createDataFrame(EXTRA, SCHEMA)).collect()}
    assert out[1001]["method_labels"] == ["apache-2.0"]
    assert out[1002]["method_labels"] == ["mit"] and out[1002]["score"] > 0.99
    assert out[1003]["method_labels"] == ["cc-by-nc-4.0"]
    assert out[1004]["method_labels"] == [] and out[1004]["score"] < 0.6


def test_empty_table(no_docs):
    assert licenses.find_licenses(no_docs).count() == 0


def by_force(rows):
    """(doc_id, labels, score) by comparing each template with the words from every place on."""
    import math

    templates = licenses.TEMPLATES + licenses.TEXTS
    texts = [licenses.words_of(t) for t, *_ in templates]
    files = [(r[0], licenses.words_of(r[1] or "")) for r in rows]
    listed = {w for t in texts for w in t}
    df = {w: sum(w in set(words) for _, words in files) for w in listed}
    idf = {w: math.log((len(files) + 1) / (df[w] + 1)) + 1e-6 for w in listed}
    out = []
    for doc_id, words in files:
        labels, best = set(), 0.0
        for text, (_, key, label) in zip(texts, templates):
            rare, key = set(sorted(set(text), key=lambda w: (-idf[w], w))[:6]), licenses.words_of(key)
            at = next(i for i in range(len(text)) if text[i:i + len(key)] == key)
            for b in range(-len(text), len(words)):
                same = [i for i, w in enumerate(text) if 0 <= b + i < len(words) and words[b + i] == w]
                if sum(text[i] in rare for i in same) >= 2 and set(range(at, at + len(key))) <= set(same):
                    share = sum(idf[text[i]] for i in same) / sum(idf[w] for w in text)
                    best = max(best, share)
                    labels |= {label} if share >= 0.6 else set()
        base = any(p.split() == words[i:i + len(p.split())] for p, _ in licenses.BASE for i in range(len(words)))
        out.append((doc_id, sorted(labels), 1.0 if base else round(min(1.0, best), 6)))
    return sorted(out, key=repr)


def test_templates_against_brute_force(spark, rows):
    """Whole licence texts, as they are, cut, edited and inside of other text, among ordinary documents."""
    import random

    rng, files = random.Random(2), []
    for text, *_ in licenses.TEXTS:
        words = text.split()
        edited = [w if rng.random() > 0.1 else "changed" for w in words]
        files += [f"Copyright (c) 2026 X. {text}", " ".join(words[: len(words) // 2]), " ".join(edited), "some words " * 20 + text + " and more" * 9]
    files = [(2000 + i, t, None, None, 0, None, None, None) for i, t in enumerate(files)] + EXTRA[:5] + [r for r in rows if len(r[1] or "") < 5000]
    out = licenses.find_licenses(spark.createDataFrame(files, SCHEMA).repartition(3))
    got = sorted(((r["doc_id"], r["method_labels"], round(r["score"], 6)) for r in out.collect()), key=repr)
    assert got == by_force(files) and sum(bool(x[1]) for x in got) > 30
