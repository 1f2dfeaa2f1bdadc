"""Training-data operators against brute force on small tables."""

from __future__ import annotations

import random

import corpus_pipeline
from tessera.llm import html_text, language, repeats, simhash


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates_are_exactly_the_texts_of_similarity_08(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(9999)}" for _ in range(250)]
        texts.append(" ".join(words))
        for edits in (4, 5, 6, 7, 8):
            copy = list(words)
            for at in rng.sample(range(5, 245), edits):
                copy[at] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    sets = [_shingles(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (simhash.BLOCK_NODES, 2):
        monkeypatch.setattr(simhash, "BLOCK_NODES", block)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()}
        assert got == dict(enumerate(want))
    assert 60 < len(set(want)) < 360


def _without_runs(texts, n):
    """Brute force: the words that no run of n words met twice covers."""
    runs = {}
    for t in texts:
        words = t.split()
        for i in range(len(words) - n + 1):
            runs[tuple(words[i : i + n])] = runs.get(tuple(words[i : i + n]), 0) + 1
    out = []
    for t in texts:
        words = t.split()
        gone = {k for i in range(len(words) - n + 1) if runs[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}
        out.append([w for k, w in enumerate(words) if k not in gone])
    return out


def test_pipeline_cuts_every_repeated_run_of_more_than_50_words(spark):
    rng = random.Random(3)

    def some(n, size):
        return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=size)) for _ in range(n)]

    texts = []
    for n, size in [(50, 12), (51, 2), (51, 5), (52, 6), (64, 3), (90, 7), (51, 1)]:
        passage = some(n, size)
        for _ in range(3):
            texts.append(" ".join([*some(rng.randrange(60), 6), *passage, *some(rng.randrange(60), 6)]))
    texts += [" ".join(["na"] * 130), "", " ".join(some(51, 4)) + "\n end"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(99, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text.split() for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == dict(enumerate(_without_runs(texts, 51))) | {99: []}
    found = repeats.removed_repeats(docs.filter("doc_id BETWEEN 3 AND 5"))
    assert found.agg({"n_removed": "sum"}).first()[0] == 0


def test_every_declared_language_has_a_model(spark):
    names = [f"{a}{b}" for a in "abcdefg" for b in "tuvwxyz"][:45]
    rng = random.Random(9)
    words = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for n in names}
    rows = []
    for n in names:
        for _ in range(4 if n == names[-1] else 8):
            rows.append((len(rows), " ".join(rng.choices(words[n], k=60)), n, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found, model = language.text_model(docs, docs["text"], docs["lang"], docs["doc_id"])
    assert found == sorted(names)
    scored = docs.select("lang", language.text_scores(model)("text").alias("scores")).collect()
    assert all(len(r.scores) == 46 and found[r.scores.index(max(r.scores))] == r.lang for r in scored)


def test_ratios_decide_over_article_and_what_stands_outside_it():
    long = [f"The {w} story goes on, with clauses, and marks; it says much more than a teaser does, as stories do. " * 3 for w in ("first", "second", "third")]
    story = "".join(f"<p>{x}</p>" for x in long)
    want = [x.strip() for x in long]
    teasers = "".join(f"<article><h3>Teaser {k}</h3><span>Read on</span></article>" for k in range(4))
    page = f"<html><body><div class=story>{story}</div><div>{teasers}</div></body></html>"
    assert html_text.main_text(page).split("\n") == want
    links = "<ul>" + "".join(f"<li><a href=/{k}>Another page {k}</a></li>" for k in range(6)) + "</ul>"
    page = f"<html><body><article><h1>Title</h1>{story}<p>Short.</p>{links}</article><div>Imprint</div></body></html>"
    assert html_text.main_text(page).split("\n") == ["Title", *want, "Short."]
