import zlib
from functools import partial

import numpy as np
import pytest

from dictspark.llm import langid
from tests.llm.helpers import clashing, docs, rng

SYLLABLES = {"aa": "ka mo ri tu ne", "bb": "sch ung ein ter ver", "cc": "ção nho lhe que dos"}


def text(r, lang, n):
    own = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(own) for _ in range(r.randint(1, 4))) for _ in range(n))


def labelled(spark, r, n=150):
    langs = [r.choice(sorted(SYLLABLES)) for _ in range(n)]
    return docs(spark, [text(r, x, r.randint(3, 60)) for x in langs], lang=lambda i: langs[i]), langs


def test_automaton_spells_substrings():
    r = rng(3)
    for _ in range(30):
        s = [r.randrange(3) for _ in range(r.randint(0, 40))]
        step = langid.suffix_automaton(s, 3)
        inside = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)} | {()}
        for _ in range(100):
            q, state = [r.randrange(3) for _ in range(r.randint(0, 6))], 0
            for c in q:
                state = step[state, c] if state >= 0 else -1
            assert (state >= 0) == (tuple(q) in inside)


@pytest.mark.parametrize("segment, stragglers, dense", [(langid.SEGMENT, langid._STRAGGLERS, langid.DENSE_BYTES), (7, 0, 0), (7, 3, 20_000), (7, 10**6, langid.DENSE_BYTES)])
def test_batched_parsing_is_the_plain_one(monkeypatch, segment, stragglers, dense):
    """The cuts of long texts show nowhere, also where matches run over several of them."""
    for name, value in (("SEGMENT", segment), ("_STRAGGLERS", stragglers), ("DENSE_BYTES", dense)):
        monkeypatch.setattr(langid, name, value)
    r = rng(4)
    model = langid.Model({k: [text(r, k, 40)] for k in SYLLABLES})
    texts = [text(r, r.choice(sorted(SYLLABLES)), r.randint(1, 400)) for _ in range(25)] + ["x", "!!", "é", "é" * 30, "éka" * 9]
    own = text(rng(4), "aa", 40)
    texts += [own, own[3:] + own, "é" + own * 3]
    coded = [model.coded(t) for t in texts]
    plain = [[langid.phrases_of(c.tolist(), s) for s in model.steps] for c in coded]
    assert np.array_equal(model.phrases(coded), np.array(plain))


def test_longest_matches():
    """Phrases are the greedy longest matches: each is a substring of the sample and could not be longer."""
    r = rng(5)
    for _ in range(50):
        sample, s = ([r.randrange(3) for _ in range(n)] for n in (20, 30))
        step, n, i = langid.suffix_automaton(sample, 4), 0, 0
        joined = ",".join(map(str, sample)) + ","
        while i < len(s):
            j = i + 1
            while j < len(s) and ",".join(map(str, s[i : j + 1])) + "," in joined:
                j += 1
            n, i = n + 1, j
        assert langid.phrases_of(s, step) == n


def test_held_out_accuracy(spark):
    r = rng(6)
    d, langs = labelled(spark, r, 300)
    rows = langid.identify(clashing(d)).collect()
    assert len(rows) == 300
    out = [x for x in rows if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in rows)
    assert sum(x["lang_pred"] == langs[x["doc_id"]] for x in out) >= 0.97 * len(out)
    assert all(0 <= x["score"] <= 1 for x in rows)


def plain_identify(given, pieces=192, size=256):
    """(doc_id, held_out, lang, score, bits) by the definitions: pieces by MD5, greedy longest matches in the plain strings."""
    import hashlib
    from math import log2

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    cuts = {}
    for i, t, lang in given:
        if lang is not None and t and not held(i):
            cuts.setdefault(lang, []).extend((hashlib.md5(t[k : k + size].encode()).hexdigest(), t[k : k + size]) for k in range(0, len(t), size))
    plain = lambda t: "".join(c if c.isalpha() else " " for c in t.lower())
    samples = {k: plain("\n".join(x for _, x in sorted(v)[:pieces])) for k, v in cuts.items()}
    out = []
    for i, t, _ in given:
        if not t or not any(c.isalpha() for c in t) or not samples:
            out.append((i, held(i), "und", 0.0, None))
            continue
        s, rates = plain(t), []
        for lang in sorted(samples):
            n, at = 0, 0
            while at < len(s):
                end = at + 1
                while end < len(s) and s[at : end + 1] in samples[lang]:
                    end += 1
                n, at = n + 1, end
            rates.append((n * log2(max(2, len(samples[lang]))) / len(s), lang))
        low, second = min(rates), sorted(x for x, _ in rates)[1:2]
        out.append((i, held(i), low[1], min(max(1 - low[0] / second[0], 0), 1) if second else 1.0, low[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pieces", [192, 3])
def test_identify_against_the_plain_form(spark, monkeypatch, pieces):
    r = rng(12)
    d, _ = labelled(spark, r, 60)
    given = [(x["doc_id"], x["text"], x["lang"]) for x in d.collect()]
    given += [(500, None, "aa"), (501, "1 2", "bb"), (502, "ÀÉ漢 nho lhe", None), (None, "Ka Mo\nri.", "aa"), (503, text(r, "cc", 900), "cc"), (503, text(r, "cc", 9), "cc"), (504, "ein", "bb"), (504, "ein", "bb")]
    table = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in given], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(langid, "training_sample", partial(langid.training_sample, pieces_per_lang=pieces))
    got = sorted((tuple(x) for x in langid.identify(table.repartition(3)).collect()), key=repr)
    want = plain_identify(given, pieces)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(a[4] == b[4] and abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_texts_in_no_learned_language_go_and_labels_are_filled(spark):
    r = rng(13)
    d, langs = labelled(spark, r, 90)
    odd = docs(spark, [(900, "漢字" * 60), (901, "".join(r.choice("qwxzjkpyvfb") for _ in range(400))), (902, "漢字"), (903, text(r, "bb", 30)), (904, "x")], lang=lambda i: None)
    got = {x["doc_id"]: x["lang"] for x in langid.keep_languages(d.union(odd)).collect()}
    assert set(got) == {*range(90), 902, 903, 904} and got[903] == "bb" and all(got[i] == langs[i] for i in range(90)) and got[904] is not None


def test_the_held_out_labels_are_not_seen(spark):
    r = rng(7)
    d, langs = labelled(spark, r, 120)
    hidden = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(x["doc_id"], x["text"], "zz" if x["doc_id"] in hidden else x["lang"], "s", 1) for x in d.collect()]
    other = spark.createDataFrame(rows, d.schema)
    assert sorted(map(tuple, langid.identify(d).collect())) == sorted(map(tuple, langid.identify(other).collect()))


def test_edge_cases(spark):
    r = rng(8)
    d, langs = labelled(spark, r, 60)
    odd = docs(spark, [(1000, None), (1001, ""), (1002, "123 !? \n x² "[:8] + "²_½"), (1003, text(r, "bb", 30_000)), (None, text(r, "aa", 20)), (1004, "que dos nho lhe"), (1004, "que dos nho lhe")], lang=lambda i: None)
    rows = {(x["doc_id"]): x for x in langid.identify(d.union(odd)).collect()}
    assert [rows[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and rows[1000]["score"] == 0
    assert rows[1003]["lang_pred"] == "bb" and rows[None]["lang_pred"] == "aa"
    assert len(langid.identify(d.union(odd)).collect()) == 67
    assert langid.identify(docs(spark, [])).collect() == []
    assert {x["lang_pred"] for x in langid.identify(docs(spark, ["ka mo"], lang=lambda i: None)).collect()} == {"und"}
    left = langid.keep_languages(clashing(d.union(odd)))
    assert left.columns == clashing(d).columns and left.count() == 64


def test_languages_of_one_large_script_are_told_apart(monkeypatch):
    """Two languages in ideographs that differ in their letters only, beside two whose letters are more frequent and many: every letter counts."""
    r = rng(9)
    letters = {"aa": [chr(0x61 + i) for i in range(26)], "bb": [chr(0x430 + i) for i in range(32)] + [chr(0x561 + i) for i in range(30)], "cc": [chr(0x4E00 + i) for i in range(600)], "dd": [chr(0x5E00 + i) for i in range(600)]}
    write = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(4)) for _ in range(n))
    samples = {k: [write(k, 2_000 if k < "cc" else 600)] for k in letters}
    texts = [(k, write(k, 30)) for k in letters for _ in range(10)]
    model = langid.Model(samples)
    out = model.predict([t for _, t in texts])
    assert out[0] == [k for k, _ in texts]
    monkeypatch.setattr(langid, "DENSE_BYTES", 0)  # the same without any dense table
    assert langid.Model(samples).predict([t for _, t in texts]) == out


def test_samples_do_not_shrink_with_the_number_of_languages():
    r = rng(10)
    own = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(60)]
    model = langid.Model({f"l{i:02}": [" ".join(r.sample(own, 60)) for _ in range(24)] for i in range(60)})
    assert all(2**b >= 24 * 500 for b in model.bits)


def test_documents_stay_if_nothing_was_learned(spark):
    d = docs(spark, ["ka mo", "123 !?", None, "", "漢字", "x"], lang=lambda i: None)
    assert {x["doc_id"] for x in langid.keep_languages(d).collect()} == {0, 4, 5}
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert langid.keep_languages(docs(spark, [(i, "ka mo") for i in held])).count() == len(held)


def test_building_leaves_no_more_than_the_model(monkeypatch):
    """What was freed in building is given back once for each model, not for each batch of texts."""
    given = []
    monkeypatch.setattr(langid, "give_back", lambda: given.append(list(langid._MODELS)), raising=False)
    monkeypatch.setattr(langid, "_MODELS", {})
    model = langid._model(1, {"en": ["the"], "de": ["der"]})
    assert langid._model(1, {}) is model and given == [[1]]
    langid._model(2, {"en": ["the"]})
    assert given == [[1], [2]]
