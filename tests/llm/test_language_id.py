import math
from collections import Counter

import numpy as np

from conftest_llm import crc, documents
from rowsmith.llm import language_id
from rowsmith.llm.common import codepoints
from rowsmith.llm.language_id import ORDER, Model, build, hashes, identify, kneser_ney, learn, letters_only, op1_language_id

EN = "the quick brown fox jumps over the lazy dog while the other dogs watch from the hill and the river "
DE = "der schnelle braune fuchs springt über den faulen hund während die anderen hunde vom hügel und vom fluss zusehen "


def brute(texts):
    """Interpolated Kneser-Ney probability of a character after a history, by its definition."""
    top = Counter()
    for t in texts:
        c = letters_only(codepoints(t)).tobytes().decode("utf-32-le")
        top.update(c[i:i + ORDER] for i in range(len(c) - ORDER + 1))
    levels = [top]
    while len(levels) < ORDER:
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(levels[0]) + 1)
        c = levels[n - 1]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once else 0.5
        own = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        return max(c[gram] - d, 0) * (gram in c) / sum(own) + d * len(own) / sum(own) * p(gram[1:])
    return p


def test_model_matches_definition(spark):
    rows = spark.createDataFrame([(EN * 3, "en", False), (DE * 2, "de", False)], "text string, lang string, calibrate boolean")
    model = build(*kneser_ney(rows))
    assert model.languages == ["de", "en"]
    for text in (EN, DE, "the fox fliegt über xylophon"):
        c = letters_only(codepoints(text))
        h, n = model.cross_entropy(c)
        s = c.tobytes().decode("utf-32-le")
        for i, t in enumerate((DE * 2, EN * 3)):
            p = brute([t])
            known = Counter(letters_only(codepoints(t)).tobytes().decode("utf-32-le"))
            want = [-math.log(p(s[k:k + ORDER])) for k in range(n) if s[k + ORDER - 1] in known]
            if len(want) == n:  # a character that no text had gets a fixed floor instead
                assert abs(np.mean(want) - h[i]) < 1e-4


def test_keys_are_sorted_and_blocks_do_not_matter(spark):
    rows = spark.createDataFrame([(EN, "en", False), (DE, "de", False)], "text string, lang string, calibrate boolean")
    model = build(*kneser_ney(rows))
    assert all((np.diff(k.astype(object)) > 0).all() for k in model.keys)
    c = letters_only(codepoints((EN + DE) * 20))
    whole, n = model.cross_entropy(c)
    parts, m = model.cross_entropy(c, block=17)
    assert n == m and np.allclose(whole, parts)


def test_query_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_edges_and_rejection(spark):
    docs = documents(spark, [(i, EN[i:] + EN * 3) for i in range(40)], "en").unionByName(
        documents(spark, [(100 + i, DE[i:] + DE * 3) for i in range(40)], "de")).unionByName(documents(spark, [(300, EN)], None))
    model = learn(docs)
    texts = [None, "", "123 !? \U0001f600\n", "a", "Ä", "the dogs and the river", "der hund und der fluss", "щука бобёр мышь " * 30, EN * 5000]
    out = {r.doc_id: r for r in identify(documents(spark, texts), model).collect()}
    assert [out[i].lang_pred for i in range(3)] == ["und"] * 3 and out[0].score == 0
    assert out[3].lang_pred in ("en", "de") and out[4].lang_pred in ("en", "de")
    assert (out[5].lang_pred, out[6].lang_pred, out[8].lang_pred) == ("en", "de", "en")
    assert out[7].rejected and not out[8].rejected and out[8].score > 0.9
    assert identify(docs.limit(0), model).count() == 0
    nothing = learn(documents(spark, ["a b"], None))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}


def test_letters():
    fold = lambda t: letters_only(codepoints(t)).tobytes().decode("utf-32-le")
    assert fold("Ab-1 É\U0001f600\U00010400!") == "   ab é \U00010428 " and fold("?") == "    "


def test_hash_separates_orders():
    c = np.array([97, 97, 97], dtype=np.uint32)
    assert hashes(c, 1)[0] != hashes(c, 2)[0] and len(hashes(c, 2)) == 2
    assert isinstance(Model([], [], [], [], np.zeros(0)).predict("abc"), tuple)


def invented(rng, n):
    """A text of an invented language: words of its own letters."""
    letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèçñßøåæœğışčřžł", 9)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(30)]
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(n)]


def test_every_language_is_learned(spark, rng, monkeypatch):
    """250 languages, each of two rows, and one of a single row; with models in several groups as with one."""
    texts = {f"x{i:03d}": invented(rng, 3) for i in range(250)} | {"only": invented(rng, 2)}
    rows = [(i, t, x) for i, (x, t) in enumerate((x, t) for x, ts in texts.items() for t in ts[:-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = spark.createDataFrame([(i, texts[x][-1], x) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "GROUP_BYTES", 6 << 20)
    fitted = learn(docs)
    assert fitted.languages == sorted(texts) and len(fitted.groups) > 2
    out = {r.doc_id: r for r in identify(held, fitted).collect()}
    right = sum(out[i].lang_pred == x for i, x in enumerate(texts))
    assert len(out) == 251 and right >= 245 and out[250].lang_pred == "only"


def test_groups_give_what_one_model_gives(spark, monkeypatch):
    docs = documents(spark, [(i, EN[i:] + EN * 3) for i in range(70)], "en").unionByName(
        documents(spark, [(100 + i, DE[i:] + DE * 3) for i in range(70)], "de"))
    texts = documents(spark, [None, "", "the dogs", "der hund", EN, DE, "щука", (4, EN), (None, DE), "x " * 3000])
    one = learn(docs)
    monkeypatch.setattr(language_id, "GROUP_BYTES", 1)
    two = learn(docs)
    assert (len(one.groups), len(two.groups)) == (1, 2) and one.sharpness == two.sharpness
    assert np.allclose(one.limits, two.limits, atol=1e-5) and np.isfinite(one.limits).all()
    a, b = ([(r.doc_id, r.lang_pred, round(r.score, 4), r.rejected) for r in identify(texts, m).collect()] for m in (one, two))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == 10


def test_predictions_match_the_definition(spark, rng):
    """Every text's language is the one with the lowest cross-entropy by the definition's own probabilities."""
    texts = {x: invented(rng, 4) for x in ("aa", "bb", "cc")}
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)],
                                 "doc_id long, text string, lang string")
    fitted = learn(docs)
    models = {x: brute(ts) for x, ts in texts.items()}
    known = {x: Counter(letters_only(codepoints(" ".join(ts))).tobytes().decode("utf-32-le")) for x, ts in texts.items()}
    tried = [" ".join(rng.sample(" ".join(texts[x] + texts[y]).split(), 25)) for x in texts for y in texts]
    out = {r.doc_id: r.lang_pred for r in identify(documents(spark, tried), fitted).collect()}
    for i, t in enumerate(tried):
        s = letters_only(codepoints(t)).tobytes().decode("utf-32-le")
        h = {x: np.mean([-math.log(p(s[k:k + ORDER])) if s[k + ORDER - 1] in known[x] else math.log((len(known[x]) + 1) * 50.0)
                         for k in range(len(s) - ORDER + 1)]) for x, p in models.items()}
        first, second = sorted(h.values())[:2]
        assert second - first < 0.05 or out[i] == min(h, key=h.get), (t, h)
