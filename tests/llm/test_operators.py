"""Literal cases, brute force and edge cases of the corpus operators."""

import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from finloom.llm import decontaminate, jaccard, pieces, pii, pseudo_likelihood, quality, secrets, topk, warc, wordpieces
from finloom.llm import queries as corpus_queries

SCHEMA = "doc_id long, text string, lang string, spans string, score string"
LONG = "wide word list " * 4000
BASE = [f"w{i}" for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    near = list(BASE)
    near[60] = "changed"
    rows = [(1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join(near)), (4, None), (5, ""), (6, "Two words"), (6, "Two words"), (7, LONG),
            (None, "no id here"), (8, "mail a.b@c.de, 10.0.0.1, 4111 1111 1111 1111, +49 (30) 123-4567 é x@y.z")]
    return spark.createDataFrame([(i, t, None, "mine", "mine") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def test_top_k_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0]), (502, [1.0, float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()]
    want = []
    for q, v in rows[:200:50]:
        scored = sorted((-int(1024 * 1024 * np.dot(v, w)), i) for i, w in rows[:200] if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("1 = 0"), F.lit(True)).count() == 0


def test_jaccard_classes(docs, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, percent=90).collect()}
    assert got == {(1, 118, 1), (2, 118, 1), (3, 118, 1), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 3, 7), (8, got_n(docs, 8), 8)}
    assert jaccard.jaccard_classes(empty).count() == 0


def got_n(docs, i):
    words = docs.where(F.col("doc_id") == i).first().text.split()
    return len({tuple(words[k : k + 3]) for k in range(len(words) - 2)})


def test_one_of_each_keeps_different_texts(spark):
    rows = [(1, "one text of some seven words here"), (1, "a wholly other text that shares the id"), (1, "one text of some seven words here"),
            (None, "no id"), (None, "no id"), (None, None)]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, {*rows}))


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_meet_for_every_pair_in_reach(percent):
    bands, rng = jaccard.Bands(percent), np.random.default_rng(3)
    with np.errstate(over="ignore"):
        for size in (2, 9, 10, 19, 40, 150, 700):
            for _ in range(20):
                base = rng.integers(0, 2**63, size).astype(np.uint64)
                other = base.copy()
                other[: max(1, int(size * (100 - percent) / (100 + percent)))] += np.uint64(1)
                both = len(np.intersect1d(base, other))
                if 100 * both < percent * (2 * size - both):
                    continue
                keys = [set(np.concatenate([jaccard._keys(s, x, bands) for x in (bands.of(size) - 1, bands.of(size)) if x >= 0]).tolist()) for s in (base, other)]
                assert keys[0] & keys[1]


def test_warc_round_trip(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "v", None), (4, "w", "é" * 400000), (5, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(warc.mark_revisits(df))).collect()}
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 3, 2, 5)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 2)]
    assert got[4].payload.decode() == "é" * 400000 and got[3].payload_bytes == 4 and all(r.digest_ok for r in got.values())
    cut = warc.write_archives(warc.mark_revisits(df)).withColumn("content", F.expr("substring(content, 1, 100)"))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(cut).collect()
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(df.where("1 = 0")))).count() == 0


def test_pii_spans(docs, empty):
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    text = got[8].text
    assert [(s.kind, text[s.start : s.end]) for s in got[8].spans] == [
        ("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567"), ("email", "x@y.z")]
    assert got[4].spans == got[5].spans == [] and got[4].score == "mine"
    assert pii.sanitise(pii.find_pii(docs)).where("doc_id = 8").first().text == "mail [email], [ip], [card], [phone] é [email]"
    assert pii.find_pii(empty).count() == 0


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"write to jo@x.org Smithson now {i}") for i in range(4)] + [(i, f"now nothing to see {i}") for i in range(10, 40)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {s.kind: r.text[s.start : s.end] for r in found.where("doc_id < 4").collect() for s in r.spans}
    assert spans == {"email": "jo@x.org", "term": "Smithson"}


def _terms(spark, texts):
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "text", "spans").collect()
    return {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"] for r in found}


COMMON = [f"now nothing at to see write {i % 7}" for i in range(60)]


def test_pii_terms_of_rare_entities(spark):
    got = _terms(spark, ["write at jo@x.org Smithson now", *[f"{t} {i}a" for i, t in enumerate(COMMON)]])
    assert got[0] == ["Smithson"]


def test_pii_terms_of_copies(spark):
    texts = [f"write to jo@x.org Smithson now {i % 7}" for i in range(3)] + [f"{t} x{i}" for i, t in enumerate(COMMON)]
    few, many = _terms(spark, texts), _terms(spark, texts + [texts[0]] * 400)
    assert "Smithson" in few[0] and all(few[i] == many[i] for i in few) and all(many[i] == few[0] for i in range(len(texts), len(many)))


def test_pii_terms_anywhere_in_the_text(spark):
    far = " ".join(COMMON[:7]) + " é"
    texts = [f"Smithson, now write {far} at jo@x.org {far} Smithsons! <jo@x.org>"] + [f"{t} é x{i}" for i, t in enumerate(COMMON)]
    assert _terms(spark, texts)[0] == ["Smithson,", "Smithsons!"]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(BASE[30:60])), (2, "never seen words of an item that is nowhere at all"), (3, None)], "item_id long, text string")
    got = {r.doc_id: r.leaked_items for r in decontaminate.leaks(docs, items).collect()}
    assert got[1] == got[2] == got[3] == [1] and got[4] == got[7] == got[8] == []
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate._common(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])) == 2


def test_decontamination_finds_short_items_in_other_words(spark):
    item = " ".join(BASE[40:56])
    changed = " ".join(["other", *BASE[41:47], "more", *BASE[48:56]])
    around = [f"frame{i % 3}" for i in range(60)]
    texts = {1: [*around, item, *around], 2: [*around, changed, *around], 3: around * 9, 4: [*BASE[40:47], *around * 9, *BASE[47:56]], 5: [item]}
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, " ".join(f"far{i}" for i in range(59)))], "item_id long, text string")
    got = {r.doc_id: r.leaked_items for r in decontaminate.leaks(frame, items).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [], 5: [1]}


def test_factorisation_machine(docs, empty):
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.1, rng.normal(size=30), rng.normal(size=(30, 4)))
    place, value = np.array([1, 4, 9]), np.array([0.5, 2.0, 1.0])
    pairs = sum(machine.factors[a] @ machine.factors[b] * x * y for k, (a, x) in enumerate(zip(place, value)) for b, y in list(zip(place, value))[k + 1 :])
    assert machine.raw(place, value) == pytest.approx(0.1 + machine.linear[place] @ value + pairs)
    trained = quality.train(quality.examples(["good plain words here"] * 20 + ["BAD!! ### | TEXT!!"] * 20), [1] * 20 + [0] * 20)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, trained).collect())
    assert quality.score(empty, trained).count() == 0
    assert quality.train([], []).score(place, value) == pytest.approx(0.5)


def test_longest_match_counts(docs, empty):
    vocabulary = ["a", "ab", "abcd", "b", "c", "d", "bc", "cdx", "d</w>", "x</w>", "c</w>", "</w>"]
    counter, known = wordpieces.Counter(vocabulary), {tuple(wordpieces.Counter.symbols(p)) for p in vocabulary}

    def greedy(symbols):
        n = at = 0
        while at < len(symbols):
            ends = [e for e in range(at + 1, len(symbols) + 1) if tuple(symbols[at:e]) in known]
            if not ends:
                return n if symbols[at:] == ["</w>"] else 1  # the last piece need not hold the end mark
            n, at = n + 1, ends[-1]
        return n

    rng = np.random.default_rng(2)
    for _ in range(2000):
        word = [*rng.choice(list("abcdx"), rng.integers(1, 9)), "</w>"]
        assert counter.count_symbols(word) == greedy(word), word
    got = {r.doc_id: r.n_tokens for r in wordpieces.count_pieces(docs).collect()}
    assert got[4] == got[5] == 0 and got[6] == 2
    assert wordpieces.count_pieces(empty).count() == 0


def test_pseudo_likelihood(docs, empty):
    fresh = pseudo_likelihood.fresh()
    learnt = pseudo_likelihood.train(docs, rounds=2)
    before, after = (pseudo_likelihood.score(docs, p).agg(F.sum("log_likelihood")).first()[0] for p in (fresh, learnt))
    assert after > before
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, learnt).collect()}
    assert got[4].n_words == 0 and got[4].per_word is None and got[7].n_words == 12000
    assert np.array_equal(pseudo_likelihood.train(empty), fresh)


def test_pseudo_likelihood_tells_words_of_a_bucket_apart(spark):
    corpus = spark.createDataFrame([(i, "the cat sat on the mat and " + " ".join(f"k{j}" for j in range(i, i + 9))) for i in range(60)], "doc_id long, text string")
    model = pseudo_likelihood.train(corpus, rounds=1)
    assert model.words.count() == 6 + 68 and model.words.agg(F.sum("n_word")).first()[0] == 60 * 16
    bucket = lambda w: int(pseudo_likelihood._classes(next(pseudo_likelihood.word_chunks(pseudo_likelihood.pa.array([w]))).hashes)[0])
    twin = next(f"zq{i}" for i in range(10**5) if bucket(f"zq{i}") == bucket("the"))
    asked = spark.createDataFrame([("the",), (twin,), (twin * 40,), (f"{twin} the",), ("the",)], "text string")
    rows = pseudo_likelihood.score(asked, model).collect()
    got = {r.text: r.log_likelihood for r in rows}
    assert len(rows) == 5 and got["the"] > got[twin] + 3 and got[twin] > got[twin * 40] > -np.inf
    assert {r.n_words for r in rows if r.text == f"{twin} the"} == {2}


def test_n_best_segmentations(docs, empty):
    lattice = pieces.Lattice.of(pieces.MODEL)

    def all_scores(word):
        arcs = lattice._arcs(word)
        scores = [[0.0]] + [[] for _ in word]
        for end in range(1, len(word) + 1):
            scores[end] = [s + score for begin, _, score in arcs[end] for s in scores[begin]]
        return sorted(scores[-1], reverse=True)

    for word in ("▁the", "▁tion", "▁naïve", "▁a𝄞"):
        assert [s for s, _ in lattice.word(word, 6)] == all_scores(word)[:6]
    both = sorted((a + b for a in all_scores("▁the") for b in all_scores("▁tion")), reverse=True)
    assert [s for s, _ in lattice.encode("the tion", 5)] == both[:5]
    rows = pieces.encode(docs).collect()
    assert all(r.round_trip for r in rows) and next(r for r in rows if r.doc_id == 5).piece_ids == []
    assert pieces.encode(empty).count() == 0


def test_secrets_equal_the_patterns(docs, empty, spark):
    text = "é Password: 'abcdef12' AKIA" + "Q" * 20 + " token=short " + "0123456789abcdef" * 3 + " 0123abc"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    want = [(m.start(), m.end()) for p in (r"Password: 'abcdef12", r"AKIAQ+", r"(0123456789abcdef){3}") for m in re.finditer(p, text)]
    assert [(s.start, s.end) for s in got[1].spans] == want and got[2].spans == []
    assert secrets.mask(secrets.find_secrets(df)).where("doc_id = 1").first().text == "é [assign]' [access] token=short [hex] 0123abc"
    assert secrets.find_secrets(empty).count() == 0 and secrets.find_secrets(docs).count() == docs.count()


def test_pieces_of_hostile_texts(spark):
    lattice = pieces.Lattice.of(pieces.MODEL)
    long_word = "a" * 100_000
    texts = [long_word, "x" + " " * 5000 + "y", "1234\n\n\t56", "▁mark", "", " ", "the" * 300, "né 𝄞" * 40]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] * 2, "doc_id long, text string, _coded string")
    rows = pieces.encode(df, n=3).collect()
    assert len(rows) == 2 * len(texts) and all(r._coded == "mine" and r.round_trip == ("▁" not in r.text) for r in rows)
    assert all(a.piece_ids == b.piece_ids and a.scores == b.scores for a in rows for b in rows if a.doc_id == b.doc_id)
    for r in rows:
        best = lattice.encode(r.text, 3)
        assert best[0][1] == r.piece_ids and [s for s, _ in best] == r.scores == sorted(r.scores, reverse=True)
        assert len({tuple(ids) for _, ids in best}) == len(best) and len({lattice.decode(ids) for _, ids in best}) == 1
    # ties: of equal scores, the smaller ids from the end
    word = "▁thethe"
    arcs = lattice._arcs(word)
    paths = {0: [(0.0, ())]}
    for end in range(1, len(word) + 1):
        paths[end] = [(s + score, ids + piece) for begin, piece, score in arcs[end] for s, ids in paths[begin]]
    assert lattice.word(word, 1)[0] == min(paths[len(word)], key=lambda p: (-p[0], p[1][::-1]))
    assert [s for s, _ in lattice.word(word, 40)] == sorted((s for s, _ in paths[len(word)]), reverse=True)[:40]


def test_pieces_do_not_depend_on_words_seen_before(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 7)
    small, whole = pieces.Lattice(pieces.MODEL), pieces.Lattice.of(pieces.MODEL)
    text = " ".join(f"w{i % 9} the {'ab' * (i % 5)}" for i in range(200))
    assert small.encode(text, 2) == whole.encode(text, 2) == small.encode(text, 2)
    assert len(small._caches[2]) <= 7


def test_pieces_of_a_text_are_those_of_the_whole_lattice():
    lattice = pieces.Lattice.of(pieces.MODEL)
    rng = np.random.default_rng(5)
    letters = list("aethn é1ï.,***\"'(=\n\t ЖЗи据数取获一个ال─═ß▁𝄞  ")
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(1, 25)))
        whole = lattice.word("▁" + text.replace(" ", "▁"), 3)
        assert [s for s, _ in lattice.encode(text, 3)] == [s for s, _ in whole], text
        assert tuple(lattice.encode(text, 1)[0][1]) == whole[0][1], text


def test_the_piece_queries_give_the_ten_best(spark):
    lattice = pieces.Lattice.of(pieces.MODEL)
    texts = ["a", "the tion naïve", "data pipelines", "x 𝄞 y"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for rows in (pieces.encode(docs).collect(), corpus_pipeline.encode_pieces(spark, docs, "").collect()):
        for r in rows:
            best = lattice.word("▁" + texts[r.doc_id].replace(" ", "▁"), 10)
            assert r.scores == pytest.approx([s for s, _ in best]) and tuple(r.piece_ids) == best[0][1]
        assert max(len(r.scores) for r in rows) == 10
    rows = corpus_queries.QUERIES["op9_sentencepiece"](spark, "/root/testdata/sf0.001").where("n_pieces >= 60").collect()
    assert rows and all(len(r.scores) == 10 and r.scores == sorted(r.scores, reverse=True) and r.scores[:2] == [r.score, r.second_score] for r in rows)


def test_the_first_segmentation_and_what_the_second_loses():
    lattice = pieces.Lattice.of(pieces.MODEL)
    for word in ("▁the", "▁thethe", "▁naïve", "▁a𝄞", "▁" + "ab" * 30, "▁", "…"):
        two = lattice.word(word, 2)
        score, ids, loss = lattice.first(word)
        assert (score, np.frombuffer(ids, np.int32).tolist()) == (two[0][0], list(two[0][1]))
        assert loss == (pytest.approx(two[0][0] - two[1][0]) if len(two) > 1 else pieces.NEVER)


def test_pseudo_likelihood_equals_the_formula_with_and_without_frequent_words(spark, monkeypatch):
    texts = ["the cat sat on the mat"] * 3 + [f"the k{i} cat and k{i % 7} zq zq" for i in range(40)] + ["", None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pseudo_likelihood.train(corpus, rounds=1)
    words = {r.word: r.n_word for r in model.words.collect()}
    classes = {r["class"]: r for r in model.classes.collect()}
    embedding, out, bias = pseudo_likelihood._parts(model.network)

    def brute(text):
        total = 0.0
        for chunk in pseudo_likelihood.word_chunks(pseudo_likelihood.pa.array([text or ""])):
            if not len(chunk.hashes):
                continue
            tokens, context, _ = pseudo_likelihood._tokens(chunk)
            for i, word in enumerate((text or "").split()):
                logits = np.tanh(sum(embedding[j, context[j, i]] for j in range(len(context)))) @ out + bias[0]
                spelled = np.exp(sum(model.spelling[a, b] for a, b in zip(b" " + word.encode(), word.encode() + b" ")))
                own, n = classes[tokens[i]], words[chunk.hashes.view(np.int64)[i]]
                total += logits[tokens[i]] - np.log(np.exp(logits).sum()) + np.log((n + own.n_distinct * spelled) / (own.n_class + own.n_distinct))
        return total

    for most in (1 << 18, 5, 0):
        monkeypatch.setattr(pseudo_likelihood, "FREQUENT", most)
        assert len(pseudo_likelihood._frequent(model.words)[0]) <= most
        for r in pseudo_likelihood.score(corpus, model).collect():
            assert r.n_words == len((r.text or "").split()) and r.log_likelihood == pytest.approx(brute(r.text), rel=1e-4, abs=1e-9)


def test_words_searched_together_equal_those_searched_alone():
    lattice, rng = pieces.Lattice.of(pieces.MODEL), np.random.default_rng(6)
    letters = list("aaetthn1ï.,Жи数据─═▁𝄞é\n")
    words = ["".join(rng.choice(letters, rng.integers(1, 25))) for _ in range(3000)] + ["▁the", "▁thethe", "a", "▁", "ab" * 12]
    got = lattice.firsts(words)
    assert sum(x is not None for x in got) > 500 and all(x in (None, lattice.first(w)) for w, x in zip(words, got))
    assert lattice.firsts(words, False)[-5:] == [lattice.first(w, False) for w in words[-5:]]
    assert lattice.firsts([]) == [] and lattice.firsts(["𝄞"]) == [None]


def test_the_words_of_a_batch_are_searched_together(monkeypatch):
    lattice, other = pieces.Lattice(pieces.MODEL), pieces.Lattice.of(pieces.MODEL)
    words = [f"▁th{'e' * (i % 9)}tion{i}" for i in range(500)]
    alone = [other.first(w) for w in words]
    known = lattice._known(10)
    known.learn(words)
    monkeypatch.setattr(lattice, "first", None)  # no word is left to be searched alone
    assert [known[w] for w in words] == alone
    assert [len(x) for x in pieces._portions(["a" * pieces.LETTERS_AT_ONCE, None, "b"])] == [1, 2]


def test_blocks_with_enough_words_equal_a_plain_count():
    rng = np.random.default_rng(9)
    words = [rng.integers(0, 60, k).astype(np.uint64) for k in (8, 9, 11, 30, 31)]
    vocabulary, needed = np.unique(np.concatenate(words)), np.array([4.0, 5.0, 6.0, 15.0, 16.0])
    hashes = rng.integers(0, 120, 900).astype(np.uint64)
    bounds = np.array([0, 0, 40, 45, 700, 900])
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[place] == hashes)
    text = np.searchsorted(bounds, at, "right") - 1
    for numbers in (np.array([0, 1, 2]), np.array([3, 4])):
        peers = decontaminate._Peers(numbers, words, np.zeros((5, 2)), needed, vocabulary)
        step = 4 * (peers.longest + decontaminate.UNIT)
        blocks = list(zip(*decontaminate._grid(bounds, 2 * step, step)[:2]))
        want = {(a, b, i) for a, b in blocks for i, k in enumerate(numbers) if np.isin(words[k], hashes[a:b]).sum() >= needed[k]}
        assert want and {tuple(map(int, x)) for x in zip(*peers.enough(bounds, at, text, place[at]))} == want
    assert decontaminate._different(np.array([3, 1, 3, 0])).tolist() == [0, 1, 3] and not len(decontaminate._different(np.zeros(0, int)))


def test_texts_of_a_batch_are_encoded_as_each_alone():
    lattice, rng = pieces.Lattice.of(pieces.MODEL), np.random.default_rng(9)
    letters = list("aaeetthhn é1ï.,***\"'(=\n\t ЖЗи据数取获一个ال─═ß▁𝄞   ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400)] + [None, "", " ", "a ", " a", "▁", "the" * 40]
    words, bounds = lattice.split_all(texts)
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])] == [lattice.split(t) for t in texts]
    for n in (1, 2, 10):
        for text, got in zip(texts, lattice.encode_all(texts, n).to_pylist()):
            ids, lists, _, _ = lattice.encode_best(text, n)
            assert got == {"piece_ids": ids.tolist(), "scores": [s for s, _ in lists], "round_trip": "▁" not in (text or "")}, text
    assert [len(lattice.encode_all(some, 3)) for some in ([], [None], ["", ""])] == [0, 1, 2]


def test_training_follows_the_gradient_of_every_word():
    texts = pseudo_likelihood.pa.array([" ".join(f"k{(i * j) % 37}" for i in range(400)) for j in range(1, 9)])
    flat = pseudo_likelihood.train_local(pseudo_likelihood.fresh().network, texts, 2.0)[0]  # so that no part is zero
    got, seen = pseudo_likelihood.train_local(flat, texts, 2.0)
    want = flat.copy()
    for tokens, context, _ in map(pseudo_likelihood._tokens, pseudo_likelihood.word_chunks(texts)):
        for a in range(0, len(tokens), pseudo_likelihood.BATCH):
            t, c = tokens[a : a + pseudo_likelihood.BATCH], context[:, a : a + pseudo_likelihood.BATCH]
            embedding, out, bias = pseudo_likelihood._parts(want)
            hidden = np.tanh(sum(embedding[j, c[j]] for j in range(len(c))))
            p = np.exp(hidden @ out + bias[0])
            error = (p / p.sum(1, keepdims=True) - np.eye(p.shape[1])[t]) * 2.0 / pseudo_likelihood.BATCH
            back = error @ out.T * (1 - hidden**2)
            new = [embedding.copy(), out - hidden.T @ error, bias - error.sum(0)]
            for j in range(len(c)):
                np.subtract.at(new[0][j], c[j], back)
            want = np.concatenate([x.ravel() for x in new])
    assert seen == 3200 and np.abs(got - want).max() < 1e-5 < np.abs(flat - want).max()


def test_words_and_byte_pairs_are_counted_in_one_pass(spark, monkeypatch):
    texts, scans = spark.createDataFrame([("ab ab b",), (None,)], "text string"), []
    to_arrow = type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, f, schema: scans.append(schema) or to_arrow(self, f, schema))
    counts, words, classes = pseudo_likelihood._count(texts)
    assert len(scans) == 1 and counts.sum() == 8 and counts[32, 97] == counts[97, 98] == 2 and counts[98, 32] == 3
    assert sorted(r.n_word for r in words.collect()) == [1, 2] and classes.agg(F.sum("n_class")).first()[0] == 3


def test_the_range_finder_makes_no_matrix_of_passages_and_buckets(spark, monkeypatch):
    rng, sums, peak = np.random.default_rng(12), [], []
    texts = pseudo_likelihood.pa.array([" ".join(f"k{x}" for x in rng.zipf(1.4, 64 * 1100))])

    def local(df, per_partition):
        tracemalloc.start()
        sums.append(per_partition([texts]))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return sums[-1]

    monkeypatch.setattr(decontaminate, "_sum_rows", local)
    monkeypatch.setattr(decontaminate, "word_chunks", lambda c, whole=list(decontaminate.word_chunks(texts)): whole)
    idf, _ = decontaminate.latent_space(SimpleNamespace(select=lambda *a: None))
    counts = np.zeros((1100, decontaminate.DIMENSIONS))
    for buckets, passage, _ in decontaminate._cut([texts]):
        np.add.at(counts, (passage, buckets), 1)
    start = np.random.default_rng(11).normal(size=(decontaminate.DIMENSIONS, decontaminate.RANK))
    want = (counts.T @ (counts @ (start * idf[:, None]))) * idf[:, None]
    assert np.allclose(sums[1], want, rtol=1e-4, atol=1e-4 * np.abs(want).max()) and peak[1] < 32e6
