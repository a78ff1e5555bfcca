"""Line CRF, language CRF, toxicity, pieces and the language model against brute force, the library or held-out labels."""

import collections
import itertools
import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from locusloom.llm import crf, katz, language_crf, line_quality, pieces, toxicity_kn

DOCS = "doc_id long, text string, lang string, source string"
ODD = [(90, None, None, None), (91, "", "en", ""), (92, " \n\t", "en", "x"), (93, "12 34 | $$", "en", "x"), (94, "a " * 30000, "en", "x"), (94, "a " * 30000, "en", "x"), (None, "no key here", None, None)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_viterbi_and_posteriors_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes, k = rng.integers(0, 6, 4), 3
        e, m = rng.normal(size=(sizes.sum(), k)) * 2, rng.normal(size=(k, k))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        post, best = crf.posteriors(e, ends, m), crf.viterbi(e, ends, m)
        for a, b in itertools.pairwise(ends):
            if a == b:
                continue
            paths = {y: sum(e[a + i, y[i]] for i in range(b - a)) + sum(m[y[i], y[i + 1]] for i in range(b - a - 1)) for y in itertools.product(range(k), repeat=int(b - a))}
            assert tuple(best[a:b]) == max(paths, key=paths.get)
            marginal = np.zeros((b - a, k))
            for y, s in paths.items():
                marginal[np.arange(b - a), y] += np.exp(s)
            assert np.allclose(marginal / marginal.sum(1, keepdims=True), post[a:b])


def test_blocked_posteriors_over_long_chains():
    rng = np.random.default_rng(2)
    ends = np.concatenate([[0], np.cumsum([100, 33, 32, 31, 0, 257])])
    e, m = rng.normal(size=(ends[-1], 3)), rng.normal(size=(3, 3))
    post = crf.posteriors(e, ends, m)
    for a, b in itertools.pairwise(ends):
        if b > a:
            assert np.allclose(crf._expected(e[None, a:b], m)[0][0], post[a:b])


def test_base_counts_against_brute_force():
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", " ", "\n", "#", "c|", "\t", "\x0b", "\x0c", "\r", "\xa0"]
    texts = [None, "", "\n", "a", " a b c a b c"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    got = line_quality.base_counts(line_quality.read_lines(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        text, words = text or "", words_of(text)
        seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        expected = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert expected == tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), text


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    stems = {"en": ["the", "ing", "tion", "wh", "er", "and"], "de": ["sch", "ung", "keit", "der", "ein", "ü"], "fr": ["eau", "ère", "que", "ment", "les", "ç"]}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3)))
    return lambda lang, n: " ".join(word(lang) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_quality_keeps_prose_and_drops_junk(spark, prose):
    good = [(i, "\n".join(prose("en", 20) for _ in range(5)), "en", "s") for i in range(40)]
    bad = [(50 + i, "\n".join(" | ".join(prose("en", 20).upper().split()) + " !!" for _ in range(5)), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(good + bad + ODD, DOCS).withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 50)) for i, *_ in good[:30] + bad[:30]] + [(1, None), (None, 1)], "doc_id long, quality int")
    field = line_quality.fit(docs, labels)
    kept = {r.doc_id: r for r in line_quality.score_documents(docs, field, keep=["doc_id"]).collect()}
    assert all(kept[i].kept for i, *_ in good)
    assert not any(kept[50 + i].kept for i in range(39))
    assert kept[91].n_words == 0 and kept[91].base_failed and not kept[91].kept and kept[91].content_share is None
    assert kept[94].base_failed and kept[94].n_repeat_words == 30000
    lines = line_quality.label_lines(docs.where("doc_id = 50"), field).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == list(range(5)) and not any(r.content for r in lines)
    empty = docs.limit(0)
    assert line_quality.score_documents(empty, line_quality.fit(empty, labels.limit(0)), keep=["doc_id"]).count() == 0


def test_language_of_documents_and_words(spark, prose):
    rows = [(i, prose(lang, 60), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    field = language_crf.fit(docs, among=F.col("doc_id") < 60)
    odd = spark.createDataFrame(rows[60:] + ODD, DOCS)
    found = {r.doc_id: r for r in language_crf.label_documents(odd, field, keep=["doc_id"]).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, _ in rows[60:])
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (90, 91, 92, 93))
    assert found[94].lang_pred in ("de", "en", "fr") and 0 <= found[94].score <= 1
    mixed = spark.createDataFrame([(1, "the thetion andwh ering schung keitder einkeit dersch eaumentque lesère queeau", None, None)], DOCS)
    words = [r.lang for r in language_crf.label_words(mixed, field).orderBy("word_no").collect()]
    assert words == ["en"] * 4 + ["de"] * 4 + ["fr"] * 3
    assert language_crf.fit(docs.limit(0)).labels == ()


def _kneser_ney(grams, counts, lower, gram):
    """The definition, for one n-gram as bytes: discounted share plus the context's weight times the lower order."""
    total = sum(c for g, c in zip(grams, counts, strict=True) if g[:-1] == gram[:-1])
    if not total:
        return lower
    kinds = sum(g[:-1] == gram[:-1] for g in grams)
    share = max(dict(zip(grams, counts, strict=True)).get(gram, 0) - toxicity_kn.DISCOUNT, 0) / total
    return share + toxicity_kn.DISCOUNT * kinds / total * lower


def test_toxic_likelihoods_against_the_definition():
    texts = [["idiot moron", "idiot the"], ["the and then", "and the"]]
    raw = []
    for side in texts:
        seen = collections.Counter()
        for word in " ".join(side).split():
            marked = b"\x01" + word.encode() + b"\x02"
            for i in range(1, len(marked)):
                seen[marked[max(0, i + 1 - toxicity_kn.ORDER) : i + 1].rjust(toxicity_kn.ORDER, b"\0")] += 1
        raw.append(seen)
    pack = lambda g: np.uint64(int.from_bytes(g, "big"))
    models = toxicity_kn.levels([np.array([pack(g) for g in s], np.uint64) for s in raw], [np.array(list(s.values())) for s in raw])
    both = {*raw[0], *raw[1]}
    for k, model in enumerate(models):
        for gram in list(both)[:25] + [b"\0\0\x01xyz"]:
            p = 1 / 256
            for n in range(1, toxicity_kn.ORDER):
                pool = both if n <= toxicity_kn.SHARED else set(raw[k])
                longer = {g[-n - 1 :] for g in pool}
                ends = collections.Counter(g[1:] for g in longer)
                p = _kneser_ney(list(ends), list(ends.values()), p, gram[-n:])
            p = _kneser_ney(list(raw[k]), list(raw[k].values()), p, gram)
            assert math.isclose(toxicity_kn.log_likelihood(model, np.array([pack(gram)], np.uint64))[0], math.log(p), rel_tol=1e-9)


def test_toxic_documents_are_found(spark, prose):
    rng = random.Random(3)
    insults = ["idiot", "moron", "scum", "worthless"]

    def text(toxic):
        words = prose("en", 80).split()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        return " ".join(words)

    rows = [(i, text(i % 3 == 0), "en", "s") for i in range(240)]
    docs = spark.createDataFrame(rows + [(1000 + (k or 0), *rest) for k, *rest in ODD], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(180)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity_kn.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity_kn.score_documents(docs, model, keep=["doc_id"]).collect()}
    right = sum(found[i].predicted == int(i % 3 == 0) for i in range(180, 240))
    assert right >= 57
    assert found[1090].score < 0.5 and found[1091].score == found[1090].score
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = toxicity_kn.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity_kn.score_documents(docs, nothing, keep=["doc_id"]).collect()} == {0.0}


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_vocabulary())


def _field(n, kind, x):
    def var(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    return var(n << 3 | kind) + (var(x) if kind == 0 else x if kind == 5 else var(len(x)) + x)


def test_pieces_are_those_of_the_library(encoder):
    v = pieces.read_vocabulary()
    proto = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True))
    proto += _field(2, 2, _field(3, 0, 1) + _field(35, 0, 1)) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 0))
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "ß", "日", "😀", "\t", "th", "ing", "q", "\x00", "한", "$", "!!", " the", "ñ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", "x" * 300, "é" * 100, " " * 70, "日本語" * 60, None]
    ids, ends = encoder.encode_all(texts)
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        got = ids[a:b].tolist()
        assert got == (library.encode(text) if text else []), text
        assert encoder.decode(got) == (text or "")


def test_encoding_round_trip_over_rows(spark, encoder):
    docs = spark.createDataFrame([(1, "Hello,  wörld\n日 😀", "en", "s"), *ODD], DOCS)
    encoded = pieces.encode(docs, encoder, keep=["doc_id", "text"])
    rows = pieces.decode(encoded.withColumnRenamed("text", "before"), encoder, to="after").collect()
    assert len(rows) == 1 + len(ODD) and all(r.before == r.after for r in rows)
    audit = {r.doc_id: r for r in pieces.audit(docs, encoder).collect()}
    assert all(r.decodes for r in audit.values()) and audit[90].n_pieces == 0 and audit[1].n_byte_pieces > 0
    assert pieces.encode(docs.limit(0), encoder).count() == 0
    assert encoder.decode([encoder.byte_ids[0xFF].item()]) == "�"


@pytest.mark.parametrize("share", [0.0, 2.0**-5])
def test_katz_against_the_definition(spark, share):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 60))) for i in range(60)}
    texts |= {90: None, 91: "Never SEEN", 92: " "}
    rows = [(i, t, None, None) for i, t in texts.items()] + [(3, texts[3], None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = [r.asDict() for r in katz.score_documents(docs, F.col("doc_id") % 10 == 1, share=share).collect()]
    assert len(got) == len(rows)
    tokens = {i: [*words_of((t or "").lower()), None] for i, t in texts.items()}
    words, pairs = collections.Counter(), collections.Counter()
    for i, *_ in rows:
        if i % 10 != 1:
            words.update(tokens[i])
            pairs.update(zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True))
    n = sum(words.values())
    contexts = {w for w in words if words[w] >= max(1, share * n) and w is not None} | {"<s>"}
    pairs = {k: c for k, c in pairs.items() if k[0] in contexts}
    d1, d2 = (katz.discounts(collections.Counter(x.values())) for x in (words, pairs))
    cut = lambda d, c: (d[c] if c <= katz.DISCOUNTED else 1.0) * c
    mass = sum(cut(d1, c) for c in words.values())
    events = n + (mass >= n)
    p1 = lambda w: cut(d1, words[w]) / events if words[w] else 1 - mass / events
    size, weight = {}, {}
    for h in contexts:
        after = {w: c for (g, w), c in pairs.items() if g == h}
        if after:
            total, kept = sum(after.values()), sum(cut(d2, c) for c in after.values())
            size[h] = total + (kept >= total)
            weight[h] = (1 - kept / size[h]) / (1 - sum(p1(w) for w in after))
            unseen = sum(p1(w) for w in words if w not in after) + 1 - mass / events
            assert math.isclose(kept / size[h] + weight[h] * unseen, 1)
    for r in got:
        t = tokens[r["doc_id"]]
        score = sum(math.log10(cut(d2, pairs[h, w]) / size[h] if (h, w) in pairs else weight.get(h, 1) * p1(w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True))
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (len(words) + 1))) for w in t)
        assert math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(words[w] > 0 for w in t), n, r["doc_id"] % 10 == 1)
    assert katz.score_documents(docs.limit(0), F.lit(False)).count() == 0


def test_katz_keeps_every_context(spark):
    """Of more than 2**17 training tokens, bigrams after words seen once or twice count as others do; words are frequent and rare."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30000)]
    weights = list(itertools.accumulate(1 / (k + 1) for k in range(30000)))
    texts = {i: " ".join(rng.choices(vocabulary, cum_weights=weights, k=1000)) for i in range(300)}
    texts |= {300: "once upon", 301: "once upon", 310: "once more"}
    got = {r.doc_id: r.score for r in katz.score_documents(spark.createDataFrame([(i, t, None, None) for i, t in texts.items()], DOCS), F.col("doc_id") % 10 == 1).collect()}
    tokens = {i: [*t.split(), None] for i, t in texts.items()}
    words, pairs, after = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for i, t in tokens.items():
        if i % 10 != 1:
            words.update(t)
            pairs.update(zip(["<s>", *t[:-1]], t, strict=True))
    n = sum(words.values())
    assert n > 2**17 and min(words.values()) == 1 and words["once"] == 2
    for (h, w), c in pairs.items():
        after[h].append((w, c))
    d1, d2 = (katz.discounts(collections.Counter(x.values())) for x in (words, pairs))
    cut = lambda d, c: (d[c] if c <= katz.DISCOUNTED else 1.0) * c
    mass = sum(cut(d1, c) for c in words.values())
    events = n + (mass >= n)
    p1 = lambda w: cut(d1, words[w]) / events if words[w] else 1 - mass / events
    size, weight = {}, {}
    for h, seen in after.items():
        total, kept = sum(c for _, c in seen), sum(cut(d2, c) for _, c in seen)
        size[h] = total + (kept >= total)
        weight[h] = (1 - kept / size[h]) / (1 - sum(p1(w) for w, _ in seen))
    for i, t in tokens.items():
        score = sum(math.log10(cut(d2, pairs[h, w]) / size[h] if (h, w) in pairs else weight.get(h, 1) * p1(w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True))
        assert math.isclose(got[i], score, rel_tol=1e-9), i


def test_words_of_any_script_vote_for_the_language():
    field = language_crf.fit_texts({"en": ["the house is near the river and the road"] * 5, "ru": ["дом стоит у реки и дорога рядом"] * 5}, chains=400)
    text = "дом стоит у реки the дорога рядом 12 …"
    post, lettered, *_ = field.words(pa.array([text]))
    assert lettered.tolist() == [True] * 7 + [False] * 2
    (lang,), (score,) = field.documents(pa.array([text]))
    assert lang == "ru" and math.isclose(score, post[:7, 1].mean())
    assert field.documents(pa.array(["12 … 34", None]))[0] == ["und", "und"]


def test_partition_keys_meet_each_partition(spark):
    from locusloom.llm.common import partition_keys

    for n in (1, 8, 51):
        rows = spark.createDataFrame([(k,) for k in partition_keys(n)], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("p"))
        assert [r.p for r in rows.collect()] == list(range(n))


def test_columns_with_the_names_of_added_ones_are_replaced(spark, encoder):
    """By default all columns are kept but those that an operator adds; keys other than integers are refused."""
    docs = spark.createDataFrame([(1, "one two three " * 30, "en", "s"), *ODD], DOCS).withColumns({c: F.lit("clash") for c in ("n_words", "lang_pred", "ids", "score", "predicted")})
    field = line_quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    for out in (
        line_quality.score_documents(docs, field),
        language_crf.label_documents(docs, language_crf.fit(docs)),
        toxicity_kn.score_documents(docs, toxicity_kn.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")).limit(0))),
        pieces.encode(docs, encoder),
        pieces.decode(pieces.encode(docs, encoder), encoder),
    ):
        assert len(set(out.columns)) == len(out.columns) and out.count() == docs.count()
    with pytest.raises(ValueError, match="integer"):
        katz.score_documents(docs.withColumn("doc_id", F.col("doc_id").cast("string")), F.lit(False))
    assert language_crf.label_documents(docs.limit(0), language_crf.fit(docs)).count() == 0
    assert toxicity_kn.score_documents(docs.limit(0), toxicity_kn.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")).limit(0))).count() == 0
    scored = katz.score_documents(docs.select("doc_id", "text"), F.lit(False)).collect()
    assert sum(r.doc_id is None for r in scored) == 1 and len(scored) == docs.count()
