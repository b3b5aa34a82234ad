"""URL filters, language ID, secret scans, toxicity, chat formatting and byte-level BPE on small cases."""

import base64
import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import byte_bpe, chat_format, language_id, queries, secret_scan, textbytes, toxicity, url_filters

BPE = queries.BPE
DOCS = "doc_id long, text string"


def rows(df):
    return {r[0]: r for r in df.collect()}


def test_spans_stop_at_documents():
    data = np.frombuffer(b"ab cdef", np.uint8)
    starts, ends, offsets = textbytes.spans(~textbytes.IS_WHITE[data], np.array([0, 5, 5, 7]))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 2), (3, 5), (5, 7)] and offsets.tolist() == [0, 2, 2, 3]
    same = textbytes.hash_spans(np.frombuffer(b"xx the the", np.uint8), np.array([3, 7, 0]), np.array([6, 10, 2]))
    assert same[0] == same[1] != same[2]


# URL filters


def test_url_rules_and_terms(spark):
    urls = [
        (0, "http://A.example.org/es/1"), (1, "http://example.org/en/12?x=1"), (2, "http://notexample.org/es/1"), (3, "https://x.example.com/fr/casino"),
        (4, "https://shop.example.net/free-bets"), (5, "https://shop.example.net/free-free"), (6, "https://scasinos.example.net/"),
        (7, None), (8, ""), (9, "no scheme casino"), (10, "http://example.org"), (11, "http://a.com/de"), (12, "http://h.net/a#casino"),
    ]
    found = rows(url_filters.judge(spark.createDataFrame(urls, "page_id long, url string"), rules=queries.URL_RULES))
    verdicts = {k: (r.host, r.path, r.rule, r.verdict) for k, r in found.items()}
    assert verdicts[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert verdicts[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert verdicts[2] == ("notexample.org", "/es/1", "org/", "allow")
    assert verdicts[3][2:] == ("com/fr/", "allow") and verdicts[4][2:] == (None, "block") and verdicts[5][2:] == (None, "allow")
    assert verdicts[6][2:] == (None, "allow") and verdicts[7] == verdicts[8] == ("", "", None, "allow")
    assert verdicts[9] == ("", "", None, "block") and verdicts[10][1:] == ("", None, "allow") and verdicts[11][2:] == (None, "allow")
    assert verdicts[12] == ("h.net", "/a", None, "block")


def test_url_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("http://a.org/x", "old", "old")], "url string, host string, verdict string")
    made = url_filters.judge(df, rules=queries.URL_RULES)
    assert made.columns.count("host") == 1 and made.first().host == "a.org"
    assert url_filters.judge(df.limit(0), vocabulary={}).count() == 0


# Language ID


def naive_viterbi(scores, penalty):
    best = max(
        itertools.product(range(scores.shape[1]), repeat=len(scores)),
        key=lambda p: sum(scores[i, s] for i, s in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False)),
    )
    return sum(scores[i, s] for i, s in enumerate(best)) - penalty * sum(a != b for a, b in zip(best, best[1:], strict=False))


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_viterbi_is_the_best_path(chunk):
    rng = np.random.default_rng(chunk)
    offsets = np.array([0, 6, 6, 7, 14])
    scores = rng.normal(0, 2, (14, 3)).astype(np.float32)
    path = language_id.viterbi(scores, offsets, 1.5, chunk)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        mine = sum(scores[i, path[i]] for i in range(a, b)) - 1.5 * sum(path[i] != path[i + 1] for i in range(a, b - 1))
        assert b == a or abs(mine - naive_viterbi(scores[a:b], 1.5)) < 1e-4


@pytest.mark.parametrize("chunk", [2, 100])
def test_viterbi_of_many_languages(chunk):
    """Each stretch of three words belongs clearly to one of 300 states, so the path is known."""
    want = np.repeat([0, 127, 128, 255, 256, 299], 3)
    scores = np.full((len(want), 300), -50, np.float32)
    scores[np.arange(len(want)), want] = 0
    for offsets in (np.array([0, len(want)]), np.arange(0, len(want) + 1, 3)):
        assert language_id.viterbi(scores, offsets, 1.5, chunk).tolist() == want.tolist()


def test_language_of_mixed_and_odd_texts(spark):
    english, german, russian = "the cat and the dog were there then", "der hund und die katze waren dort dann", "кот и собака были там тогда"
    known = [(i, t, n) for i, (t, n) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 8)]
    model = language_id.train(spark.createDataFrame([*known, (99, None, "en"), (98, "x", None)], DOCS + ", lang string"))
    assert model.languages == ["de", "en", "ru"]
    texts = [(0, f"{english}. {russian}. {german} {german} {german}"), (1, None), (2, ""), (3, "123 !?"), (4, english), (4, english), (5, "кот"), (6, "the " * 30_000)]
    df = spark.createDataFrame(texts, DOCS).selectExpr("*", "'kept' AS score")
    got = language_id.identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts) and by[0].lang_pred == "de" and [s["lang"] for s in by[0].spans] == ["en", "ru", "de"]
    part = by[0].spans[1]
    assert texts[0][1][part["start"] : part["end"]] == russian
    assert {by[i].lang_pred for i in (1, 2, 3)} == {"und"} and by[1].score == 0.0 and by[4].lang_pred == "en" and by[5].lang_pred == "ru"
    assert by[6].lang_pred == "en" and by[6].score == 1.0


def test_language_without_training_or_rows(spark):
    none = language_id.train(spark.createDataFrame([], DOCS + ", lang string"))
    assert language_id.identify(spark.createDataFrame([(1, "words here")], DOCS), none).first().lang_pred == "und"
    assert language_id.identify(spark.createDataFrame([], DOCS), none).count() == 0


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op3(spark, sf).where("held_out").join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) > 100 and (found.lang == found.lang_pred).mean() > 0.97


# Secret scans


def naive_base(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate([("assign", secret_scan.ASSIGN, 2, 6), ("access", secret_scan.ACCESS, 0, 20), ("hex", secret_scan.HEX, 0, 24)]):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_secret_patterns_and_redaction(spark):
    key, digits = "AKIA" + "Z9" * 9, "0a" * 12
    texts = [
        (0, f"é Password = '{'x1' * 4}' and {key} or {digits}"), (1, "token=abc secret:token:abcdef"), (2, None), (3, ""), (4, f"token={digits}"),
        (5, "AKIA123 " + digits[:22] + " plain words"), (6, "x " * 50_000 + f"api_key={key}"), (6, "again"),
    ]
    found = secret_scan.scan(spark.createDataFrame(texts, DOCS), None, redact="#").collect()
    assert len(found) == len(texts)
    for r, (_, text) in zip(sorted(found, key=lambda r: (r.doc_id, len(r.text or ""))), sorted(texts, key=lambda t: (t[0], len(t[1] or ""))), strict=True):
        joined = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.secrets)
        if r.doc_id != 6 or text != "again":
            assert joined == naive_base(text or "")
    by = {r.doc_id: r for r in found if r.text != "again"}
    assert by[0].text == "é #' and # or #" and by[4].text == "#" and by[2].text is None and by[5].text == texts[5][1]


def test_network_adds_unseen_secrets(spark):
    rng = np.random.default_rng(0)
    letters = np.array(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789"))
    make = lambda: "".join(rng.choice(letters, 28))
    texts = [(i, f"we say password={make()} here") for i in range(250)]
    texts += [(1000 + i, f"see page/section-{rng.integers(1000)}/item-{rng.integers(100)} now") for i in range(250)]
    df = spark.createDataFrame(texts, DOCS)
    network = secret_scan.train(df)
    new = spark.createDataFrame([(1, f"the entry was {make()} as far as known"), (2, "see page/section-77/item-5 now"), (3, "nothing")], DOCS)
    found = rows(secret_scan.scan(new, network).select("doc_id", "secrets"))
    assert [s["kind"] for s in found[1].secrets] == ["cnn"] and found[1].secrets[0]["score"] >= network.threshold and not found[2].secrets
    kept = secret_scan.scan(df, network).selectExpr("count_if(exists(secrets, s -> s.kind = 'assign')) AS n").first().n
    assert kept == 250


def test_secrets_without_findings(spark):
    empty = spark.createDataFrame([], DOCS)
    assert secret_scan.train(empty) is None and secret_scan.scan(empty, None).count() == 0


# Toxicity


def test_toxicity_finds_the_sentence(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    say = lambda: " ".join(rng.choice(words, 6)) + "."
    docs, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        docs.append((i, " ".join([say(), say(), (f"alpha {rng.choice(['vilewort', 'fool'])} beta." if toxic else say()), say()])))
        labels.append((i, int(toxic)))
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (1, None)], "doc_id long, toxic int"))
    text = "alpha beta. Ärger, VILEWORTS beta! gamma delta."
    asked = [(1, text), (2, "alpha beta. gamma."), (3, None), (4, ""), (5, "alpha beta gamma. " * 20_000), (2, "alpha beta. gamma.")]
    got = toxicity.score(spark.createDataFrame(asked, DOCS).selectExpr("*", "7 AS predicted"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].predicted == 1 and by[2].predicted == by[3].predicted == by[4].predicted == 0
    assert [text[s["start"] : s["end"]] for s in by[1].toxic_spans] == ["Ärger, VILEWORTS beta"]
    assert by[3].score == by[4].score and all(0 <= r.score <= 1 for r in got)


def _toxic_by_hand(text, model):
    """(score, offending sentences) by a plain loop over the sentences of one text."""
    shift, one = 64 - toxicity.BUCKET_BITS, np.uint64(1)
    logits = []
    for sentence in re.finditer(r"[^\n\r!.?]+", text):
        words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", sentence.group())
        if not words:
            continue
        z = model.bias
        for word in words:
            low = "".join(c.lower() if c.isascii() else c for c in word).encode()
            z += model.weights[textbytes.hash_spans(np.frombuffer(low, np.uint8), np.array([0]), np.array([len(low)]))[0] >> np.uint64(shift)]
            for i, length in enumerate(toxicity.BEGINNINGS, 1):
                part = np.frombuffer(low[:length], np.uint8)
                key = textbytes.hash_spans(part, np.array([0]), np.array([len(part)])) + one * np.uint64(i)
                z += model.weights[textbytes.mix(key)[0] >> np.uint64(shift)]
        at = sentence.start() + sentence.group().index(words[0])
        logits.append((z, at, sentence.start() + sentence.group().rindex(words[-1]) + len(words[-1])))
    clean = 1 / (1 + np.exp(model.leak))
    for z, _, _ in logits:
        clean *= 1 / (1 + np.exp(z))
    hits = [(a, b) for z, a, b in logits if z >= 0] or [max(logits)[1:]] if logits and clean <= 0.5 else []
    return 1 - clean, hits


def test_toxicity_equals_a_loop_over_sentences(spark):
    rng = np.random.default_rng(14)
    model = toxicity.Model(rng.normal(scale=1.5, size=1 << toxicity.BUCKET_BITS).astype(np.float32), -4.0, -5.0)
    words, ends = ["alpha", "Beta", "Ärger", "naïve", "x", "gamma-delta", "日本", "12", "omicron"], [". ", "! ", "?\n", ", ", " ", "... "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.integers(0, 30))) for _ in range(150)] + [None, "", "12. 34!", " . "]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        score, hits = _toxic_by_hand(text or "", model)
        assert abs(got[i].score - score) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5)
        assert [(x.start, x.end) for x in got[i].toxic_spans] == hits


def test_located_sentences_and_languages_of_the_queries(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op7(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").collect()
    assert all(bool(r.toxic_spans) == bool(r.predicted) for r in found if r.text) and any(r.predicted for r in found)
    assert all(0 <= s.start < s.end <= len(r.text) for r in found for s in r.toxic_spans)
    named = queries.op3(spark, sf).collect()
    assert all(r.lang_pred in {s.lang for s in r.spans} for r in named if r.lang_pred != "und")


def test_toxicity_with_one_label_or_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    only = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, only).collect()} == {1}
    none = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0} and toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op7(spark, sf).where("held_out").join(queries.table(spark, sf, "labels"), "doc_id").toPandas()
    right = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert right / found.predicted.sum() > 0.9 and right / found.toxic.sum() > 0.7


# Chat formatting


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant ok", "&lt;|", "&amp;<", "", "|x", "<", "a\nb"]
    turns = [(i, j, role, text) for i, text in enumerate(odd) for j, role in enumerate(["user", "assistant", "assistant"])]
    turns += [(50, None, None, None), (50, 1, "assistant", None), (51, 0, "a\nb", "x"), (52, 0, "user", "s"), (52, 0, "user", "s"), (None, 0, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumnsRenamed({}).selectExpr("*", "'x' AS formatted")
    found = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    want: dict = {}
    for conv, turn, role, text in turns:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(want)
    for conv, said in want.items():
        said.sort()
        r, loss = found[conv], "".join(t for *_, role, t in said if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in said).encode()).hexdigest() and r.n_turns == len(said)
        assert (r.loss_chars, r.loss_sha256, r.rewrites_history) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_template_that_rewrites_history():
    def only_last_thought(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 or r == 'user' else t.split('#')[-1]};" for i, (r, t) in enumerate(turns))

    turns = [("user", "hi"), ("assistant", "think#yes"), ("user", "more")]
    whole, spans, inner, rewrites = chat_format.locate(only_last_thought, turns)
    assert rewrites and whole == "[user]hi;[assistant]yes;[user]more;" and whole[slice(*inner[1])] == "yes"
    whole, spans, inner, rewrites = chat_format.locate(chat_format.marked_turns, turns)
    assert not rewrites and [whole[a:b] for a, b in inner] == [t for _, t in turns] and "".join(whole[a:b] for a, b in spans) == whole


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abeinrst '\n\t  äé日😀1²")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_bpe_equals_the_library(library, texts):
    vocabulary = byte_bpe.load(*BPE)
    ids, offsets = vocabulary.encode(texts)
    for i, text in enumerate(texts):
        mine = ids[offsets[i] : offsets[i + 1]]
        assert mine.tolist() == library.encode_ordinary(text) and vocabulary.decode(mine) == text.encode()


def test_bpe_frames(spark, library):
    texts = [(0, "Hello there, World"), (1, None), (2, ""), (3, "supercalifragilistic" * 400), (4, "naïve 😀 \n\n x"), (4, "naïve 😀 \n\n x"), (5, "b" * 3000)]
    df = spark.createDataFrame(texts, DOCS).selectExpr("*", "'old' AS ids", "1 AS decoded")
    for packed in (False, True):
        encoded = byte_bpe.encode(df, *BPE, packed=packed)
        got = sorted(byte_bpe.decode(encoded, *BPE).collect(), key=lambda r: r.doc_id)
        for r, (_, text) in zip(got, texts, strict=True):
            ids = np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids
            assert ids == library.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
    both = sorted(byte_bpe.encode(df, *BPE, packed=True, decoded="decoded").collect(), key=lambda r: r.doc_id)
    assert [(bytes(r.decoded), len(r.ids) // 4) for r in both] == [((t or "").encode(), len(library.encode_ordinary(t or ""))) for _, t in texts]
    assert byte_bpe.encode(df.limit(0), *BPE).count() == 0


def test_bpe_of_long_pieces(library, monkeypatch):
    """Rows with places by rank equal the library's, and equal rows of the matrix when ranks don't grow with merges."""
    vocabulary, rng = byte_bpe.load(*BPE), np.random.default_rng(8)
    texts = ["".join(rng.choice(list(letters), n)) for letters in ("ab", "aeiou", "abcdefghijklmnopqrstuvwxyz", "éüñß", "日本語の文") for n in (513, 1500, 4001)]
    texts += ["a" * n for n in (512, 513, 1023, 5000)] + ["=" * 3000, "ab" * 1500 + "a", " " * 2000 + "x"]
    ids, offsets = vocabulary.encode(texts)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(text)
    monkeypatch.setattr(vocabulary, "least", np.zeros_like(vocabulary.least))  # as if any new pair could come first
    for text in texts[::3]:
        raw = vocabulary.byte_ids[np.frombuffer(text.encode(), np.uint8)]
        rows, _ = vocabulary.merge_rows(raw[None, :], np.array([len(raw)]))
        assert vocabulary.merge_long(raw).tolist() == rows.tolist()


def test_bpe_cache_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    vocabulary = byte_bpe.Vocabulary(*BPE)
    for text in ("one two three four", "five six seven", "one two three four"):
        assert vocabulary.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_word_split_is_the_contract():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1cb c\xa0d") == ["a\x1cb", "c\xa0d"]
